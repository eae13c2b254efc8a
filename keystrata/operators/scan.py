"""Ordered access: seeks, bounded and prefix scans, many scans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import order

GREATER, GREATER_OR_EQUAL, FETCH_FIRST = "greater", "greater_or_equal", "fetch_first"
MAX_SEEK = 252


def seek(state: DataFrame, mode: str = FETCH_FIRST, key: str | bytes | None = None) -> DataFrame:
    """Rows from the seek position on, in no order yet; a filter on a stored key is pushed into the scan. Keys are strings or bytes."""
    if mode == FETCH_FIRST:
        return state
    if mode not in (GREATER, GREATER_OR_EQUAL):
        raise ValueError("Unknown seek scanner mode")
    if key is None:
        raise ValueError("a seek needs a key")
    if len(key.encode() if isinstance(key, str) else key) > MAX_SEEK:
        raise ValueError("the seek key is too long")
    return state.filter(F.col("key") > F.lit(key) if mode == GREATER else F.col("key") >= F.lit(key))


def scan(state: DataFrame, n: int, mode: str = FETCH_FIRST, key: str | bytes | None = None, reverse: bool = False) -> DataFrame:
    """The first n rows from the position in key order, with their place; a top-k, not a sort of everything."""
    by = F.col("key").desc() if reverse else F.col("key").asc()
    rows = seek(state, mode, key).orderBy(by).limit(n)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(by)).cast("long"))


def prefix(state: DataFrame, start: str) -> DataFrame:
    return state.filter(F.col("key").startswith(start))


def next_key(state: DataFrame) -> DataFrame:
    """key and the key after it in global order (null after the last)."""
    placed = order.reliable(order.positions(state.select("key"), "key"))
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("key").alias("next_key"))
    return placed.join(after, "pos", "left").select("key", "next_key")


def batch_scan(state: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """For each start (column start) its first n keys at or after it: start, key, pos from 1.

    Keys get positions once; a start's first position is how many keys are less than it, counted in one order of both; the
    rest is an equality join on positions. No range join, whatever the number of starts.
    """
    keys = state.select("key")
    both = keys.select("key", F.lit(1).alias("kind")).unionByName(starts.select(F.col("start").alias("key"), F.lit(0).alias("kind")))
    placed = order.reliable(order.positions(both, "key", "kind", counted=F.col("kind") == 1))
    asked = placed.filter("kind = 0").select(F.col("key").alias("start"), F.col("pos").alias("first"))
    wanted = asked.withColumn("at", F.explode(F.sequence("first", F.col("first") + n - 1)))
    held = placed.filter("kind = 1").select("key", F.col("pos").alias("at"))
    return wanted.join(held, "at").select("start", "key", (F.col("at") - F.col("first") + 1).alias("pos"))


def positions(state: DataFrame, starts: DataFrame) -> DataFrame:
    """For each start (column start) whether a scanner from there is valid, and its current key and value."""
    first = batch_scan(state, starts, 1).select("start", "key").join(state.select("key", "value"), "key")
    return starts.join(first, "start", "left").select("start", F.col("key").isNotNull().alias("is_valid"), "key", "value")
