"""What several corpus operators share: reading, lineage cuts, balanced blocks, joins that stand hot keys."""

from __future__ import annotations

import json
import math
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: ASCII white space: what separates words in every operator here.
WS = r"\x20\x09-\x0D"
BATCH_BYTES = "8m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone, and bounds the bytes of a batch sent to them.

    Spark's bound is far larger than what a batch needs, and each batch stands in direct memory of the executor until a collection.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir: survives lost executors and ends the lineage.

    Where the setting is absent (tests, one machine), a temporary folder serves; on a cluster that would not be shared, so
    it is an error there.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text as a long (null: 0), without building an array of them."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]+", "")
    return F.length(F.regexp_replace(bare, f"[^{WS}]++[{WS}]*+", "x")).cast("long")


SUBS = 1024


class Deal:
    """Deals rows into blocks of about `rows_per_block` rows by a key of whole numbers, in the key's order, nulls first.

    Blocks number at most four times the square root of the rows, so that a table with a row for each block stays small against any task
    while a block grows with the root alone. A key (or null) that holds more than a block's share is a range by itself and is split further
    by a tie-breaking number from 0 to SUBS - 1; the order of rows is then (key, that number, ...).
    """

    def __init__(self, df: DataFrame, key: str, rows_per_block: int):
        rows, held = df.agg(F.count(F.lit(1)), F.count(key)).first()
        n = max(1, min(-(-held // rows_per_block), 4 * math.isqrt(held)))
        found: list[int] = []
        if n > 1:
            found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("b")).first()["b"] or []
        self.hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
        self.hot_null = rows - held > max(rows_per_block, rows // n if n > 1 else 0)
        self.bounds = sorted({*found, *self.hot, *(v + 1 for v in self.hot)})

    def block(self, key: Column, sub: Column) -> Column:
        split = (key.isNull() & F.lit(self.hot_null)) | (F.coalesce(key.isin(self.hot), F.lit(False)) if self.hot else F.lit(False))
        at = F.when(key.isNull(), 0).otherwise(block_of(key, self.bounds) + 1)
        return (at * SUBS + F.when(split, sub).otherwise(0)).cast("long")


def block_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below the key, a binary search; null keys go to block 0."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 16:
        return F.coalesce(sum((key >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at)
    )
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def running(df: DataFrame, group: list[str], block: str, order: list, totals: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Adds `rank` (0-based) and `before_<c>` for each c of totals: exact running figures within `group` in the order (block, *order).

    Blocks are numbered in that order and each is small, so no task gets a whole group: rows are ranked inside (group, block)
    and shifted by the totals of the blocks before, a table with one row for each block. Group and block hold no nulls.
    `counted` has the group, block and totals of the same rows, where those are cheaper to read than df.
    """
    per = (df if counted is None else counted).groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in totals))
    past = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *group,
        block,
        F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_o_n"),
        *(F.coalesce(F.sum(f"_s_{c}").over(past), F.lit(0)).alias(f"_o_{c}") for c in totals),
    )
    here = Window.partitionBy(*group, block).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumns(
        {"rank": F.row_number().over(here).cast("long") - 1} | {f"before_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in totals}
    )
    out = ranked.join(offsets, [*group, block], "left")
    out = out.withColumns({"rank": F.col("rank") + F.col("_o_n")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"_o_{c}") for c in totals})
    return out.drop("_o_n", *(f"_o_{c}" for c in totals))


def attach(rows: DataFrame, key: str, table: DataFrame, weight: str, share: int = 1000) -> DataFrame:
    """rows left join table on key (unique in table), where `weight` of the table counts the rows of each key.

    Keys holding at least 1/share of all rows number at most `share`, so that part of the table is broadcast and its rows
    never move; the other keys are joined by a shuffle, where none is hot. Rows are not read for other keys if there are none.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) * share >= total).withColumn("_hot", F.lit(True))
    values = [c for c in table.columns if c != key]
    marked = rows.join(F.broadcast(hot), key, "left")
    done = marked.filter("_hot").drop("_hot")
    cold = table.filter(F.col(weight) * share < total)
    if cold.isEmpty():
        return done
    rest = marked.filter("_hot is null").drop("_hot", *values)
    return done.unionByName(rest.join(cold, key, "left"))
