"""Global order without a task that sees all rows: positions, running figures, floor search."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir (a temporary folder only where that is unset and one machine does everything)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """Rows in range partitions of the order, each with its number `_part`; kept, so that the ranges stay the same."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def positions(df: DataFrame, *order: str, counted: Column | None = None) -> DataFrame:
    """Adds `pos`, how many rows stand before a row in the order (only those where `counted` holds, if given)."""
    one = F.lit(1) if counted is None else counted.cast("int")
    ranged = dealt(df.withColumn("_one", one), *order)
    per = ranged.groupBy("_part").agg(F.sum("_one").alias("_n"))
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = per.select("_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_before", F.coalesce(F.sum("_one").over(here), F.lit(0))).join(F.broadcast(offsets), "_part")
    return out.withColumn("pos", (F.col("_before") + F.col("_offset")).cast("long")).drop("_one", "_part", "_before", "_offset")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before and at each row."""
    ranged = dealt(df, *order)
    per = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_upto", F.sum(value).over(here)).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_upto") + F.col("_offset")).cast("long")).drop("_part", "_upto", "_offset")


def floor_search(keys: DataFrame, guards: DataFrame) -> DataFrame:
    """key and guard, the largest guard at or below each key (null: none), as a lookup in a table of first keys."""
    both = keys.select("key", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_guard"))
    both = both.unionByName(guards.select(F.col("guard").alias("key"), F.lit(0).alias("_kind"), F.col("guard").alias("_guard")))
    ranged = dealt(both, "key", "_kind")
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    past = ranged.groupBy("_part").agg(F.max("_guard").alias("_last")).select("_part", F.max("_last").over(line).alias("_past"))
    here = Window.partitionBy("_part").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_here", F.max("_guard").over(here)).join(F.broadcast(past), "_part").filter("_kind = 1")
    return found.select("key", F.coalesce("_here", "_past").alias("guard"))
