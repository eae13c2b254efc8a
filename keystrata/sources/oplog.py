"""Op logs (key, lsn, op, value) over Parquet tables, and text traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def of_events(events: DataFrame) -> DataFrame:
    """One operation for each event on its user's key; errors are deletes."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("event_id").cast("long").alias("lsn"),
        F.when(gone, "delete").otherwise("put").alias("op"),
        F.when(~gone, F.concat("event_type", F.lit("|"), F.coalesce("props", F.lit("")))).alias("value"),
    )


def sized(table: DataFrame, key: str, value: str) -> DataFrame:
    """key, key_size and value_size in bytes, of puts of a table's columns."""
    name = F.col(key).cast("string")
    return table.select(
        name.alias("key"), F.octet_length(name).cast("long").alias("key_size"), F.coalesce(F.octet_length(F.col(value)), F.lit(0)).cast("long").alias("value_size")
    )


def order_key(column: str = "o_orderkey"):
    return F.lpad(F.col(column).cast("string"), 12, "0")


def line_key():
    return F.concat(order_key("l_orderkey"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))


def turn_key():
    return F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 4, "0"))


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text trace as (line_no, line); line_no rises with the position in the files and has gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def trace_ops(lines: DataFrame) -> DataFrame:
    """line_no, op, key, key_size and value of lines `PUT ksz key vsz value` and `GET ksz key`; what is not PUT is GET."""
    parts = F.split("line", " ", 5)
    put = F.get(parts, F.lit(0)) == "PUT"
    return lines.select(
        "line_no",
        F.when(put, "put").otherwise("get").alias("op"),
        F.get(parts, F.lit(1)).try_cast("long").alias("key_size"),
        F.get(parts, F.lit(2)).alias("key"),
        F.when(put, F.get(parts, F.lit(3)).try_cast("long")).alias("value_size"),
        F.when(put, F.get(parts, F.lit(4))).alias("value"),
    )


def trace_errors(ops: DataFrame) -> DataFrame:
    """Operations whose stated sizes differ from their key's or value's length."""
    key_bad = ~F.col("key_size").eqNullSafe(F.octet_length("key").cast("long"))
    value_bad = (F.col("op") == "put") & ~F.col("value_size").eqNullSafe(F.octet_length("value").cast("long"))
    return ops.filter(key_bad | value_bad)
