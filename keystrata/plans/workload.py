"""Synthetic key-value workloads and the statistics of their latencies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import kv, order

# Shares of operations in the standard workloads, value sizes, and how ten values in a row are mixed.
WORKLOADS = {
    "a": {"read": 0.5, "update": 0.5},
    "b": {"read": 0.95, "update": 0.05},
    "c": {"read": 1.0},
    "d": {"read": 0.95, "insert": 0.05},
    "e": {"scan": 0.95, "insert": 0.05},
    "f": {"read": 0.5, "rmw": 0.5},
}
VALUE_BYTES = {"s": 5, "m": 100, "l": 2000}
MIXES = {"s": "s" * 10, "m": "m" * 10, "l": "l" * 10, "sd": "ssssssmmll", "md": "ssmmmmmmll", "ld": "ssmmllllll"}
THETA = 0.99
BUCKETS = 100_000
POINTS = (0.5, 0.7, 0.9, 0.99, 0.999, 0.9999)


def value_size(i: Column, mix: str) -> Column:
    """Bytes of the i-th value under a mix, which repeats every ten values."""
    sizes = F.array(*(F.lit(VALUE_BYTES[c]) for c in MIXES[mix]))
    return F.get(sizes, (i % 10).cast("int")).cast("long")


def uniform(i: Column, salt: str = "") -> Column:
    """A number below 1 from a hash of i (and a salt) that any engine can make."""
    text = F.concat(i.cast("string"), F.lit(salt)) if salt else i.cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long") / float(1 << 24)


def choose(i: Column, shares: dict[str, float]) -> Column:
    """The operation of the i-th request: cumulative shares over a uniform number of i."""
    draw = uniform(i)
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
    return out.otherwise(name)


def load_phase(spark: SparkSession, n: int, mix: str = "sd") -> DataFrame:
    """n inserts: key (hash of a counter), lsn, op, value size."""
    rows = spark.range(n)
    return rows.select(kv.fnv1a("id").cast("string").alias("key"), F.col("id").alias("lsn"), F.lit("put").alias("op"), value_size(F.col("id"), mix).alias("value_size"))


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    return spark.range(1, n + 1).agg(F.sum(1 / F.pow("id", F.lit(theta)))).first()[0]


def zipf(u: Column, n: int, zeta_n: float, theta: float = THETA) -> Column:
    """A rank below n from a uniform number, by the closed form of the zipfian inverse."""
    alpha, two = 1 / (1 - theta), 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - two / zeta_n)
    rest = F.floor(n * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(alpha))).cast("long")
    return F.when(u * zeta_n < 1, F.lit(0)).when(u * zeta_n < two, F.lit(1)).otherwise(F.least(rest, F.lit(n - 1))).cast("long")


def scrambled(rank: Column, n: int) -> Column:
    return (kv.fnv1a(rank) % n).cast("long")


def latest_skew(top: Column, rank: Column) -> Column:
    return F.greatest(F.lit(0), top - rank).cast("long")


def scan_length(u: Column, most: int = 1000, zeta_n: float | None = None) -> Column:
    """Rows a scan asks for, from 1 to `most`: uniform, or zipfian if zeta of `most` is given."""
    return ((F.floor(u * most) if zeta_n is None else zipf(u, most, zeta_n)) + 1).cast("long")


def transactions(spark: SparkSession, n: int, records: int, workload: str, most_scan: int = 1000) -> DataFrame:
    """n requests of a workload: i, op, record (zipfian, scrambled; the newest in workload d) and scan length.

    All draws are hashes of i, so that requests do not depend on how rows are dealt.
    """
    i = F.col("id")
    rank = zipf(uniform(i, ":rank"), records, zeta(spark, records))
    rows = spark.range(n).select(i.alias("i"), choose(i, WORKLOADS[workload]).alias("op"), rank.alias("rank"), uniform(i, ":scan").alias("u"))
    record = latest_skew(F.lit(records - 1), F.col("rank")) if workload == "d" else scrambled(F.col("rank"), records)
    return rows.select("i", "op", record.alias("record"), F.when(F.col("op") == "scan", scan_length(F.col("u"), most_scan)).alias("scan_length"))


def run(requests: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies (i, op, key, found) to requests on the loaded records (key, lsn, op, value_size), and the log after them.

    A request's key is its record's; a read, scan or read-modify-write finds what was loaded. Updates, inserts and read-modify-writes of found
    records append operations with lsns after the load, in the order of requests.
    """
    keyed = requests.withColumn("key", kv.fnv1a("record").cast("string"))
    held = loaded.filter("op = 'put'").select("key").distinct().withColumn("found", F.lit(True))
    replies = keyed.join(held, "key", "left").select("i", "op", "key", F.coalesce("found", F.lit(False)).alias("found"))
    writes = replies.filter("op in ('update', 'insert') or (op = 'rmw' and found)")
    top = loaded.agg(F.max("lsn").alias("_top"))  # one row
    new = writes.join(F.broadcast(top), F.lit(True)).select("key", (F.coalesce("_top", F.lit(-1)) + 1 + F.col("i")).alias("lsn"), F.lit("put").alias("op"), value_size(F.col("i"), "sd").alias("value_size"))
    return replies, loaded.select("key", "lsn", "op", "value_size").unionByName(new)


def plan_file(lines: DataFrame) -> DataFrame:
    """name, phase and workload of an execution plan's lines `name load|run workload`; # starts a comment."""
    parts = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    rows = lines.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("phase"), F.get(parts, F.lit(2)).alias("workload"))
    return rows.filter("name <> '' and phase in ('load', 'run')")


def histogram(latencies: DataFrame) -> DataFrame:
    """op, usec, n for latencies below the last bucket."""
    return latencies.filter((F.col("usec") >= 0) & (F.col("usec") < BUCKETS)).groupBy("op", "usec").agg(F.count(F.lit(1)).alias("n"))


def percentiles(histogram: DataFrame, by: list[str], points: tuple[float, ...] = POINTS) -> DataFrame:
    """For each group the least latency at which the running count reaches floor(n * p), from a histogram (at most 100 000 buckets)."""
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("usec").rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    names = ["p" + re.sub(r"\.?0*$", "", f"{p * 100:.2f}").replace(".", "_") for p in points]
    picks = [F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") * p), F.col("usec"))).alias(n) for p, n in zip(points, names, strict=True)]
    total = F.sum(F.col("usec") * F.col("n"))
    return rows.groupBy(*by).agg(
        F.sum("n").cast("long").alias("samples"), F.min("usec").alias("min_usec"), F.max("usec").alias("max_usec"),
        F.floor(total / F.sum("n")).cast("long").alias("avg_usec"), *picks,
    )


def mean_of_threads(latencies: DataFrame) -> DataFrame:
    """Each thread's own average, then the integer mean of the threads' averages."""
    own = latencies.groupBy("op", "thread").agg(F.floor(F.sum("usec") / F.count(F.lit(1))).cast("long").alias("avg"), F.max("usec").alias("top"))
    return own.groupBy("op").agg(
        F.count(F.lit(1)).alias("threads"), F.floor(F.sum("avg") / F.count(F.lit(1))).cast("long").alias("mean_avg"),
        F.floor(F.sum("top") / F.count(F.lit(1))).cast("long").alias("mean_max"),
    )


def missing(latencies: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """op and how many of its latencies lie beyond the last bucket."""
    return latencies.groupBy("op").agg(F.count(F.when(F.col("usec") >= buckets, 1)).alias("missing"))


def mean_of_percentiles(latencies: DataFrame, points: tuple[float, ...] = POINTS) -> DataFrame:
    """Every statistic of each thread by itself, then the integer mean over the threads."""
    held = latencies.filter((F.col("usec") >= 0) & (F.col("usec") < BUCKETS)).groupBy("op", "thread", "usec").agg(F.count(F.lit(1)).alias("n"))
    own = percentiles(held, ["op", "thread"], points)
    names = [c for c in own.columns if c not in ("op", "thread", "samples")]
    means = [F.floor(F.sum(c) / F.count(F.lit(1))).cast("long").alias(c) for c in names]
    return own.groupBy("op").agg(F.sum("samples").cast("long").alias("samples"), *means)


def io_volume(samples: DataFrame, sector: int = 512) -> DataFrame:
    """Whole megabytes read and written between two readings (phase before or after) of every device's sector counters."""

    def grown(column: str) -> Column:
        change = F.sum(F.when(F.col("phase") == "after", F.col(column)).otherwise(-F.col(column)))
        return F.expr(f"cast(total_{column} * {sector} div 1048576 as long)"), change.alias(f"total_{column}")

    (read, read_sum), (written, written_sum) = grown("sectors_read"), grown("sectors_written")
    return samples.agg(read_sum, written_sum).select(read.alias("read_mb"), written.alias("written_mb"))


#: Fixed value: cycles a second of the machine that statistics are stated for.
CYCLES = 76_800_000_000


def cycles(samples: DataFrame, ops_per_second: float, cycles_per_second: int = CYCLES) -> DataFrame:
    """CPU percent, and cycles an operation with and without waiting for I/O, from samples of percentages (idle, iowait)."""
    busy = 100 - F.avg("idle")
    cost = lambda percent: percent / 100 * cycles_per_second / ops_per_second
    return samples.agg(F.round(busy, 6).alias("cpu_percent"), F.round(cost(busy), 4).alias("cycles_per_op"), F.round(cost(busy - F.avg("iowait")), 4).alias("cycles_without_iowait"))


def throughput(events: DataFrame, every: str = "1 day") -> DataFrame:
    """Operations of each tumbling interval and the change against the interval before; one row for each interval is ordered."""
    per = events.groupBy(F.window("ts", every)["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("start")))


def running_offsets(log: DataFrame) -> DataFrame:
    """Offset of each log entry without regard to segments: a running sum over lsn."""
    return order.running_sum(log, ["lsn"], "size", "upto").withColumn("offset", F.col("upto") - F.col("size")).drop("upto")
