"""Sorted runs: merging, levels, compaction, garbage, collection, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import kv, order
from keystrata.operators import state


def merge_runs(runs: DataFrame) -> DataFrame:
    """The winning version of each key among runs (level, epoch, key, op, value): least level, then newest epoch."""
    rest = [c for c in runs.columns if c != "key"]
    newest = F.struct((-F.col("level")).alias("l"), F.col("epoch").alias("e"))
    found = runs.groupBy("key").agg(F.max_by(F.struct(*rest), newest).alias("_v"))
    return found.select("key", *(F.col(f"_v.{c}").alias(c) for c in rest))


def compact(source: DataFrame, target: DataFrame, last: bool = False) -> DataFrame:
    """Two runs as one, newest versions only; tombstones stay unless the target is the last level."""
    merged = state.latest(source.unionByName(target))
    return merged.filter("op = 'put'") if last else merged


def level_sizes(runs: DataFrame, size: Column) -> DataFrame:
    return runs.groupBy("level").agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n_keys"))


def overflow(sizes: DataFrame, level0: int, growth: int) -> DataFrame:
    capacity = kv.level_capacity(F.col("level"), level0, growth)
    return sizes.withColumn("capacity", capacity).withColumn("overflows", F.coalesce(F.col("bytes") >= F.col("capacity"), F.lit(False)))


def with_liveness(ops: DataFrame) -> DataFrame:
    """Every version with `live`: it is its key's newest and a put. Map-side maxima joined back, not a window on a hot key."""
    newest = ops.groupBy("key").agg(F.max("lsn").alias("_newest"))
    return ops.join(newest, "key").withColumn("live", (F.col("lsn") == F.col("_newest")) & (F.col("op") == "put")).drop("_newest")


def with_newest(ops: DataFrame) -> DataFrame:
    """Every version with `newest`, tombstones included."""
    top = ops.groupBy("key").agg(F.max("lsn").alias("_newest"))
    return ops.join(top, "key").withColumn("newest", F.col("lsn") == F.col("_newest")).drop("_newest")


def big_garbage(versions: DataFrame) -> DataFrame:
    """Bytes of superseded values of class BIG in each segment of their log, from (segment, class, newest, size): what collection goes by."""
    return versions.filter("class = 'BIG' and not newest").groupBy("segment").agg(F.sum("size").cast("long").alias("garbage_bytes"))


def recovered_garbage(events: DataFrame) -> DataFrame:
    """Garbage counters of each segment, rebuilt from an allocation log (segment, op, garbage_bytes)."""
    return events.filter("op = 'garbage'").groupBy("segment").agg(F.sum("garbage_bytes").cast("long").alias("garbage_bytes"))


def relocate(versions: DataFrame, victims: DataFrame) -> DataFrame:
    """key, old_lsn and lsn of the live versions in victim segments, written anew at the log's tail in their old order."""
    top = versions.agg(F.max("lsn").alias("_top"))  # one row
    live = versions.filter("live").join(victims.select("segment"), "segment", "left_semi").select("key", F.col("lsn").alias("old_lsn"))
    placed = order.positions(live, "old_lsn").join(F.broadcast(top), F.lit(True))
    return placed.select("key", "old_lsn", (F.col("_top") + 1 + F.col("pos")).alias("lsn"))


def with_events(packed: DataFrame, segment: int = kv.SEGMENT) -> DataFrame:
    """Packed entries (log, lsn, size, offset) with `flushed`, the segment that an entry's arrival completes, and `padding` in it."""
    here = Window.partitionBy("log", F.expr(f"offset div {segment}")).orderBy("lsn")
    last = packed.withColumns({"_segment": F.expr(f"offset div {segment}"), "_first": F.row_number().over(here) == 1})
    ends = last.groupBy("log", "_segment").agg((F.max(F.col("offset") + F.col("size"))).alias("_end"))
    ends = ends.select("log", (F.col("_segment") + 1).alias("_segment"), (F.col("_segment") * segment).alias("_was"), ((F.col("_segment") + 1) * segment - F.col("_end")).alias("_room"))
    out = last.join(ends, ["log", "_segment"], "left")
    return out.select(*packed.columns, *(F.when(F.col("_first"), F.col(c)).cast("long").alias(n) for c, n in (("_was", "flushed"), ("_room", "padding"))))


def garbage(versions: DataFrame) -> DataFrame:
    """Bytes of dead versions of each segment, whatever their class, from (segment, live, size): a space account."""
    dead = F.when(~F.col("live"), F.col("size")).otherwise(0)
    return versions.groupBy("segment").agg(
        F.sum(dead).cast("long").alias("garbage_bytes"), F.sum("size").cast("long").alias("total_bytes"), F.sum(F.col("live").cast("long")).alias("live_rows")
    )


def victims(segments: DataFrame) -> DataFrame:
    """Segments to collect: those with garbage that are not the log's tail."""
    tail = segments.agg(F.max("segment").alias("_tail"))
    return segments.join(F.broadcast(tail), F.col("segment") < F.col("_tail")).filter("garbage_bytes > 0").drop("_tail")


def replay(*logs: DataFrame) -> DataFrame:
    """Visible rows after replaying several logs by sequence number."""
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log)
    return state.visible(whole)


def replay_allocations(events: DataFrame) -> DataFrame:
    """Segments that are allocated after all events (seq, segment, op in {alloc, free})."""
    return events.groupBy("segment").agg(F.max_by("op", "seq").alias("op")).filter("op = 'alloc'").select("segment")


def pack(log: DataFrame, segment: int = kv.SEGMENT) -> DataFrame:
    """Offset of each entry (log, lsn, size) where an entry that does not fit in its segment starts the next one.

    Within a log this is sequential by nature, so a log is the unit of work: its entries stream through in order, and only the
    running offset is kept.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, at = None, 0
        for batch in batches:
            offsets = []
            for log, size in zip(batch["log"].tolist(), batch["size"].tolist(), strict=True):
                if log != name:
                    name, at = log, 0
                room = segment - at % segment
                if size > room:
                    at += room
                offsets.append(at)
                at += size
            yield batch.assign(offset=offsets)

    ordered = log.select("log", "lsn", "size").repartition("log").sortWithinPartitions("log", "lsn")
    return ordered.mapInPandas(fold, "log string, lsn long, size long, offset long")
