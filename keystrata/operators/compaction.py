"""What compaction does next: triggers, merge or move, estimates of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import kv

#: Bytes of the smallest pair, by which keys of a full level 0 are estimated.
SMALLEST_PAIR = 33


def capacity(level: int, level0: int, growth: int) -> int | None:
    return level0 * growth**level if level < kv.LEVELS - 1 else None


def next_step(sizes: dict[int, int], level0: int, growth: int, inplace: int = kv.MEDIUM_INPLACE_LEVEL) -> tuple[str, int, int] | None:
    """(merge or move, level, next level) for the first level that overflows into one that does not; null when none does."""
    full = lambda i: capacity(i, level0, growth) is not None and sizes.get(i, 0) >= capacity(i, level0, growth)
    for i in range(kv.LEVELS - 1):
        if sizes.get(i, 0) and full(i) and not full(i + 1):
            moved = i > 0 and i + 1 != inplace and not sizes.get(i + 1, 0)
            return "move" if moved else "merge", i, i + 1
    return None


def dispatch(levels: DataFrame, level0: int, growth: int, inplace: int = kv.MEDIUM_INPLACE_LEVEL) -> DataFrame:
    """level and action (merge, move or null) of each level of a table (level, bytes) with one row for every level."""
    line = Window.orderBy("level")  # one row for each level
    below = levels.withColumns({"below": F.lead("bytes").over(line), "room": F.lead(kv.level_capacity(F.col("level"), level0, growth)).over(line)})
    starts = (F.col("bytes") >= kv.level_capacity(F.col("level"), level0, growth)) & (F.col("room").isNull() | (F.col("below") < F.col("room")))
    move = (F.col("level") > 0) & (F.col("level") + 1 != inplace) & (F.col("below") == 0)
    return below.select("level", F.when(starts & move, "move").when(starts, "merge").alias("action"))


def move(runs: DataFrame, source: int) -> DataFrame:
    """Rows of a level are rows of the next one, as they are."""
    return runs.withColumn("level", F.when(F.col("level") == source, F.col("level") + 1).otherwise(F.col("level")))


def estimate(keys: dict[int, int], target: int, level0: int) -> int:
    """Keys that a merge into a level may write: those of both levels, or a full level 0 of smallest pairs."""
    found = keys.get(target, 0)
    if target == 1 and not found:
        found = level0 // SMALLEST_PAIR
    return found + (keys.get(target - 1, 0) if target > 1 else 0)


def estimated_keys(levels: DataFrame, level0: int) -> DataFrame:
    """level and the estimate for a merge into it, of a table (level, n_keys) with one row for every level."""
    line = Window.orderBy("level")  # one row for each level
    own = F.when((F.col("level") == 1) & (F.col("n_keys") == 0), F.lit(level0 // SMALLEST_PAIR)).otherwise(F.col("n_keys"))
    above = F.when(F.col("level") > 1, F.lag("n_keys").over(line)).otherwise(0)
    return levels.select("level", (own + above).cast("long").alias("keys")).filter("level > 0")


def trimmed(segments: DataFrame, last: Column) -> DataFrame:
    """Segments of the medium log that can go once the values up to segment `last` (the greatest one touched) are back in place."""
    return segments.filter(F.col("segment") < last)
