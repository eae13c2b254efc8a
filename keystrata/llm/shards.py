"""Contiguous shards of least largest size: minimax partition over ordered atomic groups, found by binary search.

Equal texts form one group that no cut divides; null texts form a group too. Groups stand in the order of their first doc_id.
The search keeps on the driver the running sizes at block edges and, on demand, those inside a few blocks; blocks are at most
four times the square root of the rows in number, and the size of each beyond `rows_per_block` is of that order too. Everything else is DataFrame work over rows of a few numbers.

Nulls: a null text has size 1 and checksum 0; a null doc_id stands first. Repeated rows stay together as equal texts do; of rows or groups
with one doc_id the text's checksum decides the order, and an id that very many share is split into blocks by it. An empty table gives no rows. Fewer groups than shards leave shards empty. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import base

HELD_BLOCKS = 16


class Ends:
    """The largest running size at or below a target, for ordered groups dealt into blocks."""

    def __init__(self, prefix: DataFrame):
        self.prefix = prefix
        rows = prefix.groupBy("block").agg(F.max("end").alias("end")).orderBy("block").collect()
        self.blocks, self.edges = [r["block"] for r in rows], [r["end"] for r in rows]
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    def inside(self, block: int) -> np.ndarray:
        if block not in self.held:
            found = self.prefix.filter(F.col("block") == F.lit(block)).select("end").collect()
            self.held[block] = np.sort(np.fromiter((r["end"] for r in found), np.int64, len(found)))
            if len(self.held) > HELD_BLOCKS:
                self.held.popitem(last=False)
        self.held.move_to_end(block)
        return self.held[block]

    def upto(self, target: int) -> int:
        i = bisect_right(self.edges, target)
        if i == len(self.edges):
            return self.edges[-1]
        ends = self.inside(self.blocks[i])
        k = int(np.searchsorted(ends, target, "right"))
        return int(ends[k - 1]) if k else (self.edges[i - 1] if i else 0)


def cuts(ends: Ends, capacity: int, total: int, shards: int) -> list[int]:
    """Where greedy filling ends each shard; the last entry is below the total if the capacity is too small."""
    out, at = [], 0
    for _ in range(shards):
        at = ends.upto(at + capacity) if at < total else total
        out.append(at)
    return out


def least_cuts(ends: Ends, total: int, largest: int, shards: int) -> list[int]:
    low = max(-(-total // shards), largest)
    high = low + largest  # always enough: every shard but the last then holds at least an equal part
    while low < high:
        middle = (low + high) // 2
        if cuts(ends, middle, total, shards)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return cuts(ends, low, total, shards)


def shard_documents(documents: DataFrame, shards: int = 8, rows_per_block: int = 4000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents (doc_id long, text string)."""
    text = F.col("text")
    rows = base.cut(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"),
        )
    )
    deal = base.Deal(rows, "doc_id", rows_per_block)
    sub = F.expr("coalesce(cast(conv(hex(substring(key, 1, 2)), 16, 10) as int) div 64, 0)")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("block", deal.block(F.col("first"), sub))
    order = [F.col("first").asc_nulls_first(), "key"]
    prefix = base.running(groups, [], "block", order, ["bytes"]).withColumn("end", F.col("before_bytes") + F.col("bytes"))
    prefix = base.cut(prefix.select("key", "n", "bytes", "block", "end"))
    whole = prefix.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()
    edges = least_cuts(Ends(prefix), whole["total"], whole["largest"], shards)[:-1] if whole["total"] else []
    placed = prefix.select("key", "n", base.block_of(F.col("end") - F.col("bytes"), edges).alias("shard"))
    put = base.attach(rows, "key", placed, "n").withColumn("block", deal.block(F.col("doc_id"), sub))
    out = base.running(put, ["shard"], "block", [F.col("doc_id").asc_nulls_first(), "key"], [])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
