"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the size of the whole corpus; a source stops at
`most` times its own size and what it leaves is shared again by weight. The shared size is cut into equal blocks of words, as
many for each output shard. Blocks go to sources by highest quotients target / (2j + 1); as seats are only ever added, what a source has
after k + 1 shards' blocks less what it has after k is its whole quota in shard k, and a source's blocks together miss its target by
less than a block or so. A source's documents are laid out in an order seeded by doc_id and cut into blocks of that size, which its quotas
take in turn, shard by shard: whole passes over all its blocks first, then the first ones once more; the last may end inside a document.

Nulls: a null source is a source, a null text has size 0 and is taken 0 times, a null doc_id is ordered like any other.
Repeated rows count separately. Empty tables, and corpora without a word, give targets of 0. Other columns are kept on request. Sources may
be many: only their quotients at the edge of a shard's allocation, at most three times their number, meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import order
from keystrata.llm import base

WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Adds place, weight, cap, total and target to a table with one row for each source (source, source_size)."""
    placed = order.positions(sources.withColumn("_lost", F.col("source").isNull()), "_lost", "source").withColumnRenamed("pos", "place").drop("_lost")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = base.cut(placed.withColumns({"weight": weight, "cap": F.col("source_size") * most}))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # sources that are full at a level are paid, and the others share the rest by weight
        over = F.col("cap") < F.lit(level) * F.col("weight")
        n, paid, left = table.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == full or not left:
            break
        level, full = (total - paid) / left, n
    return table.withColumns({"total": F.lit(total).cast("long"), "target": F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))})


def quotas(table: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Adds block (words), upto (blocks of the source after each shard), and words (of all shards, at most cap) to the table of targets."""
    table = base.cut(table)
    total, sources = table.agg(F.max("total"), F.count(F.lit(1))).first()
    total = total or 0
    block = max(1, total // (shards * blocks))
    seats = total // (shards * block)
    step = table.select("place", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("k"))
    house = F.col("k") * seats
    # With the first divisor too few seats are given, with the second too many; the quotients between are ranked.
    few = F.when(house > sources, total / (2.0 * (house - sources))).otherwise(F.lit(total + 1.0))
    many = F.lit(float(total)) / (2.0 * (house + sources))
    step = step.withColumns({"sure": F.floor((F.col("target") / few + 1) / 2), "most": F.floor((F.col("target") / many + 1) / 2)})
    step = base.cut(step.withColumns({"sure": F.coalesce("sure", F.lit(0)).cast("long"), "most": F.coalesce("most", F.lit(0)).cast("long")}))
    spare = step.groupBy("k").agg((F.first("k") * seats - F.sum("sure")).alias("spare"))
    rivals = step.filter("most > sure").withColumn("j", F.explode(F.sequence("sure", F.col("most") - 1)))
    best = Window.partitionBy("k").orderBy((F.col("target") / (2 * F.col("j") + 1)).desc(), "place")
    rivals = rivals.withColumn("turn", F.row_number().over(best)).join(F.broadcast(spare), "k")  # one row for each shard
    won = rivals.filter("turn <= spare").groupBy("place", "k").agg(F.count(F.lit(1)).alias("won"))
    held = step.join(won, ["place", "k"], "left").withColumn("held", F.col("sure") + F.coalesce("won", F.lit(0)))
    upto = held.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("k", "held"))).alias("s")).select("place", F.col("s.held").alias("upto"))
    words = F.least(F.col("cap"), F.element_at("upto", -1) * block)
    return table.join(upto, "place").withColumns({"block": F.lit(block).cast("long"), "words": words})


def mix(documents: DataFrame, keep: list[str] | None = None, shards: int = 8, blocks: int = 65_536, seed: int = 17, rows_per_block: int = 1000) -> DataFrame:
    """doc_id, size, source_size, target, taken, block, shard for every row of documents, and the columns named in `keep`.

    block is the number, in its source's seeded order, of the block in which a document's first word lies, and shard the output shard whose
    quota takes that block first; both are null where nothing of the document is taken.
    """
    number, source = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")
    narrow = base.cut(documents.select(number, source, base.word_count(F.col("text")).alias("size")))
    name = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = base.cut(quotas(targets(base.cut(per)), shards, blocks).withColumn("name", name))
    n_rows = plan.agg(F.sum("n")).first()[0] or 0
    deal = max(1, min(-(-n_rows // rows_per_block), 4 * math.isqrt(n_rows)))
    draw = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"name": name, "draw": draw, "part": F.pmod(draw, F.lit(deal))}).drop("source")

    # Wide rows get their source's plan before their words are counted and before they move; block totals come from the narrow ones.
    kept, order = {}, ["draw", F.col("doc_id").asc_nulls_first(), "size"]
    rows = narrow
    if keep:
        kept = {"body" if c == "text" else f"kept_{i}": c for i, c in enumerate(keep)}
        rows = documents.select(number, source, *(F.col(f"`{c}`").alias(k) for k, c in ({"body": "text"} | kept).items()))
        order.append(F.xxhash64("body"))
    out = base.attach(dealt(rows), "name", plan.select("name", "source_size", "target", "words", "block", "upto", "n"), "n")
    if keep:
        out = out.withColumn("size", base.word_count(F.col("body")))
    out = base.running(out, ["name"], "part", order, ["size"], counted=dealt(narrow))
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    part = F.when(F.col("source_size") > 0, F.col("words") % F.col("source_size")).otherwise(0)
    taken = F.col("size") * whole + F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("before_size")))
    out = out.withColumns({"taken": taken.cast("long"), "block": F.expr("before_size div block")})
    shard = F.least(F.lit(shards - 1), F.size(F.filter("upto", lambda n: n <= F.col("block"))))
    for c, made in (("shard", shard.cast("int")), ("block", F.col("block"))):
        out = out.withColumn(c, F.when(F.col("taken") > 0, made))
    return out.select("doc_id", "size", "source_size", "target", "taken", "block", "shard", *(F.col(k).alias(c) for k, c in kept.items()))


def apply_mix(documents: DataFrame) -> DataFrame:
    """The mix itself: each document repeated as its taken words say, the last copy cut after a word; same columns."""
    columns = documents.columns
    mixed = mix(documents.drop(*[c for c in ("text",) if c not in columns]), keep=columns).toDF("_id", "_size", "_all", "_target", "_taken", "_block", "_shard", *columns)
    copies = F.expr("_taken div greatest(_size, 1)").cast("int")
    rest = F.when(F.col("_size") > 0, F.col("_taken") % F.col("_size")).otherwise(0).cast("int")
    # A copy number below `copies` is whole; the one that equals it is the cut one.
    numbers = F.sequence(F.lit(0), copies - F.when(rest > 0, 0).otherwise(1))
    listed = mixed.filter("_taken > 0").withColumns({"_rest": rest, "_copies": copies}).withColumn("_copy", F.explode(numbers))
    words = F.slice(F.expr(rf"regexp_extract_all(text, r'[{base.WS}]*+[^{base.WS}]++', 0)"), 1, F.col("_rest"))
    text = F.when(F.col("_copy") < F.col("_copies"), F.col("text")).otherwise(F.array_join(words, ""))
    out = listed.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*columns)
