"""SpotSigs: signatures of content words that follow common words, compared by Jaccard with pruning on set length.

A spot is a common word (an anchor) directly followed by a content word; its signature is the anchor and the next `chain`
content words, common words between them skipped. Words are runs of letters, digits and marks in lower case. A text without a
whole spot has one signature, its words as they stand. A fingerprint is the sorted distinct 64-bit hashes of the signatures in
hexadecimal, joined by spaces, so equal texts have equal fingerprints.

Nulls count as empty texts. Very long texts are scanned once, by possessive patterns that neither recurse nor look back. Ties
in doc_id are ordered by a hash of the text, then by the text. An only document is followed by itself. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm import base

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the they this to was were will with"
    " aber als am auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im ist"
    " mit nach nicht noch oder sich sie sind so und vom von vor war wie wir zu zum zur"
    " au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur mais ne nous ou par pas pour qu que qui sa se"
    " ses son sont sur un une vous"
    " al como con del el ella ellos en es esta este fue ha la las lo los más me mi muy no para pero por que se si sin su sus te un"
    " una y ya yo"
).split()
#: Whatever is not one blank between words.
RUNS = r"[^a-zß-öø-ÿ \p{L}\p{N}\p{M}][^\p{L}\p{N}\p{M}]*+| [^\p{L}\p{N}\p{M}]++"


def any_of(words: set[str]) -> str:
    """A pattern for any of the words, shared beginnings tried once."""
    heads: dict[str, set[str]] = {}
    for word in words:
        if word:
            heads.setdefault(word[0], set()).add(word[1:])
    if not heads:
        return ""
    found = "|".join(head + any_of(heads[head]) for head in sorted(heads))
    return f"(?:{found})?" if "" in words else f"(?:{found})"


def pattern(chain: int, anchors: list[str] | tuple[str, ...] = tuple(ANCHORS)) -> str:
    """In words between single blanks: one spot as the first group, from its anchor to its last content word."""
    common = any_of(set(anchors))
    content = f"(?!{common} )[^ ]++"
    return f" (?=({common} {content}" + f"(?: {common}(?= ))*+ {content}" * (chain - 1) + ") )"


def with_signatures(rows: DataFrame, text: str, name: str, chain: int = 2) -> DataFrame:
    """Adds the sorted distinct 64-bit hashes of a text column's signatures.

    One column for each step, so that the step that reads the whole text runs once.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), RUNS, " "), F.lit(" "))
    skipped = f"(?<= )(?:{any_of(set(ANCHORS))} )++"  # possessive: a plain + would recurse
    spots = F.transform(F.regexp_extract_all(words, F.lit(pattern(chain)), F.lit(1)), lambda s: F.xxhash64(F.regexp_replace(s, skipped, "")))
    rows = rows.withColumn(name, F.sort_array(F.array_distinct(spots)))
    whole = F.array(F.xxhash64(F.lit("whole"), F.trim(words)))
    return rows.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(whole))


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without a comparison where their lengths alone keep it below `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < large * least, F.lit(0.0)).otherwise(both / (small + large - both)).cast("double")


def set_part(signature_set: Column, least: float = 0.8) -> Column:
    """The partition of a set by its length: sets whose Jaccard is at least `least` lie in one or in two neighbouring ones."""
    return F.floor(F.log(F.size(signature_set).cast("double")) / -F.log(F.lit(least))).cast("int")


def is_copy(a: Column, b: Column, near: Column, least: float = 0.8) -> Column:
    """Whether two sets have a Jaccard of `least`; partitions that are no neighbours settle it without looking at `near`."""
    return F.when(F.abs(set_part(a, least) - set_part(b, least)) > 1, F.lit(False)).otherwise(near >= least)


def with_next(rows: DataFrame, derive: Callable[[DataFrame], DataFrame], rows_per_block: int = 500) -> DataFrame:
    """Rows (doc_id, text) with the columns that `derive` adds, and next_<c> for text and each of those: what the next row by
    (doc_id, hash of the text, text) has, after the last row what the first has.

    Rows move once: they are dealt into ranges of doc_id, an id that very many share into ranges of the hash, and the last row of a
    range gets the first row of the next range from a table with one row for each range.
    """
    deal = base.Deal(rows, "doc_id", rows_per_block)
    tie = F.expr("shiftrightunsigned(xxhash64(text), 1)")
    rows = rows.withColumn("block", deal.block(F.col("doc_id"), F.shiftright(tie, 53).cast("int")))
    heads = rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", tie, "text"))["text"].alias("text"))
    heads = derive(heads)
    carry = [c for c in heads.columns if c != "block"]
    heads = base.cut(heads.select("block", F.struct(*carry).alias("row")))
    line = Window.orderBy("block")  # one row for each range
    start = F.first("row").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = base.cut(heads.select("block", F.coalesce(F.lead("row").over(line), start).alias("edge")))
    here = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), tie, "text")
    led = derive(rows)
    led = led.withColumns({"after": F.lead("block").over(here)} | {f"next_{c}": F.lead(c).over(here) for c in carry}).join(edges, "block", "left")
    last = F.col("after").isNull()
    return led.withColumns({f"next_{c}": F.when(last, F.col("edge")[c]).otherwise(F.col(f"next_{c}")) for c in carry}).drop("block", "after", "edge")


def fingerprints(documents: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of documents.

    After these set_part, the fingerprint's partition by length, and whether the edited text and the next document are near copies by 0.8
    (copy_edited, copy_next), pruned by those partitions.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, lambda r: with_signatures(r, "text", "own", chain))
    half = F.expr("length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("next"))
    rows = with_signatures(rows, "edited", "other", chain)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"), "own", "other", "next",
    ).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", set_part(F.col("own")).alias("set_part"),
        is_copy(F.col("own"), F.col("other"), F.col("near_edited")).alias("copy_edited"), is_copy(F.col("own"), F.col("next"), F.col("near_next")).alias("copy_next"),
    )


def near_duplicates(documents: DataFrame, least: float = 0.8, chain: int = 2) -> DataFrame:
    """Pairs (a, b, likeness) of different signature sets whose Jaccard is at least `least`, a and b their smallest doc_ids.

    Sets are dealt into partitions of set length, in which a set of n signatures meets only sets of n*least to n/least; within
    a partition they meet over the signatures of their prefix, rarest first, so that no pair below the bound needs a full
    comparison for a common signature. Sets of one text or of equal signatures are one row here.
    """
    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = with_signatures(rows, "text", "set", chain).select("doc_id", "set")
    sets = base.cut(rows.groupBy("set").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("set")))
    spread = sets.select("id", F.explode("set").alias("sig"))
    rare = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ordered = spread.join(rare, "sig").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("rank"))
    prefix = ordered.select("id", F.explode(F.slice("rank", F.lit(1), F.size("rank") - F.ceil(F.size("rank") * least).cast("int") + 1)).alias("r"))
    heads = base.cut(prefix.select("id", F.col("r.sig").alias("sig")).join(sets.select("id", "n"), "id"))
    heads = heads.join(sets.select("id", set_part(F.col("set"), least).alias("band")), "id")
    near = heads.select(F.col("id").alias("b"), "sig", F.col("n").alias("m"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = heads.withColumnRenamed("id", "a").join(near, ["sig", "band"])
    fits = (F.least("n", "m") >= F.greatest("n", "m") * least) & (F.col("a") != F.col("b"))
    pairs = pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return pairs.select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).filter(F.col("likeness") >= least)
