"""Quality rules with risk-controlled thresholds.

Every text gets counts (words, symbols, repeated lines, repeated 8-word windows) and five ratios made of them. A fixed base
rule comes first. After it a text goes if one of its ratios is above that ratio's cutoff. A stratum is a language, and its vector of cutoffs is found
on its own labelled rows alone, all of them: so that of its good texts at most the share `risk` is rejected by all rules together, as exact
binomial bounds on them show. Two families of vectors are tested, with error levels that add up to `error` over all strata (Bonferroni):

- with a `JOINT` part of the level, all ratios' cutoffs at the same place of a fixed grid, from the loosest to the first that fails. As
  the order is fixed beforehand, these tests need no correction among themselves (the level enters the rows needed by its logarithm alone);
- with the rest, divided by the number of all vectors of the grid, any vector: then it may be chosen by looking at the data. From the strictest
  joint vector that passed, the cutoff whose lowering rejects most labelled bad texts is lowered while the result still passes.

So with probability 1 - `error` no stratum loses more than `risk` of its good texts. In a stratum with too few good rows for any test the
rules reject nothing: the base rule alone decides. No stratum bears on another but by the number of strata in the correction.

Nulls: a null text has no words and fails the base rule; a null lang is a stratum; null or conflicting labels of one document
mean that its quality is not known: such rows are left out. Empty tables, missing labels: no cutoffs, the base rule alone decides.
Repeated rows are judged alike; very long texts are read whole, in memory proportional to one text; other columns are kept on request.
"""

from __future__ import annotations

import logging
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import base
from keystrata.llm.token_counts import windows

LOG = logging.getLogger(__name__)
WINDOW = 8
# The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols", "dup_lines", "repeats", "shouts", "marks")
#: Cutoffs tried for each ratio, from the strictest; fixed beforehand, so that the tests hold.
GRID = tuple(round(0.02 * 1.4**k, 4) for k in range(12))
#: The part of the error level that the joint cutoffs get.
JOINT = 0.05
MARKS = b"!?*#$%&|<>=+~^_{}[]\\@"

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    codes = codes ^ (codes >> np.uint64(29))
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
            key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def ratios(text: str | None, found: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    """One value in [0, 1] for each of RATIOS, larger is worse."""
    n, chars, symbols, dups, again = found
    if not n:
        return (0.0,) * len(RATIOS)
    data = text.encode("utf-8", "surrogatepass")
    letters = len(data) - len(data.translate(None, _LETTERS))
    upper = len(data) - len(data.translate(None, _UPPER))
    marks = len(data) - len(data.translate(None, MARKS))
    lines = data.count(b"\n") + 1
    return symbols / chars, dups / lines, again / n, upper / max(1, letters), marks / chars


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), summed downwards from k as far as terms count."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term, total = 1.0, 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-18 * total and i < n * p:
            break
    return min(1.0, math.exp(log + math.log(total)))


def most_rejected(n: int, risk: float, level: float) -> int:
    """The most rejections among n good rows that show a share below risk at an error level; -1 if not even none does."""
    low, high = -1, int(n * risk)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if binomial_tail(middle, n, risk) <= level else (low, middle - 1)
    return low


def needed(strata: int, risk: float = 0.02, error: float = 0.05) -> int:
    """Good rows of a stratum that pass a joint test without one rejection; with fewer, no test can pass."""
    return math.ceil(math.log(error * JOINT / max(1, strata)) / math.log1p(-risk))


def vector(good: Counter, bad: Counter, strata: int, risk: float = 0.02, error: float = 0.05) -> tuple[int, ...]:
    """Each ratio's place in the grid (its length: no cutoff) for one stratum's rows, counted by (cutoffs below each ratio)."""
    top = len(GRID)
    kinds = [np.array(list(c) or np.zeros((0, len(RATIOS))), np.int64).reshape(-1, len(RATIOS)) for c in (good, bad)]
    times = [np.array(list(c.values()), np.int64) for c in (good, bad)]
    n = int(times[0].sum())

    def rejected(which: int, places: list[int]) -> int:
        return int(times[which][(kinds[which] > np.array(places)).any(axis=1)].sum())

    joint = most_rejected(n, risk, error * JOINT / max(1, strata))
    now = [top] * len(RATIOS)
    for k in reversed(range(top)):
        if rejected(0, [k] * len(RATIOS)) > joint:
            break
        now = [k] * len(RATIOS)
    whole = most_rejected(n, risk, error * (1 - JOINT) / (max(1, strata) * (top + 1) ** len(RATIOS)))
    while True:
        held, steps = rejected(1, now), []
        for i, at in enumerate(now):
            for k in range(at):
                tried = [*now[:i], k, *now[i + 1 :]]
                lost = rejected(0, tried)
                if lost <= whole:
                    steps.append((held - rejected(1, tried), lost, -k, i, tried))
        if not steps or min(steps)[0] >= 0:
            return tuple(now)
        now = min(steps)[-1]


def cutoffs_of(good: dict[str | None, Counter], bad: dict[str | None, Counter], strata: int, risk: float = 0.02, error: float = 0.05) -> dict[tuple[str | None, str], float]:
    """The cutoff of each (stratum, ratio) that has one."""
    out: dict[tuple[str | None, str], float] = {}
    for stratum, held in good.items():
        if held.total() >= needed(strata, risk, error):
            places = vector(held, bad.get(stratum, Counter()), strata, risk, error)
            out |= {(stratum, name): GRID[k] for name, k in zip(RATIOS, places, strict=True) if k < len(GRID)}
    return out


def control(rows: list[tuple[str | None, int, tuple[float, ...]]], risk: float = 0.02, error: float = 0.05) -> dict[tuple[str | None, str], float]:
    """The cutoff of each (stratum, ratio) that has one, from labelled rows (stratum, quality, ratios) that the base rule keeps."""
    kinds: tuple[dict, dict] = defaultdict(Counter), defaultdict(Counter)
    for stratum, quality, values in rows:
        kinds[quality != 1][stratum][tuple(bisect_left(GRID, x) for x in values)] += 1
    return cutoffs_of(*kinds, len(kinds[0]), risk, error)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang and, for each ratio, the number of cutoffs below it, of every text that the base rule keeps."""
    for batch in batches:
        keep, levels = [], []
        for part in windows(batch.column("text"), 8 << 20):
            for text in part.to_pylist():
                found = counts(text)
                keep.append(not base_failed(found[0], found[4]))
                if keep[-1]:
                    levels.append([bisect_left(GRID, x) for x in ratios(text, found)])
        held = batch.select(["doc_id", "lang"]).filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*held.columns, pa.array(levels, pa.list_(pa.int8()))], names=["doc_id", "lang", "levels"])


def learn(documents: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> dict[tuple[str | None, str], float]:
    """Cutoffs by (lang, ratio) from all labelled documents.

    Texts become a few small numbers where they are read; only those meet the labels and are counted. The driver gets the counts of the
    languages with enough good rows: at most one for each quality and vector of the grid, (len(GRID) + 1) ** 5 of them, however many rows.
    """
    spark = documents.sparkSession
    base.importable(spark)
    clear = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = clear.agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).filter("quality = top").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = rows.filter("doc_id is not null").mapInArrow(_features, "doc_id long, lang string, levels array<byte>")
    cells = base.cut(found.join(known, "doc_id").groupBy("lang", "good", "levels").agg(F.count(F.lit(1)).alias("n")))
    per = base.cut(cells.filter("good").groupBy("lang").agg(F.sum("n").alias("rows")))
    strata = per.count()
    enough = per.filter(F.col("rows") >= needed(strata, risk, error))
    kinds: tuple[dict, dict] = defaultdict(Counter), defaultdict(Counter)
    for r in cells.join(enough.select(F.col("lang").alias("_lang")), F.col("lang").eqNullSafe(F.col("_lang"))).collect():
        kinds[not r["good"]][r["lang"]][tuple(r["levels"])] = r["n"]
    out = cutoffs_of(*kinds, strata, risk, error)
    LOG.info("%d strata, %d of them with the %d good rows of a test; cutoffs %s", strata, len(kinds[0]), needed(strata, risk, error), out)
    return out


def judge(documents: DataFrame, cutoffs: dict[tuple[str | None, str], float], keep: bool = False) -> DataFrame:
    """The counts, base_failed and kept of every row: with doc_id alone, or after all columns of documents (`keep`).

    cutoffs are by (lang, ratio); a text of a language without any is judged by the base rule alone.
    """
    spark = documents.sparkSession
    base.importable(spark)
    tests: dict[str | None, list[tuple[int, float]]] = defaultdict(list)
    for (lang, name), cutoff in cutoffs.items():
        tests[lang].append((RATIOS.index(name), cutoff))
    tests = dict(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in COUNTS]
            failed, kept = [], []
            langs = iter(batch.column("_lang").to_pylist())
            for part in windows(batch.column("text" if keep else "_text"), 8 << 20):
                for text in part.to_pylist():
                    found = counts(text)
                    for column, value in zip(columns, found, strict=True):
                        column.append(value)
                    bad = base_failed(found[0], found[4])
                    failed.append(bad)
                    own = tests.get(next(langs))
                    if not bad and own:
                        rate = ratios(text, found)
                        bad = any(rate[i] > cutoff for i, cutoff in own)
                    kept.append(not bad)
            names = [n for n in batch.schema.names if n not in ("_text", "_lang")]
            arrays = [*(batch.column(n) for n in names), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *COUNTS, "base_failed", "kept"])

    rows = documents if keep else documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), "lang")
    rows = rows.withColumn("_lang", F.col("lang").cast("string"))
    if not keep:
        rows = rows.drop("lang")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_text", "_lang"))
    return rows.mapInArrow(run, f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")


def quality_rules(documents: DataFrame, labels: DataFrame, risk: float = 0.02) -> DataFrame:
    """doc_id, the counts, base_failed, kept for every row of documents (doc_id, text, lang)."""
    return judge(documents, learn(documents, labels, risk))
