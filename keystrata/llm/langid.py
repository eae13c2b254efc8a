"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Subwords are the 3- and 4-grams of the UTF-8 bytes of lower-case words in blanks (other signs count as blanks). A text's
vector is the mean of its subwords' embeddings; embeddings and the softmax layer are trained together in numpy on a bounded
sample of labelled texts; others of it calibrate the softmax temperature and the score under which a document is rejected: the k-th
lowest score of rightly told texts for k = floor((n + 1) * false_rejection), so that a further text of the learned languages is rejected with
at most that chance. With fewer than 1 / false_rejection such texts no score can promise that, and only texts without a letter are rejected. For
prediction embedding and layer are multiplied into one table, so that every whole text costs one look-up for each subword.

Every language that occurs is learned. Nulls: a null text, or one without a letter (Unicode class L), gets `und`, score 0 and is not rejected for its score but as `und`; rows with a
null lang are predicted and never learned from. Ties go to the first language by code point. Without a labelled row everything
is `und`. Repeated rows are predicted alike; very long texts are read in pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm import base
from keystrata.llm.token_counts import windows

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
PIECE = 1 << 20
#: Bytes whose subwords are looked up at once.
AT_ONCE = 1 << 18
SIZES = (3, 4)

#: Bytes as subwords see them: ASCII letters in lower case, other ASCII as blanks, the rest as they are.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x langs: embedding times softmax layer
    bias: np.ndarray
    temperature: float
    reject: float


def grams(data: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and start of every subword in the data, which begins and ends with a blank."""
    raw = FOLD[np.frombuffer(data, np.uint8)]
    upper = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    raw[upper] += 0x20  # Latin-1 capitals in UTF-8
    blank = raw == 32
    code = raw.astype(np.uint32)
    where, found = [], []
    three = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    inner = ~blank[1:-1]
    at = np.flatnonzero(inner)
    found.append((three[at] * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1))
    where.append(at)
    at = np.flatnonzero(inner[:-1] & inner[1:])
    four = (three[at] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519) + code[at + 3] * np.uint32(3266489917)
    four ^= four >> np.uint32(15)
    found.append((four * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1))
    where.append(at)
    return np.concatenate(found), np.concatenate(where)


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Parts of a long text, cut at blanks where there is one, each within blanks."""
    at = 0
    while len(data) - at > size:
        stop = data.rfind(b" ", at + size // 2, at + size)
        stop = at + size if stop < 0 else stop
        yield data[at:stop]
        at = stop
    yield data[at:]


def logits(texts: list[bytes], model: Model) -> np.ndarray:
    """Mean table row of each text's subwords plus bias."""
    buckets, width = model.table.shape
    sums, counts = np.zeros((len(texts), width)), np.zeros(len(texts))

    def add(owners: list[int], parts: list[bytes]) -> None:
        joined = b" " + b" ".join(parts) + b" "
        edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
        found, at = grams(joined, buckets)
        owner = np.array(owners)[np.minimum(np.searchsorted(edges, at, "right") - 1, len(parts) - 1)]
        counts[:] += np.bincount(owner, minlength=len(texts))
        for j in range(width):
            sums[:, j] += np.bincount(owner, model.table[:, j][found], minlength=len(texts))

    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            owners.append(i), held.append(part)
            size += len(part)
            if size >= AT_ONCE:
                add(owners, held)
                owners, held, size = [], [], 0
    if held:
        add(owners, held)
    return sums / np.maximum(counts, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: list[bytes], labels: list[str], buckets: int = 1 << 15, width: int = 12, epochs: int = 6, rate: float = 0.5, seed: int = 5,
    sample: int = 4000, false_rejection: float = 0.001,
) -> Model | None:
    """A model of at most `sample` of the labelled texts; None without any. The others, a fifth at least, calibrate it."""
    langs = sorted(set(labels))
    if not langs:
        return None
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(texts))
    cut = min(sample, len(order) - len(order) // 5) if len(order) >= 50 else len(order)
    learned, held = order[:cut], order[cut:] if len(order) >= 50 else order
    y = np.array([langs.index(x) for x in labels])
    bags = {}
    for i in learned:
        found, times = np.unique(grams(b" " + texts[i] + b" ", buckets)[0], return_counts=True)
        bags[i] = (found, times / max(1, times.sum()))
    embedding = draw.normal(0, 1 / width, (buckets, width)).astype(np.float32)
    layer, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in draw.permutation(learned):
            found, share = bags[i]
            vector = share @ embedding[found] if len(found) else np.zeros(width)
            p = softmax((vector @ layer + bias)[None])[0]
            p[y[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(vector, p)
            bias -= 0.1 * step * p
            if len(found):
                embedding[found] -= (step * 50 * share)[:, None] * back[None]
    model = Model(langs, (embedding @ layer).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    z, truth = logits([texts[i] for i in held], model), y[held]
    grid = np.geomspace(0.02, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    rank = int((len(right) + 1) * false_rejection)
    model.reject = float(right[rank - 1]) if rank else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(documents: DataFrame, sample: int = 4000, calibrate: int = 4000, chars: int = 3000, least: int = 20, few: int = 10_000) -> Model | None:
    """A model from about `sample` labelled rows outside the held-out part, calibrated on about `calibrate` more, drawn by a hash of doc_id.

    Every language gets an equal share of both, `least` rows at least; of each drawn text at most `chars` characters around its middle are
    learned from. These are bounds on the labelled rows alone. Rows of one language with the same text count once. One pass counts the
    languages and one draws their rows; up to `few` languages are broadcast to it, more are joined.
    """
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    per = base.cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = per.count()
    if not langs:
        return None
    each = max(least, (sample + calibrate) // langs)
    draw = F.xxhash64(F.lit(23), "doc_id")
    # A hash range with about twice the rows wanted, then exactly the lowest of them.
    upto = F.floor(F.least(F.lit(1.0), (2.0 * each + 20) / F.col("n")) * 1_000_003) + 1
    per = per.select("lang", upto.alias("upto"))
    start = F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2).cast("int"))
    rows = rows.select("lang", draw.alias("draw"), "text").join(F.broadcast(per) if langs <= few else per, "lang")
    drawn = rows.filter(F.pmod("draw", F.lit(1_000_003)) < F.col("upto")).select("lang", "draw", F.substring("text", start, F.lit(chars)).alias("text"))
    ranked = drawn.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("turn") <= each)
    found = ranked.select("lang", "text").distinct().orderBy("lang", "text").collect()
    return train([r["text"].encode("utf-8", "replace") for r in found], [r["lang"] for r in found], sample=sample)


def predict(documents: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """held_out, lang_pred, score and rejected for every row; with doc_id alone, or after all columns of documents (`keep`)."""
    spark = documents.sparkSession
    base.importable(spark)
    sent = spark.sparkContext.broadcast(model)
    flag = held_out(F.col("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = batch.column("text" if keep else "_text")
            names, scores, bad = [], [], []
            for part in windows(column, 2 << 20):
                a, b, c = judge(part.to_pylist(), own)
                names += a
                scores += b
                bad += c
            kept = [n for n in batch.schema.names if n != "_text"]
            extra = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *extra], names=[*kept, "lang_pred", "score", "rejected"])

    if keep:
        rows = documents.withColumn("held_out", flag)
    else:
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def judge(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    names, scores, bad = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if model is None:
        return names, scores, bad
    live = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if live:
        p = softmax(logits([texts[i].encode("utf-8", "replace") for i in live], model) / model.temperature)
        best = p.argmax(axis=1)
        top = p[np.arange(len(live)), best]
        for i, k, s in zip(live, best.tolist(), top.tolist(), strict=True):
            names[i], scores[i], bad[i] = model.langs[k], min(1.0, max(0.0, s)), s < model.reject
    return names, scores, bad


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of documents (doc_id, text, lang)."""
    return predict(documents, learn(documents))
