"""Token counts of whole texts by a public tokenizer, in Arrow functions that return lengths only.

Texts are split at safe boundaries: before a space or line end that stands alone between two characters that are not white
space. The tokenizer's own splitting never spans such a place, so the pieces' counts add up to the text's. Each worker keeps the
counts of pieces it has met (a bounded cache) and sends the others to the library in batches of about equal bytes.

Nulls count as empty texts, which have no tokens. Special strings inside a text are handled as the library does by default.
Repeated rows and ids are counted alike; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import base

#: White space other than lone spaces and line ends, so that splitting by plain spaces is not safe.
UNEVEN = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\xa0]|[ \n]{2}|\A[ \n]|[ \n]\Z")
SAFE = re.compile(r"(?<=\S)(?= \S)")
SPECIAL = "<|"
CACHE_ENTRIES = 400_000
BATCH_BYTES = 1 << 18

_state: dict = {}


class Counter:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def learn(self, pieces: set[str]) -> None:
        """Counts of new pieces. A piece that starts with a line end stands as it is; any other is read behind a space."""
        if len(self.known) + len(pieces) > CACHE_ENTRIES:
            self.known = {}
        odd = [p for p in pieces if SPECIAL in p or p[:1] == "\n"]
        for batch in balanced(odd, BATCH_BYTES):
            self.known.update(zip(batch, map(len, self.encode([p if p[:1] == "\n" else f" {p}" for p in batch])), strict=True))
        for batch in balanced([p for p in pieces if not (SPECIAL in p or p[:1] == "\n")], BATCH_BYTES):
            text = " " + " ".join(batch)
            found = self.tokenizer.encode(text, add_special_tokens=False)
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            edges = np.cumsum([0, *(len(p) + 1 for p in batch)])
            counts = np.bincount(np.searchsorted(edges, starts, "right") - 1, minlength=len(batch))
            self.known.update(zip(batch, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split: list[tuple[int, str, list[str]]] = []
        uneven: list[int] = []
        for i, text in enumerate(texts):
            if UNEVEN.search(text):
                uneven.append(i)
            elif text:
                first, *rest = text.replace("\n", " \n").split(" ")
                split.append((i, first, rest))
        out = [0] * len(texts)
        new: set[str] = set().union(*(s[2] for s in split)).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_ENTRIES:  # the cache starts anew with all that this batch needs
                new = set().union(*(s[2] for s in split))
            self.learn(new)
        known = self.known.__getitem__
        firsts = self.encode([s[1] for s in split])
        for (i, _, rest), first in zip(split, firsts, strict=True):
            out[i] = len(first) + sum(map(known, rest))
        pieces, owner = [], []
        for i in uneven:
            for piece in grouped(SAFE.split(texts[i]), BATCH_BYTES):
                pieces.append(piece)
                owner.append(i)
        at = 0
        for batch in balanced(pieces, BATCH_BYTES):
            for found in self.encode(batch):
                out[owner[at]] += len(found)
                at += 1
        return out


def utf8_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def grouped(pieces: list[str], size: int) -> Iterator[str]:
    """Joins neighbouring pieces to about `size` bytes."""
    start, held = 0, 0
    for i, piece in enumerate(pieces):
        own = utf8_bytes(piece)
        if held and held + own > size:
            yield "".join(pieces[start:i])
            start, held = i, 0
        held += own
    yield "".join(pieces[start:])


def balanced(texts: list[str], size: int) -> Iterator[list[str]]:
    """Consecutive batches of about `size` bytes; a longer text is a batch of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        own = utf8_bytes(text)
        if held and held + own > size:
            yield texts[start:i]
            start, held = i, 0
        held += own + 1
    if start < len(texts):
        yield texts[start:]


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file; it and its cache last as long as the worker."""
    if path not in _state:
        _state[path] = Counter(path)
    return _state[path]


def spans(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts of a string column of about `most` bytes each, a longer text alone."""
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0))
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, i - start
            start, held = i, 0
        held += size
    if start < len(column):
        yield start, len(column) - start


def windows(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of a string column of about `most` bytes each."""
    return (column.slice(start, n) for start, n in spans(column, most))


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of a string column each."""
    return (batch.slice(start, n) for start, n in spans(batch.column(column), most))


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, window_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents (doc_id long, text)."""
    base.importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column("text")
            counts: list[int] = []
            for part in windows(texts, window_bytes):
                counts += own.count([t or "" for t in part.to_pylist()])
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = pa.array(counts, pa.int64())
            over = pc.greater(tokens, limit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, tokens, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
