"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a part of a partition are laid out in one array of symbols. An index maps every mergeable pair, by its
rank, to all its positions in that array; ranks that occur are applied in ascending order, each at all its positions at once, and the
lists of the pairs that a merge makes are extended on the way. This equals merging each word by itself because a merged symbol
takes part in later ranks only, which is checked when a vocabulary is read. Ids of words, and of what stands between blanks, are kept
in bounded caches of the worker; of the latter, those that the window at hand uses stay when their cache is full.

Only vocabularies of the kind of word_bpe_49k.json are read: NFC, white space to blanks, lower case, one splitting pattern,
byte symbols with an end-of-word suffix, no decoder. Added tokens inside a text are found as the library does: first in the
text, before anything else. Decoding joins the ids' tokens by blanks, as the library does for a vocabulary without a decoder.

Nulls count as empty texts: no ids, and an empty decoded text. Repeated rows are encoded alike; very long texts are cut at blanks;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import base
from keystrata.llm.token_counts import windows

CACHE_ENTRIES = 250_000
WORD_BATCH = 400_000

_state: dict = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Vocabulary:
    def __init__(self, text: str):
        made = json.loads(text)
        model = made["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        rules = made["normalizer"]["normalizers"]
        splits = made["pre_tokenizer"]["pretokenizers"]
        known = [r["type"] for r in rules] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        if not known or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"] or made["decoder"]:
            raise ValueError("this vocabulary is of another kind than word_bpe_49k.json")
        letters = byte_characters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.width = max(ids.values()) + 2
        keys = self.left * self.width + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        first = dict(zip(self.made.tolist()[::-1], range(len(merges) - 1, -1, -1), strict=True))
        if any(first.get(a, -1) >= r or first.get(b, -1) >= r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))):
            raise ValueError("a merge of this vocabulary uses a symbol that only a later merge makes")
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.letters = r"[\p{L}]+" in splits[0]["pattern"]["Regex"].split("|")  # letters alone are one word
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def split(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk; chunks have neither line breaks nor added tokens."""
        # A line break is changed by no rule and composes with nothing, so that all chunks go through the rules at once.
        whole = "\n".join(chunks)
        whole = lower(whole if whole.isascii() else unicodedata.normalize("NFC", whole))
        find, letters = self.pattern.findall, self.letters
        return [[c] if letters and c.isalpha() else find(c) for c in whole.split("\n")] if chunks else []


def lower(text: str) -> str:
    """Lower case, character by character: a final sigma is no special case."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, and how many each word has."""
    data = [w.encode() for w in words]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(lengths)
    symbols = vocabulary.inner[raw]
    full = lengths > 0
    symbols[ends[full] - 1] = vocabulary.last[raw[ends[full] - 1]]
    n = len(symbols)
    symbols = np.append(symbols, -1)
    word = np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = n
    joint = np.append(word[1:] == word[:-1], False) if n else np.zeros(0, bool)
    rank = np.where(joint, vocabulary.rank(symbols[:-1], symbols[1:]), -1) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    found, starts = np.unique(rank[at], return_index=True)
    index: dict[int, list] = {r: [p] for r, p in zip(found.tolist(), np.split(at, starts[1:]), strict=True)} if len(at) else {}
    queue = list(index)
    heapq.heapify(queue)
    grown: dict[int, list[int]] = defaultdict(list)
    ends_word = np.append(~joint, True)  # no pair crosses the end of a word
    dead = np.zeros(n + 1, bool)
    while queue:
        r = heapq.heappop(queue)
        lists = index.pop(r, [])
        if new := grown.pop(r, None):
            lists.append(np.array(new, np.int64))
        p = lists[0] if len(lists) == 1 and not new else np.unique(np.concatenate(lists))
        a, b, c = int(vocabulary.left[r]), int(vocabulary.right[r]), int(vocabulary.made[r])
        p = p[(symbols[p] == a) & ~ends_word[p] & ~dead[p]]
        p = p[symbols[after[p]] == b]
        if a == b and len(p) > 1:
            free, kept = -1, []
            for x, y in zip(p.tolist(), after[p].tolist(), strict=True):
                if x != free:
                    kept.append(x)
                    free = y
            p = np.array(kept, np.int64)
        if not len(p):
            continue
        q = after[p]
        symbols[p] = c
        dead[q] = True
        ends_word[p] = ends_word[q]
        s = after[q]
        after[p] = s
        before[s] = p
        more = p[~ends_word[p]]
        prior = before[p]
        prior = prior[prior >= 0]
        prior = prior[~ends_word[prior]]
        for start in (more, prior):
            if len(start):
                ranks = vocabulary.rank(symbols[start], symbols[after[start]])
                pairs = ranks >= 0
                for k, x in zip(ranks[pairs].tolist(), start[pairs].tolist(), strict=True):
                    if k not in index and k not in grown:
                        heapq.heappush(queue, k)
                    grown[k].append(x)
    alive = ~dead[:n]
    return symbols[:n][alive], np.bincount(word[alive], minlength=len(words))


class Encoder:
    """A vocabulary with the worker's caches: chunks of texts between blanks, and the words inside them."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.ids: dict[str, bytes] = {"": b""}  # of a chunk
        self.decoded: dict[str, str] = {"": ""}  # of a chunk, a blank after each token
        self.words: dict[str, tuple[bytes, str]] = {}

    def merge(self, words: list[str]) -> None:
        """Take words into the cache."""
        ids, lengths = encode_words(words, self.vocabulary)
        packed, listed, names = ids.astype("<u4").tobytes(), ids.tolist(), self.vocabulary.tokens
        at = 0
        for word, end in zip(words, np.cumsum(lengths).tolist(), strict=True):
            self.words[word] = packed[4 * at : 4 * end], "".join([names[i] + " " for i in listed[at:end]])
            at = end

    def learn(self, chunks: list[str]) -> None:
        """Take chunks without blanks or line breaks into the cache; what stands beside an added token is a chunk too."""
        own = self.vocabulary
        parts: dict[str, list[str]] = {}
        if own.special and own.special.search("\n".join(chunks)):
            parts = {c: own.special.split(c) for c in chunks if own.special.search(c)}
            chunks = list({*chunks, *(p for found in parts.values() for p in found if p not in own.added)}.difference(parts))
        plans = own.split(chunks)
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        self.merge(list({w for plan in plans for w in plan if w not in self.words}))
        for chunk, plan in zip(chunks, plans, strict=True):
            if len(plan) == 1:
                self.ids[chunk], self.decoded[chunk] = self.words[plan[0]]
            else:
                found = [self.words[w] for w in plan]
                self.ids[chunk], self.decoded[chunk] = b"".join([f[0] for f in found]), "".join([f[1] for f in found])
        for chunk, found in parts.items():
            self.ids[chunk] = b"".join([own.added[p].to_bytes(4, "little") if p in own.added else self.ids[p] for p in found])
            self.decoded[chunk] = "".join([p + " " if p in own.added else self.decoded[p] for p in found])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian 32-bit) and decoded text of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        used = set().union(*split)
        new = used.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_ENTRIES:
            # What these texts use stays, the rest goes.
            self.ids = {c: self.ids[c] for c in used if c in self.ids} | {"": b""}
            self.decoded = {c: self.decoded[c] for c in self.ids}
        todo = list(new)
        for i in range(0, len(todo), WORD_BATCH):
            self.learn(todo[i : i + WORD_BATCH])
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        for chunks in split:
            yield b"".join(map(ids, chunks)), "".join(map(decoded, chunks))[:-1]


def decode(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of ids, as the library gives it without a decoder: known ids' tokens joined by blanks."""
    names = vocabulary.tokens
    return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in names])


def encoder(path: str) -> Encoder:
    if path not in _state:
        with open(path, encoding="utf-8") as file:
            _state[path] = Encoder(file.read())
    return _state[path]


def encode_documents(documents: DataFrame, path: str, window_bytes: int = 2 << 20, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents; with the ids themselves on request (binary).

    The vocabulary file is part of the installed tokenizer package on every machine, as the library itself is.
    """
    base.importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            sizes, ids, texts, raw = [], [], [], []
            for part in windows(batch.column("text"), window_bytes):
                for packed, decoded in own.encode([t or "" for t in part.to_pylist()]):
                    sizes.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        raw.append(packed)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
