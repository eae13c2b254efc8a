"""Near-duplicate join on word n-grams: chosen-path candidates, exact Jaccard, classes of linked documents.

A text is the set of its five-word shingles; equal sets are one row from the start. Each set keeps a sample, its `SAMPLE` least
token hashes, so that like sets have like samples. In each of several independent runs a set goes down to the children of a node
that are named by the sampled tokens whose hash under that node is below 1 / (split * size of the sample), so a pair of likeness J meets
under at least J / split shared tokens on average. A bucket with few sets is compared at once; a larger one splits again, level by
level, until its parts are small. A bucket that hardly splits (a child keeps `SAME` of its parent's sets, as groups of near copies do) or
that is still large on level `LEVELS` is compared in blocks bounded by rows and by bytes of tokens, each pair of blocks a task's unit.
That part is quadratic in the number of different sets of such a group: exact link counts are as many as that; exact copies cost nothing.

The number of runs follows from the target recall: the chance that a pair of the least likeness survives any number of levels is
that of a branching process with J / split children on average.

A pair is compared in the first bucket alone that holds both its sets, so link counts need no list of pairs. Buckets first
work on sketches (the 16 least hashes): a pair of likeness 0.8 shares fewer than 0.3 of them, 5 of 16, with a probability of about
3e-6, unlike pairs mostly do. Only sets that pass with some other one have their text read again and moved to the
bucket, where the exact Jaccard decides. Links become classes by star contraction.

Sets are named by 64 bits of their hash. Words are runs of other characters than ASCII white space, as they stand. A text of
one to four words is one shingle; a text without words, or null, links with nothing. Documents with one doc_id and different
texts link as any others do; a null doc_id links as any other, is carried along and never names a class. A row is told by its doc_id and
a hash of its text. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import base

WORDS = 5
LEAST = 0.8
SPLIT = 0.5
SAMPLE = 64
FEW = 48  # a bucket up to this size is compared and not split again
SAME = 0.7  # a child with this share of its parent's sets is not split again
LEVELS = 6
BLOCK = 2048  # sets of a block
BLOCK_BYTES = 8 << 20  # bytes of a block's tokens
SKETCH = 16
SKETCH_SHARE = 0.3
TARGET = 0.999


def runs_for(target: float = TARGET, least: float = LEAST, split: float = SPLIT) -> int:
    """Runs until a pair of the least likeness meets with the target probability, however many levels it has to go down."""
    meet = 1.0
    for _ in range(200):
        meet = 1 - math.exp(-least / split * meet)
    return math.ceil(math.log(1 - target) / math.log(1 - meet))


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix finalizer over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "replace").split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    key = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, len(words))):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(key)


def _name(tokens: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(tokens)).view(np.int64))


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _row():
    """What tells rows of documents apart, beside their doc_id: a hash of id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name, size and sample of each row's set."""
    for batch in batches:
        names, sizes, low = [], [], []
        for text in batch.column("text"):
            tokens = shingles(text.as_py())
            names.append(_name(tokens.tobytes()) if len(tokens) else None)
            sizes.append(len(tokens))
            low.append(tokens[:SAMPLE].copy())
        arrays = [batch.column("doc_id"), batch.column("row"), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), _listed(low)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "set", "n", "sample"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of longs, or of a binary column that holds 64-bit numbers."""
    if pa.types.is_list(column.type):
        return column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy().astype(np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[: len(held) // 8 * 8].view(np.uint64), ends // 8


def children(sample: tuple[np.ndarray, np.ndarray], parents: tuple[np.ndarray, np.ndarray], split: float = SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below each set's parents: (place of the parent in the flat list of parents, node)."""
    tokens, edges = sample
    above, of = parents
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(len(sizes)), np.diff(of))
    times = sizes[owner]
    ends = np.cumsum(times)
    place = np.repeat(np.arange(len(owner)), times)
    inside = np.arange(len(place)) - np.repeat(ends - times, times)
    own = tokens[np.repeat(edges[:-1][owner], times) + inside]
    node = above[of[0] : of[-1]][place]
    bound = np.minimum(2.0**64 / (split * np.maximum(sizes, 1)), 1.8446744073709550e19).astype(np.uint64)
    with np.errstate(over="ignore"):
        drawn = mixed(own ^ node)
        hit = drawn < bound[owner[place]]
        return place[hit], mixed(drawn[hit] ^ (node[hit] * np.uint64(0x9E3779B97F4A7C15)))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, n, node, above) for every child of each row's parents; `above` is how many sets the parent holds."""
    for whole in batches:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            parents = _lists(batch.column("parents"))
            place, node = children(_lists(batch.column("sample")), parents)
            owner = np.repeat(np.arange(len(batch)), np.diff(parents[1]))[place]
            held = _lists(batch.column("sizes"))
            above = held[0][held[1][0] :][place].view(np.int64)
            arrays = [batch.column("set").to_numpy()[owner], batch.column("n").to_numpy()[owner].astype(np.int64), node.view(np.int64), above]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["set", "n", "node", "above"])


class Bucket:
    """Sets that share a node (or two blocks of them): which pairs to compare here, and how many tokens they share."""

    def __init__(self, path: int, across: bool, pieces: list[tuple[dict, int, int]]):
        self.path, self.across = np.uint64(path % 2**64), across
        names = pieces[0][0].keys()
        made: dict = {}
        for name in names:
            if isinstance(pieces[0][0][name], tuple):
                values, sizes = [], []
                for columns, a, b in pieces:
                    held, edges = columns[name]
                    values.append(held[edges[a] : edges[b]])
                    sizes.append(np.diff(edges[a : b + 1]))
                made[name] = (np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
            else:
                made[name] = np.concatenate([columns[name][a:b] for columns, a, b in pieces])
        self.columns = made
        # A row that comes twice counts once.
        self.keep = np.sort(np.unique(made["set"], return_index=True)[1])
        self.set, self.n, self.part = (made[c][self.keep] for c in ("set", "n", "part"))
        self.copies = made["copies"][self.keep] if "copies" in made else None
        self._marked: tuple | None = None

    def list(self, name: str, i: int) -> np.ndarray:
        values, edges = self.columns[name]
        k = self.keep[i]
        return values[edges[k] : edges[k + 1]]

    def _postings(self, name: str, below: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of each row's values with row edges, and the rows of each code with code edges."""
        rows = [self.list(name, i) for i in range(len(self.keep))]
        if below is not None:
            rows = [r[r < below] for r in rows]
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        values, codes = np.unique(np.concatenate(rows), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), np.diff(edges))
        order = np.argsort(codes, kind="stable")
        return codes, edges, owner[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(values)))])

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, all j > i) to compare here: like sketches, fitting sizes, and no bucket before this one."""
        m = len(self.keep)
        if m <= 24:
            low = [frozenset(self.list("low", i).tolist()) for i in range(m)]
            leaves = [frozenset(self.list("leaves", i).tolist()) for i in range(m)]
            path, n, part = int(self.path), self.n.tolist(), self.part.tolist()
            for i in range(m - 1):
                found = []
                for j in range(i + 1, m):
                    small, large = min(n[i], n[j]), max(n[i], n[j])
                    if small < LEAST * large or (self.across and part[i] == part[j]):
                        continue
                    if len(low[i] & low[j]) >= SKETCH_SHARE * min(SKETCH, small) and min(leaves[i] & leaves[j]) == path:
                        found.append(j)
                if found:
                    yield i, np.array(found)
            return
        codes, edges, owners, starts = self._postings("low")
        before, b_edges, b_owners, b_starts = self._postings("leaves", self.path)
        size = self.n
        for i in range(m - 1):
            own = codes[edges[i] : edges[i + 1]]
            common = np.bincount(np.concatenate([owners[starts[c] : starts[c + 1]] for c in own.tolist()]), minlength=m)
            small, large = np.minimum(size, size[i]), np.maximum(size, size[i])
            fits = (common >= SKETCH_SHARE * np.minimum(SKETCH, small)) & (small >= LEAST * large)
            fits[: i + 1] = False
            if self.across:
                fits &= self.part != self.part[i]
            if fits.any():
                for c in before[b_edges[i] : b_edges[i + 1]].tolist():
                    fits[b_owners[b_starts[c] : b_starts[c + 1]]] = False
                if (found := np.flatnonzero(fits)).size:
                    yield i, found

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose exact Jaccard with i is at least LEAST."""
        if len(self.keep) <= 24:
            own = self.list("tokens", i)
            both = np.array([len(np.intersect1d(own, self.list("tokens", j), assume_unique=True)) for j in others.tolist()])
        else:
            if self._marked is None:
                values, edges = self.columns["tokens"]
                distinct, codes = np.unique(values, return_inverse=True)
                self._marked = codes.astype(np.int32), edges, np.zeros(len(distinct), bool)
            codes, edges, mark = self._marked
            k = self.keep[i]
            own = codes[edges[k] : edges[k + 1]]
            mark[own] = True
            if len(others) * 4 > len(self.keep):
                both = np.add.reduceat(mark[codes], edges[:-1], dtype=np.int64)[self.keep[others]]
            else:
                both = np.array([np.count_nonzero(mark[codes[edges[j] : edges[j + 1]]]) for j in self.keep[others].tolist()])
            mark[own] = False
        return others[both >= LEAST * (self.n[i] + self.n[others].astype(np.int64) - both)]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, Bucket]]:
    """Each bucket in turn, from rows sorted by (path, left, right); columns stay as Arrow holds them."""
    name: tuple[int, int, int] | None = None
    pieces: list[tuple[dict, int, int]] = []
    for batch in batches:
        if not len(batch):
            continue
        key = [batch.column(c).to_numpy() for c in ("path", "left", "right")]
        columns: dict = {}
        for c in batch.schema.names:
            if c not in ("path", "left", "right"):
                column = batch.column(c)
                columns[c] = _lists(column) if c in ("low", "leaves", "tokens") else column.to_numpy()
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        starts = [0, *change.tolist()]
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            own = (int(key[0][a]), int(key[1][a]), int(key[2][a]))
            if own != name and pieces:
                yield *name, Bucket(name[0], name[1] != name[2], pieces)
                pieces = []
            name = own
            pieces.append((columns, a, b))
    if pieces:
        yield *name, Bucket(name[0], name[1] != name[2], pieces)


def _table(held: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(held, fields, strict=True)], names=[n for n, _ in fields])
    for c in held:
        c.clear()
    return batch


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of each bucket that have to be compared there."""
    fields = [("path", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("part", pa.int32()), ("set", pa.int64())]
    out: list[list] = [[] for _ in fields]
    for path, left, right, bucket in _buckets(batches):
        live: set[int] = set()
        for i, found in bucket.pairs():
            live.add(i)
            live.update(found.tolist())
        for k in sorted(live):
            for column, value in zip(out, (path, left, right, int(bucket.part[k]), int(bucket.set[k])), strict=True):
                column.append(value)
        if len(out[0]) > 20_000:
            yield _table(out, fields)
    yield _table(out, fields)


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, packed = [], []
        for name, text in zip(batch.column("set").to_pylist(), batch.column("text"), strict=True):
            data = shingles(text.as_py()).tobytes()
            same = _name(data) == name  # a safeguard: rows are told by hashes
            keep.append(same)
            packed.append(data if same else b"")
        columns = [n for n in batch.schema.names if n != "text"]
        arrays = [*(batch.column(n) for n in columns), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "tokens"]).filter(pa.array(keep, pa.bool_()))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, null, links): documents that a set links with in this bucket; (a, b, 0): enough of the links to connect its sets."""
    fields = [("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]
    out: list[list] = [[] for _ in fields]
    for *_, bucket in _buckets(batches):
        root = list(range(len(bucket.keep)))
        links = np.zeros(len(root), np.int64)

        def top(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, others in bucket.pairs():
            found = bucket.linked(i, others)
            links[i] += bucket.copies[found].sum()
            links[found] += bucket.copies[i]
            for j in found.tolist():
                if top(i) != top(j):
                    root[top(i)] = top(j)
                    for column, value in zip(out, (int(bucket.set[i]), int(bucket.set[j]), 0), strict=True):
                        column.append(value)
        for k in np.flatnonzero(links).tolist():
            for column, value in zip(out, (int(bucket.set[k]), None, int(links[k])), strict=True):
                column.append(value)
        if len(out[0]) > 20_000:
            yield _table(out, fields)
    yield _table(out, fields)


def _leaves(sets: DataFrame, target: float) -> DataFrame:
    """(set, node, size, tokens) of every bucket in which a set is compared: nodes of two sets or more that are not split again."""
    seeds = mixed(np.arange(1, runs_for(target) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64).tolist()
    parents = sets.select("set", "n", "sample", F.array(*map(F.lit, seeds)).alias("parents"), F.array_repeat(F.lit(0).cast("long"), len(seeds)).alias("sizes"))
    out = None
    for level in range(LEVELS):
        nodes = parents.mapInArrow(_descend, "set long, n long, node long, above long")
        counted = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens")).filter("size > 1")
        held = base.cut(nodes.join(counted, "node").select("set", "node", "size", "tokens", "above"))
        again = (F.col("size") > FEW) & ((F.col("above") == 0) | (F.col("size") < F.col("above") * SAME)) & F.lit(level + 1 < LEVELS)
        done = held.filter(~again).select("set", "node", "size", "tokens")
        out = done if out is None else out.unionByName(done)
        more = held.filter(again)
        if more.isEmpty():
            break
        listed = more.groupBy("set").agg(F.collect_list(F.struct("node", "size")).alias("p"))
        parents = listed.join(sets, "set").select("set", "n", "sample", F.col("p.node").alias("parents"), F.col("p.size").alias("sizes"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that is not its component's least node; edges (a, b) of longs.

    Large-star and small-star steps in turn, until nothing changes: a number of rounds of the order of the logarithm of the nodes.
    """
    now = base.cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen) or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = base.cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())


def _classes(documents: DataFrame, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, set) of every row of documents, set null for a text without words; (set, copies, class_id, n_links, first).

    `first` is one row (lost, doc_id, row) of the whole class: the least doc_id, or null where no row has one (`lost`).
    """
    spark = documents.sparkSession
    base.importable(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row().alias("row"))
    found = base.cut(documents.mapInArrow(_samples, "doc_id long, row long, set long, n int, sample array<long>"))
    members = found.select("doc_id", "row", "set")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row")).alias("rep")
    about = [F.any_value(c).alias(c) for c in ("n", "sample")]
    sets = base.cut(found.filter("set is not null").groupBy("set").agg(rep, F.count(F.lit(1)).alias("copies"), *about))

    leaves = _leaves(sets, target).groupBy("set").agg(F.collect_list(F.struct("node", "size", "tokens")).alias("at"))
    low = F.slice("sample", 1, SKETCH).alias("low")
    about = base.cut(leaves.join(sets.select("set", "rep", "copies", "n", low), "set").withColumn("leaves", F.col("at.node")))

    entries = about.select("set", "n", "low", "leaves", F.explode("at").alias("l"))
    entries = entries.select("set", "n", "low", "leaves", F.col("l.node").alias("path"), F.col("l.size").alias("size"), F.col("l.tokens").alias("weight"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") * 8 / BLOCK_BYTES)).cast("int")
    entries = entries.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("set", "path"), parts).cast("int")})
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entries = entries.select("path", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "set", "n", "low", "leaves")
    n = base.partitions(spark)
    bucket = ["path", "left", "right"]
    wanted = entries.repartition(n, *bucket).sortWithinPartitions(*bucket).mapInArrow(_wanted, "path long, left int, right int, part int, set long")
    wanted = base.cut(wanted.groupBy("set").agg(F.collect_list(F.struct(*bucket, "part")).alias("at")))

    heads = wanted.join(about.drop("at"), "set").select("*", "rep.doc_id", "rep.row").drop("rep")
    texts = documents.join(heads, ["doc_id", "row"])
    if not sets.filter("rep.lost").isEmpty():
        # Sets of which no row has an id: one of their equal texts each.
        lost = documents.filter("doc_id is null").groupBy("row").agg(F.any_value("text").alias("text"))
        texts = texts.unionByName(lost.join(heads.filter("doc_id is null"), "row"))
    fields = "doc_id long, set long, at array<struct<path:long,left:int,right:int,part:int>>, copies long, n int, low array<long>, leaves array<long>"
    read = texts.select("doc_id", "set", "at", "copies", "n", "low", "leaves", "text").mapInArrow(_read_sets, f"{fields}, tokens binary")
    sent = read.withColumn("l", F.explode("at")).select("l.path", "l.left", "l.right", "l.part", "set", "copies", "n", "low", "leaves", "tokens")
    made = base.cut(sent.repartition(n, *bucket).sortWithinPartitions(*bucket).mapInArrow(_links, "a long, b long, links long"))

    roots = components(made.filter("b is not null").select("a", "b"))
    links = made.filter("b is null").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    named = sets.select("set", "rep", "copies").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    classes = named.groupBy("root").agg(F.min("rep").alias("first"))
    named = named.join(classes, "root").join(links, "set", "left")
    named = base.cut(named.select("set", "copies", "first", F.col("first.doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return members, named


def near_duplicates(documents: DataFrame, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links for every row of documents (doc_id long, text string).

    class_id is the least doc_id of the documents connected by links of Jaccard 0.8 or more; n_links is how many other
    documents one links with, copies counted one by one.
    """
    members, named = _classes(documents, target)
    members, named = members.drop("row"), named.drop("first")
    out = base.attach(members.filter("set is not null"), "set", named, "copies").select("doc_id", "class_id", "n_links")
    alone = members.filter("set is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class of documents, the one of the least doc_id, whatever other rows share that id.

    Texts without words stay, but for rows with the same doc_id and text; of these, and of such rows in a class, one stays. Rows
    without an id are near copies like any others, and those without words all stay.
    """
    members, named = _classes(documents)
    heads = named.select("first.doc_id", "first.row").unionByName(members.filter("set is null and doc_id is not null").select("doc_id", "row"))
    # Ids and rows that no null hides, so that both can be joined and grouped on.
    heads = heads.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("row").alias("_row")).distinct()
    rows = documents.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_row": _row()})
    kept = rows.join(heads, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select(*documents.columns)
    wordless = F.length(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), f"[{base.WS}]", "")) == 0
    return kept.unionByName(documents.filter(F.col("doc_id").isNull() & wordless))
