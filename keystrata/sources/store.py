"""A durable store: batches of operations and sorted levels in Parquet folders, named by superblocks.

A superblock is a small JSON file that lists the batches of level 0 and the run of every other level. Each change writes new folders first
and then the next superblock, under a name that only one writer can take; a crash in between leaves the old state. Folders that a newer
superblock no longer names stay until `vacuum`, so that rows read earlier keep working. Newest versions are told by lsn alone, wherever a row lies.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import kv, order
from keystrata.operators import compaction, merge, scan, state

SCHEMA = "key string, lsn long, op string, value string"
BINARY_SCHEMA = "key binary, lsn long, op string, value binary"
MEGABYTES = ("level0_size", "medium_log_LRU_cache_size")
GC_LIMIT = 100_000  # segments a round of collection takes at most


@dataclass(frozen=True)
class Options:
    """Settings of a store; exactly one of primary and replica holds. Sizes are bytes here and megabytes in a file."""

    level0_size: int = 1 << 20
    growth_factor: int = 4
    level_medium_inplace: int = 3
    medium_log_LRU_cache_size: int = 400 << 20
    gc_interval: int = 10
    primary_mode: bool = True
    replica_mode: bool = False
    replica_build_index: bool = False
    replica_send_index: bool = False
    enable_bloom_filters: bool = True
    enable_compaction_double_buffering: bool = True
    number_of_replicas: int = 1

    def __post_init__(self) -> None:
        if self.primary_mode == self.replica_mode:
            raise ValueError("a store is either primary or replica")
        if self.replica_build_index and self.replica_send_index:
            raise ValueError("a replica either builds its index or is sent one")
        if self.level0_size <= 0 or self.growth_factor < 2:
            raise ValueError("level0_size and growth_factor are too small")

    @classmethod
    def parse(cls, text: str, whole: bool = False) -> Options:
        """From lines `name: number`; an unknown name is an error, and so is a missing one if the text is to be `whole`."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            line = line.split("#")[0].strip()
            if line:
                name, _, value = line.partition(":")
                if name.strip() not in kinds:
                    raise ValueError(f"unknown option {name.strip()}")
                number = int(value) * (1 << 20 if name.strip() in MEGABYTES else 1)
                found[name.strip()] = kinds[name.strip()](number)
        if whole and (missing := sorted(kinds.keys() - found.keys())):
            raise KeyError(f"no option {', '.join(missing)}")
        return cls(**found)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Options:
        """From an options file that has every option."""
        return cls.parse("\n".join(r["value"] for r in spark.read.text(path).collect()), whole=True)


@dataclass
class Callbacks:
    """What a store tells a listener; each may be absent."""

    segment_is_full: Callable[[int], None] | None = None
    spin_for_medium_log_flush: Callable[[int], None] | None = None
    compaction_started: Callable[[int, int], None] | None = None
    compaction_ended: Callable[[int, str], None] | None = None
    swap_levels: Callable[[int, int], None] | None = None
    comp_write_cursor_flush_segment: Callable[[str, int], None] | None = None
    comp_write_cursor_got_flush_replies: Callable[[int], None] | None = None
    build_index_L0_compaction_started: Callable[[], None] | None = None

    def tell(self, event: str, *args: object) -> None:
        if called := getattr(self, event):
            called(*args)


class Store:
    opened: Counter[str] = Counter()  # handles of each store in this process

    def __init__(self, spark: SparkSession, base: str, name: str, create: bool = True, options: Options | None = None, binary: bool = False, callbacks: Callbacks | None = None):
        if not 0 < len(name.encode()) <= 64:
            raise ValueError("a store's name has 1 to 64 bytes")
        self.spark, self.name, self.path, self.options = spark, name, f"{base}/{name}", options or Options()
        self.callbacks, self.refused = callbacks or Callbacks(), 0
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(self.path)):
            if not create:
                raise FileNotFoundError(f"no store {name}")
            self._fs.mkdirs(self._path(self.path))
        if not self._numbers():
            self._put(1, {"binary": binary, "next": 1, "max_lsn": -1, "l0": [], "levels": {}})
        self.is_open = True
        Store.opened[self.path] += 1

    # Superblocks

    def _numbers(self) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(m[1]) for n in found if (m := re.fullmatch(r"superblock-(\d+)\.json", n)))

    def _put(self, number: int, block: dict) -> None:
        name = self._path(f"{self.path}/superblock-{number:08d}.json")
        draft = self._path(f"{self.path}/draft-{number:08d}-{time.time_ns()}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(block).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer changed store {self.name}")

    def superblock(self, number: int | None = None) -> dict:
        """The newest superblock (or an older one that vacuum has left)."""
        path = f"{self.path}/superblock-{number or self._numbers()[-1]:08d}.json"
        text = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(text)))
        finally:
            text.close()

    def flush_superblock(self, change: Callable[[dict], None] = lambda _: None) -> int:
        """Writes the next superblock, after a change of the newest one; returns its number."""
        number, block = self._numbers()[-1], self.superblock()
        change(block)
        self._put(number + 1, block)
        return number + 1

    def sync(self) -> int:
        """Every accepted write is durable already; writes a superblock that says so."""
        self._check()
        return self.flush_superblock()

    def _check(self, write: bool = False) -> None:
        if not self.is_open:
            raise ValueError("the store is closed")
        if write and self.options.replica_mode:
            raise PermissionError("DB is in replica mode, insert cannot proceed!")

    # Writing

    def _save(self, rows: DataFrame, folder: str, keys: int | None = None) -> None:
        bloom = str(self.options.enable_bloom_filters).lower()
        # A dictionary of the key would keep the filter from being written.
        writer = rows.select("key", F.col("lsn").cast("long").alias("lsn"), "op", "value").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", bloom)
        writer = writer.option("parquet.enable.dictionary#key", "false")
        if keys:
            writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(keys))
        writer.parquet(f"{self.path}/{folder}")

    def _measure(self, folder: str) -> dict:
        size = kv.kv_size(F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0)), F.col("op"))
        bad = kv.put_error(F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0)))
        bad = F.when(F.col("key").isNull(), "key is null").when(F.col("lsn").isNull(), "lsn is null").when(~F.col("op").isin("put", "delete") | F.col("op").isNull(), "unknown op").otherwise(bad)
        row = self._read([folder]).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.max("lsn").alias("lsn"), F.min(bad).alias("error")).first()
        return {"folder": folder, "rows": row["rows"], "bytes": row["bytes"] or 0, "lsn": row["lsn"], "error": row["error"]}

    def _read(self, folders: list[str]) -> DataFrame:
        schema = BINARY_SCHEMA if self.superblock()["binary"] else SCHEMA
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _append(self, ops: DataFrame) -> int:
        number = self.superblock()["next"]
        folder = f"batch-{number:08d}"
        self._save(ops, folder)
        made = self._measure(folder)
        if made.pop("error"):
            error = self._measure(folder)["error"]
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise ValueError(error)

        def change(block: dict) -> None:
            block["next"] = number + 1
            block["max_lsn"] = max(block["max_lsn"], -1 if made["lsn"] is None else made["lsn"])
            block["l0"].append({"number": number, **made})

        self.flush_superblock(change)
        self.callbacks.tell("segment_is_full", number)
        return number

    def write(self, ops: DataFrame, refuse: bool = True) -> int:
        """Appends operations (key, lsn, op, value) as one batch; returns its number.

        One invalid operation refuses the batch, with the reason as a ValueError; or (`refuse` off) such operations are left out
        and `refused` says how many were.
        """
        self._check(write=True)
        if not refuse:
            ops = order.reliable(ops)
            good = kv.put_error(F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0))).isNull() & F.col("key").isNotNull()
            self.refused = ops.filter(~good).count()
            ops = ops.filter(good)
        return self._append(ops)

    def put(self, rows: DataFrame) -> DataFrame:
        """Writes rows (key, value) with the next lsns in key order; returns key, lsn, class and log of each, and the error of those refused."""
        self._check(write=True)
        sizes = F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0))
        judged = order.reliable(rows.select("key", "value", kv.put_error(*sizes).alias("error")))
        placed = order.reliable(order.positions(judged.filter("error is null"), "key", "value"))
        lsn = (F.col("pos") + F.lit(self.superblock()["max_lsn"] + 1)).alias("lsn")
        self._append(placed.select("key", lsn, F.lit("put").alias("op"), "value"))
        kind = kv.size_class(*sizes)
        done = placed.select("key", lsn, kind.alias("class"), kv.log_of(kind).alias("log"), "error")
        failed = judged.filter("error is not null")
        return done.unionByName(failed.select("key", F.lit(None).cast("long").alias("lsn"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("log"), "error"))

    def put_serialized(self, rows: DataFrame, column: str = "data") -> DataFrame:
        """Writes pairs from their serialized form (see kv.serialized)."""
        return self.put(rows.select(*(c.cast("binary" if self.superblock()["binary"] else "string").alias(n) for n, c in zip(("key", "value"), kv.deserialized(F.col(column)), strict=True))))

    def delete(self, keys: DataFrame) -> int:
        """A tombstone for each key (column key) with the next lsns."""
        self._check(write=True)
        placed = order.positions(keys.select("key").distinct(), "key")
        kind = dict(keys.dtypes)["key"]
        return self._append(placed.select("key", (F.col("pos") + F.lit(self.superblock()["max_lsn"] + 1)).alias("lsn"), F.lit("delete").alias("op"), F.lit(None).cast(kind).alias("value")))

    def ingest_segment(self, ops: DataFrame) -> int:
        """A replica takes a log segment that its primary shipped."""
        self._check()
        if not self.options.replica_mode:
            raise PermissionError("Cannot flush in memory buffers to logs in primary mode")
        return self._append(ops)

    # Reading

    def _folders(self, block: dict) -> list[str]:
        return [b["folder"] for b in block["l0"]] + [run["folder"] for run in block["levels"].values()]

    def log(self, number: int | None = None) -> DataFrame:
        """All versions that are kept, as of the newest superblock or an older one."""
        self._check()
        return self._read(self._folders(self.superblock(number)))

    def state(self, upto: int | None = None) -> DataFrame:
        """Visible rows; as of a log sequence number on request (what compaction folded is no longer told apart)."""
        ops = self.log()
        return state.visible(ops if upto is None else ops.filter(F.col("lsn") <= upto))

    def get(self, key: str | bytes, buffer: int | None = None) -> tuple[str | bytes | None, str | None]:
        """(value, error); the filter on the key reaches the files."""
        row = state.get(self.log(), key).first()
        if row is None:
            return None, "key not found"
        value = row["value"]
        size = len(value.encode() if isinstance(value, str) else value or b"")
        return (None, "not enough buffer space") if buffer is not None and size > buffer else (value, None)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value, error of each asked key."""
        found = state.multi_get(keys, self.state())
        return found.select("key", "value", F.when(~F.col("found"), "key not found").alias("error"))

    def exists(self, key: str | bytes) -> bool:
        return not state.get(self.log(), key).isEmpty()

    def scan(self, n: int, mode: str = scan.FETCH_FIRST, key: str | bytes | None = None) -> DataFrame:
        """key, value and place of the first n visible rows from the position; no row means that the scanner is not valid."""
        return scan.scan(self.state(), n, mode, key).select("key", "value", "pos")

    # Compaction

    def levels(self) -> dict[int, int]:
        """Bytes on each level."""
        block = self.superblock()
        return {0: sum(b["bytes"] for b in block["l0"])} | {int(i): run["bytes"] for i, run in block["levels"].items()}

    def trigger(self) -> list[tuple[str, int, int]]:
        """Merges and moves until no level overflows; returns what was done as (merge or move, level, next level)."""
        self._check(write=not self.options.replica_build_index)
        done = []
        while step := compaction.next_step(self.levels(), self.options.level0_size, self.options.growth_factor, self.options.level_medium_inplace):
            self._compact(*step)
            done.append(step)
        return done

    def compact(self, partitions: int | None = None, drop_tombstones: bool = False) -> None:
        """Folds level 0 into level 1 whatever its size; with `drop_tombstones` all levels into the last, where no older put can lie."""
        self._check(write=not self.options.replica_build_index)
        block = self.superblock()
        if drop_tombstones:
            if self._folders(block):
                self._merge(self._folders(block), 0, kv.LEVELS - 1, partitions, last=True)
        elif block["l0"]:
            self._compact("merge", 0, 1, partitions)

    def _compact(self, action: str, source: int, target: int, partitions: int | None = None) -> None:
        block = self.superblock()
        if action == "move":
            self.callbacks.tell("swap_levels", source, target)

            def change(b: dict) -> None:
                b["levels"][str(target)] = b["levels"].pop(str(source))

            self.flush_superblock(change)
            return
        above = [b["folder"] for b in block["l0"]] if source == 0 else [block["levels"][str(source)]["folder"]]
        below = [block["levels"][str(target)]["folder"]] if str(target) in block["levels"] else []
        self._merge(above + below, source, target, partitions)

    def _merge(self, folders: list[str], source: int, target: int, partitions: int | None, last: bool = False) -> None:
        block, tell = self.superblock(), self.callbacks.tell
        if source == 0 and self.options.replica_build_index:
            tell("build_index_L0_compaction_started")
        tell("compaction_started", source, target)
        if source == 0:
            tell("spin_for_medium_log_flush", target)
        keys = compaction.estimate({int(i): run["rows"] for i, run in block["levels"].items()}, target, self.options.level0_size)
        rows = state.latest(self._read(folders))
        if last:
            rows = rows.filter("op = 'put'")
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"level-{target}-{self._numbers()[-1]:08d}"
        self._save(rows.repartitionByRange(n, "key").sortWithinPartitions("key"), folder, max(1, keys // n))
        tell("comp_write_cursor_flush_segment", folder, target)
        made = self._measure(folder)
        tell("comp_write_cursor_got_flush_replies", target)

        def change(b: dict) -> None:
            gone = set(folders)
            b["l0"] = [x for x in b["l0"] if x["folder"] not in gone]
            b["levels"] = {i: run for i, run in b["levels"].items() if run["folder"] not in gone} | {str(target): made}

        self.flush_superblock(change)
        tell("compaction_ended", source, folder)

    # Collection

    def gc(self, limit: int = GC_LIMIT) -> list[int]:
        """One round: rows of batches with dead versions that are their key's newest move to a new batch at the tail; returns those batches.

        The newest batch is never a victim. Nothing happens in replica mode.
        """
        self._check()
        batches = self.superblock()["l0"][:-1]
        if self.options.replica_mode or not batches:
            return []
        segment = F.regexp_extract(F.input_file_name(), r"/batch-(\d+)/", 1).cast("long")
        rows = order.reliable(merge.with_newest(self.log().withColumn("segment", segment)))
        dead = rows.filter(~F.col("newest")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
        known = {b["number"] for b in batches}
        victims = sorted(r["segment"] for r in dead.collect() if r["segment"] in known)[:limit]  # one row for each batch
        if victims:
            self._append(rows.filter(F.col("newest") & F.col("segment").isin(victims)).drop("segment", "newest"))

            def change(b: dict) -> None:
                b["l0"] = [x for x in b["l0"] if x["number"] not in victims]

            self.flush_superblock(change)
        return victims

    def gc_loop(self, rounds: int, interval: float | None = None) -> list[list[int]]:
        """Rounds of collection, `gc_interval` seconds apart, until the store is closed."""
        done = []
        for k in range(rounds):
            if not self.is_open:
                break
            if k:
                time.sleep(self.options.gc_interval if interval is None else interval)
            done.append(self.gc())
        return done

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes superblocks but the newest `keep`, and folders that none of those names; rows read from older ones end working."""
        self._check(write=not self.options.replica_mode)
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for f in self._folders(self.superblock(n))}
        gone = [f"superblock-{n:08d}.json" for n in numbers[:-keep]]
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        gone += [n for n in found if (re.match(r"(batch|level)-", n) and n not in named) or n.startswith("draft-")]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone

    def close(self) -> str | None:
        """Closes this handle; a second close is an error, and the answer says how many others are open."""
        if not self.is_open:
            raise ValueError("the store is closed")
        self.is_open = False
        Store.opened[self.path] -= 1
        left = Store.opened[self.path]
        return f"{self.name} is still open {left} times" if left else None


def format_volume(spark: SparkSession, base: str) -> None:
    """An empty base folder; what was in it goes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)


def main(args: list[str]) -> int:
    """python -m keystrata.sources.store FOLDER: formats a folder for stores."""
    if len(args) != 1:
        print("usage: python -m keystrata.sources.store FOLDER")
        return 2
    format_volume(SparkSession.builder.getOrCreate(), args[0])
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
