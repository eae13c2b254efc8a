"""Golden values and properties of the key-value model."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import kv
from keystrata.operators import compaction, merge, scan, state
from keystrata.sources import oplog
from keystrata.sources.store import Callbacks, Options, Store, format_volume, main


def test_size_classes(spark):
    want = {(5, 15): "SMALL", (5, 150): "MEDIUM", (5, 1500): "BIG", (1, 50): "MEDIUM", (1, 51): "BIG", (1, 5): "MEDIUM", (200, 824): "SMALL", (200, 825): "BIG"}
    rows = spark.createDataFrame([(*k, v) for k, v in want.items()], "k long, v long, want string")
    assert rows.filter(kv.size_class(F.col("k"), F.col("v")) != F.col("want")).count() == 0


def test_key_hash(spark):
    found = [int(r[0]) for r in spark.range(2).select(kv.fnv1a("id")).collect()]
    assert found == [12161962213042174405, 9929646806074584996]


def test_put_get_delete_scan_against_a_dict(spark, tmp_path):
    draw, model, ops = random.Random(4), {}, []
    for lsn in range(300):
        key = draw.choice("abcdefgh")
        if draw.random() < 0.3:
            model.pop(key, None)
            ops.append((key, lsn, "delete", None))
        else:
            model[key] = f"v{lsn}"
            ops.append((key, lsn, "put", f"v{lsn}"))
    store = Store(spark, str(tmp_path), "db")
    log = spark.createDataFrame(ops, "key string, lsn long, op string, value string")
    for lo, hi in ((150, 300), (0, 80), (80, 150)):
        store.write(log.filter(f"lsn >= {lo} and lsn < {hi}"))
        store.compact()
    again = Store(spark, str(tmp_path), "db", create=False)
    assert {r["key"]: r["value"] for r in again.state().collect()} == model
    rows = scan.scan(again.state(), 3, scan.GREATER, sorted(model)[0]).orderBy("pos").collect()
    assert [r["key"] for r in rows] == sorted(model)[1:4]


def test_two_key_regression(spark):
    ops = spark.createDataFrame([("/", 0, "put", "16895|0|"), ("Example", 1, "put", "Content"), ("Example", 2, "delete", None)], "key string, lsn long, op string, value string")
    assert state.get(ops, "Example").count() == 0 and [r["key"] for r in scan.scan(state.visible(ops), 9).collect()] == ["/"]


def test_packing_pads_segments(spark):
    rows = merge.pack(spark.createDataFrame([("x", 0, 60), ("x", 1, 50), ("x", 2, 30), ("y", 3, 100)], "log string, lsn long, size long"), 100)
    assert [r["offset"] for r in rows.orderBy("lsn").collect()] == [0, 100, 150, 0]


def test_options_and_modes(spark, tmp_path):
    assert Options.parse("level0_size: 64 # MB\ngrowth_factor: 8").growth_factor == 8
    for bad in ({"replica_mode": True}, {"replica_build_index": True, "replica_send_index": True}, {"level0_size": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path), "r", options=Options(primary_mode=False, replica_mode=True)).write(spark.createDataFrame([], "key string, lsn long, op string, value string"))
    with pytest.raises(ValueError):
        scan.seek(spark.range(1), "sideways", "k")


def test_trace(spark):
    lines = spark.createDataFrame([(0, "PUT 3 AA1 10 aaaaaaaaaa"), (1, "GET 3 AA1"), (2, "GET 9 AA2")], "line_no long, line string")
    ops = oplog.trace_ops(lines)
    assert [r["line_no"] for r in oplog.trace_errors(ops).collect()] == [2]


OPTIONS = """level0_size: 1
gc_interval: 10
growth_factor: 4
medium_log_LRU_cache_size: 400
level_medium_inplace: 3
primary_mode: 1
replica_mode: 0
replica_build_index: 0
replica_send_index: 0
enable_bloom_filters: 1
enable_compaction_double_buffering: 1
number_of_replicas: 1
"""


def rows(spark, *ops):
    return spark.createDataFrame(list(ops), "key string, lsn long, op string, value string")


def test_options_file(spark, tmp_path):
    (tmp_path / "options.yml").write_text(OPTIONS)
    assert Options.read(spark, str(tmp_path / "options.yml")) == Options()
    assert Options.parse("level0_size: 64").level0_size == 64 << 20 and Options().medium_log_LRU_cache_size == 400 << 20
    with pytest.raises(KeyError):
        Options.parse("level0_size: 64", whole=True)
    with pytest.raises(ValueError):
        Options.parse("level_zero: 1")


def test_invalid_puts_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path), "db")
    good = ("a", 0, "put", "1")
    for bad in (("", 1, "put", "x"), ("k" * 256, 1, "put", "x"), ("k", 1, "put", "v" * 16_384), (None, 1, "put", "x"), ("k", None, "put", "x"), ("k", 1, "padding", "x")):
        with pytest.raises(ValueError):
            store.write(rows(spark, good, bad))
    assert store.log().count() == 0
    store.write(rows(spark, good, ("", 1, "put", "x"), ("k" * 256, 1, "put", "x")), refuse=False)
    assert store.refused == 2 and [r["key"] for r in store.state().collect()] == ["a"]
    told = store.put(spark.createDataFrame([("b", "2"), ("", "3"), ("c", "v" * 2000)], "key string, value string")).orderBy("key").collect()
    assert [(r["key"], r["lsn"], r["class"], r["log"], r["error"]) for r in told] == [("", None, None, None, "key size is zero"), ("b", 1, "SMALL", "L0_RECOVERY", None), ("c", 2, "BIG", "BIG", None)]
    assert store.get("b") == ("2", None) and store.get("x") == (None, "key not found") and store.get("c", 100) == (None, "not enough buffer space")
    assert store.exists("b") and not store.exists("x")
    store.delete(spark.createDataFrame([("b",), ("nothing",)], "key string"))
    assert not store.exists("b") and {r["key"]: r["error"] for r in store.multi_get(spark.createDataFrame([("a",), ("b",)], "key string")).collect()} == {"a": None, "b": "key not found"}
    assert [(r["key"], r["pos"]) for r in store.scan(5, scan.GREATER, "a").collect()] == [("c", 1)] and store.scan(5, scan.GREATER, "c").count() == 0


def test_binary_keys(spark, tmp_path):
    draw = random.Random(6)
    pairs = {bytes(draw.choices(range(256), k=draw.randint(1, 20))): bytes(draw.choices(range(256), k=5)) for _ in range(200)} | {b"\x00": b"first", b"\xff" * 255: b"last"}
    store = Store(spark, str(tmp_path), "db", binary=True)
    store.put(spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs.items()], "key binary, value binary"))
    store.trigger()
    again = Store(spark, str(tmp_path), "db", create=False)
    assert [bytes(r["key"]) for r in again.scan(1000, scan.GREATER_OR_EQUAL, kv.SMALLEST_KEY).orderBy("pos").collect()] == sorted(pairs)
    assert all(bytes(again.get(k)[0]) == v for k, v in list(pairs.items())[:5])
    packed = spark.createDataFrame([(bytearray(b"abcdabcda\x00"), bytearray(b"a\x00"))], "k binary, v binary")
    again.put_serialized(packed.select(kv.serialized(F.col("k"), F.col("v"), F.lit("SMALL")).alias("data")))
    assert bytes(again.get(b"abcdabcda\x00")[0]) == b"a\x00"


def test_rows_read_before_compaction_stay_and_vacuum_ends_them(spark, tmp_path):
    store = Store(spark, str(tmp_path), "db")
    store.write(rows(spark, ("a", 0, "put", "1"), ("b", 1, "put", "2")))
    before, number = store.state(), store.sync()
    store.write(rows(spark, ("a", 2, "delete", None)))
    store.compact()
    assert {r["key"] for r in before.collect()} == {"a", "b"} and {r["key"] for r in store.log(number).collect()} == {"a", "b"}
    gone = store.vacuum()
    assert any(n.startswith("batch-") for n in gone) and [r["key"] for r in store.state().collect()] == ["b"]
    other = Store(spark, str(tmp_path), "db", create=False)
    assert store.close() == "db is still open 1 times" and other.close() is None
    with pytest.raises(ValueError):
        other.close()
    with pytest.raises(ValueError):
        store.state()


def test_levels_merge_and_move_and_tell(spark, tmp_path):
    told = []
    hooks = Callbacks(**{n: (lambda *a, n=n: told.append((n, *a))) for n in ("segment_is_full", "compaction_started", "swap_levels", "spin_for_medium_log_flush")})
    store = Store(spark, str(tmp_path), "db", options=Options(level0_size=100, growth_factor=2), callbacks=hooks)
    done, model = [], {}
    for b in range(6):
        store.write(rows(spark, *((f"k{b}{i}", b * 100 + i, "put", "v" * 20) for i in range(10))))
        model |= {f"k{b}{i}": "v" * 20 for i in range(10)}
        done += store.trigger()
    assert ("merge", 0, 1) in done and ("move", 1, 2) in done and ("merge", 2, 3) in done and ("swap_levels", 1, 2) in told
    assert told.count(("spin_for_medium_log_flush", 1)) == done.count(("merge", 0, 1)) and ("compaction_started", 2, 3) in told
    assert {r["key"]: r["value"] for r in store.state().collect()} == model
    sizes = store.levels()
    assert compaction.next_step(sizes, 100, 2) is None
    frame = spark.createDataFrame([(i, sizes.get(i, 0)) for i in range(8)], "level long, bytes long")
    assert compaction.dispatch(frame, 100, 2).filter("action is not null").count() == 0
    assert compaction.next_step({0: 100}, 100, 2) == ("merge", 0, 1) and compaction.next_step({0: 100, 1: 200}, 100, 2) == ("move", 1, 2)
    assert compaction.next_step({0: 100, 1: 200, 2: 400}, 100, 2) == ("merge", 2, 3) and compaction.estimate({}, 1, 1 << 20) == 31775 and compaction.estimate({1: 5, 2: 7}, 2, 9) == 12
    # The files of a level hold disjoint ranges of keys and a Bloom filter of them.
    import pyarrow.parquet as pq

    run = store.superblock()["levels"]["3"]["folder"]
    spans = sorted((s.min, s.max) for f in (tmp_path / "db" / run).glob("*.parquet") if (m := pq.ParquetFile(f).metadata).num_rows for s in [m.row_group(0).column(0).statistics])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_collection_of_updated_halves(spark, tmp_path):
    store = Store(spark, str(tmp_path), "db")
    store.write(rows(spark, *((f"ts{i}", i, "put", f"{i}") for i in range(100))))
    store.write(rows(spark, *((f"ts{i}", 100 + i, "put", f"new{i}") for i in range(0, 100, 2))))
    before = {r["key"]: r["value"] for r in store.state().collect()}
    assert store.gc_loop(2, 0) == [[1], []]
    assert {r["key"]: r["value"] for r in store.state().collect()} == before and store.log().count() == 100
    replica = Store(spark, str(tmp_path), "r", options=Options(primary_mode=False, replica_mode=True))
    for b in range(2):
        replica.ingest_segment(rows(spark, ("a", b, "put", "x")))
    assert replica.gc() == [] and replica.log().count() == 2
    with pytest.raises(PermissionError):
        store.ingest_segment(rows(spark))
    with pytest.raises(PermissionError):
        replica.trigger()


def test_format(spark, tmp_path, capsys):
    (tmp_path / "volume").mkdir()
    (tmp_path / "volume" / "old").write_text("x")
    assert main([str(tmp_path / "volume")]) == 0 and list((tmp_path / "volume").iterdir()) == []
    assert main([]) == 2 and "usage" in capsys.readouterr().out
    format_volume(spark, str(tmp_path / "volume"))
