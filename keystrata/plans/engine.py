"""Queries of levels, collection, logs, replicas and workloads beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions import kv, order
from keystrata.operators import compaction, merge, scan, state
from keystrata.plans import workload
from keystrata.plans.catalog import (
    CLASS, E, FNV_SQL, LAT, ORDER_KEY, P, POINTS_SQL, RUNS, SEGMENTS, SIZED, V, VERSIONS,
    events, latencies, orders, packing_sql, query, runs, segments, sized, transactions_sql, urls, _shared_folder,
)
from keystrata.sources import oplog
from keystrata.sources.store import Options, Store

LEVELS = RUNS + """, s AS (SELECT level, CAST(sum(7 + coalesce(octet_length(encode(value)), 0) + 8) AS BIGINT) AS bytes, count(*) AS n_keys FROM runs GROUP BY level),
 l AS (SELECT i AS level, coalesce(bytes, 0) AS bytes, coalesce(n_keys, 0) AS n_keys, CASE WHEN i < 7 THEN 256 * 4 ** i END AS cap FROM range(0, 8) AS x(i) LEFT JOIN s ON s.level = i)"""


def levels(spark, sf) -> DataFrame:
    size = 7 + F.coalesce(F.octet_length("value"), F.lit(0)) + 8
    found = merge.level_sizes(runs(spark, sf), size)
    return spark.range(8).withColumnRenamed("id", "level").join(found, "level", "left").na.fill(0, ["bytes", "n_keys"])


@query(f"""WITH {LEVELS}, n AS (SELECT *, lead(bytes) OVER (ORDER BY level) AS below, lead(cap) OVER (ORDER BY level) AS room FROM l)
SELECT level, CASE WHEN bytes >= cap AND (room IS NULL OR below < room) THEN CASE WHEN level > 0 AND level + 1 <> 3 AND below = 0 THEN 'move' ELSE 'merge' END END AS action FROM n""")
def compaction_dispatch(spark, sf):
    return compaction.dispatch(levels(spark, sf), 256, 4)


@query(f"WITH {LEVELS} SELECT level, CAST(CASE WHEN level = 1 AND n_keys = 0 THEN 1048576 // 33 ELSE n_keys END + CASE WHEN level > 1 THEN lag(n_keys) OVER (ORDER BY level) ELSE 0 END AS BIGINT) AS keys FROM l QUALIFY level > 0")
def estimated_keys(spark, sf):
    return compaction.estimated_keys(levels(spark, sf), 1 << 20)


@query(f"WITH {RUNS} SELECT key, CASE WHEN level = 2 THEN 3 ELSE level END AS level, epoch FROM runs")
def level_move(spark, sf):
    return compaction.move(runs(spark, sf), 2).select("key", "level", "epoch")


def batches(spark, sf):
    ops = events(spark, sf)
    top = ops.agg(F.max("lsn").alias("m"))  # one row
    return ops.join(F.broadcast(top), F.lit(True)).withColumn("b", F.expr("lsn * 4 div (m + 1)")).drop("m")


@query(f"WITH {V} SELECT * FROM visible")
def store_levels(spark, sf):
    """Four batches with the compaction trigger after each: merges into level 1 and on, moves into empty levels."""
    store = Store(spark, _shared_folder(spark), "db", options=Options(level0_size=1024, growth_factor=2))
    ops = order.reliable(batches(spark, sf))
    for b in range(4):
        store.write(ops.filter(F.col("b") == b))
        store.trigger()
    return store.state().select("key", "lsn", "value")


BATCHED = E + """, m AS (SELECT max(lsn) AS m FROM e), q AS (SELECT e.*, lsn * 4 // (m.m + 1) AS b, lsn = max(lsn) OVER (PARTITION BY key) AS newest FROM e, m)"""


@query(f"WITH {BATCHED} SELECT key, lsn, op FROM q WHERE newest OR b = 3")
def store_gc(spark, sf):
    """What a log of four batches holds after a round of collection: every newest version, and all of the tail batch."""
    store = Store(spark, _shared_folder(spark), "db")
    ops = order.reliable(batches(spark, sf))
    for b in range(4):
        store.write(ops.filter(F.col("b") == b))
    store.gc()
    return store.log().select("key", "lsn", "op")


@query(f"""WITH {BATCHED}, n AS (SELECT *, row_number() OVER (ORDER BY key) AS i FROM q WHERE newest AND op = 'put' AND CAST(substr(key, 2) AS BIGINT) % 3 = 0)
SELECT key, CAST(NULL AS VARCHAR) AS value, 'key not found' AS error FROM n UNION ALL SELECT key, value, NULL FROM q WHERE newest AND op = 'put' AND CAST(substr(key, 2) AS BIGINT) % 3 <> 0""")
def store_delete(spark, sf):
    """Keys deleted in a store, then asked for with all others."""
    store = Store(spark, _shared_folder(spark), "db")
    store.write(events(spark, sf))
    asked = order.reliable(store.state().select("key"))
    store.delete(asked.filter(F.substring("key", 2, 6).cast("long") % 3 == 0))
    return store.multi_get(asked)


@query(f"""WITH {V}, r AS (SELECT *, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM visible), m AS (SELECT max(lsn) AS m FROM e)
SELECT key, m + 1 + pos AS lsn, value FROM r, m""")
def store_put(spark, sf):
    """Visible pairs put again: each gets the next lsn in key order."""
    store = Store(spark, _shared_folder(spark), "db")
    store.write(events(spark, sf))
    store.put(order.reliable(store.state().select("key", "value")))
    return store.state().select("key", "lsn", "value")


@query(f"WITH {V} SELECT * FROM visible")
def store_snapshot(spark, sf):
    """Rows read before deletes, compaction and collection stay what they were."""
    store = Store(spark, _shared_folder(spark), "db")
    store.write(events(spark, sf))
    before = store.state()
    store.delete(before.select("key"))
    store.compact(drop_tombstones=True)
    store.gc()
    return before.select("key", "lsn", "value")


@query(f"WITH {V} SELECT * FROM visible")
def replica_state(spark, sf):
    """A replica that got its primary's log in four segments shows the same rows."""
    store = Store(spark, _shared_folder(spark), "db", options=Options(primary_mode=False, replica_mode=True, replica_build_index=True))
    ops = order.reliable(batches(spark, sf))
    for b in (1, 0, 3, 2):
        store.ingest_segment(ops.filter(F.col("b") == b))
    store.compact()
    return store.state().select("key", "lsn", "value")


@query(f"""WITH {VERSIONS}, {SEGMENTS}, picked AS (SELECT segment FROM g WHERE garbage_bytes > 0 AND segment < (SELECT max(segment) FROM g))
SELECT key, lsn AS old_lsn, (SELECT max(lsn) FROM seg) + row_number() OVER (ORDER BY lsn) AS lsn FROM seg WHERE live AND segment IN (SELECT segment FROM picked)""")
def gc_relocate(spark, sf):
    placed = order.reliable(segments(spark, sf))
    return merge.relocate(placed, order.reliable(merge.victims(order.reliable(merge.garbage(placed)))))


@query("""SELECT user_id AS segment, CAST(sum(octet_length(encode(coalesce(props, '')))) AS BIGINT) AS garbage_bytes FROM events WHERE event_type NOT IN ('error', 'click') GROUP BY user_id""")
def garbage_recovery(spark, sf):
    op = F.when(F.col("event_type") == "error", "free").when(F.col("event_type") == "click", "alloc").otherwise("garbage")
    log = oplog.read(spark, sf, "events").select(F.col("user_id").alias("segment"), op.alias("op"), F.octet_length(F.coalesce("props", F.lit(""))).alias("garbage_bytes"))
    return merge.recovered_garbage(log)


DOCS = f"""docs AS (SELECT coalesce(source, 'none') AS key, doc_id AS lsn, octet_length(encode(coalesce(source, 'none'))) AS key_size, octet_length(encode(coalesce(text, ''))) AS value_size FROM documents),
 kinds AS (SELECT *, {CLASS} AS class, CAST(key_size + value_size + 16 AS BIGINT) AS size FROM docs)"""


def document_log(spark, sf):
    """Documents as versions of their source's key."""
    key = F.coalesce("source", F.lit("none"))
    rows = oplog.read(spark, sf, "documents").select(
        key.alias("key"), F.col("doc_id").alias("lsn"), F.octet_length(key).alias("key_size"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("value_size")
    )
    kind = kv.size_class(F.col("key_size"), F.col("value_size"))
    return rows.withColumns({"class": kind, "size": kv.log_footprint(F.col("key_size"), F.col("value_size"))})


@query(f"""WITH {DOCS}, b AS (SELECT key, lsn, size, CAST(sum(size) OVER (ORDER BY lsn) AS BIGINT) - size AS off FROM kinds WHERE class = 'BIG'),
 t AS (SELECT key, max(lsn) AS top FROM docs GROUP BY key)
SELECT off - off % 65536 AS segment, CAST(sum(size) AS BIGINT) AS garbage_bytes FROM b JOIN t USING (key) WHERE lsn < top GROUP BY 1""")
def big_garbage(spark, sf):
    rows = order.reliable(merge.with_newest(document_log(spark, sf)))
    placed = workload.running_offsets(rows.filter("class = 'BIG'"))
    return merge.big_garbage(placed.withColumn("segment", kv.segment_of(F.col("offset"), 65_536)))


@query(f"""WITH RECURSIVE {DOCS}, x AS (SELECT CASE WHEN class = 'BIG' THEN 'BIG' ELSE 'L0_RECOVERY' END AS log, lsn, size FROM kinds WHERE key_size + value_size + 8 <= 16384), {packing_sql('x', 65_536)},
 q AS (SELECT *, off // 65536 AS seg, lag(off + size) OVER (PARTITION BY log ORDER BY lsn) AS ended, lag(off // 65536) OVER (PARTITION BY log ORDER BY lsn) AS was FROM p)
SELECT log, lsn, size, off AS "offset", CASE WHEN seg > was THEN CAST(was * 65536 AS BIGINT) END AS flushed, CASE WHEN seg > was THEN CAST(seg * 65536 - ended AS BIGINT) END AS padding FROM q""")
def put_metadata(spark, sf):
    """Where each accepted put lands in its log, the segment that it completes, and the padding left in that."""
    rows = document_log(spark, sf).filter(kv.put_error(F.col("key_size"), F.col("value_size")).isNull())
    packed = merge.pack(rows.select(kv.log_of(F.col("class")).alias("log"), "lsn", "size"), 65_536)
    return merge.with_events(order.reliable(packed), 65_536)


@query(f"WITH {SIZED} SELECT source, key, 'MEDIUM_INLOG' AS category, 9223372036854775807 AS lsn FROM classed WHERE class = 'MEDIUM' AND source <> 'lineitem'")
def medium_log_appends(spark, sf):
    """Medium values that a merge into level 1 appends to their log, all with the greatest lsn."""
    rows = sized(spark, sf).filter("source <> 'lineitem'").withColumn("category", kv.placement(F.col("class"), F.lit(1)))
    return rows.filter("category = 'MEDIUM_INLOG'").select("source", "key", "category", F.lit(kv.MAX_LSN).cast("long").alias("lsn"))


LINES = "k AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS key, l_orderkey FROM lineitem)"


@query(f"""WITH {LINES}, o AS (SELECT l_orderkey, (row_number() OVER (ORDER BY key) - 1) * 32 AS off FROM k), s AS (SELECT l_orderkey, off - off % 65536 AS segment FROM o)
SELECT DISTINCT segment FROM s WHERE segment < (SELECT max(segment) FROM s WHERE l_orderkey * 2 <= (SELECT max(l_orderkey) FROM lineitem))""")
def medium_log_trim(spark, sf):
    """Segments of a medium log in key order that can go once the lower half of the keys is back in place."""
    lines = oplog.read(spark, sf, "lineitem").select(oplog.line_key().alias("key"), "l_orderkey")
    placed = order.positions(lines, "key").withColumn("segment", kv.segment_of(F.col("pos") * 32, 65_536))
    top = lines.agg(F.max("l_orderkey").alias("top"))  # one row
    held = order.reliable(placed.join(F.broadcast(top), F.lit(True)))
    last = held.filter(F.col("l_orderkey") * 2 <= F.col("top")).agg(F.max("segment").alias("last"))  # one row
    return compaction.trimmed(held.select("segment").distinct().join(F.broadcast(last), F.lit(True)), F.col("last")).select("segment")


@query(f"WITH {P} SELECT hex(encode(key)) AS key, row_number() OVER (ORDER BY encode(key)) AS pos FROM p ORDER BY encode(key) LIMIT 100")
def scan_binary(spark, sf):
    """Keys as bytes, scanned from the smallest key there can be."""
    keys = urls(spark, sf).select(F.col("key").cast("binary").alias("key"))
    return scan.scan(keys, 100, scan.GREATER_OR_EQUAL, kv.SMALLEST_KEY).select(F.hex("key").alias("key"), "pos")


@query(f"""WITH {P}, s AS (SELECT DISTINCT substr(key, 1, 14) || 'm' AS start FROM p UNION ALL SELECT 'zzz'),
 f AS (SELECT start, (SELECT min(key) FROM p WHERE key >= start) AS key FROM s) SELECT start, key IS NOT NULL AS is_valid, key, md5(key) AS value FROM f""")
def scanner_positions(spark, sf):
    keys = order.reliable(urls(spark, sf)).withColumn("value", F.md5(F.col("key").cast("binary")))
    starts = keys.select(F.concat(F.substring("key", 1, 14), F.lit("m")).alias("start")).distinct()
    return scan.positions(keys, starts.unionByName(spark.createDataFrame([("zzz",)], "start string")))


@query(f"""WITH k AS (SELECT {ORDER_KEY} AS key, o_orderpriority AS value FROM orders)
SELECT key, value, '00000C00' || printf('%02X', length(value)) || '000000' || hex(encode(key)) || hex(encode(value)) AS data FROM k""")
def put_serialized(spark, sf):
    """Pairs packed into their serialized form and read out of it again."""
    rows = orders(spark, sf).select(oplog.order_key().alias("k"), F.col("o_orderpriority").alias("v"))
    kind = kv.size_class(F.octet_length("k"), F.octet_length("v"))
    packed = rows.select(kv.serialized(F.col("k"), F.col("v"), kind).alias("data"))
    key, value = kv.deserialized(F.col("data"))
    return packed.select(key.cast("string").alias("key"), value.cast("string").alias("value"), F.hex("data").alias("data"))


@query(f"""WITH o AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'put' WHEN 1 THEN 'delete' WHEN 2 THEN 'padding' ELSE 'other' END AS op, 12 AS key_size, length(o_orderpriority) * (o_orderkey % 3) AS value_size FROM orders),
 c AS (SELECT CASE WHEN op = 'put' THEN {CLASS} WHEN op = 'delete' THEN 'SMALL' ELSE 'BIG' END AS class, CASE WHEN op NOT IN ('put', 'delete') THEN 'unknown operation' END AS error FROM o)
SELECT class, error, count(*) AS n FROM c GROUP BY ALL""")
def kv_category_errors(spark, sf):
    i = F.col("o_orderkey") % 4
    op = F.when(i == 0, "put").when(i == 1, "delete").when(i == 2, "padding").otherwise("other")
    kind, error = kv.kv_category(F.lit(12), F.length("o_orderpriority") * (F.col("o_orderkey") % 3), op)
    return orders(spark, sf).groupBy(kind.alias("class"), error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


LOADED = f"loaded AS (SELECT {FNV_SQL} AS key FROM range(0, 5000) AS x(id))"


@query(transactions_sql(20_000, 6000, "a") + f""", {LOADED}, a AS (SELECT i, op, {FNV_SQL.replace('id', 'record')} AS key FROM requests)
SELECT op, count(*) AS n, count(*) FILTER (key IN (SELECT key FROM loaded)) AS found, count(DISTINCT key) AS keys FROM a GROUP BY op""")
def ycsb_replies(spark, sf):
    """Requests on 6000 records of which 5000 were loaded."""
    replies, _ = workload.run(workload.transactions(spark, 20_000, 6000, "a"), workload.load_phase(spark, 5000))
    return replies.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("found"), 1)).alias("found"), F.countDistinct("key").alias("keys"))


@query(transactions_sql(20_000, 6000, "a") + f""", {LOADED}, a AS (SELECT {FNV_SQL.replace('id', 'record')} AS key, 5000 + i AS lsn FROM requests WHERE op = 'update'),
 x AS (SELECT key, lsn FROM a UNION ALL SELECT {FNV_SQL}, id FROM range(0, 5000) AS x(id)) SELECT key, max(lsn) AS lsn FROM x GROUP BY key""")
def ycsb_state(spark, sf):
    """The newest version of each record after the load and all updates."""
    _, log = workload.run(workload.transactions(spark, 20_000, 6000, "a"), workload.load_phase(spark, 5000))
    return state.latest(log).select("key", "lsn")


@query(f"WITH {LAT} SELECT op, count(*) FILTER (usec >= 60) AS missing FROM lat GROUP BY op")
def latency_missing(spark, sf):
    return workload.missing(latencies(spark, sf), 60)


@query(f"""WITH {LAT}, h AS (SELECT op, thread, usec, count(*) AS n FROM lat WHERE usec >= 0 AND usec < 100000 GROUP BY ALL),
 c AS (SELECT *, sum(n) OVER (PARTITION BY op, thread ORDER BY usec) AS upto, sum(n) OVER (PARTITION BY op, thread) AS total FROM h),
 o AS (SELECT op, thread, sum(n) AS samples, min(usec) AS min_usec, max(usec) AS max_usec, sum(usec * n) // sum(n) AS avg_usec, {POINTS_SQL} FROM c GROUP BY op, thread)
SELECT op, CAST(sum(samples) AS BIGINT) AS samples, {', '.join(f'CAST(sum({c}) // count(*) AS BIGINT) AS {c}' for c in ('min_usec', 'max_usec', 'avg_usec', 'p50', 'p70', 'p90', 'p99', 'p99_9', 'p99_99'))} FROM o GROUP BY op""")
def thread_percentiles(spark, sf):
    return workload.mean_of_percentiles(latencies(spark, sf))


@query("""SELECT CAST(sum(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey * 90000 ELSE -s_suppkey * 70000 END) * 512 // 1048576 AS BIGINT) AS read_mb,
 CAST(sum(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey * 50000 ELSE -s_suppkey * 10000 END) * 512 // 1048576 AS BIGINT) AS written_mb FROM supplier""")
def io_volume(spark, sf):
    """Readings of sector counters, made of suppliers: odd ones after, even ones before."""
    i, after = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 1
    rows = oplog.read(spark, sf, "supplier").select(
        F.when(after, "after").otherwise("before").alias("phase"), (i * F.when(after, 90_000).otherwise(70_000)).alias("sectors_read"), (i * F.when(after, 50_000).otherwise(10_000)).alias("sectors_written")
    )
    return workload.io_volume(rows)


@query("""SELECT round(100 - avg(p_size), 6) AS cpu_percent, round((100 - avg(p_size)) / 100 * 76800000000 / 50000.0::DOUBLE, 4) AS cycles_per_op,
 round((100 - avg(p_size) - avg(p_partkey % 5)) / 100 * 76800000000 / 50000.0::DOUBLE, 4) AS cycles_without_iowait FROM part""")
def cpu_cycles(spark, sf):
    rows = oplog.read(spark, sf, "part").select(F.col("p_size").alias("idle"), (F.col("p_partkey") % 5).alias("iowait"))
    return workload.cycles(rows, 50_000.0)
