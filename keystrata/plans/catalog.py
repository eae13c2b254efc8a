"""Every query of the engine beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import kv, order
from keystrata.operators import merge, scan, state
from keystrata.plans import workload
from keystrata.sources import oplog
from keystrata.sources.store import SCHEMA, Store
from keystrata.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parts of SQL that several queries share.
E = """e AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id AS lsn,
 CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
 CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '|' || coalesce(props, '') END AS value FROM events)"""
V = E + """, newest AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1),
 visible AS (SELECT key, lsn, value FROM newest WHERE op = 'put')"""
ORDER_KEY = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"
P = "p AS (SELECT DISTINCT url AS key FROM pages WHERE url IS NOT NULL)"
BYTES = "octet_length(encode(coalesce({}, '')))"
RATIO = "least(key_size, value_size)::DOUBLE / nullif(greatest(key_size, value_size), 0)::DOUBLE"
CLASS = f"CASE WHEN key_size + value_size > 1024 OR {RATIO} < 0.02 THEN 'BIG' WHEN {RATIO} <= 0.2 THEN 'MEDIUM' ELSE 'SMALL' END"
SIZED = f"""sized AS (
 SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, length(CAST(doc_id AS VARCHAR)) AS key_size, {BYTES.format('text')} AS value_size FROM documents
 UNION ALL SELECT 'pages', coalesce(url, ''), {BYTES.format('url')}, {BYTES.format('html')} FROM pages
 UNION ALL SELECT 'lineitem', lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), 14, octet_length(encode(l_returnflag || l_linestatus)) FROM lineitem),
 classed AS (SELECT *, {CLASS} AS class FROM sized)"""
# Versions of events with sizes, a running offset by lsn, and the segment of 64 KiB that the entry starts in.
VERSIONS = E + """, v AS (SELECT key, lsn, op, 7 + coalesce(octet_length(encode(value)), 0) + 8 AS size FROM e),
 w AS (SELECT *, sum(size) OVER (ORDER BY lsn) - size AS off, lsn = max(lsn) OVER (PARTITION BY key) AND op = 'put' AS live FROM v),
 seg AS (SELECT *, CAST(off - off % 65536 AS BIGINT) AS segment FROM w)"""
RUNS = E + """, top AS (SELECT max(lsn) AS m FROM e),
 r AS (SELECT key, lsn, op, value, CAST(least(3, (m - lsn) * 4 // (m + 1)) AS BIGINT) AS age FROM e, top),
 runs AS (SELECT key, lsn, op, value, CASE WHEN age = 0 THEN 0 ELSE age - 1 END AS level, 3 - age AS epoch FROM r
  QUALIFY row_number() OVER (PARTITION BY age, key ORDER BY lsn DESC) = 1)"""
TRACE = f"""t AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 0 THEN 'GET ' || CAST(12 AS VARCHAR) || ' ' || {ORDER_KEY}
 ELSE 'PUT ' || CAST(CASE WHEN o_orderkey % 7 = 0 THEN 11 ELSE 12 END AS VARCHAR) || ' ' || {ORDER_KEY} || ' ' || CAST(length(o_orderpriority) AS VARCHAR) || ' ' || o_orderpriority END AS line FROM orders),
 ops AS (SELECT line_no, CASE WHEN split_part(line, ' ', 1) = 'PUT' THEN 'put' ELSE 'get' END AS op, CAST(split_part(line, ' ', 2) AS BIGINT) AS key_size, split_part(line, ' ', 3) AS key,
 CASE WHEN line LIKE 'PUT%' THEN CAST(split_part(line, ' ', 4) AS BIGINT) END AS value_size,
 CASE WHEN line LIKE 'PUT%' THEN substr(line, length(split_part(line, ' ', 1) || split_part(line, ' ', 2) || split_part(line, ' ', 3) || split_part(line, ' ', 4)) + 5) END AS value FROM t)"""
LAT = "lat AS (SELECT user_id % 4 AS thread, event_type AS op, CAST(floor(value) AS BIGINT) AS usec FROM events WHERE value IS NOT NULL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark, sf):
    return oplog.of_events(oplog.read(spark, sf, "events"))


def orders(spark, sf):
    return oplog.read(spark, sf, "orders")


def urls(spark, sf):
    return oplog.read(spark, sf, "pages").select(F.col("url").alias("key")).filter("key is not null").distinct()


def sized(spark, sf):
    lines = oplog.read(spark, sf, "lineitem").select(oplog.line_key().alias("k"), F.concat("l_returnflag", "l_linestatus").alias("v"))
    pages = oplog.read(spark, sf, "pages").withColumn("url", F.coalesce("url", F.lit("")))
    parts = {"documents": (oplog.read(spark, sf, "documents"), "doc_id", "text"), "pages": (pages, "url", "html"), "lineitem": (lines, "k", "v")}
    out = None
    for name, (table, key, value) in parts.items():
        part = oplog.sized(table, key, value).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("class", kv.size_class(F.col("key_size"), F.col("value_size")))


@query(f"""WITH k AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS key, * FROM lineitem)
SELECT key, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM k
QUALIFY row_number() OVER (PARTITION BY key ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC) = 1""")
def upsert_latest(spark, sf):
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    lines = oplog.read(spark, sf, "lineitem").select(oplog.line_key().alias("key"), *rest)
    top = Window.partitionBy("key").orderBy(*(F.desc(c) for c in rest))
    return lines.withColumn("_rank", F.row_number().over(top)).filter("_rank = 1").drop("_rank")


@query(f"WITH {V} SELECT * FROM visible")
def visible_state(spark, sf):
    return state.visible(events(spark, sf)).select("key", "lsn", "value")


@query(f"WITH {V} SELECT key, lsn FROM newest WHERE op = 'delete'")
def tombstoned_keys(spark, sf):
    return state.tombstoned(events(spark, sf))


@query(f"WITH {V} SELECT * FROM visible WHERE key = 'u000007'")
def get_point(spark, sf):
    return state.get(events(spark, sf), "u000007").select("key", "lsn", "value")


#: Asked keys grow with the tables: customers of orders, most of whom are no users.
PROBES = "probes AS (SELECT DISTINCT 'u' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS key FROM orders)"


def probes(spark, sf):
    return orders(spark, sf).select(F.concat(F.lit("u"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("key")).distinct()


@query(f"WITH {V}, {PROBES} SELECT key, value, visible.lsn IS NOT NULL AS found FROM probes LEFT JOIN visible USING (key)")
def multi_get(spark, sf):
    return state.multi_get(probes(spark, sf), state.visible(events(spark, sf))).select("key", "value", "found")


@query(f"WITH {V}, {PROBES} SELECT key FROM probes WHERE key IN (SELECT key FROM visible)")
def exists_keys(spark, sf):
    return state.exists(probes(spark, sf), state.visible(events(spark, sf)))


@query(f"WITH {V}, {PROBES} SELECT key FROM probes WHERE key NOT IN (SELECT key FROM visible)")
def missing_keys(spark, sf):
    return state.missing(probes(spark, sf), state.visible(events(spark, sf)))


@query(f"WITH {V} SELECT * FROM visible WHERE CAST(substr(key, 2) AS BIGINT) % 2 <> 0")
def delete_half_survivors(spark, sf):
    ops = events(spark, sf)
    even = ops.select("key").distinct().filter(F.substring("key", 2, 6).cast("long") % 2 == 0)
    return state.visible(state.delete(ops, even, 1 << 60)).select("key", "lsn", "value")


@query(f"""WITH {V} SELECT key, CASE WHEN CAST(substr(key, 2) AS BIGINT) % 5 = 0 THEN 'changed:' || value ELSE value END AS value FROM visible""")
def read_modify_write(spark, sf):
    ops = events(spark, sf)
    keys = ops.select("key").distinct().filter(F.substring("key", 2, 6).cast("long") % 5 == 0)
    return state.visible(state.read_modify_write(ops, keys, lambda v: F.concat(F.lit("changed:"), v), 1 << 60)).select("key", "value")


@query(f"""WITH {SIZED} SELECT source, CASE WHEN key_size > 255 THEN 'key size > 255' WHEN key_size = 0 THEN 'key size is zero'
 WHEN key_size + value_size + 8 > 16384 THEN 'KV size > 16384' END AS error, count(*) AS n FROM classed GROUP BY ALL""")
def put_validation(spark, sf):
    return sized(spark, sf).groupBy("source", kv.put_error(F.col("key_size"), F.col("value_size")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT {ORDER_KEY} AS key, 12 AS key_size, octet_length(encode(o_orderpriority)) AS value_size FROM orders)
SELECT key, row_number() OVER (ORDER BY key) - 1 AS lsn, {CLASS} AS class, 'L0_RECOVERY' AS log FROM k""")
def put_metadata_lsn(spark, sf):
    rows = orders(spark, sf).select(oplog.order_key().alias("key"), F.lit(12).alias("key_size"), F.octet_length("o_orderpriority").alias("value_size"))
    rows = order.positions(rows, "key").withColumn("class", kv.size_class(F.col("key_size"), F.col("value_size")))
    return rows.select("key", F.col("pos").alias("lsn"), "class", kv.log_of(F.col("class")).alias("log"))


def _scan_sql(where: str, desc: str = "", n: int = 100) -> str:
    return f"WITH {P} SELECT key, row_number() OVER (ORDER BY key {desc}) AS pos FROM p {where} ORDER BY key {desc} LIMIT {n}"


@query(_scan_sql("WHERE key >= 'http://m'"))
def scan_ge(spark, sf):
    return scan.scan(urls(spark, sf), 100, scan.GREATER_OR_EQUAL, "http://m")


@query(f"WITH {P}, f AS (SELECT min(key) AS k FROM p WHERE key >= 'http://m') SELECT key, row_number() OVER (ORDER BY key) AS pos FROM p, f WHERE key > k ORDER BY key LIMIT 100")
def scan_gt(spark, sf):
    keys = urls(spark, sf)
    first = scan.seek(keys, scan.GREATER_OR_EQUAL, "http://m").agg(F.min("key")).first()[0]
    return scan.scan(keys, 100, scan.GREATER, first or "http://m")


@query(_scan_sql(""))
def scan_first(spark, sf):
    return scan.scan(urls(spark, sf), 100)


@query(_scan_sql("", "DESC"))
def scan_reverse(spark, sf):
    return scan.scan(urls(spark, sf), 100, reverse=True)


@query(f"WITH k AS (SELECT {ORDER_KEY} AS key FROM orders) SELECT key, row_number() OVER (ORDER BY key) AS pos FROM k WHERE key >= '000000000100x' ORDER BY key LIMIT 50")
def scan_after_missing_key(spark, sf):
    return scan.scan(orders(spark, sf).select(oplog.order_key().alias("key")), 50, scan.GREATER_OR_EQUAL, "000000000100x")


TURNS = "k AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/' || lpad(CAST(turn AS VARCHAR), 4, '0') AS key FROM conversations)"


@query(f"""WITH {TURNS}, s AS (SELECT DISTINCT lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/0001' AS start FROM conversations),
 j AS (SELECT start, key, row_number() OVER (PARTITION BY start ORDER BY key) AS pos FROM s JOIN k ON key >= start) SELECT * FROM j WHERE pos <= 5""")
def batch_scan_topn(spark, sf):
    keys = oplog.read(spark, sf, "conversations").select(oplog.turn_key().alias("key"))
    ids = oplog.read(spark, sf, "conversations").select("conv_id").distinct()
    starts = ids.select(F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("/0001")).alias("start"))
    return scan.batch_scan(keys, starts, 5)


@query(f"WITH {P} SELECT key FROM p WHERE starts_with(key, 'http://blog.')")
def prefix_scan(spark, sf):
    return scan.prefix(urls(spark, sf), "http://blog.")


@query(f"WITH {P} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM p")
def next_key(spark, sf):
    return scan.next_key(urls(spark, sf))


@query(f"""WITH {P}, g AS (SELECT key AS guard FROM p WHERE substr(md5(key), 1, 1) = '0')
SELECT key, (SELECT max(guard) FROM g WHERE guard <= key) AS guard FROM p""")
def floor_guard(spark, sf):
    keys = urls(spark, sf)
    guards = keys.filter(F.substring(F.md5(F.col("key").cast("binary")), 1, 1) == "0").select(F.col("key").alias("guard"))
    return order.floor_search(keys, guards)


@query(f"WITH {V} SELECT count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM visible")
def scan_count(spark, sf):
    return state.visible(events(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(f"WITH {SIZED} SELECT source, key, key_size, value_size, class FROM classed WHERE source <> 'lineitem'")
def kv_category(spark, sf):
    return sized(spark, sf).filter("source <> 'lineitem'").select("source", "key", "key_size", "value_size", "class")


@query(f"WITH {SIZED} SELECT source, class, count(*) AS n FROM classed GROUP BY ALL")
def category_histogram(spark, sf):
    return sized(spark, sf).groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIZED} SELECT source, CAST(sum(key_size + value_size + 8) AS BIGINT) AS in_place, CAST(sum(key_size + 12) AS BIGINT) AS separated,
 CAST(sum(key_size + value_size + 16) AS BIGINT) AS logged FROM classed GROUP BY source""")
def kv_sizes(spark, sf):
    k, v = F.col("key_size"), F.col("value_size")
    return sized(spark, sf).groupBy("source").agg(F.sum(kv.kv_size(k, v)).alias("in_place"), F.sum(kv.separated_size(k)).alias("separated"), F.sum(kv.log_footprint(k, v)).alias("logged"))


@query(f"""WITH {SIZED} SELECT CASE WHEN class = 'BIG' THEN 'BIG' ELSE 'L0_RECOVERY' END AS log, count(*) AS n, CAST(sum(key_size + value_size + 16) AS BIGINT) AS bytes FROM classed GROUP BY ALL""")
def log_routing(spark, sf):
    rows = sized(spark, sf).groupBy(kv.log_of(F.col("class")).alias("log"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(kv.log_footprint(F.col("key_size"), F.col("value_size"))).alias("bytes"))


def runs(spark, sf):
    """Events cut by age into four runs: two in level 0 with rising epochs, then levels 1 and 2."""
    ops = events(spark, sf)
    top = ops.agg(F.max("lsn").alias("m"))
    aged = ops.join(F.broadcast(top), F.lit(True)).withColumn("age", F.least(F.lit(3), F.expr("(m - lsn) * 4 div (m + 1)")).cast("long")).drop("m")
    aged = state.latest(aged, "age", "key")
    level = F.when(F.col("age") == 0, 0).otherwise(F.col("age") - 1).cast("long")
    return aged.select("key", "lsn", "op", "value", level.alias("level"), (3 - F.col("age")).alias("epoch"))


@query(f"WITH {RUNS} SELECT key, level, epoch, op, value FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, epoch DESC) = 1")
def merge_runs(spark, sf):
    return merge.merge_runs(runs(spark, sf)).select("key", "level", "epoch", "op", "value")


@query(f"""WITH {RUNS}, one AS (SELECT key, op, value FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, epoch DESC) = 1),
 two AS (SELECT key, op, value FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)
SELECT (SELECT count(*) FROM (FROM one EXCEPT ALL FROM two)) AS only_merged, (SELECT count(*) FROM (FROM two EXCEPT ALL FROM one)) AS only_latest""")
def merge_equals_latest(spark, sf):
    one = merge.merge_runs(runs(spark, sf)).select("key", "op", "value")
    two = state.latest(events(spark, sf)).select("key", "op", "value")
    a, b = (x.exceptAll(y).agg(F.count(F.lit(1)).alias(n)) for x, y, n in ((one, two, "only_merged"), (two, one, "only_latest")))
    return a.join(b, F.lit(True))


@query(f"WITH {E} SELECT key, lsn, value FROM (SELECT * FROM e WHERE lsn <= 400 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1) WHERE op = 'put'")
def as_of_snapshot(spark, sf):
    return state.as_of(events(spark, sf), 400).select("key", "lsn", "value")


@query("SELECT i AS level, CASE WHEN i < 7 THEN CAST(1048576 * 4 ** i AS BIGINT) END AS capacity FROM range(0, 8) AS x(i)")
def level_capacity(spark, sf):
    return spark.range(8).select(F.col("id").alias("level"), kv.level_capacity(F.col("id")).alias("capacity"))


@query(f"""WITH {RUNS}, s AS (SELECT level, CAST(sum(7 + coalesce(octet_length(encode(value)), 0) + 8) AS BIGINT) AS bytes, count(*) AS n_keys FROM runs GROUP BY level)
SELECT level, bytes, n_keys, CAST(256 * 4 ** level AS BIGINT) AS capacity, bytes >= 256 * 4 ** level AS overflows FROM s""")
def level_overflow(spark, sf):
    size = 7 + F.coalesce(F.octet_length("value"), F.lit(0)) + 8
    return merge.overflow(merge.level_sizes(runs(spark, sf), size), 256, 4).select("level", "bytes", "n_keys", "capacity", "overflows")


@query(f"WITH {RUNS} SELECT key, lsn, op, value FROM runs WHERE level >= 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1")
def compaction_output(spark, sf):
    rows = order.reliable(runs(spark, sf))
    parts = [rows.filter(F.col("level") == n).select("key", "lsn", "op", "value") for n in (1, 2)]
    return merge.compact(*parts)


@query(f"""WITH {SIZED}, c AS (SELECT class, i AS level FROM classed, (SELECT unnest([0, 1, 3]) AS i))
SELECT level::BIGINT AS level, CASE class WHEN 'BIG' THEN 'BIG_INLOG' WHEN 'SMALL' THEN 'SMALL_INPLACE' ELSE CASE WHEN level = 1 THEN 'MEDIUM_INLOG' ELSE 'MEDIUM_INPLACE' END END AS category, count(*) AS n
FROM c GROUP BY ALL""")
def medium_placement(spark, sf):
    rows = sized(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 1, 3)))))
    return rows.select("level", kv.placement(F.col("class"), F.col("level")).alias("category"), "n")


@query(f"""WITH {VERSIONS} SELECT count(*) AS rows_before, CAST(sum(size) AS BIGINT) AS bytes_before, count(*) FILTER (live) AS rows_after,
 CAST(sum(size) FILTER (live) AS BIGINT) AS bytes_after, CAST(sum(size) * 100 // sum(size) FILTER (live) AS BIGINT) AS space_amp_percent FROM seg""")
def full_compaction_stats(spark, sf):
    rows = merge.with_liveness(versions(spark, sf))
    kept = F.when(F.col("live"), F.col("size"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("rows_before"), F.sum("size").alias("bytes_before"), F.count(kept).alias("rows_after"), F.sum(kept).alias("bytes_after")
    )
    return totals.withColumn("space_amp_percent", F.expr("bytes_before * 100 div bytes_after"))


def versions(spark, sf):
    size = (7 + F.coalesce(F.octet_length("value"), F.lit(0)) + 8).cast("long")
    return events(spark, sf).select("key", "lsn", "op", size.alias("size"))


def segments(spark, sf):
    placed = workload.running_offsets(versions(spark, sf)).withColumn("segment", kv.segment_of(F.col("offset"), 65_536))
    return merge.with_liveness(order.reliable(placed))


SEGMENTS = "g AS (SELECT segment, CAST(coalesce(sum(size) FILTER (NOT live), 0) AS BIGINT) AS garbage_bytes, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (live) AS live_rows FROM seg GROUP BY segment)"


@query(f"WITH {VERSIONS}, {SEGMENTS} SELECT * FROM g")
def garbage_bytes(spark, sf):
    return merge.garbage(segments(spark, sf))


@query(f"WITH {VERSIONS} SELECT key, lsn, segment FROM seg WHERE live")
def live_versions(spark, sf):
    return segments(spark, sf).filter("live").select("key", "lsn", "segment")


@query(f"WITH {VERSIONS}, {SEGMENTS} SELECT * FROM g WHERE garbage_bytes > 0 AND segment < (SELECT max(segment) FROM g)")
def gc_victims(spark, sf):
    return merge.victims(order.reliable(merge.garbage(segments(spark, sf))))


@query(f"WITH {V} SELECT * FROM visible")
def wal_replay(spark, sf):
    ops = events(spark, sf)
    log = kv.log_of(kv.size_class(F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0)), F.col("op")))
    return merge.replay(ops.filter(log == "L0_RECOVERY"), ops.filter(log == "BIG")).select("key", "lsn", "value")


@query("""WITH a AS (SELECT event_id AS seq, user_id AS segment, CASE WHEN event_type IN ('error', 'click') THEN 'free' ELSE 'alloc' END AS op FROM events)
SELECT segment FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY segment ORDER BY seq DESC) = 1) WHERE op = 'alloc'""")
def alloc_replay(spark, sf):
    op = F.when(F.col("event_type").isin("error", "click"), "free").otherwise("alloc")
    return merge.replay_allocations(oplog.read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("segment"), op.alias("op")))


def packing_sql(rows: str, segment: int) -> str:
    """p (log, lsn, size, off): entries of rows (log, lsn, size) laid out one after another, as a recursive walk along each log."""
    return f"""r AS MATERIALIZED (SELECT log, lsn, size, row_number() OVER (PARTITION BY log ORDER BY lsn) AS n FROM {rows}),
 p AS (SELECT log, lsn, size, n, CAST(0 AS BIGINT) AS off FROM r WHERE n = 1 UNION ALL
  SELECT r.log, r.lsn, r.size, r.n, CAST(CASE WHEN r.size > {segment} - (p.off + p.size) % {segment} THEN p.off + p.size + {segment} - (p.off + p.size) % {segment} ELSE p.off + p.size END AS BIGINT)
  FROM p JOIN r ON r.log = p.log AND r.n = p.n + 1)"""


@query(f"""WITH RECURSIVE {VERSIONS}, x AS (SELECT 'log' || CAST(lsn % 4 AS VARCHAR) AS log, lsn, CAST(size AS BIGINT) AS size FROM w), {packing_sql('x', 4096)}
SELECT log, lsn, size, off AS "offset" FROM p""")
def segment_packing(spark, sf):
    rows = versions(spark, sf).select(F.concat(F.lit("log"), (F.col("lsn") % 4).cast("string")).alias("log"), "lsn", "size")
    return merge.pack(rows, 4096)


@query("SELECT key, n_versions FROM (SELECT key, count(*) AS n_versions FROM (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key FROM events) GROUP BY key) ORDER BY n_versions DESC, key LIMIT 10")
def hottest_keys(spark, sf):
    return events(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_versions")).orderBy(F.desc("n_versions"), "key").limit(10)


MIX_SQL = " ".join(f"WHEN mix = '{m}' THEN list_value({', '.join(str(workload.VALUE_BYTES[c]) for c in s)})[i % 10 + 1]" for m, s in workload.MIXES.items())


@query(f"""WITH m AS (SELECT unnest(['s', 'm', 'l', 'sd', 'md', 'ld']) AS mix), x AS (SELECT mix, CASE {MIX_SQL} END AS size FROM m, range(0, 5000) AS y(i))
SELECT mix, CAST(size AS BIGINT) AS size, count(*) AS n FROM x GROUP BY ALL""")
def ycsb_mix_sizes(spark, sf):
    out = None
    for mix in workload.MIXES:
        part = spark.range(5000).select(F.lit(mix).alias("mix"), workload.value_size(F.col("id"), mix).alias("size"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mix", "size").agg(F.count(F.lit(1)).alias("n"))


def _choose_sql() -> str:
    cases = []
    for name, shares in workload.WORKLOADS.items():
        upto, when = 0.0, ""
        for op, share in shares.items():
            upto += share
            when += f" WHEN u < {upto!r} THEN '{op}'"
        cases.append(f"WHEN w = '{name}' THEN CASE{when} ELSE '{op}' END")
    return f"""WITH d AS (SELECT i, ('0x' || substr(md5(CAST(i AS VARCHAR)), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM range(0, 20000) AS x(i)),
 c AS (SELECT w, CASE {' '.join(cases)} END AS op FROM d, (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS w)) SELECT w AS workload, op, count(*) AS n FROM c GROUP BY ALL"""


@query(_choose_sql())
def ycsb_ops(spark, sf):
    out = None
    for name, shares in workload.WORKLOADS.items():
        part = spark.range(20_000).select(F.lit(name).alias("workload"), workload.choose(F.col("id"), shares).alias("op"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("workload", "op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(1 / pow(i, 0.99)), 6) AS zeta FROM range(1, 100001) AS x(i)")
def zipf_zeta(spark, sf):
    return spark.range(1, 100_001).agg(F.round(F.sum(1 / F.pow("id", F.lit(workload.THETA))), 6).alias("zeta"))


DRAW_SQL = "('0x' || substr(md5(CAST(i AS VARCHAR)), 1, 6))::BIGINT / 16777216.0::DOUBLE"
FNV_SQL = """CAST(list_reduce([14695981039346656037::UHUGEINT] || list_transform(range(0, 64, 8), lambda s: ((id >> s::INTEGER) & 255)::UHUGEINT),
 lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR)"""


def transactions_sql(n: int, records: int, name: str) -> str:
    """requests (i, op, record, scan_length) of a workload other than d."""
    upto, cases = 0.0, ""
    for op, share in workload.WORKLOADS[name].items():
        upto += share
        cases += f" WHEN u < {upto!r} THEN '{op}'"
    draw = "('0x' || substr(md5(CAST(i AS VARCHAR) || '{}'), 1, 6))::BIGINT / 16777216.0::DOUBLE"
    return f"""WITH z AS (SELECT sum(1 / pow(i, 0.99::DOUBLE)) AS zn FROM range(1, {records + 1}) AS x(i)),
 d AS (SELECT i, {draw.format('')} AS u, {draw.format(':rank')} AS v, {draw.format(':scan')} AS s FROM range(0, {n}) AS x(i)),
 t AS (SELECT *, (1 - pow(2.0::DOUBLE / {records}, 1 - 0.99::DOUBLE)) / (1 - (1 + pow(0.5::DOUBLE, 0.99)) / zn) AS eta FROM d, z),
 k AS (SELECT i, CASE{cases} ELSE '{op}' END AS op, s, CASE WHEN v * zn < 1 THEN 0 WHEN v * zn < 1 + pow(0.5::DOUBLE, 0.99) THEN 1
  ELSE least({records - 1}, CAST(floor({records} * pow(eta * v - eta + 1, 1 / (1 - 0.99::DOUBLE))) AS BIGINT)) END AS id FROM t),
 requests AS (SELECT i, op, CAST(CAST({FNV_SQL} AS UHUGEINT) % {records} AS BIGINT) AS record, CASE WHEN op = 'scan' THEN CAST(floor(s * 1000) + 1 AS BIGINT) END AS scan_length FROM k)"""


@query(f"SELECT id, {FNV_SQL} AS hash FROM (SELECT o_orderkey AS id FROM orders)")
def key_hash(spark, sf):
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), kv.fnv1a("o_orderkey").cast("string").alias("hash"))


@query(f"""WITH z AS (SELECT sum(1 / pow(i, 0.99::DOUBLE)) AS zn FROM range(1, 5001) AS x(i)), d AS (SELECT i, {DRAW_SQL} AS u FROM range(0, 20000) AS x(i)),
 e AS (SELECT *, (1 - pow(2.0::DOUBLE / 5000, 1 - 0.99::DOUBLE)) / (1 - (1 + pow(0.5::DOUBLE, 0.99)) / zn) AS eta FROM d, z),
 r AS (SELECT CASE WHEN u * zn < 1 THEN 0 WHEN u * zn < 1 + pow(0.5::DOUBLE, 0.99) THEN 1
  ELSE least(4999, CAST(floor(5000 * pow(eta * u - eta + 1, 1 / (1 - 0.99::DOUBLE))) AS BIGINT)) END AS rank FROM e)
SELECT CAST(rank AS BIGINT) AS rank, CAST(greatest(0, 4999 - rank) AS BIGINT) AS newest, count(*) AS n FROM r GROUP BY ALL""")
def zipf_ranks(spark, sf):
    z, n = workload.zeta(spark, 5000), 5000
    rank = workload.zipf(workload.uniform(F.col("id")), n, z)
    rows = spark.range(20_000).select(rank.alias("rank"))
    return rows.select("rank", workload.latest_skew(F.lit(n - 1), F.col("rank")).alias("newest")).groupBy("rank", "newest").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 5 = 0 THEN '# ' || o_orderpriority
 ELSE '  run' || CAST(o_orderkey AS VARCHAR) || '  ' || CASE WHEN o_orderkey % 2 = 0 THEN 'load' ELSE 'run' END || ' workload' || chr(97 + CAST(o_orderkey % 6 AS INTEGER)) || ' # note' END AS line FROM orders),
 p AS (SELECT regexp_split_to_array(trim(regexp_replace(line, '#.*$', '')), '\\s+') AS w FROM l)
SELECT w[1] AS name, w[2] AS phase, w[3] AS workload FROM p WHERE w[1] <> '' AND w[2] IN ('load', 'run')""")
def execution_plan(spark, sf):
    i = F.col("o_orderkey")
    step = F.concat(F.lit("  run"), i.cast("string"), F.lit("  "), F.when(i % 2 == 0, "load").otherwise("run"), F.lit(" workload"), F.chr(97 + i % 6), F.lit(" # note"))
    line = F.when(i % 5 == 0, F.concat(F.lit("# "), F.col("o_orderpriority"))).otherwise(step)
    return workload.plan_file(orders(spark, sf).select(line.alias("line")))


@query("""WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM f)""")
def guard_recovery(spark, sf):
    """Tables that were allocated and never freed, lines with flag R being the frees."""
    lines = oplog.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_returnflag") == "R").alias("freed"))
    return lines.groupBy("key").agg(F.max("freed").alias("freed")).filter(~F.col("freed")).select("key")


@query(f"""WITH {VERSIONS}, {SEGMENTS} SELECT count(*) FILTER (garbage_bytes > 0) AS segments_with_garbage,
 CAST(sum(garbage_bytes) AS BIGINT) AS garbage_bytes, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM g""")
def garbage_stats(spark, sf):
    dirty = F.count(F.when(F.col("garbage_bytes") > 0, 1)).alias("segments_with_garbage")
    return merge.garbage(segments(spark, sf)).agg(dirty, F.sum("garbage_bytes").alias("garbage_bytes"), F.sum("total_bytes").alias("total_bytes"))


@query(transactions_sql(20_000, 5000, "e") + " SELECT i, op, record, scan_length FROM requests")
def ycsb_transactions(spark, sf):
    return workload.transactions(spark, 20_000, 5000, "e")


@query(f"""SELECT {FNV_SQL} AS key, id AS lsn, 'put' AS op, CAST(CASE WHEN id % 10 < 6 THEN 5 WHEN id % 10 < 8 THEN 100 ELSE 2000 END AS BIGINT) AS value_size
FROM range(0, 10000) AS x(id)""")
def ycsb_load(spark, sf):
    return workload.load_phase(spark, 10_000)


@query(f"""WITH k AS (SELECT ('0x' || substr(md5({ORDER_KEY}), 1, 4))::BIGINT % 8 AS shard FROM orders) SELECT shard, count(*) AS n FROM k GROUP BY shard""")
def shard_counts(spark, sf):
    return orders(spark, sf).groupBy(kv.shard(oplog.order_key(), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def latencies(spark, sf):
    rows = oplog.read(spark, sf, "events").filter("value is not null")
    return rows.select((F.col("user_id") % 4).alias("thread"), F.col("event_type").alias("op"), F.floor("value").cast("long").alias("usec"))


@query(f"WITH {LAT} SELECT op, usec, count(*) AS n FROM lat WHERE usec >= 0 AND usec < 100000 GROUP BY ALL")
def latency_histogram(spark, sf):
    return workload.histogram(latencies(spark, sf))


POINTS_SQL = ", ".join(f"min(CASE WHEN upto >= floor(total * {p!r}::DOUBLE) THEN usec END) AS {n}" for p, n in zip(workload.POINTS, ("p50", "p70", "p90", "p99", "p99_9", "p99_99"), strict=True))


@query(f"""WITH {LAT}, h AS (SELECT op, usec, count(*) AS n FROM lat WHERE usec >= 0 AND usec < 100000 GROUP BY ALL),
 c AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY usec) AS upto, sum(n) OVER (PARTITION BY op) AS total FROM h)
SELECT op, CAST(sum(n) AS BIGINT) AS samples, min(usec) AS min_usec, max(usec) AS max_usec, CAST(sum(usec * n) // sum(n) AS BIGINT) AS avg_usec, {POINTS_SQL} FROM c GROUP BY op""")
def latency_percentiles(spark, sf):
    return workload.percentiles(workload.histogram(latencies(spark, sf)), ["op"])


@query(f"""WITH {LAT}, o AS (SELECT op, thread, sum(usec) // count(*) AS a, max(usec) AS t FROM lat GROUP BY ALL)
SELECT op, count(*) AS threads, CAST(sum(a) // count(*) AS BIGINT) AS mean_avg, CAST(sum(t) // count(*) AS BIGINT) AS mean_max FROM o GROUP BY op""")
def thread_mean_stats(spark, sf):
    return workload.mean_of_threads(latencies(spark, sf))


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(start, '%Y-%m-%d') AS day, n, n - lag(n) OVER (ORDER BY start) AS delta FROM w""")
def throughput_intervals(spark, sf):
    return workload.throughput(oplog.read(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "delta")


def trace(spark, sf):
    """A trace made of orders: every third line reads, the others write, some with a wrong key size."""
    key, n = oplog.order_key(), F.col("o_orderkey")
    size = F.when(n % 7 == 0, "11").otherwise("12")
    put = F.concat_ws(" ", F.lit("PUT"), size, key, F.length("o_orderpriority").cast("string"), F.col("o_orderpriority"))
    line = F.when(n % 3 == 0, F.concat_ws(" ", F.lit("GET"), F.lit("12"), key)).otherwise(put)
    return oplog.trace_ops(orders(spark, sf).select(n.alias("line_no"), line.alias("line")))


@query(f"WITH {TRACE} SELECT * FROM ops")
def trace_parse(spark, sf):
    return trace(spark, sf)


@query(f"WITH {TRACE} SELECT line_no, key FROM ops WHERE key_size <> length(key) OR (op = 'put' AND value_size <> octet_length(encode(value)))")
def trace_validate(spark, sf):
    return oplog.trace_errors(trace(spark, sf)).select("line_no", "key")


@query(f"WITH {TRACE} SELECT line_no, key FROM ops WHERE op = 'get' AND key NOT IN (SELECT key FROM ops WHERE op = 'put')")
def trace_get_misses(spark, sf):
    ops = trace(spark, sf)
    return state.missing(ops.filter("op = 'get'"), ops.filter("op = 'put'")).select("line_no", "key")


def _shared_folder(spark: SparkSession) -> str:
    order.reliable(spark.range(1))  # sets the folder where the session has none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query(f"WITH {V} SELECT * FROM visible")
def store_reopen(spark, sf):
    """Two batches written, the store closed and opened again, compacted, read."""
    folder = _shared_folder(spark)
    ops = events(spark, sf)
    store = Store(spark, folder, "db")
    store.write(ops.filter("lsn % 2 = 0"))
    store.write(ops.filter("lsn % 2 = 1"))
    store.close()
    again = Store(spark, folder, "db", create=False)
    again.compact()
    return again.state().select("key", "lsn", "value")


@query(f"WITH {V} SELECT * FROM visible")
def streaming_ingest(spark, sf):
    """Events arrive as files of a stream; the store then shows the newest versions."""
    folder = _shared_folder(spark)
    events(spark, sf).repartition(3).write.parquet(f"{folder}/in")
    store = Store(spark, folder, "db")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ingest(stream, store, f"{folder}/checkpoint", compact_every=2).awaitTermination()
    return store.state().select("key", "lsn", "value")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def size_report(spark, sf):
    """Counts by priority and status with subtotals, as a space report would have them."""
    return orders(spark, sf).rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
