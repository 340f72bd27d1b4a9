"""Every operator of the engine as a named query with its SQL twin.

A query takes (spark, sf_dir). ``QUERIES`` and ``ORACLES`` have the same keys, but for operators that SQL
cannot state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltbed.config import EngineConfig
from siltbed.functions import bloom, cms, codec, hll, simhash
from siltbed.log import events_log, is_reserved, parts_log
from siltbed.operators import access, catalog, compaction, control, merkle, writes
from siltbed.session import scratch_dir, table
from siltbed.sources import tables, wal
from siltbed.streaming import upsert

QUERIES, ORACLES = {}, {}
KV = """kv AS (SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS ts, 'user_' || lpad(user_id::VARCHAR, 6, '0') AS key, value,
 event_type = 'error' AS tombstone, event_type, props FROM events)"""
STATE = f"""{KV}, newest AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM kv GROUP BY key),
 state AS (SELECT key, seq, value FROM newest WHERE NOT tombstone)"""
RUN = 500
RUNS = f"""{KV}, r0 AS (SELECT *, (seq // {RUN})::INT AS run_id FROM kv),
 runs AS (SELECT run_id, key, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM r0 GROUP BY run_id, key)"""
SEED = 1700000001


def le_sql(x: str, width: int) -> str:
    h = f"lpad(printf('%X', {x}), {2 * width}, '0')"
    return "(" + " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(width))) + ")"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def kv(spark: SparkSession, d: str) -> DataFrame:
    return events_log(table(spark, d, "events"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    log = kv(spark, d).select("seq", "ts", "key", "value", "tombstone")
    return compaction.flush_runs(compaction.assign_runs(log, RUN))


# Reads

@query("latest_state", f"WITH {STATE} SELECT key, seq, value FROM state")
def latest_state(spark, d):
    return access.latest_state(kv(spark, d)).select("key", "seq", "value")


@query("point_get", f"WITH {STATE} SELECT key, value FROM state WHERE key = 'user_000042'")
def point_get(spark, d):
    return access.point_get(kv(spark, d), "user_000042").select("key", "value")


@query("multi_get", f"WITH {STATE} SELECT key, value FROM state WHERE key IN (SELECT 'user_' || lpad(c_custkey::VARCHAR, 6, '0') FROM customer WHERE c_acctbal > 5000)")
def multi_get(spark, d):
    want = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("user_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return access.multi_get(kv(spark, d), want).select("key", "value")


@query("range_scan", f"WITH {STATE} SELECT key, value FROM state WHERE key BETWEEN 'user_000030' AND 'user_000090'")
def range_scan(spark, d):
    return access.range_scan(kv(spark, d), "user_000030", "user_000090").select("key", "value")


@query("range_scan_page", f"WITH {STATE} SELECT (row_number() OVER (ORDER BY key))::INT AS ordinal, key, value FROM state WHERE key BETWEEN 'user_000003' AND 'user_000090' QUALIFY ordinal BETWEEN 11 AND 20")
def range_scan_page(spark, d):
    return access.page(access.range_scan(kv(spark, d), "user_000003", "user_000090"), 10, 2)


@query("scan_pages", f"WITH {STATE} SELECT ((row_number() OVER (ORDER BY key) - 1) // 10 + 1)::INT AS page, (row_number() OVER (ORDER BY key))::INT AS ordinal, key, value FROM state WHERE key BETWEEN 'user_000003' AND 'user_000090' QUALIFY page <= 3")
def scan_pages(spark, d):
    """Forwards to page 3 and back to page 2."""
    return access.get_many_pages(kv(spark, d), "user_000003", "user_000090", 10, [1, 3, 2])


@query("prefix_scan", f"WITH {STATE} SELECT key, value FROM state WHERE starts_with(key, 'user_0000')")
def prefix_scan(spark, d):
    return access.prefix_scan(kv(spark, d), "user_0000").select("key", "value")


PARTS = "parts AS (SELECT p_name AS key, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY p_name)"


@query("prefix_scan_page", f"WITH {PARTS} SELECT (row_number() OVER (ORDER BY key))::INT AS ordinal, key, value FROM parts WHERE starts_with(key, (SELECT substr(min(p_name), 1, 2) FROM part)) QUALIFY ordinal <= 10")
def prefix_scan_page(spark, d):
    part = table(spark, d, "part")
    prefix = part.agg(F.substring(F.min("p_name"), 1, 2)).first()[0]
    return access.page(access.prefix_scan(parts_log(part), prefix), 10, 1)


@query("prefix_scan_legacy", f"WITH {STATE} SELECT key, value FROM state WHERE key BETWEEN 'user_0001' AND 'user_0001ÿ'")
def prefix_scan_legacy(spark, d):
    return access.prefix_scan(kv(spark, d), "user_0001", legacy_bound=True).select("key", "value")


@query("range_iter", f"WITH {STATE} SELECT (row_number() OVER (ORDER BY key))::INT AS ordinal, key, value FROM state WHERE key BETWEEN 'user_000003' AND 'user_000090' QUALIFY ordinal = 7")
def range_iter(spark, d):
    return access.cursor(access.range_scan(kv(spark, d), "user_000003", "user_000090"), 7)


@query("prefix_iter", f"WITH {STATE} SELECT (row_number() OVER (ORDER BY key))::INT AS ordinal, key, value FROM state WHERE starts_with(key, 'user_0001') QUALIFY ordinal = 3")
def prefix_iter(spark, d):
    return access.cursor(access.prefix_scan(kv(spark, d), "user_0001"), 3)


NAMES = "(SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'bf_' WHEN 1 THEN 'cms_' WHEN 2 THEN 'hll_' WHEN 3 THEN 'sh_' WHEN 4 THEN 'tb_' ELSE 'b_' END || p_name AS key FROM part)"


@query("system_key_filter", f"SELECT id, key FROM {NAMES} WHERE NOT regexp_matches(key, '^(bf_|cms_|hll_|sh_|tb_)')")
def system_key_filter(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, ["bf_", "cms_", "hll_", "sh_", "tb_", "b_"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(prefix, "p_name").alias("key"))
    return keys.filter(~is_reserved(F.col("key")))


# Writes

OUTCOME = f"WITH {KV}, p AS (SELECT *, lag(value) OVER w AS pv, lag(tombstone) OVER w AS pt FROM kv WINDOW w AS (PARTITION BY key ORDER BY seq))"


@query("put_log", f"{OUTCOME} SELECT seq, key, true AS ok FROM p WHERE NOT tombstone")
def put_log(spark, d):
    return writes.with_outcome(kv(spark, d)).filter("op = 'put'").select("seq", "key", "ok")


@query("delete_log", f"{OUTCOME} SELECT seq, key, CASE WHEN pt = false THEN pv END AS old_value, coalesce(NOT pt, false) AS ok FROM p WHERE tombstone")
def delete_log(spark, d):
    return writes.with_outcome(kv(spark, d)).filter("op = 'delete'").select("seq", "key", "old_value", "ok")


@query("sketch_name_guard", """SELECT min(o_orderkey) AS seq, 'bf_' || o_custkey::VARCHAR AS name FROM orders
 WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY o_custkey""")
def sketch_name_guard(spark, d):
    named = lambda c: F.concat(F.lit("bf_"), F.col(c).cast("string")).alias("name")
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), named("o_custkey"))
    return writes.name_guard(requests, table(spark, d, "customer").filter("c_nationkey < 12").select(named("c_custkey")))


# Runs and compaction

@query("memtable_runs", f"WITH {RUNS} SELECT run_id, count(*) AS n_ops, count(DISTINCT key) AS n_keys FROM r0 GROUP BY run_id")
def memtable_runs(spark, d):
    r = compaction.assign_runs(kv(spark, d), RUN)
    return r.groupBy("run_id").agg(F.count("*").alias("n_ops"), F.countDistinct("key").alias("n_keys"))


@query("memtable_flush", f"WITH {RUNS} SELECT run_id, key, seq, ts, value, tombstone FROM runs")
def memtable_flush(spark, d):
    return runs(spark, d).select("run_id", "key", "seq", "ts", "value", "tombstone")


@query("kway_merge", f"WITH {RUNS} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM runs GROUP BY key")
def kway_merge(spark, d):
    return compaction.kway_merge(runs(spark, d)).select("key", "seq", "value", "tombstone")


@query("size_tiered_compaction", f"""WITH {RUNS}, n AS (SELECT max(run_id) + 1 AS n FROM runs),
 placed AS (SELECT runs.*, CASE WHEN run_id < (n // 16) * 16 THEN 3 WHEN run_id < (n // 4) * 4 THEN 2 ELSE 1 END AS level FROM runs, n),
 t AS (SELECT *, (CASE level WHEN 3 THEN run_id // 16 WHEN 2 THEN run_id // 4 ELSE run_id END)::BIGINT AS table_num FROM placed)
 SELECT level::INT AS level, table_num, key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM t GROUP BY ALL""")
def size_tiered_compaction(spark, d):
    return compaction.size_tiered(runs(spark, d), 4, 3).select("level", "table_num", "key", "seq", "value", "tombstone")


#: Narrow key ranges, so that leveled compaction meets contained, partial and disjoint tables.
LEVELED = f"""{KV}, ranged AS (SELECT seq, ts, key, value, tombstone, ((seq // {RUN}) * 3 + CASE WHEN key < 'user_000050' THEN 0 WHEN key < 'user_000100' THEN 1 ELSE 2 END)::INT AS run_id FROM kv),
 runs AS (SELECT run_id, key, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM ranged GROUP BY run_id, key)"""


def ranged_runs(spark, d):
    third = F.when(F.col("key") < "user_000050", 0).when(F.col("key") < "user_000100", 1).otherwise(2)
    log = kv(spark, d).select("seq", "ts", "key", "value", "tombstone")
    return compaction.flush_runs(log.withColumn("run_id", (F.floor(F.col("seq") / RUN) * 3 + third).cast("int")))


PLACE_SQL = "CASE WHEN run_id < (n // 16) * 16 THEN 3 WHEN run_id < (n // 4) * 4 THEN 2 ELSE 1 END"


def tiered_level(cat):
    n = cat.agg(F.max("run_id") + 1).scalar()
    whole = lambda k: F.col("run_id") < F.call_function("div", n, F.lit(k)) * k
    return F.when(whole(16), 3).when(whole(4), 2).otherwise(1)


CAT = f"""{LEVELED}, cat AS (SELECT run_id, min(key) AS first_key, max(key) AS last_key, count(*) AS n_rows FROM runs GROUP BY run_id)"""


@query("leveled_overlap", f"""WITH {CAT}, n AS (SELECT max(run_id) + 1 AS n FROM cat), placed AS (SELECT cat.*, {PLACE_SQL} AS level FROM cat, n)
 SELECT u.run_id AS upper_id, w.run_id AS lower_id, CASE WHEN w.first_key >= u.first_key AND w.last_key <= u.last_key THEN 'contained' ELSE 'partial' END AS kind
 FROM placed u JOIN placed w ON w.level = u.level + 1 AND u.first_key <= w.last_key AND w.first_key <= u.last_key""")
def leveled_overlap(spark, d):
    """All tables, at the levels that size-tiered compaction would give their runs; each level against the next."""
    cat = compaction.table_ranges(ranged_runs(spark, d), ["run_id"])
    placed = cat.withColumn("level", tiered_level(cat))
    return compaction.overlapping(placed, placed)


@query("leveled_split", f"WITH {RUNS} SELECT run_id, key, seq, key >= 'user_000075' AS moves FROM runs")
def leveled_split(spark, d):
    moving, staying = compaction.split_at(runs(spark, d), "user_000075", lower=True)
    cols = ["run_id", "key", "seq"]
    return moving.select(*cols, F.lit(True).alias("moves")).unionByName(staying.select(*cols, F.lit(False).alias("moves")))


@query("leveled_compaction", f"WITH {STATE} SELECT key, seq, value FROM state")
def leveled_compaction(spark, d):
    """The live state read from the compacted tables: compaction must not change it."""
    tables_ = ranged_runs(spark, d).withColumn("level", F.lit(1))
    done = compaction.leveled(tables_, EngineConfig(level_count=4, level_num=2, t=2))
    return access.latest_state(done.drop("level", "table_num")).select("key", "seq", "value")


@query("leveled_tables")
def leveled_tables(spark, d):
    tables_ = ranged_runs(spark, d).withColumn("level", F.lit(1))
    return compaction.leveled(tables_, EngineConfig(level_count=4, level_num=2, t=2)).groupBy("level", "table_num").agg(F.count("*").alias("n_rows"))


@query("renumber_tables", f"""WITH {RUNS}, n AS (SELECT max(run_id) + 1 AS n FROM runs),
 t AS (SELECT DISTINCT {PLACE_SQL} AS level, (CASE {PLACE_SQL} WHEN 3 THEN run_id // 16 WHEN 2 THEN run_id // 4 ELSE run_id END)::BIGINT AS run_id FROM runs, n)
 SELECT run_id, level, (row_number() OVER (PARTITION BY level ORDER BY run_id))::INT AS num FROM t""")
def renumber_tables(spark, d):
    """The tables that a compaction leaves, whose numbers have gaps."""
    left = compaction.size_tiered(runs(spark, d), 4, 3).select("level", F.col("table_num").alias("run_id")).distinct()
    return compaction.renumber(left).select("run_id", "level", "num")


# Catalog and index

CATALOG = "SELECT 1 AS level, run_id, min(key) AS first_key, max(key) AS last_key, count(*) AS n_rows, sum(tombstone::INT)::BIGINT AS n_tombstones FROM runs GROUP BY run_id"


@query("table_catalog", f"WITH {RUNS} {CATALOG}")
def table_catalog(spark, d):
    return tables.ordered_catalog(catalog.table_catalog(runs(spark, d).withColumn("level", F.lit(1))))


@query("table_summary", f"WITH {RUNS}, n AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos FROM runs) SELECT run_id, key, pos FROM n WHERE pos % 20 = 0")
def table_summary(spark, d):
    return catalog.summary(runs(spark, d), 5, 4)


@query("summary_prune", f"WITH {LEVELED}, c AS ({CATALOG}) SELECT run_id, first_key, last_key FROM c WHERE first_key <= 'user_000060' AND last_key >= 'user_000060'")
def summary_prune(spark, d):
    cat = catalog.table_catalog(ranged_runs(spark, d).withColumn("level", F.lit(1)))
    return catalog.prune_point(cat, "user_000060").select("run_id", "first_key", "last_key")


@query("sparse_index", f"WITH {RUNS}, n AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos FROM runs) SELECT run_id, key, pos FROM n WHERE pos % 5 = 0")
def sparse_index(spark, d):
    return catalog.sparse_index(runs(spark, d), 5)


@query("index_seek", f"""WITH {RUNS}, n AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos FROM runs),
 i AS (SELECT * FROM n WHERE pos % 5 = 0), p AS (SELECT DISTINCT run_id, key FROM r0)
 SELECT p.run_id, p.key, max(i.pos) AS seek_pos FROM p LEFT JOIN i ON i.run_id = p.run_id AND i.key <= p.key GROUP BY p.run_id, p.key""")
def index_seek(spark, d):
    probes = compaction.assign_runs(kv(spark, d), RUN).select("run_id", "key").distinct()
    return catalog.index_seek(catalog.sparse_index(runs(spark, d), 5), probes)


@query("sorted_table_read", f"WITH {STATE} SELECT layout, key, seq, value, tombstone FROM newest, (SELECT unnest(['many', 'one']) AS layout) WHERE key BETWEEN 'user_000030' AND 'user_000090'")
def sorted_table_read(spark, d):
    """A flushed table in both layouts, read back by key range."""
    rows = access.newest_versions(kv(spark, d)).select("key", "seq", "value", "tombstone")
    out = []
    for layout in ("many", "one"):
        path = scratch_dir(spark, f"sorted-{layout}")
        tables.write_table(rows, path, one_file=layout == "one")
        out.append(tables.read_table(spark, path).filter(F.col("key").between("user_000030", "user_000090")).withColumn("layout", F.lit(layout)))
    return out[0].unionByName(out[1])


# Integrity

CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""


@query("crc32_records", f"WITH {KV} SELECT seq, xor({CRC_SQL.format('props')}, 4294967295::BIGINT) AS crc FROM kv")
def crc32_records(spark, d):
    return kv(spark, d).select("seq", F.crc32("props").alias("crc"))


LEAF = "sha1(key || ':' || seq::VARCHAR || ':' || tombstone::VARCHAR)"
TREE = f"""WITH RECURSIVE {RUNS}, leaves AS (SELECT run_id AS table_id, 0 AS level, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos, {LEAF} AS hash FROM runs),
 tree AS (SELECT table_id, level, pos, hash FROM leaves UNION ALL
  SELECT table_id, level + 1, up, sha1(unhex(sha1(unhex(l))) || unhex(sha1(unhex(coalesce(r, '{merkle.EMPTY_SHA1}'))))) FROM (
   SELECT table_id, level, pos // 2 AS up, max(CASE WHEN pos % 2 = 0 THEN hash END) AS l, max(CASE WHEN pos % 2 = 1 THEN hash END) AS r,
    max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY table_id) AS n FROM tree) GROUP BY table_id, level, pos // 2) WHERE n > 1 OR level = 0)"""


def run_leaves(spark, d, tag=None):
    value = F.concat_ws(":", "key", F.col("seq").cast("string"), F.col("tombstone").cast("string"))
    rows = runs(spark, d).select(F.col("run_id").alias("table_id"), "key", (F.when(F.col("seq") % 97 == 5, "changed").otherwise(value) if tag else value).alias("data"))
    return merkle.merkle_leaves(rows, "key", "data")


@query("merkle_leaves", f"WITH {RUNS} SELECT run_id AS table_id, 0 AS level, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos, {LEAF} AS hash FROM runs")
def merkle_leaves(spark, d):
    return run_leaves(spark, d)


@query("merkle_levels", f"{TREE} SELECT table_id, level, pos, hash FROM tree")
def merkle_levels(spark, d):
    return merkle.merkle_tree(run_leaves(spark, d), RUN)


@query("merkle_root", f"{TREE} SELECT table_id, arg_max(hash, level) AS root FROM tree GROUP BY table_id")
def merkle_root(spark, d):
    return merkle.merkle_root(merkle.merkle_tree(run_leaves(spark, d), RUN))


DIFF = f"""WITH {RUNS}, n AS (SELECT run_id AS table_id, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos, seq, {LEAF} AS a,
 sha1(CASE WHEN seq % 97 = 5 THEN 'changed' ELSE key || ':' || seq::VARCHAR || ':' || tombstone::VARCHAR END) AS b FROM runs)"""


@query("merkle_diff", f"{DIFF} SELECT table_id, pos, a AS hash_left, b AS hash_right FROM n WHERE a <> b")
def merkle_diff(spark, d):
    return merkle.merkle_diff(run_leaves(spark, d), run_leaves(spark, d, "changed"))


@query("merkle_verify", f"{DIFF} SELECT table_id, count(*) AS n_leaves, count(*) FILTER (a <> b) AS n_diff FROM n GROUP BY table_id")
def merkle_verify(spark, d):
    return merkle.verify(run_leaves(spark, d), run_leaves(spark, d, "changed"))


# Text similarity

SPACE_SQL = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKENS = rf"""tok AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '\p{{P}}', '', 'g'), '{SPACE_SQL}')) AS w FROM documents) WHERE strlen(w) >= 3)"""
BITS = f"""{TOKENS}, h AS (SELECT doc_id, md5(w) AS d FROM tok),
 parts AS (SELECT doc_id, k, (('0x' || substr(d, 1 + 8 * k, 8))::BIGINT) AS x FROM h, (SELECT unnest(range(4)) AS k)),
 sums AS (SELECT doc_id, k, {', '.join(f'sum((x >> {31 - i}) & 1) AS s{i}' for i in range(32))}, count(*) AS n FROM parts GROUP BY doc_id, k),
 words AS (SELECT doc_id, k, {' + '.join(f'(CASE WHEN 2 * s{i} > n THEN {1 << (31 - i)}::HUGEINT ELSE 0 END)' for i in range(32))} AS v FROM sums),
 halves AS (SELECT doc_id, sum(CASE k WHEN 0 THEN v * 4294967296 WHEN 1 THEN v ELSE 0 END) AS hi, sum(CASE k WHEN 2 THEN v * 4294967296 WHEN 3 THEN v ELSE 0 END) AS lo FROM words GROUP BY doc_id),
 prints AS (SELECT doc_id, (CASE WHEN hi >= 9223372036854775808 THEN hi - 18446744073709551616 ELSE hi END)::BIGINT AS hi,
  (CASE WHEN lo >= 9223372036854775808 THEN lo - 18446744073709551616 ELSE lo END)::BIGINT AS lo
  FROM (SELECT d.doc_id, coalesce(h.hi, 0) AS hi, coalesce(h.lo, 0) AS lo FROM documents d LEFT JOIN halves h ON h.doc_id = d.doc_id))"""


@query("simhash_tokens", f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM tok GROUP BY doc_id")
def simhash_tokens(spark, d):
    t = simhash.tokens(F.col("text"))
    return (table(spark, d, "documents").select("doc_id", t.alias("t")).filter("size(t) > 0")
            .select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct")))


@query("simhash", f"WITH {BITS} SELECT doc_id, hi, lo FROM prints")
def simhash_prints(spark, d):
    return simhash.fingerprints(table(spark, d, "documents"), "doc_id", "text")


@query("hamming_pairs", f"""WITH {BITS}, reps AS (SELECT hi, lo, min(doc_id) AS doc_id FROM prints GROUP BY hi, lo)
 SELECT a.doc_id AS left_id, b.doc_id AS right_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance
 FROM reps a JOIN reps b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3""")
def hamming_pairs(spark, d):
    return simhash.near_pairs(simhash_prints(spark, d), "doc_id", 3)


@query("simhash_lookup", f"WITH {BITS} SELECT p.doc_id, (bit_count(xor(p.hi, q.hi)) + bit_count(xor(p.lo, q.lo)))::INT AS distance FROM prints p, (SELECT * FROM prints ORDER BY doc_id LIMIT 1) q")
def simhash_lookup(spark, d):
    """Distance of every stored fingerprint to one text's."""
    prints = simhash_prints(spark, d)
    first = table(spark, d, "documents").agg(F.min("doc_id").alias("doc_id"))
    one = simhash.fingerprints(table(spark, d, "documents").join(F.broadcast(first), "doc_id"), "doc_id", "text")
    q = one.select(F.struct("hi", "lo")).scalar()
    return prints.select("doc_id", simhash.hamming(F.col("hi"), F.col("lo"), q["hi"], q["lo"]).cast("int").alias("distance"))


@query("simhash_bytes", f"WITH {BITS} SELECT doc_id, lpad(hex(hi), 16, '0') || lpad(hex(lo), 16, '0') AS bytes FROM prints")
def simhash_bytes(spark, d):
    return simhash_prints(spark, d).select("doc_id", codec.simhash_hex(F.col("hi"), F.col("lo")).alias("bytes"))


@query("digest_bits", "SELECT doc_id, array_to_string(list_transform(range(1, 33, 2), lambda i: bin(('0x' || substr(md5(text), i, 2))::INT)), '') AS bits FROM documents")
def digest_bits(spark, d):
    return table(spark, d, "documents").select("doc_id", simhash.bit_string(F.md5("text")).alias("bits"))


# Sketches

BLOOM_M, BLOOM_K = bloom.bloom_size(RUN, 0.01)
ELEMENTS = "e AS (SELECT event_type AS name, 'user_' || lpad(user_id::VARCHAR, 6, '0') AS element FROM events)"


def elements(spark, d):
    return kv(spark, d).select(F.col("event_type").alias("name"), F.col("key").alias("element"))


def seeded_sql(col: str, m: int) -> str:
    return f"(('0x' || substr(md5(encode({col}) || unhex(lpad(printf('%x', {SEED} + i), 8, '0') || repeat('00', 28))), 1, 16))::UBIGINT % {m})::BIGINT"


@query("bloom_params", "SELECT n, m, ceil(m / nullif(n, 0) * ln(2))::BIGINT AS k FROM (SELECT o_orderkey AS n, ceil(o_orderkey * abs(ln(0.01)) / pow(ln(2), 2))::BIGINT AS m FROM orders)")
def bloom_params(spark, d):
    n = F.col("o_orderkey")
    sized = table(spark, d, "orders").select(n.alias("n"), F.ceil(n * F.abs(F.log(F.lit(0.01))) / F.pow(F.log(F.lit(2.0)), 2)).alias("m"))
    return sized.withColumn("k", F.ceil(F.col("m") / F.nullif(F.col("n"), F.lit(0)) * F.log(F.lit(2.0))))


POSITIONS = f"pos AS (SELECT DISTINCT name, {seeded_sql('element', BLOOM_M)} AS pos FROM e, (SELECT unnest(range({BLOOM_K})) AS i))"


@query("bloom_positions", f"WITH {ELEMENTS}, {POSITIONS} SELECT name, pos FROM pos")
def bloom_positions(spark, d):
    return bloom.build(elements(spark, d).distinct(), "name", "element", BLOOM_M, BLOOM_K, SEED)


PROBE = "p AS (SELECT DISTINCT 'user_' || lpad(c_custkey::VARCHAR, 6, '0') AS element FROM customer)"


@query("bloom_check", f"""WITH {ELEMENTS}, {POSITIONS}, {PROBE}, w AS (SELECT element, {seeded_sql('element', BLOOM_M)} AS pos FROM p, (SELECT unnest(range({BLOOM_K})) AS i))
 SELECT name, element FROM w JOIN pos USING (pos) GROUP BY name, element HAVING count(*) = {BLOOM_K}""")
def bloom_check(spark, d):
    built = bloom.build(elements(spark, d).distinct(), "name", "element", BLOOM_M, BLOOM_K, SEED)
    probes = table(spark, d, "customer").select(F.concat(F.lit("user_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("element"))
    return bloom.check(built, probes, "name", "element", BLOOM_M, BLOOM_K, SEED)


@query("bloom_prune_tables", f"""WITH {RUNS}, t AS (SELECT DISTINCT run_id, {seeded_sql('key', BLOOM_M)} AS pos FROM runs, (SELECT unnest(range({BLOOM_K})) AS i)),
 w AS (SELECT {seeded_sql("'user_000042'", BLOOM_M)} AS pos FROM (SELECT unnest(range({BLOOM_K})) AS i))
 SELECT run_id, 'user_000042' AS key FROM w JOIN t USING (pos) GROUP BY run_id HAVING count(*) = {BLOOM_K}""")
def bloom_prune_tables(spark, d):
    built = bloom.build(runs(spark, d), "run_id", "key", BLOOM_M, BLOOM_K, SEED)
    probe = spark.range(1).select(F.lit("user_000042").alias("key"))
    return bloom.check(built, probe, "run_id", "key", BLOOM_M, BLOOM_K, SEED)


P = 10
FNV_SQL = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(element) + 1), lambda i: ascii(substr(element, i, 1))::HUGEINT)),
 lambda h, b: xor((h * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, b))"""
REGS = f"""{ELEMENTS}, h AS (SELECT name, {FNV_SQL} AS h FROM (SELECT DISTINCT * FROM e)),
 regs AS (SELECT name, (h // {1 << (64 - P)})::INT AS register, max(1 + bit_count(xor(h, h - 1)::HUGEINT) - 1)::INT AS rank FROM h GROUP BY ALL)"""


@query("hll_registers", f"WITH {REGS} SELECT name, register, rank FROM regs")
def hll_registers(spark, d):
    return hll.registers(elements(spark, d).distinct(), "name", "element", P)


ALPHA_MM = 0.7213 / (1 + 1.079 / (1 << P)) * (1 << P) ** 2


@query("hll_estimate", f"""WITH {REGS}, s AS (SELECT name, sum(pow(2.0, -rank)) AS s, {1 << P} - count(*) AS empty FROM regs GROUP BY name), r AS (SELECT *, {ALPHA_MM!r}::DOUBLE / (s + empty) AS raw FROM s)
 SELECT name, round(CASE WHEN raw <= 2.5 * {1 << P} AND empty > 0 THEN {1 << P} * ln({1 << P}::DOUBLE / empty) ELSE raw END, 6) AS estimate FROM r""")
def hll_estimate(spark, d):
    return hll.estimate(hll_registers(spark, d), "name", P).select("name", F.round("estimate", 6).alias("estimate"))


@query("hll_clear", f"WITH {REGS} SELECT name, register, rank FROM regs WHERE name <> 'error'")
def hll_clear(spark, d):
    return hll.clear(hll_registers(spark, d), "name", "error")


def dense_sql(cells: str, n: int, width: int, head: str) -> str:
    """Sketch bytes in hex of a relation ``cells`` (name, slot, held)."""
    return f"""all_slots AS (SELECT name, slot FROM (SELECT DISTINCT name FROM {cells}), (SELECT unnest(range({n})) AS slot))
 SELECT name, '{head}' || string_agg({le_sql('coalesce(held, 0)', width)}, '' ORDER BY slot) AS bytes FROM all_slots LEFT JOIN {cells} USING (name, slot) GROUP BY name"""


HLL_HEAD = codec.number_hex(1 << P) + f"{P:02X}"


@query("hll_bytes", f"WITH {REGS}, c AS (SELECT name, register AS slot, rank AS held FROM regs), {dense_sql('c', 1 << P, 1, HLL_HEAD)}")
def hll_bytes(spark, d):
    body = codec.dense_hex(hll_registers(spark, d), "name", F.col("register"), F.col("rank"), 1 << P, 1)
    return body.select("name", F.concat(F.lit(HLL_HEAD), "body").alias("bytes"))


SEEDS = [(SEED + i).to_bytes(4, "big") + bytes(28) for i in range(BLOOM_K)]
BLOOM_HEAD = codec.number_hex(BLOOM_K, BLOOM_M)


@query("bloom_bytes", f"WITH {ELEMENTS}, {POSITIONS}, c AS (SELECT name, pos AS slot, 1 AS held FROM pos), f AS (WITH {dense_sql('c', BLOOM_M, 1, BLOOM_HEAD)}) SELECT name, bytes || '{codec.seeds_hex(SEEDS)}' AS bytes FROM f")
def bloom_bytes(spark, d):
    body = codec.dense_hex(bloom_positions(spark, d), "name", F.col("pos"), F.lit(1), BLOOM_M, 1)
    return body.select("name", F.concat(F.lit(BLOOM_HEAD), "body", F.lit(codec.seeds_hex(SEEDS))).alias("bytes"))


@query("hll_builtin")
def hll_builtin(spark, d):
    return hll.builtin(elements(spark, d), "name", "element")


CMS_M, CMS_K = cms.cms_size(0.01, 0.05)
CELLS = f"cells AS (SELECT name, i::INT AS row, {seeded_sql('element', CMS_M)} AS col, count(*) AS cnt FROM e, (SELECT unnest(range({CMS_K})) AS i) GROUP BY ALL)"


@query("cms_cells", f'WITH {ELEMENTS}, {CELLS} SELECT name, "row", col, cnt FROM cells')
def cms_cells(spark, d):
    return cms.cells(elements(spark, d), "name", "element", CMS_M, CMS_K, SEED)


CMS_HEAD = codec.number_hex(CMS_K, CMS_M) + codec.seeds_hex([(SEED + i).to_bytes(4, "big") + bytes(28) for i in range(CMS_K)])


@query("cms_bytes", f"WITH {ELEMENTS}, {CELLS}, c AS (SELECT name, row * {CMS_M} + col AS slot, cnt AS held FROM cells), {dense_sql('c', CMS_K * CMS_M, 4, CMS_HEAD)}")
def cms_bytes(spark, d):
    body = codec.dense_hex(cms_cells(spark, d), "name", F.col("row") * CMS_M + F.col("col"), F.col("cnt"), CMS_K * CMS_M, 4)
    return body.select("name", F.concat(F.lit(CMS_HEAD), "body").alias("bytes"))


@query("cms_estimate", f"""WITH {ELEMENTS}, {CELLS}, w AS (SELECT name, element, i::INT AS row, {seeded_sql('element', CMS_M)} AS col FROM (SELECT DISTINCT * FROM e), (SELECT unnest(range({CMS_K})) AS i))
 SELECT w.name, w.element, min(cnt) AS frequency FROM w JOIN cells c ON w.name = c.name AND w.row = c.row AND w.col = c.col GROUP BY ALL""")
def cms_estimate(spark, d):
    return cms.estimates(cms_cells(spark, d), elements(spark, d), "name", "element", CMS_M, CMS_K, SEED)


@query("cms_builtin")
def cms_builtin(spark, d):
    return cms.builtin(elements(spark, d), "name", "element", 0.01, 0.05, 42)


# Records and the log

DICT = f"{KV}, dict AS (SELECT key, row_number() OVER (ORDER BY min(seq)) - 1 AS key_id FROM kv GROUP BY key)"


@query("dictionary_encode", f"WITH {DICT} SELECT key_id, key FROM dict")
def dictionary_encode(spark, d):
    return tables.key_dictionary(kv(spark, d))


@query("compressed_table", f"WITH {STATE} SELECT key, seq, value, tombstone FROM newest")
def compressed_table(spark, d):
    """A table written with a stored key dictionary, in two steps that share it, and read back."""
    rows = access.newest_versions(kv(spark, d)).select("key", "seq", "value", "tombstone")
    path, names = scratch_dir(spark, "compressed"), scratch_dir(spark, "dictionary")
    tables.grown_dictionary(kv(spark, d).filter("tombstone"), names)
    tables.write_compressed(rows, path, names)
    return tables.read_compressed(spark, path, names)


def varint_sql(x: str) -> str:
    return f"(ceil(length(bin({x})) / 7.0))"


@query("record_size", f"""WITH {DICT}, k AS (SELECT kv.*, key_id FROM kv JOIN dict USING (key))
 SELECT seq, (CASE WHEN tombstone THEN 21 + strlen(key) ELSE 29 + strlen(key) + strlen(props) END)::INT AS plain,
 (5 + {varint_sql('ts')} + {varint_sql('key_id')} + CASE WHEN tombstone THEN 0 ELSE {varint_sql('strlen(props)')} + strlen(props) END)::INT AS compressed FROM k""")
def record_size(spark, d):
    k = kv(spark, d).join(tables.key_dictionary(kv(spark, d)), "key")
    return k.select("seq", codec.plain_size(F.col("key"), F.col("props"), F.col("tombstone")).alias("plain"),
                    codec.compressed_size(F.col("ts"), F.col("key_id"), F.col("props"), F.col("tombstone")).alias("compressed"))


@query("record_codec", f"""WITH {KV} SELECT seq, {le_sql(f"xor({CRC_SQL.format('props')}, 4294967295::BIGINT)", 4)} || {le_sql('ts', 8)} || CASE WHEN tombstone THEN '01' ELSE '00' END
 || {le_sql('strlen(key)', 8)} || {le_sql('strlen(props)', 8)} || hex(encode(key)) || hex(encode(props)) AS record FROM kv""")
def record_codec(spark, d):
    k = kv(spark, d)
    return k.select("seq", codec.record_hex(F.crc32("props"), F.col("ts"), F.col("tombstone"), F.col("key"), F.col("props")).alias("record"))


def uvarint_sql(x: str) -> str:
    n = f"{varint_sql(x)}::INT"
    return f"array_to_string(list_transform(range({n}), lambda i: lpad(printf('%X', ((({x})::BIGINT >> (7 * i)) & 127) + CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END), 2, '0')), '')"


@query("compressed_codec", f"""WITH {DICT}, k AS (SELECT kv.*, key_id FROM kv JOIN dict USING (key))
 SELECT seq, {le_sql(f"xor({CRC_SQL.format('props')}, 4294967295::BIGINT)", 4)} || {uvarint_sql('ts')} || CASE WHEN tombstone THEN '01' || {uvarint_sql('key_id')}
 ELSE '00' || {uvarint_sql('strlen(props)')} || {uvarint_sql('key_id')} || hex(encode(props)) END AS record FROM k""")
def compressed_codec(spark, d):
    k = kv(spark, d).join(tables.key_dictionary(kv(spark, d)), "key")
    return k.select("seq", codec.compressed_hex(F.crc32("props"), F.col("ts"), F.col("tombstone"), F.col("key_id"), F.col("props")).alias("record"))


SEG = 10000
SEGS = f"""{KV}, s0 AS (SELECT seq, 29 + strlen(key) + strlen(props) AS size FROM kv),
 s1 AS (SELECT seq, size, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s0),
 segs AS (SELECT seq, size, start, start // {SEG} AS segment, (start + size - 1) // {SEG} AS last_segment FROM s1)"""


def wal_log(spark, d):
    return kv(spark, d).select("seq", "ts", "key", F.col("props").alias("value"), "tombstone")


@query("wal_segments", f"WITH {SEGS} SELECT seq, size, start, segment, last_segment FROM segs")
def wal_segments(spark, d):
    return wal.segments(wal_log(spark, d), SEG).select("seq", "size", "start", "segment", "last_segment")


@query("wal_spans", f"""WITH {SEGS} SELECT (seq // {RUN})::INT AS run_id, min(segment) AS start_segment, min(start) % {SEG} AS start_offset, max(last_segment) AS end_segment,
 (max(start + size) - 1) % {SEG} + 1 AS end_offset FROM segs GROUP BY 1""")
def wal_spans(spark, d):
    return wal.memtable_spans(wal_log(spark, d), SEG, RUN)


@query("wal_retention", f"WITH {SEGS} SELECT seq, segment FROM segs WHERE segment > 20")
def wal_retention(spark, d):
    return wal.retain(wal.segments(wal_log(spark, d), SEG), 20).select("seq", "segment")


@query("wal_replay", f"WITH {KV} SELECT key, max(seq) AS seq FROM kv WHERE seq % 10 <> 7 GROUP BY key")
def wal_replay(spark, d):
    """Every tenth checksum is broken; replay skips those records."""
    log = wal_log(spark, d).withColumn("crc", F.when(F.col("seq") % 10 == 7, F.lit(0)).otherwise(F.crc32("value")))
    return access.newest_versions(wal.replay(log)).select("key", "seq")


@query("wal_binary", f"WITH {KV} SELECT ts, key, tombstone, props AS value, xor({CRC_SQL.format('props')}, 4294967295::BIGINT) AS crc FROM kv")
def wal_binary(spark, d):
    """The log as binary segment files, read back with its checksums verified."""
    folder = scratch_dir(spark, "wal-binary")
    wal.write_binary_segments(wal_log(spark, d), folder, SEG)
    return wal.replay(wal.read_segments(spark, folder)).select("ts", "key", "tombstone", F.col("value").cast("string").alias("value"), "crc")


# Request control

TB_SIZE, TB_SECONDS = 3, 3 * 86400


@query("token_bucket", f"""WITH RECURSIVE o AS (SELECT event_id AS seq, user_id, epoch(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 b AS (SELECT user_id, rn, seq, {TB_SIZE - 1} AS left_, ts AS refreshed, true AS accepted FROM o WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.rn, o.seq, CASE WHEN left_ > 0 THEN left_ - 1 WHEN o.ts - refreshed >= {TB_SECONDS} THEN {TB_SIZE - 1} ELSE 0 END,
 CASE WHEN left_ <= 0 AND o.ts - refreshed >= {TB_SECONDS} THEN o.ts ELSE refreshed END, left_ > 0 OR o.ts - refreshed >= {TB_SECONDS}
 FROM b JOIN o ON o.user_id = b.user_id AND o.rn = b.rn + 1)
 SELECT seq, 'user_' || lpad(user_id::VARCHAR, 6, '0') AS key, accepted FROM b""")
def token_bucket(spark, d):
    return control.token_bucket(requests(table(spark, d, "events")), TB_SIZE, TB_SECONDS)


@query("token_bucket_billable", f"""WITH RECURSIVE o AS (SELECT event_id AS seq, user_id, epoch(ts) AS ts, event_type <> 'error' AS paid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 b AS (SELECT user_id, rn, seq, CASE WHEN paid THEN {TB_SIZE - 1} ELSE {TB_SIZE} END AS left_, ts AS refreshed, true AS accepted FROM o WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.rn, o.seq, CASE WHEN NOT paid THEN left_ WHEN left_ > 0 THEN left_ - 1 WHEN o.ts - refreshed >= {TB_SECONDS} THEN {TB_SIZE - 1} ELSE 0 END,
 CASE WHEN paid AND left_ <= 0 AND o.ts - refreshed >= {TB_SECONDS} THEN o.ts ELSE refreshed END, NOT paid OR left_ > 0 OR o.ts - refreshed >= {TB_SECONDS}
 FROM b JOIN o ON o.user_id = b.user_id AND o.rn = b.rn + 1)
 SELECT seq, 'user_' || lpad(user_id::VARCHAR, 6, '0') AS key, accepted FROM b""")
def token_bucket_billable(spark, d):
    """Errors stand for the engine's own calls, which cost no token."""
    events = table(spark, d, "events")
    return control.token_bucket(requests(events).join(events.select(F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("billable")), "seq"), TB_SIZE, TB_SECONDS)


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"))


@query("lru_hits", """WITH t AS (SELECT event_type AS shard, event_id AS seq, user_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id))
 SELECT a.shard, a.seq, a.user_id::VARCHAR AS key, a.prev IS NOT NULL AND count(b.seq) < 12 AS hit FROM t a
 LEFT JOIN t b ON b.shard = a.shard AND b.seq > a.prev AND b.seq < a.seq AND (b.nxt IS NULL OR b.nxt > a.seq) GROUP BY a.shard, a.seq, a.user_id, a.prev""")
def lru_hits(spark, d):
    trace = table(spark, d, "events").select(F.col("event_type").alias("shard"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return control.lru_trace(trace, 12)


# Streaming

@query("stream_upsert", f"WITH {STATE} SELECT key, seq, value FROM state")
def stream_upsert(spark, d):
    return upsert.run_upsert(events_log(upsert.parquet_stream(spark, d, "events"))).select("key", "seq", "value")


@query("stream_token_bucket", ORACLES["token_bucket"])
def stream_token_bucket(spark, d):
    return upsert.run_token_bucket(requests(upsert.parquet_stream(spark, d, "events")), TB_SIZE, TB_SECONDS)
