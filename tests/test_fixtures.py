"""Known inputs and results of the single operators."""

import hashlib
import random
import shutil
import zlib

import pytest
from pyspark.sql import functions as F

from siltbed.config import EngineConfig, load_config, parse_duration
from siltbed.functions import bloom, cms, codec, hll
from siltbed.functions.hashing import seeded_position
from siltbed.operators import access, compaction, control, merkle, order
from siltbed.sources import wal

LOG = "seq long, ts long, key string, value string, tombstone boolean"


def log(spark, ops):
    return spark.createDataFrame([(k, k, key, v, v is None) for k, (key, v) in enumerate(ops)], LOG)


def test_puts_deletes_and_scans(spark):
    ops = []
    for k in range(1, 100):
        ops.append((f"test{k}", str(k)))
        if k % 4 == 0:
            ops.append((f"test{k}", None))
    df = log(spark, ops)
    assert access.latest_state(df).count() == 75
    assert access.point_get(df, "test4").count() == 0 and access.point_get(df, "test5").first().value == "5"
    page = [r.key for r in access.page(access.range_scan(df, "test3", "test9"), 10, 1).collect()]
    assert page == "test3 test30 test31 test33 test34 test35 test37 test38 test39 test41".split()
    assert access.range_scan(df, "test3", "test8").count() == 42 and access.range_scan(df, "z", "a").count() == 0
    assert [r.key for r in access.page(access.prefix_scan(df, "test"), 10, 1).collect()][-1] == "test2"


def test_odd_keys(spark):
    df = log(spark, [("k", None), ("k", ""), ("{x", "1"), ("a", "2"), ("aЖ", "3"), ("bf_x", "4"), ("k2", "5"), ("k2", None), ("k2", "6")])
    assert {r.key: r.value for r in access.user_keys(access.latest_state(df)).collect()} == {"k": "", "{x": "1", "a": "2", "aЖ": "3", "k2": "6"}
    assert access.prefix_scan(df, "a").count() == 2 and access.prefix_scan(df, "a", legacy_bound=True).count() == 1


def test_compaction_keeps_the_state(spark):
    df = spark.range(1, 3001).select(F.col("id").alias("seq"), F.col("id").alias("ts"), F.concat(F.lit("k"), (F.col("id") * 7 % 211).cast("string")).alias("key"),
                                     F.col("id").cast("string").alias("value"), (F.col("id") % 5 == 0).alias("tombstone"))
    want = sorted(map(tuple, access.latest_state(df).select("key", "value").collect()))
    runs = compaction.flush_runs(compaction.assign_runs(df, 100))
    tiered = compaction.size_tiered(runs, 3, 4).drop("level", "table_num")
    levels = compaction.leveled(runs.withColumn("level", F.lit(1)), EngineConfig(level_count=3, level_num=2, t=2)).drop("level", "table_num")
    for one in (runs.drop("run_id"), tiered, levels):
        assert sorted(map(tuple, access.latest_state(one).select("key", "value").collect())) == want


def test_sketch_sizes_and_values(spark):
    assert bloom.bloom_size(100, 0.2) == (335, 3) and bloom.bloom_size(1000, 0.01) == (9586, 7) and bloom.bloom_size(10000, 0.01) == (95851, 7)
    assert cms.cms_size(0.05, 0.05) == (55, 4)
    assert spark.range(1).select(seeded_position(F.lit("žš"), 1700000001, 960)).first()[0] == 940
    e = spark.createDataFrame([("n", x) for x in "vanja vanja kostic sv292022 asdfghjkl".split()], "name string, element string")
    regs = hll.registers(e, "name", "element", 10)
    assert {(r.register, r["rank"]) for r in regs.collect()} == {(202, 1), (552, 1), (762, 2), (807, 1)}
    assert abs(hll.estimate(regs, "name", 10).first().estimate - 4.007833) < 1e-6
    with pytest.raises(ValueError):
        hll.registers(e, "name", "element", 3)


def test_merkle_trees(spark):
    def tree(leaves):
        rows = [(1, k, x) for k, x in enumerate(leaves)]
        return merkle.merkle_tree(merkle.merkle_leaves(spark.createDataFrame(rows, "table_id int, pos0 int, data string"), "pos0", "data"), 16)

    a, b = tree(["1", "2", "3", "4", "6", "", "9"]), tree(["1", "2", "2", "4", "5"])
    assert merkle.merkle_root(a).first().root == "59842329bd2be8930dfde01d57800667201d9f70"
    assert merkle.merkle_root(b).first().root == "6d44466cd6bbfd3e6463a83b9d3ff78364c65352"
    assert sorted(r.pos for r in merkle.merkle_diff(a, b).collect()) == [2, 4]


def test_control_and_config(tmp_path):
    bucket = control.Bucket(10, 60, 0)
    assert [bucket.take(1) for _ in range(11)] == [True] * 10 + [False] and bucket.take(61) and bucket.left == 9
    cache = control.LruCache(3)
    for k in ("key1", "key2"):
        cache.insert(k)
    assert [cache.get(k) for k in ("key1", "key2", "key3")] == [True, True, False]
    for k in ("key3", "key4"):
        cache.insert(k)
    assert [cache.get(k) for k in ("key3", "key4", "key1")] == [True, True, False]
    assert parse_duration("1m") == 60 and load_config(tmp_path / "none") == EngineConfig()
    with pytest.raises(ValueError):
        parse_duration("1d")


def test_codecs():
    data = codec.encode_record(5, False, "k", b"v") + codec.encode_record(6, True, "kk", b"")
    assert [(c, t, d, k, v) for c, t, d, k, v, _ in codec.decode_records(data)] == [(zlib.crc32(b"v"), 5, False, "k", b"v"), (0, 6, True, "kk", b"")]
    assert codec.decode_compressed(codec.encode_compressed(300, False, 200, b"abc"))[:4] == (300, False, 200, b"abc")
    assert codec.hll_from_bytes(codec.hll_bytes(4, {3: 2})) == (4, {3: 2})
    assert codec.bloom_from_bytes(codec.bloom_bytes(9, 1, [b"s"], [2, 5])) == (9, 1, [b"s"], [2, 5])
    assert codec.cms_from_bytes(codec.cms_bytes(2, 3, [b"a", b"b"], {(1, 2): 7})) == (2, 3, [b"a", b"b"], {(1, 2): 7})
    assert codec.bucket_from_bytes(codec.bucket_bytes(1, 2, 3, 4)) == (1, 2, 3, 4)
    levels = [[b"a"] * 6, [b"b"] * 4, [b"c"] * 2, [b"d"]]
    assert codec.merkle_from_bytes(codec.merkle_bytes(levels)) == levels


def test_merkle_blocks_agree_with_one_pass(spark, monkeypatch):
    rows = [(t, f"{k:04d}", str(k * t)) for t, n in ((1, 1), (2, 2), (3, 5), (4, 8), (5, 9), (6, 33), (7, 67)) for k in range(n)]
    leaves = merkle.merkle_leaves(spark.createDataFrame(rows, "table_id int, key string, data string"), "key", "data")
    whole = {tuple(r) for r in merkle.merkle_tree(leaves, 67).collect()}
    monkeypatch.setattr(merkle, "SPAN", 2)
    assert {tuple(r) for r in merkle.merkle_tree(leaves, 67).collect()} == whole
    tree = {(r[0], r[1], r[2]): r[3] for r in whole}
    for (t, level, pos), h in tree.items():
        if level:
            pair = [bytes.fromhex(tree.get((t, level - 1, 2 * pos + k), merkle.EMPTY_SHA1)) for k in (0, 1)]
            assert h == hashlib.sha1(b"".join(hashlib.sha1(x).digest() for x in pair)).hexdigest()
    assert [max(k[1] for k in tree if k[0] == t) for t in range(1, 8)] == [1, 1, 3, 3, 4, 6, 7]


def test_leveled_tables_equal_a_step_by_step_model(spark):
    """Overlapping parts of the next level join the merge, the rest of those tables stays. Tables hold every key of their range."""
    rng = random.Random(4)
    cfg = EngineConfig(level_count=4, level_num=2, t=2)
    tables, rows, seq = {1: {}, 2: {}, 3: {}, 4: {}}, [], 0
    for run in range(33):
        low = rng.randrange(60)
        tables[1][run] = {}
        for k in rng.sample(range(low, low + (n := rng.randint(3, 30))), n):
            rows.append((run, 1, f"k{k:03d}", seq, seq, "v", False))
            tables[1][run][f"k{k:03d}"] = seq
            seq += 1
    number, partial = 33, 0
    for level in (1, 2, 3):
        for _ in range(len(tables[level]) - cfg.level_limit(level)):
            oldest = tables[level].pop(min(tables[level]))
            low, high = min(oldest), max(oldest)
            merged = dict(oldest)
            for n, t in list(tables[level + 1].items()):
                moved = {k: s for k, s in t.items() if low <= k <= high}
                merged = {k: max(merged.get(k, -1), moved.get(k, -1)) for k in {*merged, *moved}}
                left = {k: s for k, s in t.items() if k not in moved}
                partial += bool(moved and left)
                tables[level + 1][n] = left
                if not left:
                    del tables[level + 1][n]
            tables[level + 1][number] = merged
            number += 1
    df = spark.createDataFrame(rows, "run_id int, level int, key string, seq long, ts long, value string, tombstone boolean")
    got = compaction.leveled(df, cfg).select("level", "table_num", "key", "seq").collect()
    assert partial > 3 and sorted(map(tuple, got)) == sorted((lv, n, k, s) for lv, some in tables.items() for n, t in some.items() for k, s in t.items())


def test_leveled_plans_in_order_of_the_merged_tables():
    tables = [compaction.TableInfo(1, k, f"{k * 2:07d}", f"{k * 2 + 1:07d}") for k in range(20_000)]
    steps, pieces, levels = compaction.plan_leveled(tables, EngineConfig(level_count=3, level_num=1, t=1))
    assert len(steps) == 19_999 + 19_998 and len(pieces) == 20_000 and sorted(levels.values())[:2] == [1, 2]


def test_leveled_plans_meet_tables_that_touch():
    """Against sets of (source, point), where odd points lie between keys."""
    for seed in range(120):
        rng = random.Random(seed)
        cfg = EngineConfig(level_count=4, level_num=rng.randint(1, 3), t=rng.randint(1, 2))
        ends = [sorted((rng.randrange(20), rng.randrange(20))) for _ in range(25)]
        levels = {k: {} for k in range(1, 5)}
        levels[1] = {n: {(n, p) for p in range(2 * a, 2 * b + 1)} for n, (a, b) in enumerate(ends)}
        steps, number = [], len(ends)
        for level in (1, 2, 3):
            below = levels[level + 1]
            for pushed in sorted(levels[level])[:max(0, len(levels[level]) - cfg.level_limit(level))]:
                own = levels[level].pop(pushed)
                low, high = min(p for _, p in own), max(p for _, p in own)
                taken = {n: t for n in sorted(below) if (t := {x for x in below[n] if low - low % 2 <= x[1] <= high + high % 2})}
                for n, t in taken.items():
                    own, below[n] = own | t, below[n] - t
                    if not below[n]:
                        del below[n]
                below[number] = own
                steps.append({"level": level, "inputs": [pushed, *taken], "output": number})
                number += 1
        got, pieces, level_of = compaction.plan_leveled([compaction.TableInfo(1, n, f"{a:02d}", f"{b:02d}") for n, (a, b) in enumerate(ends)], cfg)
        assert got == steps and level_of == {n: level for level, some in levels.items() for n in some}
        spots = {(x, n) for some in levels.values() for n, t in some.items() for x in t if x[1] % 2 == 0}
        inside = lambda p, k: (p.low < k or p.low == k and not p.low_open) and (k < p.high or k == p.high and not p.high_open)
        assert {((p.source, 2 * k), p.table) for p in pieces for k in range(20) if inside(p, f"{k:02d}")} == spots


def test_leveled_routes_grow_with_the_steps():
    """Wide tables that begin and end almost alike, of which each step cuts all that went before."""
    rng = random.Random(3)
    tables = [compaction.TableInfo(1, n, f"{rng.randrange(500):05d}", f"{90_000 + rng.randrange(500):05d}") for n in range(3000)]
    plan = compaction.routed_leveled(tables, EngineConfig(level_count=4, level_num=2, t=2))
    assert len(plan.steps) >= 2998 and sum(len(r.ranges) for r in plan.routes.values()) <= 2 * len(plan.steps)


def test_a_single_record_has_a_parent(spark):
    leaves = merkle.merkle_leaves(spark.createDataFrame([(1, "a", "x")], "table_id int, key string, data string"), "key", "data")
    pair = hashlib.sha1(hashlib.sha1(b"x").digest()).digest() + hashlib.sha1(bytes.fromhex(merkle.EMPTY_SHA1)).digest()
    tree = merkle.merkle_tree(leaves, 1)
    assert merkle.merkle_root(tree).first().root == hashlib.sha1(pair).hexdigest() and tree.count() == 2


def test_positions_where_a_group_spans_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.lpad((F.col("id") * 7919 % 5000).cast("string"), 5, "0").alias("k"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
    got = order.carried_forward(order.numbered_rows(rows, ["g"], ["k"]), ["g"], ["k"], "v").collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        last = None
        for i, r in enumerate(mine):
            last = r.v if r.v is not None else last
            assert r.pos == i and r.last == last


def test_runs_by_distinct_keys(spark):
    rng = random.Random(9)
    ops = [(f"k{rng.randrange(40)}", "v") for _ in range(700)]
    got = {r.seq: (r.run_id, r.full) for r in compaction.rotated_runs(log(spark, ops), 25, 4).collect()}
    now, keys, of = 4, set(), {}
    for seq, (key, _) in enumerate(ops):
        of[seq] = now
        keys.add(key)
        if len(keys) == 25:
            now, keys = now + 1, set()
    assert got == {s: (n, n < now) for s, n in of.items()}


def test_empty_keys_are_records(spark):
    data = b"".join(codec.encode_record(5, False, k, b"v") for k in ("a", "", "c"))
    assert [r[3] for r in codec.decode_records(data + bytes(40))] == ["a", "", "c"]
    assert codec.simhash_from_bytes(codec.simhash_bytes(-5, 7)) == (-5, 7)
    held = spark.createDataFrame([(-5, 7)], "hi long, lo long").select(codec.simhash_hex(F.col("hi"), F.col("lo"))).first()[0]
    assert bytes.fromhex(held) == codec.simhash_bytes(-5, 7)


def test_binary_log_by_segments(spark, tmp_path):
    """Records that span segments, empty keys and deletes come back, with the index a segment to a task and without it as one stream."""
    rows = [(k, k + 5, "" if k % 7 == 0 else f"k{k}", None if k % 5 == 0 else "v" * (k * 37 % 400), k % 5 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, LOG)
    folder = f"file://{tmp_path}/wal"
    wal.write_binary_segments(df, folder, 128)
    want = sorted((r[1], r[2], r[4], (r[3] or "").encode()) for r in rows)
    read = lambda: sorted((r.ts, r.key, r.tombstone, bytes(r.value)) for r in wal.replay(wal.read_segments(spark, folder)).collect())
    assert read() == want
    shutil.rmtree(tmp_path / "wal" / "_index")
    assert read() == want
