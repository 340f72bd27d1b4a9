"""The user API from end to end in a folder of its own."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from siltbed.config import EngineConfig
from siltbed.engine import Engine, TooManyRequests
from siltbed.operators import access, merkle
from siltbed.sources import wal

ROOMY = EngineConfig(token_bucket_maxsize=10_000, memtable_size=50)


def words(spark, text):
    return spark.createDataFrame([(w,) for w in text.split()], "element string")


def test_keys(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/db", ROOMY)
    assert db.get("a") is None and db.delete("a") is None
    db.put_many(spark.range(1, 100).select(F.concat(F.lit("test"), F.col("id").cast("string")).alias("key"), F.col("id").cast("string").alias("value")))
    db.delete_many(spark.range(4, 100, 4).select(F.concat(F.lit("test"), F.col("id").cast("string")).alias("key")))
    page = [(r.ordinal, r.key) for r in db.range_scan("test3", "test9").collect()]
    assert page[0] == (1, "test3") and page[-1] == (10, "test41") and db.prefix_scan("test", 8).count() == 5
    assert db.get("test4") is None and db.delete("test5") == "5" and db.get("test5") is None and db.put("test5", "") and db.get("test5") == ""
    assert [r.key for r in db.range_iter("test97", "test99")] == ["test97", "test98", "test99"]
    assert sum(1 for _ in db.prefix_iter("test")) == 75
    twice = spark.createDataFrame([("x", "new", 2), ("x", "old", 1), ("y", "1", 3)], "key string, value string, order int")
    db.put_many(twice)
    assert {r.key: r.value for r in db.get_many(twice).collect()} == {"x": "new", "y": "1"}
    seqs = [r.seq for r in db.read("log").orderBy("seq").collect()]
    assert seqs == list(range(seqs[0], seqs[0] + len(seqs))) and seqs[0] <= db.upto
    db.put_many(twice.limit(0))
    with pytest.raises(ValueError):
        db.put("bf_x", "1")
    with pytest.raises(ValueError):
        db.put_many(spark.createDataFrame([("tb_x", "1")], "key string, value string"))
    with pytest.raises(ValueError):
        db.range_scan("b", "a")


def numbers(spark, n, keys):
    """Puts of key test{i % keys} and value i, for i from 1 to n."""
    i = F.col("id")
    return spark.range(1, n + 1).select(F.concat(F.lit("test"), (i % keys).cast("string")).alias("key"), i.cast("string").alias("value"), i.alias("order"))


@pytest.mark.parametrize("sized,one_file,compression", [(True, False, False), (False, True, True)])
def test_life_of_rows(spark, tmp_path, sized, one_file, compression):
    config = dataclasses.replace(ROOMY, memtable_size=20, memtable_number=2, wal_size=64, level_count=3, level_num=2, t=2, sized_compaction=sized, one_file=one_file, compression=compression)
    db = Engine(spark, f"file://{tmp_path}/db", config)
    state = {}
    for step in range(4):
        db.put_many(numbers(spark, 90, 33 + 10 * step))
        state |= {f"test{i % (33 + 10 * step)}": str(i) for i in range(1, 91)}
        db.delete_many(spark.createDataFrame([(f"test{step}",)], "key string"))
        state.pop(f"test{step}")
    assert db.upto > 200 and db.rest().count() < 100 and db.tables
    assert db.read("log").agg(F.min("seq")).first()[0] >= db.upto - db.upto % 64  # segments below the tables' mark are gone
    got = {r.key: r.value for r in db.range_iter("a", "z")}
    assert got == state
    again = Engine(spark, f"file://{tmp_path}/db", config)
    assert {r.key: r.value for r in again.get_many(spark.createDataFrame([(k,) for k in [*state, "none"]], "key string")).collect()} == state
    assert again.get("test7") == state["test7"] and again.get("test7") == state["test7"] and again.hits == 1
    assert again.delete("test7") == state["test7"] and again.get("test7") is None and again.put("test7", "x") and again.get("test7") == "x"
    assert again.get("zzz") is None and again.prune_checked[0] == 0 < again.prune_checked[1]  # no table's range holds it
    found = again.verify().collect()
    assert len(found) == len(again.tables) and all(r.n_diff == 0 and r.n_leaves for r in found)
    if not sized:
        for level in {t["level"] for t in again.tables} - {1}:
            held = again._contents([t for t in again.tables if t["level"] == level])
            assert held.count() == held.select("key").distinct().count()  # below the first level a key is in one table
    one = again.tables[0]["table_id"]
    bad = again._contents([again.tables[0]]).withColumn("table_id", F.lit(one).cast("long")).withColumn("value", F.lit("changed"))
    kept = spark.read.schema("table_id long, level int, pos long, hash string").parquet(f"file://{tmp_path}/db/trees/id={one}")
    assert merkle.verify(kept, again._leaves(bad)).first().n_diff > 0


def test_hot_and_wide_keys(spark, tmp_path):
    """A hundred thousand puts of 100 keys fill no memtable; of 50,000 keys they fill many."""
    db = Engine(spark, f"file://{tmp_path}/hot", EngineConfig())
    db.put_many(numbers(spark, 100_000, 100))
    got = {r.key: int(r.value) for r in db.range_iter("test", "testz")}
    assert len(got) == 100 and (got["test0"], got["test1"], got["test99"], sum(got.values())) == (100_000, 99_901, 99_999, 9_995_050) and not db.tables
    wide = Engine(spark, f"file://{tmp_path}/wide", dataclasses.replace(EngineConfig(), memtable_size=10_000))
    wide.put_many(numbers(spark, 100_000, 50_000))
    row = access.latest_state(wide.rows()).agg(F.count("*"), F.sum(F.col("value").cast("long"))).first()
    assert tuple(row) == (50_000, 3_750_025_000) and wide.tables and wide.upto == 100_000
    assert (wide.get("test0"), wide.get("test1"), wide.get("test49999")) == ("100000", "50001", "99999")


def test_sketches(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/db", ROOMY)
    assert db.bloom_create("b", 100, 0.01) and not db.bloom_create("b", 5, 0.1)
    db.bloom_add("b", words(spark, "apple banana apple"))
    db.bloom_add("b", "cherry")
    assert {r.element: r.maybe for r in db.bloom_check("b", words(spark, "apple cherry kiwi")).collect()} == {"apple": True, "cherry": True, "kiwi": False}
    assert db.bloom_delete("b") and not db.bloom_delete("b") and db.bloom_create("b", 100, 0.01)
    assert not db.bloom_check("b", "apple").first().maybe
    assert db.hll_create("h", 10) and db.hll_estimate("h") == 0.0
    db.hll_add("h", words(spark, "vanja vanja kostic"))
    db.hll_add("h", words(spark, "sv292022 asdfghjkl vanja"))
    assert abs(db.hll_estimate("h") - 4.007833) < 1e-6 and db.hll_delete("h")
    assert db.cms_create("c", 0.05, 0.05)
    db.cms_add("c", words(spark, "apple banana apple"))
    db.cms_add("c", words(spark, "cherry banana"))
    got = {r.element: r.frequency for r in db.cms_frequency("c", words(spark, "apple banana cherry orange")).collect()}
    assert got == {"apple": 2, "banana": 2, "cherry": 1, "orange": 0} and db.cms_delete("c")
    with pytest.raises(KeyError):
        db.cms_add("c", "apple")
    with pytest.raises(ValueError):
        db.hll_create("h", 3)


def test_fingerprints_and_bucket(spark, tmp_path):
    now = [1000.0]
    small = dataclasses.replace(ROOMY, token_bucket_maxsize=3)
    db = Engine(spark, f"file://{tmp_path}/db", small, clock=lambda: now[0])
    assert db.simhash_store("one two three four") and not db.simhash_store("one two three four")
    assert db.simhash_distance("one two three four", "four three two one") == 0
    with pytest.raises(TooManyRequests):
        db.get("a")
    assert db.range_scan("a", "z").count() == 0  # scans cost nothing, and the engine's keys are hidden
    db.close()
    again = Engine(spark, f"file://{tmp_path}/db", ROOMY, clock=lambda: now[0])
    assert (again.bucket.size, again.bucket.left) == (3, 0)
    with pytest.raises(TooManyRequests):
        again.get("a")
    now[0] += 60
    assert again.get("a") is None and json.loads(again._value("sh_one two three four"))


def test_replay_keeps_deletes(spark):
    log = spark.createDataFrame([(1, "a", "x", False), (2, "a", None, True), (3, "b", "y", False)], "seq long, key string, value string, tombstone boolean")
    sums = log.withColumn("crc", F.crc32(F.coalesce("value", F.lit(""))))
    assert wal.replay(sums).count() == 3
    assert wal.replay(sums.withColumn("crc", F.col("crc") + F.when(F.col("seq") == 3, 1).otherwise(0))).count() == 2
