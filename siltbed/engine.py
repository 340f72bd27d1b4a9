"""The user API: a store of keys, sketches and fingerprints over Parquet tables in one folder.

A write is log rows, adding to a sketch is rows of its cells, and reads combine them. Calls take one key or a DataFrame of many; large
jobs use the latter. Single user calls cost a token of the engine's bucket, scans and bulk calls none. One writer at a time; readers see
whole batches, as Spark commits them.

Life of a row: the log holds it until ``flush`` writes the full runs of the log as sorted tables of level 1 and compacts the levels by the
plan of the settings (size-tiered or leveled); only tables that a step merges are read and written again. A version of the
manifest (a row a table: level, key range, and up to which sequence number the tables hold everything) makes the new tables
count; log segments and tables that no version needs go after it. Reads take the log's rest and the tables whose key range meets what is
asked for; within those, Parquet statistics and bloom filters prune. ``get`` looks into a cache first. Writes flush by themselves when
``memtable_number`` runs may be full.

Folders: ``log/segment=N`` (operations; a segment holds ``wal_size`` sequence numbers), ``batches`` (sequence numbers given out; a row a
batch), ``manifest/version=N``, ``tables/N`` and ``trees/N`` (tables and their Merkle trees), ``dictionary`` (keys by number, where tables are
compressed), ``bloom``, ``hll``, ``cms`` (cells by sketch).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from siltbed.config import EngineConfig
from siltbed.functions import bloom, cms, hll, simhash
from siltbed.log import KV_LOG, RESERVED_PREFIXES, is_reserved
from siltbed.operators import access, catalog, compaction, merkle
from siltbed.operators.control import Bucket, LruCache
from siltbed.operators.order import IN_PARTITION
from siltbed.session import materialize
from siltbed.sources import tables

LAYOUT = {
    "log": KV_LOG.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "),
    "batches": "next long",
    "bloom": "id string, pos long",
    "hll": "id string, register int, rank int",
    "cms": "id string, row int, col long, cnt long",
    "manifest": "table_id long, level int, first_key string, last_key string, n_rows long, upto long, next_id long, version long",
    "tree": "table_id long, level int, pos long, hash string",
}
TABLE = "key string, seq long, ts long, value string, tombstone boolean"
BUCKET_KEY = "tb_token_bucket"
LAST = chr(0x10FFFF)  # no key that begins with a prefix lies behind the prefix and this


class TooManyRequests(RuntimeError):
    """The bucket is empty."""


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), clock: Callable[[], float] = time.time):
        self.spark, self.path, self.config, self.clock = spark, path.rstrip("/"), config, clock
        self.cache, self.values, self.hits, self.prune_checked = LruCache(config.cache_capacity), {}, 0, None
        self._load_manifest()
        saved = self._value(BUCKET_KEY)
        if saved is None:
            self.bucket = Bucket(config.token_bucket_maxsize, config.refill_seconds, clock())
        else:  # a saved bucket overrides the settings
            size, interval, left, refreshed = json.loads(saved)
            self.bucket = Bucket(size, interval, refreshed)
            self.bucket.left = left

    # Storage

    def read(self, name: str) -> DataFrame:
        """One of the tables of ``LAYOUT``; empty before the first write."""
        try:
            return self.spark.read.schema(LAYOUT[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LAYOUT[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _pay(self) -> None:
        if not self.bucket.take(self.clock()):
            raise TooManyRequests

    def _log(self, changes: DataFrame) -> None:
        """Append (key, value, tombstone), numbered after all earlier batches in the order of ``order``, or else of the rows.

        Numbers are dense: partitions are counted first, so no task sorts the batch. They are given out before the rows
        are written; a writer that dies in between leaves a gap and no number twice."""
        if "order" in changes.columns:
            changes = changes.orderBy("order")
        staged = materialize(changes.select("key", "value", "tombstone", F.spark_partition_id().alias("part"),
                                            F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("at")), "engine-batch")
        counts = materialize(staged.groupBy("part").count(), "engine-counts")  # a row a partition
        first = self.read("batches").agg(F.coalesce(F.max("next"), F.lit(0))).first()[0]
        total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if not total:
            return
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select("part", (first + F.coalesce(F.sum("count").over(before), F.lit(0))).alias("base"))
        self._append("batches", self.spark.createDataFrame([(first + total,)], LAYOUT["batches"]))
        rows = staged.join(base, "part").select(
            (F.col("base") + F.col("at")).alias("seq"), F.lit(int(self.clock())).cast("long").alias("ts"), "key", "value", "tombstone")
        rows.withColumn("segment", F.call_function("div", F.col("seq"), F.lit(self.config.wal_size))).write.mode("append").partitionBy("segment").parquet(f"{self.path}/log")
        if first + total >= self.next_flush:
            self.flush()

    def rest(self) -> DataFrame:
        """Rows of the log that no table holds yet."""
        return self.read("log").filter(F.col("seq") >= self.upto)

    def rows(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The log's rest and the tables that may hold keys in [first, last], or all of them."""
        wanted = [t for t in self.tables if first is None or t["first_key"] <= last and t["last_key"] >= first]
        self.prune_checked = (len(wanted), len(self.tables))
        log = self.rest().select("key", "seq", "ts", "value", "tombstone")
        return log.unionByName(self._contents(wanted)) if wanted else log

    def _contents(self, wanted: list[Row]) -> DataFrame:
        paths = [f"{self.path}/tables/{t['table_id']}" for t in wanted]
        if self.config.compression:
            found = self.spark.read.schema(TABLE.replace("key string", "key_id long")).parquet(*paths)
            return found.join(tables.load_dictionary(self.spark, f"{self.path}/dictionary"), "key_id").select("key", "seq", "ts", "value", "tombstone")
        return self.spark.read.schema(TABLE).parquet(*paths)

    def _value(self, key: str) -> str | None:
        if self.cache.get(key):
            self.hits += 1
            return self.values[key]
        row = access.point_get(self.rows(key, key), key).first()
        if row is not None:
            self._remember(key, row["value"])
        return row and row["value"]

    def _remember(self, key: str, value: str | None) -> None:
        """Keep a value that was read or written; a delete leaves a mark."""
        if value is None:
            self.cache.delete(key)
        elif self.config.cache_capacity > 0:
            self.cache.insert(key)
            self.values = {k: v for k, v in self.values.items() if k in self.cache.items} | {key: value}

    def _set(self, key: str, value: str | None) -> None:
        self._log(self.spark.createDataFrame([(key, value, value is None)], "key string, value string, tombstone boolean"))
        self._remember(key, value)

    # Keys

    @staticmethod
    def _check(key: str) -> None:
        if key.startswith(RESERVED_PREFIXES):
            raise ValueError(f"{key!r} begins like the engine's own keys")

    def put(self, key: str, value: str) -> bool:
        self._check(key)
        self._pay()
        self._set(key, value)
        return True

    def get(self, key: str) -> str | None:
        self._check(key)
        self._pay()
        return self._value(key)

    def delete(self, key: str) -> str | None:
        """The old value, or None (and no change) where there was none."""
        self._check(key)
        self._pay()
        old = self._value(key)
        if old is not None:
            self._set(key, None)
        return old

    def put_many(self, changes: DataFrame) -> None:
        """Upsert (key, value); of equal keys the last in the order of a column ``order`` wins. Rows with the engine's own
        keys, or with a null key or value, are refused as a whole batch."""
        self._bulk(changes.withColumn("tombstone", F.lit(False)), F.col("value").isNull())

    def delete_many(self, keys: DataFrame) -> None:
        self._bulk(keys.withColumns({"value": F.lit(None).cast("string"), "tombstone": F.lit(True)}), F.lit(False))

    def _bulk(self, changes: DataFrame, bad) -> None:
        if changes.filter(F.col("key").isNull() | is_reserved(F.col("key")) | bad).limit(1).count():
            raise ValueError("keys must be the user's, and neither keys nor values null")
        self._log(changes)
        self.cache, self.values = LruCache(self.config.cache_capacity), {}  # what a batch changed isn't known here

    def get_many(self, keys: DataFrame) -> DataFrame:
        return access.user_keys(access.multi_get(self.rows(), keys)).select("key", "value")

    def range_scan(self, first: str, last: str, page_num: int = 1, page_size: int | None = None) -> DataFrame:
        """One page of the live keys in [first, last]."""
        if first > last:
            raise ValueError("the range is inverted")
        return access.page(access.range_scan(self.rows(first, last), first, last), page_size or self.config.page_size, page_num)

    def prefix_scan(self, prefix: str, page_num: int = 1, page_size: int | None = None) -> DataFrame:
        return access.page(access.prefix_scan(self.rows(prefix, prefix + LAST), prefix), page_size or self.config.page_size, page_num)

    def range_iter(self, first: str, last: str) -> Iterator[Row]:
        return access.iterate(access.range_scan(self.rows(first, last), first, last))

    def prefix_iter(self, prefix: str) -> Iterator[Row]:
        return access.iterate(access.prefix_scan(self.rows(prefix, prefix + LAST), prefix))

    # Sketches: a definition under a reserved key, cells in a table of their own. A re-created sketch gets a new id, so
    # cells of a deleted one never come back.

    def _create(self, key: str, **params) -> bool:
        self._pay()
        if self._value(key) is not None:
            return False
        batch = self.read("batches").agg(F.coalesce(F.max("next"), F.lit(0))).first()[0]
        self._set(key, json.dumps({"id": f"{key}#{batch}", **params}))
        return True

    def _definition(self, key: str) -> dict:
        self._pay()
        found = self._value(key)
        if found is None:
            raise KeyError(key)
        return json.loads(found)

    def _undefine(self, key: str) -> bool:
        self._pay()
        had = self._value(key) is not None
        if had:
            self._set(key, None)
        return had

    def _elements(self, elements: DataFrame | str, sketch_id: str) -> DataFrame:
        """(id, element) of a DataFrame with a column ``element``, or of one element; nulls are no elements."""
        if isinstance(elements, str):
            elements = self.spark.createDataFrame([(elements,)], "element string")
        return elements.filter("element is not null").select(F.lit(sketch_id).alias("id"), "element")

    def _cells(self, name: str, sketch_id: str) -> DataFrame:
        return self.read(name).filter(F.col("id") == sketch_id)

    def bloom_create(self, name: str, n: int, p: float) -> bool:
        """A filter for n elements; False where the name is taken."""
        m, k = bloom.bloom_size(n, p)
        return self._create(f"bf_{name}", m=m, k=k, seed=int(self.clock()))

    def bloom_add(self, name: str, elements: DataFrame | str) -> None:
        d = self._definition(f"bf_{name}")
        self._append("bloom", bloom.build(self._elements(elements, d["id"]), "id", "element", d["m"], d["k"], d["seed"]))

    def bloom_check(self, name: str, elements: DataFrame | str) -> DataFrame:
        """(element, maybe) for each distinct element."""
        d = self._definition(f"bf_{name}")
        probes = self._elements(elements, d["id"]).distinct()
        hits = bloom.check(self._cells("bloom", d["id"]).distinct(), probes, "id", "element", d["m"], d["k"], d["seed"])
        return probes.join(hits.select("element", F.lit(True).alias("maybe")), "element", "left").select("element", F.coalesce("maybe", F.lit(False)).alias("maybe"))

    def bloom_delete(self, name: str) -> bool:
        return self._undefine(f"bf_{name}")

    def hll_create(self, name: str, precision: int) -> bool:
        if not hll.MIN_PRECISION <= precision <= hll.MAX_PRECISION:
            raise ValueError(f"precision {precision} is outside {hll.MIN_PRECISION}..{hll.MAX_PRECISION}")
        return self._create(f"hll_{name}", p=precision)

    def hll_add(self, name: str, elements: DataFrame | str) -> None:
        d = self._definition(f"hll_{name}")
        self._append("hll", hll.registers(self._elements(elements, d["id"]), "id", "element", d["p"]))

    def hll_estimate(self, name: str) -> float:
        d = self._definition(f"hll_{name}")
        regs = self._cells("hll", d["id"]).groupBy("id", "register").agg(F.max("rank").alias("rank"))
        row = hll.estimate(regs, "id", d["p"]).first()
        return row["estimate"] if row else 0.0

    def hll_delete(self, name: str) -> bool:
        return self._undefine(f"hll_{name}")

    def cms_create(self, name: str, epsilon: float, delta: float) -> bool:
        m, k = cms.cms_size(epsilon, delta)
        return self._create(f"cms_{name}", m=m, k=k, seed=int(self.clock()))

    def cms_add(self, name: str, elements: DataFrame | str) -> None:
        d = self._definition(f"cms_{name}")
        self._append("cms", cms.cells(self._elements(elements, d["id"]), "id", "element", d["m"], d["k"], d["seed"]).select("id", "row", "col", "cnt"))

    def cms_frequency(self, name: str, elements: DataFrame | str) -> DataFrame:
        """(element, frequency) for each distinct element."""
        d = self._definition(f"cms_{name}")
        cells = self._cells("cms", d["id"]).groupBy("id", "row", "col").agg(F.sum("cnt").alias("cnt"))
        return cms.estimates(cells, self._elements(elements, d["id"]), "id", "element", d["m"], d["k"], d["seed"]).select("element", "frequency")

    def cms_delete(self, name: str) -> bool:
        return self._undefine(f"cms_{name}")

    # Fingerprints

    def _fingerprint(self, text: str) -> tuple[int, int]:
        one = self.spark.createDataFrame([(1, text)], "id int, text string")
        return tuple(simhash.fingerprints(one, "id", "text").select("hi", "lo").first())

    def simhash_store(self, text: str) -> bool:
        """Keep a text's fingerprint; False where it is kept already."""
        self._pay()
        if self._value(f"sh_{text}") is not None:
            return False
        self._set(f"sh_{text}", json.dumps(self._fingerprint(text)))
        return True

    def simhash_distance(self, a: str, b: str) -> int:
        """Differing bits of two texts' fingerprints, kept or computed."""
        self._pay()
        prints = []
        for text in (a, b):
            kept = self._value(f"sh_{text}")
            prints.append(json.loads(kept) if kept is not None else self._fingerprint(text))
        return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*prints))

    # Tables

    def _load_manifest(self) -> None:
        """The newest version: its tables, up to which number they hold the log, and the next free numbers. A row a table."""
        rows = self.read("manifest")
        newest = rows.agg(F.max("version")).first()[0]
        kept = rows.filter(F.col("version") == newest).collect() if newest is not None else []
        self.version = -1 if newest is None else newest
        self.upto = max((r["upto"] for r in kept), default=0)
        self.next_id = max((r["next_id"] for r in kept), default=0)
        self.tables = sorted((r for r in kept if r["table_id"] is not None), key=lambda r: r["table_id"])
        self.next_flush = self.upto + self.config.memtable_size * self.config.memtable_number

    def _leaves(self, rows: DataFrame) -> DataFrame:
        held = F.to_json(F.struct("key", "seq", "ts", "value", "tombstone"))
        return merkle.merkle_leaves(rows.select("table_id", "key", held.alias("data")), "key", "data")

    def _write_tables(self, rows: DataFrame) -> list[tuple]:
        """Write (table_id, level, key, seq, ts, value, tombstone) as sorted tables with their Merkle trees; gives (table_id, level, first_key,
        last_key, n_rows)."""
        rows = materialize(rows, "engine-tables")
        found = catalog.table_catalog(rows.withColumnRenamed("table_id", "run_id")).collect()  # a row a table
        most = max((r["n_rows"] for r in found), default=1)
        merkle.merkle_tree(self._leaves(rows), most).withColumn("id", F.col("table_id")).write.mode("append").partitionBy("id").parquet(f"{self.path}/trees")
        shaped = rows.withColumn("sort", F.col("key"))
        if self.config.compression:
            names = tables.grown_dictionary(rows.select("seq", "key"), f"{self.path}/dictionary")
            shaped = shaped.join(names, "key").drop("key")
        key = "key_id" if self.config.compression else "key"
        for r in found:
            one = shaped.filter(F.col("table_id") == r["run_id"])
            one = one.coalesce(1) if self.config.one_file else one.repartitionByRange("sort")
            (one.sortWithinPartitions("sort").select(key, "seq", "ts", "value", "tombstone").write.mode("overwrite")
             .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{self.path}/tables/{r['run_id']}"))
        return [(r["run_id"], r["level"], r["first_key"], r["last_key"], r["n_rows"]) for r in found]

    def _drop(self, *parts: str) -> None:
        """Delete folders that nothing reads any more."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for part in parts:
            path = jvm.Path(f"{self.path}/{part}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def flush(self) -> None:
        """Full runs of the log become tables, levels that are full are compacted, and what is no longer needed is deleted.

        A run is full at ``memtable_size`` distinct keys."""
        rest = self.rest().select("seq", "ts", "key", "value", "tombstone")
        ready = compaction.rotated_runs(rest, self.config.memtable_size, self.next_id).filter("full").drop("full")
        ready = materialize(ready, "engine-flush")
        last = ready.agg(F.max("seq")).first()[0]
        size = self.config.memtable_size
        if last is None:  # updates of a few keys: no run is full yet
            ops = self.read("batches").agg(F.coalesce(F.max("next"), F.lit(0))).first()[0]
            self.next_flush = ops + size
            return
        fresh = compaction.flush_runs(ready).withColumnRenamed("run_id", "table_id").withColumn("level", F.lit(1))
        known = [(t["table_id"], t["level"], t["first_key"], t["last_key"], t["n_rows"]) for t in self.tables]
        new = self._write_tables(fresh.select("table_id", "level", "key", "seq", "ts", "value", "tombstone"))
        self.next_id = max(n for n, *_ in new) + 1
        self._commit(self._compacted(known + new), last + 1)

    def _compacted(self, known: list[tuple]) -> list[tuple]:
        """The catalog after compaction; merged tables are written."""
        infos = [compaction.TableInfo(level, num, first, last_) for num, level, first, last_, _ in known]
        plan = compaction.plan_tiered if self.config.sized_compaction else compaction.plan_leveled
        _, pieces, level_of = plan(infos, self.config)
        before = {num: level for num, level, *_ in known}
        sources: dict[int, list] = {}
        for p in pieces:
            sources.setdefault(p.table, []).append(p)
        # A table stays as it is if it is where it was, whole and alone; all others are written anew.
        spans = {num: (first, last_) for num, _, first, last_, _ in known}
        same = {n for n, some in sources.items() if n in before and len(some) == 1 and (some[0].low, some[0].high) == spans[n] and not (some[0].low_open or some[0].high_open)}
        moved = [p for n, some in sources.items() if n not in same for p in some]
        if not moved:
            return known
        name = {n: self.next_id + k for k, n in enumerate(sorted({p.table for p in moved}))}
        self.next_id += len(name)
        held = None
        for source in sorted({p.source for p in moved}):
            one = self._contents([{"table_id": source}]).withColumn("source", F.lit(source).cast("long"))
            held = one if held is None else held.unionByName(one)
        rows = self.spark.createDataFrame([(p.source, p.low, p.high, p.low_open, p.high_open, name[p.table], level_of[p.table]) for p in moved],
                                          "source long, low string, high string, low_open boolean, high_open boolean, table_id long, level int")
        placed = held.join(rows, "source").filter(compaction.in_piece()).drop("source", "low", "high", "low_open", "high_open")
        new = self._write_tables(compaction.kway_merge(placed, ["level", "table_id"]).select("table_id", "level", "key", "seq", "ts", "value", "tombstone"))
        return [t for t in known if t[0] in same] + new

    def _commit(self, known: list[tuple], upto: int) -> None:
        """Make a catalog count, in one file, then delete what only earlier versions needed."""
        gone = {t["table_id"] for t in self.tables} - {t[0] for t in known}
        old_upto, version = self.upto, self.version + 1
        rows = [(*t, upto, self.next_id, version) for t in known] or [(None, None, None, None, None, upto, self.next_id, version)]
        self.spark.createDataFrame(rows, LAYOUT["manifest"]).coalesce(1).drop("version").write.parquet(f"{self.path}/manifest/version={version}")
        self._load_manifest()
        self._drop(*(f"tables/{n}" for n in gone), *(f"trees/id={n}" for n in gone),
                   *(f"log/segment={n}" for n in range(old_upto // self.config.wal_size, upto // self.config.wal_size)),
                   *([f"manifest/version={version - 1}"] if version else []))

    def verify(self) -> DataFrame:
        """(table_id, n_leaves, n_diff): trees rebuilt from the tables against the stored ones."""
        rows = None
        for t in self.tables:
            one = self._contents([t]).withColumn("table_id", F.lit(t["table_id"]).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], "table_id long, n_leaves long, n_diff long")
        paths = [f"{self.path}/trees/id={t['table_id']}" for t in self.tables]
        return merkle.verify(self.spark.read.schema(LAYOUT["tree"]).parquet(*paths).distinct(), self._leaves(rows))

    def save_bucket(self) -> None:
        """Keep the bucket for the next session or for another process."""
        b = self.bucket
        self._set(BUCKET_KEY, json.dumps([b.size, b.interval, b.left, b.refreshed]))

    def close(self) -> None:
        self.save_bucket()
