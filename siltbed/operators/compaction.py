"""Runs, merges and both compaction policies.

A run is a set of rows with a ``run_id`` (larger is newer) and a ``level``. Merging never drops a
tombstone unless asked to, so ``latest_state`` is the same before and after. Planning works on the
catalog (one row per table) on the driver; only data moves through Spark.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siltbed.config import EngineConfig
from siltbed.operators.order import carried_forward
from siltbed.session import materialize


def assign_runs(log: DataFrame, capacity: int) -> DataFrame:
    """Memtable generation of each write, by operation count: no sequential state is needed."""
    return log.withColumn("run_id", F.call_function("div", F.col("seq"), F.lit(capacity)).cast("int"))


def rotated_runs(log: DataFrame, capacity: int, first_run: int = 0) -> DataFrame:
    """Memtable generation of each write where a memtable is full at ``capacity`` distinct keys: an update of a key that it holds takes no
    room. Adds ``run_id`` and ``full``, whether the run got full. Where a run ends depends on all before it, so this is one ordered
    pass that holds the keys of one run; for bulk loads ``assign_runs`` needs none."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)

    def run(batches):
        import numpy as np

        keys, now = set(), first_run
        for pdf in batches:
            ids = np.empty(len(pdf), np.int64)
            for i, key in enumerate(pdf["key"]):
                ids[i] = now
                keys.add(key)
                if len(keys) == capacity:
                    keys, now = set(), now + 1
            yield pdf.assign(run_id=ids)

    done = log.repartition(1).sortWithinPartitions("seq").mapInPandas(run, f"{schema}, run_id long")
    done = materialize(done, "rotated")
    full = done.groupBy("run_id").agg(F.countDistinct("key").alias("keys")).select("run_id", (F.col("keys") == capacity).alias("full"))
    return done.join(full, "run_id")


def flush_runs(runs: DataFrame) -> DataFrame:
    """Contents of each flushed run: newest version per key within the run, tombstones kept."""
    payload = [c for c in runs.columns if c not in ("run_id", "key", "seq")]
    best = F.max_by(F.struct("seq", *payload), F.col("seq")).alias("v")
    return runs.groupBy("run_id", "key").agg(best).select("run_id", "key", "v.*")


def kway_merge(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Merge runs: one row per key (and per ``by`` group), the greatest (ts, seq) wins."""
    by = by or []
    payload = [c for c in runs.columns if c not in ("key", "run_id", *by)]
    best = F.max_by(F.struct(*payload), F.struct("ts", "seq")).alias("v")
    return runs.groupBy(*by, "key").agg(best).select(*by, "key", "v.*")


def size_tiered(runs: DataFrame, fan_in: int, level_count: int) -> DataFrame:
    """Size-tiered compaction carried through at once.

    ``fan_in`` tables of a level become one of the next, cascading up to the last level, where tables
    pile up. As run ids are dense, a run's final place is arithmetic: of n runs, the oldest
    floor(n / fan_in^j) * fan_in^j have reached level j + 1 at least. So one aggregation replaces the cascade.
    """
    placed = runs.withColumn("n", runs.agg(F.max("run_id") + 1).scalar())
    level, group = F.lit(1), F.col("run_id").cast("long")
    for j in range(1, level_count):
        block = fan_in ** j
        reached = F.col("run_id") < F.floor(F.col("n") / block) * block
        level = F.when(reached, F.lit(j + 1)).otherwise(level)
        group = F.when(reached, F.floor(F.col("run_id") / block)).otherwise(group)
    placed = placed.select(*runs.columns, level.cast("int").alias("level"), group.cast("long").alias("table_num"))
    return kway_merge(placed.drop("run_id"), ["level", "table_num"])


def table_ranges(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog rows: smallest and largest key, and the row count of each table."""
    return tables.groupBy(*keys).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_rows"))


def overlapping(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of tables of a level and of the next one whose key ranges meet, with the kind: contained or partial.

    Both inputs are catalogs: one row per table, not per record."""
    u = upper.select(F.col("run_id").alias("upper_id"), F.col("level").alias("u0"), F.col("first_key").alias("u1"), F.col("last_key").alias("u2"))
    w = lower.select(F.col("run_id").alias("lower_id"), F.col("level").alias("w0"), F.col("first_key").alias("w1"), F.col("last_key").alias("w2"))
    inside = (F.col("w1") >= F.col("u1")) & (F.col("w2") <= F.col("u2"))
    meets = (F.col("w0") == F.col("u0") + 1) & (F.col("u1") <= F.col("w2")) & (F.col("w1") <= F.col("u2"))
    return u.join(w, meets).select("upper_id", "lower_id", F.when(inside, "contained").otherwise("partial").alias("kind"))


def split_at(rows: DataFrame, border: str, lower: bool) -> tuple[DataFrame, DataFrame]:
    """(moving, staying) parts of a table at a border key: ``lower`` moves keys >= border, else keys <= border."""
    moves = F.col("key") >= border if lower else F.col("key") <= border
    return rows.filter(moves), rows.filter(~moves)


@dataclass(frozen=True)
class TableInfo:
    level: int
    num: int
    first_key: str
    last_key: str


@dataclass
class Piece:
    """Keys of one source table in an interval, and the table that they are in now. Open ends leave their key out."""

    source: int
    low: str
    high: str
    low_open: bool = False
    high_open: bool = False
    table: int = -1

    def meets(self, low: str, high: str) -> bool:
        above = self.high > low or self.high == low and not self.high_open
        return above and (self.low < high or self.low == high and not self.low_open)

    def cut(self, low: str, high: str) -> tuple[Piece, list[Piece]]:
        """(the part in [low, high], the parts outside)."""
        left = self.low < low
        right = self.high > high
        inner = Piece(self.source, low if left else self.low, high if right else self.high, not left and self.low_open, not right and self.high_open, self.table)
        rest = [Piece(self.source, self.low, low, self.low_open, True, self.table)] * left
        return inner, rest + [Piece(self.source, high, self.high, True, self.high_open, self.table)] * right


def start(p: Piece) -> tuple[str, bool]:
    return p.low, p.low_open


def common(a: Piece, b: Piece) -> Piece | None:
    """The keys of ``a`` that ``b`` has too."""
    low, low_open = max(start(a), start(b))
    high, closed = min((a.high, not a.high_open), (b.high, not b.high_open))
    return Piece(a.source, low, high, low_open, not closed, b.table) if low < high or low == high and closed and not low_open else None


def joined(pieces: list[Piece], table: int) -> list[Piece]:
    """What several pieces cover, in order and without overlap, as pieces of a table."""
    out: list[Piece] = []
    for p in sorted(pieces, key=start):
        last = out[-1] if out else None
        if last and (p.low < last.high or p.low == last.high and not (p.low_open and last.high_open)):
            last.high, closed = max((last.high, not last.high_open), (p.high, not p.high_open))
            last.high_open = not closed
        else:
            out.append(Piece(table, p.low, p.high, p.low_open, p.high_open, table))
    return out


class KeyRanges:
    """What the tables of a level cover, in order, found by bisection as long as it is disjoint."""

    def __init__(self, tables: list[TableInfo]):
        self.ranges = sorted((Piece(t.num, t.first_key, t.last_key, table=t.num) for t in tables), key=start)
        self.disjoint = all(x.high < y.low for x, y in zip(self.ranges, self.ranges[1:]))

    def take(self, low: str, high: str) -> list[Piece]:
        """The parts in [low, high] of all tables, oldest first; the rest stays."""
        begin = max(0, bisect.bisect_left(self.ranges, low, key=lambda r: r.low) - 1) if self.disjoint else 0
        end = bisect.bisect_right(self.ranges, high, key=lambda r: r.low)
        out, kept = [], []
        for r in self.ranges[begin:end]:
            if r.meets(low, high):
                inner, rest = r.cut(low, high)
                out.append(inner)
                kept += rest
            else:
                kept.append(r)
        self.ranges[begin:end] = sorted(kept, key=start)
        return sorted(out, key=lambda p: p.source)

    def put(self, pieces: list[Piece]) -> None:
        """A new table, whose range the others have left."""
        at = bisect.bisect_left(self.ranges, start(pieces[0]), key=start)
        self.ranges[at:at] = pieces

    def within(self, span: Piece) -> list[Piece]:
        """The parts of ``span`` that tables cover, where these are disjoint, with the table of each."""
        out = []
        for r in self.ranges[max(0, bisect.bisect_left(self.ranges, span.low, key=lambda r: r.low) - 1):]:
            if r.low > span.high:
                break
            if part := common(span, r):
                out.append(part)
        return out

    def by_table(self) -> dict[int, list[Piece]]:
        out: dict[int, list[Piece]] = {}
        for r in self.ranges:
            out.setdefault(r.source, []).append(r)
        return out


@dataclass
class LeveledPlan:
    """Where leveled compaction takes every key. A step takes a whole key range of the next level, so where a record that came to a
    level ends depends on its key alone, whatever table it is from: ``routes[k]`` has the final tables of what came to level k + 1 by a
    step. Its size grows with the steps, not with the tables that they merge."""

    steps: list[dict]
    routes: dict[int, KeyRanges]
    level_of: dict[int, int]
    pushed: dict[int, set[int]]

    def pieces(self, tables: list[TableInfo]) -> list[Piece]:
        """The final tables of each table's keys."""
        out = []
        for t in tables:
            rest, found = [Piece(t.num, t.first_key, t.last_key, table=t.num)], []
            for route in [self.routes.get(t.level - 1)] + [self.routes.get(t.level)] * (t.num in self.pushed.get(t.level, ())):
                for r in rest if route else []:
                    parts = route.within(r)
                    found += parts
                    rest = [x for x in rest if x is not r] + outside(r, parts)
            last = None
            for p in sorted(found + rest, key=start):
                if last and last.table == p.table and last.high == p.low and last.high_open != p.low_open:
                    last.high, last.high_open = p.high, p.high_open
                else:
                    out.append(last := p)
        return out

    def borders(self) -> list[tuple[str, int, list]]:
        """(key, side, [(table, level) by route or None]): what holds from a border on, which lies before (0) or behind (2) its key."""
        names = sorted(self.routes)
        at: dict[tuple[str, int], dict[int, int | None]] = {}
        for k, level in enumerate(names):
            for r in self.routes[level].ranges:
                at.setdefault((r.high, 0 if r.high_open else 2), {}).setdefault(k, None)
                at.setdefault((r.low, 2 if r.low_open else 0), {})[k] = r.table
        now, out = [None] * len(names), []
        for (key, side), changes in sorted(at.items()):
            then = [changes.get(k, table) for k, table in enumerate(now)]
            if then != now:
                out.append((key, side, [None if n is None else (n, self.level_of[n]) for n in then]))
            now = then
        return out


def outside(span: Piece, parts: list[Piece]) -> list[Piece]:
    """What of ``span`` lies between parts of it that are in order."""
    out, low, low_open = [], span.low, span.low_open
    for p in [*parts, Piece(span.source, span.high, span.high, not span.high_open)]:
        if low < p.low or low == p.low and p.low_open and not low_open:
            out.append(Piece(span.source, low, p.low, low_open, not p.low_open, span.table))
        low, low_open = p.high, not p.high_open
    return out


def routed_leveled(tables: list[TableInfo], cfg: EngineConfig) -> LeveledPlan:
    """Leveled compaction on the catalog alone.

    While a level holds more than its limit, its oldest table goes down: what the tables of the next level hold of its key range is merged
    with it, whole tables or, split at the borders, parts; the rest of those stays where it is. Outputs are numbered after all
    other tables. A rest counts as a table of its level, even if it should hold no key."""
    levels: dict[int, list[TableInfo]] = {}
    for t in tables:
        levels.setdefault(t.level, []).append(t)
    next_num, steps, pushed, painted = max((t.num for t in tables), default=-1) + 1, [], {}, {}
    level_of = {t.num: t.level for t in tables if not 1 <= t.level <= cfg.level_count}
    now = KeyRanges(levels.get(1, []))
    for level in range(1, cfg.level_count):
        held, below = now.by_table(), KeyRanges(levels.get(level + 1, []))
        here = sorted(held)
        over = max(0, len(here) - cfg.level_limit(level))
        pushed[level], painted[level] = set(here[:over]), KeyRanges([])
        for num in here[:over]:
            own = held.pop(num)
            low, high = min(p.low for p in own), max(p.high for p in own)
            taken = below.take(low, high)
            steps.append({"level": level, "inputs": [num, *dict.fromkeys(p.source for p in taken)], "output": next_num})
            below.put(joined(own + taken, next_num))
            painted[level].take(low, high)
            painted[level].put([Piece(next_num, low, high, table=next_num)])
            next_num += 1
        level_of |= dict.fromkeys(held, level)
        now = below
    level_of |= dict.fromkeys(now.by_table(), cfg.level_count)
    routes: dict[int, KeyRanges] = {}
    for level in sorted(painted, reverse=True):
        routes[level] = KeyRanges([])
        for r in painted[level].ranges:
            routes[level].ranges += routes[level + 1].within(r) if r.source in pushed.get(level + 1, ()) else [r]
        routes[level].ranges = [r for r in routes[level].ranges if r.table in level_of]  # others are gaps, where no table has keys
    return LeveledPlan(steps, routes, level_of, pushed)


def plan_leveled(tables: list[TableInfo], cfg: EngineConfig) -> tuple[list[dict], list[Piece], dict[int, int]]:
    """(steps, pieces of each table, level of each table) of leveled compaction."""
    plan = routed_leveled(tables, cfg)
    return plan.steps, plan.pieces(tables), plan.level_of


def plan_tiered(tables: list[TableInfo], cfg: EngineConfig) -> tuple[list[dict], list[Piece], dict[int, int]]:
    """The same for size-tiered compaction: a level with ``level_num`` tables or more becomes one table of the next, in groups of that many,
    oldest first; in the last level tables pile up."""
    levels: dict[int, list[int]] = {}
    held = {t.num: [Piece(t.num, t.first_key, t.last_key, table=t.num)] for t in tables}
    for t in sorted(tables, key=lambda x: x.num):
        levels.setdefault(t.level, []).append(t.num)
    next_num, steps = max(held, default=-1) + 1, []
    for level in range(1, cfg.level_count):
        here = levels.get(level, [])
        while len(here) >= cfg.level_num:
            group, here = here[:cfg.level_num], here[cfg.level_num:]
            held[next_num] = [p for n in group for p in held.pop(n)]
            levels.setdefault(level + 1, []).append(next_num)
            steps.append({"level": level, "inputs": group, "output": next_num})
            next_num += 1
        levels[level] = here
    for n, some in held.items():
        for piece in some:
            piece.table = n
    return steps, [p for some in held.values() for p in some], {n: level for level, some in levels.items() for n in some}


def in_piece() -> Column:
    """Whether a row's key lies in the piece (low, high, low_open, high_open) beside it."""
    key, low, high = F.col("key"), F.col("low"), F.col("high")
    return ((key > low) | ((key == low) & ~F.col("low_open"))) & ((key < high) | ((key == high) & ~F.col("high_open")))


def leveled(tables: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Leveled compaction of ``tables`` (run_id, level, key, seq, ts, ...).

    The plan is made from the catalog. Tables of a level that go down are merged first, as the plan takes equal keys of them to the same
    place; a key finds its place among the plan's borders in one ordered pass over the distinct keys, and what meets there is merged."""
    catalog = [TableInfo(r["level"], r["run_id"], r["first_key"], r["last_key"])
               for r in table_ranges(tables, ["run_id", "level"]).toLocalIterator()]
    plan = routed_leveled(catalog, cfg)
    initial = {(t.level, t.num) for t in catalog}
    stays = F.col("run_id")
    for level, some in plan.pushed.items():  # the oldest of a level
        last = max((n for n in some if (level, n) in initial), default=None)
        if last is not None:
            stays = F.when((F.col("level") == level) & (F.col("run_id") <= last), None).otherwise(stays)
    merged = materialize(kway_merge(tables.withColumn("stays", stays).drop("run_id"), ["level", "stays"]), "leveled")
    borders = tables.sparkSession.createDataFrame(plan.borders(), "key string, side int, routes array<struct<table_num int, level int>>")
    probes = merged.select("key").distinct().select("key", F.lit(1).alias("side"), F.lit(None).cast(borders.schema["routes"].dataType).alias("routes"))
    found = carried_forward(borders.unionByName(probes), [], ["key", "side"], "routes").filter("side = 1").select("key", F.col("last").alias("routes"))
    route = lambda level: F.when((level >= 1) & (level < cfg.level_count), F.get("routes", F.greatest(level, F.lit(1)) - 1))
    stay = F.struct(F.col("stays").cast("int").alias("table_num"), F.col("level").cast("int").alias("level"))
    to = F.coalesce(route(F.col("level") - 1), F.when(F.col("stays").isNull(), route(F.col("level"))), stay).alias("to")
    placed = merged.join(found, "key").withColumn("to", to).drop("level", "stays", "routes").withColumns({"level": F.col("to.level"), "table_num": F.col("to.table_num")})
    return kway_merge(placed.drop("to"), ["level", "table_num"])


def renumber(catalog: DataFrame) -> DataFrame:
    """Close the gaps that a merge leaves: tables are numbered from 1 within their level, oldest first."""
    from pyspark.sql import Window

    at = Window.partitionBy("level").orderBy("run_id")
    return catalog.withColumn("num", F.row_number().over(at))


def drop_tombstones(rows: DataFrame) -> DataFrame:
    """Optional garbage collection, only valid for the last level."""
    return rows.filter(~F.col("tombstone"))
