"""Exact Jaccard self-join on word shingles with signature trees, and its connected components.

1. Every text gets its set of shingle hashes; equal sets form one class and are compared once.
2. Two sets within the threshold share one of the first n - ceil(t n) + 1 shingles of each under any one order
   of all shingles. The order puts very frequent shingles last, so they seldom choose candidates; the list of
   frequent ones has a fixed size and only steers speed. Prefix entries travel as packed blocks.
3. Classes that meet at a prefix shingle join the group of the smallest class there, its leader. A shingle that one task finds
   ``HOT`` times sends one entry on and keeps its classes with the task until the leader is known, so no task meets all of them.
4. In a group of more than ``ONE`` members each is compared with the leader: by signatures first, then on whole sets; members are dealt
   among tasks that have the leader each. In a group of many near copies of it that joins them in time linear in their number.
5. What doesn't link with the leader there, and all members of smaller groups, meet in units. A smaller group is one unit. Members of
   a larger one are cut into blocks of like size, so that only blocks of the same and of neighbouring sizes can link, and of about
   ``GROUP`` classes and ``SHINGLES`` shingles; a pair of such blocks is a unit. Each unit runs a dual traversal of a signature
   tree: nodes hold OR-combined token bitmaps and size ranges, and a pair of nodes is pruned by its largest possible overlap, its sizes,
   or because all its members are joined already. The first traversal has signatures only and leaves groups of classes that may link;
   the second has the whole sets of those and compares them at its leaves.
6. Links (a spanning set of each unit) give components.

Shingles are 64-bit hashes, sets and rows are known by 128 bits.
Nulls and empty texts have no shingles and link with nothing; a text with fewer words than the width has its whole
sequence as its shingle; repeated rows and equal ids stay rows of their own; other columns are ignored. A null
doc_id stays null, and its component is the smallest id in it, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltbed.llm import common as C

HEAVY = 1_000_000  # entries of the list of frequent shingles: a bounded broadcast
HEAVY_DF = 16  # documents that make a shingle frequent
STRETCH = 1_000_000  # shingles that are counted together
ENTRIES = 100_000  # prefix entries of one packed part
HELD = 500_000  # prefix entries that a task sorts together
HOT = 64  # entries of a prefix shingle in one task's part that make it frequent there
ONE = 512  # members of a group that is one unit
GROUP, SHINGLES = 256, 500_000  # classes of a block, and the shingles that it may hold beside its last class
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 17  # a signature has four bits a shingle within these, rounded up to a power of two
FAN = 8  # members of a leaf and children of a node


def set_signature(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order, as two signed longs."""
    with np.errstate(over="ignore"):
        a = C.mix(u).sum(dtype=np.uint64)
        b = C.mix(u ^ C.MIX_A).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def token_bits(u: np.ndarray) -> np.ndarray:
    """The packed bitmap of a set; a token's bit is given by the first bits of its hash, so halving a bitmap joins neighbours."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(u) - 1).bit_length()))
    row = np.zeros(bits, bool)
    row[(C.mix(u) >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(row)


def halved(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(bits).reshape(-1, 2).any(axis=1))


def repeated_shingles(width: int, separator: np.ndarray):
    """A function for mapInArrow: (h, n) of the shingles that several texts of a stretch of about ``STRETCH`` shingles have. A stretch is
    long, so that a shingle of few texts a megabyte, which many texts of a large table have, is counted too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        seen: set[int] = set()
        parts, held = [], 0

        def counted() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(parts), return_counts=True)
            keep = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

        for batch in batches:
            for _, data, offsets in C.slices(batch):
                h, bounds = C.batch_shingles(data, offsets, width, separator)
                sums = np.concatenate([[0], np.cumsum(C.mix(h), dtype=np.uint64)]).astype(np.uint64)
                with np.errstate(over="ignore"):
                    texts = (sums[bounds[1:]] - sums[bounds[:-1]]).tolist()
                fresh_text = np.array([not (t in seen or seen.add(t)) for t in texts])  # a copy isn't counted again by its task
                h, bounds = h[np.repeat(fresh_text, np.diff(bounds))], np.concatenate([[0], np.cumsum(np.diff(bounds) * fresh_text)])
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                if not len(h):
                    continue
                parts.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])])
                held += len(parts[-1])
                if held >= STRETCH:
                    yield counted()
                    parts, held = [], 0
        if parts:
            yield counted()

    return count


def heavy_shingles(docs: DataFrame, width: int, separator: np.ndarray) -> np.ndarray:
    """The most frequent shingles by document count, over all documents (copies in one task count once); sorted, ``HEAVY`` at most."""
    counts = docs.select("text").mapInArrow(repeated_shingles(width, separator), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = C.materialize(counts.filter(F.col("n") >= HEAVY_DF), "jaccard-heavy")
    size = F.least(F.col("n"), F.lit(1 << 20))
    least, total = None, 0
    for n, some in sorted((tuple(r) for r in counts.groupBy(size).count().collect()), reverse=True):  # all of a count, as far as there is room
        total += some
        if total > HEAVY:
            break
        least = n
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.filter(size >= least).select("h").toArrow().column(0).to_numpy().view(np.uint64))


def least_overlap(n, threshold: int):
    """ceil(t n)."""
    return -(-threshold * n // 100)


def member_rows(width: int, threshold: int, separator: np.ndarray, heavy, parts: int):
    """A function for mapInArrow: a row per document (mark null), packed prefix entries (h, s1) by part, and the classes of a
    shingle that is frequent in this part of the task (hot); of these one entry, marked, goes to the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        frequent = heavy.value
        seen: set[tuple[int, int]] = set()
        prefixes, owners, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(prefixes)
            s = np.repeat(np.array(owners, np.int64), [len(p) for p in prefixes])
            order = np.lexsort((s, h))
            h, s = h[order], s[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            often = np.diff(cuts) >= HOT
            marked = np.repeat(often, np.diff(cuts))
            first = np.zeros(len(h), bool)
            first[cuts[:-1][often]] = True
            names, hots, marks, blobs = [], [], [], []
            for tag, rows in ((False, ~marked), (True, first)):
                part = (h[rows] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                packed = np.stack([h[rows].view(np.int64), s[rows]], axis=1)[order]
                ids, at = np.unique(part[order], return_index=True)
                names += ids.tolist()
                blobs += [packed[a:b].tobytes() for a, b in zip(at, [*at[1:], len(order)])]
                marks += [tag] * len(ids)
            hots += [None] * len(names)
            for a, b in zip(cuts[:-1][often], cuts[1:][often]):
                names.append(None)
                hots.append(int(h[a].astype(np.int64)))
                marks.append(True)
                blobs.append(s[a:b].tobytes())
            return entry_batch(names, hots, marks, blobs)

        for batch in batches:
            for part, data, offsets in C.slices(batch):
                h, bounds = C.batch_shingles(data, offsets, width, separator)
                n_of, s1_of, s2_of, bits_of = [], [], [], []
                for i in range(part.num_rows):
                    u = np.unique(h[bounds[i]:bounds[i + 1]])
                    n = len(u)
                    s1, s2 = set_signature(u)
                    n_of.append(n)
                    s1_of.append(s1)
                    s2_of.append(s2)
                    bits_of.append(None)
                    if n and (s1, s2) not in seen:
                        seen.add((s1, s2))
                        bits_of[-1] = token_bits(u).tobytes()
                        if len(frequent):
                            last = frequent[np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)] == u
                            u = np.concatenate([u[~last], u[last]])
                        prefixes.append(u[:n - least_overlap(n, threshold) + 1])
                        owners.append(s1)
                        held += len(prefixes[-1])
                        if held >= HELD:
                            yield flush()
                            prefixes, owners, held = [], [], 0
                            seen.clear()
                yield pa.RecordBatch.from_arrays([
                    part.column(part.schema.get_field_index("k2")), part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                    pa.array(n_of, pa.int64()), pa.array(s1_of, pa.int64()), pa.array(s2_of, pa.int64()), pa.array(bits_of, pa.binary()),
                    pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.bool_()), pa.nulls(part.num_rows, pa.binary())], names=NAMES)
        if prefixes:
            yield flush()

    return run


NAMES = ["k2", "doc_id", "n", "s1", "s2", "bits", "part", "hot", "mark", "entries"]
MEMBERS = "k2 binary, doc_id long, n long, s1 long, s2 long, bits binary, part long, hot long, mark boolean, entries binary"


def entry_batch(parts: list, hots: list, marks: list[bool], blobs: list[bytes]) -> pa.RecordBatch:
    n, longs = len(blobs), pa.nulls(len(blobs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), longs, longs, longs, longs, pa.nulls(n, pa.binary()), pa.array(parts, pa.int64()),
                                       pa.array(hots, pa.int64()), pa.array(marks, pa.bool_()), pa.array(blobs, pa.binary())], names=NAMES)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order: (leader, member, null) for every prefix shingle that several classes have, and (leader, null, shingle) for those
    with marked entries; the leader is the smallest class."""
    C.release()

    def close(blobs: list[bytes], marked: list[bytes]) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(marked), np.int64).reshape(-1, 2)
        e = np.concatenate([np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2), m])
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        first = np.concatenate([[True], e[1:, 0] != e[:-1, 0]])
        leader = e[np.maximum.accumulate(np.where(first, np.arange(len(e)), 0)), 1]
        pairs = np.stack([leader, e[:, 1]], axis=1)[leader != e[:, 1]]
        if len(pairs):
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
        known = first & np.isin(e[:, 0], m[:, 0])
        n, k = len(pairs), int(known.sum())
        none = lambda count: pa.nulls(count, pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([pairs[:, 0], e[known, 1]])), pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), none(k)]),
            pa.concat_arrays([none(n), pa.array(e[known, 0], pa.int64())])], names=["leader", "member", "hot"])

    now, blobs, marked = None, [], []
    for batch in batches:
        for part, tag, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if part != now and (blobs or marked):
                yield close(blobs, marked)
                blobs, marked = [], []
            now = part
            (marked if tag else blobs).append(blob.as_py())
    if blobs or marked:
        yield close(blobs, marked)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, classes of a frequent shingle in one part of a task) to (leader, member)."""
    for batch in batches:
        some = [np.unique(np.frombuffer(b.as_py(), np.int64)) for b in batch.column(1)]
        leader = np.repeat(batch.column(0).to_numpy(), [len(x) for x in some])
        member = np.concatenate([*some, np.zeros(0, np.int64)])
        other = leader != member
        yield pa.RecordBatch.from_arrays([pa.array(leader[other], pa.int64()), pa.array(member[other], pa.int64())], names=["leader", "member"])


class SignatureTree:
    """Members in order of size; a level's nodes cover ``FAN`` of the level below each."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        twice = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, sizes, sizes, twice)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, tw = self.levels[-1]
            cuts = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(tw, cuts)))

    def possible(self, level: int, i: int, js: np.ndarray, threshold: int) -> np.ndarray:
        """Which nodes ``js`` may hold a partner for a member under node ``i`` of the same level."""
        b, lo, hi, tw = self.levels[level]
        need = -(-threshold * (lo[i] + lo[js]) // (100 + threshold))
        ok = (100 * hi[i] >= threshold * lo[js]) & (100 * hi[js] >= threshold * lo[i])
        js2 = np.flatnonzero(ok)
        if len(js2):
            most = np.bitwise_count(b[i] & b[js[js2]]).sum(axis=1) + np.minimum(tw[i], tw[js[js2]])
            ok[js2] = most >= need[js2]
        return ok


def may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, threshold: int) -> bool:
    """Whether two sets of these bitmaps and sizes may be within the threshold."""
    while len(a) > len(b):
        a = halved(a)
    while len(b) > len(a):
        b = halved(b)
    most = int(np.bitwise_count(a & b).sum()) + min(n_a - int(np.bitwise_count(a).sum()), n_b - int(np.bitwise_count(b).sum()))
    return (100 + threshold) * min(most, n_a, n_b) >= threshold * (n_a + n_b)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets are within the threshold."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def links_of(bits: list[np.ndarray], sizes: list[int], blocks: list[int], hubs: list[int | None], threshold: int, sets: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Spanning links among members; without ``sets``, of pairs that their signatures let pass. Members with the same hub are joined
    with each other through it, so they aren't compared.

    Sizes of a pair differ by less than two times, so their bitmaps are of equal length or one step apart: there is a tree for each
    length, which also holds the members of the next length with halved bitmaps. Where the members are of two blocks, only pairs
    across them are compared."""
    parent = list(range(len(sizes)))
    cross = len(set(blocks)) > 1

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    for length in sorted({len(b) for b in bits}):
        at = sorted((k for k, b in enumerate(bits) if len(b) in (length, 2 * length)), key=lambda k: sizes[k])
        shorter = [len(bits[k]) == length for k in at]
        tree = SignatureTree(np.stack([bits[k] if s else halved(bits[k]) for k, s in zip(at, shorter)]), np.array([sizes[k] for k in at]))
        top = len(tree.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if level:
                span = FAN ** level
                below = {find(at[k]) for base in {i, j} for k in range(base * span, min(len(at), base * span + span))}
                if len(below) == 1:  # all of them are joined already
                    continue
                n = len(tree.levels[level - 1][0])
                b = np.arange(j * FAN, min(n, j * FAN + FAN))
                for x in range(i * FAN, min(n, i * FAN + FAN)):
                    ys = b[b >= x] if i == j else b
                    stack += [(level - 1, x, int(y)) for y in ys[tree.possible(level - 1, x, ys, threshold)]]
                continue
            if i == j or not (shorter[i] or shorter[j]):
                continue
            p, q = at[i], at[j]
            if cross and blocks[p] == blocks[q] or find(p) == find(q) or hubs[p] is not None and hubs[p] == hubs[q]:
                continue
            if sets is not None and not linked(sets[p], sets[q], threshold):
                continue
            parent[find(p)] = find(q)
            found.append((p, q))
    return found


def signature_groups(rows: list[tuple], threshold: int) -> list[tuple]:
    """(leader, member, hub) of the classes of a unit that may link; rows are (block, class, hub, (n, bits))."""
    bits = [np.frombuffer(r[3][1], np.uint8) for r in rows]
    found = links_of(bits, [r[3][0] for r in rows], [r[0] for r in rows], [r[2] for r in rows], threshold, None)
    near: dict[int, list[int]] = {}
    for i, j in found:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    out, seen = [], set()
    for i in near:
        if i not in seen:
            seen.add(i)
            some, stack = [], [i]
            while stack:
                x = stack.pop()
                some.append(rows[x])
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            leader = min(r[1] for r in some)
            out += [(leader, r[1], r[2]) for r in some]
    return out


def set_links(rows: list[tuple], threshold: int) -> list[tuple]:
    """Links of a unit; rows are (block, class, hub, (node, whole set))."""
    sets = [np.frombuffer(r[3][1], np.uint64) for r in rows]
    found = links_of([token_bits(s) for s in sets], [len(s) for s in sets], [r[0] for r in rows], [r[2] for r in rows], threshold, sets)
    return [(rows[i][3][0], rows[j][3][0]) for i, j in found]


def typed(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types)], names=[n for n, _ in types])


NEAR = [("leader", pa.int64()), ("member", pa.int64()), ("hub", pa.int64())]
LINKS = [("a", pa.binary()), ("b", pa.binary())]
STARS = [("leader", pa.int64()), ("member", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]


def by_unit(work, threshold: int, types: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow over rows (leader, bi, bj, block, member, hub, payload ...) in order of unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        now, rows = None, []
        for batch in batches:
            leader, bi, bj, block, member, hub = (batch.column(k).to_pylist() for k in range(6))
            payload = list(zip(*(batch.column(k).to_pylist() for k in range(6, batch.num_columns))))
            out = []
            for k in range(batch.num_rows):
                key = (leader[k], bi[k], bj[k])
                if key != now and rows:
                    out += work(rows, threshold) if len(rows) > 1 else []
                    rows = []
                now = key
                rows.append((block[k], member[k], hub[k], payload[k]))
            yield typed(out, types)
        yield typed(work(rows, threshold) if len(rows) > 1 else [], types)

    return run


def star(test, types: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow over rows (leader, salt, member, payload ...) in order of (leader, salt), leaders first: the pairs of
    a leader and a member that pass a test of their payloads. Nothing but the leader is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        now, hubs = None, []
        for batch in batches:
            leader, salt, member = (batch.column(k).to_pylist() for k in range(3))
            payload = list(zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns))))
            out = []
            for k in range(batch.num_rows):
                if (leader[k], salt[k]) != now:
                    now, hubs = (leader[k], salt[k]), []
                if member[k] == leader[k]:
                    hubs.append(payload[k])
                else:
                    out += [(leader[k], member[k], *found) for hub in hubs if (found := test(hub, payload[k])) is not None]
            yield typed(out, types)

    return run


def may_pass(threshold: int):
    def test(hub: tuple, one: tuple) -> tuple | None:
        (n, bits), (m, more) = hub, one
        fits = 100 * min(n, m) >= threshold * max(n, m)
        return () if fits and may_link(np.frombuffer(bits, np.uint8), np.frombuffer(more, np.uint8), n, m, threshold) else None

    return test


def is_linked(threshold: int):
    def test(hub: tuple, one: tuple) -> tuple | None:
        return (hub[0], one[0]) if linked(np.frombuffer(hub[1], np.uint64), np.frombuffer(one[1], np.uint64), threshold) else None

    return test


def blocks_of(many, shingles):
    return F.floor(F.greatest(many / GROUP, shingles / SHINGLES)) + 1


def large_groups(groups: DataFrame, label: str) -> DataFrame:
    """(leader, g): the groups of (leader, member, n) that are more than one unit, and how many blocks their classes fill."""
    sizes = groups.groupBy("leader").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"))
    sizes = sizes.filter((F.col("many") > ONE) | (F.col("shingles") > 2 * SHINGLES))
    return C.materialize(sizes.select("leader", blocks_of(F.col("many"), F.col("shingles")).alias("g")), label)


def in_star(groups: DataFrame, large: DataFrame, payload: DataFrame) -> DataFrame:
    """(leader, salt, member, payload ...) of the large groups of (leader, member, n) for ``star``: members dealt by salt, the leader with
    each of them. ``payload`` is joined by ``s1``."""
    salt = F.pmod(F.hash("member"), F.col("g")).cast("long").alias("salt")
    members = groups.join(large, "leader").select("leader", salt, "member")
    hubs = large.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("salt"), F.col("leader").alias("member"))
    rows = members.unionByName(hubs).join(payload.withColumnRenamed("s1", "member"), "member")
    more = [c for c in payload.columns if c != "s1"]
    return (rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member") != F.col("leader"))
            .select("leader", "salt", "member", *more))


def in_units(groups: DataFrame, large: DataFrame, payload: DataFrame, threshold: int, label: str) -> DataFrame:
    """(leader, bi, bj, block, member, hub, payload ...) of (leader, member, hub, n) for ``by_unit``: a pair of blocks is a unit if one of them
    at least has members without a hub and their sizes let them link, which takes steps of size that differ by one at most."""
    step = F.floor(F.log("n") / (float(np.log(100 / threshold)) * 1.000001) if threshold < 100 else F.col("n")).cast("long")
    cut = groups.join(large.withColumnRenamed("g", "blocks"), "leader", "left")
    cut = cut.withColumn("step", F.when(F.col("blocks").isNull(), 0).otherwise(step))
    own = cut.groupBy("leader", "step").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"), F.max("blocks").alias("blocks"))
    g = F.when(F.col("blocks").isNull(), 1).otherwise(blocks_of(F.col("many"), F.col("shingles"))).alias("g")
    own = C.materialize(own.select("leader", "step", g), f"{label}-steps")
    cut = cut.join(own, ["leader", "step"]).withColumn("sub", F.pmod(F.hash("member"), F.col("g")).cast("long"))
    open_ = cut.filter("hub is null").groupBy("leader", "step").agg(F.collect_set("sub").alias("open"))  # g blocks at most
    blocks = C.materialize(own.join(open_, ["leader", "step"], "left").withColumn("open", F.coalesce("open", F.array().cast("array<bigint>"))), f"{label}-open")
    mine = blocks.select("leader", "step", F.col("open").alias("mine"))
    near = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    asks = cut.drop("g").join(mine, ["leader", "step"]).withColumn("away", F.explode(near)).withColumn("to", F.col("step") + F.col("away"))
    meets = asks.join(blocks.withColumnRenamed("step", "to"), ["leader", "to"])
    others = F.when(F.array_contains("mine", F.col("sub")), F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).otherwise(F.col("open"))
    name = lambda step, sub: F.col(step) * F.lit(1 << 32) + F.col(sub)
    dealt = meets.withColumn("its", F.explode(others)).withColumn("other", name("to", "its")).withColumn("block", name("step", "sub"))
    dealt = dealt.select("leader", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "member", "hub")
    rows = dealt.join(payload.withColumnRenamed("s1", "member"), "member")
    more = [c for c in payload.columns if c != "s1"]
    return (rows.repartition("leader", "bi", "bj").sortWithinPartitions("leader", "bi", "bj")
            .select("leader", "bi", "bj", "block", "member", "hub", *more))


def set_rows(width: int, separator: np.ndarray):
    """A function for mapInArrow over (s1, s2, node, text): the whole sets of the rows whose signature is the one expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        for batch in batches:
            for part, data, offsets in C.slices(batch):
                h, bounds = C.batch_shingles(data, offsets, width, separator)
                want = list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("s1", "s2", "node"))))
                out = []
                for i, (s1, s2, node) in enumerate(want):
                    u = np.unique(h[bounds[i]:bounds[i + 1]])
                    if set_signature(u) == (s1, s2):
                        out.append((s1, node, u.tobytes()))
                s1, node, sets = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(node, pa.binary()), pa.array(sets, pa.binary())], names=["s1", "node", "entries"])

    return run


def similar_groups(docs: DataFrame, width: int = 5, threshold: int = 80, separator: np.ndarray = C.ASCII_SPACE) -> DataFrame:
    """(k2, doc_id, n_shingles, class_id, component_id, root): one row per document.

    Sets link when 100 * intersection >= ``threshold`` * union; k2 is the key of the row's content and class_id the
    smallest id among documents with an equal set. root is the component itself, a content key: ids may be null or equal in several."""
    spark = C.prepared(docs)
    keyed = docs.select(C.text_key(F.col("doc_id"), F.col("text")).alias("k2"), "doc_id", "text")
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, width, separator))
    parts = C.pieces(spark, C.total_bytes(docs) * (100 - threshold) // 600, ENTRIES)
    stage = C.materialize(keyed.mapInArrow(member_rows(width, threshold, separator, heavy, parts), MEMBERS), "jaccard-members")
    members = stage.filter("mark is null").select("k2", "doc_id", "n", "s1", "s2", "bits")
    packed = stage.filter("part is not null").select("part", "mark", "entries")
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "leader long, member long, hot long")
    met = C.materialize(met, "jaccard-meet")
    kept = stage.filter("hot is not null").select("hot", "entries").join(met.filter("hot is not null").select("hot", "leader"), "hot")
    kept = kept.select("leader", "entries").mapInArrow(unpacked, "leader long, member long")
    one = [F.min("doc_id").alias("class_id"), F.min("k2").alias("node"), F.max("n").alias("n"), F.max("bits").alias("bits")]
    classes = C.materialize(members.filter("n > 0").groupBy("s1", "s2").agg(*one), "jaccard-classes")
    sizes = classes.groupBy(F.col("s1").alias("member")).agg(F.max("n").alias("n"))
    groups = met.filter("member is not null").select("leader", "member").unionByName(kept).distinct().join(sizes, "member").select("leader", "member", "n")
    groups = C.materialize(groups, "jaccard-groups")

    def whole_sets(wanted: DataFrame, label: str) -> DataFrame:
        wanted = C.materialize(wanted.select("node", "s1", "s2"), f"{label}-wanted")
        texts = keyed.select("k2", "text").join(wanted.hint("merge"), F.col("k2") == F.col("node")).select("s1", "s2", "node", "text")  # the same way at every size
        return C.materialize(texts.mapInArrow(set_rows(width, separator), "s1 long, node binary, entries binary").dropDuplicates(["node"]), label)

    signed = classes.select("s1", "n", "bits")
    large = large_groups(groups, "jaccard-large")
    passed = in_star(groups, large, signed).mapInArrow(star(may_pass(threshold), STARS[:2]), "leader long, member long")
    passed = C.materialize(passed.distinct(), "jaccard-passed")
    asked = passed.select(F.col("member").alias("s1")).unionByName(passed.select(F.col("leader").alias("s1"))).distinct()
    sets = whole_sets(classes.join(asked, "s1", "left_semi"), "jaccard-sets")
    stars = in_star(passed, large, sets).mapInArrow(star(is_linked(threshold), STARS), "leader long, member long, a binary, b binary")
    stars = C.materialize(stars, "jaccard-star-links")
    joined = stars.select("leader", "member", F.col("leader").alias("hub")).distinct()
    rest = groups.join(joined, ["leader", "member"], "left").select("leader", "member", "hub", "n")
    leaders = groups.select("leader").distinct().join(large, "leader", "left_anti").select("leader", F.col("leader").alias("member"))
    leaders = leaders.join(sizes, "member").select("leader", "member", F.lit(None).cast("long").alias("hub"), "n")  # of large groups they have met all
    rest = C.materialize(rest.unionByName(leaders), "jaccard-rest")
    near = in_units(rest, large, signed, threshold, "jaccard-units").mapInArrow(by_unit(signature_groups, threshold, NEAR), "leader long, member long, hub long")
    near = C.materialize(near.distinct().join(sizes, "member").select("leader", "member", "hub", "n"), "jaccard-near")
    more = classes.join(near.select(F.col("member").alias("s1")), "s1", "left_semi").join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(whole_sets(more, "jaccard-more-sets"))
    near_large = large_groups(near, "jaccard-near-large")
    pairs = in_units(near, near_large, sets, threshold, "jaccard-set-units").mapInArrow(by_unit(set_links, threshold, LINKS), "a binary, b binary")
    links = C.materialize(stars.select("a", "b").unionByName(pairs), "jaccard-links")
    comps = C.connected_components(links, "jaccard-cc")
    placed = classes.join(comps, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    placed = C.materialize(placed.join(smallest, "root").select("s1", "s2", "class_id", "component_id", "root"), "jaccard-placed")
    own = F.col("n") == 0
    return members.join(placed, ["s1", "s2"], "left").select(
        "k2", "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.col("k2")).otherwise(F.col("root")).alias("root"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one of each group of near copies stays: that with the smallest id, and among equal
    ids that with the smallest content key; of rows that are equal in id and text, one stays."""
    groups = similar_groups(docs, width, threshold)
    ranked = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k2")
    linked = groups.filter("n_shingles > 0")
    kept = linked.groupBy("root").agg(F.min(ranked).alias("r")).select(F.col("r.k2").alias("k2"))
    kept = kept.unionByName(groups.filter("n_shingles = 0").select("k2")).distinct().withColumnRenamed("k2", C.KEY)
    return C.keyed(docs).join(C.materialize(kept, "jaccard-kept"), C.KEY, "left_semi").dropDuplicates([C.KEY]).select(*docs.columns)
