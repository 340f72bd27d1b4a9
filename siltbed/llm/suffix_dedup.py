"""Removal of repeated 200-byte strings by a distributed, common-prefix-aware suffix merge sort.

1. Every window of ``WINDOW`` bytes names its anchor: the position of its smallest ``GRAM``-byte hash (leftmost on
   ties). That depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and only
   suffixes that start at anchors need sorting: about one in fifty. The windows of an anchor are a range of offsets.
2. Anchors whose gram occurs once are dropped. Anchors with equal surroundings form one class (128 bits of hashes);
   a class of two or more is repeated throughout and goes on as one suffix.
3. Tasks sort the suffixes of their classes and exchange them as front-coded runs: common prefix with the one before,
   then the rest. A loser tree merges the runs of a part; a comparison starts behind the prefix that is known.
4. Neighbours' common prefixes give the blocks of suffixes that agree far enough to the right; within a block equal
   bytes to the left make equal windows. A gram with more than ``HOT`` classes is split by window instead: its
   windows are grouped by (gram, offset, hash of the window), combined before they move, so that no task holds a hot gram.
5. Each document gets the union of its repeated windows.

Nulls and empty texts have no bytes and lose none; texts below ``WINDOW`` bytes stay whole; repeated rows count as
separate documents, so both lose all of their windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltbed.llm import common as C

WINDOW, GRAM = 200, 100
ENTRIES = 500_000  # anchors of one packed part
MERGED = 10_000  # classes of one merge part
HOT = 2_000  # classes of a gram that are merged in one task
ENTRY = np.dtype([("h", "<i8"), ("c", "<i8"), ("ka", "<i8"), ("kb", "<i8"), ("pos", "<i4"), ("dlo", "<i2"), ("dhi", "<i2")])
BASE_2 = np.uint64(0xD6E8FEB86659FD93)
INVERSE_2 = np.uint64(pow(int(BASE_2), -1, 1 << 64))
VALUES_2 = C.mix(C.BYTE_VALUES ^ C.MIX_B)


class Hasher:
    """Hashes of any range of a byte string, by two independent prefix sums."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.one, self.back_one = self.sums(C.BYTE_VALUES[data] * C.powers(C.BASE, len(data))), C.powers(C.BASE_INVERSE, len(data) + 1)
            self.two, self.back_two = self.sums(VALUES_2[data] * C.powers(BASE_2, len(data))), C.powers(INVERSE_2, len(data) + 1)

    @staticmethod
    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=out[1:])
        return out

    def grams(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return C.mix((self.one[width:] - self.one[:-width]) * self.back_one[:len(self.one) - width])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return C.mix((self.two[end] - self.two[start]) * self.back_two[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width``, in three passes whatever the width."""
    m = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[width - 1:width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries without key, index of each one's text) of all windows that lie within a text."""
    none = np.zeros(0, ENTRY), np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none
    hasher = Hasher(data)
    grams = hasher.grams(GRAM)
    at = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | at, WINDOW - GRAM + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.diff(offsets) - WINDOW + 1
    inside = np.zeros(len(data) + 1, np.int8)
    long = room > 0
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[:-1] + room)[long], -1)
    p = np.flatnonzero(np.cumsum(inside)[:len(anchor)])
    if not len(p):
        return none
    a = anchor[p]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    cuts = np.flatnonzero(first)
    lo, hi, a = p[cuts], p[np.append(cuts[1:], len(p)) - 1], a[cuts]
    text = np.searchsorted(offsets, a, side="right") - 1
    out = np.empty(len(a), ENTRY)
    out["h"] = grams[a].view(np.int64)
    out["pos"], out["dlo"], out["dhi"] = a - offsets[text], a - hi, a - lo
    with np.errstate(over="ignore"):
        shape = ((a - hi) * 256 + (a - lo)).astype(np.uint64) * C.MIX_A
        out["c"] = C.mix(hasher.ranges(lo, hi + WINDOW) ^ shape).view(np.int64)
    return out, text


def anchor_parts(parts: int):
    """A function for mapInArrow: packed anchors by part.

    A gram that a flush holds twice is known to repeat: its entries are dealt evenly, and one mark per flush tells
    the gram's owner; so a hot gram loads no single part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate(held)
            e = e[np.argsort(e["h"], kind="stable")]
            same = e["h"][1:] == e["h"][:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            marks = e[twice & np.concatenate([[True], ~same])].copy()
            marks["pos"] = -1
            owned = np.concatenate([e[~twice], marks])
            blobs, names, known = [], [], []
            for rows, key, tag in ((owned, owned["h"], False), (e[twice], e[twice]["c"] ^ e[twice]["ka"], True)):
                part = (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ids, cuts = np.unique(part[order], return_index=True)
                rows = rows[order]
                for i, x, y in zip(ids, cuts, [*cuts[1:], len(rows)]):
                    names.append(int(i))
                    known.append(tag)
                    blobs.append(rows[x:y].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(known, pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "known", "entries"])

        for batch in batches:
            for part, data, offsets in C.slices(batch):
                e, text = anchors(data, offsets)
                for k in ("ka", "kb"):
                    e[k] = np.asarray(part.column(part.schema.get_field_index(k)))[text]
                held.append(e)
                n += len(e)
                if n >= ENTRIES:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order: the anchors whose gram occurs again."""

    def close(blobs: list[bytes], known: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(blobs), ENTRY)
        e = e[np.argsort(e["h"], kind="stable")]
        same = e["h"][1:] == e["h"][:-1]
        group = np.concatenate([[0], np.cumsum(~same)]) if len(e) else np.zeros(0, np.int64)
        many = np.bincount(group, minlength=1) > 1
        marked = np.zeros(len(many), bool)
        marked[group[e["pos"] < 0]] = True
        out = np.concatenate([e[(many | marked)[group] & (e["pos"] >= 0)] if len(e) else e, np.frombuffer(b"".join(known), ENTRY)])
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[at:at + 50_000][f]) for f in ENTRY.names], names=list(ENTRY.names))

    now, blobs, known = None, [], []
    for batch in batches:
        for part, tag, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if part != now and (blobs or known):
                yield from close(blobs, known)
                blobs, known = [], []
            now = part
            (known if tag else blobs).append(blob.as_py())
    if blobs or known:
        yield from close(blobs, known)


OCCURRENCE = "h long, c long, ka long, kb long, pos int, dlo short, dhi short"
ELEMENT = "part long, run binary, h long, c long, d int, w long"


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


HEAD = np.dtype([("lcp", "<u1"), ("rest", "<u1"), ("left", "<u1"), ("dlo", "<u1"), ("dhi", "<u1"), ("many", "<u1"), ("h", "<i8"), ("c", "<i8")])


def front_coded(elements: list[tuple]) -> bytes:
    """A sorted run of (right, left, h, c, many, dlo, dhi): fixed heads, then the rests of the suffixes, then the left contexts."""
    elements.sort(key=lambda x: (x[0], x[3]))
    head, rests, before = np.empty(len(elements), HEAD), [], b""
    for k, (right, left, h, c, many, dlo, dhi) in enumerate(elements):
        lcp = common_prefix(before, right, 0)
        rests.append(right[lcp:])
        head[k] = (lcp, len(right) - lcp, len(left), dlo, dhi, many, h, c)
        before = right
    return len(elements).to_bytes(4, "little") + head.tobytes() + b"".join(rests) + b"".join(x[1] for x in elements)


def decoded(run: bytes) -> Iterator[tuple]:
    """(suffix, common prefix with the one before, left, h, c, many, dlo, dhi) in order."""
    n = int.from_bytes(run[:4], "little")
    head = np.frombuffer(run, HEAD, n, 4)
    at = 4 + n * HEAD.itemsize
    left_at, before = at + int(head["rest"].sum(dtype=np.int64)), b""
    for lcp, rest, left, dlo, dhi, many, h, c in head.tolist():
        before = before[:lcp] + run[at:at + rest]
        yield before, lcp, run[left_at:left_at + left], h, c, many, dlo, dhi
        at, left_at = at + rest, left_at + left


def merge_runs(runs: list[bytes]) -> Iterator[tuple[tuple, int]]:
    """(element, common prefix with the element before) over all runs in order, by a loser tree.

    Every waiting head knows its common prefix with the last winner. Of two heads the one with the longer prefix is the
    smaller; only on a tie are bytes compared, and only those behind the prefix. The loser then knows its prefix with the winner."""
    sources = [decoded(r) for r in runs]
    k = 1
    while k < len(sources):
        k *= 2
    heads: list[tuple | None] = [next(s, None) for s in sources] + [None] * (k - len(sources))
    known = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is set against the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x[0], y[0], known[a])
        u, v = x[0], y[0]
        a_first = len(u) <= len(v) if n == min(len(u), len(v)) else u[n] < v[n]
        known[b if a_first else a] = n
        return (a, b) if a_first else (b, a)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if k > 1 else 0
    while (best := heads[top]) is not None:
        yield best, known[top]
        heads[top] = nxt = next(sources[top], None)
        known[top] = nxt[1] if nxt else 0
        node, now = (top + k) // 2, top
        while node:
            now, loser[node] = play(now, loser[node])
            node //= 2
        top = now


def common_suffix(a: bytes, b: bytes) -> int:
    return common_prefix(a[::-1], b[::-1], 0)


def repeated_offsets(group: list[tuple], prefixes: list[int]) -> list[tuple[int, int, list[int]]]:
    """(h, c, offsets that repeat as from, to, from, to ...) of a gram's classes in suffix order.

    ``prefixes[i]`` is the common prefix of suffixes i - 1 and i. Classes that are repeated as a whole take part, but need no answer."""
    out: list[tuple[int, int, list[int]]] = []
    if len(group) == 2:
        (x, _, xl, *_), (y, _, yl, *_) = group
        dlo, dhi = max(group[0][6], group[1][6]), min(group[0][7], group[1][7])
        dlo, dhi = max(dlo, WINDOW - prefixes[1]), min(dhi, common_suffix(xl, yl))
        return [(g[3], g[4], [dlo, dhi]) for g in group if not g[5] and dlo <= dhi]
    hits: list[list[int]] = [[] for _ in group]
    for d in range(min(g[6] for g in group), max(g[7] for g in group) + 1):
        seen: dict[bytes, int] = {}
        for i, g in enumerate(group):
            if i and prefixes[i] < WINDOW - d:
                seen = {}
            if g[6] <= d <= g[7]:
                left = g[2]
                key = left[len(left) - d:]
                other = seen.setdefault(key, i)
                if other != i:
                    if not hits[other] or hits[other][-1] != d:
                        hits[other].append(d)
                    hits[i].append(d)
    for g, ds in zip(group, hits):
        if ds and not g[5]:
            out.append((g[3], g[4], joined(ds)))
    return out


def joined(ds: list[int]) -> list[int]:
    """Ascending numbers as from, to, from, to ..."""
    spans = [ds[0], ds[0]]
    for d in ds[1:]:
        if d == spans[-1] + 1:
            spans[-1] = d
        else:
            spans += [d, d]
    return spans


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order: merge the runs and answer for each gram."""

    def close(runs: list[bytes]) -> pa.RecordBatch:
        found, group, prefixes, classes = [], [], [], set()
        for element, lcp in merge_runs(runs):
            if lcp < GRAM and group:
                if len(group) > 1:
                    found.extend(repeated_offsets(group, prefixes))
                group, prefixes, classes = [], [], set()
            if (element[3], element[4]) in classes:  # a class that was sent twice
                continue
            classes.add((element[3], element[4]))
            group.append(element)
            prefixes.append(lcp)
        if len(group) > 1:
            found.extend(repeated_offsets(group, prefixes))
        h, c, spans = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["h", "c", "spans"])

    now, runs = None, []
    for batch in batches:
        for part, run in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part != now and runs:
                yield close(runs)
                runs = []
            now = part
            runs.append(run.as_py())
    if runs:
        yield close(runs)


def element_rows(parts: int):
    """A function for mapInArrow over (text, marks): front-coded runs of the classes' suffixes, and single windows of hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            names, runs = list(held), [front_coded(v) for v in held.values()]
            nulls = pa.nulls(len(names), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(runs, pa.binary()), nulls, nulls, pa.nulls(len(names), pa.int32()), nulls], names=FIELDS)

        last = None
        for batch in batches:
            texts, marks, ka, kb = (batch.column(k) for k in range(4))
            for i in range(batch.num_rows):
                if last == (last := (ka[i].as_py(), kb[i].as_py())):  # a repeated row: the join puts them side by side
                    continue
                text = texts[i].as_py().encode()
                hasher = None
                for m in marks[i].as_py():
                    pos, dlo, dhi = m["pos"], m["dlo"], m["dhi"]
                    if not m["hot"]:
                        held.setdefault(m["h"] % parts, []).append((text[pos:pos - dlo + WINDOW], text[pos - dhi:pos], m["h"], m["c"], m["many"], dlo, dhi))
                        n += 1
                        continue
                    hasher = hasher or Hasher(np.frombuffer(text, np.uint8))
                    ds = np.arange(dlo, dhi + 1)
                    w = hasher.ranges(pos - ds, pos - ds + WINDOW).view(np.int64)
                    nulls = pa.nulls(len(ds), pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        nulls, pa.nulls(len(ds), pa.binary()), pa.array(np.full(len(ds), m["h"], np.int64)), pa.array(np.full(len(ds), m["c"], np.int64)),
                        pa.array(ds, pa.int32()), pa.array(w)], names=FIELDS)
                if n >= 5 * MERGED:
                    yield flush()
                    held, n = {}, 0
        if held:
            yield flush()

    return run


FIELDS = ["part", "run", "h", "c", "d", "w"]


def removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans as start, end structs) to the digest of what stays; overlapping and touching spans are one."""
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = (text or "").encode()
            s = np.array([(x["s"], x["e"]) for x in spans or ()], np.int64).reshape(-1, 2)
            s = s[np.argsort(s[:, 0], kind="stable")]
            reach = np.maximum.accumulate(s[:, 1]) if len(s) else s[:, 1]
            cut = np.flatnonzero(s[1:, 0] > reach[:-1]) + 1
            starts = s[np.concatenate([[0], cut]), 0] if len(s) else []
            ends = reach[np.concatenate([cut - 1, [len(s) - 1]])] if len(s) else []
            kept, at = hashlib.sha256(), 0
            for x, y in zip(starts, ends):
                kept.update(data[at:x])
                at = y
            kept.update(data[at:])
            out.append((doc_id, len(data), int(sum(ends) - sum(starts)), len(starts), kept.hexdigest(), [int(v) for p in zip(starts, ends) for v in p]))
        cols = list(zip(*out)) if out else [()] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): one row per document; spans are byte offsets start, end, ..."""
    spark = C.prepared(docs)
    key = ["ka", "kb"]
    keyed = docs.select(*C.key_pair(F.col("doc_id"), F.col("text")), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = C.pieces(spark, C.total_bytes(docs) // (GRAM // 2), ENTRIES // 5)
    packed = keyed.select(*key, "text").mapInArrow(anchor_parts(parts), "part long, known boolean, entries binary")
    occ = packed.repartition("part").sortWithinPartitions("part").mapInArrow(repeated_anchors, OCCURRENCE)
    occ = C.materialize(occ, "suffix-occurrences")
    one = F.min(F.struct(*key, "pos", "dlo", "dhi")).alias("one")
    classes = C.materialize(occ.groupBy("h", "c").agg(F.count("*").alias("n"), one).select("h", "c", "n", "one.*"), "suffix-classes")
    grams = C.materialize(classes.groupBy("h").agg(F.count("*").alias("n_classes")).filter("n_classes > 1"), "suffix-grams")
    open_ = classes.join(grams, "h").withColumn("mark", F.struct(
        "pos", F.col("dlo").cast("int").alias("dlo"), F.col("dhi").cast("int").alias("dhi"), "h", "c", (F.col("n") > 1).cast("int").alias("many"), (F.col("n_classes") > HOT).alias("hot")))
    marks = open_.groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    n_parts = C.pieces(spark, classes.count(), MERGED)
    elements = keyed.select(*key, "text").join(C.materialize(marks, "suffix-marks").hint("merge"), key).select("text", "marks", *key)
    elements = C.materialize(elements.mapInArrow(element_rows(n_parts), ELEMENT), "suffix-runs")
    runs = elements.filter("part is not null").select("part", "run").repartition("part").sortWithinPartitions("part")
    found = runs.mapInArrow(merged, "h long, c long, spans array<int>")
    windows = elements.filter("part is null").select("h", "c", "d", "w")
    shared = C.materialize(windows.groupBy("h", "d", "w").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("h", "d", "w"), "suffix-windows")
    by_window = windows.join(shared, ["h", "d", "w"]).select("h", "c", F.array("d", "d").alias("spans"))
    whole = classes.filter("n > 1").select("h", "c", F.array(F.col("dlo").cast("int"), F.col("dhi").cast("int")).alias("spans"))
    answers = C.materialize(found.unionByName(by_window).unionByName(whole), "suffix-answers")
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(
        (F.col("pos") - F.element_at("spans", i + 2)).alias("s"), (F.col("pos") - F.element_at("spans", i + 1) + WINDOW).alias("e")))
    cover = occ.join(answers, ["h", "c"]).select(*key, F.explode(pairs).alias("p"))
    cover = C.materialize(cover.groupBy(*key).agg(F.collect_set("p").alias("p")), "suffix-cover")
    return (keyed.join(cover, key, "left").select("doc_id", "text", "p")
            .mapInArrow(removal_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>"))
