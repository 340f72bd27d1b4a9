"""Benchmark decontamination: test items that documents contain, by size-partitioned MinHash sketches.

Items are partitioned by their number of shingles. An item of n shingles, of which a document must hold t n at least,
keeps the n - ceil(t n) + 1 smallest hashes as its MinHash sketch: a document that holds enough of the item must hold one
of them, so the search misses nothing, however long the document is. A document with fewer shingles than any item of a partition
needs isn't looked up there. Documents are scanned in place and never moved; the sketches go to all tasks in chunks of ``CHUNK``
hashes (or one item, if that has more), with one scan for each chunk, so a broadcast never grows with the benchmark. Partitions of
neighbouring sizes share a chunk, one beyond a chunk is cut by a hash of its items; equal items are searched once. Every candidate is
verified on the words of its shingles, not on hashes.

Words are runs of letters and digits in lower case (bytes from 0x80 count as letters); a shingle is five of them. An item of fewer words
is one shingle, its whole sequence, which a document holds where the words stand in it side by side; ``decontaminate`` leaves such items
out, as one word is no leak. Null and empty texts and items match nothing. Repeated rows and equal ids are all searched; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltbed.llm import common as C

CHUNK = 2_000_000  # hashes of items that one broadcast holds


def item_sets(width: int):
    """A function for mapInArrow: the words of each text that has any, apart by spaces, its shingles' width, number and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.slices(batch):
                starts, ends, bounds = C.word_spans(data, offsets, C.NOT_ALNUM)
                h = C.word_hashes(data, starts, ends)
                rows = []
                for i, item in enumerate(part.column(0).to_pylist()):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b:
                        wide = min(width, int(b - a))
                        u = np.unique(C.shingle_hashes(h[a:b], np.array([0, b - a]), wide)[0])
                        rows.append((item, b" ".join(data[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b])), wide, len(u), u.tobytes()))
                cols = list(zip(*rows)) if rows else [()] * 5
                types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "words", "width", "n", "hashes"])

    return run


def windows(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[k:k + width]) for k in range(len(words) - width + 1)}


class SketchIndex:
    """Sketches of one chunk of items, partitioned by width and size: hash to items, and the items themselves for verification."""

    def __init__(self, items: list[tuple], threshold: int):
        """Items are (words, width, hashes)."""
        self.threshold = threshold
        self.words = [w for w, _, _ in items]
        self.ids = [hashlib.md5(w).digest() for w in self.words]
        self.sets = [np.frombuffer(s, np.uint64) for _, _, s in items]
        self.need = [self.least(len(s)) for s in self.sets]
        self.shingles: dict[int, set[bytes]] = {}
        of_size: dict[tuple[int, int], list[int]] = {}
        for i, (_, width, _) in enumerate(items):
            of_size.setdefault((width, len(self.sets[i]).bit_length()), []).append(i)
        #: By width: (least need, sorted hashes, cuts, items) of each size.
        self.partitions: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (width, _), members in sorted(of_size.items()):
            sketches = [self.sets[i][:len(self.sets[i]) - self.need[i] + 1] for i in members]
            h, who = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
            order = np.argsort(h, kind="stable")
            keys, cuts = np.unique(h[order], return_index=True)
            self.partitions.setdefault(width, []).append((min(self.need[i] for i in members), keys, np.append(cuts, len(h)), who[order]))

    def least(self, n: int) -> int:
        """Shingles of an item of n that a document must hold."""
        return -(-self.threshold * n // 100)

    def candidates(self, width: int, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, set[int]]]:
        """(text, items of which it may hold enough) of texts whose shingles are h[at[i]:at[i + 1]]."""
        sizes, hits = np.diff(at), []
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for k, (least, keys, _, _) in enumerate(self.partitions[width]):
            looked = np.flatnonzero((sizes >= least)[owner])
            x = np.minimum(np.searchsorted(keys, h[looked]), len(keys) - 1)
            hit = np.flatnonzero(keys[x] == h[looked])
            hits.append(np.stack([owner[looked[hit]], np.full(len(hit), k), x[hit]], axis=1))
        found = np.unique(np.concatenate(hits), axis=0)
        cuts = np.flatnonzero(np.diff(found[:, 0], prepend=-1)) if len(found) else []
        for a, b in zip(cuts, [*cuts[1:], len(found)]):
            some: set[int] = set()
            for k, x in found[a:b, 1:].tolist():
                _, _, ends, who = self.partitions[width][k]
                some.update(who[ends[x]:ends[x + 1]].tolist())
            yield int(found[a, 0]), some

    def held(self, i: int, width: int, of_hash: tuple[np.ndarray, np.ndarray, np.ndarray], spelled) -> tuple[int, int] | None:
        """(shared, all) distinct shingles of item i if a text holds enough of them; ``of_hash`` is the text's sorted hashes, where each
        one's positions begin in the list of positions, and that list; ``spelled`` gives the words at a position."""
        u, cuts, order = of_hash
        at = np.minimum(np.searchsorted(u, self.sets[i]), len(u) - 1)
        at = at[u[at] == self.sets[i]]
        if len(at) < self.need[i]:
            return None
        if i not in self.shingles:
            self.shingles[i] = windows(self.words[i].split(b" "), width)
        mine, shared = self.shingles[i], set()
        for x in at.tolist():
            for p in order[cuts[x]:cuts[x + 1]].tolist():
                if (s := spelled(p)) in mine:
                    shared.add(s)
                    break  # what else has this hash is the same shingle again, or none of the item's
        return (len(shared), len(mine)) if len(shared) >= self.least(len(mine)) else None


def search(index):
    """A function for mapInArrow over (key, doc_id, text): the items that each document contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: SketchIndex = index.value
        for batch in batches:
            for part, data, offsets in C.slices(batch):
                starts, ends, bounds = C.word_spans(data, offsets, C.NOT_ALNUM)
                words = C.word_hashes(data, starts, ends)
                out = []
                for width in x.partitions:
                    h, at = C.shingle_hashes(words, bounds, width)
                    short = np.diff(bounds) < width  # their one shingle is narrower
                    if short.any():
                        keep = np.repeat(~short, np.diff(at))
                        h, at = h[keep], np.concatenate([[0], np.cumsum(np.diff(at) * ~short)])
                    for doc, some in x.candidates(width, h, at):
                        u, n = np.unique(mine := h[at[doc]:at[doc + 1]], return_counts=True)
                        of_hash = u, np.concatenate([[0], np.cumsum(n)]), np.argsort(mine, kind="stable")
                        base = bounds[doc]

                        def spelled(p: int) -> bytes:
                            return b" ".join(data[starts[k]:ends[k]].tobytes() for k in range(base + p, base + p + width))

                        for i in sorted(some):
                            if found := x.held(i, width, of_hash, spelled):
                                out.append((doc, x.ids[i], *found))
                doc, item, shared, n = zip(*out) if out else ((), (), (), ())
                rows = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(item, pa.binary()), pa.array(shared, pa.int64()), pa.array(n, pa.int64())],
                                                 names=["k2", "doc_id", "item", "shared", "n_item"])

    return run


def chunks_of(sizes: list[tuple[int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """Chunks of (size class, pieces that it is cut into, piece), from (size class, hashes): neighbours share a
    chunk of up to ``most`` hashes."""
    out, held = [], most + 1
    for size, n in sorted(sizes):
        if held + n <= most:
            out[-1].append((size, 1, 0))
            held += n
        else:
            cut = -(-n // most)
            out += [[(size, cut, k)] for k in range(cut)]
            held = n if cut == 1 else most + 1
    return out


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 80, short: bool = True) -> DataFrame:
    """(k2, doc_id, item_id, shared, n_item): every item of which a document holds ``threshold`` percent of the shingles at
    least; k2 is the key of the row's content. Without ``short`` items of fewer than ``width`` words match nothing."""
    spark = C.prepared(docs)
    lower = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    every = items.select(F.col("item_id").cast("long").alias("item_id"), lower).mapInArrow(item_sets(width), "item_id long, words binary, width int, n long, hashes binary")
    every = C.materialize(every if short else every.filter(F.col("width") == width), "benchmark-items")
    sets = C.materialize(every.groupBy("words").agg(*[F.first(c).alias(c) for c in ("width", "n", "hashes")])
                         .withColumn("size", F.length(F.bin("n"))), "benchmark-sets")
    sizes = [tuple(r) for r in sets.groupBy("size").agg(F.sum("n")).collect()]  # 64 size classes at most
    keyed = docs.select(C.text_key(F.col("doc_id"), F.col("text")).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), lower)
    schema = "k2 binary, doc_id long, item binary, shared long, n_item long"
    out = spark.createDataFrame([], schema)
    for chunk in chunks_of(sizes, CHUNK):
        mine = F.lit(False)
        for size, cut, k in chunk:
            mine = mine | ((F.col("size") == size) & (F.pmod(F.xxhash64("words"), F.lit(cut)) == k))
        some = sorted(tuple(map(bytes_or_int, r)) for r in sets.filter(mine).select("words", "width", "hashes").collect())
        if some:
            index = spark.sparkContext.broadcast(SketchIndex(some, threshold))
            out = out.unionByName(keyed.mapInArrow(search(index), schema))
    names = every.select(F.unhex(F.md5("words")).alias("item"), "item_id")
    return out.join(names, "item").select("k2", "doc_id", "item_id", "shared", "n_item")


def bytes_or_int(x):
    return x if isinstance(x, int) else bytes(x)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The documents that contain no test item of ``width`` words or more."""
    found = contained_items(docs, items, width, threshold, short=False).select(F.col("k2").alias(C.KEY)).distinct()
    return C.keyed(docs).join(C.materialize(found, "benchmark-found"), C.KEY, "left_anti").select(*docs.columns)
