"""Shared parts: storage between stages, batch tokenisation in NumPy, document keys, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltbed.session import materialize, scratch_dir, table

__all__ = ["materialize", "scratch_dir", "table"]

SLICE_BYTES = 1 << 20  # text that one NumPy pass holds; a longer text makes a slice of its own

# Odd 64-bit multipliers of the SplitMix64 finaliser, and its increment.
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x1000193))


BYTE_VALUES = _byte_values()
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``SLICE_BYTES`` of text, each with its bytes and offsets."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


# Byte classes.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text): maximal runs of bytes that aren't separators; none crosses a text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    before = np.empty(len(word), bool)
    before[0], before[1:] = False, word[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(word), bool)
    after[-1], after[:-1] = False, word[1:]
    cut = inner[(inner > 0)] - 1
    after[cut] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


LONG = 64  # bytes from which a word is hashed by itself


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in lower case (A-Z): its length, then eight bytes at a time, go through a finaliser, so
    that words differ by chance alone. Long words are digested whole."""
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), low.data, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i]:ends[i]].data, digest_size=8).digest(), "little")
    at = np.flatnonzero(size <= LONG)
    done = 0
    while len(at):
        left = size[at] - done
        part = eights[starts[at] + done]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[at] = mix(out[at] ^ part)
        done += 8
        at = at[left > 8]
    return out


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): runs of ``width`` words within a text; a text with fewer words gives its whole sequence as one."""
    n, counts = len(words), np.diff(bounds)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            acc = mix(acc ^ words[k:n - width + 1 + k]) if len(acc) else acc
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_bounds[-1], np.uint64)
    full = counts >= width
    if full.any():
        text_of = np.repeat(np.flatnonzero(full), made[full])
        src = np.arange(len(text_of)) - np.repeat(np.cumsum(made[full]) - made[full], made[full]) + bounds[text_of]
        dst = np.arange(len(text_of)) - np.repeat(np.cumsum(made[full]) - made[full], made[full]) + out_bounds[text_of]
        out[dst] = acc[src]
    for i in np.flatnonzero(~full & (counts > 0)):
        h = np.zeros(1, np.uint64)
        for w in words[bounds[i]:bounds[i + 1]]:
            h = mix(h ^ w)
        out[out_bounds[i]] = mix(h ^ np.uint64(counts[i]))[0]
    return out, out_bounds


def batch_shingles(data: np.ndarray, offsets: np.ndarray, width: int, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = word_spans(data, offsets, separator)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return shingle_hashes(word_hashes(data, starts, ends), bounds, width)


KEY = "__content_key__"  # the key's name beside columns of the caller's


def text_key(doc_id: Column, text: Column) -> Column:
    """A key of a row by what it holds, 128 bits: equal rows get equal keys on every read of a table, whatever the order."""
    plain = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(doc_id.isNull(), "-").otherwise(":"), F.when(text.isNull(), "-").otherwise(":"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(plain))


def key_pair(doc_id: Column, text: Column) -> list[Column]:
    """The same as two longs ``ka`` and ``kb``, for packed entries."""
    return [F.xxhash64(F.lit(seed), doc_id.isNull(), doc_id, text.isNull(), text).alias(name) for seed, name in ((0x5EED, "ka"), (0x0DD, "kb"))]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with the key of their content in ``KEY``; all other columns stay."""
    return docs.withColumn(KEY, text_key(F.col("doc_id"), F.col("text")))


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node of each component, from (a, b) edges.

    Alternates large-star and small-star steps, each a map-side combinable minimum and an equality join, until
    nothing changes; each round is written to shared storage. Rounds grow with the logarithm of the size."""
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        wide = both(e)
        low = materialize(wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
        large = wide.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, label)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(low, "a")
        nxt = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialize(nxt.filter("a <> b").distinct(), label)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return materialize(nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")), label)


BATCH_ROWS, BATCH_BYTES = 256, 64 << 20  # of an Arrow batch, so that a batch of long texts fits a worker


def prepared(df: DataFrame) -> SparkSession:
    """The session, set to small Arrow batches. The setting is read when a plan runs, so it stays; it changes no result."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


KEPT: dict = {}  # what a Python worker keeps for later tasks of an operator


def release() -> None:
    """What an earlier operator's tasks left in this worker goes back to the system: workers outlive a stage, and the next one needs the room."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in a table, by one scan."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def pieces(spark: SparkSession, n: int, per_piece: int) -> int:
    """How many parts of about ``per_piece`` n units make: grows with the data, so a part does not."""
    return max(1, -(-n // per_piece))
