"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights floor(256 x). Candidates are dealt into blocks, queries into groups, and each (block,
group) is one bounded task unit: the block's postings are built by term, each query term scatters its weighted postings into
dense score arrays (``AT_ONCE`` queries at a time), a partition selection keeps the k best of the block, and the blocks' winners are merged by a
combinable top-k. Every query meets every row but itself; no score is bounded or skipped.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors lack the further terms, so those
score 0; empty vectors score 0. Ties go to the smaller vec_id; a query is left out by its vec_id, so repeated ids are all left
out. Null vec_ids take no part. Inner products must fit a long. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from siltbed.llm import common as C

BLOCK = 4096  # candidates of a block
GROUP = 8192  # queries of a group
AT_ONCE = 512  # queries whose dense scores a task holds together
DENSE = 0.5  # share of a block's rows from which a posting list is added as a whole column


def weights(vectors: DataFrame) -> DataFrame:
    """(vec_id, w) of the vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        F.coalesce(x, F.array().cast("array<float>")), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("w"))


def padded(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of weights as a matrix; missing terms are 0."""
    some = lists.combine_chunks()
    sizes = some.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = some.flatten().to_numpy()
    return out


def best_of_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best candidates in the block."""
    order = np.argsort(ids, kind="stable")
    ids, block = ids[order], block[order]  # ids ascend, so ties go to the smaller
    postings = [np.flatnonzero(block[:, term]) for term in range(block.shape[1])]
    weights_of = [np.ascontiguousarray(block[:, term]) for term in range(block.shape[1])]
    out = [(np.zeros(0, np.int64),) * 3]
    for start in range(0, len(queries), AT_ONCE):
        some = queries[start:start + AT_ONCE]
        scores = np.zeros((len(some), len(block)), np.int64)
        for term, (rows, weight) in enumerate(zip(postings, weights_of)):
            wanting = np.flatnonzero(some[:, term])
            if not len(rows) or not len(wanting):
                continue
            if len(rows) >= DENSE * len(block) and len(wanting) >= DENSE * len(some):
                scores += some[:, term, None] * weight[None, :]
            else:
                scores[np.ix_(wanting, rows)] += some[wanting, term, None] * weight[None, rows]
        for q, row in zip(query_ids[start:start + AT_ONCE], scores):
            first, last = np.searchsorted(ids, q, side="left"), np.searchsorted(ids, q, side="right")
            row, names = (row, ids) if first == last else (np.delete(row, slice(first, last)), np.delete(ids, slice(first, last)))
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row > least)
                at = np.concatenate([at, np.flatnonzero(row == least)[:k - len(at)]])
            else:
                at = np.arange(len(row))
            out.append((np.full(len(at), q), names[at], row[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def score_units(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("w"), right.column("w")
        width = max((int(pc.max(pc.list_value_length(some)).as_py() or 0) for some in lists), default=0)
        ids, qs = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q, v, s = best_of_block(ids, padded(lists[0], width), qs, padded(lists[1], width), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return run


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row that ``is_query`` (a condition) selects."""
    C.prepared(vectors)
    rows = C.materialize(weights(vectors), "topk-weights")
    blocks = C.pieces(rows.sparkSession, rows.count(), BLOCK)
    queries = rows.filter(is_query)
    groups = C.pieces(rows.sparkSession, queries.count(), GROUP)
    spread = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("b", spread(blocks)).withColumn("g", every(groups))
    right = queries.withColumn("g", spread(groups)).withColumn("b", every(blocks))
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(score_units(k), "query_id long, vec_id long, score long")
    # Repeated query rows are asked once each and give the same answers; one of them is kept.
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if_repeated = queries.groupBy("vec_id").agg(F.count("*").alias("times"))
    found = C.materialize(found, "topk-found")
    once = found.groupBy("query_id", "vec_id", "score").agg(F.count("*").alias("n")).join(if_repeated.withColumnRenamed("vec_id", "query_id"), "query_id")
    each = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.ceil(F.col("n") / F.col("times")).cast("int")))))
    ranked = each.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

