"""Reads: newest-wins state, point, range and prefix access, paging and iteration.

All reads are declarative filters over the log, so Parquet statistics prune by key. The newest
version is a map-side combinable ``max_by``: a hot key never meets in one task before it is reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from siltbed.log import is_reserved

LAST_TWO_BYTE_BOUND = "ÿ"  # the legacy upper bound of a prefix scan


def newest_versions(log: DataFrame) -> DataFrame:
    """One row per key with its newest version, tombstones included (merge on read)."""
    payload = [c for c in log.columns if c not in ("key", "seq")]
    picked = F.max_by(F.struct("seq", *payload), F.col("seq")).alias("v")
    return log.groupBy("key").agg(picked).select("key", "v.*")


def latest_state(log: DataFrame) -> DataFrame:
    """Live keys only: deletes are dropped after the newest version is known, never before."""
    return newest_versions(log).filter(~F.col("tombstone"))


def user_keys(state: DataFrame) -> DataFrame:
    """Hide the engine's own keys."""
    return state.filter(~is_reserved(F.col("key")))


def point_get(log: DataFrame, key: str) -> DataFrame:
    """Zero or one row: the live value of a key. The key filter runs in the scan."""
    return latest_state(log.filter(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Live values of many keys; ``keys`` has a column ``key`` and may be of any size."""
    return latest_state(log.join(keys.select("key").distinct(), "key", "left_semi"))


def range_scan(log: DataFrame, first: str, last: str) -> DataFrame:
    """Live user keys in the closed range; an inverted range is empty."""
    return user_keys(latest_state(log.filter(F.col("key").between(first, last))))


def prefix_scan(log: DataFrame, prefix: str, legacy_bound: bool = False) -> DataFrame:
    """Live user keys that begin with ``prefix``.

    ``legacy_bound`` reads [prefix, prefix + U+00FF] instead, which misses keys whose next character
    lies above U+00FF.
    """
    if legacy_bound:
        return range_scan(log, prefix, prefix + LAST_TWO_BYTE_BOUND)
    return user_keys(latest_state(log.filter(F.col("key").startswith(prefix))))


def page(state: DataFrame, page_size: int, page_num: int) -> DataFrame:
    """Page ``page_num`` (from 1) in key order with its ordinals; the sort is a distributed top-k."""
    if page_size < 1 or page_num < 1:
        raise ValueError("page_size and page_num start at 1")
    skip = (page_num - 1) * page_size
    rows = state.orderBy("key").offset(skip).limit(page_size)
    at = Window.orderBy("key")  # over one page at most
    return rows.select((F.row_number().over(at) + skip).cast("int").alias("ordinal"), "key", "value")


def cursor(state: DataFrame, step: int) -> DataFrame:
    """An iterator's ``step``-th element (from 1): a page of one row."""
    return page(state, 1, step)


def iterate(state: DataFrame):
    """Rows in key order, fetched partition by partition."""
    yield from state.orderBy("key").toLocalIterator(prefetchPartitions=True)


def get_many_pages(log: DataFrame, first: str, last: str, page_size: int, pages: Sequence[int]) -> DataFrame:
    """Several pages of a scan, each tagged with its number."""
    state = range_scan(log, first, last)
    out = None
    for n in pages:
        one = page(state, page_size, n).withColumn("page", F.lit(n))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no page asked for")
    return out
