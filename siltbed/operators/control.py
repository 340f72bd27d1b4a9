"""Stateful request control: token buckets and LRU traces.

Both depend on the order of requests within a key or cache shard, so each is one ordered pass per group
in Arrow batches; groups spread over the cluster by key. State is a few numbers (bucket) or at most
``capacity`` keys (cache); rows of a group are streamed, not held at once.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Bucket:
    """Tokens refill only when the bucket is empty and the interval has passed; never in proportion."""

    def __init__(self, size: int, interval: float, start: float):
        self.size, self.interval, self.left, self.refreshed = size, interval, size, start

    def take(self, now: float) -> bool:
        if self.left <= 0:
            if now - self.refreshed < self.interval:
                return False
            self.left, self.refreshed = self.size, now
        self.left -= 1
        return True


def ordered_passes(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of a key together and in order, so that one pass over a partition sees each key once."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def token_bucket(requests: DataFrame, size: int, interval_s: float) -> DataFrame:
    """Adds ``accepted``; ``requests`` has seq, key, ts (seconds) and may have ``billable``.

    A bucket is created full at the key's first request. Requests that aren't billable cost nothing."""
    if "billable" not in requests.columns:
        requests = requests.withColumn("billable", F.lit(True))
    cols = requests.select("seq", "key", F.col("ts").cast("double").alias("ts"), "billable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = object(), None
        for pdf in batches:
            out = []
            for k, ts, paid in zip(pdf["key"], pdf["ts"], pdf["billable"]):
                if k != key:
                    key, bucket = k, Bucket(size, interval_s, ts)
                out.append(bucket.take(ts) if paid else True)
            yield pd.DataFrame({"seq": pdf["seq"], "key": pdf["key"], "accepted": out})

    return ordered_passes(cols, "key", ["ts", "seq"]).mapInPandas(run, "seq long, key string, accepted boolean")


class LruCache:
    """Least recently used keys go first; a delete leaves a mark that the next insert clears."""

    def __init__(self, capacity: int):
        self.capacity, self.items = capacity, OrderedDict()

    def get(self, key) -> bool:
        if key not in self.items or self.items[key]:
            return False
        self.items.move_to_end(key)
        return True

    def insert(self, key) -> None:
        self.items.pop(key, None)
        if len(self.items) >= self.capacity:
            self.items.popitem(last=False)
        self.items[key] = False

    def delete(self, key) -> None:
        if key in self.items:
            self.items[key] = True


def lru_trace(trace: DataFrame, capacity: int) -> DataFrame:
    """Adds ``hit`` to a trace of shard, seq, key and optionally op (access, get, insert, delete).

    An access is a get that inserts on a miss. Shards are independent caches and run in parallel."""
    if "op" not in trace.columns:
        trace = trace.withColumn("op", F.lit("access"))
    cols = trace.select("shard", "seq", F.col("key").cast("string").alias("key"), "op")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, cache = object(), None
        for pdf in batches:
            hits = []
            for s, k, op in zip(pdf["shard"], pdf["key"], pdf["op"]):
                if s != shard:
                    shard, cache = s, LruCache(capacity)
                hit = None
                if op in ("access", "get"):
                    hit = cache.get(k)
                if op == "insert" or op == "access" and not hit:
                    cache.insert(k)
                if op == "delete":
                    cache.delete(k)
                hits.append(hit)
            yield pd.DataFrame({"shard": pdf["shard"], "seq": pdf["seq"], "key": pdf["key"], "hit": pd.array(hits, dtype="boolean")})

    return ordered_passes(cols, "shard", ["seq"]).mapInPandas(run, "shard string, seq long, key string, hit boolean")
