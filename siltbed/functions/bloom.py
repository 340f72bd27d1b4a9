"""Bloom filters as rows of set positions: sizing, building per group, membership and table pruning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from siltbed.functions.hashing import seeded_position


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) for n elements at false-positive rate p."""
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def positions(elements: DataFrame, element: str, m: int, k: int, seed: int) -> DataFrame:
    """Rows with ``pos``, k for each element."""
    all_k = F.array(*[seeded_position(F.col(element), seed + i, m) for i in range(k)])
    return elements.withColumn("pos", F.explode(all_k))


def build(elements: DataFrame, group: str, element: str, m: int, k: int, seed: int) -> DataFrame:
    """Set positions of one filter per group; the distinct combines map-side, so at most m rows a group move."""
    return positions(elements, element, m, k, seed).select(group, "pos").distinct()


def check(bloom: DataFrame, probes: DataFrame, group: str, element: str, m: int, k: int, seed: int) -> DataFrame:
    """(group, element) pairs of which all k positions are set: possibly present."""
    want = positions(probes.select(element).distinct(), element, m, k, seed)
    want = want.groupBy(element, "pos").count().withColumnRenamed("count", "weight")
    hit = want.join(bloom, "pos").groupBy(group, element).agg(F.sum("weight").alias("hits"))
    return hit.filter(F.col("hits") == k).select(group, element)
