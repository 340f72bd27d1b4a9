"""Count-Min Sketch as rows (group, row, col, cnt)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from siltbed.functions.hashing import seeded_position


def cms_size(eps: float, delta: float) -> tuple[int, int]:
    """(columns, rows) for error eps with failure probability delta."""
    return math.ceil(math.e / eps), math.ceil(math.log(math.e / delta))


def exploded(elements: DataFrame, element: str, m: int, k: int, seed: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("row"), seeded_position(F.col(element), seed + i, m).alias("col")) for i in range(k)])
    return elements.withColumn("cell", F.explode(cells)).select("*", "cell.row", "cell.col").drop("cell")


def cells(elements: DataFrame, group: str, element: str, m: int, k: int, seed: int) -> DataFrame:
    """Counts; equal elements are counted before they are hashed, and cells combine map-side."""
    pre = elements.groupBy(group, element).agg(F.count("*").alias("n"))
    return exploded(pre, element, m, k, seed).groupBy(group, "row", "col").agg(F.sum("n").alias("cnt"))


def estimates(sketch: DataFrame, probes: DataFrame, group: str, element: str, m: int, k: int, seed: int) -> DataFrame:
    """Frequency of each probe (group, element): the least of its k cells, 0 where a cell is empty."""
    want = exploded(probes.select(group, element).distinct(), element, m, k, seed)
    return (want.join(sketch, [group, "row", "col"], "left")
            .groupBy(group, element).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("frequency")))


def builtin(elements: DataFrame, group: str, element: str, eps: float, delta: float, seed: int) -> DataFrame:
    """Spark's own sketch, one BINARY per group."""
    return elements.groupBy(group).agg(F.count_min_sketch(F.col(element), F.lit(eps), F.lit(1 - delta), F.lit(seed)).alias("sketch"))
