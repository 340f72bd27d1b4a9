"""Positions in sorted groups, where a group may be larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siltbed.session import materialize

PART, AT = "__part__", "__at__"
IN_PARTITION = (1 << 33) - 1  # the part of a monotonically increasing id that counts within a partition


def in_parts(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows sorted by (by, order) over range partitions, written once, with their partition and place in it. A group may lie in several
    partitions, whose numbers ascend."""
    spread = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return materialize(spread.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))), "ordered")


def numbered_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, the position from 0 of each row in its group: partitions are counted first, then offsets are added."""
    placed = in_parts(rows, by, order)
    counts = placed.groupBy(*by, PART).agg(F.count("*").alias("__n__"), F.min(AT).alias("__first__"))  # a row a group and partition
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, PART, (F.coalesce(F.sum("__n__").over(before), F.lit(0)) - F.col("__first__")).alias("__base__"))
    return placed.join(base, [*by, PART]).withColumn("pos", (F.col(AT) + F.col("__base__")).cast("long")).select(*rows.columns, "pos")


def carried_forward(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``last``, the latest ``value`` that isn't null up to each row of its group: within a partition by a window, before it from the
    last values of the partitions in front."""
    placed = in_parts(rows, by, order)
    ends = placed.filter(F.col(value).isNotNull()).groupBy(*by, PART).agg(F.max_by(value, AT).alias("__end__"))
    whole = placed.select(*by, PART).distinct().join(ends, [*by, PART], "left")
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*by, PART, F.last("__end__", ignorenulls=True).over(before).alias("__carry__"))
    upto = Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("last", F.last(value, ignorenulls=True).over(upto)).join(carry, [*by, PART])
    return found.withColumn("last", F.coalesce("last", "__carry__")).select(*rows.columns, "last")
