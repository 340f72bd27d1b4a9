"""HyperLogLog registers and estimate as expressions; Spark's own sketch as the fast variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltbed.functions.hashing import fnv1_64

MIN_PRECISION, MAX_PRECISION = 4, 16
TWO32 = 4294967296.0


def registers(elements: DataFrame, group: str, element: str, p: int) -> DataFrame:
    """(group, register, rank): the register is the top p bits, the rank the trailing zeros of the whole hash + 1."""
    if not MIN_PRECISION <= p <= MAX_PRECISION:
        raise ValueError(f"precision {p} is outside {MIN_PRECISION}..{MAX_PRECISION}")
    h = F.col("_h")
    low = h.bitwiseAND(F.bitwise_not(h) + 1)  # the lowest set bit
    zeros = F.when(h == 0, 64).when(h == F.lit(-(2**63)), 63).otherwise(F.bit_count(low - 1))
    hashed = elements.withColumn("_h", fnv1_64(F.col(element)))
    return (hashed.select(group, F.shiftrightunsigned(h, 64 - p).cast("int").alias("register"), (zeros + 1).cast("int").alias("rank"))
            .groupBy(group, "register").agg(F.max("rank").alias("rank")))


def estimate(regs: DataFrame, group: str, p: int) -> DataFrame:
    """Cardinality with the small- and large-range corrections."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    s = regs.groupBy(group).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"))
    empty = F.lit(m) - F.col("used")
    raw = F.lit(alpha * m * m) / (F.col("s") + empty)
    s = s.withColumn("raw", raw).withColumn("empty", empty)
    out = (F.when((F.col("raw") <= 2.5 * m) & (F.col("empty") > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / F.col("empty")))
           .when(F.col("raw") > TWO32 / 30, -F.lit(TWO32) * F.log(1 - F.col("raw") / TWO32)).otherwise(F.col("raw")))
    return s.select(group, out.alias("estimate"))


def builtin(elements: DataFrame, group: str, element: str, lg_k: int = 12) -> DataFrame:
    """The fast variant: Spark's mergeable sketch."""
    return elements.groupBy(group).agg(F.hll_sketch_estimate(F.hll_sketch_agg(element, lg_k)).alias("estimate"))


def clear(regs: DataFrame, group: str, name: str) -> DataFrame:
    """Registers after one named sketch is cleared."""
    return regs.filter(F.col(group) != name)
