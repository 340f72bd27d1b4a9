"""The one logical table of the engine: an append-only operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

KV_LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("tombstone", T.BooleanType(), False),
])

# Key prefixes reserved for stored sketches, fingerprints and bucket state.
RESERVED_PREFIXES = ("bf_", "cms_", "hll_", "sh_", "tb_")


def is_reserved(key: Column) -> Column:
    """True for keys that belong to the engine itself, not to the user."""
    out = F.lit(False)
    for prefix in RESERVED_PREFIXES:
        out = out | key.startswith(prefix)
    return out


def events_log(events: DataFrame) -> DataFrame:
    """The ``events`` table as a log: one key per user, errors are deletes."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.unix_timestamp("ts").alias("ts"),
        F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.col("event_type"),
        F.col("props"),
    )


def parts_log(part: DataFrame) -> DataFrame:
    """``part`` as a wide-key log: every part name is a key, the newest part number wins."""
    return part.select(
        F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("ts"), F.col("p_name").alias("key"),
        F.col("p_retailprice").alias("value"), F.lit(False).alias("tombstone"),
    )
