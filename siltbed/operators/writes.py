"""Mutations as rows: puts, deletes and the name guard of stored structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def put_rows(changes: DataFrame) -> DataFrame:
    """Log rows of upserts; ``changes`` has seq, ts, key, value."""
    return changes.select("seq", "ts", "key", "value", F.lit(False).alias("tombstone"))


def delete_rows(changes: DataFrame) -> DataFrame:
    """Log rows of deletes; the value is null, as there is none."""
    return changes.select("seq", "ts", "key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"))


def with_outcome(log: DataFrame) -> DataFrame:
    """What each call answers: a put always succeeds; a delete gives the old value and succeeds only
    when the key was live. One shuffle by key; the previous version is a lag over it."""
    by_key = Window.partitionBy("key").orderBy("seq")
    prev = F.lag(F.struct("value", "tombstone")).over(by_key)
    return log.withColumn("prev", prev).select(
        "seq", "key", F.when(F.col("tombstone"), "delete").otherwise("put").alias("op"),
        F.when(F.col("tombstone") & ~F.col("prev.tombstone"), F.col("prev.value")).alias("old_value"),
        (~F.col("tombstone") | F.coalesce(~F.col("prev.tombstone"), F.lit(False))).alias("ok"),
    )


def name_guard(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Create requests that may go ahead: the name is new, and the first request for it wins."""
    first = Window.partitionBy("name").orderBy("seq")
    return (requests.join(existing.select("name").distinct(), "name", "left_anti")
            .withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn"))
