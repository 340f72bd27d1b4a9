"""Streaming forms: newest-wins upsert and token buckets with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltbed.operators.access import newest_versions
from siltbed.operators.control import Bucket
from siltbed.session import scratch_dir


def stream_state(stream: DataFrame) -> DataFrame:
    """Newest version per key as a stateful aggregation; state is one row a key."""
    return newest_versions(stream)


def run_upsert(stream: DataFrame, label: str = "stream-upsert") -> DataFrame:
    """Drain an available stream and give its live state; the stream's checkpoint is the write-ahead log.

    Each micro-batch appends the new versions of the keys that it touched; newest-wins over them is the state."""
    spark = stream.sparkSession
    out, at = scratch_dir(spark, label), scratch_dir(spark, f"{label}-checkpoint")
    changed = stream_state(stream)
    query = (changed.writeStream.outputMode("update").option("checkpointLocation", at)
             .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return newest_versions(spark.read.schema(changed.schema).parquet(f"{out}/batch=*")).filter(~F.col("tombstone"))


def stream_token_bucket(stream: DataFrame, size: int, interval_s: float) -> DataFrame:
    """Accept or reject requests (seq, key, ts) with a bucket per key in state.

    Requests of one micro-batch are taken in order of (ts, seq); a batch is bounded by the source's rate options."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"])
        bucket = Bucket(size, interval_s, float(pdf["ts"].iloc[0]))
        if state.exists:
            bucket.left, bucket.refreshed = state.get
        accepted = [bucket.take(float(t)) for t in pdf["ts"]]
        state.update((bucket.left, bucket.refreshed))
        yield pd.DataFrame({"seq": pdf["seq"], "key": pdf["key"], "accepted": accepted})

    cols = stream.select("seq", "key", F.col("ts").cast("double").alias("ts"))
    return cols.groupBy("key").applyInPandasWithState(
        step, "seq long, key string, accepted boolean", "left long, refreshed double", "append", GroupStateTimeout.NoTimeout)


def run_token_bucket(stream: DataFrame, size: int, interval_s: float) -> DataFrame:
    spark = stream.sparkSession
    out, at = scratch_dir(spark, "stream-bucket"), scratch_dir(spark, "stream-bucket-checkpoint")
    decided = stream_token_bucket(stream, size, interval_s)
    query = (decided.writeStream.outputMode("append").option("checkpointLocation", at).format("parquet")
             .option("path", out).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(decided.schema).parquet(out)


def parquet_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream; its files are the arrivals."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
