"""Sorted tables on storage: writer, catalog source, key dictionary and whole-text source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltbed.session import materialize


def write_table(rows: DataFrame, path: str, one_file: bool = False, partitions: int | None = None) -> None:
    """A table sorted by key. Range partitions give files with tight key statistics, and a Parquet bloom filter on
    the key prunes point reads. ``one_file`` writes one sorted file, for small tables."""
    if one_file:
        shaped = rows.coalesce(1)
    else:
        shaped = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
    (shaped.sortWithinPartitions("key").write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#key", "true").parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ordered_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog in read order: level ascending, newest table first."""
    return catalog.orderBy("level", F.desc("run_id"))


def key_dictionary(log: DataFrame, block: int = 65536) -> DataFrame:
    """(key_id, key): ids from 0 in the order of a key's first appearance.

    Numbered in two steps, by blocks of the first sequence number, so that no task sorts all keys."""
    first = log.groupBy("key").agg(F.min("seq").alias("seq")).withColumn("blk", F.floor(F.col("seq") / block))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    base = first.groupBy("blk").count().select("blk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    at = Window.partitionBy("blk").orderBy("seq")
    return (first.join(base, "blk")
            .select((F.col("base") + F.row_number().over(at) - 1).cast("long").alias("key_id"), "key"))


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """Append-only: (key_id, key) of keys that the stored dictionary lacks; earlier ids never change."""
    dictionary.select("key_id", "key").write.mode("append").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The stored dictionary, empty where there is none."""
    try:
        return spark.read.schema("key_id long, key string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key_id long, key string")


def grown_dictionary(log: DataFrame, path: str) -> DataFrame:
    """The stored dictionary with the new keys of ``log`` (seq, key), which get the next ids in the order of their appearance."""
    held = load_dictionary(log.sparkSession, path)
    base = held.agg(F.coalesce(F.max("key_id") + 1, F.lit(0))).first()[0]
    fresh = key_dictionary(log.select("seq", "key").join(held.select("key"), "key", "left_anti")).withColumn("key_id", F.col("key_id") + base)
    save_dictionary(materialize(fresh, "dictionary"), path)
    return load_dictionary(log.sparkSession, path)


def write_compressed(rows: DataFrame, path: str, dictionary_path: str) -> None:
    """A table whose keys are numbers of the stored dictionary, in the order of the keys."""
    ids = grown_dictionary(rows, dictionary_path)
    coded = rows.join(ids, "key").repartitionByRange("key").sortWithinPartitions("key").drop("key")
    coded.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_compressed(spark: SparkSession, path: str, dictionary_path: str) -> DataFrame:
    return spark.read.parquet(path).join(load_dictionary(spark, dictionary_path), "key_id").drop("key_id")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row: path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
