"""Table catalog, summaries, key-range pruning and the sparse index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltbed.operators.order import carried_forward, numbered_rows


def table_catalog(tables: DataFrame) -> DataFrame:
    """One row per table, newest first within a level."""
    return tables.groupBy("level", "run_id").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_rows"),
        F.sum(F.col("tombstone").cast("long")).alias("n_tombstones"))


def prune_point(catalog: DataFrame, key: str) -> DataFrame:
    """Tables that may hold ``key`` by their key range."""
    return catalog.filter((F.col("first_key") <= key) & (F.col("last_key") >= key))


def prune_range(catalog: DataFrame, first: str, last: str) -> DataFrame:
    return catalog.filter((F.col("first_key") <= last) & (F.col("last_key") >= first))


def sparse_index(tables: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th record of each table in key order with its position: the first is always in."""
    return numbered_rows(tables.select("run_id", "key"), ["run_id"], ["key"]).filter(F.col("pos") % every == 0)


def summary(tables: DataFrame, every_index: int, every_summary: int) -> DataFrame:
    """The second level: every ``every_summary``-th index entry."""
    return sparse_index(tables, every_index * every_summary)


def index_seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe and table, the position of the greatest indexed key <= the probe (an as-of lookup).

    Index entries and probes are merged in one sort by (table, key) and the last index position is
    carried forward; no range join is needed. ``probes`` has run_id, key."""
    both = index.select("run_id", "key", "pos", F.lit(0).alias("probe")).unionByName(
        probes.select("run_id", "key", F.lit(None).cast("long").alias("pos"), F.lit(1).alias("probe")))
    return carried_forward(both, ["run_id"], ["key", "probe"], "pos").filter("probe = 1").select("run_id", "key", F.col("last").alias("seek_pos"))
