"""SHA-1 Merkle trees over ordered records, their comparison and verification.

A tree is rows (table_id, level, pos, hash). Leaves hash a record, a parent hashes the SHA-1 of its
children's hashes, and an odd level is padded with the hash of nothing. Building costs one shuffle for every
``SPAN`` levels, over data that shrink by 2^SPAN each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltbed.operators.order import numbered_rows
from siltbed.session import materialize

SPAN = 10  # levels that one task builds from a block of nodes
EMPTY_SHA1 = "da39a3ee5e6b4b0d3255bfef95601890afd80709"  # fixed value: SHA-1 of no bytes


def merkle_leaves(records: DataFrame, order: str, data: str) -> DataFrame:
    """Leaf rows of each table_id; the leaves end before the first empty record."""
    numbered = numbered_rows(records, ["table_id"], [order])
    ends = numbered.filter(F.octet_length(data) == 0).groupBy("table_id").agg(F.min("pos").alias("stop"))
    return (numbered.join(ends, "table_id", "left").filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
            .select("table_id", F.lit(0).alias("level"), "pos", F.sha1(F.col(data).cast("binary")).alias("hash")))


def parent_hash(left: Column, right: Column) -> Column:
    """Parent of two node hashes (hex): the SHA-1 of both children's re-hashed bytes joined."""
    return F.sha1(F.concat(F.unhex(F.sha1(F.unhex(left))), F.unhex(F.sha1(F.unhex(right)))))


def levels_above(nodes: DataFrame, base: int) -> DataFrame:
    """Up to ``SPAN`` levels above level ``base``, from its nodes with ``n``, the number of them in the table.

    Aligned blocks of 2^SPAN nodes are subtrees of their own: all but a table's last block are full, so a level of the last block is
    odd exactly where the table's level is, and one node is padded as well as long as the table has more of that level. A single
    leaf is padded too, so a root is never a leaf."""
    def halve(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")), lambda i: parent_hash(
            F.get(hashes, i * 2), F.coalesce(F.get(hashes, i * 2 + 1), F.lit(EMPTY_SHA1))))

    block = F.shiftright("pos", SPAN).alias("block")
    blocks = nodes.filter(F.lit(base == 0) | (F.col("n") > 1)).groupBy("table_id", "n", block).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("h"))
    depth = F.least(F.lit(SPAN), F.length(F.bin(F.col("n") - 1)))
    grown = blocks.select("table_id", "n", "block", F.aggregate(
        F.sequence(F.lit(1), depth), F.array(F.transform("h", lambda x: x["hash"])),
        lambda done, _: F.concat(done, F.array(halve(F.element_at(done, -1))))).alias("levels"))
    each = grown.select("table_id", "n", "block", F.posexplode("levels").alias("up", "h")).filter("up > 0")
    each = each.select("table_id", "n", "block", "up", F.posexplode("h").alias("i", "hash"))
    first = F.call_function("shiftleft", F.col("block"), F.lit(SPAN) - F.col("up"))
    return each.select("table_id", "n", (F.col("up") + base).alias("level"), (first + F.col("i")).alias("pos"), "hash")


def merkle_tree(leaves: DataFrame, max_rows: int) -> DataFrame:
    """All levels. ``max_rows`` bounds the leaves of one table and so the number of levels."""
    out = materialize(leaves, "merkle")
    nodes = out.join(out.groupBy("table_id").agg(F.count("*").alias("n")), "table_id")
    for base in range(0, max(1, (max_rows - 1).bit_length()), SPAN):
        above = materialize(levels_above(nodes, base), "merkle")
        out = out.unionByName(above.drop("n"))
        nodes = above.filter(F.col("level") == base + SPAN).withColumn("n", F.ceil(F.col("n") / (1 << SPAN)))
    return out


def merkle_root(tree: DataFrame) -> DataFrame:
    top = F.max_by("hash", "level")
    return tree.groupBy("table_id").agg(top.alias("root"))


def merkle_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves that differ, in ascending order of position; a leaf that only one side has differs too."""
    a = left.filter("level = 0").select("table_id", "pos", F.col("hash").alias("hash_left"))
    b = right.filter("level = 0").select("table_id", "pos", F.col("hash").alias("hash_right"))
    return (a.join(b, ["table_id", "pos"], "full_outer")
            .filter(~F.col("hash_left").eqNullSafe(F.col("hash_right"))))


def verify(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Per table: the number of leaves and of leaves that differ from the stored tree."""
    n = rebuilt.filter("level = 0").groupBy("table_id").agg(F.count("*").alias("n_leaves"))
    d = merkle_diff(stored, rebuilt).groupBy("table_id").agg(F.count("*").alias("n_diff"))
    return n.join(d, "table_id", "full_outer").select(
        "table_id", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("n_diff", F.lit(0)).alias("n_diff"))
