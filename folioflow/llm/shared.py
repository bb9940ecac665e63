"""Helpers of several operators: graph components and byte access to Arrow text columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

#: A-Z to a-z, all other bytes as they are
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) lead to, for every node with a link.

    Each round hooks every node to its smallest neighbour, jumps to the hook of the hook, and contracts the links
    to what they join; so links shrink from round to round, and rounds grow with the logarithm of a chain.
    Neighbours are combined before the shuffle; a node with very many links is split by the skew handling of joins.
    """
    e = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("o")))
        hook = cut_lineage(both.groupBy("node").agg(F.least(F.min("o"), F.col("node")).alias("p")), "hooks")
        far = hook.select(F.col("node").alias("_n"), F.col("p").alias("_p"))
        hook = cut_lineage(hook.join(far, hook["p"] == far["_n"]).select("node", F.col("_p").alias("p")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("p").alias("component"))
        else:
            labels = labels.join(hook.withColumnRenamed("node", "_n"), F.col("component") == F.col("_n"), "left").select(
                "node", F.coalesce("p", "component").alias("component"))
            labels = cut_lineage(labels, "labels")
        e = e.join(hook.toDF("a", "pa"), "a").join(hook.toDF("b", "pb"), "b").where("pa <> pb")
        e = cut_lineage(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if e.isEmpty():
            return labels
