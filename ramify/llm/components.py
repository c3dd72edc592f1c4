"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.staging import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b, both bigint); root is the smallest.

    Each round every node points at its smallest neighbour, pointers are followed to
    their end by doubling, and the edges are drawn again between the ends. At least
    half of the nodes vanish each round. All steps are equi-joins and minima; a node
    with many edges meets them as a partial minimum.
    """
    mapping = None
    edges = staged(edges.filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = staged(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")), "pointer")
        while True:
            after = pointer.select(F.col("a").alias("b"), F.col("b").alias("c")).filter("b <> c")
            jumped = staged(
                pointer.join(after, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")),
                "pointer",
            )
            pointer = jumped.select("a", "b")
            if jumped.filter("moved").isEmpty():
                break
        if mapping is None:
            mapping = pointer.select(F.col("a").alias("node"), F.col("b").alias("root"))
        else:
            step = pointer.select(F.col("a").alias("root"), F.col("b").alias("further"))
            mapping = staged(mapping.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "mapping")
        ends = pointer.select("a", F.col("b").alias("end"))
        edges = staged(
            edges.join(ends, "a").select(F.col("end").alias("x"), "b")
            .join(ends.withColumnsRenamed({"a": "b", "end": "y"}), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
