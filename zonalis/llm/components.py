"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.common import Scratch


def _relink(nodes: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """nodes: (a, b) with b as neighbour of a. Links each neighbour to the least node that a knows."""
    least = scratch.table(nodes.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = nodes.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        out = joined.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its least node.

    Rounds end when a pair of stars changes nothing; each round writes its links to the shared folder, so lineage
    stays short and a lost executor costs one round at most. Minima are pre-aggregated, and joins with a node of many
    links read two plain exchanges, which adaptive execution can split. Null ends and self links are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.table(edges, "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = scratch.table(_relink(both, scratch, True), "edges")
        edges = scratch.table(_relink(edges, scratch, False), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
