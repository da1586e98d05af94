"""Graphs as tables of neighbours: entries that stand on one side only, nodes without any, connected parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.sources.scratch import Scratch


def entries(graph: DataFrame) -> DataFrame:
    """(a, b) of (cell_id, near): b is listed as a neighbour of a."""
    return graph.select(F.col("cell_id").alias("a"), F.explode("near").alias("b")).distinct()


def one_sided(pairs: DataFrame) -> DataFrame:
    """(a, b) whose (b, a) is missing."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(back, ["a", "b"], "left_anti")


def isolated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell_id) of ``nodes`` that no entry names, on either side."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("cell_id"))
    return nodes.select("cell_id").join(named, "cell_id", "left_anti")


def connected_parts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell_id, part): the least node of the connected part of each node; pairs count both ways, those with other nodes don't.

    In each round a node whose hash is the least among its neighbours takes in all neighbours that have no lesser such node beside them;
    what is left of the edges links the nodes taken in. A constant share of the nodes goes in each round, whatever the shape of the
    graph, so a long chain takes no more rounds than a star. Rounds are written to the shared folder; groups are pre-aggregated.
    """
    scratch = Scratch(nodes.sparkSession)
    known = scratch.table(nodes.select("cell_id").distinct(), "nodes")
    ends = known.withColumnRenamed("cell_id", "a"), known.withColumnRenamed("cell_id", "b")
    both = pairs.filter("a <> b").select("a", "b").join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi")
    edges = scratch.table(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = known.select("cell_id", F.col("cell_id").alias("at"))
    rounds = 0
    while not edges.isEmpty():
        rank = lambda c, k=rounds: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))
        near = scratch.table(edges.groupBy("a").agg(F.min(rank("b")).alias("least")), "near")
        tops = near.filter(rank("a") < F.col("least")).select(F.col("a").alias("b"))
        taken = edges.join(tops, "b", "left_semi").groupBy("a").agg(F.min(rank("b"))["n"].alias("to"))
        taken = scratch.table(taken, "taken")
        label = scratch.table(label.join(taken.withColumnRenamed("a", "at"), "at", "left").select("cell_id", F.coalesce("to", "at").alias("at")), "label")
        moved = edges.join(taken, "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        moved = moved.join(taken.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b", "left").select("a", F.coalesce("to_b", "b").alias("b"))
        edges = scratch.table(moved.filter("a <> b").distinct(), "edges")
        rounds += 1
    parts = label.groupBy("at").agg(F.min("cell_id").alias("part"))
    return label.join(parts, "at").select("cell_id", "part")
