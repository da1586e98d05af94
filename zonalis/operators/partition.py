"""Partitions of the sphere: three sectors of 120 degrees by two hemispheres, each cut into near-square parts.

In a zone of n rows, p parts lie in bands of 1, 3, 5, ... parts (2k - 1 in band k): b = floor(sqrt(p)) full bands of
floor(n / b) rows, and a last band with the rest of the rows and parts. Parts follow from the position of a cell in closed
form; neighbourhoods follow from the interfaces.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.sources import grid


def _zone_part(row: Column, column: Column, width: Column, n: int, parts: int) -> Column:
    """0-based part of a cell of a zone: ``row`` from the pole and ``column`` of ``width`` columns, both from 1."""
    bands = isqrt(parts)
    rest = parts - bands * bands
    rows = n // (bands + (rest > 0))
    band = F.least(G._quotient(row - 1, F.lit(rows).cast("long")) + 1, F.lit(bands + (rest > 0)).cast("long"))
    count = F.when(band <= bands, 2 * band - 1).otherwise(F.lit(rest or 2 * bands - 1))
    return (band - 1) * (band - 1) + G._quotient((column - 1) * count, width)


def part_id(i: Column, j: Column, n: int, parts: int) -> Column:
    """0-based partition of cell (i, j): ``parts`` is 1, 3, or 6 times the number of parts a zone."""
    if parts == 1:
        return F.lit(0).cast("long")
    sector = G.sector(i, j, n)
    if parts == 3:
        return sector
    if parts % 6:
        raise ValueError("1, 3 or a multiple of 6 parts")
    each = parts // 6
    row, width = F.least(i, 2 * n + 1 - i), G._quotient(G.nlon(i, n), F.lit(3).cast("long"))
    zone = sector + F.when(i > n, 3).otherwise(0)
    return zone * each + _zone_part(row, G.sector_column(i, j, n), width, n, each)


def adjacency(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(part, other, side, cells): how many pairs of cells two parts share, east-west and north-south.

    Pairs of cells are counted where they are generated; only counts are shuffled.
    """
    i, j = F.col("i"), F.col("j")
    own = part_id(i, j, n, parts)
    ring = grid.cells(spark, n).select(own.alias("part"), part_id(i, j % F.col("nlon") + 1, n, parts).alias("other"), F.lit("east").alias("side"))
    across = grid.interfaces(spark, n).select(own.alias("part"), part_id(i + 1, F.col("l"), n, parts).alias("other"), F.lit("south").alias("side"))
    return ring.unionByName(across).filter("part <> other").groupBy("part", "other", "side").agg(F.count("*").alias("cells"))


def halo_counts(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(part, cells, border, halo): cells of a part, those with a neighbour elsewhere, and the distinct cells it needs."""
    i, j = F.col("i"), F.col("j")
    cells = grid.cells(spark, n)
    ring = cells.select(F.col("cell_id").alias("a"), part_id(i, j, n, parts).alias("pa"), G.cell_id(i, j % F.col("nlon") + 1, n).alias("b"), part_id(i, j % F.col("nlon") + 1, n, parts).alias("pb"))
    across = grid.interfaces(spark, n).select(F.col("a_id").alias("a"), part_id(i, j, n, parts).alias("pa"), F.col("b_id").alias("b"), part_id(i + 1, F.col("l"), n, parts).alias("pb"))
    cut = ring.unionByName(across).filter("pa <> pb")
    both = cut.select(F.explode(F.array(F.struct(F.col("pa").alias("part"), F.col("a").alias("own"), F.col("b").alias("far")), F.struct(F.col("pb").alias("part"), F.col("b").alias("own"), F.col("a").alias("far")))).alias("e"))
    edge = both.groupBy("e.part").agg(F.countDistinct("e.own").alias("border"), F.countDistinct("e.far").alias("halo"))
    total = cells.groupBy(part_id(i, j, n, parts).alias("part")).agg(F.count("*").alias("cells"))
    return total.join(edge, "part", "left").select("part", "cells", F.coalesce("border", F.lit(0)).alias("border"), F.coalesce("halo", F.lit(0)).alias("halo"))


def edge_cut(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """One row: (edges, cut) of the adjacency graph."""
    i, j = F.col("i"), F.col("j")
    own = part_id(i, j, n, parts)
    ring = grid.cells(spark, n).select((own != part_id(i, j % F.col("nlon") + 1, n, parts)).alias("crosses"))
    across = grid.interfaces(spark, n).select((own != part_id(i + 1, F.col("l"), n, parts)).alias("crosses"))
    return ring.unionByName(across).agg(F.count("*").alias("edges"), F.count_if("crosses").alias("cut"))


def replicated(sector_one: DataFrame, n: int) -> DataFrame:
    """Cells (i, j, ...) of the first sector copied to all three, 120 degrees apart."""
    width = G._quotient(G.nlon(F.col("i"), n), F.lit(3).cast("long"))
    return sector_one.withColumn("sector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("j", F.col("j") + F.col("sector") * width)
