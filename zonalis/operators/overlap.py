"""Overlaps of the cells of two unrelated grids: rectangles of latitude and longitude, of any size and number.

This is a join of intervals in two directions. Cells are dealt to bins that both grids share, bands of latitude cut into as many bins of
longitude as an average cell of the band is wide; a cell wider or taller than a bin stands in several. Cells that share a bin meet by
an equality join, and a pair counts in one bin only, the one that holds the north-west corner of its overlap, so nothing is
de-duplicated. The number of cells in a bin follows from the cells' average size, not from the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ("north", "south", "west", "east")


def spherical_area(north: Column, south: Column, width: Column) -> Column:
    """Square degrees between two latitudes, ``width`` degrees wide."""
    return width * (F.sin(F.radians(north)) - F.sin(F.radians(south))) * F.lit(180.0) / F.pi()


def unrolled(cells: DataFrame) -> DataFrame:
    """Cells (cell_id, north, south, west, east) with longitudes from 0 to 360: those across the meridian in two pieces.

    A cell may begin anywhere (-30 or 350) and is at most 360 degrees wide. Cells without extent or with a null bound are left out.
    """
    ok = cells.filter((F.col("north") > F.col("south")) & (F.col("east") > F.col("west")))
    west = F.pmod(F.col("west"), F.lit(360.0))
    moved = ok.select("cell_id", "north", "south", west.alias("west"), (west + (F.col("east") - F.col("west"))).alias("east"))
    low = F.struct(F.col("west").alias("west"), F.least("east", F.lit(360.0)).alias("east"))
    high = F.struct(F.lit(0.0).alias("west"), (F.col("east") - 360.0).alias("east"))
    # what floating point leaves over the meridian is no piece of its own
    pieces = F.when(F.col("east") > 360.0 + 1e-9, F.array(low, high)).otherwise(F.array(low))
    return moved.select("cell_id", "north", "south", F.explode(pieces).alias("at")).select("cell_id", "north", "south", "at.west", "at.east")


def _bands(height: float, top: Column, bottom: Column) -> Column:
    first = F.floor((F.lit(90.0) - top) / F.lit(height)).cast("long")
    return F.sequence(first, F.greatest(first, F.ceil((F.lit(90.0) - bottom) / F.lit(height)).cast("long") - 1))


def _column(lon: Column) -> Column:
    """The bin of a longitude in a band of ``bins`` bins."""
    return F.least(F.floor(lon * F.col("bins") / 360.0).cast("long"), F.col("bins") - 1)


def overlaps(first: DataFrame, last: DataFrame) -> DataFrame:
    """(src, dst, area): pairs of cells of both tables (cell_id, north, south, west, east) that overlap, in square degrees.

    Bands are as high as an average cell. The table of bands has a row for each of them and is joined like any other table.
    """
    a, b = unrolled(first), unrolled(last)
    both = a.select("north", "south", "west", "east").unionByName(b.select("north", "south", "west", "east"))
    height = both.agg(F.avg(F.col("north") - F.col("south"))).first()[0]
    if height is None:
        return first.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(0.0).alias("area")).limit(0)
    height = max(height, 1e-6)

    def banded(cells: DataFrame) -> DataFrame:
        return cells.withColumn("band", F.explode(_bands(height, F.col("north"), F.col("south"))))

    width = F.avg(F.col("east") - F.col("west"))
    bands = banded(both).groupBy("band").agg(F.greatest(F.floor(360.0 / width), F.lit(1)).cast("long").alias("bins"))

    def binned(cells: DataFrame, tag: str) -> DataFrame:
        placed = banded(cells).join(bands, "band")
        last_bin = F.greatest(_column(F.col("west")), F.least(F.ceil(F.col("east") * F.col("bins") / 360.0).cast("long"), F.col("bins")) - 1)
        out = placed.withColumn("bin", F.explode(F.sequence(_column(F.col("west")), last_bin)))
        return out.select("band", "bin", "bins", F.col("cell_id").alias(tag), *(F.col(c).alias(f"{tag}_{c}") for c in BOUNDS))

    pairs = binned(a, "src").join(binned(b, "dst").drop("bins"), ["band", "bin"])
    north, south = F.least("src_north", "dst_north"), F.greatest("src_south", "dst_south")
    west, east = F.greatest("src_west", "dst_west"), F.least("src_east", "dst_east")
    met = pairs.filter((north > south) & (east > west))
    owner = (F.element_at(_bands(height, north, south), 1) == F.col("band")) & (_column(west) == F.col("bin"))
    return met.filter(owner).groupBy("src", "dst").agg(F.sum(spherical_area(north, south, east - west)).alias("area"))


def conservative_links(first: DataFrame, last: DataFrame) -> DataFrame:
    """(src, dst, w, dst_area): ``w`` is the share of the destination that the source covers, as ``weighted_links`` takes it.

    Tables are (cell_id, north, south, west, east) and may have ``mask``; cells whose mask is 0 take no part.
    """
    first, last = (c.filter(F.coalesce("mask", F.lit(0)) != 0) if "mask" in c.columns else c for c in (first, last))
    area = last.select(F.col("cell_id").alias("dst"), spherical_area(F.col("north"), F.col("south"), F.col("east") - F.col("west")).alias("dst_area"))
    return overlaps(first, last).join(area, "dst").select("src", "dst", (F.col("area") / F.col("dst_area")).alias("w"), "dst_area")
