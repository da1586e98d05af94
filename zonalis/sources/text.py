"""Fields as fixed-width text: three numbers a line (value, latitude, longitude), as other programs read and write them.

Cells are told by their coordinates, not by the order of lines, so files may be read in parallel and in any order. Lines
with '#' and blank lines are left out, and -9999 stands for a value that is not set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators.diagnostics import UNDEFINED
from zonalis.sources.grid import rows_for_cells, totals
from zonalis.sources.scratch import Scratch, new_path

LINE = "%23.16f %23.16f %23.16f"


def field_lines(field: DataFrame, n: int) -> DataFrame:
    """(tracer, value): one line a cell."""
    i, j = F.col("i"), F.col("j")
    line = F.format_string(LINE, F.coalesce("q", F.lit(UNDEFINED)), G.row_latitude(i, n), G.cell_longitude(i, j, n))
    return field.select("tracer", line.alias("value"))


def write_field(field: DataFrame, n: int, scratch: Scratch, path: str | None = None) -> str:
    """Text files in row-major order, a folder for each tracer; returns the path.

    A range sort by row keeps the order across files, so no task holds a whole field.
    """
    path = path or new_path(scratch.spark, "text")
    ordered = field.repartitionByRange("tracer", "i").sortWithinPartitions("tracer", "i", "j")
    field_lines(ordered, n).write.partitionBy("tracer").text(path)
    return path


def numbers(lines: DataFrame) -> DataFrame:
    """(value, lat, lon) and the other columns of lines (value string, ...)."""
    text = F.trim("value")
    parts = F.split(text, r"\s+")
    kept = lines.filter(~F.col("value").contains("#") & (text != ""))
    return kept.select(*(c for c in lines.columns if c != "value"), parts[0].cast("double").alias("value"), parts[1].cast("double").alias("lat"), parts[2].cast("double").alias("lon"))


def read_field(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(tracer, cell_id, i, j, q); values that are not set are null."""
    read = numbers(spark.read.schema("value string, tracer string").text(path))
    i = G.point_row(F.col("lat"), n)
    placed = read.withColumn("i", i).withColumn("j", G.point_column(F.col("i"), F.col("lon"), n))
    return placed.select("tracer", G.cell_id(F.col("i"), F.col("j"), n).alias("cell_id"), "i", "j", F.nullif("value", F.lit(UNDEFINED)).alias("q"))


def data_path(base: str, kind: str, stamp: str = "*", tracer: str = "*") -> str:
    """Path of stored data by kind (ratio, u, v), time and tracer; ``*`` stands for all. Only ratios differ by tracer.

    Spark reads whatever the pattern matches at once and fails if that is nothing.
    """
    if kind not in ("ratio", "u", "v"):
        raise ValueError(f"no such data: {kind!r}")
    return f"{base.rstrip('/')}/{kind}{f'_{tracer}' if kind == 'ratio' else ''}_{stamp}.dat"


def read_stored(spark: SparkSession, base: str, kind: str, stamp: str = "*", tracer: str = "*") -> DataFrame:
    """(tracer, stamp, value, lat, lon) of all files of one kind; time and tracer are those in the files' names."""
    lines = spark.read.text(data_path(base, kind, stamp, tracer))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/((?:ratio_|u_|v_)[^/]*)\.dat(?:/[^/]*)?$", 1)
    named = lines.select("value", name.alias("name"))
    named = named.select("value", F.nullif(F.regexp_extract("name", "^ratio_(.*)_[0-9]+$", 1), F.lit("")).alias("tracer"), F.regexp_extract("name", "_([0-9]+)$", 1).cast("long").alias("stamp"))
    return numbers(named)


def write_lines(values: DataFrame, path: str, *keys: str) -> str:
    """Lines of (value, lat, lon, keys) in folders of the keys, in order of latitude from the north and of longitude."""
    ordered = values.repartitionByRange(*keys, F.desc("lat")).sortWithinPartitions(*keys, F.desc("lat"), "lon")
    line = F.format_string(LINE, F.coalesce(F.col("value").cast("double"), F.lit(UNDEFINED)), F.col("lat"), F.col("lon"))
    ordered.select(*keys, line.alias("value")).write.partitionBy(*keys).text(path)
    return path


def read_lines(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """(keys, value, lat, lon) of what ``write_lines`` wrote; ``keys`` as a schema."""
    return numbers(spark.read.schema(f"value string, {keys}").text(path))


def write_winds(u: DataFrame, v: DataFrame, n: int, path: str) -> str:
    """Winds (stamp, i, f, u) at zonal faces and (stamp, i, j, l, v) at interfaces, as lines of value, latitude and longitude."""
    i = F.col("i")
    at_faces = u.select("stamp", F.lit("u").alias("kind"), F.col("u").alias("value"), G.row_latitude(i, n).alias("lat"), (F.col("f") * G.dlon(i, n)).alias("lon"))
    west, east = F.greatest((F.col("j") - 1) * G.dlon(i, n), (F.col("l") - 1) * G.dlon(i + 1, n)), F.least(F.col("j") * G.dlon(i, n), F.col("l") * G.dlon(i + 1, n))
    between = v.select("stamp", F.lit("v").alias("kind"), F.col("v").alias("value"), G.north_edge(i + 1, n).alias("lat"), (west + (east - west) / 2).alias("lon"))
    return write_lines(at_faces.unionByName(between), path, "kind", "stamp")


def read_winds(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(kind, stamp, cell_id, other, value): u with the row and the number of its face, v with the cells above and below.

    Faces are told by their coordinates: an interface's middle lies inside both of its cells.
    """
    read = read_lines(spark, path, "kind string, stamp long").withColumn("value", F.nullif("value", F.lit(UNDEFINED)))
    lat, lon, i = F.col("lat"), F.col("lon"), F.col("i")
    u = read.filter("kind = 'u'").withColumn("i", G.point_row(lat, n)).select("kind", "stamp", i.alias("cell_id"), F.round(lon / G.dlon(i, n)).cast("long").alias("other"), "value")
    v = read.filter("kind = 'v'").withColumn("i", F.round((90 - lat) / G.dlat(n)).cast("long"))
    v = v.select("kind", "stamp", G.cell_id(i, G.point_column(i, lon, n), n).alias("cell_id"), G.cell_id(i + 1, G.point_column(i + 1, lon, n), n).alias("other"), "value")
    return u.unionByName(v)


def write_corners(field: DataFrame, n: int, path: str) -> str:
    """Lines of a value and the latitudes and longitudes of four corners, from the north-west clockwise, in folders of tracers."""
    i, j = F.col("i"), F.col("j")
    north, south, west, east = G.north_edge(i, n), G.north_edge(i + 1, n), (j - 1) * G.dlon(i, n), j * G.dlon(i, n)
    line = F.format_string(" ".join(["%23.16f"] * 9), F.coalesce("q", F.lit(UNDEFINED)), north, west, north, east, south, east, south, west)
    field.repartitionByRange("tracer", "i").sortWithinPartitions("tracer", "i", "j").select("tracer", line.alias("value")).write.partitionBy("tracer").text(path)
    return path


def read_corners(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(tracer, cell_id, q, north, south, west, east) of lines of a value and eight corner coordinates."""
    text = F.trim("value")
    lines = spark.read.schema("value string, tracer string").text(path).filter(~F.col("value").contains("#") & (text != ""))
    x = F.transform(F.split(text, r"\s+"), lambda c: c.cast("double"))
    read = lines.select("tracer", x.alias("x")).select("tracer", F.nullif(F.col("x")[0], F.lit(UNDEFINED)).alias("q"), *(F.col("x")[k].alias(c) for k, c in ((1, "north"), (5, "south"), (2, "west"), (4, "east"))))
    i = G.point_row((F.col("north") + F.col("south")) / 2, n)
    read = read.withColumn("i", i).withColumn("j", G.point_column(F.col("i"), (F.col("west") + F.col("east")) / 2, n))
    return read.select("tracer", G.cell_id(F.col("i"), F.col("j"), n).alias("cell_id"), "q", "north", "south", "west", "east")


def write_graph(edges: DataFrame, path: str) -> str:
    """Adjacency lines of undirected edges (a, b): the cell, its number of neighbours, and these in order."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    near = both.groupBy(F.col("e.a").alias("cell_id")).agg(F.sort_array(F.collect_set("e.b")).alias("near"))
    line = F.concat_ws(" ", F.col("cell_id").cast("string"), F.size("near").cast("string"), F.array_join(F.col("near").cast("array<string>"), " "))
    near.repartitionByRange("cell_id").sortWithinPartitions("cell_id").select(line.alias("value")).write.text(path)
    return path


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, near): cells and their neighbours."""
    numbers_of = F.split(F.trim("value"), r"\s+").cast("array<long>")
    return spark.read.text(path).select(numbers_of.alias("x")).select(F.col("x")[0].alias("cell_id"), F.expr("slice(x, 3, cast(x[1] as int))").alias("near"))


def checked_size(field: DataFrame) -> int:
    """n of a field by its number of cells; an error if a tracer has another number of rows than a grid has cells."""
    counts = {r["count"] for r in field.groupBy("tracer").count().select("count").distinct().limit(2).collect()}
    if len(counts) != 1:
        raise ValueError("tracers differ in their number of cells")
    return rows_for_cells(counts.pop())


#: Columns of a grid file: number, mask (0: not part of the grid), centre, and the corners from the north-west clockwise.
GRID_LINE = " ".join(["%d %d", *["%23.16f"] * 10])


def write_grid(cells: DataFrame, path: str) -> str:
    """Lines of cells (cell_id, mask, lat, lon, north, south, west, east) in order of their numbers."""
    corners = ("north", "west", "north", "east", "south", "east", "south", "west")
    line = F.format_string(GRID_LINE, F.col("cell_id"), F.col("mask").cast("int"), *(F.col(c).cast("double") for c in ("lat", "lon", *corners)))
    cells.repartitionByRange("cell_id").sortWithinPartitions("cell_id").select(line.alias("value")).write.text(path)
    return path


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, mask, lat, lon, north, south, west, east) of a grid file; lines with '#' and blank ones are left out."""
    text = F.trim("value")
    lines = spark.read.text(path).filter(~F.col("value").contains("#") & (text != ""))
    x = lines.select(F.split(text, r"\s+").cast("array<double>").alias("x"))
    names = (("lat", 2), ("lon", 3), ("north", 4), ("south", 8), ("west", 5), ("east", 7))
    return x.select(F.col("x")[0].cast("long").alias("cell_id"), F.col("x")[1].cast("int").alias("mask"), *(F.col("x")[k].alias(c) for c, k in names))


def line_numbers(lines: DataFrame) -> DataFrame:
    """Lines (name, value) with their number in the dataset, from 0, as a column ``line``; ``lines`` comes straight from files.

    A line's place in its split is the row's own; splits are counted and the counts of those before added, a row a split. So no task sees
    more than a split, and files of any length are numbered. The splits are seen once: what is read is written first.
    """
    seen = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_mark", F.monotonically_increasing_id())
    seen = Scratch(lines.sparkSession).table(seen, "numbered")
    before = Window.partitionBy("name").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = seen.groupBy("name", "_file", "_start").agg(F.count("*").alias("_lines"), F.min("_mark").alias("_first"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines", "name")
    joined = seen.join(splits, ["_file", "_start"])
    return joined.withColumn("line", (F.col("_before") + F.col("_mark") - F.col("_first")).cast("long")).drop("_file", "_start", "_mark", "_first", "_before")


def scan_positions(spark: SparkSession, base: str, kind: str, n: int, stamp: str = "*", tracer: str = "*") -> DataFrame:
    """(tracer, stamp, line, i, j, l, value) of stored data, placed by the number of the line: only the first field is read.

    ``ratio`` has cells (i, j), ``u`` zonal faces (i, j from 0), ``v`` interfaces of (i, j) and (i + 1, l). Comments and blank lines don't count. Lines past
    the end of the grid have no place: i, j and l are null.
    """
    lines = spark.read.text(data_path(base, kind, stamp, tracer))
    text = F.trim("value")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/((?:ratio_|u_|v_)[^/]*)\.dat(?:/[^/]*)?$", 1)
    kept = lines.filter(~F.col("value").contains("#") & (text != "")).withColumn("name", name)
    kept = kept.withColumn("value", F.nullif(F.split(text, r"\s+", 2)[0].cast("double"), F.lit(UNDEFINED)))
    read = line_numbers(kept)
    size = totals(n)[{"ratio": "cells", "u": "zonal_faces", "v": "interfaces"}[kind]]
    at = F.when(F.col("line") < size, F.col("line"))
    place = {"ratio": lambda: G.cell_place(at + 1, n), "u": lambda: G.face_place(at, n), "v": lambda: G.interface_place(at, n)}[kind]()
    place = [*place, F.lit(None).cast("long")][:3]
    which = F.nullif(F.regexp_extract("name", "^ratio_(.*)_[0-9]+$", 1), F.lit("")).alias("tracer"), F.regexp_extract("name", "_([0-9]+)$", 1).cast("long").alias("stamp")
    return read.select(*which, "line", *(c.alias(k) for c, k in zip(place, "ijl", strict=True)), "value")


def paired_winds(spark: SparkSession, base: str, stamp: str = "*") -> DataFrame:
    """(stamp, line, u, v, lat, lon) of the files ``u_<stamp>.dat`` and ``v_<stamp>.dat`` that hold both components at the same points.

    Lines of one number belong together; an error if their coordinates differ or if one file has a line that the other lacks.
    """

    def component(kind: str) -> DataFrame:
        lines = spark.read.text(data_path(base, kind, stamp))
        name = F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}_([0-9]+)\.dat(?:/[^/]*)?$", 1)
        kept = lines.filter(~F.col("value").contains("#") & (F.trim("value") != "")).withColumn("name", name)
        read = numbers(line_numbers(kept))
        return read.select("name", "line", F.struct(F.nullif("value", F.lit(UNDEFINED)).alias("value"), "lat", "lon").alias(kind))

    both = component("u").join(component("v"), ["name", "line"], "full")
    apart = F.coalesce((F.col("u.lat") != F.col("v.lat")) | (F.col("u.lon") != F.col("v.lon")), F.lit(True))
    told = F.raise_error(F.concat(F.lit("components at different points: "), F.col("name"), F.lit(", line "), F.col("line").cast("string")))
    return both.select(F.col("name").cast("long").alias("stamp"), "line", F.when(apart, told.cast("double")).otherwise(F.col("u.value")).alias("u"), F.col("v.value").alias("v"), F.col("u.lat").alias("lat"), F.col("u.lon").alias("lon"))
