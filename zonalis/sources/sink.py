"""A sink of stored data under resolved names, ``ratio_<k>_<YYYYMMDDHHMM>.dat`` and the like, written in two phases.

Tasks write pieces to a folder of the job's own; what a task wrote becomes visible only when the whole job has succeeded and its pieces are
moved to their names. A failed or repeated task leaves nothing: its pieces are never named by a commit, and the folder goes at the end. A
name that is there already is an error, found before anything is moved, unless the mode is ``overwrite``.

A dataset of up to ``LINES_PER_FILE`` lines is one file; a longer one is a folder of that name with parts in order, which ``read_stored`` and
``scan_positions`` read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from zonalis.sources.text import LINE, UNDEFINED

#: Lines of a file at most (about 290 MB).
LINES_PER_FILE = 4_000_000
FORMAT = "zonalis_fields"


@dataclass
class Pieces(WriterCommitMessage):
    """What a task wrote: (name, part) to the path of the piece."""

    found: dict[tuple[str, int], str]


class FieldWriter(DataSourceWriter):
    def __init__(self, base: str, overwrite: bool):
        self.base, self.overwrite = base.rstrip("/"), overwrite
        self.staging = f"{self.base}/_staging-{uuid.uuid4().hex}"

    def _files(self):
        """The file system of the base, and the path of a full name in it."""
        from pyarrow import fs

        if "://" not in self.base and not self.base.startswith("file:"):
            return fs.LocalFileSystem(), lambda p: p
        system, root = fs.FileSystem.from_uri(self.base)
        return system, lambda p: root.rstrip("/") + p[len(self.base) :]

    def write(self, iterator: Iterator) -> Pieces:
        system, at = self._files()
        found, out, now = {}, None, None
        try:
            for row in iterator:
                key = (row["name"], row["part"])
                if key != now:
                    if out:
                        out.close()
                    if key in found:
                        raise ValueError(f"lines of {key} are not together")
                    found[key] = f"{self.staging}/{uuid.uuid4().hex}"
                    system.create_dir(at(self.staging), recursive=True)
                    out, now = system.open_output_stream(at(found[key]), buffer_size=1 << 20), key
                out.write(row["line"].encode() + b"\n")
        finally:
            if out:
                out.close()
        return Pieces(found)

    def commit(self, messages: list[Pieces | None]) -> None:
        from pyarrow import fs

        system, at = self._files()
        parts: dict[str, dict[int, str]] = {}
        for name, part, path in ((*key, path) for m in messages if m for key, path in m.found.items()):
            if part in parts.setdefault(name, {}):
                raise ValueError(f"two tasks wrote part {part} of {name}")
            parts[name][part] = path
        there = [name for name in parts if system.get_file_info(at(f"{self.base}/{name}")).type != fs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} is there already")
        for name, pieces in sorted(parts.items()):
            target = at(f"{self.base}/{name}")
            if name in there:
                kind = system.get_file_info(target).type
                (system.delete_dir if kind == fs.FileType.Directory else system.delete_file)(target)
            if list(pieces) == [0]:
                system.move(at(pieces[0]), target)
                continue
            system.create_dir(target)
            for part, path in sorted(pieces.items()):
                system.move(at(path), f"{target}/part-{part:08d}")
        self.abort(messages)

    def abort(self, messages: list[Pieces | None]) -> None:
        from pyarrow import fs

        system, at = self._files()
        if system.get_file_info(at(self.staging)).type != fs.FileType.NotFound:
            system.delete_dir(at(self.staging))


class FieldSink(DataSource):
    """Rows (name string, part int, line string), those of a name and part together and in order."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, part int, line string"

    def writer(self, schema, overwrite: bool) -> FieldWriter:
        return FieldWriter(self.options["path"], overwrite)


def write_named(lines: DataFrame, base: str, mode: str = "append", lines_per_file: int = LINES_PER_FILE) -> str:
    """Writes lines (name, place, line) under their names in order of ``place``, which counts from 0 in each; returns ``base``.

    A file, or part of a long one, is written by one task; files are dealt to tasks by hash.
    """
    lines.sparkSession.dataSource.register(FieldSink)
    cut = lines.withColumn("part", F.floor(F.col("place") / lines_per_file).cast("int"))
    dealt = cut.repartition("name", "part").sortWithinPartitions("name", "part", "place")
    dealt.select("name", "part", "line").write.format(FORMAT).mode(mode).save(base)
    return base


def stored_lines(values: DataFrame, kind: str) -> DataFrame:
    """(name, place, line) of values (stamp, place, value, lat, lon), with ``tracer`` for ratios; unset values as -9999."""
    first = [F.lit("ratio_"), F.col("tracer").cast("string"), F.lit("_")] if kind == "ratio" else [F.lit(f"{kind}_")]
    name = F.concat(*first, F.lpad(F.col("stamp").cast("string"), 12, "0"), F.lit(".dat"))
    line = F.format_string(LINE, F.coalesce(F.col("value").cast("double"), F.lit(UNDEFINED)), F.col("lat"), F.col("lon"))
    return values.select(name.alias("name"), "place", line.alias("line"))
