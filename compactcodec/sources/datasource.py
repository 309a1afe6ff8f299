"""``spark.read.format("ctext")`` and ``cbin``, batch and streaming: one partition a file, one value a row.

Files are listed and opened through Arrow's file systems, so paths may be URIs of any store that Arrow
knows.  ``ctext`` writes the rows of a task as table documents, ``cbin`` as messages, each of at most
``maxRecordsPerFile`` rows (options come in lower case).  Tasks write below ``_staging``; only the commit moves files to where
readers find them, so a task that runs twice leaves no second copy, and ``overwrite`` takes the old
files away.  What tasks of a failed job still write stays below ``_staging``, which no reader sees.
"""

from __future__ import annotations

import json
import uuid
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from compactcodec.functions.codec import BROKEN
from compactcodec.kernel import binary, scalars, text


STAGING, MOST_RECORDS = "_staging", 100_000


def _files(path: str, suffix: str) -> list[str]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        return []
    return sorted(p for p, _ in _found(path, suffix))


def _found(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files below a folder and when they were written (ns); none while they are staged."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    infos = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    below = [(f.path[len(at.rstrip("/")) :], f) for f in infos if f.type == fs.FileType.File and f.path.endswith(suffix)]
    return [(path.rstrip("/") + p, f.mtime_ns or 0) for p, f in below if not p.startswith(f"/{STAGING}/")]


def _read(path: str) -> bytes:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Rows:
    """Reads one file into rows (path, value as JSON)."""

    def __init__(self, options: dict, suffix: str):
        self.options, self.suffix = options, suffix

    def rows(self, path: str):
        raw, mode = _read(path), self.options.get("mode", "PERMISSIVE")
        try:
            if self.suffix == ".cbin":
                value = binary.loads(raw)
            else:
                value = text.loads(raw.decode(), int(self.options.get("indent", 2)), self.options.get("strict", "true") == "true")
        except BROKEN:
            if mode == "FAILFAST":
                raise
            if mode == "PERMISSIVE":
                yield path, None
            return
        yield path, json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class _Reader(_Rows, DataSourceReader):
    def partitions(self):
        return [FilePartition(f) for f in _files(self.options["path"], self.suffix)]

    def read(self, partition):
        yield from self.rows(partition.path)


class _StreamReader(_Rows, DataSourceStreamReader):
    """New files in the order in which they were written.

    The offset is the latest time taken and the names written at that time, so a later file counts
    whatever its name, and one of the same moment too.
    """

    def initialOffset(self):
        return {"time": 0, "names": []}

    def latestOffset(self):
        found = _found(self.options["path"], self.suffix)
        last = max((t for _, t in found), default=0)
        return {"time": last, "names": sorted(p for p, t in found if t == last)}

    def partitions(self, start, end):
        def taken(path: str, time: int, by: dict) -> bool:
            return time < by["time"] or time == by["time"] and path in by["names"]

        found = sorted((t, p) for p, t in _found(self.options["path"], self.suffix))
        return [FilePartition(p) for t, p in found if taken(p, t, end) and not taken(p, t, start)]

    def read(self, partition):
        yield from self.rows(partition.path)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, suffix: str, schema: StructType, overwrite: bool):
        self.options, self.suffix, self.schema, self.overwrite = options, suffix, schema, overwrite
        self.job = uuid.uuid4().hex

    def _at(self, *names: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri("/".join((self.options["path"].rstrip("/"), *names)))

    def write(self, rows):
        names, most = [], int(self.options.get("maxrecordsperfile", MOST_RECORDS))
        rows = iter(rows)
        while values := [scalars.normalise(r.asDict(recursive=True)) for r in islice(rows, most)]:
            names.append(f"part-{uuid.uuid4().hex}{self.suffix}")
            raw = binary.dumps(values) if self.suffix == ".cbin" else text.dumps(values, int(self.options.get("indent", 2)), self.options.get("delimiter", ",")).encode()
            system, at = self._at(STAGING, self.job, names[-1])
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(at) as f:
                f.write(raw)
        return Written(names)

    def commit(self, messages):
        old = [p for p, _ in _found(self.options["path"], self.suffix)] if self.overwrite else []
        for name in (n for m in messages if m is not None for n in m.names):
            system, source = self._at(STAGING, self.job, name)
            system.move(source, self._at(name)[1])
        for path in old:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(path)
            system.delete_file(at)
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        from pyarrow import fs

        system, at = self._at(STAGING, self.job)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
        system, at = self._at(STAGING)
        if system.get_file_info(at).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(at)):
            system.delete_dir(at)


class CtextSource(DataSource):
    SUFFIX = ".ctext"

    @classmethod
    def name(cls):
        return "ctext"

    def schema(self):
        return "path string, value string"

    def reader(self, schema):
        return _Reader(dict(self.options), self.SUFFIX)

    def streamReader(self, schema):
        return _StreamReader(dict(self.options), self.SUFFIX)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), self.SUFFIX, schema, overwrite)


class CbinSource(CtextSource):
    SUFFIX = ".cbin"

    @classmethod
    def name(cls):
        return "cbin"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CtextSource)
    spark.dataSource.register(CbinSource)
