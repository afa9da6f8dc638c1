"""A watched folder as a streaming source: ``spark.readStream.format("watched_folder")``.

Options: ``path``, the folder, which driver and executors share; ``log``, a folder for the
scans; ``parts``, tasks of a batch (8); ``wait``, least seconds between scans (0).

Each offset is the number of a scan. A scan lists the folder once and is written to the
log under its number before its offset is given out, so a batch that is read again after
a failure, or after a restart, reads the same listing. Rows are (path, scan, size,
mtime, ok), what ``watch`` settles; a batch's rows are dealt over its parts by path.
Scans that are done are taken from the log when their batch is committed. Names that
begin with a dot, and what is no file, are not listed."""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, scan long, size long, mtime long, ok boolean"
NAME = "watched_folder"


def listing(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """Path, bytes, milliseconds of change, and whether it can be read, of each file below."""
    for top, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if not d.startswith("."))
        for name in sorted(n for n in names if not n.startswith(".")):
            path = os.path.join(top, name)
            try:
                found = os.stat(path)
            except FileNotFoundError:  # it went meanwhile
                continue
            if os.path.isfile(path):
                yield path, found.st_size, int(found.st_mtime * 1000), os.access(path, os.R_OK)


class Part(InputPartition):
    def __init__(self, file: str, scan: int, part: int, parts: int):
        self.file, self.scan, self.part, self.parts = file, scan, part, parts


class Scans(DataSourceStreamReader):
    def __init__(self, options: dict):
        for needed in ("path", "log"):
            if not options.get(needed):
                raise ValueError(f"the source needs the option {needed}")
        self.folder, self.log, self.count, self.wait = options["path"], options["log"], int(options.get("parts", 8)), float(options.get("wait", 0))
        os.makedirs(self.log, exist_ok=True)

    def file(self, scan: int) -> str:
        return os.path.join(self.log, f"scan-{scan:012d}.jsonl")

    def initialOffset(self) -> dict:
        return {"scan": -1}

    def latestOffset(self) -> dict:
        known = [int(n[5:-6]) for n in os.listdir(self.log) if n.startswith("scan-")]
        last = max(known, default=-1)
        if known and time.time() - os.path.getmtime(self.file(last)) < self.wait:
            return {"scan": last}
        draft = os.path.join(self.log, f".{uuid.uuid4().hex}")
        with open(draft, "w") as out:
            out.writelines(json.dumps(row) + "\n" for row in listing(self.folder))
        os.rename(draft, self.file(last + 1))  # whole, or not there
        return {"scan": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(self.file(scan), scan, part, self.count) for scan in range(start["scan"] + 1, end["scan"] + 1) for part in range(self.count)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = []
        with open(part.file) as lines:
            for line in lines:
                path, size, mtime, ok = json.loads(line)
                if zlib.crc32(path.encode("utf-8", "surrogateescape")) % part.parts == part.part:
                    rows.append({"path": path, "scan": part.scan, "size": size, "mtime": mtime, "ok": ok})
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def commit(self, end: dict) -> None:
        """All but the last scan may go: its number tells the next one's."""
        for name in os.listdir(self.log):
            if name.startswith("scan-") and int(name[5:-6]) < end["scan"]:
                os.remove(os.path.join(self.log, name))


ARROW = pa.schema([("path", pa.string()), ("scan", pa.int64()), ("size", pa.int64()), ("mtime", pa.int64()), ("ok", pa.bool_())])


class WatchedFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Scans:
        return Scans(self.options)


def watched_folder(spark: SparkSession, path: str, log: str, parts: int = 8, wait: float = 0):
    """A stream of listings of the folder."""
    spark.dataSource.register(WatchedFolder)
    return spark.readStream.format(NAME).option("path", path).option("log", log).option("parts", parts).option("wait", wait).load()
