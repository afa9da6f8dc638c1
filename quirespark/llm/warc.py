"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

* ``write_archives``: records go to one gzip stream per task, a whole-file
  (monolithic) archive as many crawlers leave them. Equal payloads of at least
  ``REVISIT`` bytes are stored once; the others are revisit records.
* ``normalise``: each monolithic file is inflated once, as a stream; every record
  is written again as a gzip member of its own and gets a line in a sidecar index
  (offset, length, record id). Memory holds a chunk and one record.
* ``read_archives``: the sidecar index makes a file splittable: the index files are
  read, their lines dealt to tasks by runs of ``RUN`` archive bytes, and a task
  inflates just its members.

Files are written under the shared folder through Arrow's file systems, to a name
that is unique to the attempt and then moved, so a lost executor's task is simply
run again.

Rows: a null html is an empty payload. A page without url gets an ``urn:`` target.
A null or repeated page id is a record like any other; of equal payloads the
smallest id is the response (nulls last; rows that share it are all responses), so a
null id is one only where no copy has an id. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import join_checked, stage_path, staged, tidied

REVISIT = 100
CHUNK = 1 << 18
#: Archive bytes that a task reads in one run.
RUN = 4 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_at(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])


class Gzip:
    """A sink that compresses what it is given into one gzip member at a time."""

    def __init__(self, sink, level: int):
        self.sink, self.level, self.at, self.packer = sink, level, 0, None

    def write(self, data: bytes) -> None:
        self.packer = self.packer or zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.put(self.packer.compress(data))

    def end_member(self) -> None:
        if self.packer:
            self.put(self.packer.flush())
            self.packer = None

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)


def urn(page_id) -> str:
    """A page id in a header: no id is not the id "None", and no text breaks the line."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(name: str | None) -> str | None:
    return None if name is None or name == "<urn:page>" else unquote(name[len("<urn:page:") : -1])


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record with its HTTP head and payload, or a revisit with the head alone."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join(url.split()) or urn(page_id)[1:-1]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    else:
        block += payload
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of an inflated stream."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        at, seen = held.find(END), 0
        while at < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record's head is cut off")
            at = held.find(END, seen)
        head = bytes(held[:at])
        size = int(fields_of(head)["content-length"])
        if not head.startswith(b"WARC/") or not fill(at + 4 + size + 4) or held[at + 4 + size : at + 8 + size] != END:
            raise ValueError("not a whole WARC record")
        yield head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 8 + size]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one or more members, in bounded pieces."""
    packed, data = zlib.decompressobj(31), source.read(CHUNK)
    while data:
        piece = packed.decompress(data, CHUNK)
        if piece:
            yield piece
        data = packed.unused_data if packed.eof else packed.unconsumed_tail
        if packed.eof:
            packed = zlib.decompressobj(31)
        data = data or source.read(CHUNK)


def attempt(path: str) -> str:
    return f"{path}.{uuid.uuid4().hex}"


def marked(pages: DataFrame) -> DataFrame:
    """Pages with payload, payload_digest and refers_to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    large = pages.where(F.octet_length("payload") >= REVISIT)
    copies = staged(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first"), "warc-copies")
    out = join_checked(pages, copies, pages["digest"] == copies["_digest"], "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One monolithic gzip file per task; returns path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = sink = None
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    fs, root = open_at(folder)
                    fs.create_dir(root)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n = fs.open_output_stream(f"{name}.part", compression=None), 0
                    sink = Gzip(out, 1)
                sink.write(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                n += 1
        if sink is not None:
            sink.end_member()
            out.close()
            fs.move(f"{name}.part", name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n], pa.int64())], ["path", "records"])

    return pages.mapInArrow(tidied(run), "path string, records long")


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """Rewrites each monolithic file with a gzip member per record and a sidecar
    index; returns path, bytes, records of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, source = open_at(path)
                to, root = open_at(folder)
                to.create_dir(root)
                name = f"{root}/{path.rpartition('/')[2]}"
                own, n = attempt(name), 0
                with fs.open_input_stream(source, compression=None) as data, to.open_output_stream(own, compression=None) as out, to.open_output_stream(f"{own}.idx", compression=None) as index:
                    sink = Gzip(out, 6)
                    for head, block in records(inflated(data)):
                        at = sink.at
                        sink.write(head + END + block + END)
                        sink.end_member()
                        n += 1
                        line = {"offset": at, "length": sink.at - at, "id": fields_of(head).get("warc-record-id", "")}
                        index.write(json.dumps(line).encode() + b"\n")
                to.move(f"{own}.idx", f"{name}.idx")
                to.move(own, name)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([sink.at]), pa.array([n])], ["path", "bytes", "records"])

    return paths.select("path").mapInArrow(tidied(run), "path string, bytes long, records long")


def index_lines(files: DataFrame) -> DataFrame:
    """path, offset, length of every record, from the files' sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, source = open_at(f"{path}.idx")
                with fs.open_input_stream(source, compression=None) as data:
                    lines, rest = [], b""
                    while piece := data.read(CHUNK):
                        *whole, rest = (rest + piece).split(b"\n")
                        lines += map(json.loads, whole)
                        if len(lines) >= 10_000:
                            yield dealt(path, lines)
                            lines = []
                if lines:
                    yield dealt(path, lines)

    def dealt(path, lines):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), *(pa.array([x[k] for x in lines], pa.int64()) for k in ("offset", "length"))], ["path", "offset", "length"])

    return files.select("path").mapInArrow(tidied(run), "path string, offset long, length long")


def read_archives(files: DataFrame) -> DataFrame:
    """page_id (as text), record_type, payload_bytes, payload_digest, refers_to (as
    text) of every indexed record. The digest of a response is computed again from
    its payload and must be the recorded one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != opened:
                    if source:
                        source.close()
                    fs, path = open_at(row["path"])
                    opened, source = row["path"], fs.open_input_file(path)
                source.seek(row["offset"])
                ((head, block),) = records(iter([zlib.decompress(source.read(row["length"]), 31)]))
                fields = fields_of(head)
                http, _, payload = block.partition(END)
                digest = fields["warc-payload-digest"].partition(":")[2]
                size = int(fields_of(http)["content-length"])
                name = lambda k: page_of(fields.get(k))
                if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of {name('warc-record-id')} is damaged")
                out.append((name("warc-record-id"), size, digest, fields["warc-type"], name("warc-refers-to")))
            columns = zip(*out) if out else [()] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = -(-(files.agg(F.sum("bytes")).first()[0] or 1) // RUN)
    index = index_lines(files.repartition(max(1, min(files.count(), tasks)), "path"))
    index = index.repartition(tasks, "path", F.floor(F.col("offset") / RUN)).sortWithinPartitions("path", "offset")
    return index.mapInArrow(tidied(run), "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archived(pages: DataFrame) -> DataFrame:
    """Writes every page, normalises the archives, and reads all records back."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = stage_path(spark, "warc")
    written = staged(write_archives(marked(pages), f"{folder}/monolithic"), "warc-written")
    files = written.repartition(max(1, min(written.count(), spark.sparkContext.defaultParallelism * 4)), "path")
    found = read_archives(staged(normalise(files, f"{folder}/records"), "warc-files"))
    id_ = lambda c: F.col(c).cast(kind).alias(c)
    return found.select(id_("page_id"), "payload_bytes", "payload_digest", "record_type", id_("refers_to"))
