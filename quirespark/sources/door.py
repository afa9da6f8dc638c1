"""One door for files: bytes and a name in, a document's text or a refusal out, and
sidecar files beside what was read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.sources import office, packages, pdf
from quirespark.sources.formats import INPUT_BYTES, classify, decode_text


def pdf_text(content: bytes) -> str:
    doc = pdf.Document(content)
    return "\n\n".join("\n".join(r["text"] for r in pdf.runs_of(doc, page) if r["visible"]) for page in doc.pages())


def comic_text(content: bytes) -> str:
    return "\n".join(f"{name}: {kind} {w} x {h}" for name, kind, w, h in office.comic_pages(content))


#: Formats whose text a reader gives; plain ones are decoded by expression, others have none.
READERS = {
    "html": lambda b: packages.sanitized(b.decode("utf-8", "replace"))["text"], "svg": lambda b: packages.sanitized(b.decode("utf-8", "replace"))["text"], "eml": lambda b: packages.mail(b)["body"], "mhtml": lambda b: packages.sanitized(office.mhtml(b)["html"])["text"],
    "epub": packages.epub_text, "pdf": pdf_text, "cbz": comic_text, **{k: (lambda kind: lambda b: "\n".join(office.paragraphs_of(b, kind)))(k) for k in ("docx", "odt", "pptx")},
    **{k: (lambda kind: lambda b: "\n".join("\t".join(r) for r in office.cells_of(b, kind)))(k) for k in ("xlsx", "ods")},
}
PLAIN = ("txt", "md", "csv", "tsv", "log")


def imported(files: DataFrame, key: str = "file_id", name: str = "name", content: str = "content") -> DataFrame:
    """key, format, text, refusal of every file: classified by bytes and name, refused past
    the size cap, and read by its format's reader. A PDF tells itself by its head."""
    found = classify(F.col(content), F.col(name))
    is_pdf = F.startswith(F.hex(F.substring(F.col(content), 1, 5)), F.lit("255044462D"))
    own = files.select(F.col(key).alias("_key"), F.when(is_pdf, "pdf").otherwise(found["format"]).alias("format"), F.when(~is_pdf, found["refusal"]).alias("refusal"), F.col(content).alias("content"))
    own = own.withColumn("refusal", F.coalesce("refusal", F.when(F.octet_length("content") > INPUT_BYTES, "input too large")))
    plain = F.col("format").isin(*PLAIN)
    own = own.withColumn("text", F.when(plain & F.col("refusal").isNull(), decode_text(F.col("content")))).withColumn("content", F.when(~plain & F.col("refusal").isNull(), F.col("content")))
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, why = batch.column("text").to_pylist(), batch.column("refusal").to_pylist()
            for k, (form, data) in enumerate(zip(batch.column("format").to_pylist(), batch.column("content").to_pylist())):
                if data is None or why[k] is not None:
                    continue
                try:
                    texts[k] = READERS[form](bytes(data))
                except KeyError:
                    why[k] = "no reader"
                except Exception as e:  # noqa: BLE001  whatever a broken file raises is its refusal
                    why[k] = type(e).__name__
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("format"), pa.array(texts, pa.string()), pa.array(why, pa.string())], [key, "format", "text", "refusal"])

    return own.mapInArrow(run, f"`{key}` {kind}, format string, text string, refusal string")


def write_sidecars(reports: DataFrame, suffix: str = ".ua.txt") -> DataFrame:
    """Writes each report (path, report) to the path and the suffix, under a name of its
    own and then moved: a reader sees all of it or none. The file itself is not touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, report in zip(batch.column("path").to_pylist(), batch.column("report").to_pylist()):
                fs, own = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                part = f"{own}{suffix}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write((report or "").encode())
                fs.move(part, own + suffix)
                out.append(path + suffix)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["path"])

    return reports.select("path", "report").mapInArrow(run, "path string")
