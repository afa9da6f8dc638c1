"""Documents and grids as text: plain text, Markdown, HTML, CSV, form records.

All but the nested form records are Column expressions over ordered blocks; a
document's text is built in one aggregation by document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import csv_safe, markdown_escape, markdown_line_start, xml_escape


def csv_row(cells: Column) -> Column:
    """A row with formulas disarmed and cells quoted where they must be."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]|^ | $'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, lambda c: quoted(csv_safe(F.coalesce(c, F.lit(""))))), ",")


def joined(blocks: DataFrame, piece: Column, tight: Column) -> DataFrame:
    """doc_id, text: pieces in order, a blank line apart, or a line where ``tight``."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    gap = F.when(F.lag("pos").over(w).isNull(), "").when(tight, "\n").otherwise("\n\n")
    parts = blocks.withColumn("_piece", F.concat(gap, piece))
    one = F.collect_list(F.struct("pos", "_piece"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(one), lambda x: x["_piece"]), "").alias("text"))


def both_items() -> Column:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return (F.col("kind") == "item") & (F.lag("kind").over(w) == "item")


def to_text(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, kind, marker, text): adjacent list items stay together; a
    picture is its alternative text."""
    piece = F.when(F.col("kind") == "item", F.concat_ws(" ", F.nullif("marker", F.lit("")), "text")).when(F.col("kind") == "picture", F.concat(F.lit("[Picture: "), "text", F.lit("]"))).otherwise(F.col("text"))
    return joined(blocks, piece, both_items())


def to_markdown(blocks: DataFrame) -> DataFrame:
    """One escape for all text; headings by level; items with a dash or their number."""
    body = markdown_line_start(markdown_escape(F.col("text")))
    number = F.regexp_extract("marker", "^([0-9]+)", 1)
    mark = F.when(number != "", F.concat(number, F.lit(". "))).otherwise("- ")
    piece = F.when(F.col("kind") == "item", F.concat(mark, body)).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), body)).when(F.col("kind") == "picture", F.concat(F.lit("!["), markdown_escape(F.col("text")), F.lit("]()"))).otherwise(body)
    return joined(blocks, piece, both_items())


def to_html(blocks: DataFrame) -> DataFrame:
    """An inert document: a fixed policy that loads nothing, and escaped text."""
    body = xml_escape(F.col("text"))
    tag = F.when(F.col("kind") == "heading", F.concat(F.lit("h"), F.col("level").cast("string"))).when(F.col("kind") == "item", "li").otherwise("p")
    piece = F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
    whole = joined(blocks, piece, F.lit(True))
    head = "<!doctype html>\n<meta charset=\"utf-8\">\n<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'\">\n"
    return whole.select("doc_id", F.concat(F.lit(head), "text").alias("text"))


RECORD = "struct<forms:array<struct<textfield:array<struct<id:string,name:string,value:string>>>>>"


def json_record(fields: Column) -> Column:
    """A form record of an array of (id, name, value)."""
    return F.to_json(F.struct(F.array(F.struct(fields.alias("textfield"))).alias("forms")))


def json_field_names(record: Column) -> Column:
    """Ids and names that a record asks for, sorted and distinct."""
    fields = F.flatten(F.transform(F.from_json(record, RECORD)["forms"], lambda f: f["textfield"]))
    names = F.flatten(F.transform(fields, lambda f: F.array(f["id"], f["name"])))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")))


def write_xfdf(fields: list[tuple[str, str]]) -> str:
    """Dotted names as nested fields; repeated names as repeated values."""
    root = ElementTree.Element("xfdf", xmlns="http://ns.adobe.com/xfdf/")
    top = ElementTree.SubElement(root, "fields")
    for name, value in fields:
        at = top
        for part in name.split("."):
            found = next((e for e in at if e.tag == "field" and e.get("name") == part), None)
            at = ElementTree.SubElement(at, "field", name=part) if found is None else found
        ElementTree.SubElement(at, "value").text = value
    return ElementTree.tostring(root, encoding="unicode")


def read_xfdf(data: str, most: int = 100_000) -> list[tuple[str, str]]:
    """Values by dotted name, in document order; more than ``most`` are refused."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", data, re.I):
        raise ValueError("a form record has no document type")
    out: list[tuple[str, str]] = []
    waiting = [("", ElementTree.fromstring(data))]
    while waiting:
        path, element = waiting.pop()
        tag = element.tag.rpartition("}")[2]
        own = f"{path}.{element.get('name')}".lstrip(".") if tag == "field" else path
        if tag == "value":
            out.append((own, element.text or ""))
        if len(out) > most:
            raise ValueError("too many values")
        waiting += [(own, child) for child in reversed(list(element))]
    return out


def xfdf_round_trip(forms: DataFrame) -> DataFrame:
    """Forms (doc_id, fields array of (name, value)) written and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, v) for d, fields in zip(batch.column("doc_id").to_pylist(), batch.column("fields").to_pylist()) for n, v in read_xfdf(write_xfdf([(f["name"], f["value"]) for f in fields]))]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["doc_id", "name", "value"])

    return forms.mapInArrow(run, "doc_id long, name string, value string")


TOKEN = re.compile(rb"(?P<space>[\x00\t\n\x0c\r ]+)|(?P<comment>%[^\r\n]*)|(?P<string>\((?:\\.|[^\\()])*\))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$))|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)", re.S)


def content_tokens(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end): tokens cover the stream whole and do not overlap. Brackets in
    strings may nest."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 1] == b"(":
            depth, end = 0, at
            while end < len(data):
                c = data[end : end + 1]
                end += 2 if c == b"\\" else 1
                depth += (c == b"(") - (c == b")")
                if not depth:
                    break
            out.append(("string", at, min(end, len(data))))
        else:
            m = TOKEN.match(data, at)
            out.append((m.lastgroup, at, m.end()))
        at = out[-1][2]
    return out


def edited(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Ordered, non-overlapping replacements at offsets of the original; none: the same bytes."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        if start < at or end < start or end > len(data):
            raise ValueError("edits overlap or leave the stream")
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def unicode_map(cmap: str, most: int = 70_000) -> dict[str, str]:
    """Codes (hexadecimal) and their text of a ToUnicode map: single characters, ranges
    to a start or to a list; a range is bounded."""
    text = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
    out: dict[str, str] = {}
    for body in re.findall(r"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body):
            out[code.upper()] = text(to)
    for body in re.findall(r"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, to, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", body):
            codes = range(int(lo, 16), min(int(hi, 16), int(lo, 16) + most) + 1)
            texts = re.findall(r"<([0-9A-Fa-f]+)>", many) if many else None
            for k, code in enumerate(codes):
                if texts is not None and k >= len(texts) or len(out) >= most:
                    break
                own = text(texts[k]) if texts is not None else text(to)[:-1] + chr(ord(text(to)[-1]) + k)
                out[f"{code:0{len(lo)}X}"] = own
    return out
