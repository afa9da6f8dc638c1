"""Readers of package formats, in Arrow batches with the standard library only: HTML
(sanitised), e-mail and MHTML, EPUB, archives. Each row is one document; a document
that breaks a bound gets a refusal, never a part."""

from __future__ import annotations

import email
import email.policy
import io
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from email.header import decode_header, make_header
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from quirespark.sources.formats import ARCHIVE_MEMBERS, EXPANDED_BYTES, RATIO, RATIO_FROM

#: Elements that go with all they hold, and those that are kept.
DROPPED = frozenset("script style iframe object embed form input button select textarea svg math canvas audio video noscript template applet frame frameset link meta base".split())
KEPT = frozenset("a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q rp rt ruby s samp section small span strong sub summary sup table tbody td tfoot th thead time tr u ul var wbr".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Elements without an end, which open nothing.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SAFE = re.compile(r"(?i)^\s*(?:https?|mailto):")


class Sanitizer(HTMLParser):
    """Keeps an allowed tree: text, headings, safe links and picture texts; counts what goes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.title, self.lang = [], ""
        self.headings: list[str] = []
        self.links: list[str] = []
        self.elements: list[tuple[int, int, str]] = []  # number, parent, name
        self.open: list[tuple[str, int]] = []
        self.skipped: list[str] = []
        self.in_title = self.dropped = self.images = 0
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in DROPPED:
            self.dropped += 1
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag == "html":
            self.lang = own.get("lang") or ""
        if tag == "title":
            self.in_title += 1
        if tag not in KEPT:
            return
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "img":
            self.images += 1
            self.put(own.get("alt") or "")
        if tag == "a" and SAFE.match(own.get("href") or ""):
            self.links.append(own["href"].strip())
        if re.fullmatch("h[1-6]", tag):
            self.heading = []
        number = len(self.elements) + 1
        self.elements.append((number, self.open[-1][1] if self.open else 0, tag))
        if tag not in VOID:
            self.open.append((tag, number))

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        if tag == "title":
            self.in_title = max(0, self.in_title - 1)
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if re.fullmatch("h[1-6]", tag) and self.heading is not None:
            self.headings.append(f"{tag[1]} {' '.join(''.join(self.heading).split())}")
            self.heading = None
        if tag in BLOCKS:
            self.text.append("\n")

    def put(self, data: str) -> None:
        self.text.append(data)
        if self.heading is not None:
            self.heading.append(data)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self.put(data)

    def result(self) -> dict:
        lines = (" ".join(line.split()) for line in "".join(self.text).split("\n"))
        return {
            "text": "\n".join(line for line in lines if line), "title": " ".join("".join(self.title).split()), "lang": self.lang, "headings": self.headings, "links": self.links,
            "dropped_elements": self.dropped, "dropped_images": self.images, "elements": [{"id": n, "parent": p, "name": t} for n, p, t in self.elements],
        }


def sanitized(html: str) -> dict:
    reader = Sanitizer()
    reader.feed(html)
    reader.close()
    return reader.result()


def mail_text(value: str) -> str:
    """A header as text: decoded words, white space as one blank, no control or format
    characters, at most 1,000 characters."""
    try:
        text = str(make_header(decode_header(value)))
    except (ValueError, LookupError):
        text = value
    text = "".join(c for c in " ".join(text.split()) if unicodedata.category(c) not in ("Cc", "Cf"))
    return text[:1000]


def mail(content: bytes) -> dict:
    """Five headers, the body (plain preferred), and attachments counted, not decoded."""
    message = email.message_from_bytes(content, policy=email.policy.compat32)
    body, kind, attachments, html_first = "", "", 0, None
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            attachments += 1
        elif part.get_content_type() == "text/plain" and not body:
            body, kind = part_text(part), "plain"
        elif part.get_content_type() == "text/html" and html_first is None:
            html_first = part_text(part)
    if not body and html_first is not None:
        body, kind = sanitized(html_first)["text"], "html"
    return {h: mail_text(message.get(h, "")) for h in ("from", "to", "cc", "date", "subject")} | {"body": body, "kind": kind, "attachments_dropped": attachments}


def part_text(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


#: The end of an archive, a member's listing and its head.
END, LISTED, HEADED = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
PLAIN_TYPES = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)


class Archive:
    """What readers here use of a ``ZipFile``: names and members, in the order of the listing.
    Archives in one part, without comments, encryption or 64-bit sizes; others raise
    ``BadZipFile``, and ``opened`` leaves them to ``zipfile``."""

    def __init__(self, content: bytes):
        self.content, self.at = content, {}
        if len(content) < END.size:
            raise zipfile.BadZipFile("no end")
        sign, disk, first, here, count, size, at, comment = END.unpack_from(content, len(content) - END.size)
        if sign != b"PK\5\6" or disk or first or here != count or comment or count == 0xFFFF or at + size + END.size != len(content):
            raise zipfile.BadZipFile("not a plain archive")
        stop = at + size
        while at < stop:
            sign, _, _, flags, method, _, _, crc, packed, length, n, extra, said, _, _, _, head = LISTED.unpack_from(content, at)
            if sign != b"PK\1\2" or flags & ~0x808 or method not in PLAIN_TYPES or extra or said or max(packed, length, head) == 0xFFFFFFFF:
                raise zipfile.BadZipFile("not a plain member")
            raw = content[at + LISTED.size : at + LISTED.size + n]
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
            if name in self.at or b"\0" in raw:
                raise zipfile.BadZipFile("not a plain name")
            self.at[name] = (flags, method, crc, packed, length, head, raw)
            at += LISTED.size + n
        if len(self.at) != count:
            raise zipfile.BadZipFile("not a plain listing")

    def namelist(self) -> list[str]:
        return list(self.at)

    def sizes(self) -> list[int]:
        return [m[4] for m in self.at.values()]

    def read(self, name: str, most: int | None = None) -> bytes:
        """A member's bytes, or its first ``most``; a whole one has its checksum compared."""
        flags, method, crc, packed, length, at, raw = self.at[name]
        sign, _, _, _, _, _, _, _, _, n, extra = HEADED.unpack_from(self.content, at)
        begin = at + HEADED.size + n + extra
        if sign != b"PK\3\4" or self.content[at + HEADED.size : at + HEADED.size + n] != raw:
            raise zipfile.BadZipFile(f"{name}: another head")
        data = self.content[begin : begin + packed]
        if len(data) < packed:
            raise EOFError(name)
        if method == zipfile.ZIP_DEFLATED:
            data = zlib.decompressobj(-15).decompress(data, max(1, length if most is None else min(length, most)))
        data = data[: length if most is None else min(length, most)]
        if len(data) == length and zlib.crc32(data) != crc:
            raise zipfile.BadZipFile(f"{name}: another checksum")
        if len(data) < length and most is None:
            raise EOFError(name)
        return data


class Zipped(zipfile.ZipFile):
    """Any other archive, by ``zipfile``."""

    def sizes(self) -> list[int]:
        return [m.file_size for m in self.infolist()]

    def read(self, name: str, most: int | None = None) -> bytes:
        with self.open(name) as f:
            return f.read() if most is None else f.read(most)


def opened(content: bytes) -> Archive | Zipped:
    """An archive whose declared sizes keep the bounds; nothing is inflated here."""
    try:
        archive = Archive(content)
    except (zipfile.BadZipFile, struct.error, UnicodeDecodeError):
        archive = Zipped(io.BytesIO(content))
    members = archive.sizes()
    total = sum(members)
    if len(members) > ARCHIVE_MEMBERS:
        raise ValueError("too many members")
    if total > EXPANDED_BYTES:
        raise ValueError("expands too far")
    if total > RATIO_FROM and total > RATIO * max(1, len(content)):
        raise ValueError("compressed too well")
    return archive


def epub_text(content: bytes) -> str:
    """Chapters in spine order, whatever their order in the archive."""
    archive = opened(content)
    tree = lambda name: ElementTree.fromstring(archive.read(name))
    container = tree("META-INF/container.xml")
    package = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
    root, folder = tree(package), package.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
    spine = [items[e.get("idref")] for e in root.iter() if e.tag.endswith("}itemref") if e.get("idref") in items]
    return "\n\n".join(sanitized(archive.read(f"{folder}/{href}".lstrip("/")).decode("utf-8", "replace"))["text"] for href in spine)


HTML_SCHEMA = "text string, title string, lang string, headings array<string>, links array<string>, dropped_elements long, dropped_images long, elements array<struct<id:int,parent:int,name:string>>"
MAIL_SCHEMA = "`from` string, `to` string, cc string, date string, subject string, body string, kind string, attachments_dropped long"


def read_with(df: DataFrame, key: str, column: str, reader, schema: str) -> DataFrame:
    """key, the reader's columns, refusal (null if read). A null source is empty."""
    names = [p.split()[0].strip("`") for p in re.split(r",\s*(?![^<]*>)", schema)]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, why = [], []
            for source in batch.column(1).to_pylist():
                try:
                    rows.append(reader(source))
                    why.append(None)
                except Exception as e:  # noqa: BLE001  whatever a broken source raises is its refusal
                    rows.append({})
                    why.append(type(e).__name__)
            columns = [pa.array([r.get(n) for r in rows], arrow(n)) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(why, pa.string())], [key, *names, "refusal"])

    def arrow(name: str):
        if name in ("headings", "links"):
            return pa.list_(pa.string())
        if name == "elements":
            return pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("name", pa.string())]))
        return pa.int64() if name.startswith(("dropped", "attachments")) else pa.string()

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, {schema}, refusal string")


def read_html(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return read_with(pages, key, column, lambda s: sanitized(s or ""), HTML_SCHEMA)


def read_mail(files: DataFrame, key: str, column: str = "content") -> DataFrame:
    return read_with(files, key, column, lambda b: mail(bytes(b or b"")), MAIL_SCHEMA)


def read_epub(files: DataFrame, key: str, column: str = "content") -> DataFrame:
    return read_with(files, key, column, lambda b: {"text": epub_text(bytes(b))}, "text string")
