"""Documents and grids as packages, and package and image sources: DOCX, ODT, EPUB and
PPTX of a document's blocks, XLSX and ODS of a grid's rows, MHTML, comic archives and
image headers.

A package is built and read whole, a document at a time, in Arrow batches; its size is
that of one document. Text goes through one XML escape. The readers give back what the
writers put in, which is how both are tested."""

from __future__ import annotations

import email
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.arrow import pieces, plain
from quirespark.sources.packages import epub_text, opened, part_text

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML cannot hold.
ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
#: A date for all members (1 January 1980, as archives write it), so that equal documents are equal packages.
DAY = 1 << 5 | 1


#: What makes a text not stand in XML as it is.
MARKED = re.compile(f"[&<>\"]|{ILLEGAL.pattern}")


def xml(text: str) -> str:
    return escape(ILLEGAL.sub("", text), {'"': "&quot;"}) if MARKED.search(text) else text


def packed(name: str, text: str | bytes) -> tuple[bytes, bytes]:
    """A member: its head and data, and its listing without the place. One named mimetype is
    stored as it is, and so are bytes. Small members take a small window, which costs less to set up."""
    data, raw = text.encode() if isinstance(text, str) else text, name.encode()
    size = len(data)
    if name == "mimetype" or data is text:
        method, body = zipfile.ZIP_STORED, data
    else:
        small = size < 4096
        packer = zlib.compressobj(6, zlib.DEFLATED, -12 if small else -15, 4 if small else 8)
        method, body = zipfile.ZIP_DEFLATED, packer.compress(data) + packer.flush()
    fields = struct.pack("<5H3L2H", 20, 0 if name.isascii() else 0x800, method, 0, DAY, zlib.crc32(data), len(body), size, len(raw), 0)
    return b"PK\3\4" + fields + raw + body, b"PK\1\2\x14\3" + fields + struct.pack("<3HL", 0, 0, 0, 0o600 << 16)


def zipped(members: list[tuple[str, str | bytes] | tuple[bytes, bytes]]) -> bytes:
    """A package of its members in order, each as (name, text or bytes) or as ``packed`` gives it."""
    heads, listed, at = [], [], 0
    for m in members:
        head, listing = packed(*m) if isinstance(m[0], str) else m
        n = int.from_bytes(head[26:28], "little")
        heads.append(head)
        listed += [listing, at.to_bytes(4, "little"), head[30 : 30 + n]]
        at += len(head)
    if at >= 0xFFFFFFFF or len(heads) >= 0xFFFF:
        raise ValueError("the package is too large")
    names = b"".join(listed)
    return b"".join([*heads, names, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(heads), len(heads), len(names), at, 0)])


TYPES = HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
RELS = HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def override(part: str, kind: str) -> str:
    return f'<Override PartName="{part}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>'


def related(k: int, kind: str, target: str) -> str:
    return f'<Relationship Id="rId{k}" Type="{OFFICE}/{kind}" Target="{target}"/>'


Block = tuple[str, int, str, str]  # kind, level, marker, text


DOCX_HEAD = [packed("[Content_Types].xml", TYPES.format(override("/word/document.xml", "wordprocessingml.document.main"))), packed("_rels/.rels", RELS.format(related(1, "officeDocument", "word/document.xml")))]


def docx(blocks: list[Block]) -> bytes:
    """Headings by style; an item keeps its marker as text."""
    def paragraph(kind, level, marker, text):
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if kind == "heading" else '<w:pPr><w:pStyle w:val="ListParagraph"/></w:pPr>' if kind == "item" else ""
        mark = f'<w:r><w:t xml:space="preserve">{xml(marker)}</w:t></w:r><w:r><w:tab/></w:r>' if kind == "item" and marker else ""
        return f'<w:p>{style}{mark}<w:r><w:t xml:space="preserve">{xml(text)}</w:t></w:r></w:p>'

    body = "".join(paragraph(*b) for b in blocks)
    return zipped([
        *DOCX_HEAD,
        ("word/document.xml", f'{HEAD}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:sectPr/></w:body></w:document>'),
    ])


def pptx(blocks: list[Block]) -> bytes:
    """A slide for each heading and what follows it."""
    slides: list[list[Block]] = [[]]
    for b in blocks:
        if b[0] == "heading" and slides[-1]:
            slides.append([])
        slides[-1].append(b)

    def slide(own):
        text = "".join(f"<a:p><a:r><a:t>{xml(f'{m} {t}' if k == 'item' and m else t)}</a:t></a:r></a:p>" for k, _, m, t in own) or "<a:p/>"
        shape = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Text"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{text}</p:txBody></p:sp>'
        return f'{HEAD}<p:sld xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shape}</p:spTree></p:cSld></p:sld>'

    n = range(1, len(slides) + 1)
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in n)
    deck = f'{HEAD}<p:presentation xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{OFFICE}"><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'
    kinds = override("/ppt/presentation.xml", "presentationml.presentation.main") + "".join(override(f"/ppt/slides/slide{k}.xml", "presentationml.slide") for k in n)
    return zipped([
        ("[Content_Types].xml", TYPES.format(kinds)), ("_rels/.rels", RELS.format(related(1, "officeDocument", "ppt/presentation.xml"))), ("ppt/presentation.xml", deck),
        ("ppt/_rels/presentation.xml.rels", RELS.format("".join(related(k, "slide", f"slides/slide{k}.xml") for k in n))), *((f"ppt/slides/slide{k}.xml", slide(s)) for k, s in zip(n, slides)),
    ])


ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" office:version="1.3"'


@lru_cache
def open_document_head(kind: str) -> list[tuple[bytes, bytes]]:
    mime = f"application/vnd.oasis.opendocument.{kind}"
    listed = f'<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return [packed("mimetype", mime), packed("META-INF/manifest.xml", HEAD + listed)]


def open_document(kind: str, body: str) -> bytes:
    return zipped([*open_document_head(kind), ("content.xml", f"{HEAD}<office:document-content {ODF}><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>")])


BLANKS = re.compile("^ +| +$|(?<= ) +")


def odf_text(text: str) -> str:
    """Blanks after a blank, and outer ones, as elements: a reader collapses others."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return xml(text)
    return BLANKS.sub(lambda m: f'<text:s text:c="{len(m[0])}"/>', xml(text))


def odt(blocks: list[Block]) -> bytes:
    def paragraph(kind, level, marker, text):
        if kind == "heading":
            return f'<text:h text:outline-level="{level}">{odf_text(text)}</text:h>'
        return f"<text:p>{odf_text(f'{marker} {text}' if kind == 'item' and marker else text)}</text:p>"

    return open_document("text", "".join(paragraph(*b) for b in blocks))


def epub(blocks: list[Block], title: str = "Document", lang: str = "und") -> bytes:
    """A chapter for each heading of the first level, or one."""
    chapters: list[list[Block]] = [[]]
    for b in blocks:
        if b[0] == "heading" and b[1] == 1 and chapters[-1]:
            chapters.append([])
        chapters[-1].append(b)

    def chapter(own):
        line = lambda k, level, m, t: f"<h{level}>{xml(t)}</h{level}>" if k == "heading" else f"<p>{xml(f'{m} {t}' if k == 'item' and m else t)}</p>"
        return f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{xml(lang)}"><head><title>{xml(title)}</title></head><body>{"".join(line(*b) for b in own)}</body></html>'

    n = range(1, len(chapters) + 1)
    links = "".join(f'<li><a href="c{k}.xhtml">{k}</a></li>' for k in n)
    nav = f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{xml(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in n)
    package = f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:document</dc:identifier><dc:title>{xml(title)}</dc:title><dc:language>{xml(lang)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{"".join(f"""<itemref idref="c{k}"/>""" for k in n)}</spine></package>'
    container = f'{HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    # Chapters are stored last to first: the spine, not the archive, has the order.
    return zipped([("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("book/package.opf", package), ("book/nav.xhtml", nav), *((f"book/c{k}.xhtml", chapter(chapters[k - 1])) for k in reversed(n))])


@lru_cache(1 << 14)
def column_name(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
XLSX_HEAD = [
    packed("[Content_Types].xml", TYPES.format(override("/xl/workbook.xml", "spreadsheetml.sheet.main") + override("/xl/worksheets/sheet1.xml", "spreadsheetml.worksheet"))),
    packed("_rels/.rels", RELS.format(related(1, "officeDocument", "xl/workbook.xml"))), packed("xl/_rels/workbook.xml.rels", RELS.format(related(1, "worksheet", "worksheets/sheet1.xml"))),
    packed("xl/workbook.xml", f'{HEAD}<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
]


def xlsx(rows: list[list[str]]) -> bytes:
    """Every cell is text, so nothing is a formula."""
    cell = lambda r, c, v: f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{xml(v)}</t></is></c>'
    body = "".join([f'<row r="{r}">{"".join([cell(r, c, v) for c, v in enumerate(row)])}</row>' for r, row in enumerate(rows, 1)])
    return zipped([*XLSX_HEAD, ("xl/worksheets/sheet1.xml", f'{HEAD}<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData></worksheet>')])


def ods(rows: list[list[str]]) -> bytes:
    cell = lambda v: f'<table:table-cell office:value-type="string"><text:p>{odf_text(v)}</text:p></table:table-cell>'
    body = "".join(f"<table:table-row>{''.join(map(cell, row))}</table:table-row>" for row in rows)
    return open_document("spreadsheet", f'<table:table table:name="Sheet1">{body}</table:table>')


@lru_cache(1 << 12)
def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def spelt(content: bytes) -> ElementTree.Element:
    """The tree of a part, OpenDocument's blanks and Word's tabs as text."""
    root = ElementTree.fromstring(content)
    for e in [e for e in root.iter() if bare(e.tag) in ("s", "tab")]:
        e.text = " " * int(next((v for k, v in e.attrib.items() if k.endswith("}c")), "1")) if bare(e.tag) == "s" else " "
        del e[:]
    return root


def said(e: ElementTree.Element) -> str:
    return "".join(e.itertext())


def paragraphs_of(content: bytes, kind: str) -> list[str]:
    """The paragraphs of a package, in order."""
    archive = opened(content)
    names = archive.namelist()
    if kind == "epub":
        return epub_text(content).replace("\n\n", "\n").split("\n")
    parts = {"docx": ["word/document.xml"], "odt": ["content.xml"], "pptx": sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))}[kind]
    return [said(e) for p in parts for e in spelt(archive.read(p)).iter() if bare(e.tag) in ("p", "h") and (kind != "pptx" or "drawingml" in e.tag)]


def cells_of(content: bytes, kind: str) -> list[list[str]]:
    archive = opened(content)
    root = spelt(archive.read("xl/worksheets/sheet1.xml" if kind == "xlsx" else "content.xml"))
    row, cell = ("row", "c") if kind == "xlsx" else ("table-row", "table-cell")
    return [[said(c) for c in r if bare(c.tag) == cell] for r in root.iter() if bare(r.tag) == row]


WRITERS = {"docx": docx, "odt": odt, "epub": epub, "pptx": pptx}
GRIDS = {"xlsx": xlsx, "ods": ods}


def made(df: DataFrame, key: str, column: str, write, out: str, kind: str) -> DataFrame:
    """key, and ``write`` of the column, of each row."""
    types = {"binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    own = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(x) for x in plain(batch.column(1))], types[kind])], [key, out])

    return df.select(key, column).mapInArrow(run, f"`{key}` {own}, {out} {kind}")


def to_package(blocks: DataFrame, kind: str) -> DataFrame:
    """doc_id, content: a document's blocks (doc_id, pos, kind, level, marker, text) as a package."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "level", "marker", "text"))), lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), b["marker"].alias("marker"), b["text"].alias("text")))
    write = WRITERS[kind]
    return made(blocks.groupBy("doc_id").agg(one.alias("blocks")), "doc_id", "blocks", lambda bs: write([(kind, level or 1, marker or "", text or "") for kind, level, marker, text in bs]), "content", "binary")


def from_package(packages: DataFrame, kind: str) -> DataFrame:
    return made(packages, "doc_id", "content", lambda c: paragraphs_of(c, kind), "paragraphs", "array<string>")


def to_grid(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, content: rows (doc_id, pos, cells) as a sheet."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda r: r["cells"])
    write = GRIDS[kind]
    return made(rows.groupBy("doc_id").agg(one.alias("grid")), "doc_id", "grid", lambda g: write([[c or "" for c in r] for r in g]), "content", "binary")


def from_grid(packages: DataFrame, kind: str) -> DataFrame:
    return made(packages, "doc_id", "content", lambda c: cells_of(c, kind), "grid", "array<array<string>>")


# Sources.


def mime_parts(content: bytes, most: int = 1000) -> list[tuple[str, str, str, bytes]]:
    """(type, content id, location, decoded body) of every leaf part, in order."""
    message = email.message_from_bytes(content, policy=email.policy.compat32)
    out = []
    for part in message.walk():
        if len(out) >= most:
            raise ValueError("too many parts")
        if not part.is_multipart():
            out.append((part.get_content_type(), (part.get("Content-ID") or "").strip().strip("<>"), (part.get("Content-Location") or "").strip(), part.get_payload(decode=True) or b""))
    return out


SOURCE = re.compile(r"""(<img\b[^>]*?\bsrc\s*=\s*)(?:"([^"]*)"|'([^']*)')""", re.I)


def mhtml(content: bytes) -> dict:
    """The first HTML part is the page; its pictures are those of the package, by content
    id or location, and nothing else is fetched."""
    parts = mime_parts(content)
    message = email.message_from_bytes(content, policy=email.policy.compat32)
    page = next((part_text(p) for p in message.walk() if p.get_content_type() == "text/html"), None)
    if page is None:
        raise ValueError("no page in the package")
    images = {key: (kind, len(body)) for kind, cid, location, body in parts if kind.startswith("image/") for key in (f"cid:{cid}" if cid else "", location) if key}
    sources = [a or b for _, a, b in SOURCE.findall(page)]
    return {"html": page, "parts": len(parts), "pictures": sum(s in images for s in sources), "missing": sum(s not in images and not s.lower().startswith("data:") for s in sources)}


def image_info(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) from an image's header, without decoding; else None."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return "webp", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    return None


DIGITS = re.compile(r"\d+|\D+")


def natural(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in DIGITS.findall(name)]


def comic_pages(content: bytes) -> list[tuple[str, str, int, int]]:
    """(name, kind, width, height) of a comic archive's pictures, in natural order; hidden
    and other members are left out."""
    archive, out = opened(content), []
    for path in sorted(archive.namelist(), key=natural):
        name = path.rpartition("/")[2]
        if path.endswith("/") or name.startswith(".") or path.startswith("__MACOSX/"):
            continue
        found = image_info(archive.read(path, 1 << 16))
        if found:
            out.append((path, *found))
    return out
