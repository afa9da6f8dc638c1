"""What a source is: the format registry, sniffing, classification, caps, decoding.

Bytes decide; a name that contradicts them is a named refusal, not a guess. Every
cap refuses and none truncates: refusals are rows of a rejects table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.text import once

#: Key, label, extensions, family.
FORMATS = (
    ("png", "PNG", ("png",), "raster"), ("jpeg", "JPEG", ("jpg", "jpeg"), "raster"), ("gif", "GIF", ("gif",), "raster"),
    ("tiff", "TIFF", ("tif", "tiff"), "raster"), ("bmp", "BMP", ("bmp",), "raster"), ("webp", "WebP", ("webp",), "raster"),
    ("cbz", "Comic book", ("cbz",), "zip"), ("epub", "EPUB", ("epub",), "zip"),
    ("markdown", "Markdown", ("md", "markdown"), "text"), ("txt", "Plain text", ("txt",), "text"), ("csv", "CSV", ("csv",), "text"),
    ("docx", "Word", ("docx",), "zip"), ("xlsx", "Excel", ("xlsx",), "zip"), ("pptx", "PowerPoint", ("pptx",), "zip"),
    ("odt", "OpenDocument text", ("odt",), "zip"), ("ods", "OpenDocument sheet", ("ods",), "zip"), ("odp", "OpenDocument slides", ("odp",), "zip"),
    ("doc", "Word 97", ("doc",), "ole"), ("xls", "Excel 97", ("xls",), "ole"), ("ppt", "PowerPoint 97", ("ppt",), "ole"), ("rtf", "RTF", ("rtf",), "rtf"),
    ("ps", "PostScript", ("ps",), "postscript"), ("eps", "Encapsulated PostScript", ("eps",), "postscript"), ("heic", "HEIC", ("heic", "heif"), "heif"),
    ("html", "HTML", ("html", "htm", "xhtml"), "html"), ("svg", "SVG", ("svg",), "svg"), ("mhtml", "MHTML", ("mhtml", "mht"), "mhtml"), ("eml", "E-mail", ("eml",), "email"),
)

#: Caps of an import.
INPUT_BYTES, TEXT_BYTES, HEAD_BYTES = 200 << 20, 20 << 20, 8 << 10
ARCHIVE_MEMBERS, EXPANDED_BYTES, RATIO, RATIO_FROM = 2000, 1 << 30, 200, 64 << 20
TEXT_LINES, CSV_ROWS, CSV_CELLS, CSV_COLUMNS, CSV_CHUNK, LINE_WIDTH = 40_000, 10_000, 200_000, 24, 4000, 90

#: Family and the hexadecimal bytes that begin it, in order.
MAGIC = (
    ("raster", ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "49492A00", "4D4D002A", "424D")),
    ("zip", ("504B0304",)), ("ole", ("D0CF11E0A1B11AE1",)), ("rtf", ("7B5C727466",)), ("postscript", ("2521", "C5D0D3C6")),
)


def format_table(spark: SparkSession) -> DataFrame:
    """The registry, a row an extension: small and fixed, so it may be broadcast."""
    rows = [(k, label, e, family) for k, label, extensions, family in FORMATS for e in extensions]
    return spark.createDataFrame(rows, "format string, label string, extension string, family string")


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.?([A-Za-z0-9]+)$", 1))


def sniff_family(head: Column) -> Column:
    """The first family that fits the first bytes; none fits: null."""
    hex_, text = F.hex(F.substring(head, 1, HEAD_BYTES)), F.lower(F.decode(F.substring(head, 1, HEAD_BYTES), "ISO-8859-1"))
    starts = lambda prefix: F.startswith(hex_, F.lit(prefix))
    webp = starts("52494646") & (F.substring(hex_, 17, 8) == "57454250")
    chain = None
    for family, prefixes in MAGIC:
        hit = reduce(lambda a, b: a | b, map(starts, prefixes))
        hit = hit | webp if family == "raster" else hit
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    bare = F.regexp_replace(text, r"^(?:ï»¿)?[\x{9}-\x{D}\x{20}]*", "")
    heif = (F.substring(hex_, 9, 8) == "66747970") & F.substring(hex_, 17, 8).isin("68656963", "68656978", "6D696631", "68657663")
    mhtml = bare.rlike(r"^(?:[!-9;-~]+:[^\n]*\n(?:[ \t][^\n]*\n)*)*mime-version:") & F.contains(text, F.lit("multipart/related"))
    email = bare.rlike(r"^(?:from |(?:from|to|subject|date|received|return-path|message-id|delivered-to):)[^\n]*\r?\n(?:[ \t][^\n]*\n)*[a-z-]+:")
    svg = bare.rlike(r"^(?:<\?xml[^>]*>[\s]*)?(?:<!--[^>]*-->[\s]*)*(?:<!doctype svg[^>]*>[\s]*)?<svg[\s/>]")
    html = bare.rlike(r"^(?:<!--[^>]*-->[\s]*)*(?:<!doctype html|<html|<head|<body|<title|<meta|<p[\s>]|<h[1-6][\s>]|<div)")
    return chain.when(heif, "heif").when(mhtml, "mhtml").when(email, "email").when(svg, "svg").when(html, "html")


def looks_like_text(head: Column) -> Column:
    """A UTF-16 mark is text; otherwise text has no NUL byte."""
    hex_ = F.hex(F.substring(head, 1, HEAD_BYTES))
    nul = hex_.rlike("^(?:..)*?00")
    return hex_.rlike("^(?:FFFE|FEFF)") | ~nul


def classify(head: Column, name: Column) -> Column:
    """struct(format, refusal): exactly one is set."""
    family, ext = sniff_family(head), extension_of(name)
    by_ext = F.create_map(*(F.lit(x) for k, _, extensions, _ in FORMATS for e in extensions for x in (e, k)))
    family_of = F.create_map(*(F.lit(x) for k, _, _, fam in FORMATS for x in (k, fam)))
    named = F.element_at(by_ext, ext)
    named_family = F.element_at(family_of, named)
    hex_ = F.hex(F.substring(head, 1, 16))
    raster = F.when(F.startswith(hex_, F.lit("89504E47")), "png").when(F.startswith(hex_, F.lit("FFD8FF")), "jpeg").when(F.startswith(hex_, F.lit("47494638")), "gif").when(F.startswith(hex_, F.lit("424D")), "bmp").when(F.startswith(hex_, F.lit("52494646")), "webp").otherwise("tiff")
    single = F.create_map(*(F.lit(x) for x in ("heif", "heic", "mhtml", "mhtml", "email", "eml", "svg", "svg", "html", "html", "rtf", "rtf")))
    text = looks_like_text(head)
    found = (
        F.when(family == "raster", raster).when(family == "heif", F.lit("heic"))
        .when(family.isin("zip", "ole", "postscript") & (named_family == family), named)
        .when(family.isin("html", "svg", "email", "mhtml") & (named_family == "text"), named)
        .when(family.isin("mhtml", "email", "svg", "html", "rtf"), F.element_at(single, family))
        .when(family.isNull() & text & (named_family == "text"), named)
    )
    why = F.when(found.isNotNull(), F.lit(None)).when(family.isNull() & ~text, "unknown bytes").when(family.isNull() & named.isNull(), "unknown name").when(family.isNull(), "name says otherwise").when(named.isNull(), "unknown package").otherwise("name says otherwise")
    return F.struct(found.alias("format"), why.alias("refusal"))


def cap_refusal(size: Column, is_text: Column, lines: Column, rows: Column, columns: Column) -> Column:
    """The first cap that refuses, or null."""
    return (
        F.when(size > INPUT_BYTES, "input too large").when(is_text & (size > TEXT_BYTES), "text too large").when(is_text & (lines > TEXT_LINES), "too many lines")
        .when(rows > CSV_ROWS, "too many rows").when(columns > CSV_COLUMNS, "too many columns").when(rows * columns > CSV_CELLS, "too many cells")
    )


def decode_text(content: Column) -> Column:
    """By byte-order mark; else as UTF-8 if it is; else as Windows-1252."""
    hex_ = F.hex(F.substring(content, 1, 3))
    rest = lambda k: F.substring(content, k, 2**31 - 1)
    utf8 = F.decode(content, "UTF-8")
    cp1252 = F.translate(F.decode(content, "ISO-8859-1"), "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f", "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")
    return (
        F.when(hex_ == "EFBBBF", F.decode(rest(4), "UTF-8")).when(F.startswith(hex_, F.lit("FFFE")), F.decode(rest(3), "UTF-16LE")).when(F.startswith(hex_, F.lit("FEFF")), F.decode(rest(3), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(cp1252)
    )


def text_block(text: Column) -> Column:
    """struct(rows, fence, body): line ends made LF, closing ones dropped, laid-out rows
    estimated at 90 characters, and a fence longer than any run of backticks."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n+$", "")
    lines = F.split(body, "\n")
    rows = F.aggregate(lines, F.lit(0).cast("long"), lambda acc, s: acc + F.greatest(F.lit(1), F.ceil(F.length(s) / LINE_WIDTH)))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("(`+)"), 1), lambda t: F.length(t))), F.lit(0))
    return F.struct(rows.alias("rows"), F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1)).alias("fence"), body.alias("body"))


def delimiter(text: Column) -> Column:
    """Of the first 20 lines, the first that has a comma, semicolon or tab outside
    quotes decides by the most frequent; a comma wins a tie, then a semicolon."""
    lines = F.transform(F.slice(F.split(text, "\r?\n"), 1, 20), lambda s: F.regexp_replace(s, '"[^"]*("|$)', ""))
    counts = F.transform(lines, lambda s: F.struct(F.regexp_count(s, F.lit(",")).alias("c"), F.regexp_count(s, F.lit(";")).alias("s"), F.regexp_count(s, F.lit("\t")).alias("t")))
    first = F.get(F.filter(counts, lambda x: x["c"] + x["s"] + x["t"] > 0), F.lit(0))
    chosen = lambda f, best: F.when(f.isNull() | (f["c"] == best), ",").when(f["s"] == best, ";").otherwise("\t")
    return once(first, lambda f: once(F.greatest(f["c"], f["s"], f["t"]), lambda best: chosen(f, best)))


def padded_csv(text: Column, sep: Column) -> Column:
    """Rows of unquoted cells, padded to the widest; the first is the header."""
    rows = F.transform(F.split(F.regexp_replace(text, "\n+$", ""), "\r?\n"), lambda s: F.split(s, F.concat(F.lit("["), sep, F.lit("]"))))
    width = lambda rs: F.array_max(F.transform(rs, lambda r: F.size(r)))
    padded = lambda rs, w: F.transform(rs, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))))
    return once(rows, lambda rs: once(width(rs), lambda w: padded(rs, w)))


def chunked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """chunk: 4,000 body rows to a table, each with the header repeated."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("chunk", F.floor((rn - 1) / CSV_CHUNK).cast("int"))
