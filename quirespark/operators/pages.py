"""Page arithmetic: selection, order, splitting, numbering, imposition and contents.

Pages are rows (doc, page, ...), numbered from 1. Operators renumber by windows
within a document, never over all of them, except where files follow each other."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERM = re.compile(r"(?P<not>[!n])?(?:(?P<word>even|odd)|(?P<a>l|l-\d+|\d+)(?:(?P<dash>-)(?P<b>l|l-\d+|\d+)?)?|-(?P<upto>\d+))$")


def parse_selection(terms: list[str]) -> list[dict]:
    """The grammar 5, 2-9, 3-, -4, l, l-3, even, odd, and !x or nx for exclusion."""
    out = []
    for term in terms:
        m = TERM.match(term.strip())
        if not m:
            raise ValueError(f"not a page selection: {term}")
        end = lambda s: {"last": int(s[2:] or 0) if s != "l" else 0} if s.startswith("l") else {"page": int(s)}
        if m["word"]:
            lo, hi = {"page": 1}, {"last": 0}
        elif m["upto"]:
            lo, hi = {"page": 1}, {"page": int(m["upto"])}
        else:
            lo = end(m["a"])
            hi = (end(m["b"]) if m["b"] else {"last": 0}) if m["dash"] else lo
        if lo.get("page") == 0 or hi.get("page") == 0:
            raise ValueError("there is no page 0")
        out.append({"not": bool(m["not"]), "parity": m["word"], "lo": lo, "hi": hi, "range": bool(m["dash"] or m["upto"] or m["word"])})
    return out


def selected(pages: DataFrame, terms: list[str], strict: bool = True) -> DataFrame:
    """Pages that a selection names, per document. No terms: all. A range is clipped at
    the end; a single page that does not exist refuses, as does a net-empty selection."""
    if not terms:
        return pages
    total = F.max("page").over(Window.partitionBy("doc_id"))
    at = lambda e: F.col("_n") - e["last"] if "last" in e else F.lit(e["page"])
    parsed = parse_selection(terms)
    take, drop = F.lit(all(t["not"] for t in parsed)), F.lit(False)
    bad = F.lit(False)
    for t in parsed:
        hit = F.col("page").between(at(t["lo"]), at(t["hi"]))
        if t["parity"]:
            hit = hit & (F.col("page") % 2 == (0 if t["parity"] == "even" else 1))
        if not t["range"]:
            bad = bad | (at(t["lo"]) > F.col("_n")) | (at(t["lo"]) < 1)
        take, drop = (take, drop | hit) if t["not"] else (take | hit, drop)
    out, wanted = pages.withColumn("_n", total), take & ~drop
    if strict:
        refusal = F.raise_error(F.lit("the selection names a page that does not exist")).cast("boolean")
        return out.where(F.when(bad, refusal).otherwise(wanted)).drop("_n")
    return out.where(~bad & wanted).drop("_n")


def renumbered(pages: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*(order or ("page",)))
    return pages.withColumn("page", F.row_number().over(w))


def kept_in_order(pages: DataFrame, wanted: list[int]) -> DataFrame:
    """Selects and reorders: the list's order is the new order; a page may repeat."""
    order = F.posexplode(F.array(*map(F.lit, wanted))).alias("_pos", "_page")
    listed = pages.sparkSession.range(1).select(order)
    both = pages.join(F.broadcast(listed), F.col("page") == F.col("_page"))
    return renumbered(both.withColumn("source_page", F.col("page")), "_pos").drop("_pos", "_page")


def removed(pages: DataFrame, gone: list[int]) -> DataFrame:
    return renumbered(pages.withColumn("source_page", F.col("page")).where(~F.col("page").isin(gone)), "source_page")


def duplicated(pages: DataFrame, which: Column) -> DataFrame:
    """Each page that ``which`` names gets a copy directly after it."""
    copies = F.explode(F.when(which, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return renumbered(pages.withColumn("source_page", F.col("page")).select("*", copies), "source_page", "_copy")


def inserted_blank(pages: DataFrame, at: int, after: bool = True) -> DataFrame:
    blank = pages.where(F.col("page") == at).withColumn("_side", F.lit(1 if after else -1))
    blank = blank.select(*(F.col(c) if c in ("doc_id", "page", "_side") else F.lit(None).cast(t).alias(c) for c, t in blank.dtypes)).withColumn("source_page", F.lit(None).cast("int"))
    own = pages.withColumn("_side", F.lit(0)).withColumn("source_page", F.col("page"))
    return renumbered(own.unionByName(blank), "page", "_side").drop("_side")


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second document's pages follow the first's of the same id."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    return renumbered(both.withColumn("source_page", F.col("page")), "_part", "source_page")


def rotated(rotate: Column, degrees: int) -> Column:
    if degrees % 90:
        raise ValueError("a page turns by multiples of 90 degrees")
    return F.pmod(rotate + degrees, F.lit(360))


def displayed_size(width: Column, height: Column, rotate: Column) -> Column:
    turned = rotate.isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def display_point(x: Column, y: Column, width: Column, height: Column, rotate: Column) -> Column:
    """Fractions of the displayed page from its top left."""
    fx, fy = x / width, y / height
    pick = lambda a, b, c, d: F.when(rotate == 90, a).when(rotate == 180, b).when(rotate == 270, c).otherwise(d)
    return F.struct(pick(fy, 1 - fx, 1 - fy, fx).alias("fx"), pick(fx, fy, 1 - fx, 1 - fy).alias("fy"))


def tiles(pages: DataFrame, cols: int, rows: int) -> DataFrame:
    """Each page cut into a grid, read left to right and top down."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1))).alias("tile")
    out = pages.select("*", cell)
    c, r = F.col("tile") % cols, F.floor(F.col("tile") / cols)
    w, h = F.col("width") / cols, F.col("height") / rows
    out = out.select("*", (c * w).alias("x0"), (F.col("height") - (r + 1) * h).alias("y0"), ((c + 1) * w).alias("x1"), (F.col("height") - r * h).alias("y1"))
    return renumbered(out.withColumn("source_page", F.col("page")), "source_page", "tile")


def n_up(pages: DataFrame, n: int) -> DataFrame:
    return pages.withColumn("sheet", F.floor((F.col("page") - 1) / n).cast("int") + 1).withColumn("slot", F.pmod(F.col("page") - 1, F.lit(n)))


def booklet(pages: DataFrame) -> DataFrame:
    """Saddle stitch: sheet, side and place of each page, after padding to a multiple of 4."""
    total = F.max("page").over(Window.partitionBy("doc_id"))
    padded = F.ceil(total / 4) * 4
    p, low = F.col("page"), F.col("page") <= padded / 2
    inner = F.when(low, p - 1).otherwise(padded - p)
    sheet = F.floor(inner / 2).cast("int") + 1
    side = F.when(inner % 2 == 0, "front").otherwise("back")
    # Fronts hold the high page on the left, backs the low page.
    left = F.when(side == "front", ~low).otherwise(low)
    return pages.withColumn("sheet", sheet).withColumn("side", side).withColumn("place", F.when(left, "left").otherwise("right"))


def split_every(pages: DataFrame, k: int) -> DataFrame:
    return pages.withColumn("part", F.floor((F.col("page") - 1) / k).cast("int") + 1)


def split_ranges(pages: DataFrame, ranges: str) -> DataFrame:
    """Each token is one file; ranges are not clipped: documents that lack an end are
    left to the caller as ``whole`` = false."""
    tokens = [t.partition("-") for t in re.split(r"[,\s]+", ranges.strip())]
    spans = [(k + 1, int(a), int(b or a)) for k, (a, _, b) in enumerate(tokens)]
    parts = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for k, a, b in spans))
    n = F.max("page").over(Window.partitionBy("doc_id"))
    out = pages.withColumn("_n", n).select("*", F.explode(F.filter(parts, lambda s: F.col("page").between(s["lo"], s["hi"]))).alias("_s"))
    return out.select(*pages.columns, F.col("_s.part").alias("part"), (F.col("_s.hi") <= F.col("_n")).alias("whole"))


def split_by_outline(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """A top-level entry starts a part; pages before the first are part 0."""
    starts = outline.where("level = 0").groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias("_starts"))
    part = F.size(F.filter(F.coalesce("_starts", F.array().cast("array<int>")), lambda s: s <= F.col("page")))
    return pages.join(starts, "doc_id", "left").withColumn("part", part).drop("_starts")


def continuous_numbers(files: DataFrame, start: int = 1, pad: int = 6, prefix: str = "") -> DataFrame:
    """Files (batch, file, pages) numbered on: first and last label and the total."""
    before = Window.partitionBy("batch").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("pages").over(before), F.lit(0)) + start
    last = F.sum("pages").over(Window.partitionBy("batch")) + start - 1
    label = lambda n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), pad, "0"))
    out = files.withColumn("first_number", offset).withColumn("of_number", last)
    return out.withColumn("first_label", label(F.col("first_number"))).withColumn("last_label", label(F.col("first_number") + F.col("pages") - 1))


def page_labels(pages: DataFrame, ranges: list[tuple[int, str, int, str]]) -> DataFrame:
    """Labels by the last range (page, style, start, prefix) at or before a page; pages
    before the first have none. Styles: D, R, r, A, a."""
    specs = F.array(*(F.struct(F.lit(p).alias("page"), F.lit(s).alias("style"), F.lit(n).alias("start"), F.lit(x).alias("prefix")) for p, s, n, x in sorted(ranges)))
    out = pages.withColumn("_r", F.try_element_at(F.filter(specs, lambda r: r["page"] <= F.col("page")), F.lit(-1)))
    n = F.col("page") - F.col("_r.page") + F.col("_r.start")
    letters = F.repeat(F.chr(F.lit(65) + (n - 1) % 26), F.floor((n - 1) / 26).cast("int") + 1)
    roman_ = roman(n)
    style = F.col("_r.style")
    number = F.when(style == "D", n.cast("string")).when(style == "R", roman_).when(style == "r", F.lower(roman_)).when(style == "A", letters).when(style == "a", F.lower(letters)).otherwise("")
    return out.withColumn("label", F.concat(F.col("_r.prefix"), number)).drop("_r")


def roman(n: Column) -> Column:
    """Roman numerals, digit by digit."""
    digit = lambda one, five, ten: ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for unit, names in ((100, digit("C", "D", "M")), (10, digit("X", "L", "C")), (1, digit("I", "V", "X"))):
        parts.append(F.element_at(F.array(*map(F.lit, names)), (F.floor(n / unit) % 10 + 1).cast("int")))
    return F.concat(*parts)


def clamped_outline(outline: DataFrame) -> DataFrame:
    """Outline (doc_id, pos, title, page, level from 0): empty titles go first; a level
    is at most one deeper than the one before, from 0; repeated titles get their page
    and then their number. The closed form of the fold: least of the level, the row
    number, and the running least of level minus row number, plus row number."""
    rows = outline.where(F.trim("title") != "")
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("_rn", F.row_number().over(w) - 1)
    running = F.min(F.col("level") - F.col("_rn")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", F.least("level", F.col("_rn") + running, "_rn"))
    same = Window.partitionBy("doc_id", "title")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(same))
    rows = rows.withColumn("_t", F.when(F.col("_n") > 1, F.concat("title", F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise(F.col("title")))
    k = F.row_number().over(Window.partitionBy("doc_id", "_t").orderBy("pos"))
    return rows.withColumn("title", F.when(k > 1, F.concat("_t", F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col("_t"))).drop("_rn", "_n", "_t")


def contents_pages(outline: DataFrame, depth: int, first_rows: int, rest_rows: int, after: int, most: int = 4000) -> DataFrame:
    """Contents rows up to a depth: the contents page that holds each, and the printed
    number after that many pages are inserted. Past ``most`` rows a document is refused."""
    rows = outline.where(F.col("level") < depth)
    w, doc = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id")
    rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(doc))
    rows = rows.withColumn("refused", F.col("_n") > most)
    rest = F.ceil(F.greatest(F.col("_n") - first_rows, F.lit(0)) / rest_rows).cast("int")
    page = F.when(F.col("rn") <= first_rows, F.lit(1)).otherwise(2 + F.floor((F.col("rn") - first_rows - 1) / rest_rows)).cast("int")
    printed = F.when(F.col("page") > after, F.col("page") + 1 + rest).otherwise(F.col("page"))
    return rows.withColumn("contents_page", page).withColumn("printed", printed.cast("int")).drop("_n")


def unique_names(rows: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """Repeats get a number, in order."""
    k = F.row_number().over(Window.partitionBy(key, name).orderBy(order))
    return rows.withColumn("unique_name", F.when(k > 1, F.concat(name, F.lit("-"), k.cast("string"))).otherwise(F.col(name)))


def merged_outline(outlines: DataFrame, files: DataFrame) -> DataFrame:
    """An entry for each file (batch, file, title, pages) at its first page, its own
    outline (batch, file, pos, title, page, level) one deeper, pages shifted by the
    pages of the files before."""
    before = Window.partitionBy("batch").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offset = files.withColumn("offset", F.coalesce(F.sum("pages").over(before), F.lit(0)))
    tops = offset.select("batch", "file", F.lit(-1).alias("pos"), "title", (F.col("offset") + 1).alias("page"), F.lit(0).alias("level"))
    own = outlines.join(offset.select("batch", "file", "offset"), ["batch", "file"])
    own = own.select("batch", "file", "pos", "title", (F.col("page") + F.col("offset")).alias("page"), (F.col("level") + 1).alias("level"))
    return tops.unionByName(own)


def cropped(pages: DataFrame, left, bottom, right, top) -> DataFrame:
    """Boxes (x0, y0, x1, y1) less what is cut from each side; ``ok`` says that something
    is left, else a caller must refuse. A side never grows."""
    cut = lambda c: F.greatest(c, F.lit(0.0))
    out = {"x0": F.col("x0") + cut(left), "y0": F.col("y0") + cut(bottom), "x1": F.col("x1") - cut(right), "y1": F.col("y1") - cut(top)}
    return pages.withColumns({**out, "ok": (out["x0"] < out["x1"]) & (out["y0"] < out["y1"])})
