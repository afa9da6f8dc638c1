"""Layout reconstruction over text runs (doc_id, page, seq, text, x0, y0, x1, y1, size)
and lines: sizes, headings, paragraphs, columns, lists, running heads, row folds.

What is a window or an aggregate is one; folds that compare with an anchor, not with
the neighbour, run per page in Arrow, and a page is bounded."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import SPACE, list_marker, round_half


def modal_page_size(pages: DataFrame) -> DataFrame:
    """Per document the most frequent portrait-canonical size in whole points; ties by
    area and then width."""
    w, h = F.round("width"), F.round("height")
    sizes = pages.groupBy("doc_id", F.least(w, h).alias("w"), F.greatest(w, h).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("doc_id").agg(F.max(F.struct("n", (F.col("w") * F.col("h")).alias("area"), "w", "h")).alias("b"))
    return best.select("doc_id", "b.w", "b.h", "b.n")


def body_size(runs: DataFrame) -> DataFrame:
    """Per document the size, to a half point, that carries most characters that are
    not white space; of equal counts the smaller."""
    n = F.length(F.regexp_replace("text", f"[{SPACE}]", ""))
    sums = runs.groupBy("doc_id", round_half(F.col("size")).alias("size")).agg(F.sum(n).alias("n"))
    return sums.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("size"))).alias("body"))


#: How much larger than the body a heading is, and its most lines.
HEADING_SCALE, HEADING_LINES = 1.15, 3


def headings(lines: DataFrame, body: DataFrame) -> DataFrame:
    """The first lines of pieces that are headings, with levels by falling size, at most
    6. A piece is a paragraph, cut before each of its lines that has a list marker; a
    heading has no marker, at most three lines, and at least 1.15 times the body size."""
    para = paragraphs(lines).withColumn("_marked", list_marker(F.col("text")) != "")
    w = Window.partitionBy("doc_id", "page", "para").orderBy(F.desc("y1"), "seq")
    para = para.withColumn("_first", F.row_number().over(w)).withColumn("_cut", (F.col("_marked") & (F.col("_first") > 1)).cast("int"))
    para = para.withColumn("piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = Window.partitionBy("doc_id", "page", "para", "piece")
    para = para.withColumn("piece_lines", F.count(F.lit(1)).over(each)).withColumn("_nth", F.row_number().over(each.orderBy(F.desc("y1"), "seq")))
    first = para.where("_nth = 1 AND NOT _marked").where(F.col("piece_lines") <= HEADING_LINES).withColumn("half", round_half(F.col("size")))
    sized = first.join(body, "doc_id").where((F.col("body") > 0) & (F.col("half") >= F.col("body") * HEADING_SCALE))
    level = F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("half"))), F.lit(6))
    return sized.withColumn("level", level)


def median(column: str):
    """Exact, the mean of two middles, 0 of nothing."""
    return F.coalesce(F.percentile(column, 0.5), F.lit(0.0))


def column_steps(lines: DataFrame) -> DataFrame:
    """Right edge, median step and number of steps per column (here: page)."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y1"), "seq")
    stepped = lines.withColumn("step", F.lag("y1").over(w) - F.col("y1"))
    return stepped.groupBy("doc_id", "page").agg(F.max("x1").alias("right_edge"), median("step").alias("typical"), F.count("step").alias("steps"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """para: a line starts one when its size changes by more than a tenth, its step is
    over 1.25 typical steps (of two or more), it is indented by more than half an em, or
    the line before stopped although this one's first word would have fitted."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y1"), "seq")
    lagged = lambda c: F.lag(c).over(w)
    first_word = F.length(F.regexp_extract("text", rf"^[{SPACE}]*([^{SPACE}]*)", 1)) * 6.0
    both = lines.join(column_steps(lines), ["doc_id", "page"])
    em = F.col("size")
    breaks = (
        (F.abs(em - lagged("size")) > 0.1 * em)
        | ((F.col("steps") >= 2) & (lagged("y1") - F.col("y1") > 1.25 * F.col("typical")))
        | (F.col("x0") - lagged("x0") > 0.5 * em)
        | (F.col("right_edge") - lagged("x1") > first_word + 0.5 * em)
    )
    marked = both.withColumn("breaks", F.when(lagged("seq").isNull(), True).otherwise(breaks))
    return marked.withColumn("para", F.sum(F.col("breaks").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def columns(segments: DataFrame) -> DataFrame:
    """col: islands of overlapping horizontal extents, left to right."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "x1", "seq")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("x0") >= reach).cast("int"), F.lit(1))
    return segments.withColumn("_new", new).withColumn("col", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gutters(lines: DataFrame, least: int = 3) -> DataFrame:
    """x, to a point, where at least so many lines begin with text to their left."""
    left = lines.groupBy("doc_id", "page").agg(F.min("x0").alias("left_edge"))
    inner = lines.join(left, ["doc_id", "page"]).where(F.col("x0") > F.col("left_edge"))
    return inner.groupBy("doc_id", "page", F.round("x0").alias("x")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def list_blocks(lines: DataFrame) -> DataFrame:
    """kind (item, text, blank), marker, list: consecutive items share a list; any other
    text ends it, a blank line does not."""
    marked = lines.withColumn("marker", list_marker(F.col("line")))
    kind = F.when(F.col("marker") != "", "item").when(F.col("line").rlike(f"^[{SPACE}]*$"), "blank").otherwise("text")
    marked = marked.withColumn("kind", kind)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((F.col("kind") == "text").cast("int")).over(w)
    marked = marked.withColumn("_run", run)
    ranked = F.dense_rank().over(Window.partitionBy("doc_id", "kind").orderBy("_run"))
    return marked.withColumn("list", F.when(F.col("kind") == "item", ranked).otherwise(0)).drop("_run")


def running_lines(lines: DataFrame) -> DataFrame:
    """Lines that repeat as first or last of at least three pages of a document."""
    w = Window.partitionBy("doc_id", "page")
    edge = lines.withColumn("_top", F.max("y1").over(w)).withColumn("_low", F.min("y1").over(w))
    edge = edge.where((F.col("y1") == F.col("_top")) | (F.col("y1") == F.col("_low")))
    shape = F.regexp_replace("text", "[0-9]+", "#")
    return edge.groupBy("doc_id", shape.alias("shape")).agg(F.countDistinct("page").alias("pages")).where("pages >= 3")


def table_kind(rows: int | None = None):
    """Column: whether a table is written cell by cell, or as a line per row because it
    has more than 63 columns or 50,000 slots. Columns: n_rows, n_cols."""
    return F.when((F.col("n_cols") > 63) | (F.col("n_rows").cast("long") * F.col("n_cols") > 50_000), "text").otherwise("table")


#: Rows of folded pages that go on together.
FOLDED_ROWS = 8192


def page_fold(runs: DataFrame, fold, schema: str) -> DataFrame:
    """Runs of one page at a time, in order, through a Python fold. Pages are bounded;
    rows are dealt by page and streamed, so no task holds more than one."""
    dealt = runs.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq")
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        types, out = arrow_types(schema), []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([f[n] for f in out], t) for n, t in zip(names, types)], names)
        rows = (dict(zip(b.schema.names, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, group in groupby(rows, key=lambda r: (r["doc_id"], r["page"])):
            out += fold(list(group))
            if len(out) >= FOLDED_ROWS:
                yield pack()
                out = []
        if out:
            yield pack()

    return dealt.mapInArrow(run, schema)


def column_fold(runs: DataFrame, fold, schema: str) -> DataFrame:
    """Like ``page_fold``, by columns: the fold gets whole pages as a table, with the number
    of each row's page in it, and gives arrays. A batch's last page waits for the next."""
    dealt = runs.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq")
    names, types = [part.split()[0] for part in schema.split(",")], arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in whole_pages(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fold(rows, number), types)], names)

    return dealt.mapInArrow(run, schema)


def whole_pages(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("doc_id", "page")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches cut at pages (or other ``keys``), with the number of each row's page; rows come page by page."""
    waits = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = page_numbers(batch, keys)
        last = int(np.searchsorted(number, number[-1]))
        if waits and (last or page_numbers(pa.Table.from_batches([waits[-1].slice(waits[-1].num_rows - 1), batch.slice(0, 1)]), keys)[-1]):
            whole = pa.Table.from_batches([*waits, batch.slice(0, last)])
            yield whole, page_numbers(whole, keys)
            waits = []
        elif last:
            whole = pa.Table.from_batches([batch.slice(0, last)])
            yield whole, page_numbers(whole, keys)
        waits.append(batch.slice(last))
    if waits:
        whole = pa.Table.from_batches(waits)
        yield whole, page_numbers(whole, keys)


def page_numbers(rows, keys: tuple[str, ...] = ("doc_id", "page")) -> np.ndarray:
    fresh = np.zeros(max(rows.num_rows - 1, 0), bool)
    keys = [rows.column(c) for c in keys]
    while keys:
        key = keys.pop()
        key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
        if pa.types.is_struct(key.type):
            keys += key.flatten()
        else:
            values = np.asarray(key)
            fresh |= values[1:] != values[:-1]
    return np.concatenate([[0], np.cumsum(fresh)])


def arrow_types(schema: str) -> list[pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return [known[part.split()[1]] for part in schema.split(",")]


def joined(x0: list, y0: list, x1: list, size: list, seq: list) -> list[tuple[int, float, list[tuple[int, bool]]]]:
    """Of a page's runs, left to right, each goes to the open line of nearest baseline
    within 0.3 em and a gap of at most 1.5 em, else begins one. Lines: the first run, the right end,
    and each run with whether a blank stands before it. Open lines are kept by strips of the
    page; one that ends too far left for the page's largest run is met by none to come."""
    em = max(size, default=0.0)
    high, far = 0.3 * em if em > 0 else 1.0, 1.5 * em
    lines, strips = [], {}
    for r, (x, y, own) in enumerate(zip(x0, y0, size)):
        strip, best, near = math.floor(y / high), None, 0.3 * own
        for k in (strip - 1, strip, strip + 1):
            if k not in strips:
                continue
            gone = False
            for ln in strips[k]:
                gap = x - ln[1]
                if gap > far:
                    gone = True
                elif abs(ln[3] - y) <= near and -0.5 * own <= gap <= 1.5 * own:
                    rank = (abs(ln[3] - y), seq[ln[0]], ln[4])
                    if best is None or rank < best[0]:
                        best = rank, ln
            if gone:
                strips[k] = [ln for ln in strips[k] if x - ln[1] <= far]
        if best:
            ln = best[1]
            ln[2].append((r, x - ln[1] > 0.15 * own))
            if x1[r] > ln[1]:
                ln[1] = x1[r]
        else:
            ln = [r, x1[r], [(r, False)], y, len(lines)]
            lines.append(ln)
            strips.setdefault(strip, []).append(ln)
    lines.sort(key=lambda ln: (-ln[3], x0[ln[0]], seq[ln[0]]))
    return [tuple(ln[:3]) for ln in lines]


def line_segments(rows: pa.Table, number: np.ndarray) -> tuple[list, ...]:
    """The lines of each page, for ``column_fold``."""
    rows = rows.take(np.lexsort((rows["seq"], rows["x0"], number)))
    text, x0, y0, x1, size, seq = (rows[c].to_pylist() for c in ("text", "x0", "y0", "x1", "size", "seq"))
    first, nth, texts, ends, many = [], [], [], [], []
    edges = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(number)]
    for a, b in zip(edges, edges[1:]):
        for k, (r, end, own) in enumerate(joined(x0[a:b], y0[a:b], x1[a:b], size[a:b], seq[a:b])):
            first.append(a + r)
            nth.append(k)
            texts.append("".join(" " + text[a + i] if blank else text[a + i] for i, blank in own))
            ends.append(end)
            many.append(len(own))
    of = lambda c: rows[c].take(pa.array(first, pa.int64())).combine_chunks()
    return of("doc_id"), of("page"), nth, texts, of("x0"), ends, of("y0"), many


SEGMENTS = "doc_id long, page int, seq int, text string, x0 double, x1 double, y0 double, runs int"


def row_places(heights: list[tuple[float, float]]) -> list[int]:
    """The row of each (y, size), y falling: the first row whose FIRST item is within
    max(6, 0.6 of the size). First items fall from row to row, so it is found by halving."""
    tops, out = [], []
    for y, size in heights:
        k = bisect.bisect_left(tops, True, key=lambda top: abs(top - y) <= max(6.0, 0.6 * size))
        if k == len(tops):
            tops.append(y)
        out.append(k)
    return out


def text_rows(group: list[dict]) -> list[dict]:
    """Items in falling y, each to the first row whose FIRST item is within
    max(6, 0.6 of its height)."""
    items = sorted(group, key=lambda r: (-r["y0"], r["x0"], r["seq"]))
    rows = row_places([(r["y0"], r["size"]) for r in items])
    return sorted(({"doc_id": r["doc_id"], "page": r["page"], "seq": r["seq"], "row": k} for r, k in zip(items, rows)), key=lambda r: r["row"])


def page_rows(rows: pa.Table, number: np.ndarray) -> tuple:
    """``text_rows`` of each page, for ``column_fold``. Items of one height and size share
    their row, so each height and size is looked up once."""
    y, size = np.asarray(rows["y0"]), np.asarray(rows["size"])
    order = np.lexsort((size, -y, number))
    n, y, size = number[order], y[order], size[order]
    fresh = np.concatenate([[True], (n[1:] != n[:-1]) | (y[1:] != y[:-1]) | (size[1:] != size[:-1])])
    at = np.flatnonzero(fresh)
    own, heights, found = n[at], list(zip(y[at].tolist(), size[at].tolist())), []
    edges = [*np.flatnonzero(np.diff(own, prepend=-1)).tolist(), len(own)]
    for a, b in zip(edges, edges[1:]):
        found += row_places(heights[a:b])
    out = np.empty(len(order), np.int32)
    out[order] = np.array(found, np.int32)[np.cumsum(fresh) - 1]
    return *(rows[c].combine_chunks() for c in ("doc_id", "page", "seq")), out


ROWS = "doc_id long, page int, seq int, row int"


def reading_order(runs: DataFrame) -> DataFrame:
    """place of each run of a page: by column from the left, then downwards."""
    w = Window.partitionBy("doc_id", "page").orderBy("col", F.desc("y1"), "x0", "seq")
    return columns(runs).withColumn("place", F.row_number().over(w))
