"""Form fields that a page's drawing suggests: cells between ruled lines, lines to write on,
white grounds, runs of underscores, small squares and boxes drawn as characters.

Coordinates are points, y grows downwards. Shapes are (doc_id, page, id, kind, x0, y0, x1,
y1): ``h`` and ``v`` rules, ``heavy`` bars, empty ``square``s, ``white`` grounds, ``shade``,
``print`` (with text) and ``widget``s. What of a shape matters is expressions over its row;
rows are dealt by page once, and what meets what is found over batches of whole pages in
NumPy, by the order of their edges and a bounded number of pairs at a time. What closes a
stretch of a line is found by a sweep: the page is cut at every end of a line, and in each
strip the next line below is the next in its order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quirespark.operators.layout import whole_pages

#: Fixed values, in points: tolerance of rules, least field, least of two blanks in a cell,
#: highest row without uprights, room above a bare line, squares, room for print.
TOL, LEAST_W, LEAST_H, GAP_W, ROW_H, ABOVE, SQUARE_MAX, SQUARE_MIN, LINE_H = 2.5, 14.0, 7.0, 24.0, 45.0, 15.0, 20.0, 5.0, 8.0
BOXES = "☐□❏❐❑❒▢◻◽▫"
EDGES = ("x0", "y0", "x1", "y1")
#: What matters on a page: ``word`` is print that is a label, the last two are drawn in print.
KINDS = ("word", "square", "h", "heavy", "v", "white", "shade", "widget", "underscores", "glyph")
#: What is proposed: kind and from.
FORMS = (("check", "square"), ("check", "cell"), ("text", "line"), ("text", "cell"), ("check", "ground"), ("text", "ground"), ("text", "underscores"), ("check", "glyph"))
#: Pairs that are compared at a time.
PAIRS = 1 << 18


def c(name: str) -> Column:
    return F.col(name)


# What matters, as expressions.


def drawn_in_text() -> Column:
    """Of a print, runs of four underscores or more, and boxes drawn as characters; a character's
    place is its share of its run's width."""
    pattern = f"_{{4,}}|[{BOXES}]"
    pieces = F.arrays_zip(F.split("text", pattern).alias("before"), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("mark"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,at:int,to:int>>").alias("marks"))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["before"])
        to = at + F.length(p["mark"])
        mark = F.struct(F.when(F.startswith(p["mark"], F.lit("_")), "underscores").otherwise("glyph").alias("kind"), at.alias("at"), to.alias("to"))
        return F.struct(F.coalesce(to, at).alias("at"), F.when(p["mark"].isNotNull(), F.concat(s["marks"], F.array(mark))).otherwise(s["marks"]).alias("marks"))

    at = lambda k: c("x0") + (c("x1") - c("x0")) * k / F.length("text")
    marks = F.transform(F.aggregate(pieces, start, step, lambda s: s["marks"]), lambda m: F.struct(m["kind"].alias("kind"), at(m["at"]).alias("x0"), c("y0"), at(m["to"]).alias("x1"), c("y1")))
    return F.when((c("kind") == "print") & c("text").rlike(pattern), marks)


def parts(shapes: DataFrame) -> DataFrame:
    """doc_id, page, id, kind (its place in ``KINDS``), x0, y0, x1, y1 of what matters."""
    label = ~c("text").rlike(r"^[\s\-–—/\\().,:;|_]*$") & ~c("text").rlike(f"^[{BOXES}]+$")
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    square = w.between(SQUARE_MIN, SQUARE_MAX) & h.between(SQUARE_MIN, SQUARE_MAX) & (F.abs(w - c("y1") + c("y0")) < 4)
    white = (w >= SQUARE_MIN) & h.between(SQUARE_MIN, ROW_H)
    known = F.when(c("kind") == "print", F.when(label, "word")).when(c("kind") == "square", F.when(square, "square")).when(c("kind") == "white", F.when(white, "white")).when(c("kind").isin("h", "heavy", "v", "shade", "widget"), c("kind"))
    own = F.struct(F.when((w + h).isNotNull(), known).alias("kind"), *EDGES)
    rows = shapes.withColumns({n: c(n).cast("double") for n in EDGES})
    rows = rows.select("doc_id", "page", "id", F.explode(F.concat(F.array(own), F.coalesce(drawn_in_text(), F.array()))).alias("s"))
    rows = rows.select("doc_id", "page", "id", F.array_position(F.array(*map(F.lit, KINDS)), c("s.kind")).cast("int").alias("kind"), *(c(f"s.{n}") for n in EDGES))
    return rows.where("kind > 0").withColumn("kind", c("kind") - 1)


def proposed(shapes: DataFrame) -> DataFrame:
    """doc_id, page, kind (text, check), from (cell, line, ground, underscores, square, glyph), x0, y0, x1, y1."""
    dealt = parts(shapes).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "id").drop("id")
    keys = [shapes.schema[n] for n in ("doc_id", "page")]
    names = [k.name for k in keys] + ["kind", "from", *EDGES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, froms = map(pa.array, zip(*FORMS))
        for rows, number in whole_pages(batches):
            first = np.flatnonzero(np.diff(number, prepend=-1))
            boxes = Boxes(number, *(rows.column(n).to_numpy() for n in EDGES))
            form, found = on_pages(rows.column("kind").to_numpy(), boxes)
            at, form = pa.array(first[found.page]), pa.array(form)
            own = [rows.column(k.name).combine_chunks().take(at) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, kinds.take(form), froms.take(form), *(pa.array(v, from_pandas=True) for v in found[1:])], names)

    return dealt.mapInArrow(run, StructType([*keys, StructField("kind", StringType()), StructField("from", StringType()), *(StructField(n, DoubleType()) for n in EDGES)]))


# Boxes of whole pages.


class Boxes(NamedTuple):
    """Boxes by column, with the number of their page."""

    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def at(self, places: np.ndarray) -> Boxes:
        return Boxes(*(v[places] for v in self))

    def inner(self) -> Boxes:
        return Boxes(self.page, self.x0 + 1, self.y0 + 1, self.x1 - 1, self.y1 - 1)


def joined(*boxes: Boxes) -> Boxes:
    return Boxes(*map(np.concatenate, zip(*boxes)))


def over(a: Boxes, b: Boxes) -> np.ndarray:
    """Whether two boxes share some area."""
    return (a.x1 > b.x0) & (a.x0 < b.x1) & (a.y1 > b.y0) & (a.y0 < b.y1)


def holds_middle(a: Boxes, b: Boxes) -> np.ndarray:
    """Whether the middle of box b lies in box a."""
    x, y = (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2
    return (a.x0 <= x) & (x <= a.x1) & (a.y0 <= y) & (y <= a.y1)


def spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """So many numbers on from each start."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


def meeting(a: Boxes, b: Boxes, test: Callable[[Boxes, Boxes], np.ndarray], across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of boxes of one page that pass the test, of those whose heights (``across``: widths) meet:
    b's box begins within a's, or a's after b's and within it. ``PAIRS`` are compared at a time,
    all those of one box of a together."""
    ends = lambda r: (r.x0, r.x1) if across else (r.y0, r.y1)
    (a0, a1), (b0, b1) = ((np.minimum(*e), np.maximum(*e)) for e in map(ends, (a, b)))
    if not len(a0) or not len(b0):
        return
    by_a, by_b, values = np.lexsort((a0, a.page)), np.lexsort((b0, b.page)), np.unique(np.concatenate([a0, b0]))
    key = lambda page, v, side, by: (page * (len(values) + 1) + np.searchsorted(values, v, side))[by]
    key_a, key_b = key(a.page, a0, "left", by_a), key(b.page, b0, "left", by_b)
    from_b, to_b = np.searchsorted(key_b, key_a), np.searchsorted(key_b, key(a.page, a1, "right", by_a))
    from_a, to_a = np.searchsorted(key_a, key_b, "right"), np.searchsorted(key_a, key(b.page, b1, "right", by_b))
    n = len(a0) + 1
    ended = np.cumsum(to_b - from_b + np.cumsum(np.bincount(from_a, minlength=n) - np.bincount(to_a, minlength=n))[:-1])
    at = 0
    while at < len(a0):
        upto = max(at + 1, int(np.searchsorted(ended, (ended[at - 1] if at else 0) + PAIRS, "right")))
        within = (to_b - from_b)[at:upto]
        low = np.maximum(from_a, at)
        after = np.maximum(np.minimum(to_a, upto) - low, 0)
        i = by_a[np.concatenate([np.repeat(np.arange(at, upto), within), spread(low, after)])]
        j = by_b[np.concatenate([spread(from_b[at:upto], within), np.repeat(np.arange(len(b0)), after)])]
        at = upto
        keep = test(a.at(i), b.at(j))
        yield i[keep], j[keep]


def pairs(a: Boxes, b: Boxes, test: Callable[[Boxes, Boxes], np.ndarray], across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, int),) * 2, *meeting(a, b, test, across)]
    i, j = map(np.concatenate, zip(*found))
    return i, j


def meets(a: Boxes, b: Boxes, test: Callable[[Boxes, Boxes], np.ndarray]) -> np.ndarray:
    """Whether each box of a meets one of b."""
    out = np.zeros(len(a.page), bool)
    for i, _ in meeting(a, b, test):
        out[i] = True
    return out


def narrowed(held: tuple[np.ndarray, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of those of the left that are kept, by their places among these."""
    own = keep[held[0]]
    return (np.cumsum(keep) - 1)[held[0][own]], held[1][own]


# Fields.


def blanks(rooms: Boxes, solids: Boxes, held: tuple[np.ndarray, np.ndarray], bare: bool) -> tuple[np.ndarray, Boxes]:
    """The parts of rooms in which one could type, and whose they are: under a label printed in a
    room's top (not over a bare line), and beside what shares its band: every gap of 24
    points, or else the widest that is a field. ``held``: rooms and solids that overlap."""
    i, n, t = held[0], len(rooms.page), solids.at(held[1])
    if not bare:
        upper = (t.y0 + t.y1) / 2 < (rooms.y0 + 0.6 * (rooms.y1 - rooms.y0))[i]
        below = np.full(n, -np.inf)
        np.maximum.at(below, i[upper], t.y1[upper] - 1)
        rooms = rooms._replace(y0=np.where((below > -np.inf) & (rooms.y1 - below >= LINE_H), below, rooms.y0))
    r = rooms.at(i)
    block = over(t, r) & (np.minimum(t.y1, r.y1) - np.maximum(t.y0, r.y0) > 0.3 * (t.y1 - t.y0))
    # From a room's left edge over what blocks it to its right one.
    every, no = np.arange(n), np.full(n, np.inf)
    room, start, end = np.concatenate([every, i[block], every]), np.concatenate([-no, t.x0[block] - 1.5, no]), np.concatenate([rooms.x0, t.x1[block] + 1.5, rooms.x1])
    by = np.lexsort((end, start, room))
    room, start, end = room[by], start[by], end[by]
    values, rank = np.unique(end, return_inverse=True)
    reached = values[np.maximum.accumulate(room * len(values) + rank) % len(values)] if n else end
    to = np.minimum(start, rooms.x1[room])
    gap = np.flatnonzero((room[1:] == room[:-1]) & (to[1:] > reached[:-1]))
    own, at, to = room[gap], reached[gap], to[gap + 1]
    width, most, has = to - at, np.full(n, -np.inf), np.zeros(n, bool)
    np.maximum.at(most, own, width)
    has[own[width >= GAP_W]] = True
    widest = np.flatnonzero(~has[own] & (width >= LEAST_W) & (width == most[own]))
    keep = np.sort(np.concatenate([np.flatnonzero(width >= GAP_W), widest[np.unique(own[widest], return_index=True)[1]]]))
    keep = keep[(rooms.y1 - rooms.y0 >= LEAST_H)[own[keep]]]
    own = own[keep]
    return own, rooms.at(own)._replace(x0=at[keep], x1=to[keep])


def merged(top: np.ndarray, bottom: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring strips between the same two lines are one stretch."""
    by = np.lexsort((first, bottom, top))
    top, bottom, first, last = (v[by] for v in (top, bottom, first, last))
    new = np.ones(len(by), bool)
    new[1:] = (top[1:] != top[:-1]) | (bottom[1:] != bottom[:-1]) | (first[1:] != last[:-1] + 1)
    ends = np.append(new[1:], True)[: len(by)]
    return top[new], bottom[new], first[new], last[ends]


def row_stretches(lines: Boxes) -> tuple[np.ndarray, np.ndarray, Boxes]:
    """Top and bottom (places of lines) and box: each stretch of a line and the line that closes
    it, seven points or more below; one nearer closes it without a row."""
    page, x = np.concatenate([lines.page, lines.page]), np.concatenate([lines.x0, lines.x1])
    by = np.lexsort((x, page))
    page, x = page[by], x[by]
    strip = np.flatnonzero((page[1:] == page[:-1]) & (x[1:] != x[:-1]))
    strips = Boxes(page[strip], x[strip], x[strip], x[strip + 1], x[strip])
    found = [(np.zeros(0, int),) * 4]
    for s, line in meeting(strips, lines, lambda a, b: (b.x0 <= a.x0) & (a.x1 <= b.x1), across=True):
        by = np.lexsort((line, lines.y0[line], s))
        s, line = s[by], line[by]
        closed = np.flatnonzero((s[1:] == s[:-1]) & (lines.y0[line[1:]] > lines.y0[line[:-1]] + LEAST_H))
        found.append(merged(line[closed], line[closed + 1], s[closed], s[closed]))
    top, bottom, first, last = merged(*map(np.concatenate, zip(*found)))
    keep = strips.x1[last] - strips.x0[first] > LEAST_W
    top, bottom, first, last = (v[keep] for v in (top, bottom, first, last))
    return top, bottom, Boxes(lines.page[top], strips.x0[first], lines.y0[top], strips.x1[last], lines.y0[bottom])


def row_cells(lines: Boxes, ups: Boxes) -> tuple[Boxes, np.ndarray, np.ndarray]:
    """The cells of rows, whether their row has uprights, and whether each line is an edge of a row."""
    top, bottom, rows = row_stretches(lines)
    wide = rows._replace(x0=rows.x0 - TOL, x1=rows.x1 + TOL)
    joins = lambda a, b: (b.x0 > a.x0) & (b.x0 < a.x1) & (b.y0 <= a.y0 + TOL) & (b.y1 >= a.y1 - TOL)
    i, j = pairs(wide, ups, joins, across=True)
    upright = np.bincount(i, minlength=len(top)) > 0
    t, b = lines.at(top), lines.at(bottom)
    one_width = (np.abs(b.x0 - t.x0) <= TOL) & (np.abs(b.x1 - t.x1) <= TOL) & (rows.x0 == np.maximum(t.x0, b.x0)) & (rows.x1 == np.minimum(t.x1, b.x1))
    keep = upright | (one_width & (rows.y1 - rows.y0 <= ROW_H))
    used = np.zeros(len(lines.page), bool)
    used[top[keep]] = used[bottom[keep]] = True
    x, own = ups.x0[j], rows.at(i)
    inside = (x > own.x0 + TOL) & (x < own.x1 - TOL)
    every = np.flatnonzero(keep)
    row, x = np.concatenate([every, i[inside], every]), np.concatenate([rows.x0[every], x[inside], rows.x1[every]])
    by = np.lexsort((x, row))
    row, x = row[by], x[by]
    cell = np.flatnonzero(row[1:] == row[:-1])
    cells = rows.at(row[cell])._replace(x0=x[cell], x1=x[cell + 1]).inner()
    large = (cells.x1 - cells.x0 >= SQUARE_MIN) & (cells.y1 - cells.y0 >= SQUARE_MIN)
    return cells.at(large), upright[row[cell]][large], used


def on_pages(kind: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, Boxes]:
    """Fields of whole pages, whose shapes come by id: their forms (places in ``FORMS``) and boxes."""
    of = lambda *names: np.flatnonzero(np.isin(kind, [KINDS.index(n) for n in names]))
    get = lambda *names: boxes.at(of(*names))
    words, squares, shades, widgets = map(get, ("word", "square", "shade", "widget"))

    def free(form: np.ndarray, fields: Boxes, ground: bool = False) -> tuple[np.ndarray, Boxes]:
        """Fields on no widget and, but for grounds, in no shaded panel."""
        bad = meets(fields, widgets, lambda f, w: holds_middle(w, f) | holds_middle(f, w))
        if not ground:
            bad |= meets(fields, shades, lambda f, s: holds_middle(s, f))
        return form[~bad], fields.at(~bad)

    def all_of(*found: tuple[str, str, Boxes]) -> tuple[np.ndarray, Boxes]:
        return np.repeat([FORMS.index(f[:2]) for f in found], [len(f[2].page) for f in found]), joined(*(f[2] for f in found))

    squares = squares.at(~meets(squares, words, over))
    solids = joined(words, squares)
    lines, ups = get("h", "heavy"), get("v")
    middle = (lines.y0 + lines.y1) / 2
    lines = lines._replace(y0=middle, y1=middle)
    up = (ups.x0 + ups.x1) / 2
    cells, upright, used = row_cells(lines, ups._replace(x0=up, x1=up))
    held = pairs(cells, solids, over)
    n = len(cells.page)
    empty, ticked = np.bincount(held[0], minlength=n) == 0, np.bincount(held[0][held[1] >= len(words.page)], minlength=n) > 0
    small = (cells.x1 - cells.x0 <= SQUARE_MAX) & (cells.y1 - cells.y0 <= SQUARE_MAX)
    plain = ~small & ~ticked & ~upright & empty
    typed = ~small & ~ticked & ~plain
    room = cells.at(plain)
    room = room._replace(y0=np.maximum(room.y0, room.y1 - ABOVE))
    found = free(*all_of(("check", "square", squares), ("check", "cell", cells.at(small & empty)), ("text", "line", room), ("text", "cell", blanks(cells.at(typed), solids, narrowed(held, typed), False)[1])))
    # A line that is no row's edge, with nothing proposed above it.
    bare = lines.at((kind[of("h", "heavy")] == KINDS.index("h")) & ~used)
    bare = bare._replace(y0=bare.y0 - ABOVE, y1=bare.y1 - 0.5)
    bare = bare.at(~meets(bare, found[1], over))
    written = free(*all_of(("text", "line", blanks(bare, solids, pairs(bare, solids, over), True)[1])))
    forms, fields = [found[0], written[0]], [found[1], written[1]]
    for form, more in (grounds(get("white"), words, solids, joined(*fields), free), free(*all_of(("text", "underscores", get("underscores")), ("check", "glyph", get("glyph"))))):
        forms.append(form)
        fields.append(more)
    return np.concatenate(forms), joined(*fields)


def grounds(whites: Boxes, words: Boxes, solids: Boxes, fields: Boxes, free) -> tuple[np.ndarray, Boxes]:
    """Fields of white grounds where nothing is proposed yet, the smallest first: one is taken when
    a smaller one, not taken itself, has a field in it."""
    g = whites.at(~meets(whites.inner(), fields, over))
    w, h = g.x1 - g.x0, g.y1 - g.y0
    tick = (w <= SQUARE_MAX) & (h <= SQUARE_MAX) & (np.abs(w - h) < 4)
    ticks, wide = np.flatnonzero(tick & ~meets(g.inner(), words, over)), np.flatnonzero(~tick)
    typed, rooms = blanks(g.at(wide), solids, pairs(g.at(wide), solids, over), False)
    own = np.concatenate([ticks, wide[typed]])
    # Fields that a widget bars take nothing from others.
    place, rows = free(np.arange(len(own)), joined(g.at(ticks), rooms), ground=True)
    own = own[place]
    order = np.empty(len(w), int)
    order[np.argsort(w * h, kind="stable")] = np.arange(len(w))
    smaller = lambda i, j: order[own[j]] < order[i]
    before = [(i[k], own[j[k]]) for i, j in meeting(g.inner(), rows, over) for k in [smaller(i, j)]]
    above, below = map(np.concatenate, zip((np.zeros(0, int),) * 2, *before))
    by = np.argsort(order[above], kind="stable")
    stays = [True] * len(w)
    for a, b in zip(above[by].tolist(), below[by].tolist()):
        if stays[b]:
            stays[a] = False
    keep = np.array(stays, bool)[own]
    forms = np.where(tick[own], FORMS.index(("check", "ground")), FORMS.index(("text", "ground")))
    return forms[keep], rows.at(keep)
