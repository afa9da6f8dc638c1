"""From text runs to a page's layout: lines, columns, rows of cells, tables, paragraphs.

Runs are (doc_id, page, seq, text, x0, y0, x1, y1, size), y0 the baseline, y growing
upwards. Pages are dealt to tasks once, or come dealt, and a batch of whole pages is laid out
at a time: runs that continue each other (``chains``) and what parts them in NumPy, for all its
pages at once; what stands where among the lines page by page. Nothing is dealt again and no
pair of runs leaves its task."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quirespark.functions.text import SPACE
from quirespark.operators.chains import heads, ranged
from quirespark.operators.layout import whole_pages
from quirespark.operators.rounds import cut

#: Fixed values, in ems: runs on one baseline, the widest gap that joins, what parts words;
#: marks that are set higher: how small, how high, how near; a rule beside text.
BASELINE, JOIN_GAP, WORD_GAP = 0.3, 1.5, 0.15
RAISED_SIZE, RAISED_HIGH, RAISED_GAP, RAISED_OVERLAP = 0.8, 0.5, 0.25, 1.0
OPENING_GAP, OPENING_CHARS = 0.15, 3
BESIDE_SIZES, BESIDE_GLYPHS = 3.0, "_‐‑‒–—―\\-"
#: Gutters: the least gap, how exact an edge is, how many lines, how near beside, how clear, how many words before, leader dots.
GUTTER_GAP, GUTTER_EDGE, GUTTER_LINES, GUTTER_BESIDE, GUTTER_CLEAR, GUTTER_WORDS, LEADER_DOTS = 0.6, 0.5, 3, 0.5, 2.5, 2, 4
RUNNING_LINES, CELL_ROWS, TABLE_FILL = 2, 3, 4

#: The characters of ``SPACE``.
SPACES = "".join(chr(c) for low, high in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", SPACE) for c in range(int(low, 16), int(high or low, 16) + 1))
WORD = re.compile(f"[^{SPACES}]+")
NUMBERS = (("x0", float), ("y0", float), ("x1", float), ("size", float), ("seq", np.int64), ("_rule", bool), ("_short", bool))


def dealt_by_page(rows: DataFrame) -> DataFrame:
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")


def leads(text: str) -> bool:
    """Whether a text ends in dots that lead the eye on: four, an ellipsis counting three."""
    tail = text[len(text.rstrip(SPACES + ".·…")) :]
    return sum(3 if c == "…" else 1 for c in tail if c in ".·…") >= LEADER_DOTS


def is_rule(text: Column) -> Column:
    return text.rlike(f"^[{SPACE}]*[{BESIDE_GLYPHS}]+[{SPACE}]*$")


def is_white(text: Column) -> Column:
    return text.rlike(f"^[{SPACE}]*$")


def marked(runs: DataFrame) -> DataFrame:
    """Runs with what ``continues`` reads of their text."""
    return runs.select("*", is_rule(F.col("text")).alias("_rule"), (F.length(F.trim("text")) <= OPENING_CHARS).alias("_short"))


def continues(runs: dict):
    """Whether run ``a`` goes on where run ``b`` ends: on its baseline, or raised on it, or
    after a raised mark that opens; a rule drawn as a glyph joins no text of another size."""
    x0, y0, x1, size, rule, short = (runs[c] for c in ("x0", "y0", "x1", "size", "_rule", "_short"))

    def among(a, b):
        size_a, size_b = size[a], size[b]
        em, gap, up = np.maximum(size_a, size_b), x0[a] - x1[b], y0[a] - y0[b]
        level = np.abs(up) <= BASELINE * em
        raised = (size_a <= RAISED_SIZE * size_b) & (up > 0) & (up <= RAISED_HIGH * size_b) & (gap >= -RAISED_OVERLAP * size_b) & (gap <= RAISED_GAP * size_b)
        opening = (size_b <= RAISED_SIZE * size_a) & (up < 0) & (-up <= RAISED_HIGH * size_a) & (np.abs(gap) <= OPENING_GAP * size_a) & short[b]
        beside = ((size_a >= BESIDE_SIZES * size_b) & rule[a]) | ((size_b >= BESIDE_SIZES * size_a) & rule[b])
        return (level | raised | opening) & (gap <= JOIN_GAP * em) & ~beside

    return among


def numbers(rows: pa.Table) -> dict[str, np.ndarray]:
    return {c: np.asarray(rows.column(c), dtype=kind) for c, kind in NUMBERS}


def chained(runs: DataFrame) -> DataFrame:
    """Runs with ``line``, the seq of the first run of the line: each continues the nearest
    in height (then the one that ends furthest right, then the first) of those it can. Rows
    are dealt by page once; a task holds the pages of a batch."""
    names, seq = runs.columns, runs.schema["seq"].dataType

    def run(batches):
        for rows, number in whole_pages(batches):
            of = numbers(rows)
            line = of["seq"][heads(number, of, continues(of), RAISED_HIGH, JOIN_GAP)]
            yield from rows.select(names).append_column("line", pa.array(line).cast(rows.schema.field("seq").type)).to_batches()

    return dealt_by_page(marked(runs)).mapInArrow(run, StructType([*runs.schema.fields, StructField("line", seq)]))


# Lines of the runs of whole pages.


class Line:
    """Runs by line and from the left: ``order``, ``fresh`` (one opens a line), ``line`` and ``first``."""

    def __init__(self, head: np.ndarray, of: dict[str, np.ndarray]):
        self.order = np.lexsort((of["seq"], of["x0"], head))
        own = head[self.order]
        self.fresh = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        self.line, self.first = np.cumsum(self.fresh) - 1, np.flatnonzero(self.fresh)

    def so_far(self, values: np.ndarray) -> np.ndarray:
        """The largest of each line up to each run."""
        ranks, place = np.unique(values[self.order], return_inverse=True)
        base = self.line * len(ranks)
        return ranks[np.maximum.accumulate(base + place) - base]

    def before(self, values: np.ndarray) -> np.ndarray:
        """The same without the run itself; what it is of a first run means nothing."""
        return np.concatenate([values[:1], self.so_far(values)[:-1]])


def spelt(lines: Line, of: dict[str, np.ndarray], text: pa.Array) -> dict:
    """Lines (first: the place of their first run, text, x0, x1, y, size, runs, first_word): runs
    from the left, a blank where the gap parts words; the baseline is that of the largest run."""
    order, first = lines.order, lines.first
    x0, x1, size, own = of["x0"][order], of["x1"][order], of["size"][order], text.take(pa.array(order))
    gap = x0 - lines.before(of["x1"]) > WORD_GAP * lines.so_far(of["size"])
    ends, starts = np.asarray(pc.ends_with(own, " ")), np.asarray(pc.starts_with(own, " "))
    blank = gap & ~lines.fresh & ~np.concatenate([ends[:1], ends[:-1]]) & ~starts
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(blank), " ", ""), own, "")
    edges = np.concatenate([first, [len(order)]]).astype(np.int32)
    said = pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), pieces), ""), SPACES)
    largest, right = np.maximum.reduceat(size, first), np.maximum.reduceat(x1, first)
    top = np.flatnonzero(size == largest[lines.line])
    main = top[np.unique(lines.line[top], return_index=True)[1]]
    chars = np.asarray(pc.utf8_length(said))
    word = np.asarray(pc.utf8_length(pc.replace_substring_regex(said, f"(?s)[{SPACE}].*", "")))
    left = x0[first]
    return {"first": order[first], "text": said, "x0": left, "x1": right, "y": of["y0"][order][main], "size": largest, "runs": np.diff(edges).astype(np.int64), "first_word": (right - left) * (word / np.maximum(chars, 1))}


def level_with(number: np.ndarray, y: np.ndarray, asks: np.ndarray, of: np.ndarray, reach: np.ndarray):
    """Pairs of each that asks (page, y and reach by place) and those (page ``number``, y) of its page that stand no further away in height, some at a time, and perhaps a few more."""
    at, height = asks
    by = np.lexsort((y, number))
    values, rank = np.unique(y, return_inverse=True)
    key = number[by] * (len(values) + 1) + rank[by]
    low = np.searchsorted(key, at * (len(values) + 1) + np.searchsorted(values, height - reach - 1e-6))
    high = np.searchsorted(key, at * (len(values) + 1) + np.searchsorted(values, height + reach + 1e-6, "right"))
    for a, b in ranged(of, low, high):
        yield a, by[b]


def gutter_edges(page: np.ndarray, made: dict) -> np.ndarray:
    """The lines with other text to their left on about their height."""
    out = np.zeros(len(page), bool)
    x0, x1, y, size = (made[c] for c in ("x0", "x1", "y", "size"))
    largest = np.maximum.reduceat(size, np.flatnonzero(np.diff(page, prepend=-1)))[np.unique(page, return_inverse=True)[1]]
    for a, b in level_with(page, y, (page, y), np.arange(len(page)), GUTTER_BESIDE * np.abs(largest)):
        beside = (x1[b] <= x0[a] + GUTTER_EDGE) & (np.abs(y[a] - y[b]) <= GUTTER_BESIDE * np.maximum(size[a], size[b])) & (a != b)
        out[a[beside]] = True
    return out


def parted(number: np.ndarray, of: dict[str, np.ndarray], text: pa.Array, lines: Line, made: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that a gutter keeps from the run before in their line, and its seq: three
    lines begin at its left edge, the gap is wide, two words or more stand before it, no
    leader leads to it, and no text near above or below crosses its edge."""
    page = number[made["first"]]
    edge = gutter_edges(page, made)
    on, x = page[edge], made["x0"][edge]
    values, rank = np.unique(x, return_inverse=True)
    key = np.sort(on * (len(values) + 1) + rank)
    order = lines.order
    x0, at = of["x0"][order], number[order] * (len(values) + 1)
    about = np.searchsorted(key, at + np.searchsorted(values, x0 + GUTTER_EDGE, "right")) - np.searchsorted(key, at + np.searchsorted(values, x0 - GUTTER_EDGE))
    em = lines.so_far(of["size"])
    could = np.flatnonzero(~lines.fresh & (about >= GUTTER_LINES) & (x0 - lines.before(of["x1"]) > GUTTER_GAP * em))
    # No run is white, so two runs before are two words.
    said = text.take(pa.array(order[could - 1])).to_pylist()
    alone = lines.fresh[could - 1]
    could = could[[not leads(t) and (not one or len(WORD.findall(t)) >= GUTTER_WORDS) for t, one in zip(said, alone)]] if len(could) else could
    if not len(could):
        return could, could
    run, em = order[could], em[could]
    crossed = np.zeros(len(could), bool)
    for a, b in level_with(number, of["y0"], (number[run], of["y0"][run]), np.arange(len(run)), GUTTER_CLEAR * np.abs(em)):
        edge = of["x0"][run[a]]
        cross = (of["x0"][b] < edge - GUTTER_EDGE) & (of["x1"][b] > edge + GUTTER_EDGE) & (np.abs(of["y0"][b] - of["y0"][run[a]]) <= GUTTER_CLEAR * em[a])
        crossed[a[cross]] = True
    return run[~crossed], of["seq"][order[could - 1]][~crossed]


def lines_in(number: np.ndarray, of: dict[str, np.ndarray], text: pa.Array) -> dict:
    """The lines of pages (``number`` of each run, rising from 0): made once, and again where they show a gutter
    that some line was joined across."""
    head = heads(number, of, continues(of), RAISED_HIGH, JOIN_GAP)
    lines = Line(head, of)
    made = spelt(lines, of, text)
    gone, other = parted(number, of, text, lines, made)
    if not len(gone):
        return made
    again = np.flatnonzero(np.isin(number, number[gone]))
    part = {c: v[again] for c, v in of.items()}
    head[again] = again[heads(np.unique(number[again], return_inverse=True)[1], part, continues(part), RAISED_HIGH, JOIN_GAP, (np.searchsorted(again, gone), other))]
    return spelt(Line(head, of), of, text)


def whole_text(rows: pa.Table) -> pa.Array:
    text = rows.column("text").combine_chunks()
    return pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text


def fields(**kinds) -> list[StructField]:
    return [StructField(name, kind) for name, kind in kinds.items()]


TEXT, NUMBER, COUNT, REAL, FLAG = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def lines_of(runs: DataFrame, dealt: bool = False) -> DataFrame:
    """The lines of pages (doc_id, page, seq, text, x0, x1, y, size, runs, first_word). White runs and artifacts
    join nothing. ``dealt``: the runs of a page come one after the other in one task already, and so do its lines."""
    if "artifact" in runs.columns:
        runs = runs.where("NOT artifact")
    runs = runs.where(~is_white(F.col("text"))).select("doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "size")
    own = marked(runs).drop("y1")

    def run(batches):
        for rows, number in whole_pages(batches):
            made = lines_in(number, numbers(rows), whole_text(rows))
            who = rows.select(["doc_id", "page", "seq"]).take(pa.array(made.pop("first")))
            for name, values in made.items():
                who = who.append_column(name, pa.array(values))
            yield from who.to_batches()

    ids = [runs.schema[c] for c in ("doc_id", "page", "seq")]
    return (own if dealt else dealt_by_page(own)).mapInArrow(run, StructType([*ids, *fields(text=TEXT, x0=REAL, x1=REAL, y=REAL, size=REAL, runs=COUNT, first_word=REAL)]))


# Columns, running lines, rows of cells: a page's lines as lists, a line by its place in them.


class Page:
    def __init__(self, seq: list, x0: list, x1: list, y: list, size: list, first_word: list):
        self.seq, self.x0, self.x1, self.y, self.size, self.first_word = seq, x0, x1, y, size, first_word

    def islands(self, own) -> list[list[int]]:
        """Clusters of overlapping horizontal extents, left to right."""
        x0, x1, seq, out, reach = self.x0, self.x1, self.seq, [], None
        for k in sorted(own, key=lambda k: (x0[k], x1[k], seq[k])):
            if reach is None or x0[k] >= reach:
                out.append([])
            out[-1].append(k)
            reach = x1[k] if reach is None or x1[k] > reach else reach
        return out

    def columns(self) -> list[tuple[list[int], bool]]:
        """Columns in reading order, and which are running: a page whose columns but one, the
        body with most lines, are all headers or footers has these before and after it. A
        header or footer has at most two lines, is narrower than the body, and is an em or more
        above its first line or below its last. All or nothing."""
        cols, y, seq, size = self.islands(range(len(self.seq))), self.y, self.seq, self.size
        most = max(map(len, cols))
        if len(cols) < 2 or sum(len(c) == most for c in cols) > 1:
            return [(c, False) for c in cols]
        body = next(c for c in cols if len(c) == most)
        wide = lambda c: max(self.x1[k] for k in c) - min(self.x0[k] for k in c)
        by = lambda k: (y[k], seq[k], size[k])
        top, low, measure, heads_, feet = max(body, key=by), min(body, key=by), wide(body), [], []
        for c in cols:
            if c is body:
                continue
            em = max(size[k] for k in c)
            if len(c) > RUNNING_LINES or not wide(c) < measure:
                return [(c, False) for c in cols]
            if max(y[k] for k in c) <= y[low] - max(em, size[low]):
                feet.append(c)
            elif min(y[k] for k in c) >= y[top] + max(em, size[top]):
                heads_.append(c)
            else:
                return [(c, False) for c in cols]
        return [*((c, True) for c in heads_), (body, False), *((c, True) for c in feet)]

    def level(self, a: int, b: int) -> bool:
        return abs(self.y[a] - self.y[b]) <= BASELINE * max(self.size[a], self.size[b])

    def stretch(self, own: list[int], at: int) -> int:
        """Where a stretch of rows of cells that begins at a column's line ends, ``at`` if none
        does. One begins where two lines stand on one baseline with a gap between them, and
        goes on to the first line drawn across the gap, which every line left or right of it
        narrows; three rows make one."""
        x0, x1, a, gl, gr = self.x0, self.x1, own[at], 0.0, -1.0
        for k in range(at + 1, len(own)):
            m = own[k]
            if not self.level(a, m):
                break
            first, second = (x1[m], x0[a]) if x0[m] < x0[a] else (x1[a], x0[m])
            if second > first:
                gl, gr = first, second
        if not gr > gl:
            return at
        end, rows, left, right = at, 0, None, None
        for k in range(at, len(own)):
            m = own[k]
            if x0[m] < gl and max(gl, x1[m]) < gr:
                gl = max(gl, x1[m])
                met = right is not None and self.level(right, m)
                left = m
            elif x0[m] >= gl:
                gr = min(gr, x0[m])
                met = left is not None and self.level(left, m)
                right = m
            else:
                break
            end += 1
            if met:
                rows, left, right = rows + 1, None, None
        return end if rows >= CELL_ROWS else at

    def rows(self, own: list[int]) -> list[list[int]]:
        """A stretch's rows: one opens at the first of the lines on one baseline."""
        out = [[own[0]]]
        for k in range(1, len(own)):
            if not self.level(own[k - 1], own[k]) and k + 1 < len(own) and self.level(own[k], own[k + 1]):
                out.append([])
            out[-1].append(own[k])
        return out

    def grouped(self) -> tuple[list, ...]:
        """col, running, stretch, row, cell, place and para of each line: see ``grouped``."""
        y, seq, size, x0, x1, first_word = self.y, self.seq, self.size, self.x0, self.x1, self.first_word
        n = len(seq)
        col, is_running, stretch, row, cell, place, para = [0] * n, [False] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        down = lambda k: (-y[k], seq[k])
        nth = many = 0
        for c, (own, running) in enumerate(self.columns()):
            own = sorted(own, key=down)
            steps = sorted(y[a] - y[b] for a, b in zip(own, own[1:]))
            half = len(steps) // 2
            typical = 0.0 if not steps else steps[half] if len(steps) % 2 or steps[half - 1] == steps[half] else 0.5 * steps[half - 1] + 0.5 * steps[half]
            right, heights, at, edges = max(x1[k] for k in own), [y[k] for k in own], 0, {}
            for k in own:
                col[k], is_running[k] = c, running
            while at + 1 < len(own):
                end = self.stretch(own, at) if self.level(own[at], own[at + 1]) else at
                if end == at:
                    at += 1
                    continue
                s = len(edges) + 1
                part, of = own[at:end], {}
                for r, line in enumerate(self.rows(part)):
                    cells = self.islands(line)
                    for i, members in enumerate(cells):
                        of[r, i] = min(x0[k] for k in cells[i + 1]) if i + 1 < len(cells) else right
                        for k in members:
                            stretch[k], row[k], cell[k] = s, r, i
                edges[s] = of
                heights[at:end] = [y[part[0]]] * len(part)
                at = end
            top = dict(zip(own, heights))
            last, past = None, 0
            # A paragraph around a stretch ends at it: some stretch's first line lies between the two.
            was_past = 0
            before = {}
            for k in sorted(own, key=lambda k: (-top[k], stretch[k], row[k], cell[k], -y[k], seq[k])):
                s = stretch[k]
                if s > past:
                    past = s
                key = (s, row[k], cell[k])
                last, was_past = before.get(key, (None, 0))
                if last is None:
                    breaks = True
                else:
                    em = max(size[last], size[k])
                    edge = edges[s][row[k], cell[k]] if s else right
                    breaks = (
                        abs(size[last] - size[k]) > 0.1 * em or len(steps) >= 2 and y[last] - y[k] > 1.25 * typical or x0[k] > x0[last] + 0.5 * em
                        or edge - x1[last] > first_word[k] + 0.5 * em or not s and was_past != past
                    )
                before[key] = k, past
                nth, many = nth + 1, many + breaks
                place[k], para[k] = nth, many
        return col, is_running, stretch, row, cell, place, para


LAYOUT = ("col", "running", "stretch", "row", "cell", "place", "para")
PLACES = fields(col=NUMBER, running=FLAG, stretch=NUMBER, row=NUMBER, cell=NUMBER, place=NUMBER, para=NUMBER)


def pages_of(number: np.ndarray, columns: list[list]):
    """Each page's slice (from, to) and its ``Page``; ``columns`` are those that a page takes."""
    edges = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(number)]
    for a, b in zip(edges, edges[1:]):
        yield a, b, Page(*(c[a:b] for c in columns))


def grouped(lines: DataFrame, dealt: bool = False) -> DataFrame:
    """Lines with ``place`` in reading order and ``para``, numbered through the page: columns from
    the left (headers first, footers last), in them downwards; a stretch of rows of cells
    stands where its first line does and is read row by row, cell by cell. A line begins a
    paragraph when its size changes by over a tenth, it steps down more than 1.25 of the
    column's usual step (of two or more), it starts over half an em further right, or
    the line before stopped where its first word would have fitted: short of the column's
    right edge, or in a cell of where the next cell begins. ``dealt`` as of ``lines_of``."""
    names = ["doc_id", "page", "seq", "text", "x0", "x1", "y", "size"]

    def run(batches):
        for rows, number in whole_pages(batches):
            out = [[] for _ in LAYOUT]
            for _, _, page in pages_of(number, [rows.column(c).to_pylist() for c in ("seq", "x0", "x1", "y", "size", "first_word")]):
                for all_, own in zip(out, page.grouped()):
                    all_ += own
            whole = rows.select(names)
            for name, values in zip(LAYOUT, out):
                whole = whole.append_column(name, pa.array(values, pa.bool_() if name == "running" else pa.int32()))
            yield from whole.to_batches()

    own = lines.select(*names, "first_word")
    return (own if dealt else dealt_by_page(own)).mapInArrow(run, StructType([*(lines.schema[c] for c in names), *PLACES]))


# Tables.

#: What a page gives: its lines, the cells of its tables, its grids.
PARTS = [
    *fields(part=TEXT, seq=NUMBER, text=TEXT, x0=REAL, x1=REAL, y=REAL, size=REAL), *PLACES,
    *fields(grid=NUMBER, xs=ArrayType(REAL), ys=ArrayType(REAL), filled=COUNT, reason=TEXT, before=NUMBER, lines=COUNT, paras=NUMBER),
]


class Grid:
    """A grid of a page and the runs in it: ``at`` (its row), frame, reason, and of each run the row and column."""

    def __init__(self, at: int, grid: int, xs: list, ys: list):
        self.at, self.grid, self.xs, self.ys = at, grid, np.array(xs, float), np.array(ys, float)
        self.x0, self.x1, self.y0, self.y1 = xs[0], xs[-1], ys[-1], ys[0]
        self.slots, self.before = (len(xs) - 1) * (len(ys) - 1), None

    def overlaps(self, other: Grid) -> bool:
        return self.x0 < other.x1 and other.x0 < self.x1 and self.y0 < other.y1 and other.y0 < self.y1

    def takes(self, runs: np.ndarray, mx: np.ndarray, my: np.ndarray, turned: np.ndarray) -> None:
        self.runs = runs
        # Edges of the frame divide nothing.
        self.row = sum(((my <= y).astype(np.int64) for y in self.ys[1:-1]), np.zeros(len(runs), np.int64))
        self.col = sum(((mx >= x).astype(np.int64) for x in self.xs[1:-1]), np.zeros(len(runs), np.int64))
        self.filled = len(np.unique(self.row * len(self.xs) + self.col))
        self.turned = bool(turned.any())


def placed_in_grids(grids: list[Grid], runs: np.ndarray, mx: np.ndarray, my: np.ndarray, turned: np.ndarray) -> None:
    """Gives each of a page's runs to the grid whose frame holds the middle of its box, of several the first from the
    top and the left, and says of each grid why it is no table."""
    free = np.ones(len(runs), bool)
    for g in sorted(grids, key=lambda g: (-g.y1, g.x0, g.grid)):
        own = np.flatnonzero(free & (mx >= g.x0) & (mx <= g.x1) & (my >= g.y0) & (my <= g.y1))
        free[own] = False
        g.takes(runs[own], mx[own], my[own], turned[own])
    frames = np.array([(g.x0, g.x1, g.y0, g.y1) for g in grids])
    for k, g in enumerate(grids):
        meets = (frames[:, 0] < g.x1) & (g.x0 < frames[:, 1]) & (frames[:, 2] < g.y1) & (g.y0 < frames[:, 3])
        meets[k] = False
        g.reason = "" if TABLE_FILL * g.filled < g.slots else "nested" if meets.any() else "turned" if g.turned else None


def cut_at_tables(page: Page, para: list[int], place: list[int], is_running: list[bool], kept: list[Grid]) -> None:
    """Ends paragraphs at tables that stand in them, and tells each table (``before``) how many are read before it."""
    order = sorted(range(len(para)), key=place.__getitem__)
    x0, x1, y = page.x0, page.x1, page.y
    was, more, paras, last = [para[k] for k in order], 0, [], None
    for k, p in zip(order, was):
        if last is not None and last[1] == p:
            b = last[0]
            left, right = min(x0[b], x0[k]), max(x1[b], x1[k])
            more += any(y[b] >= g.y1 and y[k] < g.y0 and left < g.x1 and right > g.x0 for g in kept)
        last = k, p
        para[k] = p + more
        if not paras or paras[-1][0] != para[k]:
            paras.append([para[k], x0[k], x1[k], y[k], is_running[k]])
        else:
            paras[-1][1:3] = min(paras[-1][1], x0[k]), max(paras[-1][2], x1[k])
    for g in kept:
        g.before = len(paras)
        for number, left, right, top, running in paras:
            shares = running or left < g.x1 and right > g.x0
            if top < g.y1 if shares else left >= g.x1:
                g.before = number - 1
                break


def laid_out(rows: pa.Table, number: np.ndarray) -> tuple[pa.Table, dict[str, pa.Array]]:
    """What the pages of a batch give, whose it is and its columns: see ``page_parts``."""
    is_grid = np.asarray(rows.column("grid").is_valid())
    runs, at_grids = np.flatnonzero(~is_grid), np.flatnonzero(is_grid)
    own = rows.take(pa.array(runs))
    of, text, page = numbers(own), whole_text(own), number[runs]
    flag = lambda c, unknown: np.asarray(pc.fill_null(own.column(c), unknown), dtype=bool)
    turned, artifact, y1 = flag("turned", False), flag("artifact", True), np.asarray(own.column("y1"), dtype=float)
    mx, my = (of["x0"] + of["x1"]) / 2, (of["y0"] + y1) / 2
    grids: dict[int, list[Grid]] = {}
    held = rows.select(["grid", "xs", "ys"]).take(pa.array(at_grids))
    for at, p, grid, xs, ys in zip(at_grids.tolist(), number[at_grids].tolist(), *(held.column(c).to_pylist() for c in ("grid", "xs", "ys"))):
        grids.setdefault(p, []).append(Grid(at, grid, xs, ys))
    # Cells are grouped apart from each other: each is a page of its own meanwhile.
    cell, cells = np.full(len(runs), -1), []
    for p, members in grids.items():
        a, b = np.searchsorted(page, p), np.searchsorted(page, p, "right")
        placed_in_grids(members, np.arange(a, b), mx[a:b], my[a:b], turned[a:b])
        for g in members:
            if g.reason is None:
                slots, nth = np.unique(g.row * len(g.xs) + g.col, return_inverse=True)
                cell[g.runs] = len(cells) + nth
                cells += [(g, *divmod(int(s), len(g.xs))) for s in slots]
    part = lambda which: ({c: v[which] for c, v in of.items()}, text.take(pa.array(which)))
    inside = np.flatnonzero(cell >= 0)
    inside = inside[np.argsort(cell[inside], kind="stable")]
    said = [[] for _ in cells]
    if len(inside):
        made = lines_in(cell[inside], *part(inside))
        seq = of["seq"][inside[made["first"]]]
        for c, *line in zip(cell[inside[made["first"]]].tolist(), (-made["y"]).tolist(), seq.tolist(), made["text"].to_pylist()):
            said[c].append(line)
    rest = np.flatnonzero((cell < 0) & ~artifact)
    out, who, sums, made = [[] for _ in LAYOUT], np.zeros(0, np.int64), {}, None
    if len(rest):
        made = lines_in(np.unique(page[rest], return_inverse=True)[1], *part(rest))
        who = rest[made["first"]]
        columns = [of["seq"][who].tolist(), *(made[c].tolist() for c in ("x0", "x1", "y", "size", "first_word"))]
        where = page[who]
        for a, _, lines in pages_of(np.unique(where, return_inverse=True)[1], columns):
            own_layout, p = lines.grouped(), int(where[a])
            kept = [g for g in grids.get(p, ()) if g.reason is None]
            if kept:
                cut_at_tables(lines, own_layout[6], own_layout[5], own_layout[1], kept)
            sums[p] = len(lines.seq), max(own_layout[6])
            for all_, values in zip(out, own_layout):
                all_ += values
    for p, members in grids.items():
        for g in members:
            g.page = p
            if g.reason is None and g.before is None:
                g.before = 0
    flat = [g for members in grids.values() for g in members]
    first = inside[np.searchsorted(cell[inside], np.arange(len(cells)))]
    at = np.concatenate([runs[who], runs[first], np.array([g.at for g in flat], np.int64)])
    sizes = len(who), len(cells), len(flat)
    nulls = lambda n, kind: pa.nulls(n, kind)

    def column(kind, lines=None, of_cells=None, of_grids=None):
        parts = [nulls(n, kind) if v is None else pa.array(v, kind) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v.cast(kind) for n, v in zip(sizes, (lines, of_cells, of_grids))]
        return pa.concat_arrays([c for p in parts for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])])

    line = (lambda c: made[c]) if made else (lambda c: None)
    integer, real, string, edges = pa.int32(), pa.float64(), pa.string(), pa.list_(pa.float64())
    found = {
        "part": column(string, ["line"] * sizes[0], ["cell"] * sizes[1], ["grid"] * sizes[2]), "seq": column(integer, of["seq"][who]),
        "text": column(string, line("text"), ["\n".join(t for _, _, t in sorted(own)) for own in said]), **{c: column(real, line(c)) for c in ("x0", "x1", "y", "size")},
        "col": column(integer, out[0], [c for _, _, c in cells]), "running": column(pa.bool_(), out[1]), "stretch": column(integer, out[2]), "row": column(integer, out[3], [r for _, r, _ in cells]),
        **{c: column(integer, out[k]) for k, c in enumerate(LAYOUT) if k > 3}, "grid": column(integer, None, [g.grid for g, _, _ in cells], [g.grid for g in flat]),
        "xs": column(edges, None, None, [g.xs for g in flat]), "ys": column(edges, None, None, [g.ys for g in flat]), "filled": column(pa.int64(), None, None, [g.filled for g in flat]),
        "reason": column(string, None, None, [g.reason for g in flat]), "before": column(integer, None, None, [g.before for g in flat]),
        "lines": column(pa.int64(), None, None, [sums.get(g.page, (None,))[0] for g in flat]), "paras": column(integer, None, None, [sums.get(g.page, (None, None))[1] for g in flat]),
    }
    return rows.select(["doc_id", "page"]).take(pa.array(at)), found


def page_parts(runs: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """The layout of pages with ruled grids, a row for each line (``part`` is ``line``), each cell of
    a table that holds text (``cell``) and each grid (``grid``).

    A grid (doc_id, page, grid, xs rising, ys falling) is a table when a quarter of its cells hold text, no other grid overlaps it and
    none of its text is turned (``reason`` says why not; too few says nothing). A table's
    text goes to its cells, cell by cell in lines, and is taken out of the paragraphs; what
    is left is grouped as a page without a table is, and a paragraph ends at a table that
    stands in it. ``before`` is how many paragraphs are read before the table; ``lines`` and ``paras`` are how many its page has.

    Without ``grids`` the rows of ``runs`` hold both (a grid has no text, a run no ``grid``), and a page's come one after the other in one task."""
    dealt = grids is None
    names = ["doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "size"]
    flags = [F.col(c) if c in runs.columns else F.lit(False).alias(c) for c in ("turned", "artifact")]
    if dealt:
        both = runs.select(*names, *flags, "grid", "xs", "ys")
    else:
        both = runs.select(*names, *flags).unionByName(grids.select("doc_id", "page", "grid", "xs", "ys"), allowMissingColumns=True)
    both = marked(both.where(F.col("grid").isNotNull() | ~is_white(F.col("text"))))

    def run(batches):
        for rows, number in whole_pages(batches):
            who, found = laid_out(rows, number)
            for name, values in found.items():
                who = who.append_column(name, values)
            yield from who.to_batches()

    return (both if dealt else dealt_by_page(both)).mapInArrow(run, StructType([runs.schema["doc_id"], runs.schema["page"], *PARTS]))


def lines_among(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'line'").select("doc_id", "page", "seq", "text", "x0", "x1", "y", "size", *LAYOUT)


def cells_among(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'cell'").select("doc_id", "page", "grid", "row", "col", "text")


def grids_among(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'grid'").select("doc_id", "page", "grid", "xs", "ys", "filled", "reason", "before")


def tables_in_layout(runs: DataFrame, grids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines in paragraphs, cells, grids) of ``page_parts``."""
    parts = cut(page_parts(runs, grids))
    return lines_among(parts), cells_among(parts), grids_among(parts)
