"""Fields that drawings suggest, against plain loops over every pair of a page's shapes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from quirespark.operators import fields as L
from quirespark.plans import group_queries as Q

FOLDER = "/root/testdata/sf0.001"
BOXES = "☐□❏❐❑❒▢◻◽▫"


def over(a, b):
    return a[2] > b[0] and a[0] < b[2] and a[3] > b[1] and a[1] < b[3]


def middle(a, b):
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return a[0] <= x <= a[2] and a[1] <= y <= a[3]


def blanks(room, solids, bare):
    x0, y0, x1, y1 = room
    if not bare:
        upper = [t for t in solids if over(t, room) and (t[1] + t[3]) / 2 < y0 + 0.6 * (y1 - y0)]
        if upper and y1 - (max(t[3] for t in upper) - 1) >= 8:
            y0 = max(t[3] for t in upper) - 1
    if y1 - y0 < 7:
        return []
    blocks = sorted((t[0] - 1.5, t[2] + 1.5) for t in solids if over(t, (x0, y0, x1, y1)) and min(t[3], y1) - max(t[1], y0) > 0.3 * (t[3] - t[1]))
    gaps, at = [], x0
    for a, b in blocks:
        if min(a, x1) > at:
            gaps.append((at, min(a, x1)))
        at = max(at, b)
    if x1 > at:
        gaps.append((at, x1))
    wide = [g for g in gaps if g[1] - g[0] >= 24]
    keep = wide or sorted((g for g in gaps if g[1] - g[0] >= 14), key=lambda g: g[0] - g[1])[:1]
    return [(a, y0, b, y1) for a, b in keep]


def naive(shapes):
    """shapes: (id, kind, box, text) of a page."""
    of = lambda *kinds: [s for s in shapes if s[1] in kinds]
    words = [s[2] for s in of("print") if not re.fullmatch(r"[\s\-–—/\\().,:;|_]*", s[3]) and not re.fullmatch(f"[{BOXES}]+", s[3])]
    squares = [b for _, _, b, _ in of("square") if 5 <= b[2] - b[0] <= 20 and 5 <= b[3] - b[1] <= 20 and abs(b[2] - b[0] - b[3] + b[1]) < 4 and not any(over(w, b) for w in words)]
    solids, walls = words + squares, [s[2] for s in of("widget")]
    shades = [s[2] for s in of("shade")]

    def free(fields):
        return [f for f in fields if not any(middle(w, f[2]) or middle(f[2], w) for w in walls) and (f[1] == "ground" or not any(middle(s, f[2]) for s in shades))]

    found = [("check", "square", b) for b in squares]
    lines = {i: ((b[1] + b[3]) / 2, b[0], b[2]) for i, _, b, _ in of("h", "heavy")}
    xs = sorted({x for _, a, z in lines.values() for x in (a, z)})
    strips = defaultdict(list)
    for k, (a, z) in enumerate(zip(xs, xs[1:])):
        held = sorted((y, i) for i, (y, x0, x1) in lines.items() if x0 <= a and z <= x1)
        for (y, i), (v, j) in zip(held, held[1:]):
            if v > y + 7:
                strips[i, j].append(k)
    used = set()
    for (i, j), ks in strips.items():
        runs = []
        for k in ks:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        for run in runs:
            x0, x1, top, low = xs[run[0]], xs[run[-1] + 1], lines[i], lines[j]
            if x1 - x0 <= 14:
                continue
            ups = sorted((b[0] + b[2]) / 2 for _, _, b, _ in of("v") if x0 - 2.5 < (b[0] + b[2]) / 2 < x1 + 2.5 and b[1] <= top[0] + 2.5 and b[3] >= low[0] - 2.5)
            same = abs(top[1] - low[1]) <= 2.5 and abs(top[2] - low[2]) <= 2.5 and x0 == max(top[1], low[1]) and x1 == min(top[2], low[2])
            if not ups and not (same and low[0] - top[0] <= 45):
                continue
            used |= {i, j}
            cuts = [x0, *(x for x in ups if x0 + 2.5 < x < x1 - 2.5), x1]
            for a, z in zip(cuts, cuts[1:]):
                cell = (a + 1, top[0] + 1, z - 1, low[0] - 1)
                w, h = cell[2] - cell[0], cell[3] - cell[1]
                inside = [t for t in solids if over(t, cell)]
                if w < 5 or h < 5:
                    continue
                if w <= 20 and h <= 20:
                    found += [("check", "cell", cell)] if not inside else []
                elif any(t in squares for t in inside):
                    continue
                elif not ups and not inside:
                    found.append(("text", "line", (cell[0], max(cell[1], cell[3] - 15), cell[2], cell[3])))
                else:
                    found += [("text", "cell", b) for b in blanks(cell, solids, False)]
    found = free(found)
    first = list(found)
    for i, _, b, _ in of("h"):
        y = (b[1] + b[3]) / 2
        room = (b[0], y - 15, b[2], y - 0.5)
        if i not in used and not any(over(f[2], room) for f in first):
            found += free([("text", "line", x) for x in blanks(room, solids, True)])
    inner = lambda b: (b[0] + 1, b[1] + 1, b[2] - 1, b[3] - 1)
    for i, _, b, _ in sorted((s for s in of("white") if s[2][2] - s[2][0] >= 5 and 5 <= s[2][3] - s[2][1] <= 45), key=lambda s: ((s[2][2] - s[2][0]) * (s[2][3] - s[2][1]), s[0])):
        w, h = b[2] - b[0], b[3] - b[1]
        if any(over(inner(b), f[2]) for f in found):
            continue
        if w <= 20 and h <= 20 and abs(w - h) < 4:
            found += free([("check", "ground", b)] if not any(over(inner(b), t) for t in words) else [])
        else:
            found += free([("text", "ground", x) for x in blanks(b, solids, False)])
    for _, _, b, text in of("print"):
        for m in re.finditer(f"_{{4,}}|[{BOXES}]", text):
            at = lambda k: b[0] + (b[2] - b[0]) * k / len(text)  # noqa: B023, E731
            found += free([("text" if m[0][0] == "_" else "check", "underscores" if m[0][0] == "_" else "glyph", (at(m.start()), b[1], at(m.end()), b[3]))])
    return found


def compare(pages, rows):
    want, got = Counter(), Counter()
    for key, shapes in pages.items():
        want.update((key, k, f, tuple(round(x, 6) for x in b)) for k, f, b in naive(shapes))
    got.update(((r.doc_id, r.page), r["kind"], r["from"], tuple(round(x, 6) for x in (r.x0, r.y0, r.x1, r.y1))) for r in rows)
    assert got == want
    return {f for _, _, f, _ in want}


def pages_of(rows):
    pages = defaultdict(list)
    for r in rows:
        pages[r.doc_id, r.page].append((r.id, r.kind, (float(r.x0), float(r.y0), float(r.x1), float(r.y1)), r.text))
    return pages


def test_drawn_fields(spark):
    rows = Q.page_shapes(spark, FOLDER).collect()
    assert compare(pages_of(rows), Q.QUERIES["drawn_fields"](spark, FOLDER).collect()) == {"cell", "line", "ground", "underscores", "square", "glyph"}


def test_a_form(spark):
    """A row of two labelled cells and a tick box, a line to write on, a tinted box with a ground, print with blanks."""
    form = [(1, "h", 50, 100, 300, 100, ""), (2, "h", 50, 130, 300, 130, ""), (3, "v", 50, 100, 50, 130, ""), (4, "v", 180, 100, 180, 130, ""), (5, "v", 300, 100, 300, 130, ""), (6, "print", 52, 101, 80, 110, "Name"), (7, "print", 182, 101, 210, 110, "First"), (8, "h", 50, 200, 250, 200, ""), (9, "print", 50, 188, 90, 199, "Sign"), (10, "shade", 50, 300, 300, 400, ""), (11, "white", 60, 310, 160, 330, ""), (12, "white", 50, 305, 290, 335, ""), (13, "square", 400, 100, 410, 110, ""), (14, "print", 50, 500, 170, 510, "Sum ______ □ ____"), (15, "heavy", 50, 600, 300, 603, ""), (16, "widget", 400, 300, 450, 320, ""), (17, "white", 400, 300, 450, 320, "")]
    frame = spark.createDataFrame([(1, 0, *s) for s in form], "doc_id long, page int, id int, kind string, x0 int, y0 int, x1 int, y1 int, text string")
    got = L.proposed(frame).collect()
    compare(pages_of(frame.collect()), got)
    assert Counter(r["from"] for r in got) == {"cell": 2, "line": 1, "ground": 1, "square": 1, "underscores": 2, "glyph": 1}


def test_no_shapes(spark):
    assert L.proposed(spark.createDataFrame([], "doc_id long, page int, id int, kind string, x0 int, y0 int, x1 int, y1 int, text string")).collect() == []


SHAPE = "doc_id long, page int, id int, kind string, x0 double, y0 double, x1 double, y1 double, text string"


def crowded(documents, shapes, seed=5):
    """Pages of shapes that overlap at many edges, some off the whole points."""
    rng, out = random.Random(seed), []
    size = {"h": lambda: (rng.randrange(10, 200, 5), 0), "heavy": lambda: (rng.randrange(10, 200, 5), 3), "v": lambda: (rng.choice((0, 1)), rng.randrange(5, 120, 5)), "square": lambda: (rng.choice((4, 8, 10, 12)), rng.choice((8, 10, 12))), "white": lambda: (rng.choice((10, 12, 60, 150)), rng.choice((10, 12, 20, 44))), "shade": lambda: (200, 60), "widget": lambda: (rng.choice((5, 60)), 14), "print": lambda: (rng.randrange(5, 60), 9)}
    for d in range(documents):
        for i in range(shapes):
            kind = rng.choice("h h h v v heavy square white white shade widget print print print".split())
            x, y, (w, h) = rng.randrange(-100, 300, 5) + rng.choice((0, 0, 0.3)), rng.randrange(-100, 300, 5) + rng.choice((0, 0, 0.7)), size[kind]()
            out.append((d, 0, i, kind, float(x), float(y), float(x + w), float(y + h), rng.choice(("Name", "a ____ b______", "☐ x □", " - ", "_____", "___", "😀 ____")) if kind == "print" else ""))
    return out


def test_crowded_pages_a_few_pairs_at_a_time(spark, monkeypatch):
    """Pages go on over batches, and what meets what is compared in many steps."""
    frame = spark.createDataFrame(crowded(6, 120), SHAPE).repartition(3)
    pages = pages_of(frame.collect())
    compare(pages, L.proposed(frame).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        compare(pages, L.proposed(frame).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for shapes in pages.values():
        ids = [s for s in sorted(shapes) if s[1] in L.KINDS]
        kind, boxes = np.array([L.KINDS.index(s[1]) for s in ids]), L.Boxes(np.zeros(len(ids), int), *np.array([s[2] for s in ids], float).T)
        monkeypatch.setattr(L, "PAIRS", 1 << 18)
        whole = L.on_pages(kind, boxes)
        monkeypatch.setattr(L, "PAIRS", 5)
        steps = L.on_pages(kind, boxes)
        assert sorted(zip(*map(np.ndarray.tolist, (whole[0], *whole[1])))) == sorted(zip(*map(np.ndarray.tolist, (steps[0], *steps[1]))))


def test_what_is_not_known(spark):
    """A shape without an edge or a text bars nothing; print keeps what is drawn in it."""
    rows = [(1, 0, 1, "widget", None, 0.0, 50.0, 50.0, ""), (1, 0, 2, "print", 0.0, None, 60.0, 9.0, "ab ____"), (1, 0, 3, "print", 20.0, 20.0, 40.0, 40.0, None), (1, 0, 4, "square", 25.0, 25.0, 35.0, 35.0, None), (1, 0, 5, None, 0.0, 0.0, 9.0, 9.0, ""), (1, 0, 6, "h", 100.0, None, 200.0, 90.0, "")]
    got = {(r["kind"], r["from"], r.x0 and round(r.x0, 6), r.y0, r.x1, r.y1) for r in L.proposed(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {("check", "square", 25.0, 25.0, 35.0, 35.0), ("text", "underscores", round(180 / 7, 6), None, 60.0, 9.0)}


def test_one_exchange_and_no_cuts(spark):
    """Shapes are dealt by page once; no job runs before the rows are asked for."""
    frame = spark.createDataFrame(crowded(2, 20), SHAPE)
    spark.sparkContext.setJobGroup("one-exchange", "")
    found = L.proposed(frame)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("one-exchange")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert "Join" not in found._jdf.queryExecution().sparkPlan().toString()
