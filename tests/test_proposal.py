"""Proposed structure against plain loops over the naive layout of each page."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quirespark.functions.text import list_marker
from quirespark.operators import proposal as R
from quirespark.plans import group_queries as Q
from tests.test_grouping import frame, naive_lines, naive_tables, pages_of, run

FOLDER = "/root/testdata/sf0.001"


def naive(spark, runs, grids):
    pages, by, out = pages_of(runs), pages_of(grids), defaultdict(list)
    layouts, sizes = {}, defaultdict(Counter)
    for key, page in pages.items():
        found, cells, paras = naive_tables(page, by.get(key, []))
        kept = [g for g in by.get(key, []) if any(f[0] == g["grid"] and f[2] is None for f in found)]
        seqs = {s for p in paras for s in p}
        inside = lambda r: any(g["xs"][0] <= (r["x0"] + r["x1"]) / 2 <= g["xs"][-1] and g["ys"][-1] <= (r["y0"] + r["y1"]) / 2 <= g["ys"][0] for g in kept)  # noqa: B023, E731
        lines = {ln["seq"]: ln for ln in naive_lines([r for r in page if not inside(r)])}
        assert seqs == set(lines)
        layouts[key] = (found, cells, paras, lines, kept)
        for ln in lines.values():
            sizes[key[0]][math.floor(ln["size"] * 2 + 0.5) / 2] += len(re.sub(r"\s", "", ln["text"]))
    body = {d: min(c, key=lambda s: (-c[s], s)) for d, c in sizes.items()}
    texts = {" ".join(lines[s]["text"] for s in p) for _, _, paras, lines, _ in layouts.values() for p in paras}
    marks = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", list_marker(F.col("t")).alias("m")).collect()} if texts else {}
    heads = defaultdict(set)
    for (doc, page), (_, _, paras, lines, _) in sorted(layouts.items()):
        for p in paras:
            text, half = " ".join(lines[s]["text"] for s in p), max(math.floor(lines[s]["size"] * 2 + 0.5) / 2 for s in p)
            if not marks[text] and len(p) <= 3 and half >= body[doc] * 1.15:
                heads[doc].add(half)
    for (doc, page), (found, cells, paras, lines, kept) in sorted(layouts.items()):
        rows = []
        for k, p in enumerate(paras, 1):
            text, half = " ".join(lines[s]["text"] for s in p), max(math.floor(lines[s]["size"] * 2 + 0.5) / 2 for s in p)
            head = not marks[text] and len(p) <= 3 and half >= body[doc] * 1.15
            role = f"H{min(6, 1 + sum(h > half for h in heads[doc]))}" if head else "LI" if marks[text] else "P"
            box = (min(lines[s]["x0"] for s in p), min(lines[s]["y"] for s in p), max(lines[s]["x1"] for s in p), max(lines[s]["y"] + lines[s]["size"] for s in p))
            rows.append(((k * 2, -1), None, role, text[len(marks[text]) :].lstrip() if marks[text] else text, box))
        for g in kept:
            before = next(f[3] for f in found if f[0] == g["grid"])
            xs, ys = g["xs"], g["ys"]
            rows.append(((before * 2 + 1, g["grid"], -1, -1), None, "Table", "", (xs[0], ys[-1], xs[-1], ys[0])))
            for r in range(len(ys) - 1):
                rows.append(((before * 2 + 1, g["grid"], r, -1), (before * 2 + 1, g["grid"], -1, -1), "TR", "", (xs[0], ys[r + 1], xs[-1], ys[r])))
                for c in range(len(xs) - 1):
                    rows.append(((before * 2 + 1, g["grid"], r, c), (before * 2 + 1, g["grid"], r, -1), "TD", cells.get((g["grid"], r, c), "").replace("\n", " "), (xs[c], ys[r + 1], xs[c + 1], ys[r])))
        at = {}
        for key, parent, role, text, box in sorted(rows, key=lambda r: r[0]):
            at[key] = len(out[doc])
            out[doc].append((at[key], at.get(parent), role, page, text, tuple(round(x, 6) for x in box)))
    return out


def compare(spark, runs, grids, found):
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.id, r.parent, r.role, r.page, r.text, tuple(round(x, 6) for x in (r.x0, r.y0, r.x1, r.y1))))
    want = naive(spark, runs, grids)
    for doc, rows in want.items():
        assert sorted(got[doc]) == rows, doc
    return {r[2] for rows in want.values() for r in rows}


def test_structure_proposal(spark):
    where = "doc_id < 90 AND doc_id % 4 = 1"
    runs = [r.asDict() for r in Q.word_runs(spark, FOLDER).where(where).collect()]
    grids = [r.asDict() for r in Q.page_grids(spark, FOLDER).where(where).collect()]
    assert {"H1", "P", "Table", "TR", "TD"} <= compare(spark, runs, grids, Q.QUERIES["structure_proposal"](spark, FOLDER).where(where).collect())


def test_a_page_with_a_table(spark):
    runs = [run("Title", 60, 720, 60, 20, 0), run("text before the table that is quite long", 60, 700, 240, 10, 1), run("a", 70, 660, 6, 10, 2), run("b c", 170, 660, 18, 10, 3), run("d", 70, 640, 6, 10, 4), run("1. an item of a list", 60, 600, 120, 10, 5)]
    grids = [{"doc_id": 1, "page": 0, "grid": 1, "xs": [60.0, 160.0, 260.0], "ys": [675.0, 655.0, 630.0]}]
    frames = spark.createDataFrame([(1, 0, 1, grids[0]["xs"], grids[0]["ys"])], "doc_id long, page int, grid int, xs array<double>, ys array<double>")
    found = R.proposed(frame(spark, runs), frames).collect()
    compare(spark, runs, grids, found)
    assert [(r.role, r.parent, r.text) for r in sorted(found, key=lambda r: r.id)] == [("H1", None, "Title"), ("P", None, "text before the table that is quite long"), ("Table", None, ""), ("TR", 2, ""), ("TD", 3, "a"), ("TD", 3, "b c"), ("TR", 2, ""), ("TD", 6, "d"), ("TD", 6, ""), ("LI", None, "an item of a list")]


def test_a_proposal_cuts_its_layout_once(spark, monkeypatch):
    from quirespark.operators import grouping as G

    cuts, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(df) or cut(df))
    Q.QUERIES["structure_proposal"](spark, FOLDER)
    assert len(cuts) == 1 and "part" in cuts[0].columns
