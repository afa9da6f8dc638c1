"""The page map against a machine that runs a page's operators one by one."""

import random
from collections import defaultdict

from quirespark.operators import pagemap as M
from quirespark.plans import group_queries as Q

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, page int, seq int, op string, args array<double>, paint string"


def times(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def naive(ops, width, height):
    out, ctm, saved = {}, M.ONE, []
    for seq, op, args, paint in sorted(ops, key=lambda o: o[0]):
        if op == "q":
            saved.append(ctm)
        elif op == "Q":
            ctm = saved.pop() if saved else ctm
        elif op == "cm":
            ctm = times(args, ctm)
        else:
            x, y, w, h = args if op == "re" else (0, 0, 1, 1)
            at = [(a * ctm[0] + b * ctm[2] + ctm[4], a * ctm[1] + b * ctm[3] + ctm[5]) for a in (x, x + w) for b in (y, y + h)]
            left, low, right, top = min(p[0] for p in at), min(p[1] for p in at), max(p[0] for p in at), max(p[1] for p in at)
            w, h = right - left, top - low
            if w <= 0 and h <= 0 or right < 0 or left > width or top < 0 or low > height:
                continue
            kind = "image" if op == "Do" else "white" if paint == "white" else "h" if h <= 2 < w else "v" if w <= 2 < h else "box"
            part = lambda v, by: round(min(1, max(0, v / by)), 6)
            out[seq] = (kind, (paint or "") != "stroke", part(left, width), part(height - top, height), part(right, width), part(height - low, height))
    return out


def compare(rows, found, width=612.0, height=792.0):
    pages, got = defaultdict(list), defaultdict(dict)
    for r in rows:
        pages[r[0], r[1]].append(tuple(r[2:]))
    for r in found:
        got[r.doc_id, r.page][r.seq] = (r.kind, r.filled, *(round(x, 6) for x in (r.x0, r.y0, r.x1, r.y1)))
    for key, ops in pages.items():
        assert got.get(key, {}) == naive(ops, width, height), key
    return {k[0] for page in got.values() for k in page.values()}


def test_page_map(spark):
    rows = [tuple(r) for r in Q.page_operators(spark, FOLDER).collect()]
    assert compare(rows, Q.QUERIES["page_map"](spark, FOLDER).collect()) == {"h", "v", "box", "white", "image"}


def test_saves_restores_and_matrices(spark):
    r = random.Random(12)
    rows = []
    for page in range(80):
        for seq in range(r.randrange(40)):
            op = r.choice(["q", "q", "Q", "Q", "cm", "cm", "re", "re", "Do"])
            args = [r.choice([1.0, 0.5, 0.0, -1.0]) for _ in range(4)] + [r.randrange(400) * 1.0, r.randrange(400) * 1.0] if op == "cm" else [r.randrange(300) * 1.0, r.randrange(300) * 1.0, r.randrange(90) * 1.0, r.randrange(5) * 1.0]
            rows.append((1, page, seq, op, args, r.choice(["fill", "stroke", "white", None])))
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in range(80)], "doc_id long, page int, width double, height double")
    compare(rows, M.page_map(spark.createDataFrame(rows, SCHEMA), pages).collect())
    assert M.page_map(spark.createDataFrame([], SCHEMA), pages).collect() == []


def test_a_page_is_one_pass(spark):
    """A matrix on a matrix, two thousand deep, is no way of two thousand matrices for each; a matrix without numbers does nothing."""
    rows = [(1, 0, seq, op, args, "fill") for k in range(2000) for seq, op, args in ((2 * k, "cm", [1.0, 0.0, 0.0, 1.0, 1.0 - k % 2 * 2, 0.0]), (2 * k + 1, "re", [5.0, 5.0, 9.0, 9.0]))]
    pages = spark.createDataFrame([(1, 0, 612.0, 792.0), (2, 0, 612.0, 792.0)], "doc_id long, page int, width double, height double")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one pass", "")
    found = M.page_map(spark.createDataFrame(rows, SCHEMA), pages).collect()
    ran = {s for j in jobs.getJobIdsForGroup("one pass") for s in jobs.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    compare(rows, found)
    assert len(found) == 2000 and len(ran) <= 6
    bare = spark.createDataFrame([(2, 0, 0, "cm", None, None), (2, 0, 1, "re", [1.0, 1.0, 9.0, 9.0], None), (3, 0, 0, "re", [1.0, 1.0, 9.0, 9.0], None)], SCHEMA)
    assert [(r.doc_id, r.seq, r.kind) for r in M.page_map(bare, pages).collect()] == [(2, 1, "box")]
