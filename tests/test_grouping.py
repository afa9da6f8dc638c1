"""The layout of pages against plain loops that look at every pair of runs."""

import random
import re
import statistics
from collections import defaultdict

from quirespark.operators import grouping as G
from quirespark.plans import group_queries as Q

FOLDER = "/root/testdata/sf0.001"
RUN = ("doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "size", "turned")
SCHEMA = "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, turned boolean"


def run(text, x, y, width, size=10.0, seq=0, turned=False):
    return {"doc_id": 1, "page": 0, "seq": seq, "text": text, "x0": float(x), "y0": float(y), "x1": float(x + width), "y1": float(y + size), "size": float(size), "turned": turned}


def frame(spark, runs):
    return spark.createDataFrame([tuple(r[c] for c in RUN) for r in runs], SCHEMA)


def rule(text):
    return bool(re.fullmatch(r"\s*[_‐‑‒–—―-]+\s*", text))


def goes_on(a, b):
    em, gap, up = max(a["size"], b["size"]), a["x0"] - b["x1"], a["y0"] - b["y0"]
    if (b["x0"], b["seq"]) >= (a["x0"], a["seq"]) or gap > 1.5 * em:
        return False
    if a["size"] >= 3 * b["size"] and rule(a["text"]) or b["size"] >= 3 * a["size"] and rule(b["text"]):
        return False
    raised = a["size"] <= 0.8 * b["size"] and 0 < up <= 0.5 * b["size"] and -b["size"] <= gap <= 0.25 * b["size"]
    opening = b["size"] <= 0.8 * a["size"] and 0 < -up <= 0.5 * a["size"] and abs(gap) <= 0.15 * a["size"] and len(b["text"].strip()) <= 3
    return abs(up) <= 0.3 * em or raised or opening


def chains(runs, apart=()):
    before = {}
    for a in runs:
        own = [(abs(a["y0"] - b["y0"]), -b["x1"], b["seq"]) for b in runs if abs(a["y0"] - b["y0"]) <= 30 and goes_on(a, b) and (a["seq"], b["seq"]) not in apart]
        before[a["seq"]] = min(own)[2] if own else None
    head = lambda s: s if before[s] is None else head(before[s])
    lines = defaultdict(list)
    for r in sorted(runs, key=lambda r: (r["x0"], r["seq"])):
        lines[head(r["seq"])].append(r)
    return lines


def spelt(lines):
    out = []
    for seq, runs in lines.items():
        text, end, em = runs[0]["text"], runs[0]["x1"], runs[0]["size"]
        for last, r in zip(runs, runs[1:]):
            em = max(em, r["size"])
            text += (" " if r["x0"] - end > 0.15 * em and not last["text"].endswith(" ") and not r["text"].startswith(" ") else "") + r["text"]
            end = max(end, r["x1"])
        text = text.strip()
        main = min(runs, key=lambda r: (-r["size"], r["x0"], r["seq"]))
        share = len(re.match(r"\S*", text)[0]) / max(len(text), 1)
        out.append({"seq": seq, "text": text, "x0": runs[0]["x0"], "x1": end, "y": main["y0"], "size": em, "runs": len(runs), "first_word": (end - runs[0]["x0"]) * share})
    return out


def leads(text):
    return len(re.search(r"[.·…\s]*$", text)[0].replace("…", "...").replace(" ", "")) >= 4


def parted(runs, lines, made):
    edges = [a["x0"] for a in made if any(a is not b and b["x1"] <= a["x0"] + 0.5 and abs(a["y"] - b["y"]) <= 0.5 * max(a["size"], b["size"]) for b in made)]
    out = set()
    for line in lines.values():
        end, em, words = line[0]["x1"], line[0]["size"], len(line[0]["text"].split())
        for last, r in zip(line, line[1:]):
            em = max(em, r["size"])
            wide = r["x0"] - end > 0.6 * em and words >= 2 and not leads(last["text"]) and sum(abs(e - r["x0"]) <= 0.5 for e in edges) >= 3
            if wide and not any(q["x0"] < r["x0"] - 0.5 and q["x1"] > r["x0"] + 0.5 and abs(q["y0"] - r["y0"]) <= 2.5 * em for q in runs):
                out.add((r["seq"], last["seq"]))
            end, words = max(end, r["x1"]), words + len(r["text"].split())
    return out


def naive_lines(runs):
    runs = [r for r in runs if r["text"].strip()]
    lines = chains(runs)
    apart = parted(runs, lines, spelt(lines))
    return spelt(chains(runs, apart) if apart else lines)


def islands(lines):
    cols, reach = [], 0.0
    for ln in sorted(lines, key=lambda ln: (ln["x0"], ln["x1"], ln["seq"])):
        if not cols or ln["x0"] >= reach:
            cols.append([])
            reach = ln["x1"]
        cols[-1].append(ln)
        reach = max(reach, ln["x1"])
    return cols


def running(cols):
    most = max(map(len, cols))
    if len(cols) < 2 or sum(len(c) == most for c in cols) > 1:
        return [(c, False) for c in cols]
    body = next(c for c in cols if len(c) == most)
    wide = lambda c: max(ln["x1"] for ln in c) - min(ln["x0"] for ln in c)
    top, low = max(body, key=lambda ln: (ln["y"], ln["seq"])), min(body, key=lambda ln: (ln["y"], ln["seq"]))
    heads, feet = [], []
    for c in cols:
        if c is body:
            continue
        em = max(ln["size"] for ln in c)
        if len(c) > 2 or wide(c) >= wide(body):
            return [(c, False) for c in cols]
        if max(ln["y"] for ln in c) <= low["y"] - max(em, low["size"]):
            feet.append(c)
        elif min(ln["y"] for ln in c) >= top["y"] + max(em, top["size"]):
            heads.append(c)
        else:
            return [(c, False) for c in cols]
    return [*((c, True) for c in heads), (body, False), *((c, True) for c in feet)]


def level(a, b):
    return abs(a["y"] - b["y"]) <= 0.3 * max(a["size"], b["size"])


def stretch_from(lines, at):
    a, gl, gr = lines[at], 0.0, -1.0
    for m in lines[at + 1 :]:
        if not level(a, m):
            break
        left, right = (a, m) if m["x0"] >= a["x0"] else (m, a)
        if right["x0"] > left["x1"]:
            gl, gr = left["x1"], right["x0"]
    if gr <= gl:
        return at
    end, sides, rows = at, {0: None, 1: None}, 0
    for m in lines[at:]:
        if m["x0"] < gl and max(gl, m["x1"]) < gr:
            side, gl = 0, max(gl, m["x1"])
        elif m["x0"] >= gl:
            side, gr = 1, min(gr, m["x0"])
        else:
            break
        end += 1
        if sides[1 - side] is not None and level(sides[1 - side], m):
            rows, sides = rows + 1, {0: None, 1: None}
        else:
            sides[side] = m
    return end if rows >= 3 else at


def naive_groups(lines):
    """seq: (col, running, stretch, row, cell), and the paragraphs in reading order."""
    where, paras = {}, []
    for n, (col, is_running) in enumerate(running(islands(lines))):
        col = sorted(col, key=lambda ln: (-ln["y"], ln["seq"]))
        steps = [a["y"] - b["y"] for a, b in zip(col, col[1:])]
        right, typical = max(ln["x1"] for ln in col), statistics.median(steps) if steps else 0.0
        found, at, rest = [], 0, []
        while at < len(col):
            end = stretch_from(col, at)
            if end > at:
                found.append(col[at:end])
                at = end
            else:
                rest.append(col[at])
                at += 1

        def broken(part, edge):
            out = [[part[0]]]
            for a, b in zip(part, part[1:]):
                em = max(a["size"], b["size"])
                if abs(a["size"] - b["size"]) > 0.1 * em or len(steps) >= 2 and a["y"] - b["y"] > 1.25 * typical or b["x0"] > a["x0"] + 0.5 * em or edge - a["x1"] > b["first_word"] + 0.5 * em:  # noqa: B023
                    out.append([])
                out[-1].append(b)
            return out

        pieces, last = [], None
        for k, ln in enumerate(rest):  # what is not in a stretch, cut where one stands between
            past = sum(s[0]["y"] > ln["y"] or s[0]["y"] == ln["y"] and s[0]["seq"] < ln["seq"] for s in found)
            if k and past == last:
                pieces[-1][1].append(ln)
            else:
                pieces.append(((-ln["y"], 0, ln["seq"]), [ln]))
            last = past
        own = [(key, p) for key, piece in pieces for p in broken(piece, right)]
        own = [((-p[0]["y"], 0, p[0]["seq"]), p) for _, p in own]
        for k, s in enumerate(found, 1):
            rows = [[s[0]]]
            for i in range(1, len(s)):
                if not level(s[i - 1], s[i]) and i + 1 < len(s) and level(s[i], s[i + 1]):
                    rows.append([])
                rows[-1].append(s[i])
            for r, row in enumerate(rows):
                cells = islands(row)
                for c, cell in enumerate(cells):
                    edge = min(ln["x0"] for ln in cells[c + 1]) if c + 1 < len(cells) else right
                    cell = sorted(cell, key=lambda ln: (-ln["y"], ln["seq"]))
                    for p in broken(cell, edge):
                        own.append(((-s[0]["y"], k, r, c, -p[0]["y"], p[0]["seq"]), p))
                    where |= {ln["seq"]: (n, is_running, k, r, c) for ln in cell}
        where |= {ln["seq"]: (n, is_running, 0, 0, 0) for ln in rest}
        paras += [p for _, p in sorted(own, key=lambda e: e[0])]
    return where, paras


def pages_of(rows):
    pages = defaultdict(list)
    for r in rows:
        pages[r["doc_id"], r["page"]].append(r)
    return pages


def same_layout(got, runs):
    found, pages = pages_of(r.asDict() for r in got), pages_of(runs)
    assert set(found) == {k for k, rs in pages.items() if any(r["text"].strip() for r in rs)}
    for key, rows in found.items():
        lines = naive_lines(pages[key])
        where, paras = naive_groups(lines)
        text = {ln["seq"]: ln["text"] for ln in lines}
        assert {r["seq"]: (r["col"], r["running"], r["stretch"], r["row"], r["cell"]) for r in rows} == where, key
        rows.sort(key=lambda r: r["place"])
        assert [(r["seq"], r["para"]) for r in rows] == [(ln["seq"], k) for k, p in enumerate(paras, 1) for ln in p], key
        assert all(r["text"] == text[r["seq"]] for r in rows)


def test_runs_join_into_lines_and_a_column_gap_splits_them(spark):
    item = [run("second item with ", 90, 624.6, 86.17, 11, 0), run("•", 72, 624.6, 3.7, 11, 1), run("bold ", 176.17, 624.6, 24.24, 11, 2), run(" ", 300, 624.6, 3, 11, 3)]
    assert [r.text for r in G.lines_of(frame(spark, item)).collect()] == ["• second item with bold"]
    cols = [run("left column", 56.8, 685.4, 229.4, 12, 0), run("right column", 324.1, 685.4, 231.1, 12, 1)]
    assert G.lines_of(frame(spark, cols)).count() == 2
    marks = [run("text", 72, 500, 24, 12, 0), run("2", 96.5, 505, 4, 7, 1), run("a", 72, 404, 3, 6, 2), run("note", 75.5, 400, 30, 10, 3), run("____", 110, 500, 60, 60, 4)]
    assert sorted(r.text for r in G.lines_of(frame(spark, marks)).collect()) == ["____", "anote", "text2"]


def scattered(seed, pages):
    r = random.Random(seed)
    out = []
    for page in range(pages):
        many = r.randrange(1, 60)
        for seq in range(many):
            x, y = r.choice([60, 60, 100, 250, 250.3, 400]) + r.choice([0, 0, 3, 40]), 700 - 12 * r.randrange(14) - r.choice([0, 0, 0, 2, -4])
            text = r.choice(["ab", "two words", "x....", "—", "_", "long text of words", " ", "1"])
            out.append(run(text, x, y, 5 * len(text), r.choice([10, 10, 10, 10.5, 6, 36]), seq) | {"page": page})
    return out


def test_scattered_pages(spark):
    runs = scattered(1, 120)
    same_layout(G.grouped(G.lines_of(frame(spark, runs))).collect(), runs)


def table_page():
    """A heading over rows of three cells, prose below, a footer."""
    out = [run("A heading over the whole width of it", 60, 720, 400, 14, 0)]
    for k in range(5):
        out += [run(f"label {k}", 60, 690 - 14 * k, 60, 10, 10 + 3 * k), run("amount", 200, 690 - 14 * k, 60, 10, 11 + 3 * k), run("and what it is", 330, 690 - 14 * k, 90, 10, 12 + 3 * k)]
    out.append(run("more of it", 330, 620, 60, 10, 50))
    out += [run("prose that fills the measure right up to the edge", 60, 590 - 12 * k, 400, 10, 60 + k) for k in range(3)]
    return [*out, run("3", 500, 40, 6, 10, 99)]


def test_rows_of_cells_stand_in_their_column(spark):
    runs = table_page()
    got = G.grouped(G.lines_of(frame(spark, runs))).collect()
    same_layout(got, runs)
    assert sum(r.stretch == 1 for r in got) >= 15 and [r.text for r in got if r.running] == ["3"]


def test_run_grouping(spark):
    """And run_lines, over documents' words."""
    runs = [r.asDict() for r in Q.word_runs(spark, FOLDER).where("doc_id < 120").collect()]
    got = [r for r in Q.QUERIES["run_grouping"](spark, FOLDER).where("doc_id < 120").collect()]
    same_layout(got, runs)
    assert any(r.stretch for r in got) and any(r.running for r in got)
    lines = pages_of(r.asDict() for r in Q.QUERIES["run_lines"](spark, FOLDER).where("doc_id < 120").collect())
    for key, page in pages_of(runs).items():
        assert {ln["seq"]: (ln["text"], ln["runs"], ln["y"]) for ln in lines[key]} == {ln["seq"]: (ln["text"], ln["runs"], ln["y"]) for ln in naive_lines(page)}


def naive_tables(runs, grids):
    """Of a page: grids as (grid, filled, reason, before), cells, paragraphs."""
    runs = [r for r in runs if r["text"].strip()]
    frames = {g["grid"]: (g["xs"][0], g["ys"][-1], g["xs"][-1], g["ys"][0]) for g in grids}
    shape = {g["grid"]: g for g in grids}
    order = sorted(frames, key=lambda g: (-frames[g][3], frames[g][0], g))
    inside = defaultdict(list)
    for r in runs:
        x, y = (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2
        for g in order:
            a = frames[g]
            if a[0] <= x <= a[2] and a[1] <= y <= a[3]:
                inside[g].append((sum(e > y or e == y for e in shape[g]["ys"][1:-1]), sum(e <= x for e in shape[g]["xs"][1:-1]), r))
                break
    out, taken, cells, kept = [], set(), {}, []
    for g in order:
        a = frames[g]
        slots = (len(shape[g]["xs"]) - 1) * (len(shape[g]["ys"]) - 1)
        filled = len({c[:2] for c in inside[g]})
        overlaps = any(h != g and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for h, b in frames.items())
        reason = "" if 4 * filled < slots else "nested" if overlaps else "turned" if any(c[2]["turned"] for c in inside[g]) else None
        out.append([g, filled, reason, None])
        if reason is None:
            kept.append(g)
            taken |= {c[2]["seq"] for c in inside[g]}
            by = defaultdict(list)
            for row, col, r in inside[g]:
                by[row, col].append(r)
            for at, own in by.items():
                cells[g, *at] = "\n".join(ln["text"] for ln in sorted(naive_lines(own), key=lambda ln: (-ln["y"], ln["seq"])))
    rest = [r for r in runs if r["seq"] not in taken]
    where, paras = naive_groups(naive_lines(rest)) if rest else ({}, [])
    for g in kept:
        a, split = frames[g], []
        for p in paras:
            split.append([p[0]])
            for m, n in zip(p, p[1:]):
                if m["y"] >= a[3] and n["y"] < a[1] and min(m["x0"], n["x0"]) < a[2] and max(m["x1"], n["x1"]) > a[0]:
                    split.append([])
                split[-1].append(n)
        paras = split
    for row in out:
        if row[2] is None:
            a, before = frames[row[0]], len(paras)
            for k, p in enumerate(paras):
                x0, x1 = min(ln["x0"] for ln in p), max(ln["x1"] for ln in p)
                shares = where[p[0]["seq"]][1] or x0 < a[2] and x1 > a[0]
                if shares and p[0]["y"] < a[3] or not shares and x0 >= a[2]:
                    before = k
                    break
            row[3] = before
    return {tuple(r) for r in out}, cells, [[ln["seq"] for ln in p] for p in paras]


def same_tables(spark, runs, grids):
    frames = spark.createDataFrame([(g["doc_id"], g["page"], g["grid"], g["xs"], g["ys"]) for g in grids], "doc_id long, page int, grid int, xs array<double>, ys array<double>")
    lines, cells, found = (pages_of(r.asDict() for r in df.collect()) for df in G.tables_in_layout(frame(spark, runs), frames))
    by = pages_of(grids)
    for key, page in pages_of(runs).items():
        want = naive_tables(page, by.get(key, []))
        assert {(g["grid"], g["filled"], g["reason"], g["before"]) for g in found.get(key, [])} == want[0], key
        assert {(c["grid"], c["row"], c["col"]): c["text"] for c in cells.get(key, [])} == want[1], key
        paras = defaultdict(list)
        for ln in sorted(lines.get(key, []), key=lambda ln: ln["place"]):
            paras[ln["para"]].append(ln["seq"])
        assert [paras[k] for k in sorted(paras)] == want[2], key
    return {g["reason"] for gs in found.values() for g in gs}


def test_tables_on_scattered_pages(spark):
    runs, r = scattered(5, 60), random.Random(6)
    runs = [x | {"turned": x["page"] % 9 == 0 and x["seq"] == 3} for x in runs]
    grids = []
    for page in range(60):
        for grid in range(r.randrange(3)):
            xs = sorted(r.sample(range(50, 460, 30), r.randrange(3, 5)))
            ys = sorted(r.sample(range(530, 715, 9), r.randrange(3, 6)), reverse=True)
            grids.append({"doc_id": 1, "page": page, "grid": grid, "xs": list(map(float, xs)), "ys": list(map(float, ys))})
    assert same_tables(spark, runs, grids) == {None, "", "nested", "turned"}


def test_tables_in_layout(spark):
    """And table_cells, over documents' words."""
    where = "doc_id < 100 AND doc_id % 4 = 1"
    runs = [r.asDict() for r in Q.word_runs(spark, FOLDER).where(where).collect()]
    grids = pages_of(r.asDict() for r in Q.page_grids(spark, FOLDER).where(where).collect())
    found = pages_of(r.asDict() for r in Q.QUERIES["tables_in_layout"](spark, FOLDER).where(where).collect())
    cells = pages_of(r.asDict() for r in Q.QUERIES["table_cells"](spark, FOLDER).where(where).collect())
    for key, page in pages_of(runs).items():
        want = naive_tables(page, grids[key])
        assert {(g["grid"], g["filled"], g["reason"], g["before"]) for g in found[key]} == want[0]
        assert {(c["grid"], c["row"], c["col"]): c["text"] for c in cells.get(key, [])} == want[1]
        assert (found[key][0]["lines"], found[key][0]["paras"]) == (sum(map(len, want[2])), len(want[2]))


def test_pages_of_nothing(spark):
    none = frame(spark, [])
    assert G.grouped(G.lines_of(none)).collect() == []
    grids = spark.createDataFrame([], "doc_id long, page int, grid int, xs array<double>, ys array<double>")
    assert [df.collect() for df in G.tables_in_layout(none, grids)] == [[], [], []]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_lines_deals_documents_once(spark):
    """Words are never dealt: one exchange, of documents, below all that makes and joins them, and no cut."""
    plan = plan_of(Q.QUERIES["run_lines"](spark, FOLDER))
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan and "/rounds/" not in plan
    below = plan[plan.index("Exchange") :]
    assert "MapInArrow" not in below and "documents.parquet" in below


def test_pages_that_batches_cut(spark):
    """Lines are the same wherever Arrow's batches end, dealt before or here."""
    runs = frame(spark, scattered(3, 40))
    want = sorted(map(tuple, G.lines_of(runs).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        dealt = runs.coalesce(1).sortWithinPartitions("doc_id", "page")
        assert sorted(map(tuple, G.lines_of(runs).collect())) == sorted(map(tuple, G.lines_of(dealt, dealt=True).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_words_of_pages(spark):
    """Words, what stands before them, and where a page's first word is, of texts cut over many batches."""
    import pyarrow as pa

    texts = ["one two\tthree", "", None, " ".join(f"w{k}" for k in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    limit, Q.WORDS_AT_ONCE = Q.WORDS_AT_ONCE, 100
    try:
        got = [tuple(r.values()) for b in Q.words_of([batch]) for r in b.to_pylist()]
    finally:
        Q.WORDS_AT_ONCE = limit
    want = []
    for doc, text in enumerate(texts):
        off, before = 0, None
        for seq, word in enumerate((text or "").split()):
            want.append((doc, seq, word, off, before))
            off, before = off + len(word) + 1, off
    assert got == want


def test_layouts_deal_documents_once(spark):
    """What is made of lines and grids needs no exchange of its own, and no cut."""
    for name in ("run_grouping", "table_cells", "tables_in_layout"):
        plan = plan_of(Q.QUERIES[name](spark, FOLDER))
        assert plan.count("Exchange") == 1 and not any(w in plan for w in ("Sort", "Window", "Join", "Aggregate", "/rounds/")), name
        assert "MapInArrow" not in plan[plan.index("Exchange") :], name


def test_grids_that_come_with_their_pages(spark):
    """The layout is the same with grids among the runs of dealt pages as with grids of their own."""
    runs, r = [x | {"turned": False} for x in scattered(8, 30)], random.Random(2)
    grids = [(1, p, g, sorted(map(float, r.sample(range(50, 460, 30), 3))), sorted(map(float, r.sample(range(530, 715, 9), 3)), reverse=True)) for p in range(32) for g in range(r.randrange(3))]
    own, frames = frame(spark, runs), spark.createDataFrame(grids, "doc_id long, page int, grid int, xs array<double>, ys array<double>")
    both = own.unionByName(frames, allowMissingColumns=True).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")
    key = lambda r: tuple((x is None, x) for x in r)
    for a, b in zip(G.tables_in_layout(own, frames), G.tables_in_layout(both)):
        want = sorted(map(tuple, a.collect()), key=key)
        assert want == sorted(map(tuple, b.collect()), key=key) and want
