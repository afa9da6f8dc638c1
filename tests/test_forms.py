"""Queries without SQL against plain loops over the same tables."""

import hashlib
import html.parser
import itertools
import pathlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quirespark.operators import choices, clauses
from quirespark.plans import catalogue, form_queries

FOLDER = "/root/testdata/sf0.001"
Q = catalogue.queries()


def rows(table, columns, where="true"):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet' WHERE {where}").fetchall()


def got(spark, name):
    return [tuple(r) for r in Q[name](spark, FOLDER).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Choices.

WANT = [
    [("run", "Youth|Teen|Adult|Senior|Family")],
    [("circle one", "Male|Female"), ("slashes", "Male|Female")],
    [("circle one", "Checking|Savings|Visa|MC"), ("yes or no", "Y|N"), ("yes or no", "Y|N")],
    [("pipes", "$5|$10|$25"), ("run", "Red|Green|Blue")],  # the row above has a colon, and a word above the first
    [],
]


def test_form_choices(spark):
    found = defaultdict(list)
    for doc, _, k, rule, options in sorted(got(spark, "form_choices")):
        found[doc].append((rule, options))
    for (doc,) in rows("part", "p_partkey"):
        assert found[doc] == WANT[doc % 5], (doc, found[doc])


def words_at(line, y=0.0, step=40.0, h=10.0):
    return [choices.Word(t, k * step, k * step + min(30.0, 4.0 * len(t)), y, h) for k, t in enumerate(line.split())]


def texts(found):
    return ["|".join(t for t, _ in options) for _, options in found]


def test_runs_need_a_label_even_gaps_and_distinct_words():
    assert texts(choices.choices_of(words_at("Kind: Red Green Blue"))) == ["Red|Green|Blue"]
    assert not choices.choices_of(words_at("Kind Red Green Blue")) and not choices.choices_of(words_at("Kind: Red Green Red")) and not choices.choices_of(words_at("Kind: Red Of Blue"))
    assert texts(choices.choices_of([*words_at("Kind: x", 0.0), *[choices.Word(w.text, w.x0, w.x1, 20.0, w.h) for w in words_at("Red Green Blue")]])) == ["Red|Green|Blue"]  # the label is above
    assert not choices.spaced_runs(choices.rows_of(words_at("Kind: Red Green Blue")), [(0.0, -5.0, 300.0, 5.0)])


def test_a_cue_looks_at_near_rows_only():
    near, far = words_at("( circle one )"), [choices.Word(w.text, w.x0, w.x1, 90.0, w.h) for w in words_at("Male/Female")]
    assert not choices.circle_one(choices.rows_of([*near, *far]))


# Shapes.


def boxes():
    out = defaultdict(list)
    for o, k, p, s, q in rows("lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"):
        x, y = (p % 7) * 3.0, (s % 5) * 4.0
        out[o].append((k, "line" if k % 4 == 0 else "rect", x + (0.0004 if k % 3 == 0 else 0), y, x + q % 11 + 2, y + q % 5 + 2))
    return {o: sorted(b) for o, b in out.items()}


def test_shape_dedupe(spark):
    want = {}
    for o, own in boxes().items():
        kept = []
        for b in sorted(own, key=lambda b: (b[3], b[2], b[5], b[4], b[1])):
            if all(k[1] != b[1] or max(abs(x - y) for x, y in zip(k[2:], b[2:])) > 0.0006 for k in kept):
                kept.append(b)
        want[o] = (len(own), len(kept))
    assert {r[0]: r[1:] for r in got(spark, "shape_dedupe")} == want


def test_union_areas(spark):
    want = {}
    for o, own in boxes().items():
        cells = [(x, y) for b in own for x in range(round(b[2]), round(b[4])) for y in range(int(b[3]), int(b[5]))]
        want[o] = (len(set(cells)), len(cells))
    assert {r[0]: r[1:] for r in got(spark, "union_areas")} == want


def test_group_dedupe(spark):
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    want = {}
    for o, own in boxes().items():
        kept = []
        for k, b in enumerate(own):
            both = [area((max(b[2], c[2]), max(b[3], c[3]), min(b[4], c[4]), min(b[5], c[5]))) / min(area(b[2:]), area(c[2:])) for c in (own[j] for j in kept)]
            if not any(x > 0.5 for x in both):
                kept.append(k)
        want[o] = ",".join(map(str, kept))
    assert dict(got(spark, "group_dedupe")) == want


def test_merged_rules(spark):
    want = Counter()
    for o, own in boxes().items():
        for y in {b[3] for b in own}:
            reach = None
            for lo in sorted(round(b[2]) for b in own if b[3] == y):
                if reach is None or lo > reach[1] + 1:
                    if reach:
                        want[o, f"{y:g}", *reach] += 1
                    reach = (lo, lo + 30)
                reach = (reach[0], max(reach[1], lo + 30))
            want[o, f"{y:g}", *reach] += 1
    assert Counter(got(spark, "merged_rules")) == want


def test_ruled_grids(spark):
    want = Counter()
    for o, own in boxes().items():
        merged = lambda pairs, n: [(at, lo, hi) for at in sorted({a for a, _ in pairs}) for lo, hi in spans(sorted((x, x + n) for a, x in pairs if a == at))]
        across, upright = merged([(b[3], round(b[2])) for b in own], 30), merged([(round(b[2]), b[3] - 2) for b in own], 22)
        cross = {(i, j) for i, h in enumerate(across) for j, v in enumerate(upright) if h[1] - 1 <= v[0] <= h[2] + 1 and v[1] - 1 <= h[0] <= v[2] + 1}
        left = set(range(len(across)))
        while left:
            hs, n = {min(left)}, 0
            while len(hs) != n:
                n = len(hs)
                vs = {j for i, j in cross if i in hs}
                hs |= {i for i, j in cross if j in vs}
            left -= hs
            if len(hs) >= 3 and len(vs) >= 3:
                want[o, len(hs) - 1, len(vs) - 1, all((i, j) in cross for i in hs for j in vs)] += 1
    assert Counter(got(spark, "ruled_grids")) == want


def spans(pairs):
    out = []
    for lo, hi in pairs:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def test_field_proposals_overlap_nothing(spark):
    found = defaultdict(list)
    for o, kind, box in got(spark, "field_proposals"):
        found[o].append((kind, tuple(map(int, box.split()))))
    assert found
    for o, own in boxes().items():
        taken = [tuple(map(round, own[0][2:]))]
        for kind, b in found[o]:
            w, h = b[2] - b[0], b[3] - b[1]
            assert kind == "check" and 5 <= w <= 20 and 5 <= h <= 20 and abs(w - h) <= 4 or kind == "text" and w >= 14 and h == 15
            assert all(min(b[2], t[2]) - max(b[0], t[0]) <= 0 or min(b[3], t[3]) - max(b[1], t[1]) <= 0 for t in taken)
            taken.append(b)


# Small operators.


def test_cap_refusals(spark):
    def want(k):
        size, lines, r, c = k * k * 9000, k * 17, k * 41 % 12_000, k % 300
        from quirespark.sources import formats as S

        caps = (("input too large", size > S.INPUT_BYTES), ("text too large", k % 2 == 0 and size > S.TEXT_BYTES), ("too many lines", k % 2 == 0 and lines > S.TEXT_LINES), ("too many rows", r > S.CSV_ROWS), ("too many columns", c > S.CSV_COLUMNS), ("too many cells", r * c > S.CSV_CELLS))
        return next((why for why, bad in caps if bad), None)

    found = dict(got(spark, "cap_refusals"))
    assert found == {k: want(k) for (k,) in rows("part", "p_partkey")}


def test_broken_lines(spark):
    found = defaultdict(dict)
    for doc, n, line in got(spark, "broken_lines"):
        found[doc][n] = line
    for k, text in rows("part", "p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type"):
        lines = [found[k][n] for n in range(len(found[k]))]
        assert " ".join(lines) == text and all(len(x) <= 40 or " " not in x for x in lines)
        assert all(len(f"{a} {b.split(' ')[0]}") > 40 for a, b in itertools.pairwise(lines))


def test_word_alignment(spark):
    for k, n, first, last in got(spark, "word_alignment"):
        ((name, kind),) = rows("part", "p_name, p_type", f"p_partkey = {k}")
        old = f"{name} {kind} {name}"
        new = (re.sub("([A-Za-z]+ )([A-Za-z]+ )", r"\2", old) + " end").split()
        old = old.split()
        best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, j in itertools.product(range(len(old)), range(len(new))):
            best[i + 1][j + 1] = best[i][j] + 1 if old[i] == new[j] else max(best[i][j + 1], best[i + 1][j])
        assert n == best[-1][-1] and (n == 0 or old[first] in new and new[last] in old)


def test_content_edits(spark):
    want = [
        ("word,name,number,word,string,word,word,comment", "BT /F1 12 Tf () Tj ET % end\n"), ("open,string,number,string,close,word,open,name,name,close,open,number,number,close,number,number,number,word", "[() -120.5 ()] TJ <</Span/A>> <4 1> .5 0 0 rg"),
        ("word,number,number,number,number,number,number,word,name,word,word", "q 1 0 0 1 72 720 cm /Im1 Do Q"), ("string", "()"), ("hex,word,word", "<41> ' \" T* }{"),
    ]
    for k, kinds, emptied in got(spark, "content_edits"):
        assert emptied == want[k % 5][1]
        if k % 5 in (0, 2, 3):
            assert kinds == want[k % 5][0]


def test_epub_package(spark):
    from quirespark.plans import sink_queries

    text = defaultdict(list)
    for r in sink_queries.blocks(spark, FOLDER).collect():
        text[r.doc_id].append((r.pos, f"{r.marker} {r.text}" if r.kind == "item" and r.marker else r.text))
    whole = {d: " ".join(" ".join(t for _, t in sorted(own)).split()) for d, own in text.items()}
    for doc, words, digest, refusal in got(spark, "epub_package"):
        assert refusal is None and words == len(whole[doc].split()) and digest == sha(whole[doc])


# Clauses of tables.


def naive_table(cells):
    """A grid of slots as a dictionary; the order of checks as told in words."""
    lines = defaultdict(list)
    for c in sorted(cells):
        lines[c[0]].append(c)
    lines = [[c for c in own if c[1] >= 0] for _, own in sorted(lines.items())]
    width, height, y = sum(c[3] for c in lines[0]), 0, 0
    while y < len(lines):
        step = lines[y][0][4] if lines[y] else 1
        height += step if lines[y] else 0
        y += step
    slots = {}
    for y, own in enumerate(lines):
        x = 0
        if not own:
            return "short", None
        for c in own:
            while (x, y) in slots:
                x += 1
            want = list(itertools.product(range(x, x + c[3]), range(y, y + c[4])))
            if max(u for u, _ in want) >= width:
                return "wide", None
            if max(v for _, v in want) >= height:
                return "tall", None
            if set(want) & set(slots):
                return "taken", None
            slots |= dict.fromkeys(want, c)
    if len(slots) != width * height:
        return "short", None
    heads = [c for c in slots.values() if c[2]]
    if any(not c[5] for c in heads):
        for (x, y), c in sorted(slots.items(), key=lambda e: (e[0][1], e[0][0])):
            reach = any(h[2] and (v == y and h[5] == "Row" or u == x and h[5] == "Column") for (u, v), h in slots.items())
            named = (c[7] or "").split()
            if not c[2] and (x, y) != (0, 0) and not reach and not (named and set(named) <= {h[6] for h in heads}):
                return None, "unknown" if named else "unnamed"
    return None, None


def test_table_clauses(spark):
    own = defaultdict(list)
    for r in catalogue.clause_queries.cells(spark, FOLDER).collect():
        own[r.doc_id].append((r.row, r.pos, r.header, r.columns, r.rows, r.scope, r.id, r.headers))
    want = {d: naive_table(cells) for d, cells in own.items()}
    assert {d: (None if f == "regular" else f, h) for d, f, h, _ in got(spark, "ua_table_layouts")} == want
    assert len(set(want.values())) >= 6
    fault, heads = Counter(f for f, _ in want.values()), Counter(h for f, h in want.values() if f is None)
    counts = {(c, v): n for c, v, n in got(spark, "ua_table_clauses")}
    for clause, name in (("7.2 t15", "taken"), ("7.2 t41", "tall"), ("7.2 t42", "wide"), ("7.2 t43", "short")):
        assert counts.get((clause, "fail"), 0) == fault[name] and counts.get((clause, "pass"), 0) == len(want) - fault[name]
    for clause, name in (("7.5 t1", "unnamed"), ("7.5 t2", "unknown")):
        assert counts.get((clause, "fail"), 0) == heads[name] and counts.get((clause, "not applicable"), 0) == len(want) - fault[None]


def test_table_layout_by_hand():
    cell = lambda y, k, head=False, w=1, h=1, scope=None, id_=None, names=None: (y, k, head, w, h, scope, id_, names)
    assert clauses.table_layout([cell(0, 0, True, id_="a"), cell(0, 1, True, scope="Column"), cell(1, 0), cell(1, 1)]) == (None, "unnamed", 4)
    assert clauses.table_layout([cell(0, 0, True, id_="a"), cell(1, 0, names="b")])[:2] == (None, "unknown") and clauses.table_layout([cell(0, 0, True, id_="a"), cell(1, 0, names="a")])[:2] == (None, None)
    assert clauses.table_layout([cell(0, 0, w=3000, h=3000)])[0] == "unchecked"


# Text functions and rows.


def test_pipe_choices(spark):
    want = {}
    for doc, text in rows("documents", "doc_id, text"):
        for n, line in enumerate(text.split("\n")):
            stretches = re.split(r"(?:^|(?<=\s))\S*[_:()]\S*", f"{line} | red | 12")
            parts = next(p for p in ([x for x in (p.split() for p in s.split("|")) if x] for s in stretches if "|" in s) if len(p) >= 2)
            kind = lambda t: "n" if re.match(r"[$0-9]", t) else "w" if re.match("[A-Za-z]", t) else "o"
            first = [t for _, t in itertools.takewhile(lambda e: e[0] == kind(parts[0][-1]), ((kind(t), t) for t in reversed(parts[0])))][::-1]
            want[doc, n] = "|".join([" ".join(first), *map(" ".join, parts[1:])])
    assert {(d, n): o for d, n, o in got(spark, "pipe_choices")} == want


def test_natural_keys(spark):
    found = got(spark, "natural_keys")
    for page, key in found:
        ((url,),) = rows("pages", "url", f"page_id = {page}")
        assert key == "".join(p.zfill(20) if p.isdigit() else p for p in re.findall(r"[0-9]+|[^0-9]+", url.lower()))
    assert [k for _, k in found] == sorted(k for _, k in found)


def test_glyph_names(spark):
    want = ("A", "AB", "\U0001f600", "fi", None, None, "á")
    assert all(text == want[k % 7] for k, _, text in got(spark, "glyph_names"))


def test_segments_and_rows(spark):
    from quirespark.plans import layout_queries

    own = defaultdict(list)
    for r in layout_queries.words_of(spark, FOLDER).collect():
        own[r.doc_id, r.page].append(r)
    found = defaultdict(dict)
    for doc, page, seq, row in got(spark, "text_rows"):
        found[doc, page][seq] = row
    segments = Counter((doc, page) for doc, page, *_ in got(spark, "line_segments"))
    runs = Counter()
    for doc, page, *_, n in got(spark, "line_segments"):
        runs[doc, page] += n
    for key, items in own.items():
        firsts, want = [], {}
        for r in sorted(items, key=lambda r: (-r.y0, r.x0, r.seq)):
            k = next((k for k, y in enumerate(firsts) if abs(y - r.y0) <= max(6.0, 0.6 * r.size)), len(firsts))
            if k == len(firsts):
                firsts.append(r.y0)
            want[r.seq] = k
        assert found[key] == want and runs[key] == len(items) and segments[key] <= len(items)
    one = min(own)  # a page in full: each run joins the nearest open line, else opens one
    lines = []
    for r in sorted(own[one], key=lambda r: (r.x0, r.seq)):
        near = [ln for ln in lines if abs(ln[0] - r.y0) <= 0.3 * r.size and -0.5 * r.size <= r.x0 - ln[1] <= 1.5 * r.size]
        if near:
            best = min(near, key=lambda ln: (abs(ln[0] - r.y0), ln[2]))
            best[1] = max(best[1], r.x1)
        else:
            lines.append([r.y0, r.x1, r.seq])
    assert segments[one] == len(lines)


def test_search_wrapped(spark):
    from quirespark.plans import layout_queries

    pages = defaultdict(dict)
    for r in layout_queries.own_runs(spark, FOLDER).collect():
        pages[r.doc_id, r.page][r.seq] = r
    want, pattern = set(), r"[a-z]+\. ?[A-Z][a-z]+"
    for (doc, page), own in pages.items():
        for seq, r in own.items():
            chain = [r]
            while len(chain) < 3 and (after := own.get(seq + len(chain))) is not None and after.x0 < chain[-1].x1:
                chain.append(after)
                parts = [c.text for c in chain]
                hyphen = re.sub("[-‐\xad]\x01|\x01", "", "\x01".join(parts))
                for reading, s in (("space", " ".join(parts)), ("joined", "".join(parts)), ("hyphen", hyphen)):
                    for m in re.findall(pattern, s):
                        if not any(m in t for t in parts):
                            want.add((doc, page, seq, len(parts), reading, m, False))
    assert set(got(spark, "search_wrapped")) == want


def test_slash_templates(spark):
    tokens, marks = {}, set()
    for doc, text in rows("documents", "doc_id, text"):
        for row, line in enumerate(text.split("\n")):
            for pos, t in enumerate(line.split(" ")):
                tokens[doc, row, pos] = "red/blue" if row % 4 == 1 and pos == 2 else t
                if row % 4 == 0 and pos == 0:
                    marks.add((doc, row))
    slash = {}
    for (doc, row, pos), t in sorted(tokens.items()):
        if re.fullmatch("[^/]+(/[^/]+)+", t):
            slash.setdefault((doc, row), t)
    templates = {(doc, t) for doc, row in marks for t in [next((slash[doc, r] for r in (row, row + 1, row - 1) if (doc, r) in slash), None)] if t}
    assert set(got(spark, "slash_templates")) == {(*k, t) for k, t in tokens.items() if (k[0], t) in templates}


def test_figure_join(spark):
    from quirespark.plans import layout_queries

    own = defaultdict(list)
    for r in layout_queries.own_runs(spark, FOLDER).collect():
        own[r.doc_id, r.page].append(r)
    want = set()
    for (doc, page), items in own.items():
        items.sort(key=lambda r: r.seq)
        free = {r.seq: r for r in items if r.seq % 2 == 0}
        for f in (r for r in items if r.seq % 3 == 0):
            area = {k: max(0.0, min(f.x1, p.x1) - max(f.x0, p.x0)) * max(0.0, min(f.y1, p.y1) - max(f.y0, p.y0 - 3)) for k, p in free.items()}
            best = next(iter(free), None) if f.seq % 2 else max((k for k in area if area[k] > 0), key=area.get, default=None)
            free.pop(best, None)
            want.add((doc, page, f.seq, best))
    assert set(got(spark, "figure_join")) == want


def test_hyphen_evidence(spark):
    want = set()
    for doc, text in rows("documents", "doc_id, text"):
        own = re.sub(r"([^\W\d_]{3})([^\W\d_]{3}) ", r"\1-\n\2 ", text).split("\n")
        whole = {re.sub(r"^[\W_]+|[\W_]+$", "", t).lower() for line in own for t in re.split("[\t ]+", line)}
        for n, (a, b) in enumerate(itertools.pairwise(own)):
            if (x := re.search(r"([^\W\d_]+)[-‐\xad]$", a)) is None:
                continue
            joined = x[1] + (re.match(r"[^\W\d_]*", b)[0])
            if joined.lower() in whole:
                want.add((doc, n, joined))
    assert set(got(spark, "hyphen_evidence")) == want


def test_watch_settle_batch(spark):
    seen = defaultdict(dict)
    for user, event, value in rows("events", "user_id, event_id, value"):
        path, scan = user % 40, event % 25
        if path % 5 <= scan:
            size, ok = seen[path].get(scan, (-9, True))
            seen[path][scan] = max(size, int(__import__("math").fmod(round(value), 3))), ok and event % 4 != 0
    want = set()
    for path, own in seen.items():
        done, failed, before = 0 in own, None, None
        for scan in range(25):
            if scan not in own:
                done, failed, before = False, None, None
                continue
            size, ok = own[scan]
            if scan and size == before and not done and size != failed:
                want.add((f"f{path}", scan, "acted" if ok else "failed"))
                done, failed = ok, None if ok else size
            before = size
    assert set(got(spark, "watch_settle_batch")) == want


def test_watch_reacts(spark):
    seen = defaultdict(dict)
    for user, event in rows("events", "user_id, event_id"):
        own, scan = seen[user % 40], event % 25
        size, ok = own.get(scan, (-1, True))
        own[scan] = max(size, event % 50 // 12), ok and event % 4 != 0
    want = set()
    for path, own in seen.items():
        done, failed, before = None, None, None  # the size that is done
        for scan in range(25):
            if scan not in own:
                done, failed, before = None, None, None
                continue
            size, ok = own[scan]
            if scan == 0:
                done = size
            elif size == before and size not in (done, failed):
                want.add((f"f{path}", scan, "acted" if ok else "failed"))
                done, failed = (size, failed) if ok else (done, size)
            elif size != before:
                done = None
            before = size
    assert set(got(spark, "watch_reacts")) == want


def test_a_folder_is_watched_to_its_sidecars(spark, tmp_path):
    from quirespark.sources import door
    from quirespark.streaming import watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "old.pdf").write_bytes(b"old")
    scans = [watch.listed(spark, str(folder), 0).collect()]
    (folder / "new.pdf").write_bytes(b"new")
    scans += [watch.listed(spark, str(folder), k).collect() for k in (1, 2)]
    listings = spark.createDataFrame([r for s in scans for r in s], "path string, scan long, size long, mtime long, ok boolean")
    reports = watch.dispatched(watch.replay(listings), "ua", lambda acted: door.write_sidecars(acted.selectExpr("replace(path, 'file:', '') AS path", "concat('seen in scan ', scan) AS report")))
    assert [r.path.rpartition("/")[2] for r in reports.collect()] == ["new.pdf.ua.txt"]
    assert sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == ["new.pdf", "new.pdf.ua.txt", "old.pdf"]
    assert (folder / "new.pdf.ua.txt").read_text() == "seen in scan 2" and (folder / "new.pdf").read_bytes() == b"new"
    with pytest.raises(ValueError, match="no operation"):
        watch.dispatched(listings, "print", None)


def test_one_door_for_files(spark):
    from quirespark.plans import form_queries as FQ
    from quirespark.sources import door, office, pdf

    blocks = [("heading", 1, "", "A title"), ("item", 1, "1.", "first"), ("text", 1, "", "last <&> word")]
    text = "A title\n1. first\nlast <&> word"
    files = [("a.txt", b"plain", "plain"), ("b.html", b"<html><p>x<script>y</script></p>", "x"), ("c.pdf", pdf.write_pdf([[(1, 2, 3, "in a PDF")]]), "in a PDF"), ("d.docx", office.docx(blocks), text), ("e.odt", office.odt(blocks), text), ("f.pptx", office.pptx(blocks), text)]
    files += [("g.xlsx", office.xlsx([["=a", " b"], ["c", ""]]), "=a\t b\nc\t"), ("h.ods", office.ods([["=a", " b"]]), "=a\t b"), ("i.eml", b"From: a@b\nSubject: s\n\nbody", "body"), ("j.png", b"\x89PNG\r\n\x1a\n" + bytes(40), None), ("k.docx", b"PK\x03\x04broken", None), ("l.txt", b"a\x00b", None)]
    rows_ = [(k, n, bytearray(c)) for k, (n, c, _) in enumerate(files)]
    found = {r.file_id: r for r in door.imported(spark.createDataFrame(rows_, "file_id long, name string, content binary")).collect()}
    for k, (name, _, want) in enumerate(files):
        got_ = found[k].text
        assert (got_ and got_.strip("\n")) == want and (found[k].refusal is None) == (want is not None), (name, found[k])
    assert FQ.header("png", 3, 4)[:4] == b"\x89PNG"


# Sinks and sources.


def test_markdown_and_html_sinks(spark):
    from quirespark.plans import sink_queries

    own = defaultdict(list)
    for r in sink_queries.blocks(spark, FOLDER).collect():
        own[r.doc_id].append((r.pos, r.kind, r.marker, r.text))
    marked, tagged = {}, {}
    for doc, found in own.items():
        md, ht, before = "", "", None
        for _, kind, marker, text in sorted(found):
            body = re.sub(r"([\\`*_\[\]<>|~!])", r"\\\1", text)
            body = re.sub(r"^([0-9]+)([.)])", r"\1\\\2", re.sub(r"^([#>+=-])", r"\\\1", body))
            number = re.match("[0-9]+", marker or "")
            piece = {"item": f"{number[0]}. {body}" if number else f"- {body}", "heading": f"## {body}"}.get(kind, body)
            md += ("" if before is None else "\n" if kind == before == "item" else "\n\n") + piece
            tag = {"heading": "h2", "item": "li"}.get(kind, "p")
            ht += ("" if before is None else "\n") + f"<{tag}>" + text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;") + f"</{tag}>"
            before = kind
        marked[doc], tagged[doc] = md, '<!doctype html>\n<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="default-src \'none\'">\n' + ht
    assert {d: (n, s) for d, n, s in got(spark, "markdown_sink")} == {d: (len(t), sha(t)) for d, t in marked.items()}
    assert {d: (n, s) for d, n, s in got(spark, "html_sink")} == {d: (len(t), sha(t)) for d, t in tagged.items()}


class Plain(html.parser.HTMLParser):
    """Visible words and heads, by a counter of skipped elements."""

    def __init__(self):
        super().__init__()
        self.skip, self.words, self.title, self.heads, self.in_title = 0, [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "iframe", "form", "svg", "object", "noscript", "template")
        self.in_title = tag == "title" or self.in_title
        self.heads += bool(re.fullmatch("h[1-6]", tag)) and not self.skip

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "iframe", "form", "svg", "object", "noscript", "template") and self.skip > 0
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        (self.title if self.in_title else self.words if not self.skip else []).append(data)


def test_html_text(spark):
    from quirespark.sources import packages

    text = {r.page_id: r.text for r in packages.read_html(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    for r in Q["html_text"](spark, FOLDER).collect():
        ((page,),) = rows("pages", "html", f"page_id = {r.page_id}")
        plain = Plain()
        plain.feed(page or "")
        assert r.title == " ".join("".join(plain.title).split()) and r.headings == plain.heads
        assert "".join(text[r.page_id].split()) == "".join("".join(plain.words).split()) and (r.n_chars, r.digest) == (len(text[r.page_id]), sha(text[r.page_id]))


def test_ua_html_containment(spark):
    """Parents by an own stack of open elements, less the passed ones."""
    may = {"tr": "table thead tbody tfoot", "thead": "table", "tbody": "table", "tfoot": "table", "th": "tr", "td": "tr", "li": "ul ol", "caption": "table", "dt": "dl", "dd": "dl", "figcaption": "figure"}
    docs = defaultdict(lambda: defaultdict(list))
    for r in catalogue.rule_queries.html_elements(spark, FOLDER).collect():
        docs[r.doc_id][r.id] = (r.parent, r.name)
    want = Counter()
    for own in docs.values():
        verdicts = {}
        for parent, name in own.values():
            if name in may:
                while parent in own and own[parent][1] in ("div", "section", "span"):
                    parent = own[parent][0]
                ok = parent in own and own[parent][1] in may[name].split()
                verdicts[name] = verdicts.get(name, True) and ok
        if any(n not in ("div", "section", "span") for _, n in own.values()):
            want.update((f"7.2-{n}", {True: "pass", False: "fail", None: "not applicable"}[verdicts.get(n)]) for n in may)
    assert {(c, v): n for c, v, n in got(spark, "ua_html_containment")} == want


def test_mail_source(spark):
    want = {(c * 1000 + t, f"turn {t}", sha(text)) for c, t, text in rows("conversations", "conv_id, turn, text")}
    found = Q["mail_source"](spark, FOLDER).collect()
    assert {(r.file_id, r.subject, r.digest) for r in found} == want
    assert all(r["from"] == "é <a@b>" and r.kind == "plain" and r.attachments_dropped == 0 and r.refusal is None for r in found)


def test_classified_sources_and_counts(spark):
    found = got(spark, "classify_sources")
    assert len(found) == rows("documents", "count(*)")[0][0] and all((f is None) != (why is None) for _, _, f, why in found)
    lang = dict(rows("documents", "doc_id, lang"))
    want = Counter(("import.ok" if why is None else "import.refused", lang[d], f or why) for d, _, f, why in found)
    assert {tuple(r[:3]): r[3] for r in got(spark, "import_counts")} == want


@pytest.mark.parametrize("name", sorted(set(Q) - set(catalogue.oracle_sql())))
def test_no_query_is_without_a_comparison(name):
    """In this module or one beside it."""
    assert any(name in path.read_text() for path in pathlib.Path(__file__).parent.glob("test_*.py"))
