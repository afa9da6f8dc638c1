"""Packages and folds, a bounded piece of a batch at a time."""

import io
import zipfile

import pyarrow as pa
import pytest

from quirespark.functions import arrow
from quirespark.operators import rules
from quirespark.sources import office, packages


def test_plain_values():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string()))]))
    own = pa.array([[{"a": 1, "b": ["x", None]}, {"a": None, "b": None}], None, [], [{"a": 2, "b": []}]], kind)
    assert arrow.plain(own) == [[(1, ["x", None]), (None, None)], None, [], [(2, [])]]
    assert arrow.plain(own.slice(1)) == [None, [], [(2, [])]]


def test_pieces_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(arrow, "PIECE", 64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * 30] * 100)], ["k", "t"])
    parts = list(arrow.pieces(batch))
    assert len(parts) > 20 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(100))


@pytest.mark.parametrize("kind", sorted(office.GRIDS))
def test_fixed_members_are_packed_once(monkeypatch, kind):
    office.GRIDS[kind]([["a"]])
    calls, packed = [], office.packed
    monkeypatch.setattr(office, "packed", lambda name, text: calls.append(name) or packed(name, text))
    assert office.cells_of(office.GRIDS[kind]([["=a", " b  c "], ["", "é<&\x01"]]), kind) == [["=a", " b  c "], ["", "é<&"]]
    assert len(calls) == 1


@pytest.mark.parametrize("kind", sorted(office.WRITERS | office.GRIDS))
def test_packages_are_plain_archives(kind):
    content = office.GRIDS[kind]([["a", "x" * 9000]]) if kind in office.GRIDS else office.WRITERS[kind]([("heading", 1, "", " a  b "), ("text", 1, "", "x" * 9000)])
    whole = zipfile.ZipFile(io.BytesIO(content))
    assert whole.testzip() is None
    own, other = packages.opened(content), packages.Zipped(io.BytesIO(content))
    assert isinstance(own, packages.Archive) and own.namelist() == whole.namelist()
    for name in whole.namelist():
        assert own.read(name) == other.read(name) == whole.read(name) and own.read(name, 5) == whole.read(name)[:5]


def test_other_archives_go_to_zipfile():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_BZIP2) as archive:
        archive.writestr("a.txt", "text")
        archive.comment = b"said"
    found = packages.opened(out.getvalue())
    assert isinstance(found, packages.Zipped) and found.read("a.txt") == b"text"
    good = office.zipped([("a.txt", "text " * 50)])
    broken = good[:45] + bytes([good[45] ^ 255]) + good[46:]
    with pytest.raises(Exception):
        packages.opened(broken).read("a.txt")
    with pytest.raises(zipfile.BadZipFile):
        packages.opened(b"PK\x03\x04broken")


def large_rows(spark, n=40):
    return spark.range(n).coalesce(1).selectExpr("id AS doc_id", "repeat('x', 1000) AS text")


def sizes(monkeypatch, batches):
    """The batches that a step's Arrow function gives for the rows of one batch."""
    monkeypatch.setattr(arrow, "PIECE", 4096)
    return [b.num_rows for b in batches]


class Taken:
    """Stands for a DataFrame and keeps the function that it is given."""

    def __init__(self, df):
        self.schema, self.run = df.schema, None

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802  Spark's name
        return run


def test_packages_are_made_in_pieces(spark, monkeypatch):
    df = large_rows(spark)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([[["x" * 1000]]] * 40)], ["doc_id", "grid"])
    run = office.made(Taken(df), "doc_id", "grid", lambda g: office.xlsx(g), "content", "binary")
    found = sizes(monkeypatch, run(iter([batch])))
    assert sum(found) == 40 and max(found) <= 5


def test_folds_are_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(arrow, "PIECE", 4096)
    found = rules.by_document(large_rows(spark), ["text"], lambda rows: [(len(rows[0][0]),)], "n long").collect()
    assert sorted(tuple(r) for r in found) == [(k, 1000) for k in range(40)]


def test_pipe_choices_are_found_once(spark):
    from quirespark.functions import text as T
    from quirespark.plans import scalars

    plan = scalars.QUERIES["pipe_choices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "transform" in line]
    lines = {"a b | c": "a b|c", "pay $5 now Éa | 2 |": "Éa|2", "x: 1\xa02 |  | z\tq": "1 2|z q", "no (a|b) | one Two $3 4 | w": "3|", "": "", " | ": "", "_ a | b : c | d": "a|b", "1 2 b c|d": "b c|d"}
    lines["no (a|b) | one Two $3 4 | w"] = "$3 4|w"
    own = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r[0]: r[1] for r in own.selectExpr("line").select("line", scalars.F.array_join(T.pipe_choices(scalars.F.col("line")), "|")).collect()} == lines


def test_small_files_share_a_batch(spark):
    from quirespark.sources import pdf

    content = [pdf.write_pdf([[(72, 700, 10, f"line {k}")]]) if k != 3 else b"no file" for k in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(content)], ["doc_id", "content"])
    run = pdf.pdf_runs(Taken(large_rows(spark)))
    found = list(run(iter([batch])))
    assert len(found) == 1
    assert [(r["doc_id"], r["text"], r["refusal"]) for r in found[0].to_pylist()] == [(k, None, "no header") if k == 3 else (k, f"line {k}", None) for k in range(10)]


def test_spaced_strings_move_on_by_state():
    from quirespark.sources import pdf

    body = b"BT /F1 10 Tf 2 Tc 3 Tw 50 Tz 1 2 0 1 5 6 Tm [(a b) -300 (c)] TJ ET"
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F1<</Subtype/Type1/FirstChar 97/Widths[700 600]>>>>>>>>", 4: b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body)}
    doc = pdf.Document(b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer\n<</Root 1 0 R>>\n")
    (run,) = pdf.runs_of(doc, doc.pages()[0])
    moved = ((7 + 2) + (5 + 2 + 3) + (6 + 2) + 3 + (5 + 2)) * 0.5
    assert run["text"] == "a b c" and run["x0"] == 5 and run["x1"] == pytest.approx(5 + moved)


def test_verdicts_are_one_row_a_document_until_told_apart(spark):
    from quirespark.operators import clauses as C

    rows = spark.createDataFrame([(1, 5), (1, 7), (2, None), (None, 1), (9, 9)], "doc_id long, n int")
    docs = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "doc_id long")
    rules = [(f"c{k}", f"n >= {k}", f"n > {k + 4}") for k in range(70)]
    want = set()
    for doc, own in ((1, [5, 7]), (2, []), (3, []), (None, [])):
        for k in range(70):
            asked = [n for n in own if n >= k]
            want.add((doc, f"c{k}", "not applicable" if not asked else "pass" if all(n > k + 4 for n in asked) else "fail"))
    found = C.judged(rows, rules, docs)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    same = C.judged(rows.where("doc_id < 9"), rules, docs.where("doc_id < 3"))
    assert {tuple(r) for r in same.collect()} == {w for w in want if w[0] in (1, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Aggregate")


def test_delimiters_are_sniffed_once(spark):
    from quirespark.plans import rule_queries
    from quirespark.sources import formats

    plan = rule_queries.QUERIES["delimiter_sniff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3  # how Spark counts matches
    own = spark.createDataFrame([('"a,b,c"\nk;l;m,n',), ("x",), ("",), (None,), ("a\tb\n\n",), ("p,q;r\ns",)], "t string")
    rows = [tuple(r) for r in own.select(formats.delimiter(own.t), formats.padded_csv(own.t, formats.delimiter(own.t))).collect()]
    assert rows == [(";", [['"a,b,c"', "", ""], ["k", "l", "m,n"]]), (",", [["x"]]), (",", [[""]]), (",", None), ("\t", [["a", "b"]]), (",", [["p", "q;r"], ["s", ""]])]


def test_words_are_compared_where_texts_meet(spark):
    from quirespark.operators import matching

    left = spark.createDataFrame([(1, "a b b"), (1, "c"), (2, None), (3, " \t"), (4, "x")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "b a c b"), (2, "y y"), (5, "z")], "doc_id long, text string")
    found = matching.same_words(left, right)
    assert sorted(tuple(r) for r in found.collect()) == [(1, True, 0, 0), (2, False, 0, 2), (4, False, 1, 0), (5, False, 0, 1)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_dealt_before_they_are_repeated(spark):
    from quirespark.plans import structure_queries

    plan = structure_queries.QUERIES["structure_read"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(k for k, line in enumerate(plan) if "RepartitionByExpression [doc_id" in line)
    assert any("Generate explode(up" in line for line in plan[:dealt])
