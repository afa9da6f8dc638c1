import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirespark.operators import layout, matching, pages, rules
from quirespark.sources import formats, packages
from quirespark.streaming import watch


def test_selection_grammar():
    assert [t["not"] for t in pages.parse_selection(["5", "2-9", "3-", "l-3", "even", "!3", "n3"])] == [False] * 5 + [True] * 2
    for bad in ("0", "x", "1-0"):
        with pytest.raises(ValueError):
            pages.parse_selection([bad])


def test_a_missing_single_page_refuses_and_a_range_is_clipped(spark):
    own = spark.range(1, 6).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"))
    assert [r.page for r in pages.selected(own, ["4-9"]).orderBy("page").collect()] == [4, 5]
    with pytest.raises(Exception, match="does not exist"):
        pages.selected(own, ["9"]).collect()


def test_table_grid():
    assert rules.table_grid([[(1, 1), (1, 1)], [(2, 1)]]) is None
    assert rules.table_grid([[(1, 1)], [(2, 1)]]) == "too wide"
    assert rules.table_grid([[(1, 1), (1, 3)], [(1, 1)]]) == "too tall"
    assert rules.table_grid([[(1, 1), (1, 1)], [(1, 1)]]) == "empty slots"


def test_longest_common_subsequence():
    assert rules.aligned_words("a b c d".split(), "b x d".split()) == [(1, 0), (3, 2)]


def test_text_rows_compare_with_the_first_item():
    items = [{"doc_id": 1, "page": 0, "seq": k, "x0": 0.0, "y0": y, "size": 10.0} for k, y in enumerate((100.0, 95.0, 89.5))]
    assert [r["row"] for r in layout.text_rows(items)] == [0, 0, 1]  # the third is near the second, not the first


def test_wrapped_match(spark):
    rows = [(1, 0, 0, "the long con-", 0.0, 80.0), (1, 0, 1, "tract ends", 0.0, 60.0)]
    found = matching.wrapped_matches(spark.createDataFrame(rows, "doc_id long, page int, row int, text string, x0 double, x1 double"), "contract")
    assert [(r.reading, r.matched) for r in found.collect()] == [("hyphen", "contract")]


def test_wrapped_matches_deal_texts_once(spark):
    """Rows of several pieces, a hyphen at an end and budgets, by one exchange; a group of the pattern's own keeps its number."""
    rows = [(1, 0, 0, "xab-", 0.0, 80.0), (1, 0, 0, "qa", 90.0, 95.0), (1, 0, 1, "ab", 0.0, 60.0), (1, 0, 1, "c", 85.0, 86.0), (1, 0, 2, "ay", 0.0, 9.0), (1, 0, 4, "b", 0.0, 9.0), (2, 0, 0, "b", 5.0, 6.0), (2, 0, 1, "b", 6.0, 9.0), (3, 0, None, "b", 0.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, row int, text string, x0 double, x1 double")
    own = lambda found: {tuple(r) for r in found.collect()}
    two = {(1, 0, 0, 2, "hyphen", "abab", False), (1, 0, 0, 2, "joined", "qaa", False), (1, 0, 0, 2, "hyphen", "qaa", False)}
    found = matching.wrapped_matches(df, "(ab)\\1|qaa")
    assert own(found) == two | {(*r[:3], 3, *r[4:]) for r in two}
    assert own(matching.wrapped_matches(df, "(ab)\\1|qaa", 6)) == {(*r[:6], True) for r in two} and own(matching.wrapped_matches(df, "abab", 1)) == set()
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hash") == 1


def test_sanitizer_drops_and_counts():
    got = packages.sanitized("<html lang=en><title>T</title><script>x<b></script><h1>A <i>b</i></h1><p>c<a href='javascript:x'>d</a><a href=http://e>f</a><img alt=g>")
    assert got["text"] == "A b\ncdfg" and got["headings"] == ["1 A b"] and got["links"] == ["http://e"] and got["dropped_elements"] == 1 and got["dropped_images"] == 1
    assert got["title"] == "T" and got["lang"] == "en"


def test_mail_counts_attachments():
    raw = b"From: =?utf-8?B?w6k=?= <a@b>\nSubject: s\n t\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>hi</p>\n--B\nContent-Disposition: attachment; filename=x\n\nzz\n--B--\n"
    got = packages.mail(raw)
    assert got["from"].startswith("\xe9") and got["subject"] == "s t" and got["body"] == "hi" and got["attachments_dropped"] == 1


def test_epub_is_read_in_spine_order(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfile full-path="o/p.opf"/></c>')
        z.writestr("o/p.opf", '<p xmlns="x"><item id="a" href="a.html"/><item id="b" href="b.html"/><itemref idref="b"/><itemref idref="a"/></p>')
        z.writestr("o/a.html", "<p>first</p>")
        z.writestr("o/b.html", "<p>second</p>")
    files = spark.createDataFrame([(1, bytearray(data.getvalue())), (2, bytearray(b"broken"))], "id long, content binary")
    got = {r.id: (r.text, r.refusal) for r in packages.read_epub(files, "id").collect()}
    assert got[1] == ("second\n\nfirst", None) and got[2] == (None, "BadZipFile")


def test_classification_refuses_a_name_that_contradicts(spark):
    found = formats.classify(F.col("c"), F.col("n"))
    rows = [(b"\x89PNG\r\n\x1a\n", "a.txt", "png", None), (b"plain", "a.txt", "txt", None), (b"plain", "a.png", None, "name says otherwise"), (b"a\x00b", "a.txt", None, "unknown bytes"), (b"PK\x03\x04", "a.docx", "docx", None)]
    df = spark.createDataFrame([(bytearray(c), n) for c, n, _, _ in rows], "c binary, n string").select("n", "c", found.alias("f"))
    assert {(bytes(r.c), r.n): (r.f.format, r.f.refusal) for r in df.collect()} == {(c, n): (f, why) for c, n, f, why in rows}


def scans():
    """Of path: scan, size, ok; b is there at the start, c fails and then changes, d goes."""
    return [("a", 1, 5, True), ("a", 2, 5, True), ("a", 3, 5, True), ("b", 0, 1, True), ("b", 1, 1, True), ("c", 1, 1, False), ("c", 2, 1, False), ("c", 3, 1, False), ("c", 4, 2, True), ("c", 5, 2, True), ("d", 1, 1, True), ("d", 3, 1, True), ("d", 4, 1, True)]


EXPECTED = {("a", 2, "acted"), ("c", 2, "failed"), ("c", 5, "acted"), ("d", 4, "acted")}


def test_watch_replay(spark):
    df = spark.createDataFrame([(p, s, z, 1, ok) for p, s, z, ok in scans()], "path string, scan long, size long, mtime long, ok boolean")
    assert {tuple(r) for r in watch.replay(df).collect()} == EXPECTED


def test_watch_stream_restarts(spark, tmp_path):
    schema = "path string, scan long, size long, mtime long, ok boolean"
    rows = [(p, s, z, 1, ok) for p, s, z, ok in scans()]
    for part in (rows_of for rows_of in ([r for r in rows if r[1] <= 2], [r for r in rows if r[1] > 2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch.watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == EXPECTED
