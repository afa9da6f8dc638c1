import time

from pyspark.sql import functions as F

from quirespark.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_clean_drops_what_no_format_carries(spark):
    assert one(spark, T.clean(F.col("s")), s="a\x07‮b c\r\n﻿‏") == "ab\nc\n‏"


def test_one_line(spark):
    assert one(spark, T.one_line(F.col("s")), s="　 a \n b ") == "a b"


def test_csv_safe_keeps_other_cells(spark):
    assert one(spark, T.csv_safe(F.col("s")), s=" \t=1+1") == "'=1+1"
    assert one(spark, T.csv_safe(F.col("s")), s="  plain ") == "  plain "


def test_list_markers(spark):
    for text, marker in (("1. a", "1."), ("iv) b", "iv)"), ("X. c", ""), ("1.", ""), ("• d", "•"), ("1234. e", "")):
        assert one(spark, T.list_marker(F.col("s")), s=text) == marker


def test_links(spark):
    for link, safe, href in ((" HTTP://x", False, True), ("mailto:a", True, True), ("javascript:x", False, False), ("", False, False), ("http://a/%zz", False, False), ("http://a/?%zz", True, True), ("http://a\x07", False, False)):
        assert one(spark, T.safe_link(F.col("s")), s=link) is safe and one(spark, T.safe_href(F.col("s")), s=link) is href
    assert one(spark, T.link_target(F.col("s")), s="a b&amp;c&d") == "a%20b%26amp;c&d"


def test_glyph_names(spark):
    for name, text in (("f_i.alt", "fi"), ("uni00410042", "AB"), ("u1F600", "\U0001f600"), ("nosuch", None)):
        assert one(spark, T.glyph_text(F.col("s"), {"f": "f", "i": "i"}), s=name) == text


def test_pipe_choices_of_a_long_line(spark):
    """Every word is looked at a fixed number of times."""
    long = "word " * 20_000 + "9 " + "option " * 20_000
    began = time.perf_counter()
    assert one(spark, T.pipe_choices(F.col("s")), s=long + "| b | c d") == [("option " * 20_000).strip(), "b", "c d"]
    assert one(spark, T.pipe_choices(F.col("s")), s="12 " * 20_000 + "| x") == [("12 " * 20_000).strip(), "x"]
    assert time.perf_counter() - began < 60


def test_pipe_choices(spark):
    assert one(spark, T.pipe_choices(F.col("s")), s="Colour: red | blue") == ["red", "blue"]
    assert one(spark, T.pipe_choices(F.col("s")), s="no pipes") == []
    assert one(spark, T.pipe_choices(F.col("s")), s="Raise my dues by $5 | $10 each (or) a | b") == ["$5", "$10 each"]


def test_template(spark):
    values = F.create_map(F.lit("k"), F.col("v"))
    got = one(spark, T.fill_template(F.col("s"), values), s="{{k}} {{=k}} {{z}}", v="1")
    assert got["text"] == "1 {{k}} {{z}}" and got["missing"] == ["z"]
