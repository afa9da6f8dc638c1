"""From the tables to the shapes that document operators work on, in Spark and in
SQL side by side. Our own conventions: a text's lines are cut at LF, a character is
6 points wide, lines are 12 points apart, and 54 lines make a page.

The texts hold no control characters, markers, links or formulas, so queries on
these inject them by the document's id, equally in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix and suffix by doc_id modulo their number.
INJECTED = (
    ("", ""), ("‮", "⁦x⁩"), ("\x07a\x7f", "\x85b"), ("=SUM(1)", ""), ("12. ", ""), ("• ", ""), ("iv) ", ""),
    ("a b ", "\r"), ("שלום ", ""), ("# ", " *b* [c](d) `e`"), ("﻿", "‏"), (" \t+1", ""), ("- ", ""), (" 　 wide ", " "), ("X. ", ""),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with adversarial text."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % len(INJECTED)
    pick = lambda side: F.element_at(F.array(*(F.lit(p[side]) for p in INJECTED)), (k + 1).cast("int"))
    return docs.withColumn("text", F.concat(pick(0), F.coalesce("text", F.lit("")), pick(1)))


def sql_text(s: str) -> str:
    """A string as concatenated literals and code points."""
    parts = [f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 or c == "'" else f"'{c}'" for c in s]
    return " || ".join(parts) or "''"


def sql_injected() -> str:
    case = lambda side: f"CASE doc_id % {len(INJECTED)} " + " ".join(f"WHEN {k} THEN {sql_text(p[side])}" for k, p in enumerate(INJECTED)) + " END"
    return f"(SELECT doc_id, lang, source, {case(0)} || coalesce(text, '') || {case(1)} AS text FROM documents)"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, line_no (from 0), line."""
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def sql_lines(docs: str = "documents") -> str:
    return f"(SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM {docs} t) d, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) s)"


def runs(docs: DataFrame) -> DataFrame:
    """Text runs: doc_id, page, seq, text, x0, y0, x1, y1, size. Indents and sizes vary
    with the line so that layout has something to find."""
    n = F.col("line_no")
    size = F.when((n % 9 == 0) & (F.length("line") < 400), F.lit(18.0)).when(n % 17 == 3, F.lit(14.2)).otherwise(F.lit(10.0) + (F.col("doc_id") % 2) * 0.5)
    x0 = F.lit(72.0) + F.when(n % 4 == 1, F.lit(20.0)).otherwise(F.lit(0.0))
    y1 = F.lit(720.0) - (n % 54) * 12.0
    base = lines(docs).select("doc_id", "lang", F.floor(n / 54).cast("int").alias("page"), n.alias("seq"), F.col("line").alias("text"), x0.alias("x0"), size.alias("size"), y1.alias("y1"))
    return base.select("doc_id", "lang", "page", "seq", "text", "x0", (F.col("y1") - F.col("size")).alias("y0"), (F.col("x0") + F.length("text") * 6.0).alias("x1"), "y1", "size")


def sql_runs(docs: str = "documents") -> str:
    return f"""(SELECT doc_id, lang, page, seq, text, x0, y1 - size AS y0, x0 + length(text) * 6.0::DOUBLE AS x1, y1, size FROM (
      SELECT doc_id, lang, CAST(floor(line_no / 54) AS INTEGER) AS page, line_no AS seq, line AS text,
             72.0::DOUBLE + CASE WHEN line_no % 4 = 1 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS x0,
             CASE WHEN line_no % 9 = 0 AND length(line) < 400 THEN 18.0::DOUBLE WHEN line_no % 17 = 3 THEN 14.2::DOUBLE ELSE 10.0::DOUBLE + (doc_id % 2) * 0.5::DOUBLE END AS size,
             720.0::DOUBLE - (line_no % 54) * 12.0::DOUBLE AS y1
      FROM {sql_lines(docs)} l) r)"""


def is_space(c: Column) -> Column:
    return c.isin(" ", "\t")
