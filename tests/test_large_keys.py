"""Queries over keys and lines that are larger than those of the small tables."""

import time

import duckdb
from pyspark.sql import functions as F

from quirespark.plans import catalogue, document_queries


def test_image_headers_of_keys_beyond_their_fields(spark, tmp_path):
    keys = [1, 65_530, 65_533, 65_534, 65_535, 65_536, 65_537, 131_070, 131_073, 1_200_000, 1_200_001, 1_200_002, 1_200_003, 1_200_004, 16_777_212, 16_777_216, 16_777_222]
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in catalogue.queries()["image_headers"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.sql(catalogue.oracle_sql()["image_headers"]).fetchall())


def test_spans_of_a_long_line_take_one_pass(spark, tmp_path):
    text = F.repeat(F.lit("wörd "), 240_000)
    spark.range(4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spans = document_queries.template_spans(spark, str(tmp_path)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))
    began = time.perf_counter()
    rows = {r.doc_id: r for r in spans.collect()}
    assert time.perf_counter() - began < 30
    own = {k: 10 + 1_200_000 + (19 if k == 3 else 21) + 16 for k in rows}
    assert {k: r.chars for k, r in rows.items()} == own
    assert {k: r.texts for k, r in rows.items()} == {k: -(-n // 7) for k, n in own.items()}
    assert {k: r.n - r.texts for k, r in rows.items()} == {0: 0, 1: 1, 2: 0, 3: 0}
