"""Folds over pages: what they cost on long pages, and pages that batches part."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from quirespark.operators import layout as L


def test_a_long_page_is_joined_without_looking_at_every_line():
    n = 30_000
    x0 = [72.0 + 40 * k for k in range(n)]
    began = time.perf_counter()
    lines = L.joined(x0, [700.0 + k % 3 / 2 for k in range(n)], [x + 18 for x in x0], [10.0] * n, list(range(n)))
    assert len(lines) == n and time.perf_counter() - began < 20  # pairs of all open lines took minutes


def test_items_of_one_height_are_looked_up_once(monkeypatch):
    asked = []
    found = L.row_places
    monkeypatch.setattr(L, "row_places", lambda heights: asked.append(len(heights)) or found(heights))
    rows = pa.table({"doc_id": [1] * 900, "page": pa.array([0] * 900, pa.int32()), "seq": pa.array(range(900), pa.int32()), "y0": [700.0 - k % 3 * 4 for k in range(900)], "size": [10.0] * 900})
    *_, row = L.page_rows(rows, L.page_numbers(rows))
    assert asked == [3] and row.tolist() == [(0, 0, 1)[k % 3] for k in range(900)]


def test_pages_over_several_batches(spark):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        runs = spark.range(60).select((F.col("id") / 20).cast("long").alias("doc_id"), (F.col("id") % 20 / 12).cast("int").alias("page"), F.col("id").cast("int").alias("seq"), F.lit("ab").alias("text"), F.lit(10.0).alias("size"), (F.col("id") % 20 * 15.0).alias("x0"), (F.col("id") % 20 * 15.0 + 12).alias("x1"), F.lit(0.0).alias("y0"))
        rows = L.column_fold(runs, L.line_segments, L.SEGMENTS).collect()
        assert sorted((r.doc_id, r.page, r.runs) for r in rows) == [(d, p, 12 if p == 0 else 8) for d in range(3) for p in range(2)]
        assert all(r.text == " ".join(["ab"] * r.runs) for r in rows)
        assert L.column_fold(runs, L.page_rows, L.ROWS).where("row = 0").count() == 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
