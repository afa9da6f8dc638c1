"""The structure that a document's layout suggests: headings, paragraphs, list items and tables
in reading order, from the layout's paragraphs and cells. All windows are within a
document, a page or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import SPACE, list_marker, round_half
from quirespark.operators.grouping import tables_in_layout
from quirespark.operators.layout import HEADING_LINES, HEADING_SCALE, body_size


def proposed(runs: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """Elements (doc_id, id from 0 in reading order, parent, role, page, text, marker, x0, y0, x1,
    y1). Roles: ``H1`` to ``H6``, ``LI``, ``P``, and ``Table``, ``TR``, ``TD`` of the grids that are
    tables. A heading has no list marker, at most three lines, and a size of 1.15 times the
    document's or more; levels go by falling size. A table stands where its paragraphs
    before end; its rows and cells follow it at once, empty cells too. Without ``grids``: see ``page_parts``."""
    lines, cells, judged = tables_in_layout(runs, grids)
    own = F.sort_array(F.collect_list(F.struct("place", "text")))
    paras = lines.groupBy("doc_id", "page", "para").agg(
        F.array_join(F.transform(own, lambda m: m["text"]), " ").alias("text"), F.count(F.lit(1)).alias("lines"), F.max(round_half(F.col("size"))).alias("half"),
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max(F.col("y") + F.col("size")).alias("y1"),
    )
    paras = paras.join(body_size(lines), "doc_id", "left").withColumn("marker", list_marker(F.col("text")))
    large = (F.col("marker") == "") & (F.col("lines") <= HEADING_LINES) & (F.col("body") > 0) & (F.col("half") >= F.col("body") * HEADING_SCALE)
    level = F.dense_rank().over(Window.partitionBy("doc_id", "large").orderBy(F.desc("half")))
    paras = paras.withColumn("large", F.coalesce(large, F.lit(False))).withColumn("level", F.least(level, F.lit(6)))
    role = F.when(F.col("large"), F.concat(F.lit("H"), F.col("level"))).when(F.col("marker") != "", "LI").otherwise("P")
    rest = F.when(F.col("marker") == "", F.col("text")).otherwise(F.regexp_replace(F.substr("text", F.length("marker") + 1, F.length("text")), f"^[{SPACE}]+", ""))
    edges = ("x0", "y0", "x1", "y1")
    none = [F.lit(-1).alias(c) for c in ("grid", "row", "col")]
    texts = paras.select("doc_id", "page", (F.col("para") * 2).alias("at"), *none, role.alias("role"), rest.alias("text"), "marker", *edges)

    # Tables, rows and cells: a slot each, the row or column -1 for what holds them.
    kept = judged.where("reason IS NULL")
    rows, cols = F.size("ys") - 1, F.size("xs") - 1
    slots = kept.select("doc_id", "page", (F.col("before") * 2 + 1).alias("at"), "grid", "xs", "ys", F.explode(F.sequence(F.lit(-1), rows - 1)).alias("row"), cols.alias("cols"))
    slots = slots.select("*", F.explode(F.when(F.col("row") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(-1), F.col("cols") - 1))).alias("col"))
    slots = slots.join(cells.select("doc_id", "page", "grid", "row", "col", "text").hint("merge"), ["doc_id", "page", "grid", "row", "col"], "left")
    pick = lambda one, low, high: F.when(F.col(one) < 0, low).otherwise(high)
    slots = slots.select(
        "doc_id", "page", "at", "grid", "row", "col", F.when(F.col("row") < 0, "Table").when(F.col("col") < 0, "TR").otherwise("TD").alias("role"), F.coalesce(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("")).alias("text"), F.lit("").alias("marker"),
        pick("col", F.col("xs")[0], F.get("xs", F.col("col"))).alias("x0"), pick("row", F.element_at("ys", -1), F.get("ys", F.col("row") + 1)).alias("y0"), pick("col", F.element_at("xs", -1), F.get("xs", F.col("col") + 1)).alias("x1"), pick("row", F.col("ys")[0], F.get("ys", F.col("row"))).alias("y1"),
    )
    both = texts.unionByName(slots)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at", "grid", "row", "col")) - 1
    both = both.withColumn("id", place)
    table, row = Window.partitionBy("doc_id", "page", "grid"), Window.partitionBy("doc_id", "page", "grid", "row")
    parent = F.when(F.col("role") == "TR", F.max(F.when(F.col("role") == "Table", F.col("id"))).over(table)).when(F.col("role") == "TD", F.max(F.when(F.col("role") == "TR", F.col("id"))).over(row))
    return both.select("doc_id", "id", parent.alias("parent"), "role", "page", "text", "marker", *edges)
