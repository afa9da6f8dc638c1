"""Queries on page arithmetic, with their SQL. Orders stand for files, their lines for
pages; documents have a page per 54 lines, at least ten for arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.operators import pages as P
from quirespark.plans.bridge import table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def pages(spark, d):
    """doc_id, page, width, height, rotate: 4 to 13 pages by id."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 10 + 4).cast("int"))).alias("page"))
    k = F.col("doc_id") + F.col("page")
    return docs.select("doc_id", "page", F.when(k % 3 == 0, 842.0).otherwise(595.0).alias("width"), F.when(k % 3 == 0, 595.0).otherwise(F.when(k % 7 == 0, 792.4).otherwise(842.0)).alias("height"), ((k % 4) * 90).cast("int").alias("rotate"))


PAGES = """(SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN 842.0 ELSE 595.0 END::DOUBLE AS width,
  CASE WHEN (doc_id + page) % 3 = 0 THEN 595.0 WHEN (doc_id + page) % 7 = 0 THEN 792.4 ELSE 842.0 END::DOUBLE AS height, ((doc_id + page) % 4 * 90)::INTEGER AS rotate
  FROM (SELECT doc_id, unnest(generate_series(1, doc_id % 10 + 4))::INTEGER AS page FROM documents) q)"""


@query("select_pages", f"SELECT doc_id, page FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM {PAGES} p) q WHERE ((page BETWEEN 2 AND 9) OR page >= n - 1 OR page = 1) AND NOT page = 3 AND NOT (page % 2 = 0 AND page > 100)")
def select_pages(spark, d):
    return P.selected(pages(spark, d), ["2-9", "l-1-", "1", "!3"]).select("doc_id", "page")


@query("keep_pages", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS page, p.page AS source_page FROM {PAGES} p JOIN (VALUES (0, 4), (1, 1), (2, 4), (3, 2)) v(pos, w) ON p.page = v.w")
def keep_pages(spark, d):
    return P.kept_in_order(pages(spark, d), [4, 1, 4, 2]).select("doc_id", "page", "source_page")


@query("remove_pages", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page)::INTEGER AS page, page AS source_page FROM {PAGES} p WHERE page NOT IN (2, 5)")
def remove_pages(spark, d):
    return P.removed(pages(spark, d), [2, 5]).select("doc_id", "page", "source_page")


@query("duplicate_pages", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, c)::INTEGER AS page, page AS source_page FROM {PAGES} p JOIN (VALUES (0), (1)) v(c) ON c = 0 OR page = 3")
def duplicate_pages(spark, d):
    return P.duplicated(pages(spark, d), F.col("page") == 3).select("doc_id", "page", "source_page")


@query("insert_blank", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, side)::INTEGER AS page, CASE WHEN side = 0 THEN page END AS source_page FROM {PAGES} p JOIN (VALUES (0), (1)) v(side) ON side = 0 OR page = 2")
def insert_blank(spark, d):
    return P.inserted_blank(pages(spark, d), 2).select("doc_id", "page", "source_page")


@query("append_pages", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, page)::INTEGER AS page, page AS source_page FROM (SELECT *, 0 AS part FROM {PAGES} a UNION ALL SELECT *, 1 FROM {PAGES} b WHERE page <= 2) p")
def append_pages(spark, d):
    own = pages(spark, d)
    return P.appended(own, own.where("page <= 2")).select("doc_id", "page", "source_page")


@query("page_geometry", f"""SELECT doc_id, page, (rotate + 270) % 360 AS rotate, CASE WHEN rotate IN (90, 270) THEN height ELSE width END AS shown_width,
  CASE WHEN rotate IN (90, 270) THEN width ELSE height END AS shown_height,
  CASE rotate WHEN 90 THEN 36 / height WHEN 180 THEN 1 - 72 / width WHEN 270 THEN 1 - 36 / height ELSE 72 / width END AS fx,
  CASE rotate WHEN 90 THEN 72 / width WHEN 180 THEN 36 / height WHEN 270 THEN 1 - 72 / width ELSE 1 - 36 / height END AS fy FROM {PAGES} p""")
def page_geometry(spark, d):
    w, h, r = F.col("width"), F.col("height"), F.col("rotate")
    size, at = P.displayed_size(w, h, r), P.display_point(F.lit(72.0), F.lit(36.0), w, h, r)
    return pages(spark, d).select("doc_id", "page", P.rotated(r, 270).alias("rotate"), size["width"].alias("shown_width"), size["height"].alias("shown_height"), at["fx"].alias("fx"), at["fy"].alias("fy"))


@query("page_tiles", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, t)::INTEGER AS page, (t % 2) * (width / 2) AS x0,
  height - (t // 2 + 1) * (height / 3) AS y0, (t % 2 + 1) * (width / 2) AS x1, height - (t // 2) * (height / 3) AS y1 FROM {PAGES} p, (SELECT unnest(generate_series(0, 5)) AS t) s""")
def page_tiles(spark, d):
    return P.tiles(pages(spark, d), 2, 3).select("doc_id", "page", "x0", "y0", "x1", "y1")


@query("n_up", f"SELECT doc_id, page, ((page - 1) // 4 + 1)::INTEGER AS sheet, ((page - 1) % 4)::INTEGER AS slot FROM {PAGES} p")
def n_up(spark, d):
    return P.n_up(pages(spark, d), 4).select("doc_id", "page", "sheet", "slot")


@query("booklet", f"""WITH q AS (SELECT doc_id, page, ceil(max(page) OVER (PARTITION BY doc_id) / 4.0)::INTEGER * 4 AS n FROM {PAGES} p),
  r AS (SELECT *, CASE WHEN page <= n / 2 THEN page - 1 ELSE n - page END AS k FROM q)
  SELECT doc_id, page, (k // 2 + 1)::INTEGER AS sheet, CASE WHEN k % 2 = 0 THEN 'front' ELSE 'back' END AS side,
  CASE WHEN (k % 2 = 0) = (page > n / 2) THEN 'left' ELSE 'right' END AS place FROM r""")
def booklet(spark, d):
    return P.booklet(pages(spark, d)).select("doc_id", "page", "sheet", "side", "place")


@query("split_every", f"SELECT doc_id, part, min(page) AS lo, max(page) AS hi FROM (SELECT doc_id, page, ((page - 1) // 3 + 1)::INTEGER AS part FROM {PAGES} p) q GROUP BY ALL")
def split_every(spark, d):
    return P.split_every(pages(spark, d), 3).groupBy("doc_id", "part").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))


@query("split_ranges", f"SELECT doc_id, page, part, hi <= n AS whole FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM {PAGES} p) q JOIN (VALUES (1, 1, 3), (2, 5, 5), (3, 2, 9)) v(part, lo, hi) ON page BETWEEN lo AND hi")
def split_ranges(spark, d):
    return P.split_ranges(pages(spark, d), "1-3, 5\n2-9").select("doc_id", "page", "part", "whole")


def files(spark, d):
    """batch (customer), file (order), title, pages (lines)."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"))
    return orders.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("file"), F.concat(F.lit("order "), (F.col("o_orderkey") % 7).cast("string")).alias("title"), "pages")


FILES = "(SELECT o_custkey AS batch, o_orderkey AS file, 'order ' || (o_orderkey % 7) AS title, pages FROM orders JOIN (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1) n ON o_orderkey = l_orderkey)"


@query("bates_numbers", f"""SELECT batch, file, first_number, of_number, 'B-' || lpad(first_number::VARCHAR, 6, '0') AS first_label, 'B-' || lpad((first_number + pages - 1)::VARCHAR, 6, '0') AS last_label FROM (
  SELECT *, (coalesce(sum(pages) OVER (PARTITION BY batch ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100)::BIGINT AS first_number,
  (sum(pages) OVER (PARTITION BY batch) + 99)::BIGINT AS of_number FROM {FILES} f) q""")
def bates_numbers(spark, d):
    return P.continuous_numbers(files(spark, d), 100, 6, "B-").select("batch", "file", "first_number", "of_number", "first_label", "last_label")


@query("merge_outline", f"""WITH o AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY batch ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip FROM {FILES} f)
  SELECT batch, file, -1 AS pos, title, skip + 1 AS page, 0 AS level FROM o UNION ALL
  SELECT batch, file, l_linenumber, 'part ' || l_partkey, l_linenumber + skip, l_linenumber % 2 + 1 FROM o JOIN lineitem ON file = l_orderkey""")
def merge_outline(spark, d):
    own = files(spark, d)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), F.col("l_linenumber").cast("long").alias("page"), (F.col("l_linenumber") % 2).alias("level"))
    return P.merged_outline(lines.join(own.select("batch", "file"), "file"), own)


@query("output_names", f"SELECT batch, file, CASE WHEN k > 1 THEN title || '-' || k ELSE title END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY batch, title ORDER BY file) AS k FROM {FILES} f) q")
def output_names(spark, d):
    return P.unique_names(files(spark, d), "title", "batch", "file").select("batch", "file", "unique_name")


def outline(spark, d):
    """Headings out of conversations: a level by turn and text, some titles empty."""
    c = table(spark, d, "conversations")
    title = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.concat("role", (F.col("turn") % 3).cast("string")))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), title.alias("title"), (F.col("turn") + 1).cast("int").alias("page"), (F.length("text") % 4).cast("int").alias("level"))


OUTLINE = "(SELECT conv_id AS doc_id, turn AS pos, CASE WHEN turn % 5 = 4 THEN ' ' ELSE role || (turn % 3) END AS title, (turn + 1)::INTEGER AS page, (length(text) % 4)::INTEGER AS level FROM conversations)"
CLAMPED = f"""(SELECT doc_id, pos, page, least(level, rn, rn + min(level - rn) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS level, title, t FROM (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS rn,
         CASE WHEN count(*) OVER (PARTITION BY doc_id, title) > 1 THEN title || ' (p. ' || page || ')' ELSE title END AS t FROM {OUTLINE} o WHERE trim(title) <> '') q)"""


@query("outline_levels", f"SELECT doc_id, pos, page, level, CASE WHEN k > 1 THEN t || ' (' || k || ')' ELSE t END AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS k FROM {CLAMPED} c) q")
def outline_levels(spark, d):
    return P.clamped_outline(outline(spark, d)).select("doc_id", "pos", "page", "level", "title")


@query("contents_pages", f"""SELECT doc_id, pos, rn::INTEGER AS rn, n > 4000 AS refused, (CASE WHEN rn <= 2 THEN 1 ELSE 2 + (rn - 3) // 3 END)::INTEGER AS contents_page,
  (CASE WHEN page > 1 THEN page + 1 + ceil(greatest(n - 2, 0) / 3.0) ELSE page END)::INTEGER AS printed FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM {CLAMPED} c WHERE level < 2) q""")
def contents_pages(spark, d):
    return P.contents_pages(P.clamped_outline(outline(spark, d)), 2, 2, 3, 1).select("doc_id", "pos", "rn", "refused", "contents_page", "printed")


@query("split_by_outline", f"SELECT doc_id, page, (SELECT count(DISTINCT o.page) FROM {OUTLINE} o WHERE o.doc_id = p.doc_id AND o.level = 0 AND o.page <= p.page)::INTEGER AS part FROM {PAGES} p")
def split_by_outline(spark, d):
    return P.split_by_outline(pages(spark, d), outline(spark, d)).select("doc_id", "page", "part")


@query("page_labels", f"""SELECT doc_id, page, CASE WHEN page >= 6 THEN 'A-' || (page - 6 + 10) WHEN page >= 2 THEN (['i', 'ii', 'iii', 'iv'])[page - 1] END AS label FROM {PAGES} p""")
def page_labels(spark, d):
    return P.page_labels(pages(spark, d), [(6, "D", 10, "A-"), (2, "r", 1, "")]).select("doc_id", "page", "label")


@query("modal_page_size", f"""SELECT doc_id, w, h, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w * h DESC, w DESC) AS k FROM (
  SELECT doc_id, least(round(width), round(height)) AS w, greatest(round(width), round(height)) AS h, count(*) AS n FROM {PAGES} p GROUP BY ALL) q) r WHERE k = 1""")
def modal_page_size(spark, d):
    from quirespark.operators.layout import modal_page_size as modal

    return modal(pages(spark, d))
