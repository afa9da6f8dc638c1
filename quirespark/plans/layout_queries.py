"""Queries on layout and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.functions.text import SPACE
from quirespark.operators import layout as L
from quirespark.operators import matching as M
from quirespark.plans.bridge import injected, lines, runs, sql_injected, sql_lines, sql_runs, table
from quirespark.plans.scalars import _marker

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def own_runs(spark, d):
    return runs(table(spark, d, "documents"))


RUNS = sql_runs()
BODY = f"(SELECT doc_id, arg_min(size, (-n, size)) AS body FROM (SELECT doc_id, round(size * 2) / 2 AS size, sum(length(regexp_replace(text, '[{SPACE}]', '', 'g')))::BIGINT AS n FROM {RUNS} r GROUP BY ALL) q GROUP BY doc_id)"


@query("body_size", f"SELECT * FROM {BODY} b")
def body_size(spark, d):
    return L.body_size(own_runs(spark, d))


_steps = f"(SELECT doc_id, page, max(x1) AS right_edge, coalesce(quantile_cont(step, 0.5), 0.0)::DOUBLE AS typical, count(step) AS steps FROM (SELECT *, lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, seq) - y1 AS step FROM {RUNS} r) q GROUP BY ALL)"


@query("column_steps", f"SELECT * FROM {_steps} s")
def column_steps(spark, d):
    return L.column_steps(own_runs(spark, d))


@query("paragraphs", rf"""SELECT doc_id, page, count(*) FILTER (WHERE breaks) AS paras, count(*) AS lines FROM (
  SELECT doc_id, page, lag(seq) OVER w IS NULL OR abs(size - lag(size) OVER w) > 0.1 * size OR (steps >= 2 AND lag(y1) OVER w - y1 > 1.25 * typical)
    OR x0 - lag(x0) OVER w > 0.5 * size OR right_edge - lag(x1) OVER w > length(regexp_extract(text, '^[{SPACE}]*([^{SPACE}]*)', 1)) * 6.0 + 0.5 * size AS breaks
  FROM {RUNS} r JOIN {_steps} s USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1 DESC, seq)) q GROUP BY ALL""")
def paragraphs(spark, d):
    found = L.paragraphs(own_runs(spark, d))
    return found.groupBy("doc_id", "page").agg(F.max("para").alias("paras"), F.count(F.lit(1)).alias("lines"))


_breaks = rf"""(SELECT *, sum(breaks::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, seq) AS para FROM (
  SELECT r.*, lag(seq) OVER w IS NULL OR abs(size - lag(size) OVER w) > 0.1 * size OR (steps >= 2 AND lag(y1) OVER w - y1 > 1.25 * typical)
    OR x0 - lag(x0) OVER w > 0.5 * size OR right_edge - lag(x1) OVER w > length(regexp_extract(text, '^[{SPACE}]*([^{SPACE}]*)', 1)) * 6.0 + 0.5 * size AS breaks
  FROM {RUNS} r JOIN {_steps} s USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1 DESC, seq)) q)"""


@query("heading_levels", f"""WITH m AS (SELECT *, regexp_matches(text, '{_marker}') AS marked, row_number() OVER (PARTITION BY doc_id, page, para ORDER BY y1 DESC, seq) AS nth FROM {_breaks} b),
  p AS (SELECT *, sum((marked AND nth > 1)::INTEGER) OVER (PARTITION BY doc_id, page, para ORDER BY y1 DESC, seq) AS piece FROM m),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, para, piece) AS n, row_number() OVER (PARTITION BY doc_id, page, para, piece ORDER BY y1 DESC, seq) AS own FROM p)
  SELECT doc_id, seq, size, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY round(size * 2) / 2 DESC), 6)::INTEGER AS level
  FROM c JOIN {BODY} b USING (doc_id) WHERE own = 1 AND NOT marked AND n <= 3 AND body > 0 AND round(size * 2) / 2 >= body * 1.15""")
def heading_levels(spark, d):
    r = own_runs(spark, d)
    return L.headings(r, L.body_size(r)).select("doc_id", "seq", "size", "level")



@query("columns", f"""SELECT doc_id, page, seq, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS col FROM (
  SELECT doc_id, page, seq, x0, x1, CASE WHEN x0 >= max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
    WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY x0, x1, seq) = 1 THEN 1 ELSE 0 END AS fresh FROM
  (SELECT doc_id, page, seq, x0 + (seq % 3) * 200 AS x0, least(x1, x0 + 180) + (seq % 3) * 200 AS x1 FROM {RUNS} r) s) q""")
def columns(spark, d):
    shift = (F.col("seq") % 3) * 200
    parts = own_runs(spark, d).select("doc_id", "page", "seq", (F.col("x0") + shift).alias("x0"), (F.least(F.col("x1"), F.col("x0") + 180) + shift).alias("x1"))
    return L.columns(parts).select("doc_id", "page", "seq", F.col("col").cast("long").alias("col"))


@query("gutters", f"SELECT doc_id, page, round(x0) AS x, count(*) AS n FROM {RUNS} r JOIN (SELECT doc_id, page, min(x0) AS l FROM {RUNS} q GROUP BY ALL) m USING (doc_id, page) WHERE x0 > l GROUP BY ALL HAVING count(*) >= 3")
def gutters(spark, d):
    return L.gutters(own_runs(spark, d))


@query("running_lines", f"""SELECT doc_id, shape, count(DISTINCT page) AS pages FROM (SELECT doc_id, page, regexp_replace(text, '[0-9]+', '#', 'g') AS shape, y1,
  max(y1) OVER (PARTITION BY doc_id, page) AS hi, min(y1) OVER (PARTITION BY doc_id, page) AS lo FROM {RUNS} r) q WHERE y1 = hi OR y1 = lo GROUP BY ALL HAVING count(DISTINCT page) >= 3""")
def running_lines(spark, d):
    return L.running_lines(own_runs(spark, d))


_items = f"(SELECT *, CASE WHEN regexp_extract(line, '{_marker}', 1) <> '' THEN 'item' WHEN regexp_matches(line, '^[{SPACE}]*$') THEN 'blank' ELSE 'text' END AS kind FROM @ l)"


def _blocks(source):
    return f"""(SELECT doc_id, lang, line_no, kind, CASE WHEN kind = 'item' THEN dense_rank() OVER (PARTITION BY doc_id, kind ORDER BY run) ELSE 0 END::INTEGER AS list FROM (
      SELECT *, sum((kind = 'text')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM {_items.replace('FROM @ l', f'FROM {source} l')} i) q)"""


MARKED = f"(SELECT doc_id, lang, line_no, CASE WHEN (doc_id + line_no) % 4 IN (1, 2) THEN line_no || '. ' ELSE '' END || line AS line FROM {sql_lines()} x)"


def marked_lines(spark, d):
    number = F.concat(F.col("line_no").cast("string"), F.lit(". "))
    prefix = F.when(((F.col("doc_id") + F.col("line_no")) % 4).isin(1, 2), number).otherwise("")
    return lines(table(spark, d, "documents")).withColumn("line", F.concat(prefix, "line"))


@query("list_blocks", f"SELECT doc_id, line_no, kind, list FROM {_blocks(MARKED)} b")
def list_blocks(spark, d):
    return L.list_blocks(marked_lines(spark, d)).select("doc_id", "line_no", "kind", "list")


@query("block_kinds_by_lang", f"SELECT lang, kind, count(*) AS blocks, count(DISTINCT CASE WHEN kind = 'item' THEN doc_id END) AS docs_with_items FROM {_blocks(sql_lines(sql_injected()))} b GROUP BY ALL")
def block_kinds_by_lang(spark, d):
    blocks = L.list_blocks(lines(injected(spark, d)))
    return blocks.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct(F.when(F.col("kind") == "item", F.col("doc_id"))).alias("docs_with_items"))


@query("line_segments")
def line_segments(spark, d):
    return L.column_fold(words_of(spark, d), L.line_segments, L.SEGMENTS)


@query("text_rows")
def text_rows(spark, d):
    return L.column_fold(words_of(spark, d), L.page_rows, L.ROWS)


def words_of(spark, d):
    """A run per word, on the lines' baselines with a small wobble."""
    base = own_runs(spark, d).select("doc_id", "page", F.col("seq").alias("line"), "size", "y0", F.posexplode(F.split("text", " ")).alias("w", "text"))
    wobble = (F.col("w") % 3) * 0.5
    x0 = F.lit(72.0) + F.col("w") * 40.0
    return base.select("doc_id", "page", (F.col("line") * 1000 + F.col("w")).alias("seq"), "text", "size", x0.alias("x0"), (x0 + F.least(F.length("text"), F.lit(6)) * 6.0).alias("x1"), (F.col("y0") + wobble).alias("y0"))


# Matching.

WORD = rf"[^{SPACE}]+"
_counts = lambda t: f"(SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM {t} t) w GROUP BY ALL)"
_edited = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' end end' WHEN doc_id % 3 = 1 THEN regexp_replace(text, '^[^ ]+ ', '') ELSE replace(text, ' ', '  ') END AS text FROM documents)"


@query("word_multiset_diff", f"""SELECT doc_id, bool_and(a = b) AS same, sum(greatest(a - b, 0))::BIGINT AS missing, sum(greatest(b - a, 0))::BIGINT AS extra FROM (
  SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM {_counts('documents')} x FULL JOIN {_counts(_edited)} y ON x.doc_id = y.doc_id AND x.word = y.word) q GROUP BY doc_id""")
def word_multiset_diff(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 3
    edited = docs.withColumn("text", F.when(k == 0, F.concat("text", F.lit(" end end"))).when(k == 1, F.regexp_replace("text", "^[^ ]+ ", "")).otherwise(F.replace("text", F.lit(" "), F.lit("  "))))
    return M.same_words(docs, edited)


_hidden = f"(SELECT *, seq % 13 = 5 AS hidden FROM (SELECT doc_id, page, seq, x0 + CASE WHEN seq % 11 = 4 THEN 900 ELSE 0 END AS x0, y0, x1 + CASE WHEN seq % 11 = 4 THEN 900 ELSE 0 END AS x1, y1 FROM {RUNS} r) h)"
_shapes = "(SELECT l_orderkey % (SELECT count(*) FROM documents) AS doc_id, 0 AS page, (l_linenumber * 3)::INTEGER AS seq, 60.0::DOUBLE AS x0, (720 - l_linenumber * 50)::DOUBLE AS y0, 60 + l_quantity * 40 AS x1, (770 - l_linenumber * 50)::DOUBLE AS y1, l_linenumber % 2 = 0 AS opaque FROM lineitem)"


def shapes(spark, d):
    n, k = table(spark, d, "documents").count(), F.col("l_linenumber")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % n).alias("doc_id"), F.lit(0).alias("page"), (k * 3).alias("seq"), F.lit(60.0).alias("x0"), (720 - k * 50).cast("double").alias("y0"), (60 + F.col("l_quantity") * 40).alias("x1"), (770 - k * 50).cast("double").alias("y1"), (k % 2 == 0).alias("opaque"))


@query("covered_runs", f"""SELECT verdict, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT r.doc_id, CASE WHEN hidden THEN 'hidden' WHEN x1 <= 0 OR x0 >= 595 OR y1 <= 0 OR y0 >= 842 THEN 'off_page'
  WHEN EXISTS (SELECT 1 FROM {_shapes} s WHERE opaque AND s.doc_id = r.doc_id AND s.page = r.page AND s.seq > r.seq AND s.x0 <= r.x0 AND s.y0 <= r.y0 AND s.x1 >= r.x1 AND s.y1 >= r.y1) THEN 'covered' ELSE 'visible' END AS verdict FROM {_hidden} r) q GROUP BY verdict""")
def covered_runs(spark, d):
    shift = F.when(F.col("seq") % 11 == 4, 900).otherwise(0)
    r = own_runs(spark, d).select("doc_id", "page", "seq", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1", (F.col("seq") % 13 == 5).alias("hidden"))
    found = M.visible_runs(r, shapes(spark, d), (0, 0, 595, 842))
    return found.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("painted_over", f"""SELECT doc_id, count(*) AS grounds FROM {_shapes.replace(' AS opaque', ' AS white')} w WHERE white AND NOT EXISTS (SELECT 1 FROM {_shapes.replace(' AS opaque', ' AS white')} c
  WHERE NOT c.white AND c.doc_id = w.doc_id AND c.page = w.page AND c.seq > w.seq AND c.x0 <= w.x0 + 0.5 AND c.y0 <= w.y0 + 0.5 AND c.x1 >= w.x1 - 0.5 AND c.y1 >= w.y1 - 0.5) GROUP BY doc_id""")
def painted_over(spark, d):
    return M.painted_over(shapes(spark, d).withColumnRenamed("opaque", "white")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("grounds"))


_cells = "(SELECT doc_id, r AS row, c AS col, 50.0 + c * 150 AS x0, 200.0 + c * 150 AS x1, 720.0 - (r + 1) * 90 AS y0, 720.0 - r * 90 AS y1 FROM documents, (SELECT unnest(generate_series(0, 4)) AS r) a, (SELECT unnest(generate_series(0, 2)) AS c) b)"


@query("cell_assignment", f"SELECT p.doc_id, p.seq, c.row::INTEGER AS row, c.col::INTEGER AS col FROM {RUNS} p JOIN {_cells} c ON p.doc_id = c.doc_id AND p.x0 >= c.x0 AND p.x0 < c.x1 AND p.y0 >= c.y0 AND p.y0 < c.y1")
def cell_assignment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("k"))
    r, c = F.floor(F.col("k") / 3).cast("int"), (F.col("k") % 3).cast("int")
    cells = docs.select("doc_id", r.alias("row"), c.alias("col"), (50.0 + c * 150).alias("x0"), (200.0 + c * 150).alias("x1"), (720.0 - (r + 1) * 90).alias("y0"), (720.0 - r * 90).alias("y1"))
    points = own_runs(spark, d).select("doc_id", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return M.cell_of(points, cells).select("doc_id", "seq", "row", "col")


_estimates = f"(SELECT doc_id, page, seq, x0, y0, x0 + 60 AS x1, y1 FROM {RUNS} r)"
_exact = f"(SELECT doc_id, page, seq, x0, y0, x0 + 40 AS x1, y1 FROM {RUNS} r WHERE seq % 2 = 0)"


@query("placed_matches", f"""SELECT doc_id, seq, true AS exact FROM {_exact} x UNION ALL SELECT doc_id, seq, false FROM {_estimates} e WHERE NOT EXISTS (SELECT 1 FROM {_exact} x WHERE x.doc_id = e.doc_id AND x.page = e.page
  AND (e.x0 + e.x1) / 2 BETWEEN x.x0 AND x.x1 AND (e.y0 + e.y1) / 2 BETWEEN x.y0 AND x.y1)""")
def placed_matches(spark, d):
    r = own_runs(spark, d)
    box = lambda n: ("doc_id", "page", "seq", "x0", "y0", (F.col("x0") + n).alias("x1"), "y1")
    return M.placed_matches(r.select(*box(60)), r.where("seq % 2 = 0").select(*box(40))).select("doc_id", "seq", "exact")


@query("merged_proposals", f"""SELECT doc_id, seq, x1 - x0 AS w FROM {_exact} x UNION ALL SELECT doc_id, seq, x1 - x0 FROM {_estimates} b WHERE NOT EXISTS (SELECT 1 FROM {_exact} a WHERE a.doc_id = b.doc_id AND a.page = b.page
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""")
def merged_proposals(spark, d):
    r = own_runs(spark, d)
    box = lambda n: ("doc_id", "page", "seq", "x0", "y0", (F.col("x0") + n).alias("x1"), "y1")
    return M.merged_proposals(r.where("seq % 2 = 0").select(*box(40)), r.select(*box(60))).select("doc_id", "seq", (F.col("x1") - F.col("x0")).alias("w"))


PATTERN = "[Tt]he[a-z]*"


@query("search_rows", f"""SELECT doc_id, line_no, (k - 1)::INTEGER AS k, m[k] AS matched, (length(array_to_string(s[1:k], '')) + length(array_to_string(m[1:k - 1], '')))::INTEGER AS start FROM (
  SELECT doc_id, line_no, m, s, unnest(generate_series(1, len(m))) AS k FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{PATTERN}') AS m, string_split_regex(line, '{PATTERN}') AS s FROM {sql_lines()} l) q) r""")
def search_rows(spark, d):
    return M.row_matches(lines(table(spark, d, "documents")), PATTERN)


@query("search_wrapped")
def search_wrapped(spark, d):
    r = own_runs(spark, d).select("doc_id", "page", F.col("seq").alias("row"), "text", "x0", "x1")
    return M.wrapped_matches(r, r"[a-z]+\. ?[A-Z][a-z]+")


@query("mail_merge", """WITH u AS (SELECT c_custkey AS row, 'name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'f2', c_mktsegment FROM customer UNION ALL
  SELECT c_custkey, 'agree', CASE WHEN c_acctbal > 0 THEN ' Yes' ELSE 'no' END FROM customer UNION ALL SELECT c_custkey, 'tags', 'b' FROM customer UNION ALL SELECT c_custkey, 'tags', 'a' FROM customer)
  SELECT row, f.name, kind, CASE kind WHEN 'checkbox' THEN (SELECT max(CASE WHEN lower(trim(value)) IN ('t', 'true', '1', 'yes', 'y', 'x', 'checked', 'on') THEN 'On' ELSE 'Off' END) FROM u WHERE u.row = c.row AND u.name = f.name)
    WHEN 'listbox' THEN 'a,b' ELSE (SELECT min(value) FROM u WHERE u.row = c.row AND u.name IN (f.name, f.id)) END AS value
  FROM (SELECT c_custkey AS row FROM customer) c, (VALUES ('name', 'f1', 'text'), ('segment', 'f2', 'text'), ('agree', 'f3', 'checkbox'), ('tags', 'f4', 'listbox'), ('none', 'f5', 'text')) f(name, id, kind)""")
def mail_merge(spark, d):
    c = table(spark, d, "customer")
    agree = F.when(F.col("c_acctbal") > 0, " Yes").otherwise("no")
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("name", F.col("c_name")), ("f2", F.col("c_mktsegment")), ("agree", agree), ("tags", F.lit("b")), ("tags", F.lit("a")))))
    values = c.select(F.col("c_custkey").alias("row"), F.inline(pairs))
    fields = [("name", "f1", "text"), ("segment", "f2", "text"), ("agree", "f3", "checkbox"), ("tags", "f4", "listbox"), ("none", "f5", "text")]
    return M.filled_fields(spark.createDataFrame(fields, "name string, id string, kind string"), values)


@query("explorer_quorum", "SELECT item, answer, votes FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, answer DESC) AS k FROM (SELECT l_orderkey AS item, (l_partkey % 3)::VARCHAR AS answer, count(DISTINCT l_suppkey) AS votes FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2) q) r WHERE k = 1")
def explorer_quorum(spark, d):
    return M.explorer_quorum(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 3).cast("string").alias("answer"), F.col("l_suppkey").alias("source")))


@query("slash_templates")
def slash_templates(spark, d):
    t = lines(table(spark, d, "documents")).select("doc_id", F.col("line_no").alias("row"), F.posexplode(F.split("line", " ")).alias("pos", "token"))
    t = t.withColumn("token", F.when((F.col("row") % 4 == 1) & (F.col("pos") == 2), "red/blue").otherwise(F.col("token"))).withColumn("marker", (F.col("row") % 4 == 0) & (F.col("pos") == 0))
    return M.slash_templates(t).select("doc_id", "row", "pos", "token")


@query("figure_join")
def figure_join(spark, d):
    r = own_runs(spark, d)
    figs = r.where("seq % 3 = 0").select("doc_id", "page", F.col("seq").alias("pos"), F.when(F.col("seq") % 2 == 0, F.col("x0")).alias("x0"), "y0", "x1", "y1")
    pics = r.where("seq % 2 = 0").select("doc_id", "page", F.col("seq").alias("pic"), "x0", (F.col("y0") - 3).alias("y0"), "x1", "y1")
    return M.figures_by_overlap(figs, pics)
