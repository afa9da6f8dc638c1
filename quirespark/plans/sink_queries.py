"""Queries on sinks and form records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.operators import layout as L
from quirespark.plans.bridge import table
from quirespark.plans.layout_queries import MARKED, _blocks, marked_lines
from quirespark.plans.scalars import _marker
from quirespark.sources import sinks as S

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def blocks(spark, d):
    """Blocks of the documents' lines: items, and every fifth text line a heading."""
    found = L.list_blocks(marked_lines(spark, d)).where("kind != 'blank'")
    kind = F.when((F.col("kind") == "text") & (F.col("line_no") % 5 == 0), "heading").otherwise(F.col("kind"))
    text = F.when(F.col("kind") == "item", F.regexp_replace("line", r"^[^ ]+ ", "")).otherwise(F.col("line"))
    return found.select("doc_id", F.col("line_no").alias("pos"), kind.alias("kind"), "marker", text.alias("text"), F.lit(2).alias("level"))


_items = f"""(SELECT doc_id, line_no AS pos, b.kind, regexp_extract(line, '{_marker}', 1) AS marker, CASE WHEN b.kind = 'item' THEN regexp_replace(line, '^[^ ]+ ', '') ELSE line END AS text
  FROM {_blocks(MARKED)} b JOIN {MARKED} m USING (doc_id, line_no) WHERE b.kind <> 'blank')"""


@query("text_sink", f"""SELECT doc_id, sha256(string_agg(CASE WHEN before IS NULL THEN '' WHEN kind = 'item' AND before = 'item' THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN kind = 'item' THEN marker || ' ' || text ELSE text END, '' ORDER BY pos)) AS digest
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {_items} i) q GROUP BY doc_id""")
def text_sink(spark, d):
    return S.to_text(blocks(spark, d).withColumn("kind", F.when(F.col("kind") == "heading", "text").otherwise(F.col("kind")))).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("markdown_sink")
def markdown_sink(spark, d):
    return S.to_markdown(blocks(spark, d)).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query("html_sink")
def html_sink(spark, d):
    return S.to_html(blocks(spark, d)).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


_cell = lambda c: f"(CASE WHEN regexp_matches({c}, '[\",\\r\\n]|^ | $') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END)"


@query("csv_sink", f"""SELECT p_partkey, {_cell('a')} || ',' || {_cell('b')} || ',' || {_cell('c')} AS row_text FROM (SELECT p_partkey, p_name || ', ' || p_brand AS a,
  CASE WHEN p_partkey % 2 = 0 THEN '''' || '=' || p_type ELSE p_type END AS b, '"' || p_size AS c FROM part) q""")
def csv_sink(spark, d):
    b = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ="), "p_type")).otherwise(F.col("p_type"))
    cells = F.array(F.concat("p_name", F.lit(", "), "p_brand"), b, F.concat(F.lit('"'), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", S.csv_row(cells).alias("row_text"))


@query("json_field_names", "SELECT c_custkey, 'f1,f2,name,seg' || (c_custkey % 2) AS names FROM customer")
def json_field_names(spark, d):
    field = lambda i, n, v: F.struct(i.alias("id"), n.alias("name"), v.alias("value"))
    seg = F.concat(F.lit("seg"), (F.col("c_custkey") % 2).cast("string"))
    record = S.json_record(F.array(field(F.lit("f2"), seg, F.col("c_mktsegment")), field(F.lit("f1"), F.lit("name"), F.col("c_name"))))
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.json_field_names(record), ",").alias("names"))


@query("xfdf_fields", "SELECT c_custkey AS doc_id, 'a.name' AS name, c_name || ' <&>' AS value FROM customer UNION ALL SELECT c_custkey, 'a.b.seg', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'a.b.seg', 'x' FROM customer")
def xfdf_fields(spark, d):
    field = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    fields = F.array(field("a.name", F.concat("c_name", F.lit(" <&>"))), field("a.b.seg", F.col("c_mktsegment")), field("a.b.seg", F.lit("x")))
    return S.xfdf_round_trip(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), fields.alias("fields")))


@query("lost_fields", "SELECT l_returnflag AS name, count(*) AS lost FROM (SELECT l_returnflag FROM lineitem EXCEPT ALL SELECT l_returnflag FROM lineitem WHERE l_linenumber > 2) q GROUP BY 1")
def lost_fields(spark, d):
    li = table(spark, d, "lineitem")
    lost = li.select("l_returnflag").exceptAll(li.where("l_linenumber > 2").select("l_returnflag"))
    return lost.groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("lost"))
