"""Queries on sources, rule sets, versions and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.functions.text import once
from quirespark.operators import rules as R
from quirespark.plans.bridge import lines, table
from quirespark.sources import formats as S
from quirespark.sources import packages
from quirespark.streaming import history as H
from quirespark.streaming import watch as W

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Hexadecimal heads by id, and names by id.
HEADS = ("", "89504E470D0A1A0A", "504B0304", "D0CF11E0A1B11AE1", "7B5C72746631", "25215053", "0000001866747970686569630000", "FFD8FFE0", "00000000", "46726F6D3A20612040620A546F3A20620A0A", "3C68746D6C3E", "3C7376672F3E", "474946383961")
NAMES = (".txt", ".png", ".docx", ".xls", ".rtf", ".ps", ".heic", ".jpg", ".md", ".eml", ".html", ".svg", ".unknown", ".csv")
_head = "[" + ", ".join(f"'{h}'" for h in HEADS) + f"][(doc_id % {len(HEADS)} + 1)::INTEGER]"
_name = "'f' || [" + ", ".join(f"'{n}'" for n in NAMES) + f"][(doc_id % {len(NAMES)} + 1)::INTEGER]"


def sniffable(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (k % len(HEADS) + 1).cast("int"))
    name = F.concat(F.lit("f"), F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int")))
    return docs.select("doc_id", "lang", F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"), name.alias("name"))


_family = f"CASE doc_id % {len(HEADS)} WHEN 1 THEN 'raster' WHEN 2 THEN 'zip' WHEN 3 THEN 'ole' WHEN 4 THEN 'rtf' WHEN 5 THEN 'postscript' WHEN 6 THEN 'heif' WHEN 7 THEN 'raster' WHEN 9 THEN 'email' WHEN 10 THEN 'html' WHEN 11 THEN 'svg' WHEN 12 THEN 'raster' END"


@query("sniff_family", f"SELECT doc_id, {_family} AS family, doc_id % {len(HEADS)} NOT IN (6, 8) AS looks_like_text FROM documents")
def sniff_family(spark, d):
    return sniffable(spark, d).select("doc_id", S.sniff_family(F.col("content")).alias("family"), S.looks_like_text(F.col("content")).alias("looks_like_text"))


@query("classify_sources")
def classify_sources(spark, d):
    found = S.classify(F.col("content"), F.col("name"))
    return sniffable(spark, d).select("doc_id", "name", found["format"].alias("format"), found["refusal"].alias("refusal"))


@query("reject_counts", f"""SELECT CASE WHEN refusal IS NULL THEN 'ok' ELSE 'refused' END AS counter, lang AS door, coalesce(refusal, 'ok') AS label, count(*) AS n FROM (
  SELECT lang, CASE WHEN size > 20000 THEN 'input too large' WHEN lines > 20 THEN 'too many lines' END AS refusal FROM (
  SELECT lang, octet_length(encode(text)) AS size, len(string_split(text, chr(10))) AS lines FROM documents) q) r GROUP BY ALL""")
def reject_counts(spark, d):
    docs = table(spark, d, "documents").select("lang", F.octet_length("text").alias("size"), F.size(F.split("text", "\n")).alias("lines"))
    why = F.when(F.col("size") > 20_000, "input too large").when(F.col("lines") > 20, "too many lines")
    return docs.select("lang", why.alias("refusal")).groupBy(F.when(F.col("refusal").isNull(), "ok").otherwise("refused").alias("counter"), F.col("lang").alias("door"), F.coalesce("refusal", F.lit("ok")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("import_counts")
def import_counts(spark, d):
    found = S.classify(F.col("content"), F.col("name"))
    return W.outcome_counts(sniffable(spark, d).select("lang", found["format"].alias("format"), found["refusal"].alias("refusal")), "lang", "format", "refusal")


#: The formats' extensions and families.
_formats = """('png', 'png', 'raster'), ('jpeg', 'jpg', 'raster'), ('jpeg', 'jpeg', 'raster'), ('tiff', 'tif', 'raster'), ('tiff', 'tiff', 'raster'), ('webp', 'webp', 'raster'), ('gif', 'gif', 'raster'), ('bmp', 'bmp', 'raster'),
  ('cbz', 'cbz', 'zip'), ('markdown', 'md', 'text'), ('markdown', 'markdown', 'text'), ('doc', 'doc', 'ole'), ('docx', 'docx', 'zip'), ('odt', 'odt', 'zip'), ('rtf', 'rtf', 'rtf'), ('txt', 'txt', 'text'), ('xls', 'xls', 'ole'), ('xlsx', 'xlsx', 'zip'),
  ('ods', 'ods', 'zip'), ('csv', 'csv', 'text'), ('ppt', 'ppt', 'ole'), ('pptx', 'pptx', 'zip'), ('ps', 'ps', 'postscript'), ('eps', 'eps', 'postscript'), ('heic', 'heic', 'heif'), ('heic', 'heif', 'heif'), ('html', 'html', 'html'), ('html', 'htm', 'html'),
  ('html', 'xhtml', 'html'), ('svg', 'svg', 'svg'), ('mhtml', 'mhtml', 'mhtml'), ('mhtml', 'mht', 'mhtml'), ('eml', 'eml', 'email'), ('epub', 'epub', 'zip'), ('odp', 'odp', 'zip')"""


@query("format_lookup", f"SELECT doc_id, format, family FROM (SELECT doc_id, lower(regexp_extract({_name}, '[.]?([A-Za-z0-9]+)$', 1)) AS e FROM documents) q LEFT JOIN (VALUES {_formats}) f(format, extension, family) ON e = extension")
def format_lookup(spark, d):
    dim = S.format_table(spark).select("format", "extension", "family")
    return sniffable(spark, d).select("doc_id", S.extension_of(F.col("name")).alias("extension")).join(F.broadcast(dim), "extension", "left").select("doc_id", "format", "family")


@query("decode_text", "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 3 THEN 'é€' ELSE text END) AS digest FROM documents")
def decode_text(spark, d):
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.unhex(F.lit("E980")))
    return table(spark, d, "documents").select("doc_id", F.sha2(S.decode_text(content), 256).alias("digest"))


@query("text_source", r"""SELECT doc_id, rows::BIGINT AS rows, repeat('`', greatest(3, 1 + coalesce(longest, 0))::INTEGER) AS fence FROM (
  SELECT doc_id, list_sum([greatest(1, ceil(length(x) / 90.0)) for x in string_split(b, chr(10))]) AS rows, list_max([length(x) for x in regexp_extract_all(b, '`+')]) AS longest FROM (
  SELECT doc_id, regexp_replace(replace(text || CASE WHEN doc_id % 3 = 0 THEN '````x``' ELSE '' END, chr(13), chr(10)), '\n+$', '') AS b FROM documents) q) r""")
def text_source(spark, d):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "````x``").otherwise(""))
    b = S.text_block(t)
    return table(spark, d, "documents").select("doc_id", b["rows"].alias("rows"), b["fence"].alias("fence"))


_csv = "'\"a;b;c\"' || chr(10) || 'k' || CASE p_partkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END || p_name"


@query("delimiter_sniff", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter, 2 AS rows, 2 AS columns FROM part")
def delimiter_sniff(spark, d):
    sep = F.when(F.col("p_partkey") % 3 == 0, ",").when(F.col("p_partkey") % 3 == 1, ";").otherwise("\t")
    t = F.concat(F.lit('"a"\nk'), sep, "p_name")
    sized = lambda sep: once(S.padded_csv(t, sep), lambda rows: F.struct(sep.alias("delimiter"), F.size(rows).alias("rows"), F.size(rows[0]).alias("columns")))
    return table(spark, d, "part").select("p_partkey", F.inline(F.array(once(S.delimiter(t), sized))))


@query("csv_chunks", "SELECT o_orderstatus, chunk, count(*) AS rows FROM (SELECT o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 4000)::INTEGER AS chunk FROM orders) q GROUP BY ALL")
def csv_chunks(spark, d):
    return S.chunked(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").groupBy("o_orderstatus", "chunk").agg(F.count(F.lit(1)).alias("rows"))


@query("html_text")
def html_text(spark, d):
    out = packages.read_html(table(spark, d, "pages"))
    return out.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"), "title", "lang", F.size("headings").alias("headings"), F.size("links").alias("links"), "dropped_elements", "dropped_images")


@query("mail_source")
def mail_source(spark, d):
    c = table(spark, d, "conversations")
    raw = F.concat(F.lit("From: =?utf-8?B?w6k=?= <a@b>\nTo: c@d\nSubject: turn "), F.col("turn").cast("string"), F.lit("\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n\n"), F.col("text"))
    files = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), F.encode(raw, "UTF-8").alias("content"))
    return packages.read_mail(files, "file_id").select("file_id", "from", "subject", "kind", F.sha2("body", 256).alias("digest"), "attachments_dropped", "refusal")


# Rule sets.

TYPES = ("GoTo", "JavaScript", "URI", "Launch", "SubmitForm", "Named", "Unknown", "GoToR", "GoToE", "ImportData", "Rendition", "Movie", "Sound", "SetOCGState", "GoTo3DView", "Hide", "RichMediaExecute")
_type = "[" + ", ".join(f"'{t}'" for t in TYPES) + f"][(l_partkey % {len(TYPES)} + 1)::INTEGER]"
_risk = "CASE WHEN type IN ('JavaScript', 'Launch', 'SubmitForm', 'ImportData', 'GoToR', 'GoToE', 'Rendition') THEN 'high' WHEN type IN ('URI', 'Movie', 'Sound', 'SetOCGState', 'GoTo3DView', 'Hide', 'RichMediaExecute') THEN 'medium' END"


def actions(spark, d):
    """A chain per order: line k leads to k + 1, and the third back to the first."""
    li = table(spark, d, "lineitem")
    types = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    k = F.col("l_linenumber")
    own = li.groupBy(F.col("l_orderkey").alias("doc_id"), k.alias("action")).agg(F.min(types).alias("type"))
    k = F.col("action")
    return own.withColumn("next", F.when(k == 3, F.array(k + 1, F.lit(1))).otherwise(F.array(k + 1)))


@query("findings_by_severity", f"""WITH RECURSIVE a AS (SELECT l_orderkey AS doc_id, l_linenumber AS action, min({_type}) AS type FROM lineitem GROUP BY ALL),
  e AS (SELECT doc_id, action, action + 1 AS nxt FROM a UNION ALL SELECT doc_id, action, 1 FROM a WHERE action = 3),
  r AS (SELECT doc_id, action FROM a WHERE action = 2 UNION SELECT e.doc_id, e.nxt FROM r JOIN e ON r.doc_id = e.doc_id AND r.action = e.action)
  SELECT severity, rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, 'action:' || type AS rule, {_risk} AS severity FROM r JOIN a USING (doc_id, action)) q WHERE severity IS NOT NULL GROUP BY ALL""")
def findings_by_severity(spark, d):
    a = actions(spark, d)
    holders = a.where("action = 2").select("doc_id", F.lit("annotation").alias("holder"), "action")
    return R.action_findings(R.action_chains(a, holders)).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


_info = "['Author', 'Creator', 'Producer', 'Title', 'Subject', 'Keywords', 'Trapped']"
_catalog = f"""(SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'destination' END AS open_action, c_custkey % 4 = 0 AS aa, c_custkey % 5 = 0 AS javascript, c_custkey % 3 > 0 AS embedded_files, c_custkey % 8 = 0 AS associated_files,
  c_custkey % 9 = 0 AS renditions, c_custkey % 10 = 3 AS alternate_presentations, c_custkey % 7 = 0 AS xfa, c_custkey % 2 AS calculated, c_custkey % 6 AS off_page, c_custkey % 4 AS off_page_filled, c_custkey % 3 = 1 AS layers, c_custkey % 2 AS layers_off, c_custkey % 11 = 1 AS web_capture,
  c_custkey % 2 = 0 AS xmp, c_custkey % 3 AS xmp_holders, {_info}[(c_custkey % 7 + 1)::INTEGER] AS key, CASE WHEN c_custkey % 5 = 1 THEN '  ' ELSE ' ' || repeat(c_name, 6) END AS val FROM customer)"""


@query("document_findings", f"""WITH c AS (SELECT * FROM {_catalog} c) SELECT severity, kind, detail, count(*) AS n FROM (
  SELECT 'openAction' AS kind, 'high' AS severity, 'runs an action when it opens' AS detail FROM c WHERE open_action = 'action' UNION ALL SELECT 'additionalActions', 'medium', 'document' FROM c WHERE aa UNION ALL
  SELECT 'javascript', 'high', 'document' FROM c WHERE javascript UNION ALL SELECT 'attachment', 'medium', 'embedded files' FROM c WHERE embedded_files UNION ALL SELECT 'attachment', 'medium', 'associated files' FROM c WHERE associated_files UNION ALL
  SELECT 'media', 'medium', 'renditions' FROM c WHERE renditions UNION ALL SELECT 'slideshow', 'medium', 'alternate presentations' FROM c WHERE alternate_presentations UNION ALL SELECT 'xfa', 'medium', 'form' FROM c WHERE xfa UNION ALL
  SELECT 'offPageFields', CASE WHEN off_page_filled > 0 THEN 'medium' ELSE 'low' END, off_page || ' off the pages, ' || off_page_filled || ' filled' FROM c WHERE off_page > 0 UNION ALL SELECT 'additionalActions', 'medium', 'calculation order' FROM c WHERE calculated > 0 UNION ALL
  SELECT 'hiddenLayer', CASE WHEN layers_off > 0 THEN 'medium' ELSE 'low' END, layers_off || ' hidden' FROM c WHERE layers UNION ALL SELECT 'webCapture', 'low', 'record' FROM c WHERE web_capture UNION ALL SELECT 'metadata', 'low', 'catalogue' FROM c WHERE xmp UNION ALL
  SELECT 'metadata', 'low', (xmp_holders - xmp::INTEGER) || ' others' FROM c WHERE xmp_holders > xmp::INTEGER UNION ALL
  SELECT 'info', 'low', key || ': ' || CASE WHEN length(trim(val)) > 80 THEN substr(trim(val), 1, 80) || '…' ELSE trim(val) END FROM c WHERE key IN ('Author', 'Creator', 'Title', 'Subject', 'Keywords') AND trim(val) <> '') q GROUP BY ALL""")
def document_findings(spark, d):
    k = F.col("c_custkey")
    key = F.element_at(F.array(*map(F.lit, ("Author", "Creator", "Producer", "Title", "Subject", "Keywords", "Trapped"))), (k % 7 + 1).cast("int"))
    value = F.when(k % 5 == 1, "  ").otherwise(F.concat(F.lit(" "), F.repeat("c_name", 6)))
    c = table(spark, d, "customer").select(
        k.alias("doc_id"), F.when(k % 3 == 0, "action").when(k % 3 == 1, "destination").alias("open_action"), (k % 4 == 0).alias("aa"), (k % 5 == 0).alias("javascript"), (k % 3 > 0).alias("embedded_files"), (k % 8 == 0).alias("associated_files"), (k % 9 == 0).alias("renditions"),
        (k % 10 == 3).alias("alternate_presentations"), (k % 7 == 0).alias("xfa"), (k % 2).alias("calculated"), (k % 6).alias("off_page"), (k % 4).alias("off_page_filled"), (k % 3 == 1).alias("layers"), (k % 2).alias("layers_off"), (k % 11 == 1).alias("web_capture"),
        (k % 2 == 0).alias("xmp"), (k % 3).alias("xmp_holders"), F.create_map(key, value).alias("info"),
    )
    return R.findings(c).groupBy("severity", "kind", "detail").agg(F.count(F.lit(1)).alias("n"))


SUBTYPES = ("Link", "FileAttachment", "Sound", "Movie", "Screen", "RichMedia", "3D", "Widget")


@query("page_findings", """SELECT kind, severity, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(page)::BIGINT AS pages FROM (
  SELECT l_orderkey AS doc_id, l_linenumber AS page, 'additionalActions' AS kind, 'medium' AS severity FROM lineitem WHERE l_partkey % 6 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'attachment', 'medium' FROM lineitem WHERE l_suppkey % 7 = 0 UNION ALL
  SELECT user_id, event_id % 9, 'additionalActions', 'medium' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT user_id, event_id % 9, 'attachment', 'medium' FROM events WHERE event_id % 8 = 1 UNION ALL
  SELECT user_id, event_id % 9, 'media', 'medium' FROM events WHERE event_id % 8 IN (2, 3, 4) UNION ALL SELECT user_id, event_id % 9, 'media', 'high' FROM events WHERE event_id % 8 IN (5, 6) UNION ALL
  SELECT o_orderkey, 0, 'additionalActions', 'medium' FROM orders WHERE o_custkey % 4 = 0) q GROUP BY ALL""")
def page_findings(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 6 == 0).alias("aa"), (F.col("l_suppkey") % 7 == 0).alias("af"))
    e = F.col("event_id")
    annotations = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (e % 9).alias("page"), F.element_at(F.array(*map(F.lit, SUBTYPES)), (e % 8 + 1).cast("int")).alias("subtype"), (e % 5 == 0).alias("aa"))
    fields = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4 == 0).alias("aa"))
    found = R.page_findings(pages, annotations, fields)
    return found.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("page").cast("long").alias("pages"))


@query("outline_actions", f"""WITH RECURSIVE a AS (SELECT l_orderkey AS doc_id, l_linenumber AS action, min({_type}) AS type FROM lineitem GROUP BY ALL),
  e AS (SELECT doc_id, action, action + 1 AS nxt FROM a UNION ALL SELECT doc_id, action, 1 FROM a WHERE action = 3),
  r AS (SELECT o_orderkey AS doc_id, o_custkey % 4 + 1 AS holder, o_custkey % 4 + 1 AS action FROM orders UNION SELECT e.doc_id, holder, e.nxt FROM r JOIN e ON r.doc_id = e.doc_id AND r.action = e.action)
  SELECT doc_id, string_agg(type, ',' ORDER BY type, action) AS types, count(*) FILTER (WHERE risk = 'high') AS high FROM (SELECT doc_id, action, type, {_risk} AS risk FROM r JOIN a USING (doc_id, action)) q WHERE risk IS NOT NULL GROUP BY doc_id""")
def outline_actions(spark, d):
    a = actions(spark, d)
    start = (F.col("o_custkey") % 4 + 1).cast("int")
    holders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("outline "), start.cast("string")).alias("holder"), start.alias("action"))
    found = R.action_findings(R.action_chains(a, holders))
    one = F.sort_array(F.collect_list(F.regexp_replace("rule", "action:", "")))
    return found.groupBy("doc_id").agg(F.array_join(one, ",").alias("types"), F.count_if(F.col("severity") == "high").alias("high"))


@query("history_evicted", "SELECT user_id AS doc_id, bytes, sum(bytes) OVER (ORDER BY user_id DESC) > 100000 AS evicted FROM (SELECT user_id, sum(abs(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY user_id) q")
def history_evicted(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.rint(F.abs("value")).cast("long").alias("bytes"))
    return R.evicted(v, 100_000, 64)


def html_elements(spark, d):
    out = packages.read_html(table(spark, d, "pages"))
    return out.select(F.col("page_id").alias("doc_id"), F.explode("elements").alias("e")).select("doc_id", "e.id", "e.parent", "e.name")


ELEMENTS = ("table", "tr", "td", "li", "div", "ul", "th", "thead", "h1", "h2", "h3", "p")
_el = "[" + ", ".join(f"'{t}'" for t in ELEMENTS) + f"][((l_partkey + l_linenumber) % {len(ELEMENTS)} + 1)::INTEGER]"
SYNTHETIC = f"(SELECT l_orderkey AS doc_id, l_linenumber AS id, l_linenumber - 1 AS parent, min({_el}) AS name FROM lineitem GROUP BY ALL)"


def synthetic(spark, d):
    """A chain of elements per order: each line's parent is the line before."""
    name = F.element_at(F.array(*map(F.lit, ELEMENTS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(ELEMENTS) + 1).cast("int"))
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id")).agg(F.min(name).alias("name"))
    return own.select("doc_id", "id", (F.col("id") - 1).alias("parent"), "name")


#: What each element may stand in.
_clauses = """('7.2-tr', 'tr', ['table', 'thead', 'tbody', 'tfoot']), ('7.2-thead', 'thead', ['table']), ('7.2-tbody', 'tbody', ['table']), ('7.2-tfoot', 'tfoot', ['table']), ('7.2-th', 'th', ['tr']), ('7.2-td', 'td', ['tr']),
  ('7.2-li', 'li', ['ul', 'ol']), ('7.2-caption', 'caption', ['table']), ('7.2-dt', 'dt', ['dl']), ('7.2-dd', 'dd', ['dl']), ('7.2-figcaption', 'figcaption', ['figure'])"""


@query("ua_containment", f"""WITH e AS {SYNTHETIC}, t AS (SELECT e.doc_id, clause, list_contains(may, coalesce(p.name, '-')) AS ok FROM e JOIN (VALUES {_clauses}) c(clause, element, may) ON e.name = element LEFT JOIN e p ON p.doc_id = e.doc_id AND p.id = e.parent)
  SELECT clause, verdict, count(*) AS docs FROM (SELECT d.doc_id, c.clause, CASE WHEN bool_and(ok) IS NULL THEN 'not applicable' WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS verdict
  FROM (SELECT DISTINCT doc_id FROM e) d CROSS JOIN (SELECT clause FROM (VALUES {_clauses}) v(clause, element, may)) c LEFT JOIN t ON t.doc_id = d.doc_id AND t.clause = c.clause GROUP BY ALL) q GROUP BY ALL""")
def ua_containment(spark, d):
    return R.containment(synthetic(spark, d)).groupBy("clause", "verdict").agg(F.count(F.lit(1)).alias("docs"))


@query("ua_html_containment")
def ua_html_containment(spark, d):
    own = R.pass_through(html_elements(spark, d), ["div", "section", "span"])
    return R.containment(own).groupBy("clause", "verdict").agg(F.count(F.lit(1)).alias("docs"))


@query("ua_cardinality", f"""WITH e AS {SYNTHETIC} SELECT clause, verdict, count(*) AS docs FROM (SELECT p.doc_id, clause, CASE WHEN max(n) <= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM (
  SELECT p.doc_id, p.id, clause, count(c.id) AS n FROM e p JOIN (VALUES ('7.2-one-thead', 'table', 'thead'), ('7.2-one-tfoot', 'table', 'tfoot'), ('7.2-one-caption', 'table', 'caption'), ('7.2-one-figcaption', 'figure', 'figcaption')) k(clause, parent_name, child) ON p.name = parent_name
  LEFT JOIN e c ON c.doc_id = p.doc_id AND c.parent = p.id AND c.name = child GROUP BY ALL) p GROUP BY ALL) q GROUP BY ALL""")
def ua_cardinality(spark, d):
    return R.cardinality(synthetic(spark, d)).groupBy("clause", "verdict").agg(F.count(F.lit(1)).alias("docs"))


@query("ua_headings", f"""WITH e AS {SYNTHETIC}, h AS (SELECT doc_id, id, substr(name, 2, 1)::INTEGER AS level FROM e WHERE regexp_matches(name, '^h[1-6]$')),
  b AS (SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY id) AS before FROM h), j AS (SELECT doc_id, bool_or(CASE WHEN before IS NULL THEN level <> 1 ELSE level > before + 1 END) AS bad, count(*) AS n FROM b GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS headings, CASE WHEN bad IS NULL THEN 'not applicable' WHEN bad THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT DISTINCT doc_id FROM e) d LEFT JOIN j USING (doc_id)""")
def ua_headings(spark, d):
    return R.heading_nesting(synthetic(spark, d))


_verdict = "['pass', 'not applicable', 'fail', 'cannot check', 'pass', 'pass', 'pass'][(l_suppkey % 7 + 1)::INTEGER]"


@query("ua_standing", f"""SELECT l_orderkey AS doc_id, bool_and(v IN ('pass', 'not applicable')) AS conformant, CASE WHEN bool_or(v = 'fail') THEN 'fails' WHEN bool_or(v = 'cannot check') THEN 'not established' ELSE 'passes' END AS standing,
  count(*) FILTER (WHERE v = 'fail') AS failed, count(*) FILTER (WHERE v = 'cannot check') AS unresolved FROM (SELECT l_orderkey, {_verdict} AS v FROM lineitem) q GROUP BY 1""")
def ua_standing(spark, d):
    v = F.element_at(F.array(*map(F.lit, ("pass", "not applicable", "fail", "cannot check", "pass", "pass", "pass"))), (F.col("l_suppkey") % 7 + 1).cast("int"))
    return R.standing(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), v.alias("verdict")))


@query("signature_state", """SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (WHERE NOT ts) = 0 THEN CASE WHEN bool_or(b) THEN 'invalid' ELSE 'unsigned' END WHEN count(*) FILTER (WHERE NOT ts AND v) = count(*) FILTER (WHERE NOT ts) THEN 'valid' ELSE 'invalid' END AS state,
  coalesce(max(CASE WHEN NOT ts AND v THEN e END) < max(n), false) AS added_after FROM (SELECT l_orderkey, l_linenumber % 4 = 0 AS ts, l_partkey % 5 <> 0 AS v, l_partkey % 2 = 0 AS b, l_suppkey AS e, l_suppkey + l_linenumber % 2 AS n FROM lineitem) q GROUP BY 1""")
def signature_state(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4 == 0).alias("timestamp"), (F.col("l_partkey") % 5 != 0).alias("valid"), (F.col("l_partkey") % 2 == 0).alias("blob"), F.col("l_suppkey").alias("coverage_end"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("size"))
    return R.signature_state(li)


@query("undo_trim", "SELECT user_id AS doc_id, event_id AS version, kept_bytes FROM (SELECT user_id, event_id, row_number() OVER w AS k, sum(abs(value)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS kept_bytes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC)) q WHERE k <= 30")
def undo_trim(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), F.rint(F.abs("value")).cast("long").alias("bytes"))
    return R.trimmed_history(v).select("doc_id", "version", "kept_bytes")


@query("content_digest", "SELECT l_orderkey AS doc_id, sha256('v8:' || lpad(upper(to_hex(count(*))), 16, '0') || string_agg(lpad(upper(to_hex(octet_length(encode(c)))), 16, '0') || c, '' ORDER BY l_linenumber)) AS digest FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus || l_partkey) AS c FROM lineitem GROUP BY ALL) q GROUP BY 1")
def content_digest(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"))
    return R.content_digest(c.agg(F.min(F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))).alias("data")))


@query("shrink_ladder", "SELECT doc_id, rung, shrunk, met FROM (SELECT doc_id, bytes, coalesce(list_min([k for k in range(1, 7) if floor(bytes * [0.9::DOUBLE, 0.75::DOUBLE, 0.6::DOUBLE, 0.45::DOUBLE, 0.3::DOUBLE, 0.15::DOUBLE][k]) <= 800]), 6)::INTEGER AS rung, floor(bytes * 0.15::DOUBLE) <= 800 AS met FROM (SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents) a) q, LATERAL (SELECT floor(bytes * [0.9::DOUBLE, 0.75::DOUBLE, 0.6::DOUBLE, 0.45::DOUBLE, 0.3::DOUBLE, 0.15::DOUBLE][rung])::BIGINT AS shrunk) s")
def shrink_ladder(spark, d):
    sizes = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return R.shrunk_to(sizes, 800).select("doc_id", "rung", "shrunk", "met")


@query("ocr_groups", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos)::INTEGER AS group_no, first_pos, text FROM (
  SELECT doc_id, min(pos) AS first_pos, string_agg(t, ' ' ORDER BY line, pos) AS text FROM (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey % 3 AS block, l_suppkey % 2 AS para, l_quantity % 3 AS line, l_shipmode AS t FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) || l_linenumber AS l_shipmode FROM lineitem GROUP BY l_orderkey, l_linenumber) l) q
  GROUP BY doc_id, CASE WHEN block = 0 OR para = 0 THEN -pos ELSE block * 10 + para END) r""")
def ocr_groups(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))
    w = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 3).alias("block"), (F.col("l_suppkey") % 2).alias("para"), (F.col("l_quantity") % 3).alias("line"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return R.ocr_groups(w)


@query("hyphen_evidence")
def hyphen_evidence(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"(\p{L}{3})(\p{L}{3}) ", "$1-\n$2 "))
    return R.hyphen_evidence(lines(docs))


@query("watch_settle_batch")
def watch_settle_batch(spark, d):
    e = table(spark, d, "events")
    listings = e.select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("path"), (F.col("event_id") % 25).alias("scan"), (F.rint("value") % 3).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), (F.col("event_id") % 4 != 0).alias("ok"))
    listings = listings.where(F.substring("path", 2, 9).cast("int") % 5 <= F.col("scan")).groupBy("path", "scan").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"), F.bool_and("ok").alias("ok"))
    return W.replay(listings)


@query("watch_reacts")
def watch_reacts(spark, d):
    """As ``watch_settle_batch``, but a file that changes after it was done acts again."""
    e = table(spark, d, "events")
    listings = e.select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("path"), (F.col("event_id") % 25).alias("scan"), F.lit(1).cast("long").alias("mtime"), (F.col("event_id") % 4 != 0).alias("ok"), F.floor(F.col("event_id") % 50 / 12).cast("long").alias("size"))
    return W.replay(listings.groupBy("path", "scan").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"), F.bool_and("ok").alias("ok")), react=True)


def history_events(spark, d):
    """A user's events as commits, undos and redos of one document."""
    op = "element_at(array('commit', 'commit', 'undo', 'commit', 'redo', 'commit', 'undo', 'undo', 'redo', 'barrier', 'commit'), cast(event_id % 11 + 1 AS int))"
    return table(spark, d, "events").selectExpr("cast(user_id AS long) AS doc_id", "cast(event_id AS long) AS seq", f"CASE WHEN event_id % 97 = 5 THEN 'close' ELSE {op} END AS op", "CASE WHEN event_id % 3 = 0 THEN cast(event_id % 4 AS long) END AS base_rev", "sha2(cast(event_id AS string), 256) AS digest", "cast(rint(abs(value)) AS long) AS bytes")


@query("undo_history")
def undo_history(spark, d):
    """Every event's outcome, of small histories: six states, 400 bytes."""
    return H.kept_history(history_events(spark, d), depth=6, budget=400)
