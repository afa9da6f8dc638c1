"""Queries on the accessibility clauses. Subjects are made from the tables by fixed
arithmetic, in Spark and SQL alike; the SQL states each clause again, in literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.operators import clauses as C
from quirespark.plans.bridge import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def pick(values, key: str) -> tuple[str, str]:
    """One of the values by the key's remainder, in both dialects; None is null."""
    shown = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({shown}), cast(({key}) % {len(values)} + 1 AS int))", f"([{shown}])[(({key}) % {len(values)} + 1)::INTEGER]"


def made(columns: dict, source: str) -> tuple[list[str], str]:
    """Column expressions for Spark and a subquery for SQL, of {name: expression or pick}."""
    both = {k: v if isinstance(v, tuple) else (v, v) for k, v in columns.items()}
    return [f"{s} AS {k}" for k, (s, _) in both.items()], "(SELECT " + ", ".join(f"{d} AS {k}" for k, (_, d) in both.items()) + f" FROM {source})"


def judged(subjects: str, clauses, docs: str) -> str:
    """SQL of the verdicts counted by clause: subjects and docs are queries with doc_id."""
    rows = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS clause, coalesce({ok}, false) AS ok FROM subjects WHERE {who}" for c, who, ok in clauses)
    names = ", ".join(f"('{c}')" for c, *_ in clauses)
    return f"""WITH subjects AS ({subjects}), t AS ({rows}), j AS (SELECT doc_id, clause, bool_and(ok) AS ok FROM t GROUP BY ALL),
      e AS (SELECT d.doc_id, v.clause FROM (SELECT DISTINCT doc_id FROM {docs} d) d CROSS JOIN (VALUES {names}) v(clause))
      SELECT clause, CASE WHEN ok IS NULL THEN 'not applicable' WHEN ok THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS docs FROM e LEFT JOIN j USING (doc_id, clause) GROUP BY ALL"""


def counted(verdicts):
    return verdicts.groupBy("clause", "verdict").agg(F.count(F.lit(1)).alias("docs"))


# The catalogue.

_k = "c_custkey"
CATALOG, _catalog = made({
    "doc_id": _k, "xmp": f"{_k} % 9 <> 0", "ua_part": pick(("1", "2", None, "1"), f"{_k} + floor({_k} / 4)"), "part_prefix": pick(("pdfuaid", "ua"), f"{_k} + floor({_k} / 9)"),
    "amd_prefix": pick((None, "pdfuaid", "x"), _k), "corr_prefix": pick((None, "x", "pdfuaid", None), _k), "header": pick(("%PDF-1.7", "%PDF-2.0", "%PDF-1.4", " %PDF-1.7"), f"{_k} + 1"),
    "marked": f"{_k} % 6 <> 1", "suspects": f"{_k} % 11 = 2", "title": pick(("A title", "", None), _k), "display_title": f"{_k} % 5 = 1", "structure_root": f"{_k} % 8 <> 3", "metadata_text": f"{_k} % 4 = 0",
    "page_text": f"{_k} % 3 <> 0", "lang": pick(("en", "", "de-DE", None, "fr"), _k), "layer_configs": f"{_k} % 3", "unnamed_configs": f"{_k} % 2", "auto_state": f"{_k} % 7 = 4", "files": f"{_k} % 4",
    "unnamed_files": f"{_k} % 5 - {_k} % 5 % 2", "xfa": pick((None, None, "static", "dynamic"), _k), "permissions": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 64 END", "forms": f"{_k} % 2", "reference_forms": f"{_k} % 3",
    "structured_forms": f"{_k} % 5", "redrawn_forms": f"{_k} % 4",
}, "customer")


@query("ua_catalog", judged(f"SELECT * FROM {_catalog} c", (
    ("5 t1", "xmp", "ua_part IS NOT NULL"), ("5 t2", "ua_part IS NOT NULL", "ua_part = '1'"), ("5 t3", "ua_part IS NOT NULL", "part_prefix = 'pdfuaid'"), ("5 t4", "amd_prefix IS NOT NULL", "amd_prefix = 'pdfuaid'"),
    ("5 t5", "corr_prefix IS NOT NULL", "corr_prefix = 'pdfuaid'"), ("6.1 t1", "true", "regexp_full_match(header, '%PDF-1\\.[0-7]')"), ("6.2 t1", "true", "marked"), ("7.1 t4", "true", "NOT suspects"), ("7.1 t8", "true", "xmp"),
    ("7.1 t9", "xmp", "length(title) > 0"), ("7.1 t10", "true", "display_title"), ("7.1 t11", "true", "structure_root"), ("7.2 t33", "metadata_text", "length(lang) > 0"), ("7.2 t34", "page_text", "length(lang) > 0"),
    ("7.10 t1", "layer_configs > 0", "unnamed_configs = 0"), ("7.10 t2", "layer_configs > 0", "NOT auto_state"), ("7.11 t1", "files > 0", "unnamed_files = 0"), ("7.15 t1", "xfa IS NOT NULL", "xfa = 'static'"),
    ("7.16 t1", "permissions IS NOT NULL", "permissions // 512 % 2 = 1"), ("7.20 t1", "forms > 0", "reference_forms = 0"), ("7.20 t2", "structured_forms > 0", "redrawn_forms = 0"),
), _catalog))
def ua_catalog(spark, d):
    rows = table(spark, d, "customer").selectExpr(*CATALOG)
    return counted(C.judged(rows, C.CATALOG, rows))


# Structure elements: a tree of at most seven an order; the first has four kids, the second two.

NAMES = ("Table", "TR", "TH", "Table", "TD", "THead", "L", "TBody", "TFoot", "Caption", "LI", "Lbl", "TR", "LBody", "TOC", "TOCI", "Figure", "Formula", "Note", "Form", "H", "H1", "Div", "H2", None, "Part", "L", "P")
_lines = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::INTEGER AS q FROM lineitem GROUP BY ALL"
ELEMENTS, _elements = made({
    "doc_id": "l_orderkey", "id": ("cast(l_linenumber AS int)", "l_linenumber::INTEGER"), "parent": "cast(CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END AS int)", "name": pick(NAMES, "p + 3 * l_linenumber"),
    "alt": pick((None, "", "a picture", None), "s"), "actual_text": pick((None, None, "", "text", None), "p"), "expansion": pick((None, "expanded", None), "s + p"), "lang": pick((None, "en", None, "", "not a tag", None, "de-DE"), "s + l_linenumber"),
    "note_id": pick((None, "n1", "", "n2", "n3"), "s"), "role": pick((None, "rb"), "s"), "widgets": "s % 3", "other_kids": "p % 2",
}, f"({_lines}) l")


def elements(spark, d):
    own = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"))
    return own.selectExpr(*ELEMENTS)


def tree(spark, d):
    """Without pass-through elements."""
    from quirespark.operators.rules import pass_through

    return pass_through(elements(spark, d), list(C.PASS_THROUGH))


#: Each element's nearest ancestor that is not passed through.
_tree = f"""e AS (SELECT * FROM {_elements} x), up(doc_id, id, parent) AS (SELECT doc_id, id, parent FROM e WHERE coalesce(name, '') NOT IN ('NonStruct', 'Div', 'Part')
  UNION ALL SELECT up.doc_id, up.id, a.parent FROM up JOIN e a ON a.doc_id = up.doc_id AND a.id = up.parent WHERE a.name IN ('NonStruct', 'Div', 'Part')),
  n AS (SELECT e.doc_id, e.id, min(up.parent) AS parent, any_value(e.name) AS name FROM e JOIN up ON up.doc_id = e.doc_id AND up.id = e.id GROUP BY e.doc_id, e.id),
  kids AS (SELECT doc_id, parent AS id, list(name ORDER BY id) FILTER (WHERE name IS NOT NULL) AS kids FROM n GROUP BY ALL)"""
_with_kids = f"WITH RECURSIVE {_tree} SELECT n.*, coalesce(kids, []) AS kids, a.name AS above FROM n LEFT JOIN kids USING (doc_id, id) LEFT JOIN n a ON a.doc_id = n.doc_id AND a.id = n.parent"
_only = lambda *may: "len([k for k in kids if k NOT IN (" + ", ".join(f"'{m}'" for m in may) + ")]) = 0"
_in = lambda *may: "above IN (" + ", ".join(f"'{m}'" for m in may) + ")"
#: Documents of which any element is left.
_docs = f"(SELECT DISTINCT doc_id FROM {_elements} x WHERE coalesce(name, '') NOT IN ('NonStruct', 'Div', 'Part'))"


@query("ua_tag_containment", judged(_with_kids, (
    ("7.2 t3", "name = 'Table'", _only("TR", "THead", "TBody", "TFoot", "Caption")), ("7.2 t4", "name = 'TR'", _in("Table", "THead", "TBody", "TFoot")), ("7.2 t5", "name = 'THead'", _in("Table")), ("7.2 t6", "name = 'TBody'", _in("Table")),
    ("7.2 t7", "name = 'TFoot'", _in("Table")), ("7.2 t8", "name = 'TH'", _in("TR")), ("7.2 t9", "name = 'TD'", _in("TR")), ("7.2 t10", "name = 'TR'", _only("TH", "TD")), ("7.2 t17", "name = 'LI'", _in("L")), ("7.2 t18", "name = 'LBody'", _in("LI")),
    ("7.2 t19", "name = 'L'", _only("L", "LI", "Caption")), ("7.2 t20", "name = 'LI'", _only("Lbl", "LBody")), ("7.2 t26", "name = 'TOCI'", _in("TOC")), ("7.2 t27", "name = 'TOC'", _only("TOC", "TOCI", "Caption")),
    ("7.2 t36", "name = 'THead'", _only("TR")), ("7.2 t37", "name = 'TBody'", _only("TR")), ("7.2 t38", "name = 'TFoot'", _only("TR")),
), _docs))
def ua_tag_containment(spark, d):
    return counted(C.containment(tree(spark, d)))


_n = lambda name: f"len([k for k in kids if k = '{name}'])"
_late = "coalesce(list_contains(kids[2:], 'Caption'), false)"


@query("ua_kid_sequences", judged(_with_kids, (
    ("7.2 t11", "name = 'Table'", f"{_n('THead')} < 2"), ("7.2 t12", "name = 'Table'", f"{_n('TFoot')} < 2"), ("7.2 t13", "name = 'Table'", f"{_n('TFoot')} = 0 OR {_n('TBody')} > 0"), ("7.2 t14", "name = 'Table'", f"{_n('THead')} = 0 OR {_n('TBody')} > 0"),
    ("7.2 t16", "name = 'Table'", "NOT coalesce(list_contains(kids[2:-2], 'Caption'), false)"), ("7.2 t28", "name = 'TOC'", f"NOT {_late}"), ("7.2 t39", "name = 'Table'", f"{_n('Caption')} < 2"), ("7.2 t40", "name = 'L'", f"NOT {_late}"), ("7.4.4 t1", "true", f"{_n('H')} < 2"),
), _docs))
def ua_kid_sequences(spark, d):
    return counted(C.sequences(tree(spark, d)))


@query("ua_described", judged(f"SELECT *, count(note_id) OVER (PARTITION BY doc_id, name, note_id) AS same FROM {_elements} x", (
    ("7.3 t1", "name = 'Figure'", "actual_text IS NOT NULL OR length(alt) > 0"), ("7.7 t1", "name = 'Formula'", "actual_text IS NOT NULL OR length(alt) > 0"), ("7.9 t1", "name = 'Note'", "length(note_id) > 0"),
    ("7.9 t2", "name = 'Note'", "note_id IS NULL OR same = 1"), ("7.18.4 t2", "name = 'Form' AND role IS NULL", "widgets = 1 AND other_kids = 0"),
), f"{_elements}"))
def ua_described(spark, d):
    return counted(C.described(elements(spark, d)))


@query("ua_heading_styles", judged(f"SELECT doc_id, count(*) FILTER (WHERE name = 'H') AS h, count(*) FILTER (WHERE name IN ('H1', 'H2', 'H3', 'H4', 'H5', 'H6')) AS hn FROM {_elements} x GROUP BY doc_id", (
    ("7.4.4 t2", "h > 0", "hn = 0"), ("7.4.4 t3", "hn > 0", "h = 0")), f"{_elements}"))
def ua_heading_styles(spark, d):
    return counted(C.heading_styles(elements(spark, d)))


_doc_lang = pick((None, "en", ""), "o_custkey")


@query("ua_languages", judged(f"""WITH RECURSIVE e AS (SELECT * FROM {_elements} x), up(doc_id, id, here, lang) AS (SELECT doc_id, id, parent, nullif(lang, '') FROM e
  UNION ALL SELECT up.doc_id, up.id, a.parent, nullif(a.lang, '') FROM up JOIN e a ON a.doc_id = up.doc_id AND a.id = up.here WHERE up.lang IS NULL),
  near AS (SELECT doc_id, id, max(lang) AS lang FROM up GROUP BY ALL)
  SELECT e.*, coalesce(near.lang, o.lang, '') AS spoken FROM e JOIN near USING (doc_id, id) LEFT JOIN (SELECT o_orderkey AS doc_id, {_doc_lang[1]} AS lang FROM orders) o USING (doc_id)""", (
    ("7.2 t21", "actual_text IS NOT NULL", "spoken <> ''"), ("7.2 t22", "alt IS NOT NULL", "spoken <> ''"), ("7.2 t23", "expansion IS NOT NULL", "spoken <> ''"), ("7.2 t29", "lang <> ''", "regexp_full_match(lang, '[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*')"),
), f"{_elements}"))
def ua_languages(spark, d):
    docs = table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", f"{_doc_lang[0]} AS lang")
    return counted(C.languages(elements(spark, d), docs))


@query("ua_outline_languages", judged(f"SELECT o_orderkey AS doc_id, {_doc_lang[1]} AS lang FROM orders", (("7.2 t2", "true", "lang <> ''"),), "(SELECT o_orderkey AS doc_id FROM orders)"))
def ua_outline_languages(spark, d):
    return counted(C.outline_languages(table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", f"{_doc_lang[0]} AS lang")))


#: Names as written, and where the document's role map sends them.
WRITTEN = ("P", "Heading", "Body", "Loop", "Knot", "Table", "Free")
_to = {"Heading": ("Body", "H1", "Free"), "Body": ("P", "Loop", "H1"), "Loop": ("Knot",), "Knot": ("Loop",), "P": ("P", "Table", None)}
_map_rows = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{name}' AS name, {{}} AS target FROM orders" for name in _to)
ROLES = [pick(to, "o_custkey") for to in _to.values()]


@query("ua_role_maps", judged(f"""WITH RECURSIVE m AS (SELECT * FROM ({_map_rows.format(*(r[1] for r in ROLES))}) x WHERE target IS NOT NULL), n AS (SELECT DISTINCT l_orderkey AS doc_id, {pick(WRITTEN, "l_partkey")[1]} AS name FROM lineitem),
  w(doc_id, name, here, steps) AS (SELECT doc_id, name, name, 0 FROM n UNION ALL SELECT w.doc_id, w.name, m.target, steps + 1 FROM w JOIN m ON m.doc_id = w.doc_id AND m.name = w.here WHERE w.here NOT IN ('P', 'Table', 'H1') AND steps < 9)
  SELECT n.doc_id, n.name IN ('P', 'Table', 'H1') AS standard, bool_or(here IN ('P', 'Table', 'H1')) AS reaches, max(steps) = 9 AS circular, bool_or(m.target <> n.name) AS moved FROM n JOIN w USING (doc_id, name) LEFT JOIN m ON m.doc_id = n.doc_id AND m.name = n.name GROUP BY n.doc_id, n.name""", (
    ("7.1 t5", "NOT standard", "reaches OR circular"), ("7.1 t6", "NOT standard", "NOT circular"), ("7.1 t7", "standard", "NOT coalesce(moved, false)")), "(SELECT l_orderkey AS doc_id FROM lineitem)"))
def ua_role_maps(spark, d):
    orders = table(spark, d, "orders")
    mapped = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.expr(r[0]).alias("to")) for n, r in zip(_to, ROLES)))).alias("m"))
    mapped = mapped.select("doc_id", "m.name", "m.to").where("to IS NOT NULL")
    names = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", f"{pick(WRITTEN, 'l_partkey')[0]} AS name")
    return counted(C.role_maps(names, mapped, ("P", "Table", "H1")))


# Content, annotations, fonts.

CONTENT, _content = made({
    "doc_id": "l_orderkey", "artifact": "l_partkey % 3 = 0", "tagged": "l_partkey % 3 = 1", "drawn": "l_suppkey % 2 = 0", "in_tagged": "l_suppkey % 5 = 0", "in_artifact": "l_partkey % 7 = 0",
    "actual_text": pick((None, "t", None, None), "l_partkey"), "alt": pick((None, None, "a"), "l_suppkey"), "expansion": pick((None, "e", None, None, None), "l_suppkey"), "spoken": pick(("en", "", "de"), "l_partkey + l_suppkey"),
}, "lineitem")


@query("ua_content", judged(f"SELECT * FROM {_content} c", (
    ("7.1 t1", "artifact", "NOT in_tagged"), ("7.1 t2", "tagged", "NOT in_artifact"), ("7.1 t3", "drawn", "artifact OR tagged OR in_artifact OR in_tagged"),
    ("7.2 t30", "actual_text IS NOT NULL", "length(spoken) > 0"), ("7.2 t31", "alt IS NOT NULL", "length(spoken) > 0"), ("7.2 t32", "expansion IS NOT NULL", "length(spoken) > 0"),
), _content))
def ua_content(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(*CONTENT)
    return counted(C.judged(rows, C.CONTENT, rows))


ANNOTATIONS, _annotations = made({
    "doc_id": ("cast(floor(event_id / 3) AS long)", "event_id // 3"), "subtype": pick(("Link", "Widget", "Text", "PrinterMark", "Screen", "Link", "Highlight", "Widget", "TrapNet"), "event_id"), "exempt": "event_id % 6 = 5", "inside": pick(("Annot", "Link", None, "Form", "P"), "event_id + floor(event_id / 7)"),
    "inside_alt": pick((None, "", "alt"), "event_id"), "contents": pick((None, "about", "", "more"), "event_id"), "tooltip": pick(("tip", None, ""), "floor(event_id / 9)"), "tab_order": pick(("S",) * 40 + ("R", None), "event_id + user_id"),
    "media_clip": "event_id % 7 = 4", "clip_type": pick(("video/mp4", "", None), "event_id + 1"), "clip_alternates": "event_id % 4 <> 1", "spoken": pick(("en", "", "en", "en"), "event_id"),
}, "events")


@query("ua_annotations", judged(f"SELECT * FROM {_annotations} a", (
    ("7.18.1 t1", "NOT exempt AND subtype IN ('Text', 'Screen', 'Highlight', 'TrapNet')", "inside = 'Annot'"), ("7.18.1 t2", "NOT exempt AND subtype <> 'Widget'", "length(contents) > 0 OR length(inside_alt) > 0"),
    ("7.18.1 t3", "NOT exempt AND subtype = 'Widget'", "length(tooltip) > 0 OR length(inside_alt) > 0"), ("7.18.2 t1", "true", "subtype <> 'TrapNet'"), ("7.18.3 t1", "true", "tab_order = 'S'"), ("7.18.4 t1", "NOT exempt AND subtype = 'Widget'", "inside = 'Form'"),
    ("7.18.5 t1", "NOT exempt AND subtype = 'Link'", "inside = 'Link'"), ("7.18.5 t2", "NOT exempt AND subtype = 'Link'", "length(contents) > 0"), ("7.18.6.2 t1", "media_clip", "length(clip_type) > 0"), ("7.18.6.2 t2", "media_clip", "clip_alternates"),
    ("7.18.8 t1", "subtype = 'PrinterMark'", "inside IS NULL"), ("7.2 t24", "contents IS NOT NULL", "length(spoken) > 0"), ("7.2 t25", "tooltip IS NOT NULL", "length(spoken) > 0"),
), _annotations))
def ua_annotations(spark, d):
    rows = table(spark, d, "events").selectExpr(*ANNOTATIONS)
    return counted(C.judged(rows, C.ANNOTATIONS, rows))


_p = "p_partkey"
FONTS, _fonts = made({
    "doc_id": _p, "cid": f"{_p} % 2 = 0", "truetype": f"{_p} % 2 = 1", "embedded": f"{_p} % 5 <> 0", "drawn": f"{_p} % 7 <> 0", "identity_map": f"{_p} % 4 = 0",
    "collection": pick(("Japan1", "GB1"), f"floor({_p} / 2)"), "map_collection": pick(("Japan1", "Japan1", "GB1"), f"floor({_p} / 2)"), "cid_kind": f"{_p} % 3", "cid_to_glyph": f"{_p} % 8 <> 2", "map_predefined": f"{_p} % 3 = 0", "map_embedded": f"{_p} % 3 = 1",
    "map_mode": f"{_p} % 2", "dictionary_mode": f"{_p} % 11 % 2", "map_uses": pick((None, "H", "V"), f"floor({_p} / 3)"), "map_uses_predefined": f"{_p} % 10 < 8", "missing_glyphs": f"{_p} % 6 % 2", "char_set": pick((None, "/A"), f"floor({_p} / 5)"), "unlisted_glyphs": f"{_p} % 4",
    "cid_set": f"{_p} % 9 < 2", "unlisted_cids": f"{_p} % 2", "width_error": f"{_p} % 13 * 0.25", "symbolic": f"{_p} % 3 = 2", "usable_cmaps": f"floor({_p} / 3) % 3", "encoding": pick((None, "WinAnsiEncoding", "StandardEncoding", "MacRomanEncoding"), f"floor({_p} / 6)"), "cmaps": f"{_p} % 3",
    "cmap_3_0": f"{_p} % 5 = 1", "unmapped_codes": f"{_p} % 8 % 3", "bad_unicodes": f"{_p} % 12 % 5", "notdef_drawn": f"{_p} % 14 = 3",
}, "part")


@query("ua_fonts", judged(f"SELECT * FROM {_fonts} f", (
    ("7.21.3.1 t1", "cid AND NOT identity_map", "collection = map_collection"), ("7.21.3.2 t1", "cid AND embedded AND cid_kind = 2", "cid_to_glyph"), ("7.21.3.3 t1", "cid", "map_predefined OR map_embedded"), ("7.21.3.3 t2", "map_embedded", "map_mode = dictionary_mode"),
    ("7.21.3.3 t3", "map_embedded AND map_uses IS NOT NULL", "map_uses_predefined"), ("7.21.4.1 t1", "drawn", "embedded"), ("7.21.4.1 t2", "drawn AND embedded", "missing_glyphs = 0"), ("7.21.4.2 t1", "char_set IS NOT NULL", "unlisted_glyphs = 0"),
    ("7.21.4.2 t2", "cid_set", "unlisted_cids = 0"), ("7.21.5 t1", "drawn AND embedded", "width_error <= 1"), ("7.21.6 t1", "truetype AND NOT symbolic", "usable_cmaps > 0"), ("7.21.6 t2", "truetype AND NOT symbolic", "encoding = 'MacRomanEncoding' OR encoding = 'WinAnsiEncoding'"),
    ("7.21.6 t3", "truetype AND symbolic", "encoding IS NULL"), ("7.21.6 t4", "truetype AND symbolic", "cmaps = 1 OR cmap_3_0"), ("7.21.7 t1", "drawn", "unmapped_codes = 0"), ("7.21.7 t2", "drawn", "bad_unicodes = 0"), ("7.21.8 t1", "drawn", "NOT notdef_drawn"),
), _fonts))
def ua_fonts(spark, d):
    rows = table(spark, d, "part").selectExpr(*FONTS)
    return counted(C.judged(rows, C.FONTS, rows))


def cells(spark, d):
    """Tables of an order's lines: up to three cells a row, some spans, some scopes; an order whose first key is 0 in 9 has an empty row."""
    n = "l_linenumber"
    li = table(spark, d, "lineitem").groupBy("l_orderkey", n).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    width = "(l_orderkey % 3 + 1)"
    own = li.selectExpr(
        "l_orderkey AS doc_id", "cast(0 AS int) AS table", f"cast(floor(({n} - 1) / {width}) AS int) AS row", f"cast(if(p % 97 = 0, -1, {n}) AS int) AS pos", f"{n} <= {width} AS header", "cast(if(p % 11 = 0, 2, 1) AS int) AS columns",
        "cast(if(s % 13 = 0, 2, 1) AS int) AS rows", f"{pick(('Column', None, 'Row'), 'l_orderkey + s')[0]} AS scope", f"concat('h', {n}) AS id", f"{pick((None, 'h1', 'h2 h9'), 'p')[0]} AS headers",
    )
    return own


@query("ua_table_clauses")
def ua_table_clauses(spark, d):
    return counted(C.tables(cells(spark, d)))


@query("ua_table_layouts")
def ua_table_layouts(spark, d):
    from quirespark.operators.rules import by_document

    def fold(rows):
        fault, headers, slots = C.table_layout(rows)
        yield fault or "regular", headers, slots

    own = cells(spark, d)
    return by_document(own, ["row", "pos", "header", "columns", "rows", "scope", "id", "headers"], fold, "fault string, header_fault string, slots int")
