"""Accessibility clauses as predicates over subject tables.

A clause asks something of each subject of one kind: the document's catalogue row, a
structure element, an annotation, a piece of content, a font, a table. ``judged`` asks
all clauses of a kind in one scan. Its verdict per document and clause is "fail" when a
subject breaks it, "pass" when there are subjects and none does, else "not applicable".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.rules import by_document, union

#: Fixed values of this module: clauses as (name, who is asked, what must hold), in SQL.
CATALOG = (
    ("5 t1", "xmp", "ua_part IS NOT NULL"),
    ("5 t2", "ua_part IS NOT NULL", "ua_part = '1'"),
    ("5 t3", "ua_part IS NOT NULL", "part_prefix = 'pdfuaid'"),
    ("5 t4", "amd_prefix IS NOT NULL", "amd_prefix = 'pdfuaid'"),
    ("5 t5", "corr_prefix IS NOT NULL", "corr_prefix = 'pdfuaid'"),
    ("6.1 t1", "true", "header RLIKE '^%PDF-1[.][0-7]$'"),
    ("6.2 t1", "true", "marked"),
    ("7.1 t4", "true", "NOT suspects"),
    ("7.1 t8", "true", "xmp"),
    ("7.1 t9", "xmp", "title <> ''"),
    ("7.1 t10", "true", "display_title"),
    ("7.1 t11", "true", "structure_root"),
    ("7.2 t33", "metadata_text", "lang <> ''"),
    ("7.2 t34", "page_text", "lang <> ''"),
    ("7.10 t1", "layer_configs > 0", "unnamed_configs = 0"),
    ("7.10 t2", "layer_configs > 0", "NOT auto_state"),
    ("7.11 t1", "files > 0", "unnamed_files = 0"),
    ("7.15 t1", "xfa IS NOT NULL", "xfa <> 'dynamic'"),
    ("7.16 t1", "permissions IS NOT NULL", "(permissions & 512) <> 0"),
    ("7.20 t1", "forms > 0", "reference_forms = 0"),
    ("7.20 t2", "structured_forms > 0", "redrawn_forms = 0"),
)

#: Clause, subject, the parents that it may have.
PARENTS = (
    ("7.2 t4", "TR", ("Table", "THead", "TBody", "TFoot")), ("7.2 t5", "THead", ("Table",)), ("7.2 t6", "TBody", ("Table",)), ("7.2 t7", "TFoot", ("Table",)),
    ("7.2 t8", "TH", ("TR",)), ("7.2 t9", "TD", ("TR",)), ("7.2 t17", "LI", ("L",)), ("7.2 t18", "LBody", ("LI",)), ("7.2 t26", "TOCI", ("TOC",)),
)

#: Clause, subject, the standard types that its kids may have.
KIDS = (
    ("7.2 t3", "Table", ("TR", "THead", "TBody", "TFoot", "Caption")), ("7.2 t10", "TR", ("TH", "TD")), ("7.2 t19", "L", ("L", "LI", "Caption")), ("7.2 t20", "LI", ("Lbl", "LBody")),
    ("7.2 t27", "TOC", ("TOC", "TOCI", "Caption")), ("7.2 t36", "THead", ("TR",)), ("7.2 t37", "TBody", ("TR",)), ("7.2 t38", "TFoot", ("TR",)),
)

#: Over an element's standard kids in order (``kids``): cardinality and place.
SEQUENCES = (
    ("7.2 t11", "name = 'Table'", "size(filter(kids, k -> k = 'THead')) <= 1"),
    ("7.2 t12", "name = 'Table'", "size(filter(kids, k -> k = 'TFoot')) <= 1"),
    ("7.2 t13", "name = 'Table'", "NOT array_contains(kids, 'TFoot') OR array_contains(kids, 'TBody')"),
    ("7.2 t14", "name = 'Table'", "NOT array_contains(kids, 'THead') OR array_contains(kids, 'TBody')"),
    ("7.2 t16", "name = 'Table'", "NOT exists(filter(kids, (k, i) -> i > 0 AND i < size(kids) - 1), k -> k = 'Caption')"),
    ("7.2 t28", "name = 'TOC'", "NOT exists(filter(kids, (k, i) -> i > 0), k -> k = 'Caption')"),
    ("7.2 t39", "name = 'Table'", "size(filter(kids, k -> k = 'Caption')) <= 1"),
    ("7.2 t40", "name = 'L'", "NOT exists(filter(kids, (k, i) -> i > 0), k -> k = 'Caption')"),
    ("7.4.4 t1", "true", "size(filter(kids, k -> k = 'H')) <= 1"),
)

#: Of one element: replacement text, note ids (``same_id``: notes of the document with it), form kids.
ELEMENTS = (
    ("7.3 t1", "name = 'Figure'", "actual_text IS NOT NULL OR alt <> ''"),
    ("7.7 t1", "name = 'Formula'", "actual_text IS NOT NULL OR alt <> ''"),
    ("7.9 t1", "name = 'Note'", "note_id <> ''"),
    ("7.9 t2", "name = 'Note'", "note_id IS NULL OR same_id = 1"),
    ("7.18.4 t2", "name = 'Form' AND role IS NULL", "widgets = 1 AND other_kids = 0"),
)

#: Of one element, with the language that it has or inherits (``spoken``).
LANGUAGES = (
    ("7.2 t21", "actual_text IS NOT NULL", "spoken <> ''"),
    ("7.2 t22", "alt IS NOT NULL", "spoken <> ''"),
    ("7.2 t23", "expansion IS NOT NULL", "spoken <> ''"),
    ("7.2 t29", "lang <> ''", "lang RLIKE '^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$'"),
)

#: Of one piece of page content: whether it is drawn, tagged, an artifact, and inside which.
CONTENT = (
    ("7.1 t1", "artifact", "NOT in_tagged"),
    ("7.1 t2", "tagged", "NOT in_artifact"),
    ("7.1 t3", "drawn", "tagged OR artifact OR in_tagged OR in_artifact"),
    ("7.2 t30", "actual_text IS NOT NULL", "spoken <> ''"),
    ("7.2 t31", "alt IS NOT NULL", "spoken <> ''"),
    ("7.2 t32", "expansion IS NOT NULL", "spoken <> ''"),
)

#: Of one annotation: exempt (hidden or off the page), its enclosing element's type and alternate text.
ANNOTATIONS = (
    ("7.18.1 t1", "NOT exempt AND subtype NOT IN ('Widget', 'PrinterMark', 'Link')", "inside = 'Annot'"),
    ("7.18.1 t2", "NOT exempt AND subtype <> 'Widget'", "contents <> '' OR inside_alt <> ''"),
    ("7.18.1 t3", "NOT exempt AND subtype = 'Widget'", "tooltip <> '' OR inside_alt <> ''"),
    ("7.18.2 t1", "true", "subtype <> 'TrapNet'"),
    ("7.18.3 t1", "true", "tab_order = 'S'"),
    ("7.18.4 t1", "NOT exempt AND subtype = 'Widget'", "inside = 'Form'"),
    ("7.18.5 t1", "NOT exempt AND subtype = 'Link'", "inside = 'Link'"),
    ("7.18.5 t2", "NOT exempt AND subtype = 'Link'", "contents <> ''"),
    ("7.18.6.2 t1", "media_clip", "clip_type <> ''"),
    ("7.18.6.2 t2", "media_clip", "clip_alternates"),
    ("7.18.8 t1", "subtype = 'PrinterMark'", "inside IS NULL"),
    ("7.2 t24", "contents IS NOT NULL", "spoken <> ''"),
    ("7.2 t25", "tooltip IS NOT NULL", "spoken <> ''"),
)

#: Of one font as it is drawn; what a font program says comes in as columns.
FONTS = (
    ("7.21.3.1 t1", "cid AND NOT identity_map", "collection = map_collection"),
    ("7.21.3.2 t1", "cid AND embedded AND cid_kind = 2", "cid_to_glyph"),
    ("7.21.3.3 t1", "cid", "map_predefined OR map_embedded"),
    ("7.21.3.3 t2", "map_embedded", "map_mode = dictionary_mode"),
    ("7.21.3.3 t3", "map_embedded AND map_uses IS NOT NULL", "map_uses_predefined"),
    ("7.21.4.1 t1", "drawn", "embedded"),
    ("7.21.4.1 t2", "drawn AND embedded", "missing_glyphs = 0"),
    ("7.21.4.2 t1", "char_set IS NOT NULL", "unlisted_glyphs = 0"),
    ("7.21.4.2 t2", "cid_set", "unlisted_cids = 0"),
    ("7.21.5 t1", "drawn AND embedded", "width_error <= 1"),
    ("7.21.6 t1", "truetype AND NOT symbolic", "usable_cmaps > 0"),
    ("7.21.6 t2", "truetype AND NOT symbolic", "encoding IN ('MacRomanEncoding', 'WinAnsiEncoding')"),
    ("7.21.6 t3", "truetype AND symbolic", "encoding IS NULL"),
    ("7.21.6 t4", "truetype AND symbolic", "cmaps = 1 OR cmap_3_0"),
    ("7.21.7 t1", "drawn", "unmapped_codes = 0"),
    ("7.21.7 t2", "drawn", "bad_unicodes = 0"),
    ("7.21.8 t1", "drawn", "NOT notdef_drawn"),
)

PASS_THROUGH = ("NonStruct", "Div", "Part")


#: Clauses whose bits share a number.
BITS = 62


def judged(subjects: DataFrame, clauses, documents: DataFrame) -> DataFrame:
    """doc_id, clause, verdict of every document and clause; ``documents`` has doc_id. A
    document's subjects come down to two bits a clause, asked and not met, before anything is
    dealt; clauses are told apart behind that. ``documents`` may be the subjects themselves."""
    groups = [clauses[k : k + BITS] for k in range(0, len(clauses), BITS)]
    met = lambda who, ok: f"if({who}, if(coalesce({ok}, false), 1L, 2L), 0L)"
    bits = lambda g, bit: " | ".join(f"if({met(who, ok)} {bit}, {1 << k}L, 0L)" for k, (_, who, ok) in enumerate(g))
    masks = [F.expr(bits(g, bit)).alias(f"_{name}{n}") for n, g in enumerate(groups) for name, bit in (("asked", "> 0L"), ("failed", "= 2L"))]
    names = [f"_{name}{n}" for n in range(len(groups)) for name in ("asked", "failed")]
    # An id that is null is no subject's, so its clauses are not applicable.
    known = lambda m: F.when(F.col("doc_id").isNotNull(), m).otherwise(F.lit(0).cast("long"))
    tested = subjects.select("doc_id", *masks).select("doc_id", *(known(F.col(c)).alias(c) for c in names))
    if documents is not subjects:
        every = documents.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names), F.lit(True).alias("_own"))
        tested = tested.withColumn("_own", F.lit(False)).unionByName(every)
        own = [F.bool_or("_own").alias("_own")]
    else:
        own = []
    found = tested.groupBy("doc_id").agg(*(F.bit_or(c).alias(c) for c in names), *own)
    if own:
        found = found.where("_own")
    rows = []
    for n, g in enumerate(groups):
        for k, (clause, *_) in enumerate(g):
            asked, failed = (F.col(f"_{name}{n}").bitwiseAND(F.lit(1 << k)) != 0 for name in ("asked", "failed"))
            rows.append(F.struct(F.lit(clause).alias("clause"), F.when(~asked, "not applicable").when(failed, "fail").otherwise("pass").alias("verdict")))
    return found.select("doc_id", F.inline(F.array(*rows)))


def kid_lists(elements: DataFrame) -> DataFrame:
    """Elements (doc_id, id, parent, name; pass-through ones removed) with kids: the types
    of theirs, in order of id."""
    kids = elements.groupBy("doc_id", F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("k"))
    kids = kids.select("doc_id", "id", F.transform("k", lambda k: k["name"]).alias("kids"))
    return elements.join(kids, ["doc_id", "id"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<string>")))


def containment(elements: DataFrame) -> DataFrame:
    """The containment clauses. ``elements`` as for ``kid_lists``; the name is the standard
    type, null where there is none."""
    own = kid_lists(elements).join(elements.select("doc_id", F.col("id").alias("parent"), F.col("name").alias("above")), ["doc_id", "parent"], "left")
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    up = [(c, f"name = '{s}'", f"above IN ({quoted(may)})") for c, s, may in PARENTS]
    down = [(c, f"name = '{s}'", f"size(array_except(array_compact(kids), array({quoted(may)}))) = 0") for c, s, may in KIDS]
    return judged(own, [*up, *down], own)


def sequences(elements: DataFrame) -> DataFrame:
    own = kid_lists(elements).withColumn("kids", F.array_compact("kids"))
    return judged(own, SEQUENCES, own)


def described(elements: DataFrame) -> DataFrame:
    """Replacement texts, note ids and form kids (elements with those columns)."""
    same = F.count("note_id").over(Window.partitionBy("doc_id", "name", "note_id"))
    own = elements.withColumn("same_id", same)
    return judged(own, ELEMENTS, own)


def heading_styles(elements: DataFrame) -> DataFrame:
    """7.4.4 t2 and t3: a document has H or numbered headings, not both; a kind that is
    absent is not applicable for its clause."""
    h, hn = F.count_if(F.col("name") == "H"), F.count_if(F.col("name").rlike("^H[1-6]$"))
    counts = elements.groupBy("doc_id").agg(h.alias("h"), hn.alias("hn"))
    return judged(counts, (("7.4.4 t2", "h > 0", "hn = 0"), ("7.4.4 t3", "hn > 0", "h = 0")), counts)


def spoken(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements (doc_id, id, parent, lang, any other columns) with the language of the
    nearest element up the tree that has one, else of the document (doc_id, lang)."""
    def fold(rows):
        known = {i: (p, lang) for i, p, lang in rows}
        for i in known:
            at, seen = i, set()
            while at in known and not known[at][1] and at not in seen:
                seen.add(at)
                at = known[at][0]
            yield i, (known[at][1] or None) if at in known else None

    found = by_document(elements, ["id", "parent", "lang"], fold, "id int, nearest string")
    both = elements.join(found, ["doc_id", "id"]).join(documents.select("doc_id", F.col("lang").alias("_doc_lang")), "doc_id", "left")
    return both.withColumn("spoken", F.coalesce(F.nullif("nearest", F.lit("")), "_doc_lang", F.lit(""))).drop("nearest", "_doc_lang")


def languages(elements: DataFrame, documents: DataFrame) -> DataFrame:
    return judged(spoken(elements, documents), LANGUAGES, elements)


def outline_languages(entries: DataFrame) -> DataFrame:
    """7.2 t2: an outline entry (doc_id, lang of the document) resolves to a language."""
    return judged(entries, (("7.2 t2", "true", "lang <> ''"),), entries)


def role_maps(elements: DataFrame, mapped: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """7.1 t5, t6, t7 over elements (doc_id, name as written) and role maps (doc_id, name,
    to): a type that is not standard leads to a standard one, no type leads back to
    itself, no standard one leads elsewhere. A map is bounded by its document."""
    both = elements.select("doc_id", "name", F.lit(None).cast("string").alias("to")).distinct().unionByName(mapped.select("doc_id", "name", "to"))

    def fold(rows):
        to = {n: t for n, t in rows if t is not None}
        for name in {n for n, t in rows if t is None}:
            at, seen = name, []
            while at not in standard and at in to and at not in seen:
                seen.append(at)
                at = to[at]
            own = name in standard
            yield name, own, at in standard, at in seen, own and to.get(name, name) != name

    facts = by_document(both, ["name", "to"], fold, "name string, standard boolean, reaches boolean, circular boolean, remapped boolean")
    return judged(facts, (("7.1 t5", "NOT standard", "reaches OR circular"), ("7.1 t6", "NOT standard", "NOT circular"), ("7.1 t7", "standard", "NOT remapped")), elements)


#: Slots that a table may have.
MOST_SLOTS = 4_194_304


def table_layout(cells: list[tuple]) -> tuple[str | None, str | None, int]:
    """(irregularity, header fault, slots) of a table's cells (row, pos, header, columns,
    rows, scope, id, headers) in order.

    Width is the first row's; height the sum of the first cells' row spans, the rows that
    they cover skipped. Cells go to the next free slot. The first irregularity ends the
    layout: "wide", "tall", "taken", or "short" for an empty row or slot. A regular table
    whose header cells do not all have a scope is asked about headers: its first data cell
    but the one in the corner that names no valid header and that no scoped header reaches
    is a fault, "unknown" if it names ids, else "unnamed".
    """
    rows: dict[int, list[tuple]] = {}
    for c in cells:
        rows.setdefault(c[0], []).append(c)
    lines = [[c for c in rows[k] if c[1] >= 0] for k in sorted(rows)]
    width = sum(c[3] for c in lines[0]) if lines else 0
    height, k = 0, 0
    while k < len(lines):
        if not lines[k]:
            k += 1
            continue
        height += lines[k][0][4]
        k += lines[k][0][4]
    if width * height > MOST_SLOTS:
        return "unchecked", None, 0
    taken: dict[tuple[int, int], tuple] = {}
    for y, row in enumerate(lines):
        if not row:
            return "short", None, 0
        x = 0
        for c in row:
            while (y, x) in taken:
                x += 1
            if x + c[3] > width:
                return "wide", None, 0
            if y + c[4] > height:
                return "tall", None, 0
            own = [(y + dy, x + dx) for dy in range(c[4]) for dx in range(c[3])]
            if any(slot in taken for slot in own):
                return "taken", None, 0
            taken.update(dict.fromkeys(own, c))
            x += c[3]
    if len(taken) < width * height:
        return "short", None, 0
    heads = [c for c in cells if c[2] and c[1] >= 0]
    if all(c[5] for c in heads):
        return None, None, len(taken)
    ids = {c[6] for c in heads if c[6]}
    across = {y for (y, _), c in taken.items() if c[2] and c[5] in ("Row", "Both")}
    down = {x for (_, x), c in taken.items() if c[2] and c[5] in ("Column", "Both")}
    for y, x in sorted(taken):
        c = taken[y, x]
        if c[2] or (y, x) == (0, 0) or y in across or x in down:
            continue
        named = c[7].split() if c[7] else []
        if not named:
            return None, "unnamed", len(taken)
        if not ids.issuperset(named):
            return None, "unknown", len(taken)
    return None, None, len(taken)


def tables(cells: DataFrame) -> DataFrame:
    """7.2 t15, t41, t42, t43 and 7.5 t1, t2 over cells (doc_id, table, row, pos, header,
    columns, rows, scope, id, headers); a row without cells is one with pos -1."""
    def fold(rows):
        by: dict[int, list[tuple]] = {}
        for table, *cell in rows:
            by.setdefault(table, []).append(tuple(cell))
        for table, own in by.items():
            fault, headers, slots = table_layout(own)
            yield table, fault, headers, slots

    found = by_document(cells, ["table", "row", "pos", "header", "columns", "rows", "scope", "id", "headers"], fold, "table int, fault string, header_fault string, slots int")
    found = found.where("coalesce(fault, '') <> 'unchecked'")
    clauses = (
        ("7.2 t15", "true", "coalesce(fault, '') <> 'taken'"), ("7.2 t41", "true", "coalesce(fault, '') <> 'tall'"), ("7.2 t42", "true", "coalesce(fault, '') <> 'wide'"), ("7.2 t43", "true", "coalesce(fault, '') <> 'short'"),
        ("7.5 t1", "fault IS NULL", "coalesce(header_fault, '') <> 'unnamed'"), ("7.5 t2", "fault IS NULL", "coalesce(header_fault, '') <> 'unknown'"),
    )
    return judged(found, clauses, cells)


def all_verdicts(parts: list[DataFrame]) -> DataFrame:
    """Verdicts of several kinds as one report, ordered by the clause's numbers: a prefix
    of another number comes first."""
    key = F.transform(F.regexp_extract_all("clause", F.lit("([0-9]+)")), lambda n: n.cast("int"))
    return union(parts).withColumn("clause_no", key)
