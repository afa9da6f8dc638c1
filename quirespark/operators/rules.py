"""Rule sets over documents: active-content findings and accessibility clauses.

A rule is a projection of subject rows to (doc_id, rule, verdict or severity); rules
are united, so one scan of each subject table serves many. A rule without a subject
is not applicable, never passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.arrow import pieces, plain

#: Action types and how much they risk; any other type is no finding.
RISKS = {
    "JavaScript": "high", "Launch": "high", "SubmitForm": "high", "ImportData": "high", "GoToR": "high", "GoToE": "high", "URI": "medium",
    "Rendition": "high", "Movie": "medium", "Sound": "medium", "SetOCGState": "medium", "GoTo3DView": "medium", "Hide": "medium", "RichMediaExecute": "medium",
}

#: Annotations that carry or play media: kind of finding, and risk.
MEDIA = {
    "FileAttachment": ("attachment", "medium"), "Sound": ("media", "medium"), "Movie": ("media", "medium"), "Screen": ("media", "medium"), "RichMedia": ("media", "high"), "3D": ("media", "high"),
}
DEPTH = 32


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_document(df: DataFrame, columns: list[str], fold, schema: str) -> DataFrame:
    """One document's rows at a time, as a list of tuples, through a Python fold that
    yields tuples. A document's objects are bounded by the reader's caps."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(part.split() for part in schema.split(", ")))
    grouped = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            out = [(doc, *row) for doc, rows in zip(plain(batch.column("doc_id")), plain(batch.column("rows"))) for row in fold(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(list(zip(*out)) or [()] * (len(names) + 1), ("long", *types))], ["doc_id", *names])

    return grouped.mapInArrow(run, "doc_id long, " + schema)


def action_chains(actions: DataFrame, holders: DataFrame) -> DataFrame:
    """Actions (doc_id, action, type, next array) reached from holders (doc_id, holder,
    action), breadth first, each once per holder, to a depth of 32; a chain that goes on
    beyond is marked exhausted, not cut silently."""
    own = actions.select("doc_id", "action", "type", "next", F.lit(None).cast("string").alias("holder"))
    starts = holders.select("doc_id", "action", F.lit(None).cast("string").alias("type"), F.lit(None).cast("array<int>").alias("next"), "holder")

    def fold(rows):
        known = {a: (t, n or []) for a, t, n, h in rows if h is None}
        for start, _, _, holder in (r for r in rows if r[3] is not None):
            seen, level, depth = {start}, [start], 0
            while level and depth <= DEPTH:
                for a in level:
                    if a in known:
                        yield holder, a, known[a][0], depth, depth >= DEPTH
                level = [x for a in level if a in known for x in known[a][1] if x not in seen and not seen.add(x)]
                depth += 1

    return by_document(own.unionByName(starts), ["action", "type", "next", "holder"], fold, "holder string, action int, type string, depth int, exhausted boolean")


def action_findings(chain: DataFrame) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in RISKS.items() for x in pair))
    return chain.select("doc_id", F.concat(F.lit("action:"), "type").alias("rule"), F.element_at(known, F.col("type")).alias("severity"), "holder").where("severity IS NOT NULL")


def exhausted_walks(chain: DataFrame) -> DataFrame:
    """Documents whose chains go on beyond the depth: an error, never a clean result."""
    return chain.where("exhausted").select("doc_id").distinct()


#: Rules over the catalogue's row of flags and counts, as (kind, severity,
#: what is found, detail); severity and detail are SQL.
CATALOG_RULES = (
    ("openAction", "'high'", "open_action = 'action'", "'runs an action when it opens'"),
    ("additionalActions", "'medium'", "aa", "'document'"),
    ("javascript", "'high'", "javascript", "'document'"),
    ("attachment", "'medium'", "embedded_files", "'embedded files'"),
    ("attachment", "'medium'", "associated_files", "'associated files'"),
    ("media", "'medium'", "renditions", "'renditions'"),
    ("slideshow", "'medium'", "alternate_presentations", "'alternate presentations'"),
    ("xfa", "'medium'", "xfa", "'form'"),
    ("offPageFields", "if(off_page_filled > 0, 'medium', 'low')", "off_page > 0", "concat(off_page, ' off the pages, ', off_page_filled, ' filled')"),
    ("additionalActions", "'medium'", "calculated > 0", "'calculation order'"),
    ("hiddenLayer", "if(layers_off > 0, 'medium', 'low')", "layers", "concat(layers_off, ' hidden')"),
    ("webCapture", "'low'", "web_capture", "'record'"),
    ("metadata", "'low'", "xmp", "'catalogue'"),
    ("metadata", "'low'", "xmp_holders - int(xmp) > 0", "concat(xmp_holders - int(xmp), ' others')"),
)

#: Entries of the information dictionary that identify, and how much is shown.
INFO, SHOWN = ("Author", "Creator", "Title", "Subject", "Keywords"), 80


def findings(catalog: DataFrame) -> DataFrame:
    """doc_id, kind, severity, detail: rules over one row a document of flags, counts and
    the map ``info``; one scan serves them all."""
    rules = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(s).alias("severity"), F.expr(when).alias("found"), F.expr(d).alias("detail")) for k, s, when, d in CATALOG_RULES))
    entry = lambda key: F.trim(F.element_at("info", key))
    shown = lambda v: F.when(F.char_length(v) > SHOWN, F.concat(F.substring(v, 1, SHOWN), F.lit("…"))).otherwise(v)
    info = F.array(*(F.struct(F.lit("info").alias("kind"), F.lit("low").alias("severity"), (entry(k) != "").alias("found"), F.concat(F.lit(f"{k}: "), shown(entry(k))).alias("detail")) for k in INFO))
    found = catalog.select("doc_id", F.explode(F.filter(F.concat(rules, info), lambda r: F.coalesce(r["found"], F.lit(False)))).alias("r"))
    return found.select("doc_id", "r.kind", "r.severity", "r.detail")


def page_findings(pages: DataFrame, annotations: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, page, kind, severity: additional actions and associated files of pages
    (doc_id, page, aa, af), media and additional actions of annotations (doc_id, page,
    subtype, aa), additional actions of form fields (doc_id, aa; page 0)."""
    kind = F.create_map(*(F.lit(x) for k, v in MEDIA.items() for x in (k, v[0])))
    risk = F.create_map(*(F.lit(x) for k, v in MEDIA.items() for x in (k, v[1])))
    own = lambda df, page, k, s: df.select("doc_id", page.cast("int").alias("page"), F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), F.lit(s).alias("severity") if isinstance(s, str) else s.alias("severity"))
    page = F.col("page")
    return union([
        own(pages.where("aa"), page, "additionalActions", "medium"), own(pages.where("af"), page, "attachment", "medium"), own(annotations.where("aa"), page, "additionalActions", "medium"),
        own(annotations.where(F.col("subtype").isin(*MEDIA)), page, F.element_at(kind, F.col("subtype")), F.element_at(risk, F.col("subtype"))), own(fields.where("aa"), F.lit(0), "additionalActions", "medium"),
    ])


def pass_through(elements: DataFrame, names: list[str]) -> DataFrame:
    """Elements (doc_id, id, parent, name) without pass-through ones: a child's parent is
    its nearest ancestor that is none."""
    gone = frozenset(names)

    def fold(rows):
        known = {i: (p, n) for i, p, n in rows}
        for i, parent, name in rows:
            if name not in gone:
                while parent in known and known[parent][1] in gone:
                    parent = known[parent][0]
                yield i, parent, name

    return by_document(elements, ["id", "parent", "name"], fold, "id int, parent int, name string")


#: Clause, element, and the parents that it may have.
CONTAINMENT = (
    ("7.2-tr", "tr", ("table", "thead", "tbody", "tfoot")), ("7.2-thead", "thead", ("table",)), ("7.2-tbody", "tbody", ("table",)), ("7.2-tfoot", "tfoot", ("table",)),
    ("7.2-th", "th", ("tr",)), ("7.2-td", "td", ("tr",)), ("7.2-li", "li", ("ul", "ol")), ("7.2-caption", "caption", ("table",)),
    ("7.2-dt", "dt", ("dl",)), ("7.2-dd", "dd", ("dl",)), ("7.2-figcaption", "figcaption", ("figure",)),
)


def containment(elements: DataFrame) -> DataFrame:
    """doc_id, clause, verdict: pass, fail or not applicable, per document and clause."""
    parents = elements.select("doc_id", F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    both = elements.join(parents, ["doc_id", "parent"], "left")
    clauses = F.array(*(F.struct(F.lit(c).alias("clause"), F.lit(e).alias("name"), F.array(*map(F.lit, p)).alias("may")) for c, e, p in CONTAINMENT))
    tested = both.select("doc_id", "name", "parent_name", F.explode(F.filter(clauses, lambda c: c["name"] == F.col("name"))).alias("c"))
    ok = F.coalesce(F.array_contains("c.may", F.col("parent_name")), F.lit(False))
    counted = tested.groupBy("doc_id", F.col("c.clause").alias("clause")).agg(F.bool_and(ok).alias("ok"))
    every = elements.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(c) for c, _, _ in CONTAINMENT))).alias("clause"))
    return every.join(counted, ["doc_id", "clause"], "left").select("doc_id", "clause", F.when(F.col("ok").isNull(), "not applicable").when(F.col("ok"), "pass").otherwise("fail").alias("verdict"))


#: Clause, parent, child, most of them, and whether it must come first.
CARDINALITY = (("7.2-one-thead", "table", "thead", 1, False), ("7.2-one-tfoot", "table", "tfoot", 1, False), ("7.2-one-caption", "table", "caption", 1, False), ("7.2-one-figcaption", "figure", "figcaption", 1, False))


def cardinality(elements: DataFrame) -> DataFrame:
    """doc_id, clause, verdict: at most so many children of a name under each parent."""
    out = []
    for clause, parent, child, most, _ in CARDINALITY:
        p = elements.where(F.col("name") == parent).select("doc_id", F.col("id").alias("parent"))
        n = p.join(elements.where(F.col("name") == child).groupBy("doc_id", "parent").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "parent"], "left")
        out.append(n.groupBy("doc_id").agg(F.bool_and(F.coalesce("n", F.lit(0)) <= most).alias("ok")).select("doc_id", F.lit(clause).alias("clause"), F.when(F.col("ok"), "pass").otherwise("fail").alias("verdict")))
    return union(out)


def heading_nesting(elements: DataFrame) -> DataFrame:
    """Fails when the first numbered heading is not level 1 or one exceeds its
    predecessor by more than 1; without headings not applicable."""
    heads = elements.where(F.col("name").rlike("^h[1-6]$")).select("doc_id", "id", F.substring("name", 2, 1).cast("int").alias("level"))
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("id"))
    bad = F.when(before.isNull(), F.col("level") != 1).otherwise(F.col("level") > before + 1)
    judged = heads.withColumn("bad", bad).groupBy("doc_id").agg(F.bool_or("bad").alias("bad"), F.count(F.lit(1)).alias("headings"))
    docs = elements.select("doc_id").distinct()
    return docs.join(judged, "doc_id", "left").select("doc_id", F.coalesce("headings", F.lit(0)).alias("headings"), F.when(F.col("bad").isNull(), "not applicable").when(F.col("bad"), "fail").otherwise("pass").alias("verdict"))


def standing(results: DataFrame) -> DataFrame:
    """doc_id, conformant, standing, failed, unresolved: conformant only if a rule was
    asked and every verdict is pass or not applicable."""
    ok, fail = F.col("verdict").isin("pass", "not applicable"), F.col("verdict") == "fail"
    state = F.when(F.bool_or(fail), "fails").when(F.bool_or(~ok), "not established").otherwise("passes")
    return results.groupBy("doc_id").agg((F.bool_and(ok) & (F.count(F.lit(1)) > 0)).alias("conformant"), state.alias("standing"), F.count_if(fail).alias("failed"), F.count_if(~ok & ~fail).alias("unresolved"))


def table_grid(rows: list[list[tuple[int, int]]]) -> str | None:
    """The first irregularity of a table of (column span, row span) cells, or None: too
    wide, too tall, taken, or empty slots. Width is the first row's; height is the sum of
    the first cells' row spans, rows under them skipped."""
    rows_ = [r for r in rows]
    width = sum(c for c, _ in rows_[0]) if rows_ else 0
    height, k = 0, 0
    while k < len(rows_):
        if not rows_[k]:
            k += 1
            continue
        height += rows_[k][0][1]
        k += rows_[k][0][1]
    taken: set[tuple[int, int]] = set()
    for y, row in enumerate(rows_):
        x = 0
        if not row:
            return "empty row"
        for cols, spans in row:
            while (y, x) in taken:
                x += 1
            if x + cols > width:
                return "too wide"
            if y + spans > height:
                return "too tall"
            own = {(y + dy, x + dx) for dy in range(spans) for dx in range(cols)}
            if own & taken:
                return "taken"
            taken |= own
            x += cols
    return None if len(taken) == width * height else "empty slots"


def signature_state(signatures: DataFrame) -> DataFrame:
    """doc_id, state, added_after: unsigned, valid (every signer verifies) or invalid;
    time stamps are no signers; more than 64 signatures could not be checked. Added
    after: the last valid signer does not cover the end."""
    signer = ~F.col("timestamp")
    n, good = F.count_if(signer), F.count_if(signer & F.col("valid"))
    over = F.count(F.lit(1)) > 64
    state = F.when(over, "could not check").when(n == 0, F.when(F.bool_or("blob"), "invalid").otherwise("unsigned")).when(good == n, "valid").otherwise("invalid")
    covered = F.max(F.when(signer & F.col("valid"), F.col("coverage_end")))
    return signatures.groupBy("doc_id").agg(state.alias("state"), F.coalesce(covered < F.max("size"), F.lit(False)).alias("added_after"))


def trimmed_history(versions: DataFrame, depth: int = 30) -> DataFrame:
    """Versions (doc_id, version, bytes) within the depth, newest first, and the bytes
    kept in each document."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("version")))
    kept = versions.withColumn("_k", k).where(F.col("_k") <= depth).drop("_k")
    return kept.withColumn("kept_bytes", F.sum("bytes").over(Window.partitionBy("doc_id").orderBy(F.desc("version")).rowsBetween(Window.unboundedPreceding, 0)))


def evicted(kept: DataFrame, budget: int, span: int = 4096) -> DataFrame:
    """Whole histories in order of opening, while all that is kept exceeds the budget: a
    document goes when what it and those opened later hold is over it. Ids are dealt to
    spans; sums of spans, then of rows inside one, so no task orders all documents."""
    sizes = kept.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).withColumn("_span", F.floor(F.col("doc_id") / span))
    after = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.groupBy("_span").agg(F.sum("bytes").alias("_sum"))
    spans = spans.withColumn("_after", F.coalesce(F.sum("_sum").over(after), F.lit(0))).drop("_sum")
    own = F.sum("bytes").over(Window.partitionBy("_span").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0))
    both = sizes.withColumn("_own", own).join(spans, "_span")
    return both.select("doc_id", "bytes", (F.col("_own") + F.col("_after") > budget).alias("evicted"))


def content_digest(chunks: DataFrame, version: int = 8) -> DataFrame:
    """SHA-256 over version, number of chunks, and the chunks in order, each with its
    length: neither a moved boundary nor a moved chunk keeps the digest."""
    one = F.struct("pos", F.concat(F.lpad(F.hex(F.octet_length("data")), 16, "0"), F.col("data")).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]), "")
    head = F.concat(F.lit(f"v{version}:"), F.lpad(F.hex(F.count(F.lit(1))), 16, "0"))
    return chunks.groupBy("doc_id").agg(F.sha2(F.concat(head, joined), 256).alias("digest"))


#: The ladder of shrinking, share of the size that each rung leaves.
LADDER = (0.9, 0.75, 0.6, 0.45, 0.3, 0.15)


def shrunk_to(sizes: DataFrame, target) -> DataFrame:
    """The gentlest rung that meets the target, else the hardest, with met."""
    rungs = F.array(*(F.struct(F.lit(k).alias("rung"), F.floor(F.col("bytes") * s).cast("long").alias("size")) for k, s in enumerate(LADDER, 1)))
    fit = F.get(F.filter(rungs, lambda r: r["size"] <= target), F.lit(0))
    best = F.coalesce(fit, F.element_at(rungs, -1))
    return sizes.select("*", best["rung"].alias("rung"), best["size"].alias("shrunk"), fit.isNotNull().alias("met"))


def ocr_groups(words: DataFrame) -> DataFrame:
    """Words (doc_id, pos, block, para, line, text) as groups in first-appearance order;
    a word without block or paragraph is a group of its own; by line within a group."""
    alone = (F.col("block") == 0) | (F.col("para") == 0)
    key = F.when(alone, F.struct(F.lit(0).alias("b"), F.col("pos").alias("p"))).otherwise(F.struct(F.col("block").alias("b"), F.col("para").alias("p")))
    keyed = words.withColumn("_key", key).withColumn("_alone", alone)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", "text"))), lambda w: w["text"]), " ")
    groups = keyed.groupBy("doc_id", "_alone", "_key").agg(F.min("pos").alias("first_pos"), text.alias("text"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos"))
    return groups.select("doc_id", rank.alias("group_no"), "first_pos", "text")


def hyphen_evidence(lines: DataFrame) -> DataFrame:
    """Broken words at a line's end (doc_id, line_no, joined) that the document also has
    whole; the halves themselves are no evidence."""
    word = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    parts = lines.withColumn("_next", F.lead("line").over(w))
    ends = parts.where(F.col("line").rlike(r"\p{L}[\x{2D}\x{2010}\x{AD}]$")).select("doc_id", "line_no", F.concat(F.regexp_extract("line", r"([\p{L}]+)[\x{2D}\x{2010}\x{AD}]$", 1), F.regexp_extract("_next", r"^([\p{L}]+)", 1)).alias("joined"))
    whole = lines.select("doc_id", F.explode(F.split("line", r"[\x{9}\x{20}]+")).alias("t")).select("doc_id", word(F.col("t")).alias("word")).distinct()
    return ends.withColumn("word", F.lower("joined")).join(whole, ["doc_id", "word"], "left_semi").select("doc_id", "line_no", "joined")


def aligned_words(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by dynamic programming."""
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out
