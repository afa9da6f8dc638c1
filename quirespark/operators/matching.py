"""Joins of documents' parts: word multisets, boxes against boxes, cells, search with
wrapped lines, and form filling.

Box joins are range joins within a page: the equi key is the page, which is bounded,
so each is a shuffle join on (doc_id, page) with a range filter, never a product of
tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import SPACE, truthy, words
from quirespark.operators.rules import by_document


#: A word between Unicode white space, as ``words`` finds it.
WORD = re.compile("[^" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE) + "]+")


def same_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, same, missing, extra: multiset equality of the words of both sides. Texts are
    dealt whole, once, and words counted where a document's texts have met: a row for each
    word would be several times as large. Without a word on either side there is no row."""
    side = lambda df, k: df.where("text IS NOT NULL").select("doc_id", F.lit(k).alias("side"), "text")

    def fold(rows):
        counts = Counter(), Counter()
        for k, text in rows:
            counts[k].update(WORD.findall(text))
        a, b = counts
        if a or b:
            yield a == b, (a - b).total(), (b - a).total()

    return by_document(side(left, 0).unionByName(side(right, 1)), ["side", "text"], fold, "same boolean, missing long, extra long")


def styles_by_text(tree: DataFrame, proposal: DataFrame) -> DataFrame:
    """Each paragraph of the tree takes the style of the proposal's paragraph of the same
    words; each is used once, in order."""
    def numbered(df):
        key = F.array_join(words(F.col("text")), " ")
        w = Window.partitionBy("doc_id", "_key").orderBy("pos")
        return df.withColumn("_key", key).withColumn("_k", F.row_number().over(w))
    styles = numbered(proposal).select("doc_id", "_key", "_k", "style")
    return numbered(tree).join(styles, ["doc_id", "_key", "_k"], "left").drop("_key", "_k")


def holds(outer: str, inner: str) -> Column:
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(outer, "x0") <= c(inner, "x0")) & (c(outer, "y0") <= c(inner, "y0")) & (c(outer, "x1") >= c(inner, "x1")) & (c(outer, "y1") >= c(inner, "y1"))


def visible_runs(runs: DataFrame, shapes: DataFrame, page_box: tuple[float, float, float, float]) -> DataFrame:
    """Runs with a verdict, the first that holds: hidden (its layer is off), off_page,
    covered (a later opaque shape holds its box), visible."""
    x0, y0, x1, y1 = page_box
    opaque = shapes.where("opaque").select("doc_id", "page", "seq", "x0", "y0", "x1", "y1").alias("s")
    r = runs.alias("r")
    on = (F.col("r.doc_id") == F.col("s.doc_id")) & (F.col("r.page") == F.col("s.page")) & (F.col("s.seq") > F.col("r.seq")) & holds("s", "r")
    covered = r.join(opaque, on, "left_semi").select("doc_id", "page", "seq", F.lit(True).alias("_covered"))
    out = (F.col("x1") <= x0) | (F.col("x0") >= x1) | (F.col("y1") <= y0) | (F.col("y0") >= y1)
    verdict = F.when(F.col("hidden"), "hidden").when(out, "off_page").when(F.col("_covered"), "covered").otherwise("visible")
    return runs.join(covered, ["doc_id", "page", "seq"], "left").withColumn("verdict", verdict).drop("_covered")


def painted_over(shapes: DataFrame, slack: float = 0.5) -> DataFrame:
    """White grounds that no later coloured fill covers within the slack."""
    white, colour = shapes.where("white").alias("w"), shapes.where("NOT white").alias("c")
    c = lambda a, b, n, sign: F.col(f"c.{n}") * sign <= F.col(f"w.{n}") * sign + slack
    on = (F.col("w.doc_id") == F.col("c.doc_id")) & (F.col("w.page") == F.col("c.page")) & (F.col("c.seq") > F.col("w.seq"))
    on = on & c("c", "w", "x0", 1) & c("c", "w", "y0", 1) & c("c", "w", "x1", -1) & c("c", "w", "y1", -1)
    return white.join(colour, on, "left_anti")


def cell_of(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (x, y) with row and col of their half-open cell: a point on a boundary
    belongs to the cell after it."""
    p, c = points.alias("p"), cells.alias("c")
    on = (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.x") >= F.col("c.x0")) & (F.col("p.x") < F.col("c.x1")) & (F.col("p.y") >= F.col("c.y0")) & (F.col("p.y") < F.col("c.y1"))
    return p.join(c, on).select("p.*", "c.row", "c.col")


def placed_matches(estimated: DataFrame, exact: DataFrame) -> DataFrame:
    """All exact boxes, and the estimates whose centre no exact box contains."""
    e, x = estimated.alias("e"), exact.alias("x")
    cx, cy = (F.col("e.x0") + F.col("e.x1")) / 2, (F.col("e.y0") + F.col("e.y1")) / 2
    on = (F.col("e.doc_id") == F.col("x.doc_id")) & (F.col("e.page") == F.col("x.page")) & cx.between(F.col("x.x0"), F.col("x.x1")) & cy.between(F.col("x.y0"), F.col("x.y1"))
    left = e.join(x, on, "left_anti")
    return exact.withColumn("exact", F.lit(True)).unionByName(left.withColumn("exact", F.lit(False)))


def merged_proposals(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of the first, and those of the second that overlap none of them."""
    a, b = first.alias("a"), second.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page"))
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        on = on & (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}"))
    return first.unionByName(b.join(a, on, "left_anti"))


def link_at(points: DataFrame, links: DataFrame) -> DataFrame:
    """The first link, in annotation order, whose box holds the point, edges included."""
    p, k = points.alias("p"), links.alias("k")
    on = (F.col("p.doc_id") == F.col("k.doc_id")) & F.col("p.x").between(F.col("k.x0"), F.col("k.x1")) & F.col("p.y").between(F.col("k.y0"), F.col("k.y1"))
    both = p.join(k, on, "left").groupBy("p.doc_id", "p.point").agg(F.min(F.struct("k.pos", "k.uri")).alias("hit"))
    return both.select("doc_id", "point", "hit.uri")


def row_matches(rows: DataFrame, pattern: str) -> DataFrame:
    """Every match of a pattern in the rows (doc_id, line_no, line): k, matched, start."""
    found = F.regexp_extract_all("line", F.lit(f"({pattern})"), 1)
    hits = rows.select("doc_id", "line_no", "line", F.posexplode(found).alias("k", "matched"))
    before = F.concat_ws("", F.slice(F.split("line", pattern), F.lit(1), F.col("k") + 1))
    skipped = F.aggregate(F.slice(found, F.lit(1), F.col("k")), F.lit(0), lambda acc, m: acc + F.length(m))
    return hits.select("doc_id", "line_no", "k", "matched", (F.length(before) + skipped).alias("start"))


def wrapped_matches(pieces: DataFrame, pattern: str, chains: int = 200_000) -> DataFrame:
    """Matches that run over a line's end: doc_id, page, row, lines, reading, matched.

    A chain is a piece and a piece of the next row that starts left of its end, up to
    three rows; it is read joined with a blank, joined, and de-hyphenated. Past the
    budget of chains a page falls back to two rows and then one, and says so (skipped)."""
    # Pieces are dealt by page once: rows, budgets, chains and what is found keep to their page.
    p = pieces.where("doc_id IS NOT NULL AND page IS NOT NULL AND row IS NOT NULL").repartition("doc_id", "page")
    rows = p.groupBy("doc_id", "page", "row").agg(F.collect_list(F.struct("text", "x0", "x1")).alias("own"))
    down, whole = Window.partitionBy("doc_id", "page").orderBy("row"), Window.partitionBy("doc_id", "page")
    after = lambda k: F.when(F.lead("row", k).over(down) == F.col("row") + k, F.lead("own", k).over(down))
    rows = rows.select("*", after(1).alias("two"), after(2).alias("three")).where("two IS NOT NULL")
    left_of = lambda a: lambda b: b["x0"] < a["x1"]
    third = F.transform("two", lambda b: F.struct(b["x0"].alias("x0"), F.size(F.filter(F.coalesce("three", F.slice("two", 1, 0)), left_of(b))).cast("long").alias("n")))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, n: s + n)
    of_row = lambda value: total(F.transform("own", lambda a: total(F.transform(F.filter("_third", left_of(a)), value))))
    rows = rows.withColumn("_third", third)
    rows = rows.withColumn("_c2", F.sum(of_row(lambda b: F.lit(1).cast("long"))).over(whole)).withColumn("_c3", F.sum(of_row(lambda b: b["n"])).over(whole))
    rows = rows.withColumn("depth", F.when(F.col("_c2") + F.col("_c3") <= chains, 3).when(F.col("_c2") <= chains, 2).otherwise(1)).where("depth > 1")
    a, b = F.col("a"), F.col("b")
    pairs = rows.select("doc_id", "page", "row", "depth", "two", "three", F.explode("own").alias("a")).select("*", F.explode(F.filter("two", left_of(a))).alias("b"))
    ends = F.when(F.col("depth") > 2, F.filter("three", left_of(b)))
    parts = F.concat(F.array(F.array(a["text"], b["text"])), F.coalesce(F.transform(ends, lambda c: F.array(a["text"], b["text"], c["text"])), F.array().cast("array<array<string>>")))
    chained = pairs.select("doc_id", "page", "row", "depth", F.explode(parts).alias("parts"))
    # Without a hyphen at an end, joined and de-hyphenated are one text: it is searched once.
    hyphens = "\\x{2D}\\x{2010}\\x{AD}"
    parted = F.exists(F.slice("parts", 1, F.size("parts") - 1), lambda t: t.rlike(f"[{hyphens}]\\z")) | F.exists("parts", lambda t: F.contains(t, F.lit("\x01")))
    hyphen = F.regexp_replace(F.array_join("parts", "\x01"), f"[{hyphens}]\\x{{1}}|\\x{{1}}", "")
    named = lambda s, *names: F.struct(F.array(*map(F.lit, names)).alias("names"), s.alias("s"))
    space, joined = named(F.array_join("parts", " "), "space"), F.array_join("parts", "")
    readings = F.when(F.coalesce("parted", F.lit(True)), F.array(space, named(joined, "joined"), named(hyphen, "hyphen"))).otherwise(F.array(space, named(joined, "joined", "hyphen")))
    read = chained.withColumn("parted", parted).select("doc_id", "page", "row", "parts", (F.col("depth") < 3).alias("skipped"), F.explode(readings).alias("r"))
    hits = read.select("doc_id", "page", "row", "parts", "skipped", F.col("r.names").alias("names"), F.explode(F.array_distinct(F.regexp_extract_all("r.s", F.lit(pattern), F.lit(0)))).alias("matched"))
    # What one row holds alone was found there.
    hits = hits.where(~F.exists("parts", lambda t: F.contains(t, F.col("matched"))))
    return hits.select("doc_id", "page", "row", F.size("parts").alias("lines"), F.explode("names").alias("reading"), "matched", "skipped").distinct()


def slash_templates(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, row, pos, token, marker) that become choices: an X/Y token on a
    marker's row, else on the next, else on the one before, is a template, and every
    equal token of the document is a choice."""
    slash = tokens.where(F.col("token").rlike("^[^/]+(/[^/]+)+$"))
    first = slash.groupBy("doc_id", "row").agg(F.min_by("token", "pos").alias("token"))
    marks = tokens.where("marker").select("doc_id", "row").distinct()
    near = [first.select("doc_id", (F.col("row") - k).alias("row"), F.col("token").alias(f"t{i}")) for i, k in enumerate((0, 1, -1))]
    found = marks
    for n in near:
        found = found.join(n, ["doc_id", "row"], "left")
    templates = found.select("doc_id", F.coalesce("t0", "t1", "t2").alias("token")).where("token IS NOT NULL").distinct()
    return tokens.join(templates, ["doc_id", "token"], "left_semi")


#: Fields that a form may have.
MOST_FIELDS = 10_000


def filled_fields(template: DataFrame, values: DataFrame) -> DataFrame:
    """Mail merge: fields (form, name, id, kind) x rows of values (row, name, value). A
    value is found by a field's name, else by its id. Check boxes read truth, list boxes
    take all values, the rest the first."""
    named = values.groupBy("row", "name").agg(F.sort_array(F.collect_list("value")).alias("vals"))
    rows = values.select("row").distinct()
    if template.limit(MOST_FIELDS + 1).count() > MOST_FIELDS:
        raise ValueError(f"a form has at most {MOST_FIELDS} fields")
    both = rows.crossJoin(F.broadcast(template))  # one form's fields, counted above: a query set
    by_name = both.join(named, ["row", "name"], "left").withColumnRenamed("vals", "by_name")
    by_id = by_name.join(named.select("row", F.col("name").alias("id"), F.col("vals").alias("by_id")), ["row", "id"], "left")
    vals = F.coalesce("by_name", "by_id")
    one = F.when(F.col("kind") == "checkbox", F.when(truthy(vals[0]), "On").otherwise("Off")).when(F.col("kind") == "listbox", F.array_join(vals, ",")).otherwise(vals[0])
    return by_id.select("row", "name", "kind", F.when(vals.isNotNull(), one).alias("value"))


def explorer_quorum(answers: DataFrame, least: int = 2) -> DataFrame:
    """Items on whose answer at least so many distinct sources agree."""
    agreed = answers.groupBy("item", "answer").agg(F.countDistinct("source").alias("votes")).where(F.col("votes") >= least)
    return agreed.groupBy("item").agg(F.max(F.struct("votes", "answer")).alias("b")).select("item", "b.answer", "b.votes")


def figures_by_overlap(tree: DataFrame, pictures: DataFrame) -> DataFrame:
    """Tree figures, in order, each with the unused page picture of largest overlap; one
    without a box takes the first unused; else none. Greedy, so per page in Arrow."""

    def fold(figs: list[dict], pics: list[dict]) -> list[tuple]:
        free, out = {p["pic"]: p for p in pics}, []
        for f in sorted(figs, key=lambda f: f["pos"]):
            if f["x0"] is None:
                best = next(iter(free), None)
            else:
                area = {k: max(0.0, min(f["x1"], p["x1"]) - max(f["x0"], p["x0"])) * max(0.0, min(f["y1"], p["y1"]) - max(f["y0"], p["y0"])) for k, p in free.items()}
                best = max((k for k in area if area[k] > 0), key=lambda k: area[k], default=None)
            free.pop(best, None)
            out.append((f["doc_id"], f["page"], f["pos"], best))
        return out

    box = ["x0", "y0", "x1", "y1"]
    figs = tree.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "page", *box))).alias("figs"))
    pics = pictures.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pic", *box))).alias("pics"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f, p in zip(batch.column("figs").to_pylist(), batch.column("pics").to_pylist()) for r in fold(f, p or [])]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "page", "pos", "pic"])

    return figs.join(pics, ["doc_id", "page"], "left").select("figs", "pics").mapInArrow(run, "doc_id long, page int, pos int, pic int")
