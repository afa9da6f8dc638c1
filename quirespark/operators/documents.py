"""Tables of a document's parts: fields, active objects, pictures, attachments,
revisions, blocks, cells. Filters are anti and semi joins, orders are windows within a
document or page, and a cap refuses, it never cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.rounds import climbed, reached
from quirespark.operators.rules import MEDIA, RISKS


def field_list(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """Fields (doc_id, id, parent, name) with their full name, whether a widget (doc_id,
    field) draws them or a field under them on a page, and whether they can be filled: their chain of
    parents ends at a root (parent 0), neither broken nor in a circle. Of a broken chain the
    name is what there is of it; in a circle it is of no use."""
    own = fields.select("doc_id", "id", F.when(F.col("parent") != 0, F.col("parent")).alias("parent"), "name")
    named = climbed(own, "name").select("doc_id", "id", F.array_join(F.filter(F.transform("path", lambda p: p["own"]), lambda n: n != ""), ".").alias("full_name"), (F.col("status") == "root").alias("fillable"))
    drawn = widgets.select("doc_id", F.col("field").alias("id")).distinct().withColumn("on_page", F.lit(True))
    return named.join(drawn, ["doc_id", "id"], "left").withColumn("on_page", F.coalesce("on_page", F.lit(False)))


def unfillable_asked(listed: DataFrame, asked: DataFrame) -> DataFrame:
    """Names asked for (doc_id, full_name) whose field cannot be filled."""
    return listed.where("NOT fillable").select("doc_id", "full_name").join(asked, ["doc_id", "full_name"], "left_semi").distinct()


#: Kinds of objects that are active, that carry files or media, that describe.
ACTIVE = ("action", "additionalActions", "javascript", "openAction", "xfa", "slideshow", "attachment", "media")
METADATA = ("info", "xmp")


def stripped(objects: DataFrame, tier: str) -> DataFrame:
    """Objects (doc_id, id, kind, type) that stay: ``active`` drops what the scan reports
    as active, ``media`` files, media annotations and the actions that play them,
    ``metadata`` the information dictionary and every metadata stream. An action that is
    no risk stays, and so does an annotation that is no medium."""
    kind, type_ = F.col("kind"), F.coalesce("type", F.lit(""))
    risky, playing = type_.isin(*RISKS), type_.isin("Rendition", "Movie", "Sound", "GoTo3DView", "RichMediaExecute")
    medium = (kind == "annotation") & type_.isin(*MEDIA)
    drop = {
        "active": (kind == "action") & risky | kind.isin(*(k for k in ACTIVE if k != "action")) | medium,
        "media": (kind == "action") & playing | kind.isin("attachment", "media") | medium,
        "metadata": kind.isin(*METADATA),
    }[tier]
    return objects.where(~drop)


def counters(events: DataFrame) -> DataFrame:
    """doc_id, report: the number of events (doc_id, cause) by cause, as a map."""
    counts = events.groupBy("doc_id", "cause").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cause", "n")))).alias("report"))


def agreed(rules: DataFrame, disagreements: DataFrame, unexercised: DataFrame) -> DataFrame:
    """n: rules (clause) without those known to disagree and those that no file exercises."""
    return rules.join(disagreements, "clause", "left_anti").join(unexercised, "clause", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def block_order(paragraphs: DataFrame, inserts: DataFrame) -> DataFrame:
    """doc_id, page, kind, id, place: tables and figures (before: the number of paragraphs
    read before their corner) among the paragraphs (seq)."""
    p = paragraphs.select("doc_id", "page", F.lit("paragraph").alias("kind"), F.col("seq").alias("id"), F.col("seq").alias("at"), F.lit(1).alias("after"))
    i = inserts.select("doc_id", "page", "kind", "id", F.col("before").alias("at"), F.lit(0).alias("after"))
    w = Window.partitionBy("doc_id", "page").orderBy("at", "after", "kind", "id")
    return p.unionByName(i).select("doc_id", "page", "kind", "id", F.row_number().over(w).alias("place"))


def nearest(lists: DataFrame, markers: DataFrame) -> DataFrame:
    """Of each marker's (doc_id, marker, x0, x1) lists (doc_id, pos, x0, x1) the nearest, of equal distance the first."""
    m, k = markers.alias("m"), lists.alias("k")
    gap = F.greatest(F.lit(0.0), F.col("k.x0") - F.col("m.x1"), F.col("m.x0") - F.col("k.x1"))
    both = m.join(k, "doc_id").groupBy("doc_id", "m.marker").agg(F.min(F.struct(gap.alias("distance"), F.col("k.pos").alias("pos"))).alias("best"))
    return both.select("doc_id", "marker", "best.pos", "best.distance")


def capped(groups: DataFrame, size: str, most: int) -> DataFrame:
    """refusal: of a group whose size is past the cap, the whole group is refused."""
    return groups.withColumn("refusal", F.when(F.col(size) > most, F.concat(F.lit("more than "), F.lit(most).cast("string"))))


def kept_resources(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, id: what content names (roots), and what that names in turn (edges: from, to)."""
    return reached(edges, roots)


def row_pieces(words: DataFrame) -> DataFrame:
    """piece: a row's words are cut where a gap is wider than the size of the word before."""
    w = Window.partitionBy("doc_id", "row").orderBy("x0", "seq")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) > F.lag("size").over(w)).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def time_backing(signed_time: Column, token: Column, trusted: Column) -> Column:
    """Who stands behind a signing time."""
    return F.when(token & trusted, "tsa").when(token, "tsa-unverified").when(signed_time.isNotNull(), "self-asserted").otherwise("none")


def text_layers(runs: DataFrame) -> DataFrame:
    """Pages with text that is there but not shown: a recognised layer."""
    return runs.groupBy("doc_id", "page").agg(F.bool_or(~F.col("visible")).alias("has_layer"))


def span_grid(cells: DataFrame) -> DataFrame:
    """doc_id, row, col, covered: cells (row, col, rows, columns) over the slots that they span; all but the first are covered."""
    slots = cells.select("doc_id", "row", "col", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("dy"), "columns").select("*", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("dx"))
    return slots.select("doc_id", (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col"), ((F.col("dy") > 0) | (F.col("dx") > 0)).alias("covered"))


def filled_tables(cells: DataFrame) -> DataFrame:
    """doc_id, cells, filled, table: a grid is a table when a quarter of its cells hold text."""
    filled = F.count_if(F.coalesce("text", F.lit("")) != "")
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), filled.alias("filled"), (filled * 4 >= F.count(F.lit(1))).alias("is_table"))


def signed_revision(signatures: DataFrame) -> DataFrame:
    """Of each (doc_id, fingerprint) the latest valid revision: the number of its object, and its end."""
    return signatures.where("valid").groupBy("doc_id", "fingerprint").agg(F.max_by("id", F.struct("end", "id")).alias("id"), F.max("end").alias("end"))


def coverage(signatures: DataFrame, files: DataFrame) -> DataFrame:
    """Signatures (doc_id, id, gap_from, gap_to, end, valid, timestamp) with ``nth`` in the
    order of their numbers, ``nests`` and ``bounds``, and the ``tail`` of the file (doc_id,
    size) that no signature covers.

    A revision covers all bytes up to its end but the gap that holds the signature itself.
    It nests when that gap lies in what it adds: behind the end of every revision that
    ends before it, by a running maximum over the ends, and inside its own; of two with one
    end neither nests. Coverage is bounded by the last end of a valid one that nests and is
    no mere timestamp."""
    ends = Window.partitionBy("doc_id").orderBy("end").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(ends), F.lit(0))
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "end")) > 1
    nests = (F.col("gap_from") >= before) & (F.col("gap_from") < F.col("gap_to")) & (F.col("gap_to") <= F.col("end")) & ~same
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    rows = signatures.select("*", nth.alias("nth"), nests.alias("nests"))
    counts = F.col("valid") & F.col("nests") & ~F.col("timestamp")
    reach = F.max(F.when(counts, F.col("end"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("reach", F.coalesce(reach, F.lit(0))).withColumn("bounds", counts & (F.col("end") == reach))
    return rows.join(files, "doc_id").select("doc_id", "id", "nth", "nests", F.coalesce("bounds", F.lit(False)).alias("bounds"), (F.col("size") - F.col("reach")).alias("tail"))


def pictures_joined(figures: DataFrame, pictures: DataFrame) -> DataFrame:
    """Figures (doc_id, page, pos, resource) with the picture's bytes (doc_id, resource,
    bytes, broken), or the cause why there are none."""
    both = figures.join(pictures, ["doc_id", "resource"], "left")
    cause = F.when(F.col("resource").isNull(), "drawn").when(F.col("bytes").isNull() & F.col("broken").isNull(), "missing").when(F.col("broken"), "unreadable")
    return both.select("doc_id", "page", "pos", F.when(cause.isNull(), F.col("bytes")).alias("bytes"), cause.alias("cause"))


def listed_once(pictures: DataFrame) -> DataFrame:
    """Each picture (doc_id, object, page) on the first page that shows it."""
    return pictures.groupBy("doc_id", "object").agg(F.min("page").alias("page"), F.countDistinct("page").alias("pages"))


def attachments(tree: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id, name, page, place: the catalogue's (page 0) and then those of pages; of a
    document's equal names the later get a number."""
    both = tree.select("doc_id", "name", F.lit(0).alias("page"), "pos").unionByName(annotations.select("doc_id", "name", "page", "pos"))
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    same = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("page", "pos"))
    return both.select("doc_id", F.when(same == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), same.cast("string"), F.lit(")"))).alias("name"), "page", F.row_number().over(w).alias("place"))


def record_entries(files: DataFrame, name: str, kind: str, most: int) -> DataFrame:
    """Of each document's embedded files (doc_id, name, kind, size, in_tree) the one in the
    exact shape of a record that the tool wrote; two of them are none."""
    exact = files.where((F.col("name") == name) & (F.col("kind") == kind) & F.col("size").between(1, most) & F.col("in_tree"))
    return exact.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n = 1").select("doc_id", "size")


def masked(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text: characters of the marked spans (start from 0, end) as blocks; a text's
    spans are bounded by its length."""
    own = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    both = texts.join(own, "doc_id", "left")
    cover = lambda s, t: F.concat(F.substr(s, F.lit(1), t["start"]), F.repeat(F.lit("█"), F.greatest(F.least(t["end"], F.length(s)) - t["start"], F.lit(0))), F.substr(s, t["end"] + 1, F.lit(2**31 - 1)))
    return both.select("doc_id", F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.col("text"), cover).alias("text"))
