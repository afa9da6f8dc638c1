"""Exact deduplication by 128-bit content hash with byte comparison in groups.

Rows whose texts are identical after deleting white space (``[\\x20\\x09-\\x0D]``)
are copies. Of copies the row with the most code points in its original text
stays, then the one with the smallest id.

Plan: one pass hashes every text (MD5, 128 bits) into a narrow staged table; a
hash that occurs once needs nothing more. Only texts whose hash repeats are
moved, once, and grouped by hash *and* bytes, so a collision of hashes separates.
Groups collapse on the map side; the join back is on two exchanged sides, so AQE
splits a group that holds a third of all rows.

Rows: a null text counts as empty; empty and white texts are copies of each
other. A null id sorts after every other id. Rows repeated with the same id and
text count one by one in ``group_size``, all carry ``kept`` when their id stays,
and ``drop_copies`` leaves one. Other columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import is_small, join_checked, staged, text_of

BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = text_of(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.char_length(text).alias("n"), normalised(text).alias("norm")
    ).withColumn("h", F.unhex(F.md5("norm")))
    narrow = staged(keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")), "exact-hashes")
    repeated = staged(narrow.groupBy("h").count().where("count > 1").select("h"), "exact-repeated")
    alone = join_checked(narrow, repeated, "h", "left_anti")
    copies = staged(join_checked(keyed, repeated, "h", "left_semi"), "exact-copies")
    # Of one hash and the same bytes: the keeper and the size.
    best = F.min_by("doc_id", F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id"))
    classes = staged(
        copies.groupBy("h", "norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-classes"
    )
    joined = copies.select("doc_id", "h", "norm").join(classes.hint("merge"), ["h", "norm"])
    grouped = joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    groups = exact_groups(docs, id_col, text_col)
    # By id and text: another row of a copy's id may have a text of its own.
    dropped = staged(groups.where("NOT kept").select(F.col("doc_id").alias("_dropped"), F.col("text_sha256").alias("_sha256")).distinct(), "exact-dropped")
    own = docs.withColumn("_own_sha256", F.sha2(normalised(text_of(text_col)), 256))
    kept = join_checked(own, dropped, own[id_col].eqNullSafe(dropped["_dropped"]) & (own["_own_sha256"] == dropped["_sha256"]), "left_anti").drop("_own_sha256")
    twice = staged(groups.where("kept AND group_size > 1").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")), "exact-twice")
    if not is_small(twice, 0):  # rows repeated with id and text: one of each stays
        text, again = F.md5(normalised(text_of(text_col))), F.broadcast(twice) if is_small(twice) else twice
        rest = kept.join(again, kept[id_col].eqNullSafe(again["_twice"]), "left_anti")
        same = kept.join(again, kept[id_col].eqNullSafe(again["_twice"]), "left_semi").withColumn("_norm_md5", text)
        kept = rest.unionByName(same.dropDuplicates([id_col, "_norm_md5"]).drop("_norm_md5"))
    return kept
