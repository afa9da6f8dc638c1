"""Mixing sources to target weights by weighted fair queueing, in DataFrame
operations only.

Every source is a queue of its documents in a fixed pseudo-random order (MD5 of
the id). A document's virtual finish time is the words of its source up to and
including it, divided by the source's target; a second pass over the queue goes
on where the first ended. All passes of all queues are range-sorted by finish
time, and the prefix within the total budget is the mix.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; a target stops at twice its source's words and the
excess is shared again by weight until none is above. That is the water level L
with sum(min(2 * size, L * weight)) = budget: with the sources by size / weight,
it is the largest level at which the sources before count with their cap.

Rows: a null text has size 0 and takes 0. Null ids and repeated rows are rows like
any other; of one id the order is that of sizes, then of the texts' hashes, and rows
that are equal in all these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.common import WORD, is_small, join_checked, prefix_sums, staged, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2


def sources_with_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size, weight, target; one row a source. Its windows hold one
    row a source, never documents."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * passes
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    weighed = sums.withColumn("weight", weight.cast("long")).withColumn("level", level)
    target = F.least(cap.cast("double"), F.max("level").over(whole) * F.col("weight"))
    return weighed.withColumn("target", target).drop("level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return taken_words(docs, id_col, text_col, source_col, **params).select("doc_id", "size", "source_size", "target", "taken")


def size_of(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def taken_words(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Those columns, source, and the text's hash."""
    sized = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), F.xxhash64(text_of(text_col)).alias("hash")).withColumn(
            "turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        ),
        "mix-sized",
    )
    sources = staged(sources_with_targets(sized, weights, share, passes), "mix-sources")
    queued = prefix_sums(sized, ["source"], ["turn", "doc_id", "size", "hash"], "size", "ahead", sized.count())
    level = F.broadcast(sources) if is_small(sources) else sources.hint("merge")
    queued = queued.join(level, queued["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    queued = staged(queued, "mix-queued")

    # Each pass of a document that has words, by finish time.
    finish = lambda k: (F.col("ahead") + F.col("size") + F.col("source_size") * k) / F.col("target")
    sort = ["finish", "turn", "doc_id", "hash", "pass"]
    items = queued.where("size > 0").select("size", "turn", "doc_id", "hash", F.posexplode(F.array(*(finish(k) for k in range(passes)))).alias("pass", "finish"))
    ranged = staged(items.repartitionByRange(*sort).select("*", F.spark_partition_id().alias("part")), "mix-ranged")
    # Sums of the ranges (a row each), then the rows of the one in which the budget ends.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share).first()[0]
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"), F.max(F.struct(*sort)).alias("last")).withColumn("upto", F.sum("words").over(upto))
    whole = sums.where(F.col("upto") <= budget).agg(F.max("part").alias("part"), F.max("upto").alias("upto"), F.max("last").alias("last")).first()
    cut = sums.where(F.col("upto") > budget).agg(F.min("part")).first()[0]
    last = whole["last"]
    if cut is not None:
        running = F.sum("size").over(Window.partitionBy("part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
        within = ranged.where(F.col("part") == cut).withColumn("upto", running + (whole["upto"] or 0)).where(F.col("upto") <= budget)
        last = within.agg(F.max(F.struct(*sort))).first()[0] or last
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        end = F.struct(F.lit(last["finish"]), F.lit(last["turn"]), F.lit(last["doc_id"]).cast(dict(queued.dtypes)["doc_id"]), F.lit(last["hash"]), F.lit(last["pass"]))
        within = lambda k: (F.struct(finish(k), F.col("turn"), F.col("doc_id"), F.col("hash"), F.lit(k)) <= end).cast("long")
        taken = F.when(F.col("size") > 0, F.col("size") * sum((within(k) for k in range(1, passes)), within(0))).otherwise(F.lit(0).cast("long"))
    return queued.select("doc_id", "source", "size", "hash", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each time it takes one."""
    taken = taken_words(docs, id_col, text_col, source_col, **params)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("long")).otherwise(0)
    keys = taken.groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("hash").alias("_mix_hash")).agg(F.count(F.lit(1)).alias("_mix_rows"), F.sum(times).alias("_mix_times"))
    keys = staged(keys.where("_mix_times > 0"), "mix-times")
    on = docs[id_col].eqNullSafe(keys["_mix_id"]) & docs[source_col].eqNullSafe(keys["_mix_source"]) & (F.xxhash64(text_of(text_col)) == keys["_mix_hash"])
    copies = lambda df, n: df.select(*(df[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_mix_copy")).drop("_mix_copy")
    even = join_checked(docs, keys, on, "inner")
    uneven = staged(keys.where("_mix_times % _mix_rows != 0"), "mix-uneven")
    if is_small(uneven, 0):
        return copies(even, F.floor(F.col("_mix_times") / F.col("_mix_rows")))
    # Of rows equal in id, source and text some are taken once more: any, but so many.
    some = staged(join_checked(docs, uneven, on, "inner").withColumn("_mix_tag", F.md5(F.monotonically_increasing_id().cast("string"))), "mix-some")
    ranked = prefix_sums(some.withColumn("_mix_one", F.lit(1)), ["_mix_id", "_mix_source", "_mix_hash"], ["_mix_tag"], "_mix_one", "_mix_rank", some.count())
    more = F.floor(F.col("_mix_times") / F.col("_mix_rows")) + (F.col("_mix_rank") < F.col("_mix_times") % F.col("_mix_rows")).cast("long")
    ranked = ranked.withColumn("_mix_n", more).where("_mix_n > 0")
    return copies(even.where("_mix_times % _mix_rows = 0"), F.floor(F.col("_mix_times") / F.col("_mix_rows"))).unionByName(copies(ranked, F.col("_mix_n")))
