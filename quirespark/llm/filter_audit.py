"""Filter interaction audit by inclusion and exclusion.

Filters are named flags of a document (true: it fails). For every set U of filters the
corpus gives one number, the documents that fail all of U: the sum of the product of
their flags. These 2 ** n joint counts per part are all that is aggregated, for all
documents and for those that labels mark; everything else is arithmetic on them:

* kept(T), documents that no filter of T fails: the Moebius sum of (-1) ** |U| joint(U)
  over the U within T. What a filter removes after those of T is kept(T) - kept(T + it).
* What only one filter fails: the sum of (-1) ** (|U| - 1) joint(U) over the U with it.
* Shapley: the game v(T) = documents that T removes has the Harsanyi dividends
  (-1) ** (|U| - 1) joint(U), which the members of U share equally. Times n! it is what
  the filter removes in all orders together, a whole number.

The flag of a copy (E) asks for the smallest id among rows of the same text, table-wide.
Texts are grouped by SHA-256 in narrow rows, combined before the exchange; the join back
has two exchanged sides, so AQE splits a text that a third of the rows share.

Rows: a null text counts as empty, so nulls and empty texts are copies of each other. A
null source is the part of the empty string. Rows of one id and text don't make each
other copies (the id is not smaller); a null id comes after all others. A label counts
once for an id, however often the label table has it. An empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import WORD, join_checked, staged, text_of

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABELS = ("good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at one text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{UPPER}]+", ""))) > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, sha, ...) with E: a smaller id has the same text."""
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = staged(first, "audit-first").withColumnRenamed("sha", "_sha")
    both = join_checked(rows, first, F.col("sha") == F.col("_sha"), "left")
    later = (F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull())
    return both.withColumn("E", F.coalesce(later, F.lit(False))).drop("_sha", "first", "sha")


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: part, a flag for each filter, good, toxic."""
    text = text_of(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *(c.alias(k) for k, c in text_flags(text).items()), F.unhex(F.sha2(text, 256)).alias("sha"))
    rows = copies(staged(own, "audit-flags"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = join_checked(rows, staged(marks.where("good OR toxic"), "audit-labels"), F.col("doc_id") == F.col("_id"), "left")
    return both.select("part", *FILTERS, *(F.coalesce(m, F.lit(False)).alias(m) for m in LABELS))


def joint_counts(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, and for all documents and each label an array of joint counts by set (bit k
    of an index is filter k): one aggregate of flag products, combined on the map side."""
    every = range(2 ** len(filters))
    product = lambda u, own: " * ".join([own, *(f"CAST({f} AS LONG)" for k, f in enumerate(filters) if u >> k & 1)])
    weights = {"every": "1L", **{m: f"CAST({m} AS LONG)" for m in LABELS}}
    sums = rows.groupBy("part").agg(*(F.expr(f"sum({product(u, own)}) AS {name}_{u}") for name, own in weights.items() for u in every))
    return sums.selectExpr("part", *(f"array({', '.join(f'{name}_{u}' for u in every)}) AS {name}" for name in weights))


def signed_sum(joint: str, sets: list[int], weight) -> str:
    return " + ".join(f"({weight(u)}) * {joint}[{u}]" for u in sets)


def steps_of(filters: str) -> str:
    """A table of each order and step: the filter's number and the sets before and after."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(f"struct('{''.join(filters[x] for x in order)}', {step}, {k}, {before}, {before | 1 << k})")
            before |= 1 << k
    return f"inline(array({', '.join(rows)})) AS (filter_order, step, k, before, after)"


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: a row for each part, order of the filters and step."""
    n, every = len(filters), range(2 ** len(filters))
    within = lambda t: [u for u in every if u & ~t == 0]
    having = lambda k: [u for u in every if u >> k & 1]
    sign = lambda u: (-1) ** u.bit_count()
    kept = [f"array({', '.join(signed_sum(name, within(t), sign) for t in every)}) AS {name}_kept" for name in ("every", *LABELS)]
    alone = ", ".join(signed_sum("every", having(k), lambda u: -sign(u)) for k in range(n))
    # Dividends times n!, each shared by the members of its set: whole numbers, as n! / size is one.
    share = ", ".join(signed_sum("every", having(k), lambda u: -sign(u) * factorial(n) // u.bit_count()) for k in range(n))
    fails = ", ".join(f"every[{1 << k}]" for k in range(n))
    read = joint_counts(rows, filters).selectExpr("part", *kept, f"array({alone}) AS alone", f"array({share}) AS share", f"array({fails}) AS fails")
    lost = lambda name: f"{name}_kept[before] - {name}_kept[after]"
    return read.selectExpr("*", steps_of(filters)).selectExpr(
        "part", "filter_order", "step", "every_kept[after] AS kept", f"{lost('every')} AS removed", f"fails[k] - ({lost('every')}) AS redundant",
        "alone[k] AS unique_fails", *(f"{lost(m)} AS {m}_lost" for m in LABELS), "share[k] AS shapley",
    )
