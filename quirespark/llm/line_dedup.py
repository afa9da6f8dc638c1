"""Line deduplication by pairwise patience alignment.

1. Each document becomes the array of its lines' 64-bit hashes (lines trimmed of
   white space; lines under ``LEAST_CHARS`` are no anchors).
2. Documents that share a rare line (in at most ``RARE`` documents) are paired with
   each other, and that pair is decided there alone. Two that share frequent lines only
   do to each other what their frequent lines say, whatever else they hold: documents with the same ones, up to
   the length of gaps, are one class, and classes are paired. A run of lines of
   ``BLOCK_CHARS`` goes to the first class that holds it and, where that leaves some
   of it, to all that do. The result is that of all pairs of documents that share a
   line of ``LEAST_CHARS``.
3. Each pair is aligned by patience diff: the lines that are unique in both
   documents and common to them, in longest increasing order, are anchors, grown
   over equal neighbours; gaps between anchors are aligned in the same way, and a gap
   without anchors by a longest common subsequence. A block of at least
   ``BLOCK_CHARS`` characters is common.
4. Common blocks are deleted from the later document (the larger id). Decisions are
   made on the input, so they do not depend on an order of pairs.

Alignment sees arrays of hashes and lengths, never texts. Joins are on exchanged
sides, so AQE splits a document with very many partners.

Rows: a null text has no lines. Rows with one id and different texts and rows with
null ids are documents of their own (null ids come last; of one id the order is that
of the texts' MD5). Rows with the same id, or none, and the same text are one document.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirespark.llm.common import slices, staged, text_of, tidied

LEAST_CHARS = 20
BLOCK_CHARS = 40
RARE = 4


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, increasing in both."""
    ca, cb = Counter(a), Counter(b)
    at = {h: k for k, h in enumerate(b)}
    anchors = [(i, at[h]) for i, h in enumerate(a) if ca[h] == 1 and cb.get(h) == 1]
    tails: list[int] = []
    stack: list[tuple[int, int, int]] = []  # i, j, the anchor before
    tops: list[int] = []
    for i, j in anchors:
        k = bisect_left(tails, j)
        before = tops[k - 1] if k else -1
        stack.append((i, j, before))
        tails[k : k + 1] = [j]
        tops[k : k + 1] = [len(stack) - 1]
    chain, at_ = [], tops[-1] if tops else -1
    while at_ >= 0:
        i, j, at_ = stack[at_]
        chain.append((i, j))
    chain.reverse()
    out: list[tuple[int, int]] = []
    ends = [*chain, (len(a), len(b))]
    last = (-1, -1)
    for k, (i, j) in enumerate(chain):
        grown = []
        x, y = i - 1, j - 1
        while x > last[0] and y > last[1] and a[x] == b[y]:
            grown.append((x, y))
            x, y = x - 1, y - 1
        out += [*reversed(grown), (i, j)]
        x, y = i + 1, j + 1
        while x < ends[k + 1][0] and y < ends[k + 1][1] and a[x] == b[y]:
            out.append((x, y))
            x, y = x + 1, y + 1
        last = out[-1]
    return out


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, bit-parallel; equal heads and tails first."""
    both = set(a) & set(b)
    x, y = [i for i, h in enumerate(a) if h in both], [j for j, h in enumerate(b) if h in both]
    lo, hi = 0, 0
    while lo < min(len(x), len(y)) and a[x[lo]] == b[y[lo]]:
        lo += 1
    while hi < min(len(x), len(y)) - lo and a[x[-1 - hi]] == b[y[-1 - hi]]:
        hi += 1
    head, tail = list(zip(x[:lo], y[:lo])), list(zip(x[len(x) - hi :], y[len(y) - hi :]))
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    places: dict[int, int] = {}
    for k, j in enumerate(y):
        places[b[j]] = places.get(b[j], 0) | 1 << k
    full = state = (1 << len(y)) - 1
    states = []
    for i in x:
        found = state & places.get(a[i], 0)
        state = ((state + found) | (state - found)) & full
        states.append(state)
    middle, row, col = [], len(x), len(y)
    while row and col:
        if states[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or states[row - 1] >> (col - 1) & 1:
                col -= 1
                middle.append((x[row], y[col]))
    return [*head, *reversed(middle), *tail]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: between neighbouring anchors again, with what is unique in the
    gap; a gap without anchors is aligned by a longest common subsequence."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        left, right = a[i:m], b[j:n]
        if not left or not right or set(left).isdisjoint(right):
            continue
        found = [(i + x, j + y) for x, y in patience(left, right)]
        if not found:
            out += [(i + x, j + y) for x, y in longest_common(left, right)]
            continue
        out += found
        for (x, y), (u, v) in zip([(i - 1, j - 1), *found], [*found, (m, n)]):
            if u - x > 1 and v - y > 1:
                gaps.append((x + 1, u, y + 1, v))
    return sorted(out)


def common_lines(early: list[int], late: list[int], chars: list[int], least: int = BLOCK_CHARS) -> list[int]:
    """Lines of the later document inside common blocks: runs adjacent in both."""
    out, run = [], []
    for pair in [*aligned(early, late), (-9, -9)]:
        if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(chars[j] for _, j in run) >= least:
                out += [j for _, j in run]
            run = []
        run.append(pair)
    return out


def windows_of(hashes: list[int | None], chars: list[int], least: int = BLOCK_CHARS) -> list[tuple[int, int]]:
    """From each line on, and up to each line, the least run of ``least`` characters
    without a gap (None). Every line of a block of so many characters is in such a run
    inside the block."""
    out = set()
    for step in (1, -1):
        for i in range(len(hashes)):
            j, n = i, 0
            while 0 <= j < len(hashes) and hashes[j] is not None:
                n += chars[j]
                if n >= least:
                    out.add((min(i, j), max(i, j) + 1))
                    break
                j += step
    return sorted(out)


def named(hashes: list[int], at: tuple[int, int]) -> bytes:
    return md5(array("q", hashes[slice(*at)]).tobytes()).digest()


def projected(hashes: list[int], chars: list[int], frequent: set[int]) -> tuple[list[int | None], list[int], list[int]]:
    """The frequent lines, their characters and numbers; a gap of any length is one None."""
    out, n, at = [], [], []
    for k, h in enumerate(hashes):
        if h in frequent:
            out.append(h), n.append(chars[k]), at.append(k)
        elif out and out[-1] is not None:
            out.append(None), n.append(0), at.append(-1)
    if out and out[-1] is None:
        out.pop(), n.pop(), at.pop()
    return out, n, at


def pair_lines(early: list[int | None], late: list[int | None], chars: list[int]) -> list[int]:
    """Lines of ``late`` in common blocks, if the two share a line of ``LEAST_CHARS``."""
    held = set(early)
    if not any(h in held and n >= LEAST_CHARS for h, n in zip(late, chars)):
        return []
    left, right = ([-2 * k - side if h is None else h for k, h in enumerate(x)] for side, x in ((1, early), (2, late)))
    return common_lines(left, right, chars)


def doc_of(id_col: str, text_col: str, kind: str) -> Column:
    """Order of documents: null ids last, of one id by the text's hash."""
    own = F.coalesce(F.col(id_col), F.lit("0").cast(kind))
    return F.struct(F.col(id_col).isNull().alias("nul"), own.alias("id"), F.md5(text_of(text_col)).alias("text"))


def lined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, hashes, chars: doc orders documents by id and tells texts of one id apart."""
    lines = F.transform(F.split(text_of(text_col), "\n"), lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    out = docs.select(doc_of(id_col, text_col, dict(docs.dtypes)[id_col]).alias("doc"), lines.alias("lines"))
    return out.select("doc", F.transform("lines", lambda s: F.xxhash64(s)).alias("hashes"), F.transform("lines", lambda s: F.length(s)).alias("chars"))


def over(rows: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """``make`` gives the output rows of one input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                found = [x for row in zip(*(part.column(c).to_pylist() for c in columns)) for x in make(*row)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], schema=arrow)

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    names = arrow.names
    return rows.select(*columns).mapInArrow(tidied(run), schema)


def rare_pairs(near: DataFrame) -> DataFrame:
    """early, late: documents that share a rare line."""
    few = near.where(F.col("n") <= RARE).groupBy("h").agg(F.sort_array(F.collect_list("doc")).alias("docs"))  # at most RARE each
    late = few.select("docs", F.posexplode("docs").alias("k", "late")).where("k > 0")
    return staged(late.select(F.explode(F.slice("docs", 1, F.col("k"))).alias("early"), "late").distinct(), "line-pairs")


def rare_cuts(single: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, line: removed by documents that share a rare line, in all their pairs."""
    for side in ("early", "late"):
        table = single.select(F.col("doc").alias(side), F.col("hashes").alias(f"{side}_hashes"), F.col("chars").alias(f"{side}_chars"))
        pairs = pairs.join(table.hint("merge"), side)
    kind = single.schema["doc"].dataType.simpleString()
    rows = pairs.select(F.col("late").alias("doc"), "early_hashes", "late_hashes", "late_chars")
    return over(rows, rows.columns, f"doc {kind}, line int", lambda doc, a, b, n: ((doc, k) for k in pair_lines(a, b, n)))


def frequent_cuts(single: DataFrame, near: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, line: removed by documents that share frequent lines only. What two of them
    do depends on their frequent lines alone, so it is decided between classes of
    documents with the same ones, and holds for the documents after a class's first.

    A pair that also shares a rare line is left out: ``rare_cuts`` decides it. So for a
    document that has such a pair with the first of a class, the class's first is the next
    that is not left out, and a run whose first class has none goes to the next class that
    has. Few documents are concerned, for a first has few rare pairs."""
    some = near.where(F.col("n") > RARE).groupBy("doc").agg(F.collect_set("h").alias("own"), F.max("size").alias("size")).where(F.col("size") >= LEAST_CHARS)
    both = single.join(some.hint("merge"), "doc")
    kind = single.schema["doc"].dataType.simpleString()

    def member(doc, hashes, chars, own):
        proj, n, at = projected(hashes, chars, set(own))
        yield doc, md5(repr(proj).encode()).digest(), proj, n, at

    members = staged(over(both, ["doc", "hashes", "chars", "own"], f"doc {kind}, cls binary, hashes array<bigint>, chars array<int>, at array<int>", member), "line-members")
    classes = staged(members.groupBy("cls").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.first("hashes").alias("hashes"), F.first("chars").alias("chars")), "line-classes")
    keys = over(classes, ["cls", "hashes", "chars"], "cls binary, w binary", lambda cls, h, n: ((cls, w) for w in {named(h, x) for x in windows_of(h, n)}))
    keys = staged(keys, "line-keys")
    order = classes.select("cls", "first", "last")
    held = staged(keys.join(order.hint("merge"), "cls"), "line-held")
    firsts = staged(held.groupBy("w").agg(F.min_by("cls", "first").alias("a"), F.max("last").alias("most"), F.min("first").alias("least")).where("most > least"), "line-firsts")

    # d, a, free: documents with a rare pair with a class's first, and its first that they have none with.
    touched = pairs.join(order.select(F.col("first").alias("early"), F.col("cls").alias("a")).hint("merge"), "early").select(F.col("late").alias("d"), "a")
    touched = touched.join(members.select(F.col("doc").alias("d"), F.col("cls").alias("b")).hint("merge"), "d")
    touched = staged(touched, "line-touched")
    later = touched.join(members.select(F.col("cls").alias("a"), "doc").hint("merge"), "a").where("doc < d")
    later = later.join(pairs.hint("merge"), (F.col("doc") == F.col("early")) & (F.col("d") == F.col("late")), "left_anti").groupBy("d", "a").agg(F.min("doc").alias("free"))
    touched = staged(touched.join(later.hint("merge"), ["d", "a"], "left"), "line-freed")

    def cuts(pairs: DataFrame, name: str) -> DataFrame:
        """b, first (of a), found (numbers in b's lines), a, open (windows of b not all found)."""
        left = classes.select(F.col("cls").alias("a"), "first", F.col("hashes").alias("x"))
        right = classes.select(F.col("cls").alias("b"), F.col("hashes").alias("y"), "chars")
        rows = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

        def make(a, b, first, x, y, n):
            found = pair_lines(x, y, n)
            gone = set(found)
            yield a, b, first, found, list({named(y, w) for w in windows_of(y, n) if not gone.issuperset(range(*w))})

        return staged(over(rows, ["a", "b", "first", "x", "y", "chars"], f"a binary, b binary, first {kind}, found array<int>, open array<binary>", make), name)

    # A run goes to the class that holds it first; where that leaves some of it, to all that hold it.
    one = staged(held.join(firsts.hint("merge"), "w").where("last > least").select("w", "a", F.col("cls").alias("b")), "line-one")
    none = touched.where("free IS NULL").select("d", "a", "b").join(one.hint("merge"), ["a", "b"])
    free = touched.select("d", F.col("a").alias("c"), "free", F.lit(True).alias("is_touched"))
    next_ = none.select("d", "b", "w").join(held.select("w", F.col("cls").alias("c"), "first").hint("merge"), "w").where("first < d").join(free.hint("merge"), ["d", "c"], "left")
    next_ = next_.withColumn("from", F.when(F.col("is_touched"), F.col("free")).otherwise(F.col("first"))).where(F.col("from") < F.col("d"))
    next_ = next_.groupBy("d", "b", "w").agg(F.min_by("c", "from").alias("a")).select("w", "a", "b")
    tried = staged(one.unionByName(next_).distinct(), "line-tried")
    done = cuts(staged(tried.select("a", "b").distinct(), "line-first"), "line-done")
    rest = done.select("a", "b", F.explode("open").alias("w")).join(tried.hint("merge"), ["w", "a", "b"])
    rest = staged(rest.join(order.select(F.col("cls").alias("b"), "last").hint("merge"), "b"), "line-open")
    others = rest.withColumnRenamed("a", "tried").join(held.select("w", F.col("cls").alias("a"), "first").hint("merge"), "w")
    others = others.where("first < last AND a != tried").select("a", "b").distinct().join(tried.select("a", "b").distinct().hint("merge"), ["a", "b"], "left_anti")
    every = done.unionByName(cuts(staged(others, "line-others"), "line-rest"))
    least = every.select("b", "first", F.explode("found").alias("k")).groupBy("b", "k").agg(F.min("first").alias("first"))
    cover = staged(least.groupBy("b").agg(F.collect_list(F.struct("k", "first")).alias("cover")), "line-cover")
    apart = staged(touched.join(every.select("a", "b").hint("merge"), ["a", "b"]).select("d").distinct(), "line-apart")
    out = members.join(apart.select(F.col("d").alias("doc")).hint("merge"), "doc", "left_anti").select("doc", F.col("cls").alias("b"), "at").join(cover.hint("merge"), "b")
    out = out.select("doc", F.explode(F.expr("transform(filter(cover, c -> c.first < doc), c -> at[c.k])")).alias("line"))
    # The concerned: each class that they meet, from the first that they have no rare pair with.
    own = members.join(apart.select(F.col("d").alias("doc")).hint("merge"), "doc", "left_semi").select(F.col("doc").alias("d"), F.col("cls").alias("b"), "at")
    met = own.join(every.select("a", "b", "first", "found").hint("merge"), "b").join(touched.select("d", "a", "free", F.lit(True).alias("is_touched")).hint("merge"), ["d", "a"], "left")
    met = met.withColumn("from", F.when(F.col("is_touched"), F.col("free")).otherwise(F.col("first"))).where(F.col("from") < F.col("d"))
    return out.unionByName(met.select(F.col("d").alias("doc"), F.explode(F.expr("transform(found, k -> at[k])")).alias("line")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, removed (sorted line numbers), of the documents that lose lines."""
    lines = lined(docs, id_col, text_col)
    single = staged(lines.groupBy("doc").agg(F.first("hashes").alias("hashes"), F.first("chars").alias("chars")), "line-single")
    own = single.select("doc", F.explode(F.arrays_zip("hashes", "chars")).alias("line"))
    own = staged(own.select("doc", F.col("line.hashes").alias("h"), F.col("line.chars").alias("size")).distinct(), "line-own")
    seen = staged(own.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-seen")
    near = staged(own.join(seen.hint("merge"), F.col("_h") == F.col("h")).select("doc", "h", "size", "n"), "line-near")
    pairs = rare_pairs(near)
    gone = rare_cuts(single, pairs).unionByName(frequent_cuts(single, near, pairs)).distinct()
    return gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def drop_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (lines left)."""
    gone = staged(removed_lines(docs, id_col, text_col), "line-gone").withColumnRenamed("doc", "_doc")
    own = docs.select(F.col(id_col).alias("doc_id"), F.split(text_of(text_col), "\n").alias("lines"), doc_of(id_col, text_col, dict(docs.dtypes)[id_col]).alias("doc"))
    # Texts move once, whatever their number: one plan for all sizes.
    both = own.join(gone.hint("merge"), own["doc"] == gone["_doc"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    starts, ends = F.concat(F.array(F.lit(-1)), removed), F.concat(removed, F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 2, b - a - 1)))  # between removed lines
    n = F.when(F.array_join("lines", "") == "", F.lit(0)).otherwise(F.size("lines"))
    return both.select("doc_id", n.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("text"))
