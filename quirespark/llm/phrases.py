"""Phrase collocation mining with generalised suffix automata.

1. Texts (A-Z lowered) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
   words. A *shard* is ``SHARD_BYTES`` of texts. Of each shard and language a suffix
   automaton over words is built, generalised (of many pieces) and bounded in depth.
2. A state is a class of substrings with the same end positions: the longest, and with
   it its suffixes down to some length, with one count. States travel as they are,
   (language, longest, least length, count); their substrings are read off in the JVM.
3. Counts are summed by phrase. A shard sends a phrase once, so no phrase has more rows
   than there are shards, however common it is.
   Most phrases occur too seldom to be a candidate, so lengths are counted first, one by
   one and by 32-bit hashes: pairs, then triples whose pairs are frequent, and so on. An
   automaton grows no further where a phrase is surely too rare; a frequent phrase has
   only frequent phrases in it, so its count stays whole. What is not rare is told by a
   filter of 2 ** ``FILTER_BITS`` bits, 16 MB at any size of the corpus. A phrase that
   shares its bit with a frequent one is only counted in vain.
4. A phrase's links, its longest proper suffix and prefix, lead from a longer candidate
   to what lies inside it: the greatest count that arrives over a link decides whether a
   phrase is subsumed. (Words of a longer one that lie inside it lie in a link of a
   candidate one word longer, and counts only fall with length.)

The automaton is built from its link tree, which is the suffix tree of the reversed
pieces: each position is sorted into its contexts of 1, 2, ... words back, one sort a
depth; a context that is always preceded by the same word shares the state of the
longer one. Counts are exact: contexts are pairs of numbers, and hashes
only ever spare work.

Scores are whole numbers of DECIMAL(38): floor(1000000 a a / (l r)) of the cut that
scores least.

Rows: a null text has no words, a null language is ``und``; ids are not read, so null
and repeated ids change nothing and repeated rows count each. A language without words
has no rows, nor has an empty table. A piece longer than a shard is not cut: it is its
text's, and a text is never cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.common import arrow_rows, join_checked, sized, staged, text_of, tidied
from quirespark.llm.shingles import FACTOR, mixed

SHARD_BYTES = 4 << 20
#: Rows of a batch to Python: texts are long.
BATCH_ROWS = 500
MOST_WORDS = 3
LEAST_COUNT = 10
SUBSUMED_PERCENT = 50
TOP = 2000
#: Bits of the filter of pairs, as a power of two: at most 2 ** 21 words of it reach the driver.
FILTER_BITS = 27
SCALE = 1_000_000
#: Stops and line ends become the mark of a cut, tabs blanks.
CUT = b"\n"
CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", CUT * 9 + b" ")


def worded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts' words as numbers, of each the words before it in its piece, and the
    words that the numbers stand for."""
    blob = CUT.join(texts).lower().translate(CUTS).replace(CUT, b" \n ")
    found = pc.split_pattern(pa.array([blob.decode("utf-8", "replace")], pa.large_string()), " ").values.dictionary_encode()
    codes, names = np.asarray(found.indices).astype(np.int64), found.dictionary
    number = {x: k for x in ("", "\n") if (k := pc.index(names, x).as_py()) >= 0}
    codes = codes[codes != number.get("", -1)]
    cut = codes == number.get("\n", -1)
    first = np.concatenate(([True], cut[:-1]))[~cut] if len(codes) else cut
    return codes[~cut], since(first), names


def since(first: np.ndarray) -> np.ndarray:
    """Of each place how many lie between it and the last one marked as a first."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(first) else at


def bits_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of the filter for a key."""
    bit = keys >> np.uint64(64 - FILTER_BITS)
    return bit >> np.uint64(6), bit & np.uint64(63)


class Automaton:
    """The states of the suffix automaton of pieces, up to a depth.

    ``words`` are the pieces' words one after the other, ``before`` how many words of
    its piece precede each. Of depth d = 1, 2, ... there are the nodes of the link tree,
    the distinct contexts of d words: ``count`` (end positions), ``end`` (one of them),
    ``link`` (the node of the context without its first word), ``least`` (the shortest
    suffix in the same state), ``tops`` (whether it is the longest of its state) and
    ``key``, a hash of the words (``hashes``). ``grows(d, key)`` tells which nodes of a
    depth from 2 are of use; others, and all that goes on from them, are left out."""

    def __init__(self, words: np.ndarray, before: np.ndarray, depth: int, hashes: np.ndarray | None = None, grows=None):
        self.words, self.levels = words, []
        hashes = np.zeros(int(words.max(initial=0)) + 1, dtype=np.uint64) if hashes is None else hashes
        at, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        many = int(words.max(initial=0)) + 1
        for d in range(1, depth + 1):
            held = before[at] >= d - 1
            at, parent = at[held], node[held]
            keys, first, node, count = np.unique(parent * many + words[at - (d - 1)], return_index=True, return_inverse=True, return_counts=True)
            link, end = parent[first], at[first]
            above = self.levels[-1] if self.levels else {"key": np.zeros(1, dtype=np.uint64)}
            key = mixed(above["key"][link] * FACTOR + hashes[words[end - (d - 1)]] + np.uint64(d))
            if d > 1 and grows is not None:
                stays = grows(d, key)
                on, number = stays[node], np.cumsum(stays) - 1
                at, node, count, link, end, key = at[on], number[node[on]], count[stays], link[stays], end[stays], key[stays]
            level = {"count": count, "end": end, "link": link, "key": key, "least": np.full(len(count), d), "tops": np.ones(len(count), dtype=bool)}
            if self.levels:  # as many end positions as its link: they are the same ones
                same = count == above["count"][link]
                level["least"][same] = above["least"][link[same]]
                above["tops"][link[same]] = False
            self.levels.append(level)

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each depth: the words of the longest, a column a word, least lengths, counts."""
        for d, level in enumerate(self.levels, 1):
            end = level["end"][level["tops"]]
            yield d, np.stack([self.words[end - k] for k in range(d - 1, -1, -1)]), level["least"][level["tops"]], level["count"][level["tops"]]


def automaton(words: np.ndarray, before: np.ndarray, names: pa.Array, lang: str, depth: int, frequent: np.ndarray, upto: int) -> Automaton:
    """Of depths 2 to ``upto`` only what the filter holds."""
    own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(names)) + own

    def grows(d: int, key: np.ndarray) -> np.ndarray:
        word, bit = bits_of(key)
        return (frequent[word] >> bit & np.uint64(1)) > 0 if d <= upto else np.ones(len(key), dtype=bool)

    return Automaton(words, before, depth, hashes, grows)


def shard_keys(texts: list[bytes], lang: str, depth: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """32-bit hashes and counts of the phrases of ``depth`` words whose shorter ones the filter holds."""
    words, before, names = worded(texts)
    level = automaton(words, before, names, lang, depth, frequent, depth - 1).levels[-1]
    for at in range(0, len(level["key"]), 200_000):
        part = slice(at, at + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array((level["key"][part] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(level["count"][part].astype(np.int32))], ["key", "f"])


def shard_states(texts: list[bytes], lang: str, depth: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    words, before, names = worded(texts)
    names = names.cast(pa.string())
    row = lambda phrase, least, count: pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(least, pa.int32()), pa.array(count, pa.int64())], ["lang", "longest", "least", "f"])
    if not len(words):
        return
    yield row(pa.array([""]), [0], [len(words)])  # all words, under the phrase of none
    for d, columns, least, count in automaton(words, before, names, lang, depth, frequent, depth).states():
        for at in range(0, len(count), 100_000):
            part = slice(at, at + 100_000)
            spelt = pc.binary_join_element_wise(*(names.take(pa.array(c[part])) for c in columns), " ") if d > 1 else names.take(pa.array(columns[0][part]))
            yield row(spelt, least[part].astype(np.int32), count[part])


def by_shard(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make`` gives the batches of one shard's texts in one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = defaultdict(list), 0
        for batch in batches:
            for part in sized(batch, "text", SHARD_BYTES):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    shard[lang].append(text)
                    size += len(text)
                if size >= SHARD_BYTES:
                    for lang in list(shard):
                        yield from make(shard.pop(lang), lang)
                    size = 0
        for lang in list(shard):
            yield from make(shard.pop(lang), lang)

    return rows.mapInArrow(tidied(run), schema)


def frequent_phrases(rows: DataFrame, depth: int, least: int) -> np.ndarray:
    """The filter: a bit for each hash of a phrase of 2 to ``depth`` words with so many
    occurrences, length by length, each counted where the shorter ones are held."""
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for d in range(2, depth + 1):
        held = rows.sparkSession.sparkContext.broadcast(out)
        keys = by_shard(rows, "key int, f int", lambda texts, lang: shard_keys(texts, lang, d, held.value)).repartition("key")  # noqa: B023  most keys are of one shard: no sums before the exchange
        keys = keys.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        bit = F.shiftrightunsigned("key", 32 - FILTER_BITS)
        flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
        with arrow_rows(rows.sparkSession, BATCH_ROWS):
            words = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(flag).alias("flags")).toArrow()
        held.unpersist()
        out = out.copy()
        out[words.column("word").to_numpy()] |= words.column("flags").to_numpy().view(np.uint64)
    return out


def some_words(phrase: str, n: Column) -> Column:
    """A phrase's first n words, or its last -n."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n.cast("int"))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """lang, phrase, f: phrases of 1 to ``depth`` words with a count of ``least`` or
    more, and under the empty phrase the number of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_phrases(rows, depth, least))
    states = by_shard(rows, "lang string, longest string, least int, f long", lambda texts, lang: shard_states(texts, lang, depth, frequent.value))
    lengths = F.sequence("least", F.when(F.col("least") == 0, F.lit(0)).otherwise(F.regexp_count("longest", F.lit(" ")) + 1))
    phrases = states.select("lang", "longest", "f", F.explode(lengths).alias("k")).select("lang", some_words("longest", -F.col("k")).alias("phrase"), "f")
    counts = phrases.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = MOST_WORDS, least: int = LEAST_COUNT, percent: int = SUBSUMED_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        counts = staged(phrase_counts(docs, text_col, lang_col, depth, least), "phrase-counts")
    spaces = F.regexp_count("phrase", F.lit(" "))
    found = counts.where(spaces > 0).select("lang", "phrase", F.col("f").alias("a"), (spaces + 1).alias("k"))
    # What arrives over links from candidates a word longer.
    links = found.where("k > 2").select("lang", "a", F.explode(F.array(some_words("phrase", F.col("k") - 1), some_words("phrase", 1 - F.col("k")))).alias("inside"))
    over = links.groupBy(F.col("lang").alias("_lang"), "inside").agg(F.max("a").alias("over"))
    left = found.join(over.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("inside")), "left").where(f"over IS NULL OR 100 * over < {percent} * a")
    # Each cut's parts, then the cut that scores least.
    cuts = left.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", some_words("phrase", F.col("cut")).alias("first"), some_words("phrase", F.col("cut") - F.col("k")).alias("rest"))
    for side, count in (("first", "l"), ("rest", "r")):
        table = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(count))
        cuts = cuts.join(table.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase")
    wide = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) DIV ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    words = counts.where("phrase = ''").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return join_checked(ranked, words, F.col("lang") == F.col("_lang"), "inner").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
