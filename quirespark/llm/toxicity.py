"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fit, on at most ``EXAMPLES`` labelled rows chosen by the hash of their id: the
vocabulary is every word of the examples (letter runs, lowered). A word weighs
sqrt(count) * idf * (``FLOOR`` + told): idf from the document frequencies of all
documents, and told the lower bound, ``SURE`` standard errors below, of the logarithm
by which the word is likelier among toxic examples, at least 0. Words that tell
nothing keep the floor, each in a dimension of its own; none is cut. Words outside the
vocabulary have no weight. Everything but the fit covers all documents.

Search: the examples' vectors form an inverted index in blocks of ``BLOCK`` examples,
ordered by label, commonest and heaviest word. Each word knows its largest weight in
each block. A query's rare words are summed over their short lists; what its frequent
words may add to a block is bounded by the sum of their largest weights there. Blocks
are scored by falling bound until no bound left reaches the k-th best cosine. That is
exact. The neighbours vote with their cosine as weight,
smoothed towards the labels' base rate, which a text without any known word gets.

Rows: a null or empty text gets the base rate. Labels that are null are left out;
a document labelled twice counts as toxic if either says so; of rows of one labelled
id, that with the least text is the example. With no labels, or none of one class,
every score is the base rate (0 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import join_checked, slices, staged, text_of, tidied

EXAMPLES = 4096
NEIGHBOURS = 11
BLOCK = 64
#: Weight of the base rate against the neighbours' votes.
PRIOR = 0.02
CUT = 0.7
#: Weight of a word that tells nothing, and standard errors asked of one that does.
FLOOR, SURE = 0.1, 2.5
#: Frequent terms whose lists are matrix rows; queries searched together; postings
#: expanded at once; best blocks that are scored before the bounds are looked at again.
DENSE, QUERIES, STEP, FIRST = 512, 128, 1 << 18, (2, 8)
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1


def term_counts(sample: DataFrame) -> DataFrame:
    """term, in_toxic, in_other: documents of each class that hold it (rows: text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1)):
                both[toxic.as_py()].update(set(words_of(text.as_py())))
            terms = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (both[1], both[0]))], ["term", "in_toxic", "in_other"])

    counted = sample.select("text", "toxic").mapInArrow(tidied(run), "term string, in_toxic long, in_other long")
    return counted.groupBy("term").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))


def told(in_toxic: np.ndarray, in_other: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """Lower bounds of the words' log-odds of toxic examples, at least 0."""
    odds = np.log((in_toxic + 0.5) / (in_other + 0.5)) - np.log((toxic + 0.5) / (other + 0.5))
    return np.maximum(0.0, odds - SURE * np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_other + 0.5)))


def vectors(docs: DataFrame, terms, columns: list[str]) -> DataFrame:
    """The columns, terms (numbers in the broadcast vocabulary) and counts, a row per
    row of (columns, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(terms.value)}
        for batch in (part for whole in batches for part in slices(whole, 512)):
            at, found, times = [0], [], []
            for text in batch.column("text").to_pylist():
                for word, n in Counter(words_of(text)).items():
                    if (k := number.get(word)) is not None:
                        found.append(k)
                        times.append(n)
                at.append(len(found))
            offsets = pa.array(at, pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, times))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *lists], [*columns, "terms", "counts"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(tidied(run), f"{kinds}, terms array<int>, counts array<int>")


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of all the ranges, and the number of each one's range."""
    size = ends - starts
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(size) - size), size), of


class BlockMaxIndex:
    """Inverted index of unit vectors with the largest weight of each term by block.

    The posting lists of the ``dense`` most frequent terms are rows of a matrix, the
    others runs of one array; that is layout only."""

    def __init__(self, of: np.ndarray, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, block: int = BLOCK, dense: int = DENSE):
        """``of``, ``terms``, ``counts``: the examples' words, with their example's number."""
        self.idf, self.block, self.n = idf, block, len(labels)
        weights = self.weights(of, terms, counts, self.n)
        keys = []
        for by in (counts, weights):  # each example's commonest and heaviest word
            order = np.lexsort((terms, -by, of))
            first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
            key = np.full(self.n, -1)
            key[of[first]] = terms[first]
            keys.append(key)
        #: Example at each place.
        self.order = np.lexsort((keys[1], keys[0], labels))
        self.labels = labels[self.order].astype(np.float64)
        self.blocks = -(-self.n // block)
        place = np.empty(self.n, dtype=np.int64)
        place[self.order] = np.arange(self.n)
        at = place[of]
        frequent = np.argsort(-np.bincount(terms, minlength=len(idf)), kind="stable")[:dense]
        #: Row of each frequent term in the matrix, -1 for the others; the matrix; its maxima by block.
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.blocks * block))
        often = self.row[terms] >= 0
        self.matrix[self.row[terms[often]], at[often]] = weights[often]
        self.most = self.matrix.reshape(len(frequent), self.blocks, block).max(axis=2) if self.n else np.zeros((len(frequent), 0))
        at, terms, weights = at[~often], terms[~often], weights[~often]
        order = np.lexsort((at, terms))
        self.at, self.weight = at[order].astype(np.int32), weights[order]
        self.start = np.searchsorted(terms[order], np.arange(len(idf) + 1)).astype(np.int32)

    def weights(self, of: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        weight = np.sqrt(counts) * self.idf[terms]
        norm = np.sqrt(np.bincount(of, weights=weight * weight, minlength=n))
        return weight / np.where(norm > 0, norm, 1.0)[of]

    def nearest(self, of: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest examples of n queries, the best first; of
        equal cosines the smaller place. Missing ones have cosine 0."""
        cosines, places = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
        weight, ends = self.weights(of, terms, counts, n), np.searchsorted(of, np.arange(n + 1))
        for a in range(0, n if self.n else 0, QUERIES):
            b = min(n, a + QUERIES)
            own = slice(ends[a], ends[b])
            cosines[a:b], places[a:b] = self.search(of[own] - a, terms[own], weight[own], b - a, k)
        return cosines, places

    def search(self, of: np.ndarray, terms: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        width, often = self.blocks * self.block, self.row[terms] >= 0
        query = np.zeros((n, len(self.matrix)))
        query[of[often], self.row[terms[often]]] = weight[often]
        # Rare terms: their short lists are summed. What frequent ones may add is bounded by block.
        rare, own, w = terms[~often], of[~often], weight[~often]
        scores = np.zeros((n, width))
        for a, b in steps(self.start[rare + 1] - self.start[rare]):
            posting, entry = ranges(self.start[rare[a:b]], self.start[rare[a:b] + 1])
            scores += np.bincount(own[a:b][entry] * width + self.at[posting], weights=w[a:b][entry] * self.weight[posting], minlength=n * width).reshape(n, width)
        bounds = scores.reshape(n, self.blocks, self.block).max(axis=2) + query @ self.most
        rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
        scored, best = np.zeros(bounds.shape, dtype=bool), np.zeros(n)
        for upto in (*FIRST, self.blocks):
            # Bounds are sums in another order than scores, so they get some room.
            chosen = ~scored & (rank < upto) & (bounds > 0) & (bounds * (1 + 1e-9) >= best[:, None])
            for block in np.flatnonzero(chosen.any(axis=0)):
                rows, part = np.flatnonzero(chosen[:, block]), slice(block * self.block, (block + 1) * self.block)
                scores[rows, part] += query[rows] @ self.matrix[:, part]
            scored |= chosen
            if width > k:  # what is not scored yet counts with its rare terms: never too much
                best = np.partition(scores, width - k, axis=1)[:, width - k]
        scores = np.round(np.where(np.repeat(scored, self.block, axis=1), scores, 0.0), 12)
        k_ = min(k, width)
        least = np.partition(scores, width - k_, axis=1)[:, width - k_]
        cosines, places = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
        for row in range(n):
            at = np.flatnonzero((scores[row] >= least[row]) & (scores[row] > 0))
            at = at[np.argsort(-scores[row, at], kind="stable")][:k]
            cosines[row, : len(at)], places[row, : len(at)] = scores[row, at], at
        return cosines, places


def steps(sizes: np.ndarray):
    """Runs of entries of about STEP postings, or one entry."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield at, to
        at = to


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    offsets = lists.offsets.to_numpy()  # of a slice they begin where it does; flatten() is its own values
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(offsets))


def votes(index: BlockMaxIndex, of, terms, counts, n: int, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of n texts, and the cosines and places of their neighbours."""
    cosines, places = index.nearest(of, terms, counts, n)
    labels = index.labels[places] if index.n else np.zeros(places.shape)
    return ((cosines * labels).sum(axis=1) + PRIOR * base) / (cosines.sum(axis=1) + PRIOR), cosines, places


def scored(found: DataFrame, index, base: float, columns: list[str], name_kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = index.value
        for batch in (part for whole in batches for part in slices(whole, 512)):
            (terms, of), (counts, _) = flat(batch.column("terms")), flat(batch.column("counts"))
            scores, cosines, places = votes(own, of, terms, counts, batch.num_rows, base)
            there = cosines > 0
            at = pa.array(np.append(0, np.cumsum(there.sum(axis=1))), pa.int32())
            evidence = pa.ListArray.from_arrays(at, names.take(pa.array(own.order[places[there]] if own.n else places[there])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.clip(scores, 0, 1)), evidence], [*columns, "score", "evidence"])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in columns)
    return found.mapInArrow(tidied(run), f"{kinds}, score double, evidence array<{name_kind}>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (the ids
    of the nearest examples), digest (MD5 of the text)."""
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out())
    chosen = staged(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples), "toxic-chosen")
    few = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))  # at most ``examples`` narrow rows
    own = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("digest"), text_of(text_col).alias("text"))
    sample = own.join(few, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = staged(sample.withColumnRenamed("_id", "doc_id"), "toxic-sample")
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    base = seen.get(1, 0) / max(1, sum(seen.values()))

    # The vocabulary and the examples' words are bounded by ``examples`` texts.
    counts = term_counts(sample).orderBy("term").toArrow()
    terms = spark.sparkContext.broadcast(counts.column("term").to_pylist())
    found = staged(vectors(own, terms, ["doc_id", "digest"]), "toxic-vectors")
    seen_in = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.ones(len(counts))
    df[seen_in.column("term").to_numpy()] = seen_in.column("count").to_numpy()
    idf = np.log((1 + found.count()) / df) * (FLOOR + told(counts.column("in_toxic").to_numpy(), counts.column("in_other").to_numpy(), seen.get(1, 0), seen.get(0, 0)))
    rows = vectors(sample, terms, ["doc_id", "toxic"]).orderBy("doc_id").toArrow().combine_chunks()
    column = lambda c: rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)
    (words, of), (times, _) = flat(column("terms")), flat(column("counts"))
    index = BlockMaxIndex(of, words, times, column("toxic").to_numpy(), idf)
    out = scored(found, spark.sparkContext.broadcast((index, column("doc_id"))), base, ["doc_id", "digest"], sample.schema["doc_id"].dataType.simpleString())
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence", "digest")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns. A score is
    the text's, so a text goes wherever it stands, and another row of its id stays."""
    gone = staged(toxicity(docs, labels, id_col, text_col).where("predicted = 1").select(F.col("digest").alias("_gone")).distinct(), "toxic-gone")
    return join_checked(docs, gone, F.unhex(F.md5(text_of(text_col))) == gone["_gone"], "left_anti")
