"""Packing documents into token sequences by exact-complement hashing.

Documents become pieces of at most ``limit`` tokens; the plan is made over piece
*lengths*. At most ``limit`` distinct lengths exist, so their histogram is
bounded whatever the corpus, and one driver-side plan of a few thousand bin
patterns serves any number of documents:

* ``Complements`` indexes the lengths that are left by single, pair and triple
  sums, and yields a combination that fills a gap exactly under the counts left;
* a pattern (the largest length left plus its complement, with the largest
  fitting length put in while no complement exists) is used as often as the
  counts allow, which exhausts a length or leaves too few for the pattern;
* bins that no combination fills take the best-fitting lengths left.

Pieces are then numbered within their length (two levels of prefix sums, so a
length that holds a third of all pieces is spread over tasks) and find their
sequence and offset in the plan by binary search.

Rows: a null or empty text is the closing token alone. Repeated rows are packed
each. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import prefix_sums, staged, text_of, tidied

LIMIT = 4096
END_ID = 1
#: Chunks of text between white space whose ids a Python worker remembers.
MEMORY = 300_000


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


OTHER = re.compile("[^\x00-\xff]")
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,]?)")


class ChunkIds(dict):
    """The ids of a chunk of text, as little-endian bytes. The tokenizer lowers
    case and drops white space, and no token crosses white space, so a text is
    its chunks' ids in a row. A plain Latin word goes straight to the model, which
    takes a word's UTF-8 bytes as printable characters; all else goes through the
    whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.shown = str.maketrans({b: 256 + k for k, b in enumerate(others)})

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMORY:
                self.words.clear()
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
            found = self.words[word] = pack_ids([t.id for t in self.tokenizer.model.tokenize(shown)])
        return found

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        if len(chunk) <= 60 and (m := PLAIN.fullmatch(chunk)):
            ids = self.word(m[1]) + (self.word(m[2]) if m[2] else b"")
        else:
            ids = pack_ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 60:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not OTHER.search(text):
            text = text.lower()
        # Only blank, tab and line feed: what else counts as space is left to the tokenizer.
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """One memory for all tasks of a Python worker."""
    return ChunkIds(path)


def pieces_of(ids: bytes, limit: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    step = 4 * limit
    return [(k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step)) if (part := ids[at : at + step])]


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    end = pack_ids([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(tokenizer)
        for batch in batches:
            rows = [(k, *piece) for k, text in enumerate(batch.column(1)) for piece in pieces_of(chunks.of(text.as_py()) + end, limit)]
            at, *columns = zip(*rows) if rows else [()] * 5
            found = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return chosen.mapInArrow(tidied(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Complements:
    """The lengths that are left, indexed by the sums of one, two and three."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit = limit
        self.left = np.zeros(limit + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pair_index: dict[int, np.ndarray] = {}

    def largest(self, most: int) -> int:
        """The largest length left of at most so many tokens; 0 if none."""
        there = np.flatnonzero(self.left[: most + 1])
        return int(there[-1]) if len(there) else 0

    def pairs(self, total: int) -> np.ndarray:
        """The larger lengths of the pairs with this sum; built on first use and
        then only ever narrowed, as counts never grow."""
        found = self.pair_index.get(total)
        a = np.arange((total + 1) // 2, total) if found is None else found
        a = a[(self.left[a] > 0) & (self.left[total - a] > 0)]
        self.pair_index[total] = a
        return a

    def pair(self, total: int, used: list[int]) -> tuple[int, ...] | None:
        for a in self.pairs(total)[::-1]:
            if self.enough([*used, int(a), total - int(a)]):
                return int(a), total - int(a)
        return None

    def enough(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def exact(self, gap: int, used: list[int]) -> tuple[int, ...] | None:
        """One, two or three lengths left that sum to the gap, larger first."""
        if gap <= self.limit and self.left[gap] and self.enough([*used, gap]):
            return (gap,)
        if found := self.pair(gap, used):
            return found
        for a in np.flatnonzero(self.left[: gap - 1])[::-1]:
            a = int(a)
            if 3 * a < gap:
                break
            if self.enough([*used, a]) and (found := self.pair(gap - a, [*used, a])):
                return (a, *found)
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns and how often each is used; together they use each length as
    often as ``counts`` has it."""
    rest, out = Complements(counts, limit), []
    while first := rest.largest(limit):
        bin_, gap = [first], limit - first
        while gap:
            if found := rest.exact(gap, bin_):
                bin_ += found
                gap = 0
                break
            # The best fit that this bin has left; a length in use up to its count is skipped.
            most = gap
            while (fit := rest.largest(most)) and rest.left[fit] <= bin_.count(fit):
                most = fit - 1
            if not fit:
                break
            bin_.append(fit)
            gap -= fit
        times = min(int(rest.left[x]) // bin_.count(x) for x in set(bin_))
        for x in bin_:
            rest.left[x] -= times
        out.append((tuple(bin_), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), by length and rank:
    from its first rank on, a length's pieces go to successive sequences."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for bin_, times in patterns:
        at = 0
        for length in bin_:
            rows.append((length, rank.get(length, 0), base, at))
            rank[length] = rank.get(length, 0) + times
            at += length
        base += times
    found = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan(counts, limit)))
    turned = pieces.withColumn("turn", F.md5(F.concat_ws("-", "doc_id", "piece", "ids_crc32")))
    ranked = prefix_sums(turned.withColumn("one", F.lit(1).cast("long")), ["length"], ["turn", "doc_id", "piece", "start", "ids_crc32"], "one", "rank", sum(counts.values()))
    far = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows = table.value
        keys = plan_rows[:, 0] * far + plan_rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            row = plan_rows[np.searchsorted(keys, length * far + rank, side="right") - 1]
            own = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*own.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "rank").mapInArrow(tidied(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(token_pieces(docs, tokenizer, limit, end_id, id_col, text_col), "pack-pieces"), limit)
