"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes: h = 2 * h + gear[byte], so 64 bytes decide
it; it is computed for all positions at once by doubling the window. Boundaries
follow normalised chunking: no cut before ``LEAST`` bytes, a hard mask up to
``NORMAL``, an easy one beyond, and a cut at ``MOST``. Cuts depend on nearby
content only, so an insertion shifts chunks without changing the later ones.

The fingerprint is the set of (chunk digest, chunk length). Likeness of one to
another is containment by length: the bytes of the distinct chunks that both hold,
divided by the bytes of the first's distinct chunks. Equal fingerprints are 1, also
of empty texts; an empty one and another are 0.

Rows: a null text counts as empty. Null ids come last; rows repeated with an id are
ordered by a hash of their text, the largest first. A single document is its own next
one. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import staged, text_of, tidied

LEAST, NORMAL, MOST = 24, 96, 512
HARD, EASY = np.uint64(0xFF << 56), np.uint64(0x1F << 59)
GEAR = np.random.default_rng(64).integers(0, 2**64, 256, dtype=np.uint64)
#: Documents of a part, and the most parts there are; beyond, parts grow.
ROWS, PARTS = 4000, 100_000


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte, of the 64 bytes up to it."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16, 32):
        if width >= len(h):
            break
        older = h[:-width] << np.uint64(width)
        h = h.copy()
        h[width:] += older
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks."""
    if len(data) <= LEAST:
        return [len(data)] if data else []
    h = gear_hashes(data)
    easy = np.flatnonzero((h & EASY) == 0) + 1
    hard = easy[(h[easy - 1] & HARD) == 0]
    easy, hard, out, at = easy.tolist(), hard.tolist(), [], 0
    i = j = 0
    while len(data) - at > LEAST:
        while i < len(hard) and hard[i] <= at + LEAST:
            i += 1
        if i < len(hard) and hard[i] <= at + NORMAL:
            at = hard[i]
        else:
            while j < len(easy) and easy[j] <= at + NORMAL:
                j += 1
            end = min(at + MOST, len(data))
            at = easy[j] if j < len(easy) and easy[j] < end else end
        out.append(at)
    if at < len(data):
        out.append(len(data))
    return out


def fingerprint(text: str) -> dict[str, int]:
    """Chunk digest to chunk length."""
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in cuts(data):
        chunk = data[at:end]
        out[xxhash.xxh3_64_hexdigest(chunk)] = len(chunk)
        at = end
    return out


def written(chunks: dict[str, int]) -> str:
    return " ".join(f"{d}:{n}" for d, n in sorted(chunks.items()))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    whole = sum(a.values())
    if not whole:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / whole


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """part, ghost, doc_id, text: the documents by descending id in range parts, and
    in each part, last, a ghost of the document that follows it.

    Spark's range partitioner cuts the narrow keys (id, and a hash of the text that
    splits an id with many rows); a part's least and greatest key are all that the
    driver sees, at most ``PARTS`` of each, however many the documents."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    there = F.col("doc_id").isNotNull().alias("there")
    keys = staged(docs.select(there, "doc_id", "h"), "print-keys")
    parts = min(PARTS, max(1, keys.count() // ROWS))
    key = F.struct("there", "doc_id", "h")
    cut = keys.repartitionByRange(parts, "there", "doc_id", "h").groupBy(F.spark_partition_id()).agg(F.min(key).alias("least"), F.max(key).alias("most"))
    found = sorted(((r["least"], r["most"]) for r in cut.collect()), key=lambda e: place_of(*e[0]))
    bounds = [place_of(*least) for least, _ in found[1:]]
    n = max(1, len(found))

    @F.pandas_udf("int")
    def part_of(there: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([n - 1 - bisect_right(bounds, place_of(*key)) for key in zip(there, ids, hashes)], dtype="int32")

    whole = F.coalesce("doc_id", F.lit("0").cast(docs.schema["doc_id"].dataType))  # a null would make the ids floats
    # Part 0 holds the largest keys. A part is followed by the next one's greatest key, the last by the first's.
    most = {n - 1 - k: m for k, (_, m) in enumerate(found)}
    heads = [((p - 1) % n, m["doc_id"], m["h"]) for p, m in most.items()]
    heads = F.broadcast(docs.sparkSession.createDataFrame(heads, f"_part int, _id {docs.schema['doc_id'].dataType.simpleString()}, _h long"))
    ghosts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).groupBy("_part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    ghosts = ghosts.select(F.col("_part").alias("part"), F.lit(True).alias("ghost"), "doc_id", "text", F.lit(0).cast("long").alias("h"))
    own = docs.select(part_of(F.col("doc_id").isNotNull(), whole, "h").alias("part"), F.lit(False).alias("ghost"), "doc_id", "text", "h")
    order = ("part", "ghost", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return own.unionByName(ghosts).repartitionById(n, F.col("part")).sortWithinPartitions(*order).drop("h")


def place_of(there: bool, doc_id, h: int) -> tuple:
    """Order of keys: null ids first, as Spark's ascending order has them."""
    return (there, doc_id if there else 0, h)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, ids = None, None  # the row before, and the type of ids
        out: list[tuple] = []

        def give():
            columns = list(zip(*out)) or [()] * 7
            found = [pa.array(columns[0], ids), *(pa.array(c, t) for c, t in zip(columns[1:], types))]
            out.clear()
            return pa.RecordBatch.from_arrays(found, names)

        def compare(one, two) -> None:
            _, doc_id, text, chunks = one
            changed = edited(text, two[2])
            new = fingerprint(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), digest, written(chunks), written(new), likeness(chunks, new), likeness(chunks, two[3])))

        for batch in batches:
            ids = batch.schema.field("doc_id").type
            for part, ghost, doc_id, text in zip(*(batch.column(k) for k in range(4))):
                text = text.as_py()
                row = (part.as_py(), doc_id.as_py(), text, fingerprint(text))
                if held and held[0] == row[0]:
                    compare(held, row)
                held = None if ghost.as_py() else row
            if out:
                yield give()

    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs, id_col, text_col).mapInArrow(tidied(run), schema)
