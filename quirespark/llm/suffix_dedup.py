"""Suffix-array deduplication: every byte covered by a string of ``length`` bytes
that also starts earlier in the corpus is removed.

A suffix array of the whole corpus would carry tuples of ten times its bytes, so
the corpus is first cut into shards that lose no match:

1. Later copies of a whole text are settled by its digest: all their strings start
   earlier. (A text shorter than ``length`` loses nothing.)
2. In every window of ``length`` bytes the ``GRAM``-byte string with the least hash
   is its anchor. Equal windows have equal anchors, so only anchors whose hash
   occurs twice matter. The windows of one anchor form a segment of the text.
3. Equal segments are one, of its earliest place; later places are removed whole.
   Segments of one anchor hash that differ go to one shard, and each shard's suffix
   array, by external induced sorting with common-prefix lengths, tells the windows
   that also start earlier. An anchor hash with more than ``HOT`` different segments
   is cut further: each of its windows becomes a segment under its own hash.
4. A document's removed intervals are united; what is left is its text.

Texts move once for the segments and once for the cut, and only those that have a
repeated anchor or a removed byte.

Rows: a null text is empty. Rows of one id are one document to the order of starts:
the same place in two of them is not earlier. Null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import join_checked, staged, text_of, tidied
from quirespark.llm.induced_sort import pieces, sorted_suffixes
from quirespark.llm.shingles import mixed

LENGTH, GRAM = 100, 40
HOT = 20_000
#: Bytes of text gathered for one suffix array, and hashed at once.
SHARD, CHUNK = 1 << 20, 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes, by doubling."""
    at = {1: mixed(data.astype(np.uint64) + np.uint64(1))}
    width = 1
    while width * 2 <= gram:
        h = at[width]
        at[width * 2] = h[:-width] * power(width) + h[width:]
        width *= 2
    out, done = at[width], width
    while done < gram:
        more = 1 << ((gram - done).bit_length() - 1)
        out = out[: len(out) - more] * power(more) + at[more][done : done + len(out) - more]
        done += more
    return mixed(out)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts (with their ends): (text, anchor hash, first window) of
    each run of windows with one anchor; windows are counted from the text's start."""
    if len(data) < length:
        return (np.empty(0, dtype=np.int64),) * 3
    h = gram_hashes(data, gram)
    # The left-most least: 32 bits of hash, then the place.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (window_least(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    begins = np.concatenate(([0], ends[:-1]))
    inside = np.flatnonzero(start + length <= ends[text])
    a, t = anchor[inside], text[inside]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]))) if len(a) else np.empty(0, dtype=bool)
    return t[new], h[a[new]].view(np.int64), inside[new] - begins[t[new]]


def chunks(texts: list[bytes], length: int):
    """(first text, texts, and for each text its anchors' hashes and first windows), of
    about CHUNK bytes at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        of, hashes, firsts = anchors(np.frombuffer(b"".join(part), dtype=np.uint8), np.cumsum([len(t) for t in part]), length)
        yield at, part, np.searchsorted(of, np.arange(len(part) + 1)), hashes, firsts
        at = end


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, hashes: the anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part, offsets, hashes, _ in chunks(batch.column("data").to_pylist(), length):
                own = batch.slice(at, len(part))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("digest"), lists], ["doc_id", "digest", "hashes"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "digest", "data").mapInArrow(tidied(run), f"doc_id {kind}, digest binary, hashes array<long>")


def segments_of(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, h, first, last, segment: of the anchors whose numbers are in
    ``found``. A segment that its text holds already is null: all its windows start
    earlier there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(batch):
            take = pa.array([r[0] for r in out], pa.int64())
            columns = [pa.array([r[k] for r in out], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.binary()))]
            out.clear()
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("digest").take(take), *columns], ["doc_id", "digest", "h", "first", "last", "segment"])

        out: list[tuple] = []
        for batch in batches:
            numbers, size = batch.column("found").to_pylist(), 0
            for at, part, offsets, hashes, firsts in chunks(batch.column("data").to_pylist(), length):
                for k, data in enumerate(part):
                    ends, seen = [*(firsts[offsets[k] + 1 : offsets[k + 1]] - 1).tolist(), len(data) - length], set()
                    for n in sorted(numbers[at + k]):
                        first, last, h = int(firsts[offsets[k] + n]), ends[n], int(hashes[offsets[k] + n])
                        segment = data[first : last + length]
                        if segment in seen:
                            if out and out[-1][0] == at + k and out[-1][4] is None and out[-1][3] + 1 == first:
                                out[-1] = (*out[-1][:3], last, None)
                                continue
                            segment = None
                        else:
                            seen.add(segment)
                            size += len(segment)
                        out.append((at + k, h, first, last, segment))
                        if size >= CHUNK:
                            yield give(batch)
                            size = 0
            if out:
                yield give(batch)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "digest", "data", "found").mapInArrow(tidied(run), f"doc_id {kind}, digest binary, h long, first long, last long, segment binary")


def shard_spans(rows: list[tuple], length: int) -> Iterator[tuple]:
    """(doc_id, digest, first, last) runs of window starts that also start earlier,
    among the distinct segments (doc_id, digest, first, segment) of one shard."""
    data = b"\xff".join(r[3] for r in rows)  # a byte that UTF-8 never has
    lengths = np.array([len(r[3]) for r in rows])
    begins = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    order = sorted({r[0] for r in rows}, key=lambda d: (d is None, d))
    rank = {d: k for k, d in enumerate(order)}
    doc, first = np.array([rank[r[0]] for r in rows]), np.array([r[2] for r in rows])
    # Suffixes that share the window's length are neighbours: a group. Its least place stays.
    with sorted_suffixes(data, length) as found:
        least = np.empty(int(sum((found[part, 1] < length).sum() for part in pieces(len(found)))), dtype=np.int64)
        least[:] = np.iinfo(np.int64).max
        late = np.zeros(len(data), dtype=bool)

        def grouped():
            done = -1
            for part in pieces(len(found)):
                at, new = found[part, 0].astype(np.int64), found[part, 1] < length
                group, done = done + np.cumsum(new), done + int(new.sum())
                segment = np.searchsorted(begins, at, side="right") - 1
                offset = at - begins[segment]
                whole = offset + length <= lengths[segment]
                yield at[whole], group[whole], (doc[segment[whole]] << 40) + first[segment[whole]] + offset[whole]

        for _, group, place in grouped():
            np.minimum.at(least, group, place)
        for at, group, place in grouped():
            late[at[place > least[group]]] = True
    for k, (doc_id, digest, at, segment) in enumerate(rows):
        own = np.flatnonzero(np.diff(late[begins[k] : begins[k] + len(segment)], prepend=False, append=False))
        yield from ((doc_id, digest, at + a, at + b - 1) for a, b in own.reshape(-1, 2).tolist())


def sharded_spans(firsts: DataFrame, length: int) -> DataFrame:
    """Shards are runs of whole anchor hashes, of about SHARD bytes or one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows):
            columns = list(zip(*shard_spans(rows, length))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (ids, pa.binary(), pa.int64(), pa.int64()))], ["doc_id", "digest", "first", "last"])

        held, size, hash_, ids = [], 0, None, None
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "digest", "first", "segment"))):
                if h != hash_ and size >= SHARD:
                    yield give(held)
                    held, size = [], 0
                hash_ = h
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield give(held)

    kind = dict(firsts.dtypes)["doc_id"]
    return firsts.select("h", "doc_id", "digest", "first", "segment").mapInArrow(tidied(run), f"doc_id {kind}, digest binary, first long, last long")


def windows_of(firsts: DataFrame, length: int) -> DataFrame:
    """Each window of a hot anchor's segment as a segment under its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, window = [], [], []
            for k, (f, s) in enumerate(zip(batch.column("first").to_pylist(), batch.column("segment").to_pylist())):
                for o in range(len(s) - length + 1):
                    at.append(k)
                    first.append(f + o)
                    window.append(s[o : o + length])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("digest").take(take), pa.array(first, pa.int64()), pa.array(window, pa.binary())], ["doc_id", "digest", "first", "segment"])

    kind = dict(firsts.dtypes)["doc_id"]
    out = firsts.select("doc_id", "digest", "first", "segment").mapInArrow(tidied(run), f"doc_id {kind}, digest binary, first long, segment binary")
    return out.withColumn("h", F.xxhash64("segment"))


def earliest(segments: DataFrame) -> DataFrame:
    """Equal segments as one, at its earliest place: h, segment, doc_id, digest, first."""
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "first", "digest")).alias("at")
    return segments.groupBy("h", "segment").agg(place).select("h", "segment", "at.doc_id", "at.digest", "at.first")


def later(segments: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, first, last: the windows of all places but the earliest. Rows of
    one id are one document, so the earliest place is one whatever the row."""
    own = firsts.select(F.col("doc_id").alias("_id"), F.col("first").alias("_first"), F.col("h").alias("_h")).distinct()
    spans = segments.select("doc_id", "digest", "first", (F.col("first") + F.octet_length("segment") - length).alias("last"), "h")
    on = spans["doc_id"].eqNullSafe(own["_id"]) & (spans["first"] == own["_first"]) & (spans["h"] == own["_h"])
    return spans.join(own.hint("merge"), on, "left_anti").drop("h")


def removed_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, spans (first and last window starts) of the staged docs
    (doc_id, digest, data) that are the first of their text."""
    # Only narrow rows are exchanged: a staged row's number, an anchor's, and its hash.
    marks = staged(anchored(docs, length).withColumn("row", F.monotonically_increasing_id()), "suffix-anchors")
    flat = marks.select("row", F.posexplode("hashes").alias("k", "h"))
    repeated = staged(flat.groupBy("h").count().where("count > 1").select("h"), "suffix-repeated")
    found = flat.join(repeated.hint("merge"), "h").groupBy("row").agg(F.collect_list("k").alias("found"))
    found = staged(found.join(marks.select("row", "doc_id", "digest").hint("merge"), "row").drop("row"), "suffix-found")
    texts = with_marks(docs, found, "found")
    cut = staged(segments_of(texts, length), "suffix-segments")
    segments = cut.where("segment IS NOT NULL").drop("last")
    again = cut.where("segment IS NULL").select("doc_id", "digest", "first", "last")
    firsts = staged(earliest(segments), "suffix-firsts")
    counts = staged(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-counts")
    several = firsts.join(counts.hint("merge"), "h")
    windows = staged(windows_of(several.where(F.col("n") > HOT), length), "suffix-windows")
    window_firsts = staged(earliest(windows), "suffix-window-firsts")
    # Windows of one hash that differ (a collision) are sorted like other segments.
    collided = window_firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    sorted_ = several.where(F.col("n") <= HOT).select(*firsts.columns).unionByName(window_firsts.join(collided, "h").select(*firsts.columns))
    sorted_ = staged(sorted_, "suffix-sorted").repartition("h").sortWithinPartitions("h")
    spans = later(segments, firsts, length).unionByName(later(windows, window_firsts, length)).unionByName(sharded_spans(sorted_, length)).unionByName(again)
    return spans.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def with_marks(docs: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """The staged documents that have a row in marks, with its column. Documents
    without one are dropped before their texts are moved, if the ids are few."""
    own = marks.withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_digest")
    ids = own.select(F.col("_id").alias("_few"), F.col("_digest").alias("_few_digest"))
    few = join_checked(docs, ids, docs["doc_id"].eqNullSafe(ids["_few"]) & (docs["digest"] == ids["_few_digest"]), "left_semi")
    return few.join(own.hint("merge"), few["doc_id"].eqNullSafe(own["_id"]) & (few["digest"] == own["_digest"])).select("doc_id", "digest", "data", column)


def cut_texts(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, n_removed, n_spans, kept: the bytes left of data without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                runs: list[list[int]] = []
                for s in spans:  # by first start; runs that touch are one
                    if runs and s["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["last"] + length)
                    else:
                        runs.append([s["first"], s["last"] + length])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                out.append((sum(b - a for a, b in runs), len(runs), b"".join(parts)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["doc_id", "digest", "n_removed", "n_spans", "kept"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(tidied(run), f"doc_id {kind}, digest binary, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (null: the whole
    text is kept), kept_sha256."""
    data = F.encode(text_of(text_col), "UTF-8")
    own = docs.select(F.col(id_col).alias("doc_id"), data.alias("data")).withColumn("sha", F.sha2("data", 256))
    own = own.withColumn("digest", F.unhex(F.substring("sha", 1, 32)))
    light = staged(own.select("doc_id", "digest", "sha", F.octet_length("data").cast("long").alias("n_bytes")), "suffix-light")
    again = light.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = staged(again.select(F.col("digest").alias("_digest"), "_first"), "suffix-again")

    def is_later(df):
        both = join_checked(df, again, df["digest"] == again["_digest"], "left")
        return both.withColumn("later", F.col("_digest").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("_first"))).drop("_digest", "_first")

    rows = is_later(light)
    first = is_later(own).where(~F.col("later") & (F.octet_length("data") >= length)).select("doc_id", "digest", "data")
    spans = staged(removed_spans(first, length), "suffix-spans")
    cut = cut_texts(with_marks(first, spans, "spans"), length).withColumn("kept_sha256", F.sha2("kept", 256)).dropDuplicates(["doc_id", "digest"])
    cut = staged(cut, "suffix-cut").withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_cut")
    out = rows.join(cut.hint("merge"), rows["doc_id"].eqNullSafe(cut["_id"]) & (rows["digest"] == cut["_cut"]) & ~rows["later"], "left")
    zero, nothing = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    pick = lambda late, column, other: F.when(F.col("later"), late).otherwise(F.coalesce(column, other))
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", zero).alias("n_removed"), pick(F.lit(1).cast("long"), "n_spans", zero).alias("n_spans"),
        F.when(F.col("later"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"), pick(nothing, "kept_sha256", F.col("sha")).alias("kept_sha256"),
    )
