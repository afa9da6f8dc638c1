"""MinHash near-deduplication with sequential Bayesian verification.

1. Every whole text becomes a set of hashed five-word shingles; equal sets are one
   node (its 128-bit digest). ``BANDS`` x ``ROWS`` MinHash values make band keys:
   at similarity 0.75 a pair shares none with probability (1 - .75**4)**32, 5e-6.
2. In each bucket all nodes are paired with the least one: linear, however large
   the bucket. Pairs are compared by batches of signature values and dropped when
   the posterior probability of a similarity of at least the threshold falls under
   ``MISS``; the rest are verified on the full sets. Links make components.
3. A bucket whose nodes lie in more than one component still holds untried pairs:
   nodes outside its largest component against all its nodes. Both sides are cut into
   blocks of bounded size, and each two blocks meet in a group of their own, as
   matrices; only survivors are emitted and verified.
4. Components of all links; a document's class is the least id in its component.

Rows: a null or empty text has no shingles and is linked with nothing; equal sets
are linked. Each row is a document of its own, also with a null or repeated id: its
component is that of its set. ``drop_near_copies`` leaves one row of each component,
so a text of its own stays whatever other rows of its id hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import is_small, join_checked, slices, staged, text_of, tidied
from quirespark.llm.components import components
from quirespark.llm.shingles import Signer, shingle_set, word_hashes

BANDS, ROWS = 32, 4
#: Signature values of a byte each compared in verification, by batches of so many.
VALUES, BATCH = 1024, 128
MISS = 1e-4
#: Similarity from which documents are linked, in per cent.
THRESHOLD = 75
#: Nodes of one side of a group in which two blocks of a bucket are compared.
BLOCK = 512


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def least_matches(threshold: int = THRESHOLD, miss: float = MISS, values: int = VALUES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(values compared, least matches that go on): below, P(similarity >= threshold)
    given the matches, from a uniform prior, is under ``miss``. That posterior is
    Beta(m + 1, n - m + 1), whose upper tail is the binomial P(X <= m), X of n + 1.
    Bytes of different values match by chance once in 256."""
    t, out = threshold / 100, []
    t += (1 - t) / 256
    for n in range(batch, values + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of the signature matrices a and b survive all batches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for n, least in bounds:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def similar(a: bytes, b: bytes, threshold: int = THRESHOLD) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(both) - shared)


def sets_and_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, n_shingles, node (null without shingles), keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = word_hashes(), Signer(BANDS, ROWS)
        for batch in (part for whole in batches for part in slices(whole, 500)):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signer.keys(signer.sign(s)).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "n_shingles", "node", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("digest"), text_of(text_col).alias("text"))
    return chosen.mapInArrow(tidied(run), f"doc_id {kind}, digest binary, n_shingles long, node binary, keys array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, signature, keys, shingles of the documents that represent the nodes (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer, bander = word_hashes(), Signer(1, VALUES, seed=11), Signer(BANDS, ROWS)
        for batch in (part for whole in batches for part in slices(whole, 500)):
            out: tuple[list, ...] = ([], [], [], [])
            for node, text in zip(batch.column(0), batch.column(1)):
                found = shingle_set(text.as_py(), words)
                if digest(found) == node.as_py():  # else another row with this id
                    for to, x in zip(out, (node.as_py(), signer.sign(found).astype(np.uint8).tobytes(), bander.keys(bander.sign(found)).tobytes(), found.tobytes())):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["node", "signature", "keys", "shingles"])

    chosen = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    ids = nodes.select(F.col("node"), F.col("doc_id").alias("_rep"))
    both = join_checked(chosen, ids, chosen["_id"].eqNullSafe(ids["_rep"]), "inner")
    return both.select("node", "_text").mapInArrow(tidied(run), "node binary, signature binary, keys binary, shingles binary")


def attach(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Adds the column of both nodes of each pair, as ``a_`` and ``b_``."""
    for side in "ab":
        own = table.select(F.col("node").alias(side), F.col(column).alias(f"{side}_{column}"))
        pairs = pairs.join(own.hint("merge"), side)
    return pairs


def matrix(column: pa.Array, values: int = VALUES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), values)


def survivors(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    bounds = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = surviving(matrix(batch.column("a_signature")), matrix(batch.column("b_signature")), bounds)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return attach(pairs, sets, "signature").mapInArrow(tidied(run), "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column("a_shingles"), batch.column("b_shingles"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return attach(pairs, sets, "shingles").mapInArrow(tidied(run), "a binary, b binary")


def star_pairs(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each node of a bucket with the bucket's least node."""
    both = members.join(buckets.hint("merge"), "key").where("node != least")
    return both.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def untried_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components in a bucket that survive comparison; ``members``
    (key, node) holds the buckets of two nodes and more."""
    root = roots.withColumnRenamed("node", "_node")
    known = members.join(root.hint("merge"), members["node"] == root["_node"], "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    known = staged(known, "near-known")
    sizes = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = main.where("parts > 1 AND n > 2").select(F.col("key").alias("_key"), F.col("most.root").alias("main"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most.n")).alias("ask_blocks"))
    mixed = staged(mixed, "near-mixed")
    here = known.join(mixed.hint("merge"), known["key"] == mixed["_key"])
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    all_ = here.select("key", "node", "root", block("blocks").alias("block"), every("ask_blocks").alias("ask_block"), F.lit(False).alias("asks"))
    asks = here.where("root != main").select("key", "node", "root", every("blocks").alias("block"), block("ask_blocks").alias("ask_block"), F.lit(True).alias("asks"))
    own = sets.select("node", "signature", "keys")
    group = ["key", "block", "ask_block"]
    dealt = staged(all_.unionByName(asks).join(own.hint("merge"), "node"), "near-blocks").repartition(*group).sortWithinPartitions(*group)
    bounds = least_matches()

    def compare(group: list) -> list[tuple[bytes, bytes]]:
        x, y = [r for r in group if r[4]], [r for r in group if not r[4]]
        if not x or not y:
            return []
        sx, sy = (np.frombuffer(b"".join(r[5] for r in part), dtype=np.uint8).reshape(-1, VALUES) for part in (x, y))
        kx, ky = (np.frombuffer(b"".join(r[6] for r in part), dtype=np.int64).reshape(-1, BANDS) for part in (x, y))
        names = {r: k for k, r in enumerate({r[2] for r in group})}
        rx, ry = (np.array([names[r[2]] for r in part]) for part in (x, y))
        out = []
        for k in range(len(x)):
            # Of the buckets that a pair shares, the first band's has it; all of them compare it,
            # as of two components at most one is the largest.
            band = int(np.flatnonzero(kx[k] == group[0][0])[0])
            at = np.flatnonzero((ry != rx[k]) & ~(ky[:, :band] == kx[k, :band]).any(axis=1))
            alive = surviving(np.broadcast_to(sx[k], (len(at), VALUES)), sy[at], bounds)
            out += [(min(x[k][1], y[j][1]), max(x[k][1], y[j][1])) for j in at[alive]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: (r[0], r[3], r[7])):
            if found := compare(list(group)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*set(found))], ["a", "b"])

    return dealt.select("key", "node", "root", "block", "asks", "signature", "keys", "ask_block").mapInArrow(tidied(run), "a binary, b binary").distinct()


def row_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those columns, digest (MD5 of the text), and root of the component (null without
    shingles): two may have one least id, where rows share it."""
    signed = staged(sets_and_keys(docs, id_col, text_col), "near-signed")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # Band keys do not depend on the document, only on the set: copies collapse on the map side.
    banded = signed.where("node IS NOT NULL").select("node", F.explode("keys").alias("key"))
    buckets = staged(banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("greatest")).where("least != greatest").select("key", "least"), "near-buckets")
    members = staged(join_checked(banded, buckets.select("key"), "key", "left_semi").distinct(), "near-members")
    tried = members.select("node").distinct()
    reps = staged(nodes.join(tried.hint("merge"), "node", "left_semi"), "near-reps")
    sets = staged(full_sets(docs, reps, id_col, text_col), "near-sets")

    pairs = staged(star_pairs(members, buckets), "near-pairs")
    links = staged(verified(staged(survivors(pairs, sets), "near-alive"), sets), "near-links")
    roots = staged(components(links), "near-roots")
    more = staged(untried_pairs(members, roots, sets), "near-untried").join(pairs.hint("merge"), ["a", "b"], "left_anti")
    more = staged(verified(more, sets), "near-more")
    roots = staged(components(links.unionByName(more)), "near-all-roots")

    own = nodes.join(roots.hint("merge"), "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    own = staged(own, "near-own")
    first = staged(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-first")
    classes = staged(own.join(first.hint("merge"), "root").select(F.col("node").alias("_node"), "component_id", "root"), "near-classes")
    out = signed.join(classes.hint("merge"), F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "digest", "root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return row_groups(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component the row with the
    least id, of these the one with the least MD5 of its text."""
    groups = staged(row_groups(docs, id_col, text_col).where("root IS NOT NULL").select("doc_id", "root", "digest", "kept"), "near-rows")
    first = groups.where("kept").groupBy("root").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n"))
    first = staged(first.where("n > 1"), "near-several")  # components with more than one row of their least id
    several = groups.where("kept").join(first.select("root", "least").hint("merge"), "root")
    gone = groups.where("NOT kept").select("doc_id", "digest").unionByName(several.where("digest != least").select("doc_id", "digest"))
    gone = staged(gone.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")).distinct(), "near-gone")
    digest = F.unhex(F.md5(text_of(text_col)))
    out = join_checked(docs, gone, docs[id_col].eqNullSafe(gone["_gone"]) & (digest == gone["_digest"]), "left_anti")
    same = staged(groups.where("kept").groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("_same"), F.col("digest").alias("_digest")), "near-same")
    if is_small(same, 0):
        return out
    on = out[id_col].eqNullSafe(same["_same"]) & (digest == same["_digest"])  # rows repeated with id and text: one of each
    return join_checked(out, same, on, "left_anti").unionByName(join_checked(out, same, on, "left_semi").withColumn("_text_md5", digest).dropDuplicates([id_col, "_text_md5"]).drop("_text_md5"))
