"""Quality rules as a bitmask ledger.

1. One pass over the texts takes every measurement, and every rule is evaluated once
   on them: the *ledger* holds a row per document with the measurements and ``bits``,
   the failures (bit k is rule k of ``RULES``).
2. A *policy* is a version of which rules count: a mask. Applying one, or another
   version, to a stored ledger is ``bits & mask = 0``; no text is read again.
3. *Ablations* are aggregates of bits: the ledger is counted by ``bits`` (at most
   2 ** rules rows, combined before the exchange), and each policy is read off it:
   what each rule fails, what it alone fails, what stays without it.

Measurements. Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. ``word_chars`` are
code points in words, ``n_symbols`` characters of ``[#*$%&|<>]``, ``n_lines`` lines
with a word, ``n_dup_lines`` those equal to an earlier one, ``n_repeat_words`` words
that lie in an 8-word window found twice or more in the text, the first included,
``n_letter_words`` words with a letter, ``n_stutters`` words equal to the word before.
Windows are compared by exact numbers, not by hashes: a window of 8 is a pair of
windows of 4, and so on down to words, each numbered by one sort of a batch. A batch
holds ``BATCH_CHARS`` of text or a single document.

Rows: a null text has no words and fails ``few_words``, as an empty one does. Each row
is judged by itself, so null ids, repeated rows and ties need no rule; an empty table
gives an empty ledger. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import join_checked, sized, staged, text_of, tidied

WINDOW = 8
BATCH_CHARS = 4 << 20
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_stutters")


class Rule(NamedTuple):
    """What fails a document, over the measurements."""

    name: str
    fails: str


#: A rule's place is its bit and never changes; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeat_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("dup_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "10 * word_chars < 25 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("letterless", "100 * n_letter_words < 70 * n_words"),
    Rule("stutter", "100 * n_stutters > 30 * n_words"),
)

#: Versions of the policy: the rules that count. ``base`` is what all versions hold.
POLICIES = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "dup_lines"),
    "v2": tuple(rule.name for rule in RULES),
}
POLICY = "v2"


def mask_of(policy: str) -> int:
    return reduce(or_, (1 << k for k, rule in enumerate(RULES) if rule.name in POLICIES[policy]), 0)


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a version of the policy."""
    return F.col("bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def class_table(*members: bytes) -> np.ndarray:
    """Of each byte a bit for every class that holds it."""
    out = np.zeros(256, dtype=np.uint8)
    for k, chars in enumerate(members):
        out[list(chars)] |= 1 << k
    return out


LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CLASSES = class_table(BLANKS, SYMBOLS, bytes(range(0x80, 0xC0)), LETTERS)


def numbered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers, from 0."""
    return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Of each word whether it is in a window found twice or more in its document.
    ``words`` are numbers, ``doc`` (rising) the documents' numbers."""
    covered = np.zeros(len(words), dtype=bool)
    if len(words) < width:
        return covered
    ids, have = words.astype(np.int64), 1
    while have < width:  # windows of `have` words to those of twice as many, or of all
        step = min(have, width - have)
        ids, have = numbered(ids[: len(ids) - step], ids[step:]), have + step
    inside = doc[: len(ids)] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    own = numbered(doc[at].astype(np.int64), ids[at])
    twice = at[np.bincount(own)[own] > 1] if len(at) else at
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of some texts."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets, kinds = offsets - offsets[0], CLASSES[whole]

    def sums(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return upto[offsets[1:]] - upto[offsets[:-1]]

    blank = (kinds & 1) > 0
    first = np.zeros(len(whole) + 1, dtype=bool)  # a text's first byte starts a word, too
    first[offsets[:-1]] = True
    starts = np.flatnonzero(~blank & (first[:-1] | np.concatenate(([True], blank[:-1]))))
    last = np.zeros(len(whole) + 1, dtype=bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(~blank & (last[1:] | np.concatenate((blank[1:], [True])))) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    edges = np.append(np.column_stack((starts, ends)).ravel(), len(whole)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(whole)])  # words, and between them gaps
    codes = np.asarray(pieces.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode().indices)
    letters = np.concatenate(([0], np.cumsum((kinds & 8) > 0, dtype=np.int64)))
    by_doc = lambda flags: np.bincount(doc, weights=flags, minlength=len(texts)).astype(np.int64)
    lines = [[line for line in text.split(b"\n") if line.strip()] for text in texts.to_pylist()]
    n_lines = np.array([len(x) for x in lines], dtype=np.int64)
    return {
        "n_words": np.bincount(doc, minlength=len(texts)).astype(np.int64),
        "word_chars": sums((kinds & 5) == 0),
        "n_symbols": sums((kinds & 2) > 0),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.array([len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": by_doc(repeated_words(codes, doc)),
        "n_letter_words": by_doc(letters[ends] > letters[starts]),
        "n_stutters": by_doc(np.concatenate(([False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])))[: len(doc)]),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements, bits."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text", BATCH_CHARS):
                found = measured(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidied(run), schema)
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES)))
    return rows.withColumn("bits", bits)


def verdicts(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with base_failed, and kept under a version of the policy."""
    return book.withColumn("base_failed", ~passes("base")).withColumn("kept", passes(policy))


def keep_good(docs: DataFrame, policy: str = POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; texts are judged, so rows of one
    id with different texts go or stay each by its own."""
    failed = ledger(docs.select(F.xxhash64(id_col, text_of(text_col)).alias("_key"), F.col(text_col)), "_key", text_col).where(~passes(policy))
    failed = staged(failed.select(F.col("doc_id").alias("_key")).distinct(), "quality-failed")
    keyed = docs.withColumn("_own_key", F.xxhash64(id_col, text_of(text_col)))
    return join_checked(keyed, failed, keyed["_own_key"] == failed["_key"], "left_anti").drop("_own_key")


def ablations(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """policy, rule, n_failed (by the rule), n_only (by it alone of the policy's),
    n_kept (under the policy), n_kept_without (the rule); a row for each rule that
    counts. Every figure is a sum over the ledger's distinct bits."""
    patterns = book.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    asked = [(p, rule.name, 1 << k, mask_of(p)) for p in policies for k, rule in enumerate(RULES) if rule.name in POLICIES[p]]
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask")) for p, r, b, m in asked)))
    each = patterns.select("bits", "n", rows.alias("a")).select("n", "a.*", F.col("bits").bitwiseAND(F.col("a.mask")).alias("own"))
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule").agg(
        count(F.col("own").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("own") == F.col("bit"))("n_only"),
        count(F.col("own") == 0)("n_kept"),
        count(F.col("own").bitwiseAND(F.bitwise_not("bit")) == 0)("n_kept_without"),
    )
