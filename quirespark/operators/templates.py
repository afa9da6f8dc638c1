"""Placeholders of office templates, in text that editors have cut into spans.

A paragraph's text is that of its spans (doc_id, para, seq, text; null: a break, a picture,
a field) one after the other. ``{{key}}`` is found in the paragraph, wherever the spans
end; the span where it begins gets the value, and the rest is cut out of those that held
it. Spans without a match pass through untouched. Documents are dealt once, or come dealt, and
are filled over batches of whole documents: a span never leaves its task."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quirespark.operators.layout import whole_pages

#: What stands in the paragraph for something that is no text; no key contains it.
MARK = "\x00"
PAIR, PLACE = re.compile(r"\{\{[^{}\n]*\}\}"), re.compile(r"\{\{[ \t\r\n\x0B\f]*(=?)([A-Za-z0-9_.-]+)[ \t\r\n\x0B\f]*\}\}")
NAMES = ["doc_id", "para", "seq", "text", "key", "value"]


class Filling:
    """A document's filling: how many pairs of braces it has (``places``), and what refuses it."""

    def __init__(self, values: dict[str, str | None]):
        self.values, self.places, self.malformed, self.missing = values, 0, False, set()

    def paragraph(self, texts: list[str | None]) -> list[str | None]:
        """The spans' texts with what each placeholder stands for; of no use once the document is refused."""
        whole = "".join([MARK if t is None else t for t in texts])
        found = [*PAIR.finditer(whole)]
        if not found:
            return texts
        self.places += len(found)
        starts, out = [0, *accumulate(1 if t is None else len(t) for t in texts)], list(texts)
        # From the last on, so that the places before stay.
        for m in reversed(found):
            place = PLACE.fullmatch(m[0])
            if not place:
                self.malformed = True
                continue
            literal, key = place.groups()
            put = "{{" + key + "}}" if literal else self.values.get(key)
            if put is None:
                self.missing.add(key)
                continue
            if self.malformed:
                continue
            start, end = m.span()
            first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            rest = out[last][end - starts[last] :]
            if first == last:
                out[first] = out[first][: start - starts[first]] + put + rest
            else:
                out[first] = out[first][: start - starts[first]] + put
                out[first + 1 : last] = [""] * (last - first - 1)
                out[last] = rest
        return out

    def refusal(self) -> str | None:
        return "malformed" if self.malformed else "missing: " + ", ".join(sorted(self.missing)) if self.missing else None


def documents_of(batches):
    """Of each batch of whole documents its spans in order (a table), and of each document the slice there, its
    filling and the paragraphs as (from, to, texts)."""
    for rows, number in whole_pages(batches, ("doc_id",)):
        given = np.asarray(rows.column("key").is_valid())
        values: dict[int, dict] = {}
        held = rows.select(["key", "value"]).take(pa.array(np.flatnonzero(given)))
        for n, key, value in zip(number[given].tolist(), held.column("key").to_pylist(), held.column("value").to_pylist()):
            values.setdefault(n, {})[key] = value
        own = np.flatnonzero(~given)
        para, seq = (np.asarray(rows.column(c).take(pa.array(own))) for c in ("para", "seq"))
        own = own[np.lexsort((seq, para, number[own]))]
        spans, doc = rows.take(pa.array(own)), number[own]
        para, texts, found = np.asarray(spans.column("para")), spans.column("text").to_pylist(), []
        fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (para[1:] != para[:-1])])[: len(own)])
        last = None
        for a, b, n in zip(fresh.tolist(), [*fresh[1:].tolist(), len(own)], doc[fresh].tolist()):
            if n != last:
                found.append([a, b, Filling(values.get(n, {})), []])
                last = n
            found[-1][1] = b
            found[-1][3].append((a, b, found[-1][2].paragraph(texts[a:b])))
        yield spans, found


def in_order(spans: DataFrame, values: DataFrame) -> DataFrame:
    """Spans and values (doc_id, key, value) in one table, document by document: a value has a ``key``, a span none."""
    both = spans.select("doc_id", "para", "seq", "text").unionByName(values.where("key IS NOT NULL").select("doc_id", "key", "value"), allowMissingColumns=True)
    return both.repartition("doc_id").sortWithinPartitions("doc_id")


def filled(spans: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The spans of documents that could be filled, and each document's outcome.

    ``values`` are (doc_id, key, value). One pair of braces that is no placeholder
    (``malformed``) or one key without a value (``missing``, with the keys) refuses the
    document; a refusal never holds a value. ``{{=key}}`` stays as the literal ``{{key}}``.
    Without ``values`` the rows of ``spans`` are both, as of ``in_order``."""
    rows = spans.select(NAMES) if values is None else in_order(spans, values)
    doc, para, seq, text = (rows.schema[c] for c in NAMES[:4])

    def texts(batches):
        for own, found in documents_of(batches):
            kept = [d for d in found if d[2].refusal() is None]
            if kept:
                at = np.concatenate([np.arange(a, b) for a, b, *_ in kept])
                whole = own.select(["doc_id", "para", "seq"]).take(pa.array(at))
                yield from whole.append_column("text", pa.array([t for d in kept for p in d[3] for t in p[2]], pa.string())).to_batches()

    def outcomes(batches):
        for own, found in documents_of(batches):
            whole = own.select(["doc_id"]).take(pa.array([a for a, *_ in found], pa.int64()))
            whole = whole.append_column("places", pa.array([d[2].places for d in found], pa.int64()))
            yield from whole.append_column("refusal", pa.array([d[2].refusal() for d in found], pa.string())).to_batches()

    outcome = StructType([doc, StructField("places", LongType()), StructField("refusal", StringType())])
    return rows.mapInArrow(texts, StructType([doc, para, seq, text])), rows.mapInArrow(outcomes, outcome)


def filled_paragraphs(rows: DataFrame) -> DataFrame:
    """doc_id, para, text of documents that could be filled; ``rows`` as of ``in_order``."""

    def run(batches):
        for own, found in documents_of(batches):
            paras = [p for d in found if d[2].refusal() is None for p in d[3]]
            whole = own.select(["doc_id", "para"]).take(pa.array([a for a, *_ in paras], pa.int64()))
            yield from whole.append_column("text", pa.array(["".join([t for t in p[2] if t is not None]) for p in paras], pa.string())).to_batches()

    return rows.select(NAMES).mapInArrow(run, StructType([rows.schema["doc_id"], rows.schema["para"], StructField("text", StringType())]))
