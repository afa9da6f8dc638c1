"""The map of a page: what its content draws, where, as fractions of the page.

Operators are rows (doc_id, page, seq, op, args): ``q`` and ``Q`` save and restore the state,
``cm`` concatenates a matrix of six, ``re`` paints a rectangle (x, y, width, height; ``paint``
is fill, stroke or white) and ``Do`` an image in the unit square. Which matrix holds at an
operator is a state that runs along its page: rows are dealt by page once and stream by in
their order, with the open saves as all that is held; only saves, restores and matrices are
steps, what is drawn between two of them takes its matrix by column."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In points: what is thinner is a rule.
RULE = 2.0
ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: The size of a page that is not known.
NONE = (0.0, 0.0, False)


def times(m: tuple, n: tuple) -> tuple:
    """The matrix that does m, then n."""
    a, b, c, d, e, f = m
    return a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5]


def fresh(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Whether a row's keys differ from those of the row before it (``before`` the first)."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
    new[0] = tuple(c[0].as_py() for c in columns) != before
    return new


def numbers(lists: pa.Array, most: int) -> np.ndarray:
    """The first so many numbers of each list; what is missing is NaN."""
    flat, many = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    at = (np.cumsum(many) - many)[:, None] + np.arange(most)
    return np.where(np.arange(most) < many[:, None], np.append(flat, np.nan)[np.minimum(at, len(flat))], np.nan)


def placed(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, seq, op, paint of what is drawn on known pages, their ``width`` and ``height``, and the
    box ``l``, ``b``, ``r``, ``t`` under the matrix that holds there. A restore without a save does nothing."""
    columns = ["doc_id", "page", "seq", "op", "paint"]
    known = ops.select(*columns, "args").where("op IN ('q', 'Q', 'cm', 're', 'Do') AND doc_id IS NOT NULL AND page IS NOT NULL")
    sizes = pages.select("doc_id", "page", F.lit("page").alias("op"), F.array("width", "height").cast("array<double>").alias("args"))
    rows = known.unionByName(sizes, allowMissingColumns=True).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", F.col("op") != "page", "seq")

    def run(batches):
        key, size, ctm, saved = None, None, ONE, []
        for batch in batches:
            if not batch.num_rows:
                continue
            op, keys = batch.column("op"), [batch.column("doc_id"), batch.column("page")]
            new = fresh(keys, key)
            key = tuple(c[-1].as_py() for c in keys)
            drawn = np.asarray(pc.is_in(op, pa.array(["re", "Do"])))
            steps = np.flatnonzero(new | ~drawn)
            own = batch.take(pa.array(steps))
            args = numbers(own.column("args"), 6)
            held, sizes = [ctm], [size or NONE]  # as the batch begins, then from each step on
            for what, first, m, given in zip(own.column("op").to_pylist(), new[steps].tolist(), args.tolist(), own.column("args").is_valid().to_pylist()):
                if first:
                    ctm, saved, size = ONE, [], None
                if what == "page":
                    size = (m[0], m[1], True)
                elif what == "q":
                    saved.append(ctm)
                elif what == "Q":
                    ctm = saved.pop() if saved else ctm
                elif what == "cm" and given:
                    ctm = times(m, ctm)
                held.append(ctm)
                sizes.append(size or NONE)
            at = np.searchsorted(steps, np.arange(batch.num_rows), side="right")
            held, sizes = np.array(held), np.array(sizes)
            take = np.flatnonzero(drawn & (sizes[at, 2] > 0))
            out = batch.take(pa.array(take))
            x, y, w, h = np.where(np.asarray(pc.equal(out.column("op"), "Do"))[:, None], (0.0, 0.0, 1.0, 1.0), numbers(out.column("args"), 4)).T
            c, corners = held[at[take]].T, [(x + dx * w, y + dy * h) for dx in (0, 1) for dy in (0, 1)]
            xs, ys = [x * c[0] + y * c[2] + c[4] for x, y in corners], [x * c[1] + y * c[3] + c[5] for x, y in corners]
            found = (*sizes[at[take], :2].T, *(reduce(f, v) for f in (np.minimum, np.maximum) for v in (xs, ys)))
            yield pa.RecordBatch.from_arrays([*map(out.column, columns), *(pa.array(v, from_pandas=True) for v in found)], [*columns, "width", "height", "l", "b", "r", "t"])

    kinds = dict(known.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'double')}" for n in (*columns, "width", "height", "l", "b", "r", "t")))


def page_map(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, seq, kind (h, v, box, white, image), filled, x0, y0, x1, y1: fractions of the
    page (doc_id, page, width, height) from its top left corner. What lies wholly outside
    the page, and what has no extent at all, is not on the map."""
    m = placed(ops, pages)
    w, h = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    kind = F.when(F.col("op") == "Do", "image").when(F.col("paint") == "white", "white").when((h <= RULE) & (w > RULE), "h").when((w <= RULE) & (h > RULE), "v").otherwise("box")
    both = m.where(((w > 0) | (h > 0)) & (F.col("r") >= 0) & (F.col("l") <= F.col("width")) & (F.col("t") >= 0) & (F.col("b") <= F.col("height")))
    part = lambda v, by: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.col(by)))
    return both.select("doc_id", "page", "seq", kind.alias("kind"), (F.coalesce("paint", F.lit("")) != "stroke").alias("filled"), part(F.col("l"), "width").alias("x0"), part(F.col("height") - F.col("t"), "height").alias("y0"), part(F.col("r"), "width").alias("x1"), part(F.col("height") - F.col("b"), "height").alias("y1"))
