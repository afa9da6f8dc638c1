"""Arrow columns as Python values, a column at a time: ``to_pylist`` of nested columns makes
a dictionary of each structure and a scalar of each value."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a batch that are Python values at once: as values they take some ten times as much.
PIECE = 4 << 20


def plain(column: pa.Array) -> list:
    """The column's values: lists as lists, structures as tuples, null as None."""
    if pa.types.is_list(column.type):
        items, out, at = plain(column.flatten()), [], 0
        for n in column.value_lengths().to_pylist():
            if n is None:
                out.append(None)
            else:
                out.append(items[at : at + n])
                at += n
        return out
    if pa.types.is_struct(column.type):
        rows = list(zip(*map(plain, column.flatten())))
        return [r if known else None for r, known in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows
    return column.to_pylist()


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``PIECE`` bytes together, a row at least."""
    step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
