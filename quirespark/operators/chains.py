"""Which run of a page goes on where another ends, over batches of whole pages in NumPy.

Runs are dealt to strips of their page as high as its largest run allows two that continue
each other to stand apart, and sorted from the left in them; a run looks in its own strip and
the two beside it, no further left than the widest run there reaches."""

from __future__ import annotations

import numpy as np

#: Pairs that are compared at a time.
PAIRS = 1 << 21


def ranged(asks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Each that asks with all places from ``low`` to before ``high``, ``PAIRS`` at a time."""
    many = np.maximum(high - low, 0)
    ends, at = np.cumsum(many), 0
    while at < len(asks):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m = many[at:upto]
        yield np.repeat(asks[at:upto], m), np.repeat(low[at:upto] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        at = upto


def heads(number: np.ndarray, runs: dict[str, np.ndarray], continues, reach: float, far: float, banned: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Of each run (page ``number``, rising; seq, x0, y0, x1, size and what ``continues`` reads) the place
    of the first run of its line. ``continues(a, b)`` gets places. ``reach`` and ``far``: how many sizes
    two that continue each other are apart at most, in height and along the line. ``banned``: places
    of runs and the seq of what they must not continue."""
    n = len(number)
    if not n:
        return np.zeros(0, np.int64)
    x0, y0, x1, size, seq = (runs[c] for c in ("x0", "y0", "x1", "size", "seq"))
    largest = np.maximum.reduceat(size, np.flatnonzero(np.diff(number, prepend=-1)))[number]
    high = np.where(largest > 0, largest * reach, 1.0)
    strip = np.floor(y0 / high).astype(np.int64)
    order = np.lexsort((seq, x0, strip, number))
    num, st = number[order], strip[order]
    fresh = np.concatenate([[True], (num[1:] != num[:-1]) | (st[1:] != st[:-1])])
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    # Groups by page and strip, by rank of the strip so that the key stays small.
    strips, rank = np.unique(st[first], return_inverse=True)
    key = num[first] * len(strips) + rank
    values, place = np.unique(x0, return_inverse=True)
    sorted_key = group * (len(values) + 1) + place[order]
    wide = np.maximum.reduceat((x1 - x0)[order], first)
    parent, best = np.full(n, -1, np.int64), None
    for d in (-1, 0, 1):
        r = np.searchsorted(strips, strip + d)
        there = (r < len(strips)) & (strips[np.minimum(r, len(strips) - 1)] == strip + d)
        wanted = number * len(strips) + r
        g = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        asks = np.flatnonzero(there & (key[g] == wanted))
        g = g[asks]
        low = x0[asks] - np.maximum(wide[g], 0) - far * np.maximum(largest[asks], 0) - 1e-6
        a0 = np.searchsorted(sorted_key, g * (len(values) + 1) + np.searchsorted(values, low))
        a1 = np.searchsorted(sorted_key, g * (len(values) + 1) + place[asks], "right")
        for a, b in ranged(asks, a0, a1):
            b = order[b]
            keep = ((x0[b] < x0[a]) | ((x0[b] == x0[a]) & (seq[b] < seq[a])))
            a, b = a[keep], b[keep]
            keep = continues(a, b)
            a, b = a[keep], b[keep]
            if banned is not None and len(a):
                base, span = int(seq.min()), int(seq.max() - seq.min()) + 1
                keep = ~np.isin(a * span + (seq[b] - base), banned[0] * span + (banned[1] - base))
                a, b = a[keep], b[keep]
            # Of what is known and what was found now the nearest, then what ends furthest right, then the first.
            if best is not None:
                a, b = np.concatenate([a, best[0]]), np.concatenate([b, best[1]])
            by = np.lexsort((seq[b], -x1[b], np.abs(y0[a] - y0[b]), a))
            a, b = a[by], b[by]
            top = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            best = a[top], b[top]
    head = np.arange(n)
    if best is not None:
        head[best[0]] = best[1]
    while True:
        further = head[head]
        if (further == head).all():
            return head
        head = further
