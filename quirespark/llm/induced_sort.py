"""External suffix sorting by induction, with common-prefix lengths.

The scheme: the left-most S-type (LMS) suffixes are sorted, by sorting and naming
the substrings between them and recursing on the string of names; from them all
L-type and then all S-type suffixes are induced by two scans in key order. What is
induced goes into a priority queue as a tuple of position and common-prefix length;
the queue is monotone (a scan never pushes below the key that it pops), so it is a
set of first-in-first-out runs by key, held in memory up to a budget and on disk
beyond. The text, its types, names, seeds, the L-type tuples between the scans and the
result are files, read in pieces, so a shard may be far larger than memory. What stays
in memory is the budget, a piece, some numbers for each key, and the ``BASE`` names up
to which a string of names is ordered in memory, which ends the recursion.

Common-prefix lengths are capped: beyond ``depth`` they count as ``depth``, and
suffixes that share so much are neighbours in any order. They pass through the
recursion: suffixes of names that share k names share the characters of these and
then what a comparison finds. A pushed suffix shares one character more with the one
pushed before into its run than the least of the lengths scanned between the two.
Where the L and S parts of a bucket meet, both begin with a run of one character,
and share the shorter run.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heappop, heappush

import numpy as np

#: Bytes of queued tuples in memory; names that are ordered in memory; tuples of a piece.
BUDGET, BASE, PIECE = 2 << 20, 1 << 21, 1 << 16
#: What sorting did: spills of a queue, and strings of names that were recursed on.
COUNTS: Counter = Counter()


def pieces(n: int, size: int | None = None) -> Iterator[slice]:
    size = size or PIECE
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


class Files:
    """Arrays that are files of one folder."""

    def __init__(self, folder: str):
        self.folder, self.n = folder, 0

    def array(self, dtype, shape) -> np.ndarray:
        self.n += 1
        size = shape if isinstance(shape, tuple) else (shape,)
        # As a plain array on the mapped file: a memmap costs more than most of what is done with a short piece of it.
        return np.memmap(f"{self.folder}/{self.n}", dtype=dtype, mode="w+", shape=size).view(np.ndarray) if all(size) else np.empty(size, dtype)

    @contextmanager
    def inner(self):
        """A folder for what is needed no longer than this."""
        with tempfile.TemporaryDirectory(dir=self.folder) as folder:
            yield Files(folder)


class RunQueue:
    """Monotone priority queue of (position, length) tuples: runs by key, in one file
    when they exceed the budget."""

    def __init__(self, files: Files, budget: int, downward: bool = False):
        self.file = tempfile.TemporaryFile(dir=files.folder)
        self.budget, self.held, self.sign = budget, 0, -1 if downward else 1
        self.runs: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.keys: list[int] = []

    def push(self, key: int, tuples: np.ndarray) -> None:
        own = self.runs.get(key)
        if own is None:
            self.runs[key] = own = []
            if key not in self.spilled:
                heappush(self.keys, self.sign * key)
        own.append(tuples)
        self.held += tuples.nbytes
        if self.held > self.budget:
            at = self.file.seek(0, os.SEEK_END)
            for k, parts in self.runs.items():
                n = sum(len(p) for p in parts)
                self.file.write(b"".join(p.tobytes() for p in parts))
                self.spilled.setdefault(k, []).append((at, n))
                at += 8 * n
            self.runs.clear()
            self.held = 0
            COUNTS["spills"] += 1

    def next_key(self) -> int | None:
        while self.keys and (key := self.sign * self.keys[0]) not in self.runs and key not in self.spilled:
            heappop(self.keys)
        return self.sign * self.keys[0] if self.keys else None

    def pop(self, key: int) -> Iterator[np.ndarray]:
        """The run of a key in the order of its pushes, in pieces. Pushes meanwhile are another run."""
        spilled, parts = self.spilled.pop(key, []), self.runs.pop(key, [])
        self.held -= sum(p.nbytes for p in parts)
        for at, n in spilled:
            for part in pieces(n):
                self.file.seek(at + 8 * part.start)
                yield np.frombuffer(self.file.read(8 * (part.stop - part.start)), dtype=np.int32).reshape(-1, 2).copy()
        if len(parts) > 1 and len(parts) * 64 > sum(map(len, parts)):
            parts = [np.concatenate(parts)]
        for part in parts:
            for x in pieces(len(part)):
                yield part[x]


class Least:
    """Least common-prefix length scanned since the last push to each key. Lengths are at
    most ``depth``, so the last time that each length or less was scanned tells all."""

    def __init__(self, top: int, depth: int):
        self.depth, self.now, self.last, self.pushed_at = depth, 0, [-1] * (depth + 1), np.full(top + 1, -1, dtype=np.int64)

    def pushed(self, lengths: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Lengths of the tuples pushed at these indices of a scanned batch, by key and then by index."""
        out = np.empty(len(at), dtype=np.int32)
        if len(lengths) <= 4:  # the many short runs of a string of names
            wanted, now = {}, self.now
            for j, (i, k) in enumerate(zip(at.tolist(), keys.tolist())):
                wanted[i] = (j, k)
            for i, length in enumerate(lengths.tolist()):
                self.last[length:] = [now + i] * (self.depth + 1 - length)
                if i in wanted:
                    j, k = wanted[i]
                    out[j] = min(bisect_right(self.last, self.pushed_at[k]) + 1, self.depth)
                    self.pushed_at[k] = now + i
            self.now += len(lengths)
            return out
        if len(at):
            first = np.ones(len(keys), dtype=bool)
            np.not_equal(keys[1:], keys[:-1], out=first[1:])
            found = np.minimum.accumulate(lengths)[at]
            if not first.all():
                later = np.flatnonzero(~first)
                found[later] = range_least(lengths, at[later - 1] + 1, at[later])
            before = np.searchsorted(self.last, self.pushed_at[keys[first]], side="right")
            found[first] = np.minimum(found[first], before)
            out[:] = np.minimum(found + 1, self.depth)
            self.pushed_at[keys] = self.now + at  # of equal keys the last one stays
        times = np.full(self.depth + 1, -1, dtype=np.int64)
        np.maximum.at(times, lengths, self.now + np.arange(len(lengths)))
        self.last = np.maximum(self.last, np.maximum.accumulate(times)).tolist()
        self.now += len(lengths)
        return out


def range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi]: read range by range, or, if they overlap much, from a table of
    powers of two."""
    if int((hi - lo).sum()) <= 16 * len(values):
        ends = np.empty(2 * len(lo), dtype=np.int64)
        ends[::2], ends[1::2] = lo, hi + 1
        return np.minimum.reduceat(np.append(values, values[-1:]), ends)[::2]
    table, width = [values], 1
    longest = int((hi - lo).max()) + 1
    while width * 2 <= longest:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    out, level = np.empty(len(lo), dtype=values.dtype), np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for k, t in enumerate(table):
        m = level == k
        out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << k) + 1])
    return out


def typed(text: np.ndarray, files: Files) -> np.ndarray:
    """True where the suffix is of S type; the text ends in a unique least character."""
    n = len(text)
    out = files.array(bool, n)
    out[n - 1] = True
    for part in reversed(list(pieces(n - 1))):
        own, after = text[part].astype(np.int64), text[part.start + 1 : part.stop + 1].astype(np.int64)
        step = np.append(np.sign(after - own), 1 if out[part.stop] else -1)
        # An equal neighbour has the type of the next differing step.
        at = np.where(step != 0, np.arange(len(step)), len(step))
        out[part] = (step[np.minimum.accumulate(at[::-1])[::-1]] > 0)[:-1]
    return out


def run_length(text: np.ndarray, at: int, depth: int) -> int:
    part = np.asarray(text[at : at + depth])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(text: np.ndarray, seeds: np.ndarray, files: Files, depth: int, budget: int, lengths: bool = True) -> np.ndarray:
    """All suffixes in order, as (position, length shared with the one before), from
    the LMS suffixes in order (the same tuples). Without ``lengths`` only positions count."""
    n, top, star, here, at = len(text), 0, {}, None, 0
    for part in pieces(len(seeds)):
        heads = text[seeds[part, 0]].astype(np.int64)
        top = max(top, int(heads.max()))
        for c in np.flatnonzero(np.diff(heads, prepend=-1 if here is None else here)).tolist():
            if here is not None:
                star[here] = (at, part.start + c)
            here, at = int(heads[c]), part.start + c
    star[here] = (at, len(seeds))
    top = max(top, max(int(text[part].max()) for part in pieces(n)))

    def scan(queue: RunQueue, least: Least | None, batch: np.ndarray, key: int, admit) -> None:
        """Push what precedes the batch's suffixes, where ``admit`` says so."""
        before = batch[:, 0] - 1
        at = np.flatnonzero(before >= 0)
        keys = text[before[at]]
        ok = admit(keys, key)
        at, keys = at[ok], keys[ok]
        if len(at) > 1:
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
        shares = least.pushed(batch[:, 1], at, keys) if least else 0
        if not len(at):
            return
        tuples = np.empty((len(at), 2), dtype=np.int32)
        tuples[:, 0], tuples[:, 1] = before[at], shares
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
            queue.push(int(keys[a]), tuples[a:b])

    def whole(queue: RunQueue, least: Least | None, key: int, admit) -> Iterator[np.ndarray]:
        """A bucket's induced part: popped and scanned until it adds nothing to itself."""
        first = True
        while key in queue.runs or key in queue.spilled:
            for batch in queue.pop(key):
                if first:
                    batch[0, 1], first = 0, False
                scan(queue, least, batch, key, admit)
                yield batch

    def buckets(queue: RunQueue, others: list[int], downward: bool) -> Iterator[int]:
        sign, others = (-1 if downward else 1), sorted(others, reverse=not downward)  # the next one is the last
        while True:
            keys = [k for k in (queue.next_key(), others[-1] if others else None) if k is not None]
            if not keys:
                return
            key = min(keys, key=lambda k: sign * k)
            if others and others[-1] == key:
                others.pop()
            yield key

    # Upwards: L-type suffixes, from each bucket's L part and then its LMS suffixes.
    queue, least = RunQueue(files, budget), Least(top, depth) if lengths else None
    stored, large, size = tempfile.TemporaryFile(dir=files.folder), {}, 0
    for key in buckets(queue, list(star), False):
        last, begin = None, size
        for found in whole(queue, least, key, lambda k, own: k >= own):
            stored.write(found.tobytes())
            last, size = int(found[-1, 0]), size + len(found)
        if size > begin:
            large[key] = (begin, size)
        if key in star:
            for part in pieces(star[key][1] - star[key][0]):
                batch = np.array(seeds[star[key][0] + part.start : star[key][0] + part.stop])
                if not part.start:
                    batch[0, 1] = 0 if last is None else min(run_length(text, last, depth), run_length(text, int(batch[0, 0]), depth))
                scan(queue, least, batch, key, lambda k, own: k > own)

    # Downwards: S-type suffixes, from each bucket's S part and then its L part.
    stored.flush()
    ell = np.memmap(stored, dtype=np.int32, mode="r", shape=(size, 2)).view(np.ndarray) if size else np.empty((0, 2), np.int32)
    queue, least = RunQueue(files, budget, True), Least(top, depth) if lengths else None
    out, to = files.array(np.int32, (n, 2)), n
    for key in buckets(queue, list(large), True):
        last = None
        for found in whole(queue, least, key, lambda k, own: k <= own):
            # Downward, a length is shared with the one above: of each it goes to the one before.
            out[to - len(found) : to, 0] = found[::-1, 0]
            out[to - len(found) + 1 : to, 1] = found[:0:-1, 1]
            if last is not None:
                out[to, 1] = found[0, 1]
            last, to = int(found[-1, 0]), to - len(found)
        meet = 0
        if key in large:
            a, b = large[key]
            if last is not None:
                meet = min(run_length(text, int(ell[b - 1, 0]), depth), run_length(text, last, depth))
                out[to, 1] = meet
            for part in pieces(b - a):
                own = np.array(ell[b - part.stop : b - part.start])
                out[to - len(own) : to] = own
                to -= len(own)
                above = meet if not part.start else int(ell[b - part.start, 1])
                down = np.stack((own[::-1, 0], np.concatenate((np.array([above], dtype=np.int32), own[:0:-1, 1]))), axis=1)
                scan(queue, least, down, key, lambda k, own: k < own)
        elif last is not None:
            out[to, 1] = 0
    if to == 1:  # the closing character precedes all; nothing induces it
        out[0] = (n - 1, 0)
    return out


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory, by doubling
    ranks: ``depth`` names tell apart all that the depth does; what shares more may
    come in any order."""
    rank, width = np.asarray(names).astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), dtype=np.int64)
        if width < len(rank):
            after[: len(rank) - width] = rank[width:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key)
        found = key[order]
        new = np.concatenate(([0], np.cumsum(found[1:] != found[:-1])))
        rank[order] = new
        width *= 2
        if new[-1] == len(rank) - 1 or width >= depth + 1:
            return order


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, known: np.ndarray | None = None) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, up to the depth, from the known ones on."""
    n, out = len(text), np.zeros(len(a), dtype=np.int64) if known is None else np.minimum(known, depth)
    alive = np.flatnonzero(out < depth)
    while len(alive):
        x, y = a[alive] + out[alive], b[alive] + out[alive]
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        alive = alive[ok]
        out[alive] += 1
        alive = alive[out[alive] < depth]
    return out


def equal_strings(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    out, alive, step = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
    while len(alive):
        differ = text[a[alive] + step] != text[b[alive] + step]
        out[alive[differ]] = False
        step += 1
        alive = alive[~differ & (length[alive] > step)]
    return out


def by_head(text: np.ndarray, lms: np.ndarray, files: Files) -> np.ndarray:
    """(position, 0) of the LMS suffixes by first character, in the order of the text."""
    top = max(int(text[part].max()) for part in pieces(len(text)))
    cursor = np.zeros(top + 2, dtype=np.int64)
    for part in pieces(len(lms)):
        cursor[1:] += np.bincount(text[lms[part]], minlength=top + 1)
    cursor = np.cumsum(cursor)
    out = files.array(np.int32, (len(lms), 2))
    for part in pieces(len(lms)):
        heads = text[lms[part]].astype(np.int64)
        order = np.argsort(heads, kind="stable")
        heads = heads[order]
        first = np.flatnonzero(np.diff(heads, prepend=-1))
        nth = np.arange(len(heads)) - np.repeat(first, np.diff(np.append(first, len(heads))))
        out[cursor[heads] + nth, 0] = lms[part][order]
        np.add.at(cursor, heads, 1)
    return out


def named(text: np.ndarray, lms: np.ndarray, rough: np.ndarray, place: np.ndarray, files: Files) -> tuple[np.ndarray, int]:
    """Names of the substrings between LMS positions, and their number: neighbours in
    the rough order are equal when lengths and all characters are."""
    names, last, name = files.array(np.int32, len(lms)), None, -1
    for part in pieces(len(rough)):
        order = place[rough[part, 0]]
        order = order[order >= 0].astype(np.int64)
        if not len(order):
            continue
        both = order if last is None else np.append(last, order)
        end = lambda at: np.where(at + 1 < len(lms), lms[np.minimum(at + 1, len(lms) - 1)], len(text) - 1) - lms[at] + 1
        length = end(both)
        p, q = both[:-1], both[1:]
        same = length[:-1] == length[1:]
        same[same] = equal_strings(text, lms[p[same]].astype(np.int64), lms[q[same]].astype(np.int64), length[:-1][same])
        new = np.append(True, ~same) if last is None else ~same
        ids = name + np.cumsum(new)
        names[order] = ids
        last, name = order[-1], int(ids[-1])
    return names, name + 1


def suffix_order(text: np.ndarray, files: Files, depth: int, budget: int | None = None, base: int | None = None) -> np.ndarray:
    """(position, capped length shared with the one before) of all suffixes in order.
    ``text``: non-negative integers that end in a unique least one."""
    budget, base = budget or BUDGET, base or BASE
    seeds = seeded(text, files, depth, budget, base)
    return induce(text, seeds, files, depth, budget)


def seeded(text: np.ndarray, files: Files, depth: int, budget: int, base: int) -> np.ndarray:
    """The LMS suffixes in order, as those tuples."""
    n = len(text)
    with files.inner() as own:
        small = typed(text, own)
        found = own.array(np.int32, n // 2 + 2)
        m = 0
        for part in pieces(n - 1):
            at = np.flatnonzero(small[part.start + 1 : part.stop + 1] & ~small[part]) + part.start + 1
            found[m : m + len(at)] = at
            m += len(at)
        if not m:
            found[0], m = n - 1, 1
        lms = found[:m]
        place = own.array(np.int32, n)
        for part in pieces(n):
            place[part] = -1
        for part in pieces(m):
            place[lms[part]] = np.arange(part.start, part.stop)
        with own.inner() as short:
            # Sort the substrings between LMS positions: LMS suffixes by first character only, induced.
            names, many = named(text, lms, induce(text, by_head(text, lms, short), short, 1, budget, lengths=False), place, own)
        # A name stands for two characters at least.
        inner_depth = depth // 2 + 1
        order = own.array(np.int32, m)
        known = own.array(np.int32, m)
        if many == m:
            for part in pieces(m):
                order[names[part]] = np.arange(part.start, part.stop)
        elif m <= base:
            order[:] = doubled(names, inner_depth)
            for part in pieces(m - 1):
                known[part.start + 1 : part.stop + 1] = shared(names, order[part].astype(np.int64), order[part.start + 1 : part.stop + 1].astype(np.int64), inner_depth)
        else:
            COUNTS["recursions"] += 1
            inner = own.array(np.int32, m + 1)
            for part in pieces(m):
                inner[part] = names[part] + 1
            inner[m] = 0
            with own.inner() as below:
                found = suffix_order(inner, below, inner_depth, budget, base)
                for part in pieces(m):
                    order[part], known[part] = found[part.start + 1 : part.stop + 1].T
        out = files.array(np.int32, (m, 2))
        for part in pieces(m):
            at = order[max(0, part.start - 1) : part.stop].astype(np.int64)
            a, b, k = at[:-1], at[1:], known[part.stop - len(at) + 1 : part.stop]
            # Equal names: the characters up to the LMS position after them; the closing name shares none.
            k = np.minimum(k, np.minimum(m - 1 - a, m - 1 - b))
            p, q = lms[a].astype(np.int64), lms[b].astype(np.int64)
            lengths = shared(text, p, q, depth, lms[a + k] - p)
            out[part, 0] = lms[order[part]]
            out[part, 1] = np.append(0, lengths) if not part.start else lengths
    return out


def scratch() -> str | None:
    """Spark's own scratch folder of this executor, as its spilled shuffles use."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None


@contextmanager
def sorted_suffixes(data, depth: int, budget: int | None = None, base: int | None = None):
    """(position, capped common-prefix length) of the suffixes of a shard's bytes, a file."""
    with tempfile.TemporaryDirectory(dir=scratch()) as folder:
        files = Files(folder)
        text = files.array(np.int16, len(data) + 1)
        for part in pieces(len(data)):
            text[part] = np.frombuffer(data, dtype=np.uint8, count=part.stop - part.start, offset=part.start).astype(np.int16) + 1
        text[len(data)] = 0
        yield suffix_order(text, files, depth, budget, base)[1:]
