"""The undo history of documents as keyed state of a stream.

Each document keeps its revision, what it holds now, and two rings of earlier and undone
states, as (digest, bytes): contents stay in the store that the digest names. Events
(doc_id, seq, op, base_rev, digest, bytes) come in any micro-batches; within one, a
document's events go by seq. State is kept by document, so documents are dealt over tasks
and an event costs its document's rings, at most ``depth`` entries each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "doc_id long, seq long, op string, outcome string, rev long, digest string, undo int, redo int"
RING = "digest string, bytes long"
#: The most states that undo remembers, and the most bytes of both rings.
DEPTH, BUDGET = 30, 256 << 20


class History:
    """One document's rings, fed with its events in order.

    ``commit`` is refused as ``changed`` when it was made on another revision than the
    document's (without one, the last writer wins); else what was is pushed, what was
    undone is forgotten. ``undo`` and ``redo`` move between the rings, and are ``empty``
    where there is nothing. Each change is a new revision. The oldest states go beyond
    the depth, and beyond the bytes from the older end of each ring, but never its last.
    ``barrier`` commits and forgets both rings. ``close`` forgets everything."""

    def __init__(self, state: tuple = (0, None, 0), undo: list | None = None, redo: list | None = None, depth: int = DEPTH, budget: int = BUDGET):
        self.rev, self.digest, self.bytes = state
        self.undo, self.redo, self.depth, self.budget = list(undo or []), list(redo or []), depth, budget

    def see(self, op: str, base_rev: int | None, digest: str | None, size: int) -> str:
        if op == "close":
            self.__init__(depth=self.depth, budget=self.budget)
            return "ok"
        if op in ("commit", "barrier"):
            if base_rev is not None and base_rev != self.rev:
                return "changed"
            if self.digest is not None:
                self.undo.append((self.digest, self.bytes))
            self.redo.clear()
            self.digest, self.bytes = digest, size
            if op == "barrier":
                self.undo.clear()
        elif op in ("undo", "redo"):
            take, give = (self.undo, self.redo) if op == "undo" else (self.redo, self.undo)
            if not take:
                return "empty"
            give.append((self.digest, self.bytes))
            self.digest, self.bytes = take.pop()
        else:
            return "unknown"
        self.rev += 1
        self.trim()
        return "ok"

    def trim(self) -> None:
        del self.undo[: max(0, len(self.undo) - self.depth)]
        for ring in (self.undo, self.redo):
            while len(ring) > 1 and sum(n for _, n in (*self.undo, *self.redo)) > self.budget:
                del ring[0]


class Keeper(StatefulProcessor):
    """With ``idle``, milliseconds of event time, a document that nothing happens to for so long
    loses both rings whole, and says so once (``evicted``)."""

    def __init__(self, idle: int | None = None, depth: int = DEPTH, budget: int = BUDGET):
        self.idle, self.depth, self.budget = idle, depth, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "rev long, digest string, bytes long")
        self.rings = [handle.getListState(name, RING) for name in ("undo", "redo")]

    def history(self) -> History:
        state = self.now.get() if self.now.exists() else (0, None, 0)
        return History(tuple(state), *([tuple(r) for r in ring.get()] if ring.exists() else [] for ring in self.rings), self.depth, self.budget)

    def keep(self, held: History) -> None:
        self.now.update((held.rev, held.digest, held.bytes))
        for ring, own in zip(self.rings, (held.undo, held.redo)):
            ring.put(own) if own else ring.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.history(), []
        for seq, op, base, digest, size in pd.concat(list(rows)).sort_values("seq")[["seq", "op", "base_rev", "digest", "bytes"]].itertuples(index=False):
            outcome = held.see(op, None if pd.isna(base) else int(base), digest, int(size))
            out.append((key[0], seq, op, outcome, held.rev, held.digest, len(held.undo), len(held.redo)))
        self.keep(held)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held.undo or held.redo:
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.history()
        held.undo, held.redo = [], []
        self.keep(held)
        yield pd.DataFrame([(key[0], -1, "idle", "evicted", held.rev, held.digest, 0, 0)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def kept_history(events: DataFrame, idle: int | None = None, depth: int = DEPTH, budget: int = BUDGET) -> DataFrame:
    """What became of each event, of a stream or of a table. ``idle`` needs a stream with a
    watermark. Streams need Spark's RocksDB state store."""
    events.sparkSession.streams  # noqa: B018  state stores report to its coordinator, those of a table too
    return events.groupBy("doc_id").transformWithStateInPandas(Keeper(idle, depth, budget), OUTPUT, "Append", "EventTime" if idle is not None else "None")
