"""A watched folder as a stream of listings.

Each scan lists (path, size, mtime, ok). A file acts when size and time equal those of
the scan before, and at most once if it succeeded; a failed one acts again only after a
change; a name that is gone is forgotten, and what was there at the start counts as
done. State is kept by path, so paths are dealt over tasks. There is no event time: a
listing's scan number orders it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "path string, scan long, outcome string"
STATE = "size long, mtime long, scan long, done boolean, failed_size long, failed_mtime long"


class Watched:
    """The state of one path, fed with its listings in the order of scans. With ``react``
    a file that changed after it was done is new again."""

    def __init__(self, state: tuple | None = None, react: bool = False):
        self.react = react
        self.size, self.mtime, self.scan, self.done, self.failed_size, self.failed_mtime = state or (-1, -1, -2, False, -1, -1)

    def state(self) -> tuple:
        return self.size, self.mtime, self.scan, self.done, self.failed_size, self.failed_mtime

    def see(self, scan: int, size: int, mtime: int, ok: bool, first: int = 0) -> str | None:
        """The outcome of this listing: acted, failed, or None."""
        if scan == first:
            self.done = True  # there before the watch began
        elif self.scan != scan - 1:
            self.__init__(None, self.react)  # it was gone in between
        same = (size, mtime) == (self.size, self.mtime)
        if self.react and self.done and scan != first and not same:
            self.done = False
        settled = same and self.scan == scan - 1
        self.size, self.mtime, self.scan = size, mtime, scan
        if not settled or self.done or (size, mtime) == (self.failed_size, self.failed_mtime):
            return None
        if ok:
            self.done = True
            return "acted"
        self.failed_size, self.failed_mtime = size, mtime
        return "failed"


def seen_in(watched: Watched, path: str, rows: pd.DataFrame) -> pd.DataFrame:
    columns = rows.sort_values("scan")[["scan", "size", "mtime", "ok"]]
    out = [(path, scan, found) for scan, size, mtime, ok in columns.itertuples(index=False) if (found := watched.see(scan, size, mtime, ok))]
    return pd.DataFrame(out, columns=["path", "scan", "outcome"])


def watch(listings: DataFrame, react: bool = False) -> DataFrame:
    """Outcomes of a stream of listings (path, scan, size, mtime, ok)."""
    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watched = Watched(state.get if state.exists else None, react)
        found = seen_in(watched, key[0], pd.concat(list(batches)))
        state.update(watched.state())
        yield found

    return listings.groupBy("path").applyInPandasWithState(settle, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(listings: DataFrame, react: bool = False) -> DataFrame:
    """The same over a table of listings: a batch of all scans."""
    return listings.groupBy("path").applyInPandas(lambda key, rows: seen_in(Watched(None, react), key[0], rows), OUTPUT)


def listed(spark, folder: str, scan: int) -> DataFrame:
    """One listing of a folder: the files there now, by Spark's own reader, without their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.lit(scan).cast("long").alias("scan"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.lit(True).alias("ok"))


#: What a watch may do to a settled file.
OPERATIONS = ("open", "timestamp", "optimize", "sanitize", "ua")


def dispatched(outcomes: DataFrame, operation: str, act) -> DataFrame:
    """``act`` on what acted, of a stream or a batch; an unknown operation is refused before
    anything runs. Only ``open`` reacts to a change, see ``watch``."""
    if operation not in OPERATIONS:
        raise ValueError(f"no operation {operation}")
    return act(outcomes.where("outcome = 'acted'"))


def outcome_counts(events: DataFrame, door: str, format_: str, refusal: str) -> DataFrame:
    """import.ok by door and format, import.refused by door and cause."""
    ok = F.col(refusal).isNull()
    name = F.when(ok, "import.ok").otherwise("import.refused")
    return events.groupBy(name.alias("counter"), F.col(door).alias("door"), F.coalesce(F.when(ok, F.col(format_)), F.col(refusal)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
