"""The watched folder as a source, and undo histories as state."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quirespark.plans import catalogue
from quirespark.streaming import folder, history, watch

FOLDER = "/root/testdata/sf0.001"
EVENT = "doc_id long, seq long, op string, base_rev long, digest string, bytes long, at timestamp"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_a_folder_is_a_stream_of_listings(spark, tmp_path):
    path, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    os.mkdir(path)
    out = str(tmp_path / "out")

    def scan():
        query = folder.watched_folder(spark, path, log, parts=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        query.awaitTermination()
        return {(os.path.basename(r.path), r.scan, r.size, r.ok) for r in spark.read.schema(folder.SCHEMA).parquet(out).collect()}

    (tmp_path / "in" / "a.pdf").write_text("12345")
    (tmp_path / "in" / ".hidden").write_text("x")
    assert scan() == {("a.pdf", 0, 5, True)}
    (tmp_path / "in" / "deep").mkdir()
    (tmp_path / "in" / "deep" / "b é.pdf").write_text("1")
    os.remove(tmp_path / "in" / "a.pdf")
    assert scan() == {("a.pdf", 0, 5, True), ("b é.pdf", 1, 1, True)}
    assert ("b é.pdf", 2, 1, True) in scan()  # a new query goes on after the last
    assert "scan-000000000000.jsonl" not in os.listdir(log) and "scan-000000000002.jsonl" in os.listdir(log)


def test_a_batch_is_read_again_as_it_was(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1")
    source = folder.Scans({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "parts": "2"})
    start, end = source.initialOffset(), source.latestOffset()
    rows = lambda: sorted(r["path"] for p in source.partitions(start, end) for b in source.read(p) for r in b.to_pylist())
    first = rows()
    (tmp_path / "in" / "b").write_text("2")
    assert rows() == first and len(first) == 1
    again = folder.Scans({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "parts": "2", "wait": "60"})
    assert again.latestOffset() == end  # not before the wait is over
    with pytest.raises(ValueError):
        folder.Scans({"path": "x"})


def test_settled_files_of_a_watched_folder_act_once(spark, tmp_path):
    path, log, check, out = (str(tmp_path / n) for n in ("in", "log", "check", "out"))
    os.mkdir(path)
    acted = lambda: sorted((os.path.basename(r.path), r.scan, r.outcome) for r in spark.read.schema(watch.OUTPUT).parquet(out).collect())

    def scan():
        outcomes = watch.watch(folder.watched_folder(spark, path, log, parts=2))
        query = watch.dispatched(outcomes, "optimize", lambda df: df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start())
        query.awaitTermination()

    (tmp_path / "in" / "old").write_text("there before")
    scan()
    (tmp_path / "in" / "new").write_text("12")
    scan()
    (tmp_path / "in" / "new").write_text("123")
    scan()
    assert acted() == []
    scan()
    assert acted() == [("new", 3, "acted")]
    scan()
    assert acted() == [("new", 3, "acted")]


def naive_history(events, depth, budget):
    rev, now, undo, redo, out = 0, None, [], [], []
    for seq, op, base, digest, size in events:
        outcome = "ok"
        if op in ("commit", "barrier"):
            if base is not None and base != rev:
                outcome = "changed"
            else:
                undo = undo + [now] if now else undo
                undo, redo, now = ([] if op == "barrier" else undo), [], (digest, size)
        elif op == "undo" and undo:
            redo, now, undo = [*redo, now], undo[-1], undo[:-1]
        elif op == "redo" and redo:
            undo, now, redo = [*undo, now], redo[-1], redo[:-1]
        elif op == "close":
            rev, now, undo, redo = 0, None, [], []
        else:
            outcome = "empty" if op in ("undo", "redo") else "unknown"
        rev += outcome == "ok" and op != "close"
        undo = undo[-depth:]
        while len(undo) > 1 and sum(n for _, n in undo + redo) > budget:
            undo = undo[1:]
        while len(redo) > 1 and sum(n for _, n in undo + redo) > budget:
            redo = redo[1:]
        out.append((seq, op, outcome, rev, now and now[0], len(undo), len(redo)))
    return out


def test_undo_history(spark):
    events = {}
    for r in catalogue.rule_queries.history_events(spark, FOLDER).collect():
        events.setdefault(r.doc_id, []).append((r.seq, r.op, r.base_rev, r.digest, r.bytes))
    want = sorted((doc, *row) for doc, own in events.items() for row in naive_history(sorted(own, key=lambda e: e[0]), 6, 400))
    got = sorted(map(tuple, catalogue.queries()["undo_history"](spark, FOLDER).collect()))
    assert got == want and {"ok", "changed", "empty"} <= {r[3] for r in got}
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{FOLDER}/events.parquet'").fetchall()[0][0]


def test_undo_history_of_a_stream(rocks, tmp_path):
    """Events dealt over batches give what they give at once."""
    spark, r, rows = rocks, random.Random(3), []
    for seq in range(240):
        doc, op = r.randrange(5), r.choice(["commit", "commit", "commit", "undo", "redo", "barrier"] + ["close"] * (seq % 50 == 0))
        rows.append((doc, seq, op, r.choice([None, None, r.randrange(9)]), f"d{seq}", r.randrange(90), None))
    path, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], EVENT).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(EVENT).parquet(path)
        query = history.kept_history(stream, depth=4, budget=200).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    want = sorted((doc, *row) for doc in range(5) for row in naive_history([e[1:6] for e in rows if e[0] == doc], 4, 200))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_an_idle_history_goes_whole(rocks, tmp_path):
    spark = rocks
    path, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    day = [[(1, 1, "commit", None, "a", 1, "2024-01-01 10:00:00"), (1, 2, "commit", None, "b", 1, "2024-01-01 10:00:01")], [(2, 3, "commit", None, "c", 1, "2024-01-01 12:00:00")], [(2, 4, "commit", None, "d", 1, "2024-01-01 12:00:01")], [(1, 5, "undo", None, None, 0, "2024-01-01 12:00:02")]]
    for rows in day:
        spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(EVENT).parquet(path).withWatermark("at", "1 second")
        query = history.kept_history(stream, idle=600_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.doc_id, r.seq, r.op, r.outcome, r.undo) for r in spark.read.parquet(out).collect())
    assert (1, -1, "idle", "evicted", 0) in got and (1, 5, "undo", "empty", 0) in got and (1, 2, "commit", "ok", 1) in got
