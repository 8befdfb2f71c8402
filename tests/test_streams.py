"""Streams with state: any split into micro-batches gives one result, a stream goes on from its checkpoint, replays change nothing."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import stateful, upserts, windows

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def plain_lost(rows, stale, attempts, end):
    """What becomes of each job, one by one; rows (job, second, kind)."""
    out = set()
    for job in {r[0] for r in rows}:
        runs, ended, n, seen, saved = False, False, 0, 0, False
        for _, second, kind in [*sorted(r for r in rows if r[0] == job and r[1] < end), (job, end, None)]:
            if runs and second > seen + stale:
                again = saved and n < attempts
                out.add((job, at(seen + stale), "requeue" if again else "fail", n))
                runs, ended = False, not again
            if kind is None or ended:
                continue
            if not runs:
                runs, n = True, n + 1
            seen, saved = second, saved or kind == "checkpoint"
            if kind == "done":
                runs, ended = False, True
    return out


def started(stream, out, checkpoint):
    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()


SIGNS = "job_id long, ts timestamp, kind string"


def test_lost_jobs_go_on_from_a_checkpoint_and_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(2)
    rows, second = [], 0
    for _ in range(400):
        second += rng.randrange(1, 9)
        rows.append((rng.randrange(12), second, rng.choice(["alive"] * 6 + ["checkpoint", "done"])))
    rows = [r for r in rows if r[2] != "done" or r[0] > 8]
    rows += [(3, 5, "checkpoint"), (4, 6, "checkpoint"), (5, 7, "checkpoint")]
    expected = plain_lost(rows, 60, 3, second)
    assert {a for _, _, a, _ in expected} == {"requeue", "fail"} and any(n == 3 for *_, n in expected)
    stored = sorted(((j, at(s), k) for j, s, k in rows), key=lambda r: r[1])
    for name, cuts in (("many", [(0, 50), (50, 51), (51, 200), (200, 500)]), ("one", [(0, 500)])):
        root = tmp_path / name
        (root / "in").mkdir(parents=True)
        stream = spark.readStream.schema(SIGNS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(root / "in"))
        for lo, hi in cuts:  # the stream stops and starts again after each file
            spark.createDataFrame(stored[lo:hi], SIGNS).coalesce(1).write.mode("append").parquet(str(root / "in"))
            started(stateful.lost_jobs(stream), str(root / "out"), str(root / "progress"))
        got = spark.read.parquet(str(root / "out")).collect()
        assert len(got) == len(expected) and {(r["job_id"], r["at"], r["action"], r["attempt"]) for r in got} == expected


def test_gathered_and_debounced_requests(spark, tmp_path):
    seconds = {1: [0, 1, 2, 5, 6, 30], 2: [10, 13, 15, 19, 21], 3: [4]}
    rows = sorted((at(s), k) for k, all_ in seconds.items() for s in all_) + [(at(60), 9)]
    spark.createDataFrame([(k, t) for t, k in rows], "k long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    spans = lambda df: {(r["k"], (r["first_at"] - T0).seconds, (r["fired_at"] - T0).seconds, r["requests"]) for r in df.collect()}
    got = spans(windows.drained(stateful.gathered(stream, "k", 5)))
    assert got == {(1, 0, 5, 3), (1, 5, 10, 2), (1, 30, 35, 1), (2, 10, 15, 2), (2, 15, 20, 2), (2, 21, 26, 1), (3, 4, 9, 1)}
    quiet = {(1, 0, 9, 5), (1, 30, 33, 1), (2, 10, 18, 3), (2, 19, 24, 2), (3, 4, 7, 1)}
    assert spans(windows.drained(stateful.debounced(stream, "k", "3 seconds"))) == quiet
    assert spans(stateful.debounced(spark.read.parquet(str(tmp_path / "in")), "k", "3 seconds")) - {(9, 60, 63, 1)} == quiet


def test_drained_streams_append_closed_windows_and_keep_all_when_complete(spark, tmp_path):
    spark.createDataFrame([(1, at(s)) for s in (0, 30, 70, 200)], "k long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    counts = windows.tumbling_counts(stream, ["k"], "1 minute", "0 seconds")
    seen = lambda mode: {((r["window_start"] - T0).seconds, r["calls"]) for r in windows.drained(counts, mode).collect()}
    assert seen("append") == {(0, 2), (60, 1)} and seen("complete") == {(0, 2), (60, 1), (180, 1)}
    with pytest.raises(ValueError, match="append or complete"):
        windows.drained(counts, "update")


def adding(now, batch):
    return now.unionByName(batch).groupBy("k").agg(F.sum("n").alias("n"))


def test_upserts_take_effect_once_whatever_is_replayed(spark, tmp_path, monkeypatch):
    """Killed between write and commit, and between the commit and the stream's own: each batch counts once."""
    rows = [(k % 7, 1) for k in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : (i + 1) * 20], "k long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = upserts.KeyedTable(spark, str(tmp_path / "table"), "k long, n long", ["k"], adding, buckets=4)
    assert target.read().collect() == []
    stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    attempts = []

    def failing(df, batch_id):
        attempts.append(batch_id)
        if attempts.count(batch_id) == 1:
            target.write(df, batch_id)
            raise RuntimeError("killed before the commit")
        target.upsert(df, batch_id)
        if attempts.count(batch_id) == 2:
            raise RuntimeError("killed after the commit")

    for _ in range(9):
        query = windows.upsert_batches(stream, failing, str(tmp_path / "progress"))
        try:
            query.awaitTermination()
        except Exception as why:  # noqa: BLE001
            assert "killed" in str(why)
        else:
            break
    assert attempts == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert {(r["k"], r["n"]) for r in target.read().collect()} == {(k, sum(1 for j, _ in rows if j == k)) for k in range(7)}
    assert sorted({r["batch_id"] for r in target.ledger().collect()}) == [0, 1, 2]
    target.upsert(spark.createDataFrame([(1, 100)], "k long, n long"), 2)  # a batch that has been applied
    assert target.read().where("k = 1").first()["n"] < 100


def test_upsert_of_the_latest_row_touches_its_buckets_only(spark, tmp_path):
    merge = upserts.latest(["k"], "v")
    target = upserts.KeyedTable(spark, str(tmp_path / "t"), "k long, v long, s string", ["k"], merge, buckets=16)
    target.upsert(spark.createDataFrame([(k, 1, "a") for k in range(50)], target.schema), 0)
    before = {r["bucket"] for r in target.ledger().where("batch_id = 0").collect()}
    target.upsert(spark.createDataFrame([(3, 5, "b"), (3, 4, "c"), (77, 1, "d")], target.schema), 1)
    target.upsert(spark.createDataFrame([], target.schema), 2)
    got = {r["k"]: (r["v"], r["s"]) for r in target.read().collect()}
    assert got == {k: (1, "a") for k in range(50)} | {3: (5, "b"), 77: (1, "d")}
    assert len(before) > 5 and target.ledger().where("batch_id = 1").count() <= 2 and target.applied(2)


def test_waiting_rows_are_packed():
    """A key's waiting rows take eight bytes each, in sorted stretches, and its state and timer are one value."""
    import types

    import numpy as np

    from pyspark.sql import Row

    class Value(list):
        get = lambda self: self[-1] if self else None
        update = list.append

    class Rows(list):
        get = lambda self: iter(self)
        appendList = list.extend  # noqa: N815

        def put(self, rows):
            self[:] = rows

    held, rows, timers = Value(), Rows(), set()
    handle = types.SimpleNamespace(getValueState=lambda *_: held, getListState=lambda *_: rows, registerTimer=timers.add, deleteTimer=timers.discard)
    s = stateful._Gathered("k", 1)
    s.init(handle)
    at = [5_000_000, 1_000_000, 1_500_000, 9_000_000]
    list(s.handleInputRows((1,), (Row(k=1, ts=None, packed=x * stateful.KINDS) for x in at), None))
    assert [np.frombuffer(r[0], np.int64).tolist() for r in rows] == [[x * stateful.KINDS for x in sorted(at)]] and timers == {1001}
    timers.clear()
    out = list(s.handleExpiredTimer((1,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 8000), None))
    assert [tuple(r) for r in out] == [(1, 1_000_000, 2_000_000, 2), (1, 5_000_000, 6_000_000, 1)]
    assert [len(r[0]) for r in rows] == [8] and timers == {9001}
