"""Keyed state with timers in event time: jobs whose worker went silent, and requests that are gathered before they act.

Both wait until the watermark has passed a row before they act on it, and then take the rows of a key in order of their time.
So the result depends on the rows alone, not on how they fell into micro-batches, and a stream that goes on from its
checkpoint gives what one without a break gives. State is kept a row for a key, in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.session import prepare

# Seconds without a sign of life after which a worker is lost, runs of a job in all, seconds of a debounce.
STALE, ATTEMPTS, QUIET = 60, 3, 2

#: Kinds of rows that a packed number tells apart, and rows of a packed stretch.
KINDS, PACK = 4, 100_000

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """State with timers needs the RocksDB state store; a session that has another one set is told so."""
    name = "spark.sql.streaming.stateStore.providerClass"
    now = spark.conf.get(name)
    if now != _STORE and not now.endswith("HDFSBackedStateStoreProvider"):
        raise RuntimeError(f"{name} is {now}, timers need {_STORE}")
    spark.conf.set(name, _STORE)


class _InOrder(StatefulProcessor):
    """Rows of a key, handed to `step` in order of their time once the watermark has passed them.

    A row is one number: its time in microseconds, and a kind below KINDS that orders rows of one time. Rows wait packed, 8 bytes
    each, in sorted stretches of PACK at most, so that a key with very many rows takes little more than these. One timer stands
    at the earliest moment at which something can happen: the first waiting row, or `due`, the moment that the state itself
    waits for. Where it stands is kept with the state, so a key costs few calls to the state store.
    """

    #: Schema of the key's state, the key's name, and the names of what follows it in a result.
    state, key, gives = "", "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.state}, wake long")
        self.rows = handle.getListState("rows", "packed binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        packed, first = [], None
        while lot := [r[-1] for r in islice(rows, PACK)]:
            part = np.sort(np.array(lot, np.int64))
            first = int(part[0]) if first is None else min(first, int(part[0]))
            packed.append((part.tobytes(),))
        if first is not None:
            self.rows.appendList(packed)
            held = self.held.get()
            *held, wake = held if held is not None else (*self.begin(), -1)
            at = first // KINDS // 1000 + 1
            if wake < 0 or at < wake:
                self._wake(held, wake, at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, given = timerValues.getCurrentWatermarkInMs() * 1000, Row(self.key, *self.gives)
        parts = [np.frombuffer(r[0], np.int64) for r in self.rows.get()]
        waiting = np.concatenate(parts) if parts else np.empty(0, np.int64)
        waiting.sort()
        split = int(np.searchsorted(waiting, now * KINDS))
        ready, later = waiting[:split], waiting[split:]
        *held, wake = self.held.get()
        for lo in range(0, split, PACK):
            for row in ready[lo : lo + PACK].tolist():
                at, kind = divmod(row, KINDS)
                yield from (given(*key, *o) for o in self.idle(held, at))
                self.step(held, at, kind)
        yield from (given(*key, *o) for o in self.idle(held, now))
        if len(later):
            self.rows.put([(later[lo : lo + PACK].tobytes(),) for lo in range(0, len(later), PACK)])
        elif split:
            self.rows.clear()
        moments = [int(later[0]) // KINDS] if len(later) else []
        if (due := self.due(held)) is not None:
            moments.append(due)
        self._wake(held, -1, min(moments) // 1000 + 1 if moments else -1)  # the timer that went off is gone

    def _wake(self, held: list, standing: int, at: int) -> None:
        """Keep the state, and leave one timer, at `at`, or none where that is negative."""
        if standing >= 0:
            self.handle.deleteTimer(standing)
        if at >= 0:
            self.handle.registerTimer(at)
        self.held.update((*held, at))

    def close(self) -> None:
        pass


CHECKPOINT, DONE = 1, 2


class _Jobs(_InOrder):
    """held: whether the job runs, whether it has ended, its runs so far, its last sign of life, whether a checkpoint is saved."""

    state = "runs boolean, ended boolean, attempts int, seen long, saved boolean"
    key, gives = "job_id", ("at", "action", "attempt")

    def __init__(self, stale: int, attempts: int):
        self.stale, self.attempts = stale * 1_000_000, attempts

    def begin(self) -> list:
        return [False, False, 0, 0, False]

    def due(self, held: list) -> int | None:
        return held[3] + self.stale + 1 if held[0] else None

    def idle(self, held: list, until: int) -> Iterator[tuple]:
        runs, _, attempts, seen, saved = held
        if runs and until > seen + self.stale:
            again = saved and attempts < self.attempts
            held[0], held[1] = False, not again
            yield seen + self.stale, "requeue" if again else "fail", attempts

    def step(self, held: list, at: int, kind: int) -> None:
        if held[1]:
            return
        if not held[0]:  # a queued job's first sign of life is its next run
            held[0], held[2] = True, held[2] + 1
        held[3], held[4] = at, held[4] or kind == CHECKPOINT
        if kind == DONE:
            held[0], held[1] = False, True


class _Gathered(_InOrder):
    """held: when the pending run was asked for first (-1: none pending), and how many requests it has gathered."""

    state = "first long, requests long"
    gives = ("first_at", "fired_at", "requests")

    def __init__(self, key: str, seconds: float):
        self.key, self.wait = key, int(seconds * 1_000_000)

    def begin(self) -> list:
        return [-1, 0]

    def due(self, held: list) -> int | None:
        return held[0] + self.wait if held[0] >= 0 else None

    def idle(self, held: list, until: int) -> Iterator[tuple]:
        first, requests = held
        if first >= 0 and until >= first + self.wait:
            held[0], held[1] = -1, 0
            yield first, first + self.wait, requests

    def step(self, held: list, at: int, kind: int) -> None:
        held[0], held[1] = (at if held[0] < 0 else held[0]), held[1] + 1


def _packed(kind: Column) -> Column:
    return (F.unix_micros("ts") * KINDS + kind).alias("packed")


def lost_jobs(signs: DataFrame, late: str = "0 seconds", stale: int = STALE, attempts: int = ATTEMPTS) -> DataFrame:
    """What becomes of jobs whose worker goes silent: (job_id, at, action, attempt), a stream from a stream.

    signs (job_id, ts, kind) are signs of life; kind is checkpoint where the job saved a state to go on from, done where it
    ended, anything else otherwise. After more than `stale` seconds of silence a job is requeued if it has a checkpoint and
    has run fewer than `attempts` times, else it has failed; `at` is when the silence ran out, attempt the run that was lost.
    A requeued job's next sign of life begins its next run; what comes after the end of a job is ignored. Rows later than
    `late` are dropped. Rows without a job_id or ts are left out.
    """
    with_state_store(signs.sparkSession)
    prepare(signs.sparkSession)
    timed = signs.where("job_id IS NOT NULL AND ts IS NOT NULL").select("job_id", F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", late)
    kind = signs.schema["job_id"].dataType.simpleString()
    signs_ = timed.select("job_id", "ts", _packed(F.when(F.col("kind") == "done", DONE).when(F.col("kind") == "checkpoint", CHECKPOINT).otherwise(0)))
    told = signs_.groupBy("job_id").transformWithState(_Jobs(stale, attempts), f"job_id {kind}, at long, action string, attempt int", "append", "eventTime")
    return told.withColumn("at", F.timestamp_micros("at"))


def gathered(requests: DataFrame, key: str, seconds: float = QUIET, late: str = "0 seconds") -> DataFrame:
    """Runs that requests (key, ts) cause: (key, first_at, fired_at, requests), a stream from a stream.

    A request starts a run `seconds` later, unless one is pending, which then serves it as well. A request at the very
    moment that a run fires starts another.
    """
    with_state_store(requests.sparkSession)
    prepare(requests.sparkSession)
    timed = requests.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    kind = requests.schema[key].dataType.simpleString()
    told = timed.select(key, "ts", _packed(F.lit(0))).groupBy(key).transformWithState(_Gathered(key, seconds), f"`{key}` {kind}, first_at long, fired_at long, requests long", "append", "eventTime")
    return told.withColumns({"first_at": F.timestamp_micros("first_at"), "fired_at": F.timestamp_micros("fired_at")})


def debounced(requests: DataFrame, key: str, quiet: str = f"{QUIET} seconds", late: str = "0 seconds") -> DataFrame:
    """Runs that bursts of requests (key, ts) cause: (key, first_at, fired_at, requests), of a stream or of a table.

    A run fires once its key has been quiet for `quiet` after a request; each further request puts it off. That is a session
    window, which needs no code in Python: a late request joins two bursts into one as long as the watermark allows it, and a
    request at the very moment that a run would fire still puts it off.
    """
    timed = requests.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts"))
    if requests.isStreaming:
        timed = timed.withWatermark("ts", late)
    bursts = timed.groupBy(F.session_window("ts", quiet).alias("w"), key).agg(F.min("ts").alias("first_at"), F.count(F.lit(1)).alias("requests"))
    return bursts.select(key, "first_at", F.col("w.end").alias("fired_at"), "requests")
