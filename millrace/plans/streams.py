"""Streaming queries over the events table (extensions)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.plans.base import Book
from millrace.session import shared_dir, table
from millrace.streaming import stateful, upserts, windows

book = Book()
query = book.query


def _stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    return windows.drained(windows.tumbling_counts(_stream(spark, sf_dir), ["event_type"], "1 hour"), "complete")


@query("SELECT date_trunc('minute', ts) AS window_start, user_id % 10 AS workspace, count(*) AS calls FROM events GROUP BY 1, 2")
def request_windows(spark, sf_dir):
    return windows.tumbling_counts(table(spark, sf_dir, "events").withColumn("workspace", F.col("user_id") % 10), ["workspace"])


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, k"
)
def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "user_id", "6 hours")


@query(
    "SELECT o_orderkey AS job, CASE WHEN o_custkey % 5 < 3 THEN 'requeue' ELSE 'fail' END AS next FROM orders WHERE o_orderkey % 4 = 0 AND CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1996-01-01' - INTERVAL 60 SECOND"
)
def stale_jobs_of_orders(spark, sf_dir):
    """Orders as jobs whose last heartbeat was their date."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 4 == 0, "running").otherwise("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("heartbeat_at"), (F.col("o_custkey") % 5).alias("attempt"))
    return windows.stale_jobs(jobs, F.lit("1996-01-01 00:00:00").cast("timestamp")).select("job", "next")


# A row acts once the watermark, which stands at the latest row's millisecond, has passed it.
_END = "date_trunc('milliseconds', (SELECT max(ts) FROM events))"
_SIGNS = f"v AS (SELECT user_id AS job, ts, event_id % 7 = 0 AS saves, event_id % 97 = 0 AS ends FROM events WHERE ts < {_END}), g AS (SELECT *, lead(ts) OVER w AS next, max(saves) OVER (PARTITION BY job ORDER BY ts, ends, saves ROWS UNBOUNDED PRECEDING) AS saved, max(ends) OVER (PARTITION BY job ORDER BY ts, ends, saves ROWS UNBOUNDED PRECEDING) AS ended FROM v WINDOW w AS (PARTITION BY job ORDER BY ts, ends, saves))"


@query(
    f"WITH {_SIGNS}, l AS (SELECT job, ts + INTERVAL 12 HOUR AS lost_at, saved, row_number() OVER (PARTITION BY job ORDER BY ts) AS attempt FROM g WHERE NOT ended AND coalesce(next, {_END}) > ts + INTERVAL 12 HOUR), "
    "a AS (SELECT *, CASE WHEN saved AND attempt < 3 THEN 'requeue' ELSE 'fail' END AS action FROM l), f AS (SELECT *, count(*) FILTER (action = 'fail') OVER (PARTITION BY job ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM a) SELECT job AS job_id, lost_at, action, attempt FROM f WHERE coalesce(failed, 0) = 0"
)
def lost_jobs_of_events(spark, sf_dir):
    """Users as jobs whose events are signs of life: every seventh event saves a checkpoint, every 97th ends the job."""
    kind = F.when(F.col("event_id") % 97 == 0, "done").when(F.col("event_id") % 7 == 0, "checkpoint").otherwise("alive")
    signs = _stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts", kind.alias("kind"))
    return windows.drained(stateful.lost_jobs(signs, stale=12 * 3600)).withColumnRenamed("at", "lost_at")


_REQUESTS = f"q AS (SELECT user_id % 10 AS member, ts FROM events WHERE ts < {_END})"


@query(
    f"WITH {_REQUESTS}, g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY member ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY member ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g) "
    f"SELECT member, min(ts) AS first_at, max(ts) + INTERVAL 10 MINUTE AS fired_at, count(*) AS requests FROM b GROUP BY member, burst HAVING max(ts) + INTERVAL 10 MINUTE <= {_END}"
)
def debounced_requests(spark, sf_dir):
    """Runs that fire after ten minutes without a request of the same member."""
    requests = _stream(spark, sf_dir).select((F.col("user_id") % 10).alias("member"), "ts")
    return windows.drained(stateful.debounced(requests, "member", "10 minutes"))


@query(
    f"WITH RECURSIVE {_REQUESTS}, r AS (SELECT member, min(ts) AS first_at FROM q GROUP BY member UNION ALL SELECT r.member, (SELECT min(ts) FROM q WHERE q.member = r.member AND q.ts >= r.first_at + INTERVAL 1 HOUR) FROM r WHERE first_at IS NOT NULL) "
    f"SELECT r.member, first_at, first_at + INTERVAL 1 HOUR AS fired_at, count(*) AS requests FROM r JOIN q ON q.member = r.member AND q.ts >= first_at AND q.ts < first_at + INTERVAL 1 HOUR WHERE first_at + INTERVAL 1 HOUR <= {_END} GROUP BY ALL"
)
def gathered_requests(spark, sf_dir):
    """Runs that start an hour after the first request and serve all that come before."""
    requests = _stream(spark, sf_dir).select((F.col("user_id") % 10).alias("member"), "ts")
    return windows.drained(stateful.gathered(requests, "member", 3600))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(ts) AS last_at FROM events GROUP BY user_id")
def upserted_totals(spark, sf_dir):
    """Totals of each user as a stream adds them to a keyed table, batch by batch."""

    def add(now, batch):
        both = now.unionByName(batch)
        return both.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_at").alias("last_at"))

    rows = _stream(spark, sf_dir).select("user_id", F.lit(1).cast("long").alias("n"), F.col("value").cast("decimal(38,6)").alias("total"), F.col("ts").cast("timestamp").alias("last_at"))
    root = f"{shared_dir(spark)}/millrace/totals-{uuid.uuid4().hex}"
    target = upserts.KeyedTable(spark, root, "user_id long, n long, total decimal(38,6), last_at timestamp", ["user_id"], add, buckets=8)
    windows.upsert_batches(rows, target.upsert, f"{root}-progress").awaitTermination()
    return target.read().withColumn("total", F.round(F.col("total").cast("double"), 2))
