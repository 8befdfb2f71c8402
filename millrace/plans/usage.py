"""Usage queries: the events table as a log of model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import usage
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_CALLS = "SELECT *, event_type AS model, user_id % 10 AS workspace, event_id % 900 AS prompt, event_id % 1100 AS cached, event_id % 300 AS completion, event_id % 13 = 0 AS failed FROM events"
_PRICES = "SELECT * FROM (VALUES ('click', 'USD', 2.5::DECIMAL(10,2), 1.25::DECIMAL(10,2), 10::DECIMAL(10,2)), ('view', 'SAR', 9::DECIMAL(10,2), 1::DECIMAL(10,2), 30::DECIMAL(10,2))) p(model, currency, input, cached_input, output)"
_COSTED = f"WITH c AS ({_CALLS}), p AS ({_PRICES}), k AS (SELECT c.*, p.currency, ((prompt - least(cached, prompt)) * input + least(cached, prompt) * cached_input + completion * output) / 1000000.0 AS cost FROM c LEFT JOIN p ON c.model = p.model)"


def _calls(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").withColumns({"model": F.col("event_type"), "workspace": F.col("user_id") % 10, "prompt": i % 900, "cached": i % 1100, "completion": i % 300, "failed": i % 13 == 0})


def _costed(spark, sf_dir):
    prices = spark.createDataFrame([("click", "USD", "2.5", "1.25", "10"), ("view", "SAR", "9", "1", "30")], "model string, currency string, input string, cached_input string, output string")
    return usage.token_costs(_calls(spark, sf_dir), prices.select("model", "currency", *[F.col(c).cast("decimal(10,2)").alias(c) for c in ("input", "cached_input", "output")]))


@query(f"{_COSTED} SELECT workspace, currency, count(*) AS calls, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE cost IS NULL) AS unpriced, CAST(sum(prompt + completion) AS BIGINT) AS tokens, round(CAST(sum(CAST(cost AS DECIMAL(30,10))) AS DOUBLE), 4) AS cost FROM k GROUP BY workspace, currency")
def cost_rollup(spark, sf_dir):
    return usage.usage_rollup(_costed(spark, sf_dir), ["workspace"]).withColumn("cost", F.round("cost", 4))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, count(DISTINCT user_id) AS members, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS heavy FROM events GROUP BY 1, 2")
def daily_bucket_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("members"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("heavy")
    )


@query("SELECT user_id, min(ts) AS first_seen, count(*) AS calls FROM events GROUP BY user_id HAVING min(ts) >= TIMESTAMP '2024-01-01 12:00:00' AND min(ts) < TIMESTAMP '2024-01-03'")
def having_first_seen(spark, sf_dir):
    return usage.first_seen_between(table(spark, sf_dir, "events"), "user_id", F.expr("timestamp_ntz'2024-01-01 12:00:00'"), F.expr("timestamp_ntz'2024-01-03'"))


@query(f"WITH c AS ({_CALLS}) SELECT workspace, CAST(sum(prompt + completion) AS BIGINT) AS tokens FROM c WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY workspace")
def month_budget(spark, sf_dir):
    return usage.budget_used(_calls(spark, sf_dir), "workspace", F.expr("timestamp_ntz'2024-01-01'"), F.expr("timestamp_ntz'2024-02-01'"))


@query(f"WITH c AS ({_CALLS}), t AS (SELECT workspace, event_type, CAST(sum(prompt + completion) AS BIGINT) AS t FROM c GROUP BY 1, 2) SELECT workspace, CAST(sum(t) AS BIGINT) AS total, string_agg(event_type || '=' || t, ',' ORDER BY event_type) AS roles FROM t GROUP BY workspace")
def role_rollup(spark, sf_dir):
    r = usage.role_tokens(_calls(spark, sf_dir), "workspace", "event_type")
    return r.select("workspace", "total", F.array_join(F.transform(F.map_entries("by_role"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("roles"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def last_seen(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
