"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus".split()


def _profile_sql(source: str, columns: dict[str, bool]) -> str:
    """A UNION ALL of one SELECT for each column; the flag says whether it is text."""
    parts = []
    for c, text in columns.items():
        lengths = f"avg(length({c})), max(length({c}))" if text else "CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"CASE WHEN count(*) > 0 THEN 100.0 * (count(*) - count({c})) / count(*) ELSE 0.0 END::DOUBLE AS null_pct, count(DISTINCT {c}) AS distinct_count, "
            f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, {lengths.split(', ')[0]} AS avg_length, CAST({lengths.split(', ')[1]} AS INTEGER) AS max_length FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query(_profile_sql("lineitem", {c: c.startswith("l_return") or c.startswith("l_lines") for c in _LINE}))
def profile_lineitem(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "lineitem").select(*_LINE))


@query(_profile_sql("customer", {"c_custkey": False, "c_name": True, "c_nationkey": False, "c_mktsegment": True}))
def profile_customer(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("SELECT count(*) AS row_count, count(*) - count(o_orderpriority) AS null_count, count(DISTINCT o_orderpriority) AS distinct_count FROM orders")
def quick_profile(spark, sf_dir):
    c = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - F.count(c)).alias("null_count"), F.count_distinct(c).alias("distinct_count"))


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, value LIMIT 10")
def top_values_brand(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_brand")


_TESTS = {k: f"regexp_full_match(v, '{p[4:] if p.startswith('(?i)') else p}'{", 'i'" if p.startswith('(?i)') else ''})" for k, p in profile.PATTERNS.items()}
_TESTS["phone"] = f"regexp_full_match(v, '{profile.PHONE}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15"


def _pattern_sql(source: str, column: str) -> str:
    tests = ", ".join(f"coalesce(avg(CASE WHEN {t} THEN 1 ELSE 0 END), 0.0) AS {k}" for k, t in _TESTS.items())
    long = " UNION ALL ".join(f"SELECT '{k}' AS pattern, {k} AS share, {k} >= 0.8{' AND NOT iso_date >= 0.8' if k == 'phone' else ''} AS reported FROM s" for k in _TESTS)
    return f"WITH v AS (SELECT DISTINCT trim(CAST({column} AS VARCHAR)) AS v FROM {source} WHERE trim(CAST({column} AS VARCHAR)) <> '' ORDER BY v LIMIT 200), s AS (SELECT {tests} FROM v) {long}"


@query(_pattern_sql("pages", "url"))
def pattern_shares_url(spark, sf_dir):
    return profile.pattern_shares(table(spark, sf_dir, "pages"), "url")


@query(_pattern_sql("customer", "c_name"))
def pattern_shares_name(spark, sf_dir):
    return profile.pattern_shares(table(spark, sf_dir, "customer"), "c_name")


@query(
    "WITH p AS (" + _profile_sql("orders", {"o_orderkey": False, "o_orderstatus": True, "o_orderpriority": True}) + "), f AS (SELECT *, column_name = 'o_orderstatus' AS is_protected, FALSE AS is_key FROM p), "
    "g AS (SELECT *, CASE WHEN row_count > 0 AND null_pct >= 100 THEN 'all_null' WHEN null_pct > 50 THEN 'mostly_null' WHEN is_protected THEN NULL "
    "WHEN distinct_count = 1 AND row_count > 0 THEN 'constant' WHEN distinct_count = row_count AND row_count > 0 AND NOT is_key THEN 'unique_not_key' END AS finding FROM f) "
    "SELECT column_name, finding, row_count >= 100000 AS capped, CASE WHEN finding = 'constant' THEN min_value END AS value FROM g WHERE finding IS NOT NULL"
)
def column_findings(spark, sf_dir):
    p = profile.column_profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    p = p.withColumn("is_protected", F.col("column_name") == "o_orderstatus").withColumn("is_key", F.lit(False))
    return profile.findings(p, 100_000).select("column_name", "finding", "capped", "value")


_POINTS = "SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS taken_at, count(*) AS row_estimate FROM orders GROUP BY 1, 2"


def _points(spark, sf_dir):
    month = F.to_date(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), month.alias("taken_at")).agg(F.count(F.lit(1)).alias("row_estimate"))


@query(
    f"WITH p AS ({_POINTS}), m AS (SELECT *, row_estimate < lag(row_estimate) OVER (PARTITION BY series ORDER BY taken_at) * 0.8 AS d FROM p), "
    "f AS (SELECT series, min_by(row_estimate, taken_at) AS first, max_by(row_estimate, taken_at) AS latest, min(taken_at) AS began, max(taken_at) AS ended, max(CASE WHEN d THEN taken_at END) AS low, count(*) AS n, min(row_estimate) AS lo, max(row_estimate) AS hi FROM m GROUP BY series), "
    "g AS (SELECT f.*, coalesce(p.row_estimate, f.first) AS base, date_diff('day', coalesce(f.low, f.began), f.ended) AS days FROM f LEFT JOIN p ON p.series = f.series AND p.taken_at = f.low WHERE n > 1 AND lo < hi), "
    "h AS (SELECT *, CASE WHEN days <> 0 THEN (latest - base) / CAST(days AS DOUBLE) * 30.44 ELSE 0.0 END AS pm FROM g) "
    "SELECT series, first, latest, round(CASE WHEN first <> 0 THEN (latest - first) / CAST(first AS DOUBLE) * 100 END, 6) AS change_pct, round(pm, 6) AS per_month, round(greatest(0.0, latest + pm * 12), 6) AS in_12_months, low AS dropped_at FROM h"
)
def growth_series(spark, sf_dir):
    g = profile.growth(_points(spark, sf_dir), "series")
    return g.select("series", "first", "latest", *[F.round(c, 6).alias(c) for c in ("change_pct", "per_month", "in_12_months")], "dropped_at")


@query(
    f"WITH p AS ({_POINTS}), s AS (SELECT series, count(*) AS n, min(row_estimate) AS lo, max(row_estimate) AS hi FROM p GROUP BY series) "
    "SELECT CASE WHEN n < 2 THEN 'new' WHEN lo = hi THEN 'unchanged' ELSE 'counted' END AS reason, count(*) AS n FROM s GROUP BY 1"
)
def growth_left_out(spark, sf_dir):
    s = _points(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("k"), F.min("row_estimate").alias("lo"), F.max("row_estimate").alias("hi"))
    reason = F.when(F.col("k") < 2, "new").when(F.col("lo") == F.col("hi"), "unchanged").otherwise("counted")
    return s.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH t AS (SELECT p_partkey AS table_id, CASE WHEN p_size % 6 = 0 THEN 'view' ELSE 'table' END AS kind FROM part), p AS (SELECT l_partkey AS id, count(*) AS n, min(x) AS lo, max(x) AS hi FROM (SELECT l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_quantity END AS x FROM lineitem WHERE l_partkey % 5 > 0 AND l_linenumber > l_partkey % 6) GROUP BY 1) "
    "SELECT table_id, CASE WHEN kind = 'view' THEN 'view' WHEN n IS NULL THEN 'no_estimate' WHEN n = 1 THEN 'new' ELSE 'unchanged' END AS reason FROM t LEFT JOIN p ON table_id = id WHERE kind = 'view' OR n IS NULL OR n = 1 OR lo = hi"
)
def growth_reasons(spark, sf_dir):
    """Parts as tables, order lines as their estimates: why the growth of some is not told."""
    tables = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.when(F.col("p_size") % 6 == 0, "view").otherwise("table").alias("kind"))
    k = F.col("l_partkey")
    points = table(spark, sf_dir, "lineitem").where((k % 5 > 0) & (F.col("l_linenumber") > k % 6)).select(k.alias("table_id"), F.when(k % 3 == 0, 5.0).otherwise(F.col("l_quantity")).alias("row_estimate"))
    return profile.left_out(tables, points)
