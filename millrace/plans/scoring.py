"""Scores of tables, layers and the warehouse from findings: a large roll-up over the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import score
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query


_FINDINGS = "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'error' WHEN o_orderkey % 3 = 0 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN o_custkey % 2 = 0 THEN 'core' ELSE 'mart' END AS layer, CAST(o_custkey % 97 AS VARCHAR) AS table_id, o_orderstatus <> 'P' AS passed FROM orders"
_WEIGHT = "CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END"


def _findings(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    severity = F.when(k % 10 == 0, "error").when(k % 3 == 0, "warning").otherwise("info")
    return table(spark, sf_dir, "orders").select(severity.alias("severity"), F.when(c % 2 == 0, "core").otherwise("mart").alias("layer"), (c % 97).cast("string").alias("table_id"), (F.col("o_orderstatus") != "P").alias("passed"))


@query(f"WITH f AS ({_FINDINGS}) SELECT table_id, round(100.0 * sum(CASE WHEN passed THEN {_WEIGHT} ELSE 0 END) / sum({_WEIGHT}), 2) AS score FROM f GROUP BY table_id")
def score_by_table(spark, sf_dir):
    return score.table_scores(_findings(spark, sf_dir))


@query(
    f"WITH f AS ({_FINDINGS}), t AS (SELECT table_id, round(100.0 * sum(CASE WHEN passed THEN {_WEIGHT} ELSE 0 END) / sum({_WEIGHT}), 2) AS score FROM f GROUP BY 1), n AS (SELECT CAST(p_partkey % 97 AS VARCHAR) AS id, count(*) AS n FROM part WHERE p_partkey % 97 < 80 GROUP BY 1), "
    "l AS (SELECT CASE WHEN CAST(table_id AS INTEGER) % 3 = 0 THEN 'mart' ELSE 'core' END AS layer, score, coalesce(n, 1) AS w FROM t LEFT JOIN n ON table_id = id), s AS (SELECT layer, round(sum(score * w) / sum(w), 2) AS score FROM l GROUP BY 1), b AS (SELECT layer, max(severity = 'error' AND NOT passed) AS bad FROM f GROUP BY 1), "
    "g AS (SELECT s.layer, score, bad, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS g FROM s JOIN b ON s.layer = b.layer) SELECT layer, score, CASE WHEN bad AND g IN ('A', 'B') THEN 'C' ELSE g END AS grade FROM g"
)
def score_by_layer(spark, sf_dir):
    """Layers' scores, tables weighted by how many columns they have; the parts stand for columns."""
    found = _findings(spark, sf_dir)
    tables = found.select("table_id", F.when(F.col("table_id").cast("int") % 3 == 0, "mart").otherwise("core").alias("layer")).distinct()
    columns = table(spark, sf_dir, "part").where("p_partkey % 97 < 80").select((F.col("p_partkey") % 97).alias("table_id"))
    return score.layer_scores(found, tables, columns)


@query(
    f"WITH f AS ({_FINDINGS}), s AS (SELECT round(100.0 * sum(CASE WHEN passed THEN {_WEIGHT} ELSE 0 END) / sum({_WEIGHT}), 2) AS score, max(severity = 'error' AND NOT passed) AS bad FROM f), "
    "g AS (SELECT score, bad, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS g FROM s) SELECT score, CASE WHEN bad AND g IN ('A', 'B') THEN 'C' ELSE g END AS grade, bad AND g IN ('A', 'B') AS capped FROM g"
)
def score_of_warehouse(spark, sf_dir):
    return score.warehouse_score(_findings(spark, sf_dir))
