"""The checks of a warehouse model, one query each, over a model as large as the driver's tables.

Parts stand for tables (a third staging, core and mart each), orders for columns, their mappings and inputs, suppliers for
review flags, and customers for KPIs. Keys are spread so that every check passes for some objects and fails for others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import score
from millrace.plans.base import Book
from millrace.session import table

book = Book()

_SQL = """WITH t AS (
    SELECT 't' || p_partkey AS table_id, p_partkey AS k, p_size AS z, CASE p_partkey % 3 WHEN 0 THEN 'staging' WHEN 1 THEN 'core' ELSE 'mart' END AS layer,
        CASE WHEN p_partkey % 3 = 0 THEN 'staging' WHEN p_partkey % 29 = 1 THEN 'date' WHEN p_size % 5 < 2 THEN 'fact' WHEN p_size % 5 < 4 THEN 'dimension' ELSE 'bridge' END AS kind FROM part
), c AS (
    SELECT 'c' || o_orderkey AS column_id, 't' || o_custkey AS table_id, o_orderkey AS k, 'n' || (o_orderkey % 400) AS name, ['sk', 'nk', 'fk', 'fk', 'measure', 'measure', 'attribute'][o_orderkey % 7 + 1] AS role,
        ['smallint', 'integer', 'bigint', 'decimal', 'string', 'text', 'date'][CASE WHEN o_orderkey % 400 < 200 THEN o_orderkey % 400 % 7 ELSE o_orderkey // 400 % 7 END + 1] AS kind, CASE WHEN o_orderkey % 7 IN (2, 3) THEN 't' || (o_custkey * 3 % 1000) END AS target FROM orders
), m AS (
    SELECT 'c' || o_orderkey AS column_id, o_orderkey AS k, 1 AS branch FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'c' || o_orderkey, o_orderkey, 2 FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 5 <> 0
), i AS (
    SELECT 'c' || o_orderkey AS column_id, CASE o_orderkey % 4 WHEN 0 THEN 'staging' WHEN 1 THEN 'core' WHEN 2 THEN 'staging' END AS input_layer, o_orderkey % 13 <> 0 AS there, o_orderkey % 17 = 0 AS gone FROM orders WHERE o_orderkey % 3 <> 1
), ct AS (SELECT c.*, t.layer, t.kind AS table_kind, t.k AS tk FROM c JOIN t ON c.table_id = t.table_id),
f AS (SELECT c.column_id, c.table_id, t.kind AS target_kind, t.table_id AS target FROM c JOIN t ON c.target = t.table_id WHERE c.role = 'fk')
"""
_CORE, _ID, _COLUMN = "layer IN ('core', 'mart')", "table_id AS object_id, table_id, layer", "column_id AS object_id, table_id, layer"

# The rows of each check: object_id, table_id, layer, passed.
_ROWS = {
    "fact_has_grain": f"SELECT {_ID}, k % 4 > 0 FROM t WHERE {_CORE} AND kind = 'fact'",
    "column_covered": "SELECT ct.column_id, ct.table_id, layer, role = 'sk' OR coalesce(d, 0) >= greatest(1, coalesce(b, 1)) FROM ct LEFT JOIN (SELECT table_id, count(DISTINCT branch) AS b FROM m JOIN c ON m.column_id = c.column_id GROUP BY 1) x ON ct.table_id = x.table_id LEFT JOIN (SELECT column_id, count(DISTINCT branch) AS d FROM m WHERE k % 6 > 0 GROUP BY 1) y ON ct.column_id = y.column_id WHERE layer IN ('core', 'mart') AND tk % 23 <> 0",
    "aggregate_group_by": "SELECT ct.column_id, table_id, layer, m.k % 2 = 0 FROM ct JOIN m ON ct.column_id = m.column_id WHERE layer IN ('core', 'mart') AND table_kind = 'fact' AND tk % 2 = 0 AND role <> 'measure'",
    "dimension_has_keys": f"SELECT {_ID}, table_id IN (SELECT table_id FROM c WHERE role = 'sk') AND table_id IN (SELECT table_id FROM c WHERE role = 'nk') FROM t WHERE {_CORE} AND kind = 'dimension'",
    "fact_has_dimension_fk": f"SELECT {_ID}, table_id IN (SELECT table_id FROM f WHERE target_kind IN ('dimension', 'date', 'bridge')) FROM t WHERE {_CORE} AND kind = 'fact'",
    "no_fact_to_fact_fk": "SELECT ct.column_id, ct.table_id, layer, target_kind <> 'fact' FROM ct JOIN f ON ct.column_id = f.column_id WHERE layer IN ('core', 'mart') AND table_kind = 'fact'",
    "time_fact_has_date_dimension": f"SELECT {_ID}, table_id IN (SELECT table_id FROM f WHERE target_kind = 'date') FROM t WHERE {_CORE} AND kind = 'fact' AND k % 5 < 3",
    "measure_has_additivity": f"SELECT {_COLUMN}, k % 5 > 0 FROM ct WHERE {_CORE} AND role = 'measure'",
    "dimension_has_scd_type": f"SELECT {_ID}, k % 4 > 1 FROM t WHERE {_CORE} AND kind = 'dimension'",
    "no_deep_snowflake": f"SELECT {_ID}, table_id NOT IN (SELECT a.table_id FROM f a JOIN f b ON a.target = b.table_id WHERE a.target_kind = 'dimension' AND b.target_kind = 'dimension' AND a.table_id <> a.target AND b.table_id <> b.target) FROM t WHERE {_CORE} AND kind = 'dimension'",
    "fact_fk_is_lookup": "SELECT ct.column_id, ct.table_id, layer, ct.column_id IN (SELECT column_id FROM m WHERE k % 6 = 1) FROM ct JOIN f ON ct.column_id = f.column_id WHERE layer = 'core' AND table_kind = 'fact' AND target_kind = 'dimension'",
    "bridge_has_keys": f"SELECT {_ID}, table_id IN (SELECT table_id FROM c WHERE role = 'sk') AND table_id IN (SELECT table_id FROM c WHERE role = 'fk' GROUP BY 1 HAVING count(*) > 1) FROM t WHERE {_CORE} AND kind = 'bridge'",
    "naming_conventions": f"SELECT {_ID}, z % 7 > 0 AND z % 11 > 0 FROM t",
    "same_name_same_type": "SELECT ct.column_id, ct.table_id, layer, kinds = 1 FROM ct JOIN (SELECT name, count(DISTINCT kind) AS kinds FROM ct WHERE layer IN ('core', 'mart') AND role <> 'sk' GROUP BY 1 HAVING count(*) > 1) n ON ct.name = n.name WHERE layer IN ('core', 'mart') AND role <> 'sk'",
    "inputs_from_layer_below": "SELECT ct.column_id, table_id, layer, coalesce(input_layer, '') = CASE layer WHEN 'core' THEN 'staging' ELSE 'core' END FROM ct JOIN i ON ct.column_id = i.column_id WHERE layer IN ('core', 'mart') AND there",
    "conformed_dimension_shared": f"SELECT {_ID}, table_id IN (SELECT f.target FROM f JOIN t o ON f.table_id = o.table_id WHERE o.kind = 'fact' GROUP BY 1 HAVING count(DISTINCT f.table_id) > 1) FROM t WHERE {_CORE} AND kind = 'dimension' AND k % 2 = 1",
    "mapping_parses": "SELECT ct.column_id, table_id, layer, m.k % 19 > 0 FROM ct JOIN m ON ct.column_id = m.column_id",
    "inputs_exist": "SELECT ct.column_id, table_id, layer, there FROM ct JOIN i ON ct.column_id = i.column_id WHERE layer IN ('core', 'mart')",
    "no_source_removed_inputs": "SELECT ct.column_id, table_id, layer, NOT gone FROM ct JOIN i ON ct.column_id = i.column_id WHERE there",
    "review_flags_resolved": "SELECT 'c' || s_suppkey, 't' || (s_suppkey * 3), 'staging', s_suppkey % 2 = 0 FROM supplier JOIN t ON table_id = 't' || (s_suppkey * 3) WHERE layer = 'staging'",
    "table_has_description": f"SELECT {_ID}, k % 5 > 1 FROM t WHERE {_CORE}",
    "measure_has_description": f"SELECT {_COLUMN}, k % 3 > 0 FROM ct WHERE {_CORE} AND role = 'measure'",
    "kpi_has_description": "SELECT 'k' || c_custkey, NULL, 'dw', c_custkey % 3 > 0 FROM customer",
    "kpi_links_measure": f"SELECT 'k' || c_custkey, NULL, 'dw', c_custkey IN (SELECT k // 7 FROM ct WHERE {_CORE} AND role = 'measure') FROM customer",
    "surrogate_key_integer": f"SELECT {_COLUMN}, kind IN ('smallint', 'integer', 'bigint') FROM ct WHERE {_CORE} AND role = 'sk'",
    "fact_no_free_text": f"SELECT {_COLUMN}, kind NOT IN ('string', 'text') FROM ct WHERE {_CORE} AND table_kind = 'fact' AND role IN ('attribute', 'measure')",
    "fact_width": f"SELECT t.table_id AS object_id, t.table_id, layer, coalesce(n, 0) <= 60 FROM t LEFT JOIN (SELECT table_id, count(*) AS n FROM c GROUP BY 1) x ON t.table_id = x.table_id WHERE {_CORE} AND kind = 'fact'",
    "pii_in_mart": f"SELECT {_COLUMN}, k % 8 > 0 FROM ct WHERE layer = 'mart'",
}
_SEVERE = {"no_source_removed_inputs": "CASE WHEN layer = 'staging' THEN 'warning' ELSE 'error' END"}


def model(spark, sf_dir) -> score.Model:
    """The model that the SQL above describes."""
    p, z, k, c = F.col("p_partkey"), F.col("p_size"), F.col("o_orderkey"), F.col("o_custkey")
    named = lambda stem, x: F.concat(F.lit(stem), x.cast("string"))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    layer = pick(("staging", "core", "mart"), p % 3)
    kind = F.when(p % 3 == 0, "staging").when(p % 29 == 1, "date").when(z % 5 < 2, "fact").when(z % 5 < 4, "dimension").otherwise("bridge")
    prefix = F.when(layer == "staging", "stg_").when(kind == "fact", "fact_").when(kind == "bridge", "bridge_").otherwise("dim_")
    tables = table(spark, sf_dir, "part").select(
        named("t", p).alias("table_id"), layer.alias("layer"), F.concat(F.when(z % 7 == 0, "x_").otherwise(prefix), F.when(z % 11 == 0, "Name").otherwise("name"), p.cast("string")).alias("name"), kind.alias("kind"), F.when(p % 4 > 0, "a row").otherwise(" ").alias("grain"),
        (p % 2 == 0).alias("is_aggregate"), (p % 5 < 3).alias("is_time_based"), F.when(p % 4 > 1, 2).alias("scd_type"), (p % 2 == 1).alias("is_conformed"), F.when(p % 5 > 1, "what it is").otherwise(F.when(p % 5 == 1, "")).alias("description"), (p % 23 == 0).alias("generated"),
    )
    o, n = table(spark, sf_dir, "orders"), k % 400
    role = pick(("sk", "nk", "fk", "fk", "measure", "measure", "attribute"), k % 7)
    columns = o.select(
        named("c", k).alias("column_id"), named("t", c).alias("table_id"), named("n", n).alias("name"), role.alias("role"), pick(("smallint", "integer", "bigint", "decimal", "string", "text", "date"), F.when(n < 200, n % 7).otherwise(F.floor(k / 400) % 7)).alias("kind"),
        F.when(k % 5 > 0, "additive").alias("additivity"), F.when(role == "fk", named("t", c * 3 % 1000)).alias("references"), F.when(k % 3 > 0, "said").alias("description"), (role == "sk").alias("is_system"), F.lit(False).alias("source_removed"), (k % 8 == 0).alias("pii"),
    )
    mapping = (F.when(k % 6 == 0, "unmapped").when(k % 6 == 1, "lookup").otherwise("direct").alias("mapping_type"), (k % 2 == 0).alias("grouped"), (k % 19 > 0).alias("parses"))
    first = o.where(k % 9 != 0).select(named("c", k).alias("column_id"), F.lit(1).alias("branch"), *mapping)
    second = o.where((c % 4 == 0) & (k % 5 != 0)).select(named("c", k).alias("column_id"), F.lit(2).alias("branch"), *mapping)
    inputs = o.where(k % 3 != 1).select(named("c", k).alias("column_id"), F.when(k % 4 == 1, "core").when(k % 2 == 0, "staging").alias("input_layer"), named("c", k + 1).alias("input_id"), (k % 13 != 0).alias("input_exists"), (k % 17 == 0).alias("input_removed"))
    s, u = F.col("s_suppkey"), F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    return {
        "tables": tables, "columns": columns, "mapped": first.unionByName(second), "inputs": inputs, "flags": table(spark, sf_dir, "supplier").select(named("t", s * 3).alias("table_id"), named("c", s).alias("column_id"), (s % 2 == 0).alias("overridden")),
        "kpis": customers.select(named("k", u).alias("kpi_id"), F.col("c_name").alias("name"), F.when(u % 3 > 0, "said").alias("description")), "kpi_links": o.select(named("k", F.floor(k / 7)).alias("kpi_id"), named("c", k).alias("column_id")),
    }


def _registered(code: str, severity: str) -> None:
    def run(spark, sf_dir):
        return score.run_checks(model(spark, sf_dir), only=(code,)).select("object_id", "table_id", "layer", "severity", "passed")

    run.__name__, run.__doc__ = f"check_{code}", f"Findings of {code} over the whole model."
    severe = _SEVERE.get(code, f"'{severity}'")
    book.query(f"{_SQL}, r(object_id, table_id, layer, passed) AS ({_ROWS[code]}) SELECT object_id, table_id, layer, {severe} AS severity, passed FROM r")(run)


for _code, (_severity, _) in score.CHECKS.items():
    _registered(_code, _severity)


_EACH = " UNION ALL ".join(f"SELECT '{code}' AS check_code, {_SEVERE.get(code, chr(39) + severity + chr(39))} AS severity, * FROM ({_ROWS[code]}) {code}(object_id, table_id, layer, passed)" for code, (severity, _) in score.CHECKS.items())


@book.query(f"{_SQL}, r AS ({_EACH}) SELECT check_code, severity, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY 1, 2")
def model_checks_of_parts(spark, sf_dir):
    """How many objects pass and fail each check."""
    found = score.run_checks(model(spark, sf_dir))
    return found.groupBy("check_code", "severity").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


_W = "CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END"


@book.query(
    f"{_SQL}, r AS ({_EACH}), s AS (SELECT table_id, round(100.0 * sum(CASE WHEN passed THEN {_W} ELSE 0 END) / sum({_W}), 2) AS score FROM r WHERE table_id IS NOT NULL GROUP BY 1), n AS (SELECT table_id, count(*) AS n FROM c GROUP BY 1), "
    f"l AS (SELECT layer, round(sum(score * greatest(1, coalesce(n, 1))) / sum(greatest(1, coalesce(n, 1))), 2) AS score FROM t JOIN s ON t.table_id = s.table_id LEFT JOIN n ON t.table_id = n.table_id GROUP BY layer), b AS (SELECT layer, max(severity = 'error' AND NOT passed) AS bad FROM r GROUP BY 1), "
    "g AS (SELECT l.layer, score, bad, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS g FROM l JOIN b ON l.layer = b.layer) SELECT layer, score, CASE WHEN bad AND g IN ('A', 'B') THEN 'C' ELSE g END AS grade FROM g"
)
def model_scores_of_parts(spark, sf_dir):
    """Scores and grades of the layers, tables weighted by their columns."""
    m = model(spark, sf_dir)
    return score.layer_scores(score.run_checks(m), m["tables"], m["columns"])
