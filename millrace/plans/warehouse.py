"""Warehouse queries: calendars, lookups, mappings and KPIs over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import warehouse as WH
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query


@query(
    "SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, "
    "CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(year(d) * 100 + month(d) AS INTEGER) AS year_month, "
    "isodow(d) IN (6, 7) AS is_weekend, d = last_day(d) AS is_month_end, CAST(year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST((month(d) + 5) % 12 // 3 + 1 AS INTEGER) AS fiscal_quarter, CAST((month(d) + 5) % 12 + 1 AS INTEGER) AS fiscal_month "
    "FROM (SELECT CAST(unnest(generate_series(date_trunc('year', low), date_trunc('year', high) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders))"
)
def date_dim(spark, sf_dir):
    """Every day of the years that the orders span."""
    span = table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    return WH.date_dimension(spark, *span, fiscal_start=7)


@query(
    "SELECT CAST(i // 60 * 100 + i % 60 AS INTEGER) AS time_key, CAST(i // 60 AS INTEGER) AS hour_24, CAST(CASE WHEN i // 60 % 12 = 0 THEN 12 ELSE i // 60 % 12 END AS INTEGER) AS hour_12, CAST(i % 60 AS INTEGER) AS minute, CASE WHEN i < 720 THEN 'AM' ELSE 'PM' END AS am_pm, "
    "CASE WHEN i < 360 THEN 'night' WHEN i < 720 THEN 'morning' WHEN i < 1080 THEN 'afternoon' ELSE 'evening' END AS day_period, lpad(CAST(i // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') AS time_label, coalesce(n, 0) AS events FROM (SELECT unnest(range(1440)) AS i) LEFT JOIN (SELECT hour(ts) * 60 + minute(ts) AS m, count(*) AS n FROM events GROUP BY 1) ON i = m"
)
def time_dim(spark, sf_dir):
    """Every minute of the day, and the events that fell into it."""
    calls = table(spark, sf_dir, "events").groupBy((F.hour("ts") * 100 + F.minute("ts")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return WH.time_dimension(spark).join(calls, F.col("time_key") == F.col("k"), "left").withColumn("events", F.coalesce("n", F.lit(0))).drop("k", "n")


@query(
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS full_date FROM orders), n AS (SELECT full_date, date_diff('day', DATE '0622-07-19', full_date) AS n FROM d), y AS (SELECT *, (30 * n + 10646) // 10631 AS y FROM n), "
    "r AS (SELECT *, n - 354 * (y - 1) - (3 + 11 * y) // 30 AS r FROM y), m AS (SELECT *, least(12, CAST(ceil((r + 0.5) / 29.5) AS BIGINT)) AS m FROM r) SELECT full_date, CAST(y AS INTEGER) AS hijri_year, CAST(m AS INTEGER) AS hijri_month, CAST(r - ceil(29.5 * (m - 1)) + 1 AS INTEGER) AS hijri_day, "
    "CAST(y * 100 + m AS INTEGER) AS hijri_year_month, ['Muharram', 'Safar', 'Rabi al-Awwal', 'Rabi al-Thani', 'Jumada al-Ula', 'Jumada al-Akhirah', 'Rajab', 'Shaaban', 'Ramadan', 'Shawwal', 'Dhu al-Qadah', 'Dhu al-Hijjah'][m] AS hijri_month_name FROM m"
)
def hijri_dates(spark, sf_dir):
    """The days that have orders."""
    return WH.hijri(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("full_date")).distinct(), "full_date")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT -1, NULL, NULL")
def unknown_member(spark, sf_dir):
    return WH.with_unknown_member(table(spark, sf_dir, "nation"), "n_nationkey")


@query("SELECT o_orderkey, coalesce(c_custkey, -1) AS customer_key FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def lookup_unknown_member(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").withColumn("sk", F.col("c_custkey"))
    return WH.lookup(table(spark, sf_dir, "orders"), dim, {"o_custkey": "c_custkey"}, "sk", "customer_key").select("o_orderkey", "customer_key")


_CHANGES = "SELECT o_custkey, o_orderdate, min(o_orderpriority) AS priority FROM orders GROUP BY o_custkey, o_orderdate"
_VERSIONS = (
    f"WITH c AS ({_CHANGES}), f AS (SELECT *, lag(priority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS b FROM c), k AS (SELECT * FROM f WHERE b IS NULL OR b <> priority), "
    "v AS (SELECT o_custkey, priority, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM k)"
)


def _versions(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderpriority").alias("priority"))
    return WH.scd2_versions(changes, "o_custkey", "o_orderdate", ["priority"])


@query(_VERSIONS + " SELECT o_custkey, priority, valid_from, valid_to, valid_to IS NULL AS current_flag, sha256(priority) AS row_hash FROM v")
def scd2_versions(spark, sf_dir):
    return _versions(spark, sf_dir)


_KEYED = " , d AS (SELECT *, o_custkey * 100000 + CAST(date_diff('day', DATE '1990-01-01', CAST(valid_from AS DATE)) AS BIGINT) AS sk FROM v)"
_SHIPPED = "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_custkey AS custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _facts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("o_custkey").alias("custkey"))


def _keyed(spark, sf_dir):
    day = F.date_diff(F.col("valid_from").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return _versions(spark, sf_dir).withColumn("sk", F.col("o_custkey") * 100000 + day)


@query(f"{_VERSIONS}{_KEYED}, sh AS ({_SHIPPED}) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sk, -1) AS version_key FROM sh LEFT JOIN d ON custkey = o_custkey AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)")
def scd2_asof_lookup(spark, sf_dir):
    out = WH.asof_lookup(_facts(spark, sf_dir), _keyed(spark, sf_dir), {"custkey": "o_custkey"}, "l_shipdate", "sk", "version_key")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "version_key")


@query(f"{_VERSIONS}{_KEYED}, sh AS (SELECT DISTINCT * FROM ({_SHIPPED})) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(max_by(sk, valid_from), -1) AS version_key FROM sh LEFT JOIN d ON custkey = o_custkey AND l_shipdate BETWEEN valid_from AND valid_to GROUP BY l_orderkey, l_linenumber, l_partkey, l_shipdate, custkey")
def scd2_asof_lookup_strict(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy(*facts.columns).orderBy("l_orderkey"))  # a sort spills by the row, where distinct() holds two tables of all rows
    facts = facts.withColumn("nth", nth).where("nth = 1").drop("nth")
    out = WH.asof_lookup(facts, _keyed(spark, sf_dir), {"custkey": "o_custkey"}, "l_shipdate", "sk", "version_key", strict=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "version_key")


@query(
    "SELECT 'customer' AS party_type, c_custkey AS party_key, c_name AS name, CAST(c_acctbal AS DECIMAL(12,2)) AS balance, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey "
    "UNION ALL SELECT 'supplier', s_suppkey, s_name, CAST(s_acctbal AS DECIMAL(12,2)), NULL FROM supplier WHERE s_acctbal > 0"
)
def union_all_branches(spark, sf_dir):
    target = {"party_type": "string", "party_key": "bigint", "name": "string", "balance": "decimal(12,2)", "nation": "string"}
    mapping = WH.Mapping(
        target,
        [
            WH.Branch("customer", {"party_type": "'customer'", "party_key": "c_custkey", "name": "c_name", "balance": "c_acctbal", "nation": "n_name"}, [("nation", "c_nationkey = n_nationkey", "left")]),
            WH.Branch("supplier", {"party_type": "'supplier'", "party_key": "s_suppkey", "name": "s_name", "balance": "s_acctbal", "nation": None}, where="s_acctbal > 0"),
        ],
    )
    return WH.run_mapping(mapping, {t: table(spark, sf_dir, t) for t in ("customer", "supplier", "nation")})


@query("SELECT o_custkey AS customer_key, o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey, o_orderstatus HAVING count(*) > 2")
def aggregate_mapping(spark, sf_dir):
    branch = WH.Branch(
        "orders", {"customer_key": "o_custkey", "status": "o_orderstatus", "orders": "count(*)", "total": "sum(cast(o_totalprice as decimal(18,2)))"}, where="o_totalprice > 1000", group_by=["o_custkey", "o_orderstatus"], having="count(*) > 2"
    )
    return WH.run_mapping(WH.Mapping({"customer_key": "bigint", "status": "string", "orders": "bigint", "total": "double"}, [branch]), {"orders": table(spark, sf_dir, "orders")})


@query("SELECT * FROM (VALUES (0, 'unmapped_column'), (1, 'broken_reference'), (2, 'broken_reference'), (3, 'not_in_group_by')) t(branch, problem)")
def mapping_validation(spark, sf_dir):
    orders = {"orders": table(spark, sf_dir, "orders")}
    branches = [
        WH.Branch("orders", {"k": "o_orderkey", "n": None}), WH.Branch("nowhere", {"k": "1", "n": "2"}), WH.Branch("orders", {"k": "no_such_column", "n": "1"}),
        WH.Branch("orders", {"k": "o_custkey", "n": "o_totalprice"}, group_by=["o_custkey"]),
    ]
    found = WH.mapping_problems(WH.Mapping({"k": "bigint", "n": "bigint"}, branches), orders)
    return spark.createDataFrame([(k, p) for k, p, _ in found], "branch int, problem string")


_KPI = "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS kpi_sum, round(avg(l_quantity), 6) AS kpi_avg, count(DISTINCT l_suppkey) AS kpi_distinct, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS kpi_ratio FROM lineitem"


@query(_KPI)
def kpis(spark, sf_dir):
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").agg(
        price.alias("kpi_sum"), F.round(F.avg("l_quantity"), 6).alias("kpi_avg"), F.count_distinct("l_suppkey").alias("kpi_distinct"), F.round(WH.ratio(F.sum("l_tax"), F.sum("l_discount")), 6).alias("kpi_ratio")
    )


@query(
    "WITH t AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2) "
    "SELECT year, month, total, round(total / nullif(lag(total) OVER (ORDER BY year, month), 0) - 1, 6) AS mom, round(total / nullif(lag(total) OVER (PARTITION BY month ORDER BY year), 0) - 1, 6) AS yoy FROM t"
)
def kpi_growth(spark, sf_dir):
    """Facts joined with the date dimension, then month over month and year over year."""
    days = WH.date_dimension(spark, 1990, 2005).select("full_date", "year", "month")
    facts = table(spark, sf_dir, "orders").join(days, F.col("o_orderdate").cast("date") == F.col("full_date"))
    g = WH.month_growth(facts, "year", "month", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"))
    return g.select("year", "month", "total", F.round("mom", 6).alias("mom"), F.round("yoy", 6).alias("yoy"))


@query(
    "WITH m AS (SELECT p_brand AS t, 1 AS b, p_partkey AS c FROM part WHERE p_size % 3 > 0 UNION ALL SELECT p_brand, 2, p_partkey FROM part WHERE p_size % 4 > 0), b AS (SELECT t, count(DISTINCT b) AS n FROM m GROUP BY t), d AS (SELECT t, c, count(DISTINCT b) AS n FROM m GROUP BY t, c) "
    "SELECT p_brand AS \"table\", count(*) AS columns, sum(CASE WHEN coalesce(d.n, 0) >= coalesce(b.n, 1) THEN 1 ELSE 0 END)::BIGINT AS covered, CAST(floor(sum(CASE WHEN coalesce(d.n, 0) >= coalesce(b.n, 1) THEN 1 ELSE 0 END) * 100 / count(*)) AS BIGINT) AS percent FROM part LEFT JOIN b ON p_brand = b.t LEFT JOIN d ON p_brand = d.t AND p_partkey = d.c GROUP BY p_brand"
)
def mapping_coverage_of_parts(spark, sf_dir):
    """Parts as columns of their brands, mapped in two branches or not."""
    p, z = table(spark, sf_dir, "part"), F.col("p_size")
    names = (F.col("p_brand").alias("table"), F.col("p_partkey").alias("column"))
    one = lambda n, b: p.where(z % n > 0).select(*names, F.lit(b).alias("branch"))
    return WH.coverage(p.select(*names), one(3, 1).unionByName(one(4, 2)))
