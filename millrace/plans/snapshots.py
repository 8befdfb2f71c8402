"""Snapshot queries: two states of part as snapshots, and small catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import snapshots as S
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query


def _states(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    after = p.where("p_partkey % 97 <> 5").withColumn("p_size", F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return p.where("p_partkey % 20 <> 3"), after


_STATES = "WITH b AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 20 <> 3), a AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 97 <> 5)"


@query(
    f"{_STATES} SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS status, "
    "CASE WHEN b.p_partkey IS NOT NULL AND a.p_partkey IS NOT NULL THEN 'p_size:' || b.p_size || '>' || a.p_size ELSE '' END AS changes FROM b FULL JOIN a ON b.p_partkey = a.p_partkey WHERE b.p_partkey IS NULL OR a.p_partkey IS NULL OR b.p_size <> a.p_size OR b.p_brand <> a.p_brand"
)
def snapshot_diff(spark, sf_dir):
    d = S.diff(*_states(spark, sf_dir), "p_partkey")
    shown = F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["before"], F.lit(">"), c["after"]))
    return d.select("p_partkey", "status", F.array_join(shown, ",").alias("changes"))


@query("SELECT 0::BIGINT AS n")
def snapshot_diff_of_itself(spark, sf_dir):
    b, _ = _states(spark, sf_dir)
    return S.diff(b, b, "p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, TRUE AS equal FROM part GROUP BY p_brand")
def content_hash_order_free(spark, sf_dir):
    """Hashes of each brand's parts agree whatever order the rows come in."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    a, b = S.content_hash(p, ["p_brand"]), S.content_hash(p.orderBy(F.desc("p_partkey")), ["p_brand"]).select(F.col("p_brand").alias("k"), F.col("digest").alias("other"))
    return a.join(b, F.col("p_brand") == F.col("k")).select("p_brand", (F.col("digest") == F.col("other")).alias("equal"))


_SETS = (
    "b AS (SELECT DISTINCT p_partkey % 3 AS s, 't' || (p_partkey % 150) AS n, unnest(['id', 'c' || p_size]) AS c FROM part), a AS (SELECT DISTINCT p_partkey % 3 AS s, 'n' || (p_partkey % 150) AS n, unnest(['id', CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE 'c' END || p_size]) AS c FROM part WHERE p_partkey % 450 <> 9), "
    "sb AS (SELECT s, n, count(*) AS k FROM b GROUP BY ALL), sa AS (SELECT s, n, count(*) AS k FROM a GROUP BY ALL), m AS (SELECT b.s, b.n AS old, a.n AS new, count(*) AS k FROM b JOIN a ON b.s = a.s AND b.c = a.c GROUP BY ALL)"
)


def _catalogs(spark, sf_dir):
    """Parts as columns of some 150 tables in three schemas, before and after a change; every table has an id."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size, t, s = F.col("p_size").cast("string"), (k % 150).cast("string"), k % 3
    before = p.select(s.alias("scope"), F.concat(F.lit("t"), t).alias("name"), F.explode(F.array(F.lit("id"), F.concat(F.lit("c"), size))).alias("child"))
    other = F.concat(F.when(k % 10 == 0, "x").otherwise("C"), size)
    return before, p.where(k % 450 != 9).select(s.alias("scope"), F.concat(F.lit("n"), t).alias("name"), F.explode(F.array(F.lit("ID"), other)).alias("child"))


@query(f"WITH {_SETS} SELECT m.s AS scope, old, new, m.k / (sb.k + sa.k - m.k) AS jaccard FROM m JOIN sb ON m.s = sb.s AND old = sb.n JOIN sa ON m.s = sa.s AND new = sa.n WHERE m.k / (sb.k + sa.k - m.k) >= 0.6")
def alike_tables(spark, sf_dir):
    """Tables gone and come whose columns are alike."""
    return S.alike_sets(*_catalogs(spark, sf_dir))


@query()
def renames_of_a_catalog(spark, sf_dir):
    """Schemas and tables that a later state has under other names."""
    before, after = _catalogs(spark, sf_dir)
    full = lambda df, p: df.select(F.concat(F.lit(p), F.col("scope").cast("string")).alias("schema"), F.col("name").alias("table"), F.lit("table").alias("kind"), "child")
    same = after.withColumn("name", F.when(F.substring("name", 2, 9).cast("int") % 10 > 1, F.concat(F.lit("t"), F.substring("name", 2, 9))).otherwise(F.col("name")))
    return S.renames(full(before, "old"), full(same, "new"))


@query("SELECT 't' || (a.p_partkey % 40) AS \"table\", a.p_name || a.p_partkey AS from_name, 'new_' || b.p_partkey AS to_name FROM part a JOIN part b ON a.p_partkey % 40 = b.p_partkey % 40 AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 = 1")
def column_renames_of_parts(spark, sf_dir):
    """Parts as columns gone and come in one place of one table."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    shape = (F.concat(F.lit("t"), (k % 40).cast("string")).alias("table"), F.col("p_type").alias("data_type"), F.col("p_size").alias("ordinal"))
    removed = p.where(k % 3 == 0).select(*shape, F.concat("p_name", k.cast("string")).alias("name"))
    added = p.where(k % 3 == 1).select(*shape, F.concat(F.lit("new_"), k.cast("string")).alias("name"))
    return S.column_renames(removed, added).where("confidence BETWEEN 0.5 AND 1").select("table", "from_name", "to_name")


@query(
    "WITH s AS (SELECT 't' || (p_partkey % 90) AS t, 'c' || p_partkey AS c, CASE WHEN p_partkey % 7 = 0 THEN 'text' ELSE 'int' END AS ty, p_partkey % 5 = 0 AS nu FROM part WHERE p_partkey % 11 <> 0), g AS (SELECT 't' || (p_partkey % 90) AS t, 'c' || p_partkey AS c, CASE WHEN p_size % 6 = 0 THEN 'text' ELSE 'int' END AS ty, p_size % 4 = 0 AS nu, p_partkey % 13 = 0 AS gone, p_partkey % 3 = 0 AS edited, p_partkey % 90 < 4 AS dead FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 90 > 1), k AS (SELECT t, max(dead) AS dead FROM g GROUP BY t) "
    "SELECT * FROM (SELECT coalesce(s.t, g.t) AS \"table\", coalesce(s.c, g.c) AS \"column\", CASE WHEN k.dead THEN NULL WHEN k.t IS NULL THEN 'create_table' WHEN g.t IS NULL THEN 'add_column' WHEN s.t IS NULL THEN CASE WHEN NOT gone THEN 'flag_removed' END WHEN gone THEN 'restore' WHEN (s.ty <> g.ty OR s.nu <> g.nu) AND edited THEN 'conflict' WHEN s.ty <> g.ty THEN 'retype' WHEN s.nu <> g.nu THEN 'renullable' END AS action "
    "FROM s FULL JOIN g ON s.t = g.t AND s.c = g.c LEFT JOIN k ON coalesce(s.t, g.t) = k.t) WHERE action IS NOT NULL"
)
def staging_sync_of_parts(spark, sf_dir):
    """Parts as columns of ninety tables, in a source and in staging, and what brings the one in line with the other."""
    p, k, z = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    names = (F.concat(F.lit("t"), (k % 90).cast("string")).alias("table"), F.concat(F.lit("c"), k.cast("string")).alias("column"))
    source = p.where(k % 11 != 0).select(*names, F.when(k % 7 == 0, "text").otherwise("int").alias("data_type"), (k % 5 == 0).alias("nullable"))
    staging = p.where((k % 17 != 0) & (k % 90 > 1)).select(*names, F.when(z % 6 == 0, "text").otherwise("int").alias("data_type"), (z % 4 == 0).alias("nullable"), (k % 13 == 0).alias("source_removed"), (k % 3 == 0).alias("user_edited"), (k % 90 < 4).alias("tombstoned"))
    return S.sync_plan(source, staging)


_KINDS = "['smallint', 'integer', 'bigint', 'decimal', 'double', 'char', 'string', 'text', 'json', 'date']"


@query(
    f"WITH p AS (SELECT 'c' || p_partkey AS name, {_KINDS}[p_partkey % 10 + 1] AS f, {_KINDS}[p_size % 10 + 1] AS t, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 60 END AS fl, p_size AS tl, p_partkey % 3 = 0 AS fn, p_size % 2 = 0 AS tn FROM part), r AS (SELECT *, list_position({_KINDS}[1:5], f) AS fr, list_position({_KINDS}[1:5], t) AS tr FROM p) "
    "SELECT name, 'may_truncate' AS warning FROM r WHERE f IN ('char', 'string', 'text') AND t IN ('char', 'string') AND (fl IS NULL OR fl > tl) UNION ALL SELECT name, 'may_lose_precision' FROM r WHERE fr > 0 AND tr > 0 AND tr < fr UNION ALL SELECT name, 'may_fail_conversion' FROM r WHERE f IN ('char', 'string', 'text', 'json') AND t NOT IN ('char', 'string', 'text', 'json') UNION ALL SELECT name, 'nullable_into_required' FROM r WHERE fn AND NOT tn"
)
def type_warnings_of_parts(spark, sf_dir):
    """Parts as columns mapped from one type into another."""
    k, z = F.col("p_partkey"), F.col("p_size")
    kind = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("smallint", "integer", "bigint", "decimal", "double", "char", "string", "text", "json", "date")]), (i % 10 + 1).cast("int"))
    pairs = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), k.cast("string")).alias("name"), kind(k).alias("from_kind"), F.when(k % 4 > 0, (k % 60).cast("int")).alias("from_length"), (k % 3 == 0).alias("from_nullable"), kind(z).alias("to_kind"), z.alias("to_length"), (z % 2 == 0).alias("to_nullable"))
    return S.type_warnings(pairs)


@query(
    "WITH e AS (SELECT o_custkey AS s, 'n' || o_orderkey AS n, o_orderkey % 50 + 1 AS k FROM orders WHERE o_orderkey % 3 = 0), w AS (SELECT o_custkey AS s, 'n' || o_orderkey AS n FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT * FROM w WHERE (s, n) NOT IN (SELECT (s, n) FROM e)), t AS (SELECT s, max(k) AS top FROM e GROUP BY s) "
    "SELECT f.s AS system, n AS name, coalesce(top, 0) + row_number() OVER (PARTITION BY f.s ORDER BY n) AS number FROM f LEFT JOIN t ON f.s = t.s"
)
def placeholder_numbers_of_orders(spark, sf_dir):
    """Orders as objects of their customers' systems, some numbered before."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    named = (F.col("o_custkey").alias("system"), F.concat(F.lit("n"), k.cast("string")).alias("name"))
    return S.numbered(o.where(k % 2 == 0).select(*named), o.where(k % 3 == 0).select(*named, (k % 50 + 1).alias("number")), "system", "name", "number")


@query(
    "WITH t AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'source_removed' ELSE 'present' END AS st FROM part), c AS (SELECT o_orderkey AS id, o_custkey AS t, 'c' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'source_removed' ELSE 'present' END AS st FROM orders), r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey % 9 = 0) "
    "SELECT 'table' AS object_type, id AS object_id, name AS label FROM t WHERE st = 'source_removed' AND id NOT IN (SELECT c.t FROM c WHERE c.id IN (SELECT id FROM r)) UNION ALL SELECT 'column', c.id, t.name || '.' || c.name FROM c JOIN t ON c.t = t.id WHERE c.st = 'source_removed' AND t.st = 'present' AND c.id NOT IN (SELECT id FROM r)"
)
def staging_drops(spark, sf_dir):
    """Parts as staging tables and orders as their columns: what is gone and nothing reads."""
    o = F.col("o_orderkey")
    tables = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, "source_removed").otherwise("present").alias("status"))
    columns = table(spark, sf_dir, "orders").select(o.alias("column_id"), F.col("o_custkey").alias("table_id"), F.concat(F.lit("c"), o.cast("string")).alias("name"), F.when(o % 3 == 0, "source_removed").otherwise("present").alias("status"))
    return S.droppable(tables, columns, table(spark, sf_dir, "lineitem").where("l_partkey % 9 = 0").select(F.col("l_orderkey").alias("source")))
