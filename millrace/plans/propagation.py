"""Queries on changes and what they carry with them, over metadata made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import propagation as P
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_OLD = "o AS (SELECT 'S' || (p_partkey % 4) AS s, 'T' || (p_partkey % 37) AS t, 'c' || p_partkey AS c, p_name AS d, p_partkey % 3 + 1 AS v FROM part WHERE p_partkey % 5 <> 1)"
_NEW = "n AS (SELECT 'S' || (p_partkey % 4) AS s, 'T' || (p_partkey % 37) AS t, CASE WHEN p_partkey % 6 = 0 THEN 'C' ELSE 'c' END || p_partkey AS c, CASE WHEN p_size % 4 = 0 THEN upper(p_name) ELSE p_name END AS d FROM part WHERE p_partkey % 7 <> 2 AND p_partkey % 37 <> 5)"


@query(
    f"WITH {_OLD}, {_NEW}, tt AS (SELECT DISTINCT s, t FROM n) SELECT coalesce(n.s, o.s) AS schema, coalesce(n.t, o.t) AS \"table\", coalesce(n.c, o.c) AS \"column\", coalesce(n.d, o.d) AS definition, "
    "CASE WHEN n.c IS NOT NULL THEN 'present' WHEN (o.s, o.t) IN (SELECT (s, t) FROM tt) OR o.s IN ('S0', 'S1') THEN 'source_removed' ELSE 'out_of_scope' END AS status, CAST(CASE WHEN o.c IS NULL THEN 1 WHEN n.c IS NULL OR (n.c = o.c AND n.d = o.d) THEN v ELSE v + 1 END AS BIGINT) AS version "
    "FROM o FULL JOIN n ON o.s = n.s AND o.t = n.t AND lower(o.c) = lower(n.c)"
)
def snapshot_write(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    names = (F.concat(F.lit("S"), (k % 4).cast("string")).alias("schema"), F.concat(F.lit("T"), (k % 37).cast("string")).alias("table"))
    old = p.where(k % 5 != 1).select(*names, F.concat(F.lit("c"), k.cast("string")).alias("column"), F.col("p_name").alias("definition"), F.lit("present").alias("status"), (k % 3 + 1).alias("version"))
    new = p.where((k % 7 != 2) & (k % 37 != 5)).select(*names, F.concat(F.when(k % 6 == 0, "C").otherwise("c"), k.cast("string")).alias("column"), F.when(F.col("p_size") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("definition"))
    return P.stored_snapshot(old, new, ["S0", "S1"], folds_case=True)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN c_name || '-new' ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 3 THEN 'present' ELSE 'missing' END AS status FROM customer")
def adopted_identity(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.select(k.alias("id"), F.col("c_name").alias("name"), F.lit("missing").alias("status"))
    new = c.where(k % 10 == 3).select((-k).alias("id"), F.concat("c_name", F.lit("-new")).alias("name"), F.lit("present").alias("status"))
    return P.adopted(old.unionByName(new), c.where(k % 10 == 3).select(F.col("c_name").alias("from_name"), F.concat("c_name", F.lit("-new")).alias("to_name")))


@query(
    "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS mapping_id, 'coalesce(s' || (l_suppkey % 50) || '.' || CASE WHEN l_suppkey % 50 < 20 THEN 'fresh' ELSE 'name' END || ', T' || (l_partkey % 30) || '.' || CASE WHEN l_partkey % 30 < 15 THEN 'code2' ELSE 'Code' END || ', s1.names)' AS sql FROM lineitem WHERE l_suppkey % 50 < 20 OR l_partkey % 30 < 15"
)
def rename_propagation(spark, sf_dir):
    sup, part = (F.col("l_suppkey") % 50).cast("string"), (F.col("l_partkey") % 30).cast("string")
    sql = F.concat(F.lit("coalesce(s"), sup, F.lit(".name, T"), part, F.lit(".Code, s1.names)"))
    mappings = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mapping_id"), sql.alias("sql"))
    renames = spark.createDataFrame([(f"S{i}", "name", "fresh") for i in range(20)] + [(f"t{i}", "CODE", "code2") for i in range(15)], "table string, from_name string, to_name string")
    return P.rewritten(mappings, renames)


_EDGES = "e AS (SELECT p_partkey // 2 AS source, p_partkey AS target, CASE WHEN p_size % 5 = 0 THEN 'derived' ELSE 'direct' END AS kind FROM part)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2).alias("source"), F.col("p_partkey").alias("target"), F.when(F.col("p_size") % 5 == 0, "derived").otherwise("direct").alias("mapping_type"), F.when(F.col("p_size") % 3 == 0, "uses").otherwise("value").alias("kind"))


@query(
    f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT s FROM (VALUES (3::BIGINT), (10)) v(s) UNION SELECT target FROM r JOIN e ON source = node AND kind = 'direct') SELECT DISTINCT target AS node, 'retype' AS action FROM r JOIN e ON source = node WHERE kind = 'direct' UNION ALL "
    "SELECT DISTINCT target, 'flag' FROM r JOIN e ON source = node WHERE kind <> 'direct' AND target NOT IN (SELECT node FROM r)"
)
def retype_propagation(spark, sf_dir):
    return P.retyped(_edges(spark, sf_dir), spark.createDataFrame([(3,), (10,)], "node long"))


@query("SELECT p_partkey AS node FROM part WHERE (p_partkey // 2) % 5 = 0 AND p_size % 4 = 1 UNION SELECT p_partkey FROM part WHERE (p_partkey // 2) % 5 = 0 AND p_partkey % 9 = 0")
def nullability_propagation(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    columns = p.select(k.alias("column_id"), (F.col("p_size") % 4 != 1).alias("nullable"), F.when(k % 9 == 0, "nk").otherwise("attribute").alias("role"))
    return P.nullability_flags(_edges(spark, sf_dir), _edges(spark, sf_dir).select(F.col("source").alias("node")).distinct().where("node % 5 = 0"), columns)


@query("SELECT DISTINCT p_partkey AS node, CASE WHEN p_size % 3 = 0 THEN 'flag' ELSE 'unmap' END AS action FROM part WHERE (p_partkey // 2) % 7 = 0")
def removal_propagation(spark, sf_dir):
    return P.removal_effects(_edges(spark, sf_dir), _edges(spark, sf_dir).select(F.col("source").alias("node")).distinct().where("node % 7 = 0"))


@query(
    "WITH k AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, ['suggested', 'accepted', 'rejected'][o_custkey % 3 + 1] AS status, CASE WHEN o_custkey % 7 = 0 THEN 'manual' ELSE 'inferred' END AS origin, 0.5 AS c FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_orderkey + 1 AS a, o_orderkey AS b, 0.9 AS c FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT coalesce(k.a, f.b) AS low, coalesce(k.b, f.a) AS high, CASE WHEN status IS NULL THEN 'suggested' WHEN status = 'suggested' AND origin <> 'manual' AND f.c IS NULL THEN 'withdrawn' ELSE status END AS status, CAST(CASE WHEN status IS NULL OR (status = 'suggested' AND origin <> 'manual' AND f.c IS NOT NULL) THEN f.c ELSE k.c END AS DOUBLE) AS confidence FROM k FULL JOIN f ON k.a = f.b"
)
def suggestion_merge(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.element_at(F.array(F.lit("suggested"), F.lit("accepted"), F.lit("rejected")), (F.col("o_custkey") % 3 + 1).cast("int"))
    known = o.where(k % 2 == 0).select(k.alias("a"), (k + 1).alias("b"), status.alias("status"), F.when(F.col("o_custkey") % 7 == 0, "manual").otherwise("inferred").alias("origin"), F.lit(0.5).alias("confidence"))
    return P.merged_suggestions(known, o.where(k % 3 == 0).select((k + 1).alias("a"), k.alias("b"), F.lit(0.9).alias("confidence")))


@query("SELECT l_partkey AS a, l_suppkey AS b, CAST(least(1, l_discount * 15) AS DOUBLE) AS confidence FROM lineitem WHERE l_partkey <> l_suppkey AND l_discount * 15 >= 0.6 AND l_partkey IN (SELECT c_custkey FROM customer) AND l_suppkey IN (SELECT c_custkey FROM customer)")
def guess_filter(spark, sf_dir):
    guesses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_discount") * 15).alias("confidence"))
    return P.sound_guesses(guesses, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("column_id")), 0.6)


@query("SELECT o_custkey AS column_id, o_orderpriority AS rule, CASE o_orderpriority WHEN '1-URGENT' THEN 'direct' ELSE 'financial' END AS category, CAST(1.0 AS DOUBLE) AS confidence FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def detection_filter(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where("o_totalprice >= 1000").select(F.col("o_custkey").alias("column_id"), F.col("o_orderpriority").alias("rule"), (F.col("o_totalprice") / 1000).alias("confidence"))
    return P.sound_detections(found, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("column_id")), {"1-URGENT": "direct", "2-HIGH": "financial"}, 0.5)


@query("SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'm2' END AS model, label % 3 = 0 AND embedding IS NOT NULL AS has_vector FROM embeddings")
def vector_switch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("model", F.when(F.col("label") % 3 == 0, "m2").otherwise("m1"))
    return P.current_vectors(v, "m2").select("vec_id", "model", F.col("embedding").isNotNull().alias("has_vector"))


def _mappings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = lambda x: F.lit(x)
    return o.select(
        F.col("o_orderkey").alias("mapping_id"), text("core").alias("layer"), text("orders").alias("target_table"), text("").alias("branch"), F.col("o_orderkey").cast("string").alias("target_column"), text("bigint").alias("target_type"),
        F.col("o_orderpriority").alias("transformation_rule"), F.concat(F.lit("=o."), F.col("o_custkey").cast("string")).alias("sql_expression"), F.when(F.col("o_custkey") % 2 == 0, "direct").otherwise("derived").alias("mapping_type"), text(None).cast("string").alias("notes"),
    )


@query(
    "WITH i AS (SELECT l_orderkey, string_agg(DISTINCT 'p' || (l_partkey % 7), ';' ORDER BY 'p' || (l_partkey % 7)) AS t, string_agg(DISTINCT '-' || l_linenumber, ';' ORDER BY '-' || l_linenumber) AS c FROM lineitem GROUP BY 1) SELECT 'core' AS layer, 'orders' AS target_table, '' AS branch, CAST(o_orderkey AS VARCHAR) AS target_column, 'bigint' AS target_type, "
    "coalesce(t, '') AS input_table, CASE WHEN c IS NULL THEN '' ELSE '''' || c END AS \"input_column(s)\", o_orderpriority AS transformation_rule, '''=o.' || o_custkey AS sql_expression, CASE WHEN o_custkey % 2 = 0 THEN 'direct' ELSE 'derived' END AS mapping_type, '' AS notes FROM orders LEFT JOIN i ON o_orderkey = l_orderkey"
)
def mapping_sheet(spark, sf_dir):
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mapping_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("table"), F.concat(F.lit("-"), F.col("l_linenumber").cast("string")).alias("column"))
    return P.mapping_sheet(_mappings(spark, sf_dir), inputs)


@query(
    "SELECT 'core' AS layer, 'orders' AS target_table, '' AS branch, CAST(o_orderkey AS VARCHAR) AS target_column, CASE WHEN o_orderkey % 11 = 0 THEN 'twice' WHEN o_orderkey % 13 = 0 THEN 'changed' END AS change FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 UNION ALL SELECT 'core', 'orders', '', 'ghost' || n_nationkey, 'unknown' FROM nation"
)
def mapping_sheet_import(spark, sf_dir):
    now = _mappings(spark, sf_dir).drop("mapping_id", "target_type")
    k = F.col("target_column").cast("long")
    sheet = now.withColumns({"sql_expression": F.concat(F.lit("'"), "sql_expression"), "notes": F.when(k % 13 == 0, "new").otherwise(F.lit(" "))})
    ghosts = table(spark, sf_dir, "nation").select(F.lit("core").alias("layer"), F.lit("orders").alias("target_table"), F.lit("").alias("branch"), F.concat(F.lit("ghost"), F.col("n_nationkey").cast("string")).alias("target_column"), *[F.lit("x").alias(c) for c in ("transformation_rule", "sql_expression", "mapping_type", "notes")])
    return P.sheet_changes(now, sheet.unionByName(sheet.where(k % 11 == 0)).unionByName(ghosts))


@query(
    "WITH c AS (SELECT c_mktsegment AS layer, 'T' || c_nationkey AS tab, c_acctbal > 0 AS ok, c_custkey % 3 + 1 AS w, 'fix ' || (c_custkey % 4) AS hint FROM customer) SELECT layer, tab AS \"table\", round(100.0 * sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w), 2) AS score, count(*) FILTER (WHERE NOT ok) AS failed, "
    "coalesce(string_agg(DISTINCT hint, '; ' ORDER BY hint) FILTER (WHERE NOT ok), '') AS hints FROM c GROUP BY GROUPING SETS ((layer, tab), (layer), ())"
)
def score_export(spark, sf_dir):
    k = F.col("c_custkey")
    checks = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("layer"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("table"), F.lit("check").alias("check"), (F.col("c_acctbal") > 0).alias("passed"), (k % 3 + 1).cast("double").alias("weight"), F.concat(F.lit("fix "), (k % 4).cast("string")).alias("hint"))
    return P.score_sheet(checks)


_NAMES = (
    "s AS (SELECT s_suppkey AS k FROM supplier), st AS (SELECT unnest(range(0, 6)) AS n), "
    "g AS (SELECT 'core' AS scope, 'sup' || k || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS old, 'sup' || k || '_' || (n + 1) AS new, n AS t FROM s, st WHERE k % 4 = 0 AND n < 5 UNION ALL SELECT 'core', 'sup' || k || '_3', 'other' || k, -10 FROM s WHERE k % 4 = 0 "
    "UNION ALL SELECT 't' || k, 'c3' || CASE WHEN n = 0 THEN '' ELSE '_' || n END, 'c3_' || (n + 1), n FROM s, st)"
)


def _renamed(spark, sf_dir):
    """Suppliers as tables of four columns; tables of every fourth have been renamed five times, a column of each six times."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, sf_dir, "supplier").select(k.alias("k"), F.col("s_suppkey").alias("n"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("at")
    name = lambda stem, i: F.concat(stem, F.when(i == 0, "").otherwise(F.concat(F.lit("_"), i.cast("string"))))
    stem = F.concat(F.lit("sup"), F.col("k"))
    fourth = s.where("n % 4 = 0").select("k", steps).where("at < 5").select(F.lit("core").alias("scope"), name(stem, F.col("at")).alias("from_name"), name(stem, F.col("at") + 1).alias("to_name"), "at")
    # a name that was given up before the chain gave it again
    early = s.where("n % 4 = 0").select(F.lit("core").alias("scope"), F.concat(stem, F.lit("_3")).alias("from_name"), F.concat(F.lit("other"), F.col("k")).alias("to_name"), F.lit(-10).alias("at"))
    third = s.select("k", steps).select(F.concat(F.lit("t"), F.col("k")).alias("scope"), name(F.lit("c3"), F.col("at")).alias("from_name"), name(F.lit("c3"), F.col("at") + 1).alias("to_name"), "at")
    tables = s.select(F.concat(F.lit("t"), F.col("k")).alias("table_id"), F.lit("core").alias("layer"), F.when(F.col("n") % 4 == 0, F.concat(stem, F.lit("_5"))).otherwise(stem).alias("name"), F.when(F.col("n") % 11 == 0, "source_removed").otherwise("present").alias("status"), "n")
    columns = tables.select("table_id", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    columns = columns.select(F.concat("table_id", F.lit(".c"), F.col("i").cast("string")).alias("column_id"), "table_id", F.when(F.col("i") == 3, "c3_6").otherwise(F.concat(F.lit("c"), F.col("i").cast("string"))).alias("name"), F.when((F.col("n") + F.col("i")) % 13 == 0, "source_removed").otherwise("present").alias("status"))
    return fourth.unionByName(early).unionByName(third), tables.drop("n"), columns


@query(
    f"WITH RECURSIVE {_NAMES}, x AS (SELECT a.scope, a.old, a.new, a.t, min(b.t) AS later FROM g a LEFT JOIN g b ON a.scope = b.scope AND a.new = b.old AND b.t > a.t GROUP BY ALL), r(scope, old, t, new, later) AS (SELECT scope, old, t, new, later FROM x UNION ALL SELECT r.scope, r.old, r.t, x.new, x.later FROM r JOIN x ON r.scope = x.scope AND r.new = x.old AND r.later = x.t) "
    "SELECT scope, old AS name, arg_max(new, t) AS now FROM r WHERE later IS NULL GROUP BY scope, old"
)
def names_now(spark, sf_dir):
    """What each name in a log of renames has become."""
    return P.names_now(_renamed(spark, sf_dir)[0])


@query(
    "WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT k, 't' || k AS id, 'sup' || k || CASE WHEN k % 4 = 0 THEN '_5' ELSE '' END AS name FROM s), r AS (SELECT DISTINCT l_suppkey AS k, CASE WHEN l_suppkey % 4 = 0 AND l_linenumber > 1 THEN 'sup' || l_suppkey || '_' || (l_linenumber - 1) ELSE 'sup' || l_suppkey END AS name, l_partkey % 5 AS c, CASE WHEN l_partkey % 5 = 3 THEN 'c3_' || l_linenumber ELSE 'c' || (l_partkey % 5) END AS col FROM lineitem), "
    "m AS (SELECT t.k, t.id, t.name AS shown, r.name, r.c, r.col FROM r JOIN t ON r.k = t.k WHERE NOT regexp_matches(r.name, '_6$')) "
    "SELECT DISTINCT 'table' AS object_type, id AS object_id, 'rename' AS change, name AS old_name, shown AS new_name FROM m WHERE name <> shown UNION ALL SELECT DISTINCT 'table', id, 'removed', NULL, NULL FROM m WHERE k % 11 = 0 "
    "UNION ALL SELECT DISTINCT 'column', id || '.c3', 'rename', col, 'c3_6' FROM m WHERE k % 11 <> 0 AND c = 3 AND col NOT IN ('c3_6', 'c3_7') UNION ALL SELECT DISTINCT 'column', id || '.' || col, 'removed', col, NULL FROM m WHERE k % 11 <> 0 AND (c = 4 OR col = 'c3_7') "
    "UNION ALL SELECT DISTINCT 'column', id || '.c' || c, 'removed', NULL, NULL FROM m WHERE k % 11 <> 0 AND c < 4 AND col <> 'c3_7' AND (k + c) % 13 = 0"
)
def open_impacts(spark, sf_dir):
    """What order lines, as mappings, read of the suppliers' tables under names that these no longer have."""
    renames, tables, columns = _renamed(spark, sf_dir)
    k, n, c = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey") % 5
    name = F.concat(F.lit("SUP"), k.cast("string"), F.when((k % 4 == 0) & (n > 1), F.concat(F.lit("_"), (n - 1).cast("string"))).otherwise(""))
    column = F.when(c == 3, F.concat(F.lit("C3_"), n.cast("string"))).otherwise(F.concat(F.lit("C"), c.cast("string")))
    return P.open_impacts(table(spark, sf_dir, "lineitem").select(F.lit("core").alias("layer"), name.alias("table"), column.alias("column")), tables, columns, renames)


@query(
    "SELECT 'S' || (p_partkey % 4) AS schema, 'T' || (p_partkey % 37) AS \"table\", CASE WHEN p_partkey % 9 = 0 THEN chr(39) || '=' || p_name ELSE p_name END AS \"column\", p_type AS data_type, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS nullable, CASE WHEN p_size % 7 = 0 THEN 'true' ELSE 'false' END AS is_key, "
    "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN chr(39) || '-' || p_brand ELSE p_brand END AS description FROM part"
)
def data_dictionary(spark, sf_dir):
    """Parts as columns of a data dictionary, some of them with names or descriptions that a spreadsheet would run."""
    k, z = F.col("p_partkey"), F.col("p_size")
    columns = table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), (k % 4).cast("string")).alias("schema"), F.concat(F.lit("T"), (k % 37).cast("string")).alias("table"), F.concat(F.when(k % 9 == 0, "=").otherwise(""), "p_name").alias("column"), F.col("p_type").alias("data_type"),
        (z % 2 == 0).alias("nullable"), (z % 7 == 0).alias("is_key"), F.when(k % 5 != 0, F.concat(F.when(k % 5 == 1, "-").otherwise(""), "p_brand")).alias("description"),
    )
    return P.data_dictionary(columns)
