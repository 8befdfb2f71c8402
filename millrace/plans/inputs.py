"""Queries on sources, sheets and the guarded SELECT."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import json_schema, validators
from millrace.operators import guard
from millrace.plans.base import Book
from millrace.session import table
from millrace.sources import files, schema_import, sinks

book = Book()
query = book.query


@query(
    r'''SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '''
    r''''<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_hash FROM pages'''
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(files.html_text(F.col("html"))).alias("text_hash"))


_SHEETS = "t AS (SELECT p_partkey % 500 AS t FROM part), c AS (SELECT l_partkey % 520 AS t, l_suppkey % 40 AS c FROM lineitem), k AS (SELECT o_orderkey AS n, o_orderkey % 500 AS t, o_custkey % 45 AS c, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 530 END AS rt, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS rn FROM orders)"


@query(
    f"WITH {_SHEETS}, kt AS (SELECT DISTINCT t FROM t), kc AS (SELECT DISTINCT t, c FROM c) SELECT 'duplicate_table' AS problem, 't' || t AS object FROM t GROUP BY t HAVING count(*) > 1 UNION ALL SELECT 'duplicate_column', 't' || t || '.c' || c FROM c GROUP BY t, c HAVING count(*) > 1 UNION ALL SELECT 'unknown_table', 't' || t || '.c' || c FROM c WHERE t NOT IN (SELECT t FROM kt) "
    "UNION ALL SELECT 'unknown_reference', 'k' || n FROM k WHERE rt NOT IN (SELECT t FROM kt) UNION ALL SELECT 'reference_arity', 'k' || n FROM k WHERE rt IS NOT NULL AND rn = 2 UNION ALL SELECT 'unknown_column', 'k' || n FROM k WHERE (t, c) NOT IN (SELECT (t, c) FROM kc)"
)
def schema_import_of_parts(spark, sf_dir):
    """The checks on sheets as large as the tables."""
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    tables = table(spark, sf_dir, "part").select(named("t", F.col("p_partkey") % 500).alias("table"))
    columns = table(spark, sf_dir, "lineitem").select(named("t", F.col("l_partkey") % 520).alias("table"), named("c", F.col("l_suppkey") % 40).alias("column"))
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    constraints = o.select(named("t", k % 500).alias("table"), named("k", k).alias("name"), named("c", F.col("o_custkey") % 45).alias("columns"), F.when(k % 2 == 0, named("t", F.col("o_custkey") % 530)).alias("ref_table"), F.when(k % 6 == 0, "a,b").otherwise("a").alias("ref_columns"))
    return files.schema_problems(tables, columns, constraints)


@query(
    "WITH f AS (SELECT o_orderpriority AS category, CASE WHEN o_custkey % 3 = 0 THEN '=' ELSE '' END || 'c' || (o_custkey % 11) AS c, 'r' || (o_orderkey % 5) AS r FROM orders), g AS (SELECT category, string_agg(DISTINCT c, '; ' ORDER BY c) AS columns, string_agg(DISTINCT r, '; ' ORDER BY r) AS rules FROM f GROUP BY 1) "
    "SELECT category, CASE WHEN columns LIKE '=%' THEN chr(39) || columns ELSE columns END AS columns, rules FROM g"
)
def pii_inventory_of_orders(spark, sf_dir):
    k = F.col("o_custkey")
    column = F.concat(F.when(k % 3 == 0, "=").otherwise(""), F.lit("c"), (k % 11).cast("string"))
    return sinks.pii_inventory(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), column.alias("column"), F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string")).alias("rule")))


_GUARDED = "SELECT c_mktsegment, upper(c_name) AS shouted, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL GROUP BY c_mktsegment, c_name HAVING count(*) > 0 ORDER BY c_mktsegment, c_name LIMIT 50"


@query("SELECT c_mktsegment, '[MASKED]' AS shouted, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY 1 LIMIT 50")
def guarded_select(spark, sf_dir):
    """A protected column is masked before the statement runs, so also where it groups; counts stay readable."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "nation")}
    return guard.run(spark, _GUARDED, tables, {("customer", "c_name")})


@query("SELECT n_name AS name FROM nation UNION ALL SELECT '[masked]' FROM customer")
def guarded_union(spark, sf_dir):
    """A protected column in a later branch of a set operation is masked as well."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "nation")}
    return guard.run(spark, "SELECT n_name AS name FROM nation UNION ALL SELECT c_name FROM customer", tables, {("customer", "c_name")}, cap=10**9)


@query("SELECT DISTINCT '[masked]' AS most FROM nation")
def guarded_subquery(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "nation")}
    return guard.run(spark, "SELECT DISTINCT (SELECT max(c_name) FROM customer) AS most FROM nation", tables, {("customer", "c_name")})


_VERDICTS = [
    ("SELECT c_name FROM customer", True), ("SELECT c_name FROM customer; DROP TABLE customer", False), ("INSERT INTO customer SELECT * FROM customer", False), ("SELECT * FROM customer NATURAL JOIN nation", False),
    ("SELECT * FROM secrets", False), ("SELECT reflect('java.lang.Runtime', 'getRuntime')", False), ("WITH t AS (SELECT c_custkey AS k FROM customer) SELECT count(*) FROM t", True), ("SELECT c_name FROM customer LIMIT 5", True),
    ("SELECT sum(c_acctbal) OVER (PARTITION BY c_nationkey) FROM customer", True), ("SELECT c_custkey FROM customer UNION ALL SELECT n_nationkey FROM nation", True), ("SELECT /*+ BROADCAST(customer) */ c_name FROM customer", False),
    ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT n_nationkey FROM nation)", True), ("SELECT no_such FROM customer", False), ("SELECT k FROM secrets /* secrets as ( */", False), ("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT k FROM secrets)", False), ("SELECT (SELECT max(k) FROM secrets) FROM nation", False),
    ("SELECT k FROM secrets UNION ALL (WITH secrets AS (SELECT 1 AS k) SELECT k FROM secrets)", False), ("SELECT c_name FROM customer GROUP BY ROLLUP (c_name)", False), ("", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).upper()})" for i, (_, ok) in enumerate(_VERDICTS)) + ") t(case_no, accepted)")
def guard_verdicts(spark, sf_dir):
    for t in ("customer", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.createDataFrame([(i, guard.accepts(spark, sql, {"customer", "nation"})) for i, (sql, _) in enumerate(_VERDICTS)], "case_no int, accepted boolean")


_PROPS = {"type": "object", "properties": {"k": {"anyOf": [{"$ref": "#/$defs/small"}, {"type": "integer", "minimum": 90}]}}, "required": ["k"], "additionalProperties": False, "$defs": {"small": {"type": "integer", "minimum": 10, "maximum": 50}}}


@query("WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN k BETWEEN 10 AND 50 OR k >= 90 THEN '' ELSE 'props.k: does not match any allowed form' END AS problems FROM k")
def event_properties(spark, sf_dir):
    """Properties of all events held against a schema with a choice of two ranges."""
    found = json_schema.violations(F.col("props"), _PROPS, "props")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, "; ").alias("problems"))


_LINES = {"type": "array", "maxItems": 3, "items": {"type": "string", "maxLength": 200}}
_TURN = {"type": "object", "properties": {"role": {"enum": ["user", "assistant"]}, "turn": {"$ref": "#/$defs/count"}, "lines": _LINES}, "required": ["role", "turn", "lines", "tool"], "additionalProperties": {"type": "null"}, "$defs": {"count": {"type": "integer", "maximum": 2}}}


@query(
    "WITH l AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS lines FROM conversations) SELECT conv_id, turn, array_to_string(list_concat(['args.tool: is required'], CASE WHEN role NOT IN ('user', 'assistant') THEN ['args.role: must be one of ''user'', ''assistant'''] ELSE [] END, CASE WHEN turn > 2 THEN ['args.turn: is above the maximum 2'] ELSE [] END, "
    "CASE WHEN len(lines) > 3 THEN ['args.lines: has too many items'] ELSE [] END, list_transform(list_filter(range(1, len(lines) + 1), lambda i: length(lines[i]) > 200), lambda i: 'args.lines[' || (i - 1) || ']: is too long'), CASE WHEN turn % 2 = 1 THEN ['args.odd: must be of type null'] ELSE [] END), '; ') AS problems FROM l"
)
def conversation_arguments(spark, sf_dir):
    """Every turn as the arguments of a call, which lack one, have bad roles, long lines and a property too many."""
    made = F.to_json(F.struct("role", "turn", F.split("text", "\n", -1).alias("lines"), F.when(F.col("turn") % 2 == 1, F.lit(True)).alias("odd")))
    found = json_schema.violations(made, _TURN, "args")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, "; ").alias("problems"))


_FULL = (
    "WITH t0 AS (SELECT p_partkey AS n, p_partkey % 300 AS t, CASE p_size % 9 WHEN 0 THEN 'matview' WHEN 1 THEN NULL WHEN 2 THEN 'VIEW' WHEN 3 THEN 'view' ELSE 'table' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'SELECT 1' END AS def, CASE WHEN p_partkey % 31 = 0 THEN 'many' WHEN p_partkey % 3 = 0 THEN '12' END AS cnt FROM part), "
    "t1 AS (SELECT *, lower(kind) IN ('table', 'view') AS ok FROM t0), t2 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n) AS k FROM t1 WHERE ok), tt AS (SELECT *, lower(kind) AS low FROM t2 WHERE k = 1), "
    "c0 AS (SELECT o_orderkey AS n, o_custkey % 320 AS t, 'c' || (o_orderkey % 12) AS c, CASE WHEN o_orderkey % 50 > 0 THEN 'int' END AS ty, CASE WHEN o_orderkey % 40 = 0 THEN '0' WHEN o_orderkey % 2 = 0 THEN '3' END AS o, CASE WHEN o_orderkey % 45 = 0 THEN 'maybe' WHEN o_orderkey % 7 = 0 THEN 'No' END AS nu FROM orders), "
    "c1 AS (SELECT * FROM c0 WHERE ty IS NOT NULL), c2 AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY n) AS k FROM c1 WHERE t IN (SELECT t FROM tt)), cc AS (SELECT * FROM c2 WHERE k = 1), "
    "k0 AS (SELECT c_custkey AS n, c_custkey % 310 AS t, 'k' || (c_custkey % 3) AS name, ['pk', 'FK', 'fk', 'unique', 'check'][c_custkey % 5 + 1] AS ty, CASE WHEN c_custkey % 11 = 0 THEN ['c1', 'c99'] ELSE ['c' || (c_custkey % 12)] END AS cols, CASE WHEN c_custkey % 13 > 0 THEN c_custkey * 7 % 330 END AS rt, CASE WHEN c_custkey % 6 = 0 THEN ['c2', 'c3'] ELSE ['c' || (c_custkey % 14)] END AS rc FROM customer), "
    "k1 AS (SELECT *, lower(ty) AS low FROM k0 WHERE t IN (SELECT t FROM tt)), k2 AS (SELECT *, row_number() OVER (PARTITION BY t, name ORDER BY n) AS k FROM k1 WHERE low <> 'check'), cl AS (SELECT t AS lt, list(c) AS have FROM cc GROUP BY t), k3 AS (SELECT k2.*, list_filter(cols, lambda x: NOT list_contains(coalesce(have, []), x)) AS gone FROM k2 LEFT JOIN cl ON t = lt WHERE k = 1), "
    "k4 AS (SELECT * FROM k3 WHERE len(gone) = 0), k5 AS (SELECT * FROM k4 WHERE NOT (low = 'fk' AND rt IS NULL)), k6 AS (SELECT k5.*, coalesce(rt IN (SELECT t FROM tt), FALSE) AS there, list_filter(rc, lambda x: NOT list_contains(coalesce(have, []), x)) AS lost FROM k5 LEFT JOIN cl ON rt = lt WHERE NOT (low = 'fk' AND len(rc) <> len(cols)))"
)


def _sheets(spark, sf_dir):
    """Parts as tables, orders as columns, customers as constraints of an import, with everything wrong that can be."""
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    at = lambda x: (text("s", x % 3).alias("schema"), text("t", x).alias("table"))
    p, z, o, c, u = F.col("p_partkey"), F.col("p_size"), F.col("o_orderkey"), F.col("o_custkey") % 320, F.col("c_custkey")
    kind = F.when(z % 9 == 0, "matview").when(z % 9 == 2, "VIEW").when(z % 9 == 3, "view").when(z % 9 != 1, "table")
    tables = table(spark, sf_dir, "part").select(p.cast("int").alias("row"), *at(p % 300), kind.alias("kind"), F.when(p % 31 == 0, "many").when(p % 3 == 0, "12").alias("row_count"), F.lit(None).cast("string").alias("comment"), F.when(p % 4 == 0, "SELECT 1").alias("definition"))
    nothing = F.lit(None).cast("string")
    columns = table(spark, sf_dir, "orders").select(o.cast("int").alias("row"), *at(c), text("c", o % 12).alias("column"), F.when(o % 50 > 0, "int").alias("data_type"), F.when(o % 40 == 0, "0").when(o % 2 == 0, "3").alias("ordinal"), F.when(o % 45 == 0, "maybe").when(o % 7 == 0, "No").alias("is_nullable"), nothing.alias("default"), nothing.alias("comment"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("pk", "FK", "fk", "unique", "check")]), (u % 5 + 1).cast("int"))
    ref = F.when(u % 13 > 0, u * 7 % 330)
    constraints = table(spark, sf_dir, "customer").select(
        u.cast("int").alias("row"), *at(u % 310), text("k", u % 3).alias("constraint"), kinds.alias("type"), F.when(u % 11 == 0, "c1, c99").otherwise(text("c", u % 12)).alias("columns"), text("s", ref % 3).alias("ref_schema"), text("t", ref).alias("ref_table"), F.when(u % 6 == 0, "c2,c3").otherwise(text("c", u % 14)).alias("ref_columns"),
    )
    return {"tables": tables, "columns": columns, "constraints": constraints}


@query(
    f"{_FULL} SELECT 'tables' AS sheet, n AS row, 'error' AS severity, 'empty' AS code, 'kind' AS object FROM t0 WHERE kind IS NULL UNION ALL SELECT 'tables', n, 'error', 'kind_unknown', lower(kind) FROM t1 WHERE kind IS NOT NULL AND NOT ok UNION ALL SELECT 'tables', n, 'error', 'listed_twice', 's' || (t % 3) || '.t' || t FROM t2 WHERE k > 1 "
    "UNION ALL SELECT 'tables', n, 'warning', 'view_without_definition', 's' || (t % 3) || '.t' || t FROM tt WHERE low = 'view' AND def IS NULL UNION ALL SELECT 'tables', n, 'warning', 'definition_ignored', 's' || (t % 3) || '.t' || t FROM tt WHERE low = 'table' AND def IS NOT NULL UNION ALL SELECT 'tables', n, 'error', 'not_a_number', cnt FROM tt WHERE cnt = 'many' "
    "UNION ALL SELECT 'columns', n, 'error', 'empty', 'data_type' FROM c0 WHERE ty IS NULL UNION ALL SELECT 'columns', n, 'error', 'unknown_table', 's' || (t % 3) || '.t' || t FROM c1 WHERE t NOT IN (SELECT t FROM tt) UNION ALL SELECT 'columns', n, 'error', 'listed_twice', 't' || t || '.' || c FROM c2 WHERE k > 1 UNION ALL SELECT 'columns', n, 'error', 'not_a_number', o FROM cc WHERE o = '0' "
    "UNION ALL SELECT 'columns', n, 'error', 'not_a_flag', nu FROM cc WHERE nu = 'maybe' UNION ALL SELECT 'columns', NULL, 'warning', 'table_without_columns', 's' || (t % 3) || '.t' || t FROM tt WHERE t NOT IN (SELECT t FROM cc) "
    "UNION ALL SELECT 'constraints', n, 'error', 'unknown_table', 's' || (t % 3) || '.t' || t FROM k0 WHERE t NOT IN (SELECT t FROM tt) UNION ALL SELECT 'constraints', n, 'error', 'type_unknown', 'check' FROM k1 WHERE low = 'check' UNION ALL SELECT 'constraints', n, 'error', 'listed_twice', 't' || t || '.' || name FROM k2 WHERE k > 1 UNION ALL SELECT 'constraints', n, 'error', 'unknown_columns', name || ': ' || array_to_string(gone, ', ') FROM k3 WHERE len(gone) > 0 "
    "UNION ALL SELECT 'constraints', n, 'error', 'no_reference', name FROM k4 WHERE low = 'fk' AND rt IS NULL UNION ALL SELECT 'constraints', n, 'error', 'reference_arity', name FROM k5 WHERE low = 'fk' AND len(rc) <> len(cols) UNION ALL SELECT 'constraints', n, 'warning', 'reference_outside', name || ': t' || rt FROM k6 WHERE low = 'fk' AND NOT there UNION ALL SELECT 'constraints', n, 'error', 'unknown_reference_columns', name || ': ' || array_to_string(lost, ', ') FROM k6 WHERE low = 'fk' AND there AND len(lost) > 0"
)
def import_issues(spark, sf_dir):
    """What is wrong with the sheets, errors and warnings."""
    return schema_import.checked(_sheets(spark, sf_dir))[1]


@query(
    f"{_FULL}, ks AS (SELECT * FROM k6 WHERE NOT (low = 'fk' AND there AND len(lost) > 0)), pk AS (SELECT DISTINCT t, unnest(cols) AS c FROM ks WHERE low = 'pk') SELECT 's' || (cc.t % 3) AS schema, 't' || cc.t AS \"table\", cc.c AS \"column\", CAST(coalesce(TRY_CAST(o AS INTEGER), row_number() OVER (PARTITION BY cc.t ORDER BY TRY_CAST(o AS INTEGER) NULLS LAST, n)) AS INTEGER) AS ordinal, "
    "CASE WHEN nu IS NULL THEN TRUE WHEN nu = 'No' THEN FALSE END AS is_nullable, pk.c IS NOT NULL AS is_pk FROM cc LEFT JOIN pk ON cc.t = pk.t AND cc.c = pk.c"
)
def imported_columns(spark, sf_dir):
    """The columns of the catalog that the sheets describe, with their keys."""
    return schema_import.checked(_sheets(spark, sf_dir))[0]["columns"].select("schema", "table", "column", "ordinal", "is_nullable", "is_pk")


_MAILS = "WITH m AS (SELECT c_custkey, concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.org') AS mail, c_nationkey FROM customer) SELECT m.c_custkey AS k, upper(m.mail) AS contact, n_name, (SELECT max(n_name) FROM nation) AS last FROM m JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey > 0"


@query("SELECT 'customer.' || c AS column_name, 'email' AS rule FROM (SELECT unnest(['c_name', 'c_mktsegment']) AS c) WHERE (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) > 0")
def findings_behind_a_query(spark, sf_dir):
    """The columns behind an output that turns out to hold addresses."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "nation")}
    strong = {k: check for k, (_, weight, check) in validators.VALIDATORS.items() if weight == 1.0}
    return guard.recorded(spark, _MAILS, tables, strong, {})
