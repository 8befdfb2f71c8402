"""Queries on the rules of a warehouse model. The model's metadata is made from the driver's tables, a row for each part,
supplier or order, so that the rules run over tables of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import validators as V
from millrace.operators import modelling as M
from millrace.operators.formulas import checked_formulas
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_TYPES = "['direct', 'hashed', 'derived', 'constant', 'lookup', 'system', 'not_in_branch', 'unmapped', 'odd']"
_MAPPED = f"m AS (SELECT p_partkey AS column_id, {_TYPES}[p_partkey % 9 + 1] AS t, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS sql, CASE WHEN p_size % 3 = 0 THEN 'sk' ELSE 'attribute' END AS role, p_partkey % 5 = 0 AS in_branch FROM part)"


def _mappings(spark, sf_dir):
    types = F.array(*[F.lit(t) for t in (*M.MAPPING_TYPES, "odd")])
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("column_id"), F.element_at(types, (k % 9 + 1).cast("int")).alias("mapping_type"), F.when(size % 2 == 0, F.col("p_name")).otherwise("").alias("sql"), F.when(size % 3 == 0, "sk").otherwise("attribute").alias("role"), (k % 5 == 0).alias("in_branch"),
        F.when(k % 2 == 0, "core").otherwise("mart").alias("layer"),
    )


@query(
    f"WITH {_MAPPED} SELECT column_id, 'hashed_by_hand' AS problem FROM m WHERE t = 'hashed' UNION ALL SELECT column_id, 'type_not_allowed' FROM m WHERE t = 'odd' OR (t = 'not_in_branch' AND NOT in_branch) UNION ALL SELECT column_id, 'sql_not_allowed' FROM m WHERE t IN ('unmapped', 'not_in_branch', 'lookup', 'system') AND sql <> '' "
    "UNION ALL SELECT column_id, 'sql_missing' FROM m WHERE t IN ('direct', 'derived', 'constant') AND sql = '' UNION ALL SELECT column_id, 'not_a_system_column' FROM m WHERE t = 'system' AND (in_branch OR role <> 'sk')"
)
def mapping_type_rules(spark, sf_dir):
    return M.mapping_problems(_mappings(spark, sf_dir))


@query(
    "WITH l AS (SELECT o_orderkey AS column_id, CASE WHEN o_orderkey % 7 = 0 THEN 'mart' ELSE 'core' END AS layer, o_custkey % 40 AS dim, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'o.day' WHEN o_orderkey % 11 = 0 THEN 'day' END AS as_of FROM orders), d AS (SELECT n_nationkey AS id, n_regionkey AS scd, n_nationkey % 3 AS keys FROM nation), "
    "j AS (SELECT * FROM l LEFT JOIN d ON dim = id) SELECT column_id, 'not_a_core_foreign_key' AS problem FROM j WHERE layer <> 'core' OR id IS NULL UNION ALL SELECT column_id, 'no_key_inputs' FROM j WHERE n = 0 UNION ALL SELECT column_id, 'key_count' FROM j WHERE n > 0 AND id IS NOT NULL AND n <> keys "
    "UNION ALL SELECT column_id, 'input_not_a_column' FROM j WHERE as_of = 'day' UNION ALL SELECT column_id, 'no_as_of' FROM j WHERE scd = 2 AND as_of IS NULL"
)
def lookup_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    inputs = F.transform(F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("o.k"), i.cast("string")))
    lookups = table(spark, sf_dir, "orders").select(
        k.alias("column_id"), F.when(k % 7 == 0, "mart").otherwise("core").alias("layer"), F.lit("fk").alias("role"), (F.col("o_custkey") % 40).alias("dimension_id"), inputs.alias("nk_inputs"), F.when(k % 3 == 0, "o.day").when(k % 11 == 0, "day").alias("as_of")
    )
    n = table(spark, sf_dir, "nation")
    keys = n.where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("table_id"), F.explode(F.sequence(F.lit(1), (F.col("n_nationkey") % 3).cast("int")))).select("table_id", F.lit("nk").alias("role"), F.lit(False).alias("is_system"))
    return M.lookup_problems(lookups, n.select(F.col("n_nationkey").alias("table_id"), F.col("n_regionkey").alias("scd_type")), keys)


_LINES = "r AS (SELECT DISTINCT l_orderkey AS mapping_id, CASE WHEN l_orderkey % 2 = 0 THEN 'core' ELSE 'mart' END AS layer, CASE WHEN l_suppkey % 9 > 0 THEN 'T' || (l_suppkey % 5) END AS tab, 'C' || CASE WHEN l_partkey % 7 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS col, CASE WHEN l_linenumber % 2 = 0 THEN 'uses' ELSE 'value' END AS use FROM lineitem)"
_COLUMNS = "c AS (SELECT s_suppkey AS input_id, CASE WHEN s_suppkey % 2 = 0 THEN 'staging' ELSE 'core' END AS cl, 't' || (s_suppkey % 5) AS ct, 'c' || s_suppkey AS cc FROM supplier)"
_RESOLVED = f"WITH {_LINES}, {_COLUMNS}, j AS (SELECT r.*, input_id FROM r LEFT JOIN c ON cl = CASE WHEN layer = 'core' THEN 'staging' ELSE 'core' END AND ct = lower(tab) AND cc = lower(col))"


def _resolved(spark, sf_dir):
    k = F.col("l_orderkey")
    refs = table(spark, sf_dir, "lineitem").select(
        k.alias("mapping_id"), F.when(k % 2 == 0, "core").otherwise("mart").alias("layer"), F.when(F.col("l_suppkey") % 9 > 0, F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string"))).alias("table"),
        F.concat(F.lit("C"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_suppkey") + 1000000).otherwise(F.col("l_suppkey")).cast("string")).alias("column"), F.when(F.col("l_linenumber") % 2 == 0, "uses").otherwise("value").alias("use"),
    ).distinct()
    s = F.col("s_suppkey")
    columns = table(spark, sf_dir, "supplier").select(s.alias("column_id"), F.when(s % 2 == 0, "staging").otherwise("core").alias("layer"), F.concat(F.lit("t"), (s % 5).cast("string")).alias("table"), F.concat(F.lit("c"), s.cast("string")).alias("column"))
    return M.resolved_inputs(refs, columns)


@query(f"{_RESOLVED} SELECT mapping_id, tab AS \"table\", col AS \"column\", use, input_id, CASE WHEN tab IS NULL THEN 'unqualified' WHEN input_id IS NULL THEN 'unknown_input' END AS problem FROM j")
def input_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).drop("layer")


@query(
    f"{_RESOLVED} SELECT DISTINCT mapping_id, use AS kind, input_id AS source, CASE WHEN use = 'value' THEN mapping_id * 10 ELSE mapping_id % 100 END AS target FROM j WHERE input_id IS NOT NULL AND tab IS NOT NULL UNION SELECT o_orderkey, 'lookup', o_orderkey * 10, o_custkey FROM orders WHERE o_orderkey % 10 = 0"
)
def edge_derivation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    targets = o.select(F.col("o_orderkey").alias("mapping_id"), (F.col("o_orderkey") * 10).alias("column_id"), (F.col("o_orderkey") % 100).alias("table_id"))
    lookups = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("mapping_id"), F.col("o_custkey").alias("dimension_id"))
    return M.mapping_edges(_resolved(spark, sf_dir), targets, lookups)


_FINDINGS = "f AS (SELECT o_custkey AS column_id, o_orderpriority AS category, ['suggested', 'accepted', 'rejected'][o_orderkey % 3 + 1] AS status FROM orders)"


def _findings(spark, sf_dir):
    status = F.element_at(F.array(F.lit("suggested"), F.lit("accepted"), F.lit("rejected")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("column_id"), F.col("o_orderpriority").alias("category"), status.alias("status"))


@query(f"WITH {_FINDINGS} SELECT c_custkey AS column_id, c_custkey % 50 = 0 OR c_custkey IN (SELECT column_id FROM f WHERE status <> 'rejected') AS protected FROM customer")
def protected_policy(spark, sf_dir):
    columns = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("column_id"), (F.col("c_custkey") % 50 == 0).alias("is_sensitive"))
    return M.protected_columns(columns, _findings(spark, sf_dir)).select("column_id", "protected")


@query(f"WITH {_FINDINGS} SELECT column_id, category, status FROM f WHERE status <> 'rejected' AND column_id IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)")
def new_suspected_columns(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("column_id"), "c_nationkey")
    return M.new_suspected(new.where("c_nationkey % 2 = 1"), new, _findings(spark, sf_dir))


_ITEMS = "e AS (SELECT p_partkey AS item, unnest([p_partkey // 2, p_partkey // 3]) AS dep FROM part WHERE p_partkey > 0)"


def _items(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k > 0).select(k.alias("item"), F.array(F.floor(k / 2), F.floor(k / 3)).alias("depends_on"))


@query(f"WITH RECURSIVE {_ITEMS}, r(item) AS (SELECT 9::BIGINT UNION SELECT e.item FROM r JOIN e ON e.dep = r.item) SELECT item FROM r")
def change_dependents(spark, sf_dir):
    return M.closure_of_items(_items(spark, sf_dir), spark.createDataFrame([(9,)], "item long"), dependents=True)


@query(f"WITH RECURSIVE {_ITEMS}, r(item) AS (SELECT max(item) FROM e UNION SELECT e.dep FROM r JOIN e ON e.item = r.item) SELECT item FROM r")
def change_dependencies(spark, sf_dir):
    items = _items(spark, sf_dir)
    return M.closure_of_items(items, items.agg(F.max("item").alias("item")), dependents=False)


@query(
    "WITH m AS (SELECT l_orderkey AS kpi, count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)) AS gone, count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 9)) AS bare FROM lineitem GROUP BY 1) "
    "SELECT kpi, CASE WHEN gone > 0 THEN 'needs_data' WHEN bare > 0 THEN 'needs_mapping' ELSE 'computable' END AS feasibility FROM m"
)
def kpi_feasibility(spark, sf_dir):
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kpi"), F.col("l_partkey").alias("column_id"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("column_id"), "p_size")
    return M.feasibility(inputs, p.where("p_size > 3"), p.where("p_size > 9"))


_LAYERED = "c AS (SELECT p_partkey AS id, ['staging', 'core', 'mart'][p_partkey % 3 + 1] AS layer FROM part), e AS (SELECT p_partkey // 2 AS s, p_partkey AS t, p_size FROM part)"


def _layered(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    columns = p.select(k.alias("column_id"), F.element_at(F.array(F.lit("staging"), F.lit("core"), F.lit("mart")), (k % 3 + 1).cast("int")).alias("layer"))
    edges = p.select(F.floor(k / 2).alias("source"), k.alias("target"), F.when(F.col("p_size") % 4 > 0, "value").otherwise("uses").alias("kind"), F.when(F.col("p_size") % 4 > 1, "direct").otherwise("derived").alias("mapping_type"))
    return columns, edges


@query(
    f"WITH {_LAYERED}, l AS (SELECT DISTINCT l_orderkey AS kpi, l_partkey * 2 AS id FROM lineitem), r AS (SELECT s FROM e JOIN c ON t = id WHERE layer = 'mart' AND p_size % 4 > 0) SELECT kpi, l.id AS column_id, CASE WHEN layer IS NULL OR layer = 'staging' THEN 'not_in_core_or_mart' ELSE 'read_by_mart' END AS problem "
    "FROM l LEFT JOIN c ON l.id = c.id WHERE layer IS NULL OR layer = 'staging' OR (layer = 'core' AND l.id IN (SELECT s FROM r))"
)
def kpi_link_rules(spark, sf_dir):
    columns, edges = _layered(spark, sf_dir)
    return M.refused_links(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kpi"), (F.col("l_partkey") * 2).alias("column_id")).distinct(), columns, edges)


@query(
    f"WITH {_LAYERED}, l AS (SELECT DISTINCT l_orderkey AS kpi, l_partkey AS id FROM lineitem), u AS (SELECT s, min(t) AS up FROM e JOIN c ON t = id WHERE layer = 'mart' AND p_size % 4 > 1 GROUP BY s) "
    "SELECT DISTINCT kpi, CASE WHEN layer = 'core' AND up IS NOT NULL THEN up ELSE l.id END AS column_id FROM l LEFT JOIN c ON l.id = c.id LEFT JOIN u ON l.id = s"
)
def kpi_repoint(spark, sf_dir):
    columns, edges = _layered(spark, sf_dir)
    return M.repointed_links(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("kpi"), F.col("l_partkey").alias("column_id")).distinct(), edges, columns)


@query(
    f"WITH {_MAPPED}, x AS (SELECT CASE WHEN column_id % 2 = 0 THEN 'core' ELSE 'mart' END AS layer, count(*) AS columns, count(*) FILTER (WHERE t <> 'unmapped') AS mapped FROM m GROUP BY 1) SELECT *, CASE WHEN mapped = 0 THEN 'not_started' WHEN mapped < columns THEN 'in_progress' ELSE 'complete' END AS progress FROM x"
)
def layer_progress(spark, sf_dir):
    m = _mappings(spark, sf_dir)
    return M.layer_progress(m.select("column_id", "layer"), m.select("column_id", "mapping_type"))


@query("SELECT 'first_email' AS column_name, 'email' AS rule FROM (SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[a-z0-9]+@[a-z0-9]+\\.[a-z]+')) WHERE n > 0")
def values_at_query(spark, sf_dir):
    """Columns of a result that show personal data in their values: what a result is masked by."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(F.regexp_extract("text", r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", 0), F.lit("")).alias("first_email"))
    strong = {k: check for k, (_, weight, check) in V.VALIDATORS.items() if weight == 1.0 and k in ("email", "iban", "card_number")}
    return M.personal_columns(docs, strong, {k: V.VALIDATORS[k][2] for k in ("commercial_registration", "birth_date")})


_ITEMS = "i AS (SELECT o_orderkey // 10 AS change_set, o_orderkey AS item, o_orderkey % 10 AS pos, CASE o_custkey % 11 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' WHEN 2 THEN 'needs_owner' ELSE 'pending' END AS status, o_custkey % 13 = 0 AS owner_only, o_custkey % 17 = 0 AS stale, o_custkey AS k FROM orders)"
_DEPENDS = "d AS (SELECT item, item - 1 AS dep FROM i WHERE pos > 0 AND k % 3 <> 0 UNION SELECT item, item - 3 FROM i WHERE pos >= 3 AND k % 5 = 0 UNION SELECT item, item + 2 FROM i WHERE pos = 0 AND change_set % 20 = 0 UNION SELECT item, -1 FROM i WHERE k % 97 = 5)"


def _set_items(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pos, change_set = k % 10, F.floor(k / 10)
    status = F.when(c % 11 == 0, "rejected").when(c % 11 == 1, "accepted").when(c % 11 == 2, "needs_owner").otherwise("pending")
    depends = F.array(F.when((pos > 0) & (c % 3 != 0), k - 1), F.when((pos >= 3) & (c % 5 == 0), k - 3), F.when((pos == 0) & (change_set % 20 == 0), k + 2), F.when(c % 97 == 5, F.lit(-1).cast("long")))
    return o.select(change_set.alias("change_set"), k.alias("item"), F.array_compact(depends).alias("depends_on"), status.alias("status"), F.when(c % 13 == 0, "owner").otherwise("member").alias("required_role"), (c % 17 == 0).alias("stale"))


_DECIDED = (
    f"WITH RECURSIVE {_ITEMS}, {_DEPENDS}, tc(item, dep) AS (SELECT item, dep FROM d UNION SELECT tc.item, d.dep FROM tc JOIN d ON tc.dep = d.item), o AS (SELECT item FROM i WHERE status IN ('pending', 'needs_owner')), s AS (SELECT item FROM i WHERE item % 4 <> 1), "
    "c AS (SELECT item FROM o WHERE item IN (SELECT item FROM s) OR item IN (SELECT dep FROM tc WHERE item IN (SELECT item FROM s))), ow AS (SELECT c.item FROM c JOIN i ON c.item = i.item WHERE owner_only), w AS (SELECT item FROM c WHERE item IN (SELECT item FROM ow) OR item IN (SELECT item FROM tc WHERE dep IN (SELECT item FROM ow))), "
    "n AS (SELECT item FROM c WHERE item NOT IN (SELECT item FROM w)), cy AS (SELECT item FROM tc WHERE item = dep), "
    "b AS (SELECT n.item, CASE WHEN n.item IN (SELECT item FROM cy) OR n.item IN (SELECT item FROM tc WHERE dep IN (SELECT item FROM cy)) THEN 'cycle' WHEN n.item IN (SELECT d.item FROM d LEFT JOIN i ON d.dep = i.item WHERE coalesce(i.status, 'missing') NOT IN ('accepted', 'pending', 'needs_owner')) THEN 'not_applied' WHEN i.stale THEN 'stale' END AS why FROM n JOIN i ON n.item = i.item), "
    "nt(item, dep) AS (SELECT item, dep FROM d WHERE item IN (SELECT item FROM n) AND dep IN (SELECT item FROM n) UNION SELECT nt.item, d.dep FROM nt JOIN d ON nt.dep = d.item WHERE d.dep IN (SELECT item FROM n)), "
    "k AS (SELECT item, why FROM b WHERE why IS NOT NULL UNION ALL SELECT item, 'depends_on_skipped' FROM b WHERE why IS NULL AND item IN (SELECT item FROM nt WHERE dep IN (SELECT item FROM b WHERE why IS NOT NULL))), "
    "f AS (SELECT change_set, i.item, CASE WHEN w.item IS NOT NULL THEN CASE WHEN owner_only THEN 'needs_owner' ELSE 'pending' END WHEN k.item IS NOT NULL THEN 'stale' WHEN n.item IS NOT NULL THEN 'accepted' ELSE status END AS status, k.why AS reason, w.item IS NOT NULL AS waits FROM i LEFT JOIN w ON i.item = w.item LEFT JOIN n ON i.item = n.item LEFT JOIN k ON i.item = k.item), "
    "no AS (SELECT item FROM f WHERE status = 'needs_owner'), r AS (SELECT change_set, item, CASE WHEN status IN ('pending', 'needs_owner') AND NOT waits AND item NOT IN (SELECT item FROM no) AND item NOT IN (SELECT item FROM tc WHERE dep IN (SELECT item FROM no)) THEN 'expired' ELSE status END AS status, reason FROM f)"
)


@query(f"{_DECIDED} SELECT * FROM r")
def change_set_items(spark, sf_dir):
    """Orders as items of change sets of ten, some of them stale, for owners, or on a cycle."""
    items = _set_items(spark, sf_dir)
    return M.accepted_items(items, items.where("item % 4 <> 1").select("item"))


@query(f"{_DECIDED} SELECT change_set, CASE WHEN count(*) FILTER (status IN ('pending', 'needs_owner')) > 0 THEN 'pending' WHEN count(*) FILTER (status = 'accepted') = 0 THEN 'rejected' WHEN count(*) FILTER (status = 'accepted') = count(*) THEN 'applied' ELSE 'partially_applied' END AS status FROM r GROUP BY change_set")
def change_sets_decided(spark, sf_dir):
    return M.change_set_statuses(change_set_items(spark, sf_dir))


_FORMULAS = (
    "SELECT sum(amount) FROM sales", "SELECT sum(s.amount) / count(*) AS ratio FROM core.sales s JOIN client c ON s.client_id = c.id", "SELECT sum(price) FROM sales", "SELECT sum(amount) FROM stg_sales", "SELECT x.amount FROM sales s",
    "WITH t AS (SELECT client_id, sum(amount) AS total FROM sales GROUP BY client_id) SELECT avg(total) FROM t", "INSERT INTO sales SELECT * FROM sales", "SELECT sum(amount FROM sales", "SELECT region, extra FROM client WHERE id IN (SELECT client_id FROM sales WHERE gone > 1)",
)
_FOUND = ("", "", "no table in the query has a column `price`", "`stg_sales` is not a core or mart table; no table in the query has a column `amount`", "`x` is not a table or alias in the query", "", "not one SELECT", "not valid SQL", "no table in the query has a column `extra`; no table in the query has a column `gone`")


@query("SELECT s_suppkey AS kpi, [" + ", ".join(f"'{x}'" for x in _FOUND) + "][s_suppkey % 9 + 1] AS problems FROM supplier")
def kpi_formulas(spark, sf_dir):
    """Suppliers as KPIs, whose formulas are checked against a small core and mart."""
    model = {("mart", "sales"): {"amount", "client_id", "day"}, ("core", "sales"): {"amount", "client_id", "note"}, ("core", "client"): {"id", "region"}}
    texts = F.array(*[F.lit(x) for x in _FORMULAS])
    kpis = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("kpi"), F.element_at(texts, (F.col("s_suppkey") % 9 + 1).cast("int")).alias("sql"))
    found = checked_formulas(kpis, model).select("kpi", F.array_join("problems", "; ").alias("problems"))
    return found.withColumn("problems", F.regexp_replace("problems", r"(?s)^(not valid SQL): .*", "$1"))


@query(
    "WITH t AS (SELECT 't' || s_suppkey AS t, CASE WHEN s_suppkey % 7 = 0 THEN 'source_removed' ELSE 'present' END AS st FROM supplier WHERE s_suppkey % 5 > 0), c AS (SELECT t, 'c' || n AS c, CASE WHEN n % 4 = 3 THEN 'source_removed' ELSE 'present' END AS st FROM t, range(0, 6) x(n)), r AS (SELECT DISTINCT l_orderkey AS m, 't' || l_suppkey AS t, CASE WHEN l_linenumber < 7 THEN 'c' || l_partkey % 8 END AS c FROM lineitem) "
    "SELECT DISTINCT m AS mapping_id, 'broken_reference' AS code, r.t AS name FROM r WHERE r.t NOT IN (SELECT t FROM t) UNION ALL SELECT DISTINCT m, 'removed_input', r.t FROM r JOIN t ON r.t = t.t WHERE st = 'source_removed' UNION ALL SELECT DISTINCT m, 'broken_reference', r.t || '.' || r.c FROM r JOIN t ON r.t = t.t LEFT JOIN c ON r.t = c.t AND r.c = c.c WHERE r.c IS NOT NULL AND c.c IS NULL "
    "UNION ALL SELECT DISTINCT m, 'removed_input', r.t || '.' || r.c FROM r JOIN t ON r.t = t.t JOIN c ON r.t = c.t AND r.c = c.c WHERE t.st = 'present' AND c.st = 'source_removed'"
)
def inputs_of_mappings(spark, sf_dir):
    """Orders as mappings whose lines name suppliers' tables and columns, some of which are gone."""
    s, n = F.col("s_suppkey"), F.col("n")
    tables = table(spark, sf_dir, "supplier").where(s % 5 > 0).select(F.lit("staging").alias("layer"), F.concat(F.lit("t"), s.cast("string")).alias("table"), F.when(s % 7 == 0, "source_removed").otherwise("present").alias("status"))
    columns = tables.select("layer", "table", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("layer", "table", F.concat(F.lit("c"), n.cast("string")).alias("column"), F.when(n % 4 == 3, "source_removed").otherwise("present").alias("status"))
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mapping_id"), F.lit("staging").alias("layer"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("table"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("C"), (F.col("l_partkey") % 8).cast("string"))).alias("column"))
    return M.input_problems(reads, tables, columns)


@query("SELECT o_custkey AS table_id, count(DISTINCT o_orderstatus) AS branches FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def unintegrated_tables(spark, sf_dir):
    """Customers as tables, the states of their orders as branches; every fourth says how its rows become one."""
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), F.when(F.col("c_custkey") % 4 == 0, "the latest row wins").when(F.col("c_custkey") % 4 == 1, " ").alias("integration_rule"))
    return M.unintegrated(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderstatus").alias("branch")), rules)
