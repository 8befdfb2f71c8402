"""The relational surface of the guarded SELECT: predicates, joins, set operations, windows, ordering, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query
money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")  # noqa: E731  exact whatever the order of adding


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '1-%' AND NOT o_custkey <= 10")
def filter_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keep = (F.col("o_orderstatus") != "F") & F.col("o_totalprice").between(1000, 90000) & F.col("o_orderpriority").like("1-%") & ~(F.col("o_custkey") <= 10)
    return o.where(keep).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%part%1%' OR regexp_full_match(p_brand, 'Brand#[12][1-3]')")
def filter_pattern(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%part%1%") | R.similar_to(F.col("p_brand"), "Brand#[12][1-3]")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL AND nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL")
def filter_in_null_safe(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").isNotNull() & F.nullif(F.col("c_nationkey"), F.lit(3)).eqNullSafe(F.lit(None))).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_in_subquery(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)")
def exists_correlated(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def not_exists(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("scalar_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM scalar_orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM scalar_orders)")


@query(
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS segment, "
    "CAST(c_custkey % 7 AS BIGINT) AS remainder, CAST(c_custkey // 7 AS BIGINT) AS quotient, -c_acctbal AS negated, c_name || '/' || c_mktsegment AS label FROM customer"
)
def expressions(spark, sf_dir):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", band.alias("band"), F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("-")).alias("segment"), (F.col("c_custkey") % 7).alias("remainder"),
        F.expr("c_custkey div 7").alias("quotient"), (-F.col("c_acctbal")).alias("negated"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("label"),
    )


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 50000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
def derived_tables(spark, sf_dir):
    per = table(spark, sf_dir, "orders").where("o_totalprice > 50000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS cell FROM documents")
def cell_shaping(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.shaped_cell(F.col("text")).alias("cell"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def json_key_time_range(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.get_json_object("props", "$.k").isNotNull() & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-02'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-05'"))).select("event_id")


@query("SELECT CAST(NULL AS DECIMAL(12, 2)) AS credit_limit, CAST(NULL AS VARCHAR) AS note, count(*) AS n FROM customer")
def typed_nulls(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.lit(None).cast("decimal(12,2)").alias("credit_limit"), F.lit(None).cast("string").alias("note"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, r_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def join_inner(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def join_left_preaggregated(spark, sf_dir):
    per = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("orders"))


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000")
def join_right(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 8000")
    return s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query(
    "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) a FULL JOIN "
    "(SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k"
)
def join_full(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 3")
def join_cross_small(spark, sf_dir):
    """Two tables of fixed size; nothing that grows is ever crossed."""
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation").where("n_nationkey < 3")).select("r_name", "n_name")


@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 150000")
def join_comma(spark, sf_dir):
    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"comma_{t}")
    return spark.sql("SELECT o_orderkey, c_name FROM comma_orders, comma_customer WHERE o_custkey = c_custkey AND o_totalprice > 150000")


@query("SELECT q.conv_id, q.turn, length(q.text) AS question, length(a.text) AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def join_self(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q, a = c.where("role = 'user'").alias("q"), c.where("role = 'assistant'").alias("a")
    on = (F.col("q.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1)
    return q.join(a, on).select("q.conv_id", "q.turn", F.length("q.text").cast("long").alias("question"), F.length("a.text").cast("long").alias("answer"))


@query(
    "SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.o_orderkey % 7 + 1 WHERE l.l_quantity > 45"
)
def join_composite(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem").where("l_quantity > 45"), table(spark, sf_dir, "orders")
    return l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") == F.col("o_orderkey") % 7 + 1)).select("l_orderkey", "l_linenumber", "o_orderdate")


@query(
    "WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS name FROM customer), b AS (SELECT c_custkey AS id, c_name AS name FROM customer), "
    "e AS (SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b ON a.name = b.name), la AS (SELECT * FROM a WHERE id NOT IN (SELECT left_id FROM e)), lb AS (SELECT * FROM b WHERE id NOT IN (SELECT right_id FROM e)), "
    "ua AS (SELECT lower(name) AS f, min(id) AS id FROM la GROUP BY 1 HAVING count(*) = 1), ub AS (SELECT lower(name) AS f, min(id) AS id FROM lb GROUP BY 1 HAVING count(*) = 1) "
    "SELECT left_id, right_id, 'exact' AS how FROM e UNION ALL SELECT ua.id, ub.id, 'fold' FROM ua JOIN ub ON ua.f = ub.f"
)
def identity_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"))
    return R.identity_match(a, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(l_discount), 6) AS discount, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_samp(l_quantity), 6) AS deviation, round(var_samp(l_quantity), 4) AS variance, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus")
def aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("total"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("deviation"), F.round(F.var_samp("l_quantity"), 4).alias("variance"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def aggregate_strings(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 20")
def group_by_expression_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).where("n > 20")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_extension(spark, sf_dir):
    """Grouping sets are an extension: the guarded surface refuses them."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


_RANKS = "PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey"


@query(f"SELECT c_custkey, row_number() OVER ({_RANKS}) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, ntile(4) OVER ({_RANKS}) AS quartile FROM customer")
def rank_windows(spark, sf_dir):
    w, s = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"), W.partitionBy("c_nationkey").orderBy("c_mktsegment")
    ranks = (F.row_number().over(w).alias("rn"), F.rank().over(s).alias("rk"), F.dense_rank().over(s).alias("dr"), F.ntile(4).over(w).alias("quartile"))
    return table(spark, sf_dir, "customer").select("c_custkey", *ranks).select("c_custkey", *[F.col(c).cast("long") for c in ("rn", "rk", "dr", "quartile")])


@query(
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
)
def value_windows(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    k = "o_orderkey"
    return table(spark, sf_dir, "orders").select(k, F.lag(k).over(w).alias("before"), F.lead(k, 2).over(w).alias("after"), F.first(k).over(w).alias("first"), F.last(k).over(whole).alias("last"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS pair, "
    "CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem"
)
def frame_windows(spark, sf_dir):
    by = W.partitionBy("l_orderkey")
    w, q = by.orderBy("l_linenumber"), F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.sum(q).over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(-1, 0)).alias("pair"), F.sum(q).over(w.rangeBetween(W.unboundedPreceding, 0)).alias("running"), F.count(F.lit(1)).over(by).alias("lines")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
def topk_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(5).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-06-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def keyset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return R.keyset_page(o, ["o_orderdate", "o_orderkey"], [F.expr("timestamp_ntz'1997-06-01'"), F.lit(500)], 20)


@query("SELECT DISTINCT p_type AS code FROM part WHERE p_type IS NOT NULL ORDER BY code LIMIT 50")
def distinct_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_type IS NOT NULL").select(F.col("p_type").alias("code")).distinct().orderBy("code").limit(50)


_NAMES = "SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'supplier', s_name FROM supplier"


@query(f"WITH n AS ({_NAMES}) SELECT kind, name, CAST(CASE WHEN lower(name) = 'ia' THEN 0 WHEN lower(name) LIKE 'ia%' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM n WHERE contains(lower(name), 'ia') ORDER BY rank, name, kind LIMIT 200")
def ranked_name_search(spark, sf_dir):
    kinds = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name"), ("supplier", "s_name"))]
    return R.name_search(reduce(lambda a, b: a.unionByName(b), kinds), "ia", 200)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select("s_nationkey"))


@query("SELECT c_mktsegment AS v FROM customer UNION SELECT o_orderpriority FROM orders")
def set_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("v")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


@query("SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation")
def set_union_all(spark, sf_dir):
    return reduce(lambda a, b: a.unionByName(b), [table(spark, sf_dir, t).agg(F.lit(t).alias("kind"), F.count(F.lit(1)).alias("n")) for t in ("customer", "supplier", "part", "nation")])


@query(
    "WITH p AS (SELECT l_suppkey AS a, l_partkey AS b, l_tax AS confidence FROM lineitem) "
    "SELECT least(a, b) AS low, greatest(a, b) AS high, max(confidence) AS confidence, count(*) AS n FROM p GROUP BY 1, 2"
)
def undirected_merge(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_tax").alias("confidence"))
    return R.undirected(pairs)


@query(
    "SELECT abs(c_acctbal) AS a1, round(c_acctbal, 1) AS a2, CAST(ceil(c_acctbal) AS BIGINT) AS a3, CAST(floor(c_acctbal) AS BIGINT) AS a4, CAST(sign(c_acctbal) AS DOUBLE) AS a5, greatest(c_custkey, 10) AS a6, upper(substr(c_name, 1, 3)) AS s1, "
    "lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS s2, replace(c_name, '#', '-') AS s3, reverse(c_mktsegment) AS s4, CAST(instr(c_name, '#') AS INTEGER) AS s5, split_part(c_name, '#', 2) AS s6, md5(c_name) AS s7, translate(c_mktsegment, 'ABC', 'xyz') AS s8, "
    "regexp_replace(c_name, '[0-9]+', 'N', 'g') AS s9, try_cast(c_mktsegment AS DOUBLE) IS NOT NULL AS s10, CAST(ascii(c_mktsegment) AS INTEGER) AS s11, left(c_name, 4) AS s12, right(c_name, 4) AS s13, concat_ws('|', c_name, c_mktsegment) AS s14 FROM customer"
)
def scalar_functions(spark, sf_dir):
    b, n, m = F.col("c_acctbal"), F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.abs(b).alias("a1"), F.round(b, 1).alias("a2"), F.ceil(b).alias("a3"), F.floor(b).alias("a4"), F.signum(b).alias("a5"), F.greatest("c_custkey", F.lit(10)).alias("a6"), F.upper(F.substring(n, 1, 3)).alias("s1"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("s2"), F.replace(n, F.lit("#"), F.lit("-")).alias("s3"), F.reverse(m).alias("s4"), F.instr(n, "#").alias("s5"), F.split_part(n, F.lit("#"), F.lit(2)).alias("s6"), F.md5(n).alias("s7"),
        F.translate(m, "ABC", "xyz").alias("s8"), F.regexp_replace(n, "[0-9]+", "N").alias("s9"), F.expr("try_cast(c_mktsegment as double)").isNotNull().alias("s10"), F.ascii(m).alias("s11"), F.left(n, F.lit(4)).alias("s12"),
        F.right(n, F.lit(4)).alias("s13"), F.concat_ws("|", n, m).alias("s14"),
    )


@query(
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, last_day(CAST(o_orderdate AS DATE)) AS ends, date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS month_start, "
    "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS days_left, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders"
)
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.last_day(d.cast("date")).alias("ends"), F.date_trunc("month", d.cast("timestamp")).alias("month_start"),
        F.date_diff(F.lit("1999-01-01").cast("date"), d.cast("date")).alias("days_left"), F.date_format(d, "yyyy-MM-dd").alias("shown"),
    )
