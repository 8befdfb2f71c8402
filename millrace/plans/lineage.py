"""Lineage queries, on a graph that the parts make: a part comes from one with about half its key; small keys make cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_EDGES = "SELECT DISTINCT p_partkey // 2 + p_size % 3 AS source, p_partkey AS target, CASE WHEN p_partkey % 3 = 0 THEN 'uses' WHEN p_partkey % 11 = 0 THEN 'lookup' ELSE 'value' END AS kind FROM part"
_WALK = f"WITH RECURSIVE e AS ({_EDGES}), r(seed, node) AS (SELECT s, s FROM (VALUES (5::BIGINT), (17), (100)) v(s) UNION SELECT r.seed, e.target FROM r JOIN e ON r.node = e.source"


def _edges(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "uses").when(k % 11 == 0, "lookup").otherwise("value")
    return table(spark, sf_dir, "part").select((F.floor(k / 2) + F.col("p_size") % 3).alias("source"), k.alias("target"), kind.alias("kind")).distinct()


def _seeds(spark):
    return spark.createDataFrame([(5,), (17,), (100,)], "node long")


@query(f"{_WALK}) SELECT seed, node FROM r")
def lineage_closure(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir), _seeds(spark)).select("seed", "node")


@query(f"{_WALK}) SELECT DISTINCT e.source, e.target, e.kind FROM e JOIN r ON e.source = r.node")
def lineage_downstream_edges(spark, sf_dir):
    return graph.reachable_edges(_edges(spark, sf_dir), _seeds(spark))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT 5::BIGINT UNION SELECT e.source FROM r JOIN e ON r.node = e.target) SELECT DISTINCT e.source, e.target, e.kind FROM e JOIN r ON e.target = r.node")
def lineage_upstream_edges(spark, sf_dir):
    return graph.reachable_edges(_edges(spark, sf_dir), spark.createDataFrame([(5,)], "node long"), upstream=True)


@query(f"{_WALK}), h AS (SELECT DISTINCT node FROM r WHERE node <> seed) SELECT p_brand AS type, count(*) AS n FROM part WHERE p_partkey IN (SELECT node FROM h) GROUP BY 1")
def lineage_impact(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("type"))
    return graph.impact(_edges(spark, sf_dir), nodes, _seeds(spark))


_DERIVED = f"{_WALK} AND e.kind = 'value'), d AS (SELECT DISTINCT node FROM r), u AS (SELECT DISTINCT e.target AS node FROM e JOIN d ON e.source = d.node WHERE e.kind IN ('uses', 'lookup')), s AS (SELECT node, 'derived' AS status FROM d UNION ALL SELECT node, 'influenced' FROM u WHERE node NOT IN (SELECT node FROM d))"


@query(f"{_DERIVED} SELECT * FROM s")
def pii_propagation(spark, sf_dir):
    return graph.propagate(_edges(spark, sf_dir), _seeds(spark))


@query(f"{_DERIVED} SELECT p_brand AS kpi, min(status) AS status FROM part JOIN s ON p_partkey = node GROUP BY p_brand")
def pii_dependent_kpis(spark, sf_dir):
    links = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kpi"), F.col("p_partkey").alias("node"))
    return graph.dependent_kpis(links, graph.propagate(_edges(spark, sf_dir), _seeds(spark)))


@query(f"{_WALK} AND e.kind = 'value') SELECT node, string_agg(seed, ',' ORDER BY seed) AS origins FROM (SELECT DISTINCT node, seed FROM r WHERE node <> seed) GROUP BY node")
def pii_origins(spark, sf_dir):
    return graph.origins(_edges(spark, sf_dir), _seeds(spark)).select("node", F.array_join("origins", ",").alias("origins"))


@query(
    f"WITH RECURSIVE e AS ({_EDGES}), one AS (SELECT target, min(source) AS source FROM e WHERE kind = 'value' GROUP BY target HAVING count(DISTINCT source) = 1), "
    "r(node, root, hops) AS (SELECT DISTINCT target, target, 0 FROM e UNION ALL SELECT r.node, one.source, hops + 1 FROM r JOIN one ON r.root = one.target WHERE hops < 8) SELECT node, arg_max(root, hops) AS root FROM r GROUP BY node"
)
def trace_to_root(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.roots(e, e.select(F.col("target").alias("node")).distinct())


@query(f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT source AS s, target AS t FROM e UNION SELECT target, source FROM e), r(node, hops) AS (SELECT 5::BIGINT, 0 UNION SELECT b.t, r.hops + 1 FROM r JOIN b ON r.node = b.s WHERE r.hops < 12), m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node) SELECT node, hops FROM m ORDER BY hops, node LIMIT 20")
def ego_graph(spark, sf_dir):
    return graph.neighbourhood(_edges(spark, sf_dir), spark.createDataFrame([(5,)], "node long"), 20)


@query(
    f"WITH RECURSIVE e AS ({_EDGES}), s(node) AS (VALUES (5::BIGINT), (17), (100)), a(node) AS (SELECT node FROM s UNION SELECT target FROM a JOIN e ON node = source AND kind = 'value'), p(node) AS (SELECT node FROM s UNION SELECT target FROM p JOIN e ON node = source AND kind = 'value' AND target % 7 <> 0), "
    "h(node) AS (SELECT target FROM a JOIN e ON node = source AND kind = 'value' AND target % 7 = 0 UNION SELECT target FROM h JOIN e ON node = source AND kind = 'value'), u AS (SELECT DISTINCT target AS node FROM a JOIN e ON node = source AND kind <> 'value') "
    "SELECT node, CASE WHEN node IN (SELECT node FROM p) THEN 'derived' ELSE 'pseudonymised' END AS status, node IN (SELECT node FROM h) AS pseudonymised FROM a UNION ALL SELECT node, 'influenced', NULL FROM u WHERE node NOT IN (SELECT node FROM a)"
)
def pii_pseudonymised(spark, sf_dir):
    """Personal data where every seventh part is a hash of what it comes from."""
    hashed = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("node"))
    return graph.propagate(_edges(spark, sf_dir), _seeds(spark), hashed)
