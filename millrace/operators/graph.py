"""Lineage graphs as edge lists (source, target, kind): closures, impact, and how personal data spreads.

A walk in a large graph keeps a frontier: each round joins it with the edges, drops what has been visited, and writes the
rest to the shared folder, so cycles end and the plan does not grow. No walk goes further than MAX_DEPTH hops.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stored

MAX_DEPTH = 64
#: Edges up to which every task gets the whole graph and walks it by itself.
SMALL = 50_000


def reach(edges: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH, small: int = SMALL) -> DataFrame:
    """(seed, node, hops): the nodes that each seed (node) reaches along the edges, itself at 0 hops, by the fewest hops.

    Null nodes reach nothing and are left out. A graph of `small` edges at most is broadcast (its size is counted first) and each seed is walked in one pass; a
    larger one is walked by joins.
    """
    step = stored(edges.select(F.col("source").alias("__s"), F.col("target").alias("__t")).where("__s IS NOT NULL AND __t IS NOT NULL").distinct(), "graph-edges")
    start = seeds.where("node IS NOT NULL").select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0))
    return _walked(step, start, depth) if step.limit(small + 1).count() <= small else _joined(step, start, depth)


def _walked(step: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    shared = step.sparkSession.sparkContext.broadcast([tuple(r) for r in step.collect()])

    def walk(frames):
        after: dict = {}
        for source, target in shared.value:
            after.setdefault(source, []).append(target)
        for frame in frames:
            for seed in frame["seed"].tolist():
                hops, layer, at = {seed: 0}, [seed], 0
                while layer and at < depth:
                    at += 1
                    layer = list(dict.fromkeys(t for n in layer for t in after.get(n, ()) if t not in hops))
                    hops |= dict.fromkeys(layer, at)
                yield pd.DataFrame({"seed": seed, "node": list(hops), "hops": list(hops.values())})

    return start.select("seed").mapInPandas(walk, start.schema)


def _joined(step: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    frontier = stored(start, "graph-seeds")
    seen = frontier
    for hops in range(1, depth + 1):
        new = frontier.join(step, F.col("node") == F.col("__s")).select("seed", F.col("__t").alias("node")).distinct()
        frontier = stored(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hops)), "graph-reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def spread(edges: DataFrame, start: DataFrame, small: int = SMALL) -> DataFrame:
    """(node): the start nodes and all that any of them reaches, each once, however far; one walk for all of them.

    Null nodes reach nothing and are left out. A graph of `small` edges at most is walked in one task, a larger one by joins.
    """
    step = stored(edges.select(F.col("source").alias("__s"), F.col("target").alias("__t")).where("__s IS NOT NULL AND __t IS NOT NULL").distinct(), "graph-edges")
    seeds = stored(start.where("node IS NOT NULL").select("node").distinct(), "graph-start")
    if step.limit(small + 1).count() > small:
        frontier = seen = seeds
        while not frontier.isEmpty():
            new = frontier.join(step, F.col("node") == F.col("__s")).select(F.col("__t").alias("node")).distinct()
            frontier = stored(new.join(seen, "node", "left_anti"), "graph-spread")
            seen = seen.unionByName(frontier)
        return seen
    shared = step.sparkSession.sparkContext.broadcast([tuple(r) for r in step.collect()])

    def walk(frames):
        after: dict = {}
        for source, target in shared.value:
            after.setdefault(source, []).append(target)
        seen: set = set()
        for frame in frames:
            layer = [n for n in frame["node"].tolist() if n not in seen]
            new: dict = {}
            while layer:
                seen.update(layer)
                layer = list(dict.fromkeys(t for n in layer for t in after.get(n, ()) if t not in seen))
                new |= dict.fromkeys(layer)
            yield pd.DataFrame({"node": pd.Series(list(new), dtype=frame["node"].dtype)})

    inside = seeds.join(step.select(F.col("__s").alias("node")).distinct(), "node", "left_semi").coalesce(1)  # `small` nodes at most
    return seeds.unionByName(inside.mapInPandas(walk, seeds.schema)).distinct()


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the length of the longest walk that ends at a node; null on a cycle and behind one.

    Each round takes the nodes that nothing left points to. A node that points to itself is a cycle.
    """
    step = stored(edges.select(F.col("source").alias("__s"), F.col("target").alias("__t")).where("__s IS NOT NULL AND __t IS NOT NULL").distinct(), "graph-edges")
    left = stored(nodes.select("node").where("node IS NOT NULL").distinct(), "graph-left")
    step = step.join(left.select(F.col("node").alias("__n")), F.col("__s") == F.col("__n"), "left_semi")
    done, level = left.limit(0).withColumn("level", F.lit(0)), 0
    while True:
        held = step.join(left.select(F.col("node").alias("__n")), F.col("__s") == F.col("__n"), "left_semi").select(F.col("__t").alias("node")).distinct()
        ready = stored(left.join(held, "node", "left_anti"), "graph-ready")
        if ready.isEmpty():
            return done.unionByName(left.withColumn("level", F.lit(None).cast("int")))
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        left, level = stored(left.join(ready, "node", "left_anti"), "graph-left"), level + 1


def turned(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": F.col("target"), "target": F.col("source")})


def reachable_edges(edges: DataFrame, seeds: DataFrame, upstream: bool = False, depth: int = MAX_DEPTH) -> DataFrame:
    """The edges on any walk from the seeds, downstream or upstream."""
    nodes = reach(turned(edges) if upstream else edges, seeds, depth).where(F.col("hops") < depth).select(F.col("node").alias("__n")).distinct()
    return edges.join(nodes, F.col("target" if upstream else "source") == F.col("__n"), "left_semi")


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(type, n): the nodes (node, type) downstream of the seeds by type, seeds apart."""
    hit = reach(edges, seeds).where("hops > 0").select(F.col("node").alias("__n")).distinct()
    return nodes.join(hit, F.col("node") == F.col("__n"), "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# What personal data may be said of a node, the strongest first.
PII_STATUSES = ("derived", "pseudonymised", "influenced")


def propagate(edges: DataFrame, protected: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """(node, status) of personal data: along value edges from the protected nodes, and one step along uses and lookup edges.

    A node that some path of value edges reaches is `derived`, or `pseudonymised` if every such path enters a hashed node; one
    that such a node only steers is `influenced`. Protected nodes are derived. With hashed (node), a column pseudonymised says
    in addition whether any of a node's paths enters a hashed node, or is null where it has none.
    """
    values = edges.where("kind = 'value'")
    reached = stored(spread(values, protected), "pii-reached")
    used = edges.where("kind IN ('uses', 'lookup')").join(reached.select(F.col("node").alias("__n")), F.col("source") == F.col("__n"), "left_semi").select(F.col("target").alias("node")).distinct()
    only = used.where("node IS NOT NULL").join(reached, "node", "left_anti").withColumn("status", F.lit("influenced"))
    if hashed is None:
        return reached.withColumn("status", F.lit("derived")).unionByName(only)
    h = hashed.select(F.col("node").alias("__h")).where("__h IS NOT NULL").distinct()
    plain = spread(values.join(h, F.col("target") == F.col("__h"), "left_anti"), protected).select(F.col("node").alias("__p"))
    # a hashed node is entered only along an edge: a protected one is as it stands
    entered = values.join(h, F.col("target") == F.col("__h"), "left_semi").join(reached.select(F.col("node").alias("__n")), F.col("source") == F.col("__n"), "left_semi").select(F.col("target").alias("node"))
    touched = spread(values, entered).select(F.col("node").alias("__t"))
    both = reached.join(plain, F.col("node") == F.col("__p"), "left").join(touched, F.col("node") == F.col("__t"), "left")
    told = both.select("node", F.when(F.col("__p").isNotNull(), "derived").otherwise("pseudonymised").alias("status"), F.col("__t").isNotNull().alias("pseudonymised"))
    return told.unionByName(only.withColumn("pseudonymised", F.lit(None).cast("boolean")))


def dependent_kpis(links: DataFrame, status: DataFrame) -> DataFrame:
    """(kpi, status) of the KPIs linked (kpi, node) to personal data; the strongest status of its nodes."""
    hit = links.join(status.select(F.col("node").alias("__n"), "status"), F.col("node") == F.col("__n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in PII_STATUSES]), F.col("status"))
    return hit.groupBy("kpi").agg(F.min_by("status", rank).alias("status"))


def origins(edges: DataFrame, protected: DataFrame) -> DataFrame:
    """(node, origins): the protected columns that each derived node comes from, as a sorted list."""
    found = reach(edges.where("kind = 'value'"), protected).where("hops > 0")
    return found.groupBy("node").agg(F.sort_array(F.collect_set("seed")).alias("origins"))


def roots(edges: DataFrame, nodes: DataFrame, depth: int = 8) -> DataFrame:
    """(node, root): back along nodes with a single input, until one has none or several."""
    single = edges.where("kind = 'value'").groupBy(F.col("target").alias("__t")).agg(F.min("source").alias("__s"), F.count_distinct("source").alias("__n")).where("__n = 1")
    single = stored(single.select("__t", "__s"), "graph-single")
    at = nodes.select("node", F.col("node").alias("root"))
    for _ in range(depth):
        at = stored(at.join(single, F.col("root") == F.col("__t"), "left").select("node", F.coalesce("__s", "root").alias("root"), F.col("__s").isNotNull().alias("moved")), "graph-roots")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("node", "root")


def neighbourhood(edges: DataFrame, start: DataFrame, limit: int = 100) -> DataFrame:
    """(node, hops): the nearest nodes around a start whichever way the edges point, `limit` at most, nearer ones first."""
    both = edges.select("source", "target").unionByName(turned(edges.select("source", "target")))
    return reach(both, start).groupBy("node").agg(F.min("hops").alias("hops")).orderBy("hops", "node").limit(limit)
