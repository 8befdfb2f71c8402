"""Mixing sources to target weights by pivotal dependent rounding.

Each document has an expected number of copies, its source's target over its source's size. The whole part is settled at
once. The fractional parts are copy probabilities; documents of one source meet in pairs, and each pair moves mass (words
times probability) from one to the other, in a random direction that keeps both expectations, until one of the two is
integral. The other goes on to meet the next document. So the words a source gives stay equal to its target but for the
one document that is left over at the very end.

The pairs form a reduction tree. Documents are dealt by hash to groups of about FAN; each group leaves its residual and a
few documents of different sizes, and those are dealt to groups again until each source has a single group: about
log_25(n) levels, each one shuffle of a few numbers a row. The last group rounds its residual by a coin and then flips
documents of its own, one or two at a time, as long as that brings the source nearer to its target.

Rows that agree in doc_id, source and size are one unit of n rows, whose copies are n times the rate: only the fraction of a
copy that is left meets other units, so a row repeated in a third of the table weighs there no more than any other. The
unit's copies are spread evenly over its rows, which differ by one copy at most: rows come in order of a hash of all their
columns, and equal rows are counted, never numbered, so the result does not depend on how the table is split or ordered.

Defined cases: a null or wordless text has size 0, is copied by an own coin of the same probability and gives no words; a
null source is a source of its own, last in order; equal rows get copies that differ by one at most; an empty table gives an
empty result; further columns are carried, and names starting with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._spark import uniform, width, word_count, written

#: Documents that meet in one group of the reduction tree.
FAN = 128
#: Documents of a group that are passed on unrounded, besides the open one, so that the last group holds all sizes.
KEPT = 4
#: Times that one or two documents of the last group may be flipped.
FITS = 6
#: Equal rows that are written out at once.
LOT = 10_000

_SETTLED = "struct<id:struct<doc_id:bigint,source:string,size:bigint>,mass:double,taken:boolean>"


def source_targets(units: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: its size, its target, and the expected copies of each of its documents.

    Sources weigh weights[0], weights[1], ... in code-point order (null last), repeating. They share `share` times all
    words; a target stops at `cap` times its source's size and the excess is shared again by weight among the others.
    Water-filling in closed form: in order of size/weight the first sources are capped, the rest get weight times the
    level at which the open ones use up what is left.
    """
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after))
    open_ = level.withColumn("open", F.col("level") * F.col("weight") <= F.lit(float(cap)) * F.col("source_size"))
    # open sources are a suffix in this order, and the first of them has the level that holds for all
    line = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"]
    most = F.lit(float(cap)) * F.col("source_size")
    target = F.when(F.col("open"), F.least(most, F.coalesce(line, F.lit(0.0)) * F.col("weight"))).otherwise(most)
    return open_.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"), "units"
    )


def _meet(state, x):
    """One step of the rounding in a group: the document still open meets x; one of the two becomes integral."""
    f = state["open"]
    a, p, b, q = f["mass"], f["p"], x["mass"], x["p"]
    up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
    goes_up = x["u"] * (up + down) < down
    first_full = a * (1 - p) <= b * q  # going up, the open one reaches 1 no later than x reaches 0
    first_empty = a * p <= b * (1 - q)
    settle_f = F.when(goes_up, first_full).otherwise(first_empty)
    settled = F.struct(F.when(settle_f, f["id"]).otherwise(x["id"]).alias("id"), F.when(settle_f, a).otherwise(b).alias("mass"), F.when(settle_f, goes_up).otherwise(~goes_up).alias("taken"))
    p_open = F.when(goes_up, F.when(first_full, q - up / b).otherwise(p + up / a)).otherwise(F.when(first_empty, q + down / b).otherwise(p - down / a))
    p_open = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p_open))
    still = F.struct(
        F.when(settle_f, x["id"]).otherwise(f["id"]).alias("id"), F.when(settle_f, b).otherwise(a).alias("mass"), p_open.alias("p"), F.when(settle_f, x["u"]).otherwise(f["u"]).alias("u")
    )
    return F.struct(still.alias("open"), F.concat(state["done"], F.array(settled)).alias("done"))


def _level(rows: DataFrame, seed: int, depth: int, last: bool) -> DataFrame:
    """Deal rows (source, groups, id, mass, p) to groups and round within each.

    One row a group: done (id, taken) and rest (id, mass, p), the document still open and KEPT others spread over the
    sizes, which a later level rounds. At the last level rest is empty: the open document is rounded by its own coin, and
    documents of the group are flipped, larger ones first, while that brings the source's words nearer to its target.
    """
    key = F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "id"), F.col("groups"))
    entry = F.struct((-F.col("mass")).alias("order"), F.col("id"), F.col("mass"), F.col("p"), uniform(F.lit(seed), F.lit(-1 - depth), "id").alias("u"))
    groups = rows.groupBy("source", "groups", key.alias("g")).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    plain = F.transform("all", lambda e: F.struct(e["id"].alias("id"), e["mass"].alias("mass"), e["p"].alias("p"), e["u"].alias("u")))
    groups = groups.select("source", "groups", plain.alias("plain"))
    if last:
        meeting, spared = F.col("plain"), F.slice("plain", 1, 0)
    else:
        step = F.greatest(F.lit(2), F.floor(F.size("plain") / (KEPT + 1)).cast("int"))
        spare = lambda x, i: (i % step == step - 1) & (i < KEPT * step)
        meeting, spared = F.filter("plain", lambda x, i: ~spare(x, i)), F.filter("plain", spare)
    start = F.struct(meeting[0].alias("open"), F.expr(f"cast(array() as array<{_SETTLED}>)").alias("done"))
    rounded = F.aggregate(F.slice(meeting, 2, F.greatest(F.lit(1), F.size(meeting))), start, _meet)
    out = groups.select("source", "groups", spared.alias("spared"), rounded.alias("r"))
    bare = lambda x: F.struct(x["id"].alias("id"), x["mass"].alias("mass"), x["p"].alias("p"))
    if not last:
        return out.select("source", "groups", "r.done", F.transform(F.concat(F.array("r.open"), "spared"), bare).alias("rest"))
    up = F.col("r.open.u") < F.col("r.open.p")
    closed = F.struct(F.col("r.open.id").alias("id"), F.col("r.open.mass").alias("mass"), up.alias("taken"))
    off = F.when(up, F.col("r.open.mass") * (1 - F.col("r.open.p"))).otherwise(-F.col("r.open.mass") * F.col("r.open.p"))
    out = out.select("source", F.concat("r.done", F.array(closed)).alias("all"), off.alias("off"))
    order = F.sort_array(F.transform("all", lambda x: F.struct((-x["mass"]).alias("order"), x["id"].alias("id"), x["mass"].alias("mass"), x["taken"].alias("taken"))))
    plain = F.transform(order, lambda x: F.struct(x["id"].alias("id"), x["mass"].alias("mass"), x["taken"].alias("taken")))
    begin = F.struct(F.col("off").alias("off"), plain.alias("all"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(FITS)), begin, lambda state, _: _nearer(state))
    nothing = F.expr("cast(array() as array<struct<id:struct<doc_id:bigint,source:string,size:bigint>,mass:double,p:double>>)")
    return out.select("source", F.lit(1).cast("long").alias("groups"), fitted["all"].alias("done"), nothing.alias("rest"))


def _nearer(state):
    """state (off, all) after the one or two flips that bring off nearest to 0; of equal ones the first. None is taken in vain.

    all holds the documents of one group, so its pairs are few.
    """
    change = lambda x: F.when(x["taken"], -x["mass"]).otherwise(x["mass"])
    at = F.sequence(F.lit(0), F.size(state["all"]) - 1)
    moves = F.transform(at, lambda i: F.array_min(F.transform(F.filter(at, lambda j: j >= i), lambda j: _move(state, i, j, change))))
    best = F.array_min(moves)
    flip = F.abs(best["left"]) < F.abs(state["off"])
    flipped = F.transform(state["all"], lambda x, i: F.struct(x["id"].alias("id"), x["mass"].alias("mass"), (x["taken"] != (flip & ((i == best["i"]) | (i == best["j"])))).alias("taken")))
    return F.struct(F.when(flip, best["left"]).otherwise(state["off"]).alias("off"), flipped.alias("all"))


def _move(state, i, j, change):
    x, y = F.get(state["all"], i), F.get(state["all"], j)
    left = state["off"] + change(x) + F.when(i == j, 0.0).otherwise(change(y))
    return F.struct(F.abs(left).alias("by"), i.alias("i"), j.alias("j"), left.alias("left"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def copies(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Copies of each distinct (doc_id, source, size) of rows, as sized() gives them: n rows of it, and copies of all n.

    Columns: doc_id, source, size, n, source_size, target, rate, copies. The sum of size * copies over a source differs
    from its target by less than a document's words; in practice by a few, as pairs of the last group's documents close the
    gap where their sizes allow it. Only whole documents are taken.
    """
    units = written(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    targets = written(source_targets(units, tuple(weights), share, cap).coalesce(1), "mix-targets")
    rated = units.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "inner").drop("__s")
    all_ = F.col("n") * F.col("rate")
    whole = F.floor(all_ + F.lit(1e-9)).cast("long")
    rated = rated.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), all_ - whole))
    coin = (F.col("size") <= 0) | (F.col("p") <= 0)
    groups = F.ceil(F.col("units") / F.lit(FAN)).cast("long")
    identity = F.struct("doc_id", "source", "size").alias("id")
    rows = rated.where(~coin).select("source", groups.alias("groups"), identity, F.col("size").cast("double").alias("mass"), "p")
    most = targets.agg(F.max("units")).first()[0] or 0
    decided, depth = [], 0
    while True:
        groups_now = -(-most // FAN)
        level = _level(rows.where("groups <= 1"), seed, depth, last=True)
        if groups_now > 1:
            level = level.unionByName(_level(rows.where("groups > 1"), seed, depth, last=False))
        level = written(level, f"mix-level{depth}")
        decided.append(level.select(F.explode("done").alias("d")).select("d.id", "d.taken"))
        if groups_now <= 1:
            break
        most, depth = groups_now * (KEPT + 1), depth + 1
        fewer = F.ceil(F.col("groups") * (KEPT + 1) / F.lit(FAN)).cast("long")
        rows = level.select("source", fewer.alias("groups"), F.explode("rest").alias("x")).select("source", "groups", "x.id", "x.mass", "x.p")
    settled = decided[0]
    for more in decided[1:]:
        settled = settled.unionAll(more)
    settled = settled.select(F.col("id.doc_id").alias("__d"), F.col("id.source").alias("__s"), F.col("id.size").alias("__z"), "taken")
    joined = rated.join(settled, (F.col("doc_id").eqNullSafe(F.col("__d"))) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left")
    own = uniform(F.lit(seed), F.lit(1), "doc_id", "source", "size") < F.col("p")
    return joined.select("doc_id", "source", "size", "n", "source_size", "target", "rate", (F.col("whole") + F.coalesce(F.col("taken"), own).cast("long")).alias("copies"))


def shared(rows: DataFrame, decided: DataFrame, size: str = "size") -> DataFrame:
    """Each row of rows (doc_id, source, size and others) with __source_size, __target and __c, its own copies, as decided says.

    Only where a unit's copies do not come out even are its rows told apart: by a hash of the whole row, equal rows counted
    as one, and ranked by running sums over cells of the hash, so no unit is brought to one task.
    """
    decided = decided.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("n").alias("__n"), F.col("copies").alias("__all"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col(size) == F.col("__z"))
    uneven = F.col("__all") % F.col("__n") != 0
    each = F.floor(F.col("__all") / F.col("__n"))
    kept = [*[F.col(f"`{c}`") for c in rows.columns], "__source_size", "__target"]
    even = rows.join(decided.where(~uneven), on).select(*kept, each.cast("int").alias("__c"))
    if decided.where(uneven).isEmpty():
        return even
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    met = rows.join(decided.where(uneven), on).withColumn("__h", F.sha2(F.to_json(row), 256)).withColumn("__cell", F.substring("__h", 1, 3))
    unit = ["__d", "__s", "__z"]
    alike = written(met.groupBy(*unit, "__n", "__all", "__source_size", "__target", "__cell", "__h").agg(F.count(F.lit(1)).alias("__k"), F.first(row).alias("__row")), "mix-alike")
    # how many rows of the unit come before: those of its lower cells, and of lower hashes in its own
    sum_before = lambda *keys, by: F.coalesce(F.sum("__k").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = alike.groupBy(*unit, "__cell").agg(F.sum("__k").alias("__k"))
    cells = cells.select(*[F.col(c).alias(f"{c}1") for c in (*unit, "__cell")], sum_before(*unit, by="__cell").alias("__lower"))
    same = F.lit(True)
    for c in (*unit, "__cell"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}1"))
    ranked = alike.withColumn("__within", sum_before(*unit, "__cell", by="__h")).join(cells, same)
    more = F.greatest(F.lit(0), F.least(F.col("__k"), F.col("__all") % F.col("__n") - F.col("__lower") - F.col("__within")))
    # `more` of the equal rows get one copy more; they are written out again in lots, so that many are no one task's work
    parts = F.array(F.struct(more.alias("rows"), (each + 1).alias("c")), F.struct((F.col("__k") - more).alias("rows"), each.alias("c")))
    lots = ranked.select("__row", "__source_size", "__target", F.explode(parts).alias("__p")).where("__p.rows > 0")
    lots = lots.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__p.rows") - 1) / LOT)))).repartition(width(rows.sparkSession))
    again = lots.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT).cast("long"), F.col("__p.rows") - F.col("__lot") * LOT))))
    return even.unionByName(again.select("__row.*", "__source_size", "__target", F.col("__p.c").cast("int").alias("__c")))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix copies it (none, once or more), with docs' own columns."""
    decided = written(copies(sized(docs), **params), "mix-copies")
    taken = shared(docs.withColumn("__z0", word_count(F.col("text"))), decided.where("copies > 0"), "__z0").where("__c > 0")
    return taken.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__c")))).select(*[F.col(f"`{c}`") for c in docs.columns])
