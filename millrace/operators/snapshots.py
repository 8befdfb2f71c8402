"""Snapshots of metadata: differences, renames, content hashes, and what a sync of staging has to do."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import stored

SAME_CHILDREN = 0.6


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, status, changes): added, removed and changed rows; changes is an array of (field, before, after) as strings."""
    fields = [c for c in before.columns if c != key]
    b, a = before.select(F.col(key).alias("__b"), F.struct(*fields).alias("__old")), after.select(F.col(key).alias("__a"), F.struct(*fields).alias("__new"))
    both = b.join(a, F.col("__b") == F.col("__a"), "full")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__old.{f}").cast("string").alias("before"), F.col(f"__new.{f}").cast("string").alias("after")) for f in fields])
    changed = F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))
    status = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.size(changed) > 0, "changed")
    out = both.select(F.coalesce("__b", "__a").alias(key), status.alias("status"), F.when(status == "changed", changed).otherwise(F.slice(changed, 1, 0)).alias("changes"))
    return out.where("status IS NOT NULL")


def content_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest): a hash of each group's rows that does not depend on their order.

    Rows are hashed one by one and the sorted hashes together; a group is a table's columns, so it is small.
    """
    digest = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in keys])), 256)
    return rows.select(*keys, digest.alias("__h")).groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("__h")), ""), 256).alias("digest"))


#: From this length on difflib leaves out what is frequent in the second name.
_POPULAR = 200


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts: the longest common stretch, the first in a and then in b, and so on
    before and behind it. Short texts are searched by the interpreter's own `find`, many times as fast as difflib's tables."""
    if not a or not b:
        return 0
    size = at = i = 0
    while i + size < len(a):
        if a[i : i + size + 1] in b:
            size, at = size + 1, i
        else:
            i += 1
    if not size:
        return 0
    to = b.find(a[at : at + size])
    return size + _matched(a[:at], b[:to]) + _matched(a[at + size :], b[to + size :])


def _ratio(a: str, b: str) -> float:
    if len(b) >= _POPULAR or len(a) >= _POPULAR:
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two names, case folded. Spark has no such function."""
    return pd.Series([_ratio(x.casefold(), y.casefold()) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


#: Columns come of one place that a task compares with the columns gone.
DEAL = 64


def column_renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(from_name, to_name, confidence) of columns (table, name, data_type, ordinal) gone and come in one place of one table.

    Same table, type and position is an equality join; names only grade the pair. The pairs, not the columns, are the work: the
    columns come of a place are dealt out in lots of about DEAL, and those gone meet each lot, so a place with many of both is
    many small joins.
    """
    place = ("table", "data_type", "ordinal")
    r = removed.select(*[F.col(c).alias(f"r_{c}") for c in removed.columns])
    lots = added.groupBy(*[F.col(c).alias(f"l_{c}") for c in place]).agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("long").alias("lots"))
    a = added.select(*[F.col(c).alias(f"a_{c}") for c in added.columns])
    of = lambda side: reduce(lambda x, y: x & y, [F.col(f"{side}_{c}") == F.col(f"l_{c}") for c in place])
    a = a.join(lots, of("a")).withColumn("a_lot", F.pmod(F.xxhash64("a_name"), F.col("lots"))).drop("lots", *[f"l_{c}" for c in place])
    r = r.join(lots, of("r")).withColumn("r_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("lots", *[f"l_{c}" for c in place])
    same = reduce(lambda x, y: x & y, [F.col(f"r_{c}") == F.col(f"a_{c}") for c in (*place, "lot")])
    # the two small sides make many times their rows, so they are spread over all tasks and neither sent around nor put together
    tasks = int(removed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, side: df.repartition(tasks, *[f"{side}_{c}" for c in (*place, "lot")])
    met = spread(r, "r").hint("shuffle_hash").join(spread(a, "a"), same)
    return met.select(F.col("r_table").alias("table"), F.col("r_name").alias("from_name"), F.col("a_name").alias("to_name"), F.round(0.5 + 0.5 * likeness("r_name", "a_name"), 2).alias("confidence"))


def alike_sets(removed: DataFrame, added: DataFrame, least: float = SAME_CHILDREN) -> DataFrame:
    """(scope, old, new, jaccard) of the sets (scope, name, child) gone and come whose children are alike by Jaccard of `least`
    or more, within a scope. Children compare without case.

    Children are put in order, rare ones first. Two such sets share one of their first n - ceil(least * n) + 1 children, n
    being the size of each, so only these are joined: a child that all sets have never makes a pair of sets with others. Sets
    whose sizes alone rule it out are not compared, and the rest is counted exactly.
    """
    rows = lambda df, side: df.select("scope", F.col("name").alias("set"), F.lower("child").alias("c"), F.lit(side).alias("side")).where("c IS NOT NULL").distinct()
    every = stored(rows(removed, "old").unionByName(rows(added, "new")), "alike-children")
    common = every.groupBy(F.col("scope").alias("fs"), F.col("c").alias("fc")).agg(F.count(F.lit(1)).alias("f"))
    ranked = every.join(common, F.col("scope").eqNullSafe(F.col("fs")) & (F.col("c") == F.col("fc"))).select("scope", "set", "side", F.struct("f", "c").alias("x"))
    sets = ranked.groupBy("scope", "set", "side").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]).alias("all"))
    n = F.size("all")
    sets = stored(sets.withColumn("n", n).withColumn("first", F.slice("all", 1, (n - F.ceil(F.round(n * least, 9)) + 1).cast("int"))), "alike-sets")
    o, w = (sets.where(F.col("side") == side).select(*[F.col(c).alias(f"{side}_{c}") for c in ("scope", "set", "all", "n")], F.explode("first").alias(f"{side}_c")) for side in ("old", "new"))
    fits = (F.col("new_n") >= F.round(F.col("old_n") * least, 9)) & (F.col("old_n") >= F.round(F.col("new_n") * least, 9))
    met = o.join(w, F.col("old_scope").eqNullSafe(F.col("new_scope")) & (F.col("old_c") == F.col("new_c")) & fits)
    # a pair that shares several of its first children is counted at the first of them
    both = F.array_intersect("old_all", "new_all")
    shared = met.where(F.get(both, F.lit(0)) == F.col("old_c")).select("old_scope", "old_set", "new_set", "old_n", "new_n", F.size(both).alias("k"))
    jaccard = F.col("k") / (F.col("old_n") + F.col("new_n") - F.col("k"))
    return shared.select(F.col("old_scope").alias("scope"), F.col("old_set").alias("old"), F.col("new_set").alias("new"), jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def _graded(good: DataFrame) -> DataFrame:
    """(scope, from_name, to_name, confidence): 0.7 of the Jaccard and 0.3 of the names' likeness."""
    return good.select("scope", F.col("old").alias("from_name"), F.col("new").alias("to_name"), F.round(0.7 * F.col("jaccard") + 0.3 * likeness("old", "new"), 2).alias("confidence"))


def _tables(df: DataFrame) -> DataFrame:
    keys = [c for c in ("schema", "kind") if c in df.columns]
    return df.select(F.to_json(F.struct(*keys)).alias("scope") if keys else F.lit("").alias("scope"), F.col("table").alias("name"), "child")


def table_rename_candidates(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(from_name, to_name, confidence) of tables (table, child, and schema and kind if they have them) whose columns are alike
    by Jaccard of 0.6 or more. Only tables of one schema and kind meet."""
    return _graded(alike_sets(_tables(removed), _tables(added))).drop("scope")


def schema_rename_candidates(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(from_name, to_name, confidence) of schemas (schema, table) whose tables are alike, in the same way."""
    given = lambda df: df.select(F.lit("").alias("scope"), F.col("schema").alias("name"), F.col("table").alias("child"))
    return _graded(alike_sets(given(removed), given(added))).drop("scope")


def renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """(level, schema, from_name, to_name, confidence): schemas, then tables, that a newer state (schema, table, kind, child) has
    under another name. Tables of a renamed schema are compared within it; schema is the newer one's name."""
    b, a = stored(before.select("schema", "table", "kind", "child"), "renames-before"), stored(after.select("schema", "table", "kind", "child"), "renames-after")
    only = lambda x, y, keys: x.join(y.select(*[F.col(k).alias(f"o_{k}") for k in keys]).distinct(), [F.col(k) == F.col(f"o_{k}") for k in keys], "left_anti")
    schemas = stored(greedy_pairs(schema_rename_candidates(only(b, a, ["schema"]), only(a, b, ["schema"]))), "renames-schemas")
    moved = b.join(schemas.select("from_name", "to_name"), F.col("schema") == F.col("from_name"), "left").select(F.coalesce("to_name", "schema").alias("schema"), "table", "kind", "child")
    found = _graded(alike_sets(_tables(only(moved, a, ["schema", "table"])), _tables(only(a, moved, ["schema", "table"]))))
    # names are unique within their schema only, so pairs are taken by both
    full = lambda c: F.to_json(F.struct(F.get_json_object("scope", "$.schema").alias("s"), F.col(c).alias("t"))).alias(c)
    pairs = greedy_pairs(found.select(full("from_name"), full("to_name"), "confidence"))
    part = lambda c, x: F.get_json_object(c, f"$.{x}")
    tables = pairs.select(F.lit("table").alias("level"), part("to_name", "s").alias("schema"), part("from_name", "t").alias("from_name"), part("to_name", "t").alias("to_name"), "confidence")
    return schemas.select(F.lit("schema").alias("level"), F.col("to_name").alias("schema"), "from_name", "to_name", "confidence").unionByName(tables)


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """One-to-one renames (from_name, to_name, confidence), best first: by confidence, then by name.

    A pair that is the best of both its names is chosen; what shares no name with a chosen pair goes to the next round. That
    is what taking pairs one by one in this order gives.
    """
    left = stored(candidates.select("from_name", "to_name", "confidence"), "renames")
    order = F.struct((-F.col("confidence")).alias("by"), "from_name", "to_name")
    chosen = left.limit(0)
    while not left.isEmpty():
        by_from, by_to = (left.groupBy(F.col(c).alias(f"k_{c}")).agg(F.min(order).alias("b")).select(f"k_{c}", F.col("b.to_name" if c == "from_name" else "b.from_name").alias(f"best_{c}")) for c in ("from_name", "to_name"))
        both = left.join(by_from, (F.col("from_name") == F.col("k_from_name")) & (F.col("to_name") == F.col("best_from_name"))).join(by_to, (F.col("to_name") == F.col("k_to_name")) & (F.col("from_name") == F.col("best_to_name")))
        now = stored(both.select("from_name", "to_name", "confidence"), "renames")
        chosen = chosen.unionByName(now)
        left = left.join(now.select(F.col("from_name").alias("uf")), F.col("from_name") == F.col("uf"), "left_anti")
        left = stored(left.join(now.select(F.col("to_name").alias("ut")), F.col("to_name") == F.col("ut"), "left_anti"), "renames")
    return chosen


def type_warnings(pairs: DataFrame) -> DataFrame:
    """(name, warning) for column pairs (name, from_kind, from_length, from_nullable, to_kind, to_length, to_nullable)."""
    rank = lambda c: F.expr(f"array_position(array('smallint','integer','bigint','decimal','float','double'), {c})")
    numbers = (rank("from_kind") > 0) & (rank("to_kind") > 0)
    texts = F.col("from_kind").isin("char", "string", "text") & F.col("to_kind").isin("char", "string")
    warnings = F.array_compact(
        F.array(
            F.when(texts & (F.col("from_length").isNull() | (F.col("from_length") > F.col("to_length"))), "may_truncate"),
            F.when(numbers & (rank("to_kind") < rank("from_kind")), "may_lose_precision"),
            F.when(F.col("from_kind").isin("char", "string", "text", "json") & ~F.col("to_kind").isin("char", "string", "text", "json"), "may_fail_conversion"),
            F.when(F.col("from_nullable") & ~F.col("to_nullable"), "nullable_into_required"),
        )
    )
    return pairs.select("name", F.explode(warnings).alias("warning"))


def sync_plan(source: DataFrame, staging: DataFrame) -> DataFrame:
    """(table, column, action) that brings staging in line with source.

    source (table, column, data_type, nullable); staging the same and source_removed, user_edited, tombstoned. Actions:
    create_table (unless tombstoned), add_column, retype, renullable, conflict (the user edited the field), flag_removed,
    restore.
    """
    s = source.select(F.col("table").alias("st"), F.col("column").alias("sc"), F.col("data_type").alias("stype"), F.col("nullable").alias("snull"))
    g = staging.select(F.col("table").alias("gt"), F.col("column").alias("gc"), F.col("data_type").alias("gtype"), F.col("nullable").alias("gnull"), "source_removed", "user_edited")
    tables = staging.groupBy(F.col("table").alias("kt")).agg(F.max("tombstoned").alias("dead"))
    both = s.join(g, (F.col("st") == F.col("gt")) & (F.col("sc") == F.col("gc")), "full").join(tables, F.coalesce("st", "gt") == F.col("kt"), "left")
    changed = (F.col("stype") != F.col("gtype")) | (F.col("snull") != F.col("gnull"))
    action = (
        F.when(F.col("dead"), None)
        .when(F.col("kt").isNull(), "create_table")
        .when(F.col("gt").isNull(), "add_column")
        .when(F.col("st").isNull(), F.when(~F.col("source_removed"), "flag_removed"))
        .when(F.col("source_removed"), "restore")
        .when(changed & F.col("user_edited"), "conflict")
        .when(F.col("stype") != F.col("gtype"), "retype")
        .when(F.col("snull") != F.col("gnull"), "renullable")
    )
    return both.select(F.coalesce("st", "gt").alias("table"), F.coalesce("sc", "gc").alias("column"), action.alias("action")).where("action IS NOT NULL")


def droppable(tables: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_type, object_id, label) of what an owner may drop of staging: tables and columns that are gone from the source
    and that nothing reads.

    tables: (table_id, name, status); columns: (column_id, table_id, name, status); edges: (source), column ids that are read.
    A table goes with its columns, none of which may be read; columns go one by one where their table stays.
    """
    read = edges.select(F.col("source").alias("__r")).where("__r IS NOT NULL").distinct()
    own = columns.join(read, F.col("column_id") == F.col("__r"), "left").withColumn("used", F.col("__r").isNotNull())
    busy = own.where("used").select(F.col("table_id").alias("__b")).distinct()
    gone = tables.where("status = 'source_removed'")
    whole = gone.join(busy, F.col("table_id") == F.col("__b"), "left_anti").select(F.lit("table").alias("object_type"), F.col("table_id").alias("object_id"), F.col("name").alias("label"))
    stay = tables.where("NOT status <=> 'source_removed'").select(F.col("table_id").alias("__t"), F.col("name").alias("__name"))
    single = own.where("status = 'source_removed' AND NOT used").join(stay, F.col("table_id") == F.col("__t"))
    return whole.unionByName(single.select(F.lit("column").alias("object_type"), F.col("column_id").alias("object_id"), F.concat_ws(".", "__name", "name").alias("label")))


def numbered(new: DataFrame, existing: DataFrame, scope: str, name: str, number: str) -> DataFrame:
    """new (scope, name) with stable numbers: they go on after the highest of their scope, by name."""
    top = existing.groupBy(F.col(scope).alias("__s")).agg(F.max(number).alias("__top"))
    fresh = new.join(existing.select(F.col(scope).alias("__es"), F.col(name).alias("__en")), (F.col(scope) == F.col("__es")) & (F.col(name) == F.col("__en")), "left_anti")
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(name))
    return fresh.join(top, F.col(scope) == F.col("__s"), "left").select(scope, name, (F.coalesce("__top", F.lit(0)) + rank).cast("long").alias(number))
