"""Rules of a warehouse model: which mappings are sound, what edges they leave, which columns are protected, what a change
set depends on, whether a KPI can be computed and what it may link to. All rules are joins over metadata tables."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.graph import levels, reach, spread, turned
from millrace.session import stored

# Mapping types, those that carry no SQL, statuses of findings that protect a column, and a layer's inputs.
MAPPING_TYPES = ("direct", "hashed", "derived", "constant", "lookup", "system", "not_in_branch", "unmapped")
WITHOUT_SQL = ("unmapped", "not_in_branch", "lookup", "system")
SYSTEM_ROLES = ("sk", "scd", "audit")
PROTECTING = ("suggested", "accepted")
LAYER_BELOW = {"core": "staging", "mart": "core"}


def _problems(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in found]))


def mapping_problems(mappings: DataFrame) -> DataFrame:
    """(column_id, problem) of column mappings (column_id, mapping_type, sql, role, in_branch).

    SQL is asked for but where the type carries none; system columns alone are mapped as system, and only at table level;
    not_in_branch is for branches; hashed mappings are set by accepting a finding, never by hand.
    """
    kind, sql = F.col("mapping_type"), F.coalesce(F.trim("sql"), F.lit(""))
    bare = kind.isin(*WITHOUT_SQL)
    known = kind.isin(*MAPPING_TYPES)
    found = _problems(
        (kind == "hashed", "hashed_by_hand"),
        (kind.isNull() | ~known | ((kind == "not_in_branch") & ~F.col("in_branch")), "type_not_allowed"),
        (bare & (sql != ""), "sql_not_allowed"),
        (known & ~bare & (kind != "hashed") & (sql == ""), "sql_missing"),
        ((kind == "system") & (F.col("in_branch") | ~F.coalesce(F.col("role").isin(*SYSTEM_ROLES), F.lit(False))), "not_a_system_column"),
    )
    return mappings.select("column_id", F.explode(found).alias("problem"))


def lookup_problems(lookups: DataFrame, dimensions: DataFrame, columns: DataFrame) -> DataFrame:
    """(column_id, problem) of lookups (column_id, layer, role, dimension_id, nk_inputs array, as_of).

    dimensions: (table_id, scd_type). columns: (table_id, role, is_system). A lookup belongs to a core foreign key with a
    dimension, has an input for each natural-key column, each a bare table.column, and a date where the dimension keeps versions.
    """
    keys = columns.where("role = 'nk' AND NOT is_system").groupBy(F.col("table_id").alias("kt")).agg(F.count(F.lit(1)).alias("n_keys"))
    all_ = lookups.join(dimensions.select(F.col("table_id").alias("dt"), "scd_type"), F.col("dimension_id") == F.col("dt"), "left").join(keys, F.col("dimension_id") == F.col("kt"), "left")
    inputs, bare = F.coalesce("nk_inputs", F.array().cast("array<string>")), r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$"
    found = _problems(
        ((F.col("layer") != "core") | ~F.coalesce(F.col("role") == "fk", F.lit(False)) | F.col("dt").isNull(), "not_a_core_foreign_key"),
        (F.size(inputs) == 0, "no_key_inputs"),
        ((F.size(inputs) > 0) & F.col("dt").isNotNull() & (F.size(inputs) != F.coalesce("n_keys", F.lit(0))), "key_count"),
        (F.exists(inputs, lambda x: ~x.rlike(bare)) | ~F.col("as_of").rlike(bare), "input_not_a_column"),
        ((F.col("scd_type") == 2) & F.col("as_of").isNull(), "no_as_of"),
    )
    return all_.select("column_id", F.explode(found).alias("problem"))


def resolved_inputs(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """refs (mapping_id, layer, table, column, use) with input_id, the column meant, and problem: unqualified or unknown.

    layer is the target's; inputs must be columns of the layer directly below. Names compare without case. columns:
    (column_id, layer, table, column).
    """
    below = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in LAYER_BELOW.items()])
    c = columns.select(F.col("column_id").alias("input_id"), F.col("layer").alias("cl"), F.lower("table").alias("ct"), F.lower("column").alias("cc"))
    met = refs.withColumn("__below", below).join(c, (F.col("__below") == F.col("cl")) & (F.lower("table") == F.col("ct")) & (F.lower("column") == F.col("cc")), "left")
    problem = F.when(F.col("table").isNull(), "unqualified").when(F.col("input_id").isNull(), "unknown_input")
    return met.select(*[F.col(f"`{x}`") for x in refs.columns], "input_id", problem.alias("problem"))


def mapping_edges(resolved: DataFrame, targets: DataFrame, lookups: DataFrame) -> DataFrame:
    """(mapping_id, kind, source, target): what each mapping leaves in the lineage graph.

    A value input points to the target column, a used one to the target's table, and a lookup's foreign key to its dimension.
    targets: (mapping_id, column_id, table_id); lookups: (mapping_id, dimension_id).
    """
    t = targets.select(F.col("mapping_id").alias("tm"), "column_id", "table_id")
    good = resolved.where("problem IS NULL").join(t, F.col("mapping_id") == F.col("tm"))
    inputs = good.select("mapping_id", F.col("use").alias("kind"), F.col("input_id").alias("source"), F.when(F.col("use") == "value", F.col("column_id")).otherwise(F.col("table_id")).alias("target"))
    found = lookups.join(t, F.col("mapping_id") == F.col("tm")).select("mapping_id", F.lit("lookup").alias("kind"), F.col("column_id").alias("source"), F.col("dimension_id").alias("target"))
    return inputs.unionByName(found).distinct()


def replaced_edges(edges: DataFrame, new: DataFrame, saved: DataFrame) -> DataFrame:
    """edges with those of the saved mappings (mapping_id) replaced by the new ones."""
    return edges.join(saved.select(F.col("mapping_id").alias("sm")).distinct(), F.col("mapping_id") == F.col("sm"), "left_anti").unionByName(new)


def protected_columns(columns: DataFrame, findings: DataFrame) -> DataFrame:
    """columns (column_id, is_sensitive and others) with `protected`: sensitive, or with a suggested or accepted finding."""
    hit = findings.where(F.col("status").isin(*PROTECTING)).select(F.col("column_id").alias("fc")).distinct()
    met = columns.join(hit, F.col("column_id") == F.col("fc"), "left")
    return met.withColumn("protected", F.coalesce("is_sensitive", F.lit(False)) | F.col("fc").isNotNull()).drop("fc")


def new_suspected(old: DataFrame, new: DataFrame, findings: DataFrame) -> DataFrame:
    """(column_id, category, status) of the columns (column_id) of a new snapshot that the old one lacks and a finding protects."""
    added = new.select("column_id").join(old.select("column_id"), "column_id", "left_anti").distinct()
    return findings.where(F.col("status").isin(*PROTECTING)).select("column_id", "category", "status").join(added, "column_id", "left_semi")


def closure_of_items(items: DataFrame, roots: DataFrame, dependents: bool) -> DataFrame:
    """(item): the roots (item) of a change set and all that depends on them, or all that they depend on.

    items: (item, depends_on array).
    """
    edges = items.select(F.col("item").alias("target"), F.explode("depends_on").alias("source"))
    return reach(edges if dependents else turned(edges), roots.select(F.col("item").alias("node"))).select(F.col("node").alias("item")).distinct()


# Statuses of change-set items that await a decision.
OPEN_ITEMS = ("pending", "needs_owner")
#: Items up to which a change set is decided by one task.
SMALL_SET = 10_000


def accepted_items(items: DataFrame, selected: DataFrame | None = None, owner: bool = False, small: int = SMALL_SET) -> DataFrame:
    """(change_set, item, status, reason) of all items after the selected ones (item; by default all open ones) are accepted.

    items: (change_set, item, depends_on array, status, required_role, stale). What a selected item depends on is accepted
    with it. Items that need an owner, unless one decides, wait as needs_owner and what depends on them as pending. Of the
    others, those that are stale, depend on one that was not applied or is not there, or stand on a cycle of dependencies or
    behind it, are skipped as stale, with all that depend on them; the rest is accepted. Other open items expire, unless they
    depend on one that an owner has to decide. Closed items stay as they are. reason is stale, not_applied, cycle or
    depends_on_skipped for skipped items. Null items are left out.

    Change sets of `small` items at most that share no item and no dependency with another are dealt over the tasks and
    decided one by one; all others are walked together by joins, with the same result.
    """
    asked = F.col("status").isin(*OPEN_ITEMS) if selected is None else F.col("__w").isNotNull()
    rows = items.where("item IS NOT NULL")
    if selected is not None:
        rows = rows.join(selected.select(F.col("item").alias("__w")).distinct(), F.col("item") == F.col("__w"), "left")
    flags = (F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce(asked, F.lit(False)).alias("wanted"))
    rows = stored(rows.select("change_set", "item", "depends_on", "status", "required_role", *flags), "items")
    if not _plain_keys(rows):
        return _accepted_by_joins(rows, owner)
    apart = _sets_apart(rows, small)
    if apart.isEmpty():
        return _accepted_by_sets(rows, owner)
    near = rows.join(apart, F.col("change_set") == F.col("__a"), "left_anti").where("change_set IS NOT NULL")
    far = rows.join(apart, F.col("change_set") == F.col("__a"), "left_semi").unionByName(rows.where("change_set IS NULL"))
    return _accepted_by_sets(near, owner).unionByName(_accepted_by_joins(stored(far, "items-apart"), owner))


def _plain_keys(rows: DataFrame) -> bool:
    """Whether Python tells items and change sets apart as Spark does: whole numbers or texts."""
    kind = lambda t: "number" if isinstance(t, T.IntegralType) else t.simpleString()
    of = {f.name: f.dataType for f in rows.schema.fields}
    item, change_set = kind(of["item"]), kind(of["change_set"])
    return {item, change_set} <= {"number", "string"} and kind(of["depends_on"].elementType) == item


def _sets_apart(rows: DataFrame, small: int) -> DataFrame:
    """(__a): the change sets of more than `small` items, and those that name an item which another set holds or names, or that
    is there more than once; null where there are items without a change set."""
    named = rows.select("change_set", F.explode("depends_on").alias("node")).where("node IS NOT NULL").withColumn("here", F.lit(0))
    every = rows.select("change_set", F.col("item").alias("node"), F.lit(1).alias("here")).unionByName(named)
    low, high, bare = F.min("change_set").alias("low"), F.max("change_set").alias("high"), F.count_if(F.col("change_set").isNull()).alias("bare")
    linking = every.groupBy("node").agg(low, high, bare, F.sum("here").alias("n")).where("n > 1 OR (n = 1 AND (low <> high OR bare > 0))")
    linking = stored(linking.select(F.col("node").alias("__l")), "items-linking")
    large = rows.groupBy("change_set").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > small) | F.col("change_set").isNull()).select("change_set")
    linked = every.join(linking, F.col("node") == F.col("__l"), "left_semi").select("change_set")
    found = large if linking.isEmpty() else large.unionByName(linked)
    return stored(found.select(F.col("change_set").alias("__a")).distinct(), "sets-apart")


def _accepted_by_sets(rows: DataFrame, owner: bool) -> DataFrame:
    """accepted_items() of change sets that have nothing to do with one another; a task holds one set and a batch of rows."""
    told = rows.select("change_set", "item", "depends_on", "status", (F.lit(not owner) & F.coalesce(F.col("required_role") == "owner", F.lit(False))).alias("for_owner"), "stale", "wanted")
    schema = T.StructType([rows.schema["change_set"], rows.schema["item"], T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())])

    def decide(batches):
        members: list[tuple] = []  # those of the last set so far, which may go on in the next batch
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in (0, 1)] + [pa.string(), pa.string()]
            sets = [list(x) for _, x in groupby(members + list(zip(*[c.to_pylist() for c in batch.columns])), key=lambda r: r[0])]
            members = sets.pop() if sets else []
            yield from out(sets, kinds)
        yield from out([members] if members else [], kinds)

    def out(sets, kinds):
        decided = [x for one in sets for x in _decided(one)]
        if decided:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*decided), kinds)], names=schema.names)

    return told.repartition("change_set").sortWithinPartitions("change_set").mapInArrow(decide, schema)


def _decided(members: list[tuple]) -> list[tuple]:
    """(change_set, item, status, reason) of the members (change_set, item, depends_on, status, for_owner, stale, wanted) of one set."""
    at = {m[1]: i for i, m in enumerate(members)}
    status = [m[3] for m in members]
    before: list[list[int]] = [[] for _ in members]
    after: list[list[int]] = [[] for _ in members]
    unmet = set()
    for i, m in enumerate(members):
        for d in m[2] or ():
            if d is None:
                continue
            j = at.get(d)
            if j is None or status[j] not in ("accepted", *OPEN_ITEMS):
                unmet.add(i)
            if j is not None:
                before[i].append(j)
                after[j].append(i)

    def walk(start, step, inside=None):
        seen = set(start)
        queue = list(seen)
        for n in queue:
            for t in step[n]:
                if t not in seen and (inside is None or t in inside):
                    seen.add(t)
                    queue.append(t)
        return seen

    chosen = {i for i in walk((i for i, m in enumerate(members) if m[6]), before) if status[i] in OPEN_ITEMS}
    held = {i for i in chosen if members[i][4]}
    waiting = walk(held, after) & chosen
    candidates = chosen - waiting
    left = [len(b) for b in before]
    ready = [i for i, n in enumerate(left) if n == 0]
    for n in ready:
        for t in after[n]:
            left[t] -= 1
            if left[t] == 0:
                ready.append(t)
    why = {i: "cycle" if left[i] else "not_applied" if i in unmet else "stale" for i in candidates if left[i] or i in unmet or members[i][5]}
    skipped = walk(why, after, candidates)
    for i in chosen:
        status[i] = ("needs_owner" if i in held else "pending") if i in waiting else "stale" if i in skipped else "accepted"
    kept = walk((i for i, x in enumerate(status) if x == "needs_owner"), after) | waiting
    reason = lambda i: why.get(i, "depends_on_skipped") if i in skipped else None
    return [(m[0], m[1], "expired" if status[i] in OPEN_ITEMS and i not in kept else status[i], reason(i)) for i, m in enumerate(members)]


def _accepted_by_joins(rows: DataFrame, owner: bool) -> DataFrame:
    """accepted_items() of the stored rows, whose dependencies are walked in rounds of joins."""
    node = F.col("item").alias("node")
    edges = stored(rows.select(F.explode("depends_on").alias("source"), F.col("item").alias("target")).where("source IS NOT NULL"), "item-edges")
    pick = lambda df: rows.join(df.select(F.col("node").alias("__n")).distinct(), F.col("item") == F.col("__n"), "left_semi")
    drop = lambda df, other: df.join(other.select(F.col("node").alias("__n")).distinct(), F.col("item") == F.col("__n"), "left_anti")
    is_open = F.col("status").isin(*OPEN_ITEMS)

    wanted = rows.where("wanted").select(node)
    chosen = stored(pick(spread(turned(edges), wanted)).where(is_open), "items-chosen")
    held = chosen.where("required_role = 'owner'").select(node) if not owner else rows.limit(0).select(node)
    waiting = stored(pick(spread(edges, held)).join(chosen.select(F.col("item").alias("__c")), F.col("item") == F.col("__c"), "left_semi").select(node), "items-waiting")
    candidates = stored(drop(chosen, waiting), "items-candidates")

    known = rows.select(F.col("item").alias("ki"), F.col("status").alias("ks"))
    unmet = edges.join(known, F.col("source") == F.col("ki"), "left").where(F.col("ks").isNull() | ~F.col("ks").isin("accepted", *OPEN_ITEMS))
    unmet = unmet.select(F.col("target").alias("un"), F.lit("not_applied").alias("u")).distinct()
    cycle = levels(edges, rows.select(node)).where("level IS NULL").select(F.col("node").alias("cn"), F.lit("cycle").alias("c"))
    own = F.coalesce("c", "u", F.when(F.col("stale"), F.lit("stale")))
    blocked = candidates.join(cycle, F.col("item") == F.col("cn"), "left").join(unmet, F.col("item") == F.col("un"), "left").select("item", own.alias("why")).where("why IS NOT NULL")
    blocked = stored(blocked, "items-blocked")
    among = edges.join(candidates.select(F.col("item").alias("__s")), F.col("source") == F.col("__s"), "left_semi").join(candidates.select(F.col("item").alias("__t")), F.col("target") == F.col("__t"), "left_semi")
    skipped = spread(among, blocked.select(node)).select(F.col("node").alias("sn"))

    waits = waiting.select(F.col("node").alias("wn"))
    needs = rows.join(waits, F.col("item") == F.col("wn"), "left").join(candidates.select(F.col("item").alias("can")), F.col("item") == F.col("can"), "left")
    needs = needs.join(held.select(F.col("node").alias("hn")).distinct(), F.col("item") == F.col("hn"), "left").join(skipped, F.col("item") == F.col("sn"), "left").join(blocked.select(F.col("item").alias("bn"), "why"), F.col("item") == F.col("bn"), "left")
    decided = (
        F.when(F.col("wn").isNotNull(), F.when(F.col("hn").isNotNull(), "needs_owner").otherwise("pending"))
        .when(F.col("can").isNotNull(), F.when(F.col("sn").isNotNull(), "stale").otherwise("accepted"))
        .otherwise(F.col("status"))
    )
    reason = F.when(F.col("can").isNotNull() & F.col("sn").isNotNull(), F.coalesce("why", F.lit("depends_on_skipped")))
    after = stored(needs.select("change_set", "item", decided.alias("status"), reason.alias("reason"), F.col("wn").isNotNull().alias("waits")), "items-decided")
    kept = spread(edges, after.where("status = 'needs_owner'").select(node)).select(F.col("node").alias("kn"))
    met = after.join(kept, F.col("item") == F.col("kn"), "left")
    expires = is_open & ~F.col("waits") & F.col("kn").isNull()
    return met.select("change_set", "item", F.when(expires, "expired").otherwise(F.col("status")).alias("status"), "reason")


def change_set_statuses(items: DataFrame) -> DataFrame:
    """(change_set, status) by its items (change_set, status): pending while one is open, else rejected, applied or partially_applied."""
    accepted, n = F.count_if(F.col("status") == "accepted"), F.count(F.lit(1))
    waits = F.count_if(F.col("status").isin(*OPEN_ITEMS)) > 0
    return items.groupBy("change_set").agg(F.when(waits, "pending").when(accepted == 0, "rejected").when(accepted == n, "applied").otherwise("partially_applied").alias("status"))


def input_problems(reads: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(mapping_id, code, name): what mappings read that is not there any more (broken_reference), or that is gone from the
    source (removed_input).

    reads: (mapping_id, layer, table, column), layer being where they read; column is null where a table alone is named.
    tables: (layer, table, status); columns: (layer, table, column, status). A table that is not there is named once, and its
    columns are not looked for. Names compare without case.
    """
    asked = reads.select("mapping_id", "layer", F.lower("table").alias("t"), F.lower("column").alias("c")).distinct()
    tt = tables.select(F.col("layer").alias("tl"), F.lower("table").alias("tn"), F.col("status").alias("ts")).distinct()
    cc = columns.select(F.col("layer").alias("cl"), F.lower("table").alias("ct"), F.lower("column").alias("cn"), F.col("status").alias("cs")).distinct()
    met = asked.join(tt, (F.col("layer") == F.col("tl")) & (F.col("t") == F.col("tn")), "left")
    met = met.join(cc, (F.col("layer") == F.col("cl")) & (F.col("t") == F.col("ct")) & (F.col("c") == F.col("cn")), "left")
    gone = lambda c: F.coalesce(F.col(c) == "source_removed", F.lit(False))
    name = F.concat_ws(".", "t", "c")
    found = F.array_compact(
        F.array(
            F.when(F.col("tn").isNull(), F.struct(F.lit("broken_reference").alias("code"), F.col("t").alias("name"))),
            F.when(F.col("tn").isNotNull() & F.col("c").isNotNull() & F.col("cn").isNull(), F.struct(F.lit("broken_reference").alias("code"), name.alias("name"))),
            F.when(gone("ts"), F.struct(F.lit("removed_input").alias("code"), F.col("t").alias("name"))),
            F.when(~gone("ts") & gone("cs"), F.struct(F.lit("removed_input").alias("code"), name.alias("name"))),
        )
    )
    return met.select("mapping_id", F.explode(found).alias("f")).select("mapping_id", "f.code", "f.name").distinct()


def unintegrated(branches: DataFrame, rules: DataFrame) -> DataFrame:
    """(table_id, branches) of the tables that several branches (table_id, branch) feed without an integration rule (table_id,
    integration_rule) that says how their rows become one."""
    told = rules.where("trim(coalesce(integration_rule, '')) <> ''").select(F.col("table_id").alias("__t")).distinct()
    n = branches.groupBy("table_id").agg(F.count_distinct("branch").alias("branches")).where("branches > 1")
    return n.join(told, F.col("table_id") == F.col("__t"), "left_anti")


def feasibility(inputs: DataFrame, existing: DataFrame, mapped: DataFrame) -> DataFrame:
    """(kpi, feasibility) of KPIs by their inputs (kpi, column_id): needs_data where one does not exist, needs_mapping where
    one is not mapped, else computable."""
    e, m = existing.select(F.col("column_id").alias("ec")).distinct(), mapped.select(F.col("column_id").alias("mc")).distinct()
    met = inputs.join(e, F.col("column_id") == F.col("ec"), "left").join(m, F.col("column_id") == F.col("mc"), "left")
    missing, bare = F.count_if(F.col("column_id").isNotNull() & F.col("ec").isNull()), F.count_if(F.col("column_id").isNotNull() & F.col("mc").isNull())
    return met.groupBy("kpi").agg(F.when(missing > 0, "needs_data").when(bare > 0, "needs_mapping").otherwise("computable").alias("feasibility"))


def refused_links(links: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """(kpi, column_id, problem) of KPI links (kpi, column_id): not a core or mart column, or a core column that a mart column
    is already mapped from. columns: (column_id, layer); edges: (source, target, kind)."""
    layer = columns.select(F.col("column_id").alias("lc"), "layer")
    read = edges.where("kind = 'value'").join(layer.where("layer = 'mart'"), F.col("target") == F.col("lc")).select(F.col("source").alias("rs")).distinct()
    met = links.join(layer, F.col("column_id") == F.col("lc"), "left").join(read, F.col("column_id") == F.col("rs"), "left")
    problem = F.when(F.col("layer").isNull() | ~F.col("layer").isin("core", "mart"), "not_in_core_or_mart").when((F.col("layer") == "core") & F.col("rs").isNotNull(), "read_by_mart")
    return met.withColumn("problem", problem).where("problem IS NOT NULL").select("kpi", "column_id", "problem")


def repointed_links(links: DataFrame, mappings: DataFrame, columns: DataFrame) -> DataFrame:
    """links (kpi, column_id) with core columns replaced by the mart column that is now mapped directly from them.

    mappings: (source, target, mapping_type). Where several mart columns are, the first by id is taken.
    """
    layer = columns.select(F.col("column_id").alias("lc"), "layer")
    up = mappings.where("mapping_type = 'direct'").join(layer.where("layer = 'mart'"), F.col("target") == F.col("lc")).groupBy(F.col("source").alias("us")).agg(F.min("target").alias("up"))
    core = links.join(layer.where("layer = 'core'").select(F.col("lc").alias("kc")), F.col("column_id") == F.col("kc"), "left").join(up, (F.col("column_id") == F.col("us")) & F.col("kc").isNotNull(), "left")
    return core.select("kpi", F.coalesce("up", "column_id").alias("column_id")).distinct()


def layer_progress(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """(layer, columns, mapped, progress) of the columns (column_id, layer): not_started, in_progress or complete.

    mappings: (column_id, mapping_type); an unmapped one does not count.
    """
    done = mappings.where("mapping_type <> 'unmapped'").select(F.col("column_id").alias("mc")).distinct()
    per = columns.join(done, F.col("column_id") == F.col("mc"), "left").groupBy("layer").agg(F.count(F.lit(1)).alias("columns"), F.count("mc").alias("mapped"))
    return per.withColumn("progress", F.when(F.col("mapped") == 0, "not_started").when(F.col("mapped") < F.col("columns"), "in_progress").otherwise("complete"))


def personal_columns(df: DataFrame, strong: dict, weak: dict, share: float = 0.8, least: int = 3) -> DataFrame:
    """(column_name, rule): columns of df whose values show personal data, by which a result is masked.

    strong, weak: validators by rule. One value that passes a strong rule is enough; of a weak one `share` of at least
    `least` values must. One pass, one aggregation; the rule is the first that holds.
    """
    names = [f.name for f in df.schema.fields]
    counts = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]
    counts += [F.count_if(F.coalesce(check(F.col(f"`{c}`").cast("string")), F.lit(False))).alias(f"m{i}_{r}") for i, c in enumerate(names) for r, check in (strong | weak).items()]
    rows = []
    for i, c in enumerate(names):
        rule = F.lit(None).cast("string")
        for r in reversed([*strong, *weak]):
            holds = F.col(f"m{i}_{r}") > 0 if r in strong else (F.col(f"n{i}") >= least) & (F.col(f"m{i}_{r}") >= share * F.col(f"n{i}"))
            rule = F.when(holds, r).otherwise(rule)
        rows.append(F.struct(F.lit(c).alias("column_name"), rule.alias("rule")))
    return df.agg(*counts).select(F.inline(F.array(*rows))).where("rule IS NOT NULL")
