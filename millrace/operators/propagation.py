"""What a change carries with it: snapshots stored over earlier ones, renames, new types, nullability and removals along the
mappings, suggestions merged with decisions, and sheets of mappings read back as changes. Joins over metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import reach
from millrace.session import stored
from millrace.sources.sinks import sheet_cell

# The columns of a mapping sheet, and of a data dictionary.
MAPPING_SHEET = ("layer", "target_table", "branch", "target_column", "target_type", "input_table", "input_column(s)", "transformation_rule", "sql_expression", "mapping_type", "notes")
DICTIONARY = ("schema", "table", "column", "data_type", "nullable", "is_key", "description")


def stored_snapshot(old: DataFrame, new: DataFrame, allowed: list[str], folds_case: bool = False) -> DataFrame:
    """The columns (schema, table, column, definition, status, version) of a source after a new snapshot of it.

    old has these columns; new has (schema, table, column, definition). A column that is found again is present, takes the
    new spelling and definition, and one version more if either changed; a new one has version 1. One that is gone is
    source_removed where its table is still there or its schema is among the allowed, else out_of_scope. Names meet as
    written first; where the source folds case they meet without it.
    """
    fold = (lambda c: F.lower(c)) if folds_case else (lambda c: F.col(c))
    keys = ("schema", "table", "column")
    o = old.select(*[fold(c).alias(f"k_{c}") for c in keys], *[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[fold(c).alias(f"k_{c}") for c in keys], *[F.col(c).alias(f"n_{c}") for c in new.columns])
    tables = n.select("k_schema", "k_table").distinct().withColumn("there", F.lit(True))
    both = o.join(n, [f"k_{c}" for c in keys], "full").join(tables, ["k_schema", "k_table"], "left")
    found, known = F.col("n_column").isNotNull(), F.col("o_column").isNotNull()
    revised = found & known & ~(F.col("o_definition").eqNullSafe(F.col("n_definition")) & (F.col("o_column") == F.col("n_column")))
    gone = F.when(F.col("there") | F.col("o_schema").isin(*allowed), "source_removed").otherwise("out_of_scope")
    return both.select(
        *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in keys], F.when(found, F.col("n_definition")).otherwise(F.col("o_definition")).alias("definition"), F.when(found, "present").otherwise(gone).alias("status"),
        (F.coalesce("o_version", F.lit(1)) + revised.cast("int")).alias("version"),
    )


def adopted(objects: DataFrame, renames: DataFrame) -> DataFrame:
    """objects (id, name, status and others) after renames (from_name, to_name): the old object takes the new name and is
    present again, and the object that stood for the new name goes."""
    r = renames.select("from_name", "to_name")
    kept = objects.join(r.select(F.col("to_name").alias("tn")), F.col("name") == F.col("tn"), "left_anti").join(r, F.col("name") == F.col("from_name"), "left")
    changed = {"name": F.coalesce("to_name", "name"), "status": F.when(F.col("to_name").isNotNull(), "present").otherwise(F.col("status"))}
    return kept.withColumns(changed).select(*objects.columns)


#: Text literals and comments of a statement.
_QUOTED = r"'(?:[^']|'')*'|--[^\n]*|(?s:/\*.*?\*/)"


def rewritten(mappings: DataFrame, renames: DataFrame) -> DataFrame:
    """(mapping_id, sql) of the mappings (mapping_id, sql) whose text names a renamed column (table, from_name, to_name).

    A name is found qualified by its table's own name, as a whole word and without case: table.column; columns behind an
    alias of the table stay as they are. What stands in a text literal or a comment is left alone. Each different text is
    rewritten once, whatever number of mappings have it, and meets only the renames of tables that it names. Mappings that are
    there twice are given once.
    """
    texts = stored(mappings.where("sql IS NOT NULL").select("sql").distinct().withColumn("no", F.monotonically_increasing_id()), "texts")
    by_table = stored(renames.select(F.lower("table").alias("rt"), F.struct("table", "from_name", "to_name").alias("rename")).where("rt IS NOT NULL"), "renames-by-table")
    named = texts.select("no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(r"\b([a-z_]\w*)\.[a-z_]\w*\b"), F.lit(1)))).alias("t"))
    listed = named.join(by_table, F.col("t") == F.col("rt")).groupBy(F.col("no").alias("ln")).agg(F.sort_array(F.collect_set("rename")).alias("renames"))
    word = lambda r: F.concat(F.lit(r"(?i)\b("), r["table"], F.lit(r")\."), r["from_name"], F.lit(r"\b"))
    renamed = lambda text: F.aggregate("renames", text, lambda t, r: F.regexp_replace(t, word(r), F.concat(F.lit("$1."), r["to_name"])))
    code, quoted = F.split("sql", _QUOTED, -1), F.regexp_extract_all("sql", F.lit(_QUOTED), F.lit(0))
    new = F.array_join(F.zip_with(code, quoted, lambda c, q: F.concat(renamed(c), F.coalesce(q, F.lit("")))), "")
    changed = stored(texts.join(listed, F.col("no") == F.col("ln")).select("no", F.col("sql").alias("old"), new.alias("new")).where(~F.col("new").eqNullSafe(F.col("old"))), "texts-rewritten")
    # numbers, not texts, go along while mappings are made unique
    met = mappings.join(changed.select("no", "old"), F.col("sql") == F.col("old")).select("mapping_id", F.col("no").alias("mn")).distinct()
    return met.join(changed.select("no", "new"), F.col("mn") == F.col("no")).select("mapping_id", F.col("new").alias("sql"))


def names_now(renames: DataFrame) -> DataFrame:
    """(scope, name, now): what each former name in a log of renames (scope, from_name, to_name, at) has become.

    A rename is followed by the first later one of the name that it gave; chains are followed by pointer jumping, so rounds
    grow with the logarithm of the longest. A name that was given up several times means what it became the last time. Names
    compare without case; of renames at one time, those that give a name come before those that take it.
    """
    log = renames.where("from_name IS NOT NULL AND to_name IS NOT NULL AND at IS NOT NULL").select("scope", F.lower("from_name").alias("old"), F.col("to_name").alias("new"), "at").distinct()
    log = stored(log.withColumn("id", F.xxhash64("scope", "old", "new", "at")), "renames")
    given = log.select("scope", F.lower("new").alias("name"), "at", F.lit(0).alias("takes"), "id")
    taken = log.select("scope", F.col("old").alias("name"), "at", F.lit(1).alias("takes"), "id")
    later = Window.partitionBy("scope", "name").orderBy("at", "takes", "id").rowsBetween(1, Window.unboundedFollowing)
    after = given.unionByName(taken).withColumn("next", F.first(F.when(F.col("takes") == 1, F.col("id")), ignorenulls=True).over(later)).where("takes = 0").select(F.col("id").alias("ni"), "next")
    at = stored(log.join(after, F.col("id") == F.col("ni")).select("id", "new", F.when(F.col("next") != F.col("id"), F.col("next")).alias("next")), "renames")
    while not at.where("next IS NOT NULL").isEmpty():
        far = at.select(F.col("id").alias("fi"), F.col("new").alias("fn"), F.col("next").alias("ff"))
        at = stored(at.join(far, F.col("next") == F.col("fi"), "left").select("id", F.coalesce("fn", "new").alias("new"), F.col("ff").alias("next")), "renames")
    ends = log.select("id", "scope", "old", "at").join(at.select(F.col("id").alias("ei"), F.col("new").alias("now")), F.col("id") == F.col("ei"))
    return ends.groupBy("scope", F.col("old").alias("name")).agg(F.max_by("now", F.struct("at", "id")).alias("now"))


def open_impacts(reads: DataFrame, tables: DataFrame, columns: DataFrame, renames: DataFrame) -> DataFrame:
    """(object_type, object_id, change, old_name, new_name): the changes behind what mappings read and no longer find.

    reads: (layer, table, column) that mappings name, layer being where they read; column is null where only the table is
    named. tables: (table_id, layer, name, status); columns: (column_id, table_id, name, status); ids and layers are texts.
    renames: (scope, from_name, to_name, at), the scope of a table being its layer, that of a column its table's id. A name
    that is not there means what it was renamed to, if that is: a rename. A column that is neither there nor renamed is
    removed, its id being that of its table and its name; so are tables and columns of status source_removed. A table that is
    gone without a rename says nothing. Each change is given once.
    """
    former = stored(names_now(renames), "names-now")
    asked = reads.where("table IS NOT NULL").select("layer", F.lower("table").alias("t"), F.lower("column").alias("c")).distinct()
    known = tables.select("table_id", F.col("layer").alias("kl"), F.lower("name").alias("kn"), F.col("name").alias("shown"), F.col("status").alias("table_status"))
    here = known.select("kl", "kn").distinct()
    was = former.select(F.col("scope").alias("ws"), F.col("name").alias("wn"), F.lower("now").alias("now"))
    # a name in use is itself, whatever was called so before
    named = asked.join(here, (F.col("layer") == F.col("kl")) & (F.col("t") == F.col("kn")), "left").join(was, (F.col("layer") == F.col("ws")) & (F.col("t") == F.col("wn")), "left")
    named = named.select("layer", "t", "c", F.when(F.col("kn").isNotNull(), F.col("t")).otherwise(F.col("now")).alias("meant"))
    found = stored(named.join(known, (F.col("layer") == F.col("kl")) & (F.col("meant") == F.col("kn"))), "impacts-tables")
    change = lambda df, kind, key, what, old, new: df.select(F.lit(kind).alias("object_type"), key.alias("object_id"), F.lit(what).alias("change"), old.alias("old_name"), new.alias("new_name"))
    nothing = F.lit(None).cast("string")
    out = change(found.where("t <> meant"), "table", F.col("table_id"), "rename", F.col("t"), F.col("shown"))
    gone = F.coalesce(F.col("table_status") == "source_removed", F.lit(False))
    out = out.unionByName(change(found.where(gone), "table", F.col("table_id"), "removed", nothing, nothing))

    own = columns.select("column_id", F.col("table_id").alias("ot"), F.lower("name").alias("on"), F.col("name").alias("called"), F.col("status").alias("column_status"))
    there = own.select("ot", "on").distinct()
    read = found.where(~gone & F.col("c").isNotNull()).select("table_id", "c").distinct()
    met = read.join(there, (F.col("table_id") == F.col("ot")) & (F.col("c") == F.col("on")), "left").join(was, (F.col("table_id") == F.col("ws")) & (F.col("c") == F.col("wn")), "left")
    met = met.select("table_id", "c", F.when(F.col("on").isNotNull(), F.col("c")).otherwise(F.col("now")).alias("is"))
    column = stored(met.join(own, (F.col("table_id") == F.col("ot")) & (F.col("is") == F.col("on")), "left"), "impacts-columns")
    out = out.unionByName(change(column.where("column_id IS NOT NULL AND c <> is"), "column", F.col("column_id"), "rename", F.col("c"), F.col("called")))
    out = out.unionByName(change(column.where("column_status = 'source_removed'"), "column", F.col("column_id"), "removed", nothing, nothing))
    out = out.unionByName(change(column.where("column_id IS NULL"), "column", F.concat_ws(".", "table_id", "c"), "removed", F.col("c"), nothing))
    return out.distinct()


def retyped(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, action) of a change of type (node): `retype` along direct mappings however far, `flag` where another mapping
    reads a retyped column. edges: (source, target, mapping_type)."""
    direct = reach(edges.where("mapping_type = 'direct'"), changed)
    new = direct.where("hops > 0").select("node").distinct()
    every = direct.select(F.col("node").alias("n")).distinct()
    read = edges.where("mapping_type <> 'direct'").join(every, F.col("source") == F.col("n"), "left_semi").select(F.col("target").alias("node")).distinct()
    return new.withColumn("action", F.lit("retype")).unionByName(read.join(every, F.col("node") == F.col("n"), "left_anti").withColumn("action", F.lit("flag")))


def nullability_flags(edges: DataFrame, changed: DataFrame, columns: DataFrame) -> DataFrame:
    """(node): the columns mapped from one that may now be null (node) which themselves may not, or are keys.

    columns: (column_id, nullable, role)."""
    strict = columns.where("NOT nullable OR role IN ('nk', 'pk', 'sk', 'fk')").select(F.col("column_id").alias("c"))
    read = edges.join(changed.select(F.col("node").alias("n")), F.col("source") == F.col("n"), "left_semi")
    return read.join(strict, F.col("target") == F.col("c"), "left_semi").select(F.col("target").alias("node")).distinct()


def removal_effects(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(node, action) of removed columns (node): mappings that read one are unmapped, tables that use one in a branch are
    flagged. It does not go further. edges: (source, target, kind)."""
    hit = edges.join(removed.select(F.col("node").alias("n")), F.col("source") == F.col("n"), "left_semi")
    return hit.select(F.col("target").alias("node"), F.when(F.col("kind") == "value", "unmap").otherwise("flag").alias("action")).distinct()


def merged_suggestions(known: DataFrame, found: DataFrame) -> DataFrame:
    """(low, high, status, confidence) of relationships after a run of inference.

    known: (a, b, status, origin, confidence); found: (a, b, confidence). Pairs count whichever way round. Decisions and
    manual pairs stay as they are, so a rejected pair stays rejected when its reverse is found; a suggestion that is found
    again takes its new confidence, one that is not is withdrawn.
    """
    pair = (F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    new = found.groupBy(*pair).agg(F.max("confidence").alias("new"))
    old = known.select(*pair, "status", "origin", F.col("confidence").alias("old"))
    both = old.join(new, ["low", "high"], "full")
    open_ = F.coalesce((F.col("status") == "suggested") & (F.col("origin") != "manual"), F.lit(False))
    status = F.when(F.col("status").isNull(), "suggested").when(open_ & F.col("new").isNull(), "withdrawn").otherwise(F.col("status"))
    return both.select("low", "high", status.alias("status"), F.when(F.col("status").isNull() | (open_ & F.col("new").isNotNull()), F.col("new")).otherwise(F.col("old")).alias("confidence"))


def sound_guesses(guesses: DataFrame, columns: DataFrame, least: float) -> DataFrame:
    """(a, b, confidence) of guessed relationships of two different known columns, with confidence brought into 0 to 1 and at
    least `least`."""
    known = columns.select(F.col("column_id").alias("k")).distinct()
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    fit = guesses.where("a <> b").join(known, F.col("a") == F.col("k"), "left_semi").join(known, F.col("b") == F.col("k"), "left_semi")
    return fit.select("a", "b", c.alias("confidence")).where(F.col("confidence") >= least)


def sound_detections(found: DataFrame, columns: DataFrame, categories: dict[str, str], least: float) -> DataFrame:
    """(column_id, rule, category, confidence) of detections (column_id, rule, confidence) of known columns by known rules; the
    category is the rule's, whatever the detection says."""
    known = columns.select(F.col("column_id").alias("k")).distinct()
    category = F.try_element_at(F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]), F.col("rule"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    fit = found.join(known, F.col("column_id") == F.col("k"), "left_semi")
    return fit.select("column_id", "rule", category.alias("category"), c.alias("confidence")).where((F.col("confidence") >= least) & F.col("category").isNotNull())


def current_vectors(passages: DataFrame, model: str) -> DataFrame:
    """passages (embedding, model and others) after a change of the embedding model: vectors of another model are dropped."""
    same = F.col("model").eqNullSafe(F.lit(model))
    return passages.withColumns({"embedding": F.when(same, F.col("embedding")), "model": F.when(same, F.col("model"))})


def mapping_sheet(mappings: DataFrame, inputs: DataFrame) -> DataFrame:
    """The rows of a mapping sheet: mappings (mapping_id and the sheet's other columns) with their inputs (mapping_id, table,
    column) listed once each, in order; every cell safe for spreadsheets."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    i = inputs.groupBy(F.col("mapping_id").alias("im")).agg(listed("table").alias("input_table"), listed("column").alias("input_column(s)"))
    return mappings.join(i, F.col("mapping_id") == F.col("im"), "left").select(*[sheet_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in MAPPING_SHEET])


def sheet_changes(current: DataFrame, sheet: DataFrame) -> DataFrame:
    """(layer, target_table, branch, target_column, change) of a mapping sheet that comes back: `changed` where a rule, SQL,
    type or note differs, `unknown` where there is no such column, `twice` where the sheet has it more than once. Columns
    that the sheet leaves out are left alone."""
    key, told = ["layer", "target_table", "branch", "target_column"], ["transformation_rule", "sql_expression", "mapping_type", "notes"]
    text = lambda c: F.regexp_replace(F.coalesce(F.trim(F.col(c)), F.lit("")), r"^'(?=[=+\-@])", "")
    rows = sheet.select(*[F.coalesce(c, F.lit("")).alias(c) for c in key], F.struct(*[text(c).alias(c) for c in told]).alias("new")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("new").alias("new"))
    now = current.select(*[F.coalesce(c, F.lit("")).alias(c) for c in key], F.struct(*[text(c).alias(c) for c in told]).alias("old"))
    change = F.when(F.col("n") > 1, "twice").when(F.col("old").isNull(), "unknown").when(F.col("old") != F.col("new"), "changed")
    return rows.join(now, key, "left").select(*key, change.alias("change")).where("change IS NOT NULL")


def data_dictionary(columns: DataFrame) -> DataFrame:
    """The rows of a data dictionary, every cell safe for spreadsheets."""
    return columns.select(*[sheet_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in DICTIONARY])


def score_sheet(checks: DataFrame) -> DataFrame:
    """(layer, table, score, failed, hints) of checks (layer, table, check, passed, weight, hint): the weighted share of passed
    checks in percent for every table, every layer (table null) and overall (both null), with the failed checks' hints."""
    passed = F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0))
    failed = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("hint"))))
    rows = checks.groupingSets([["layer", "table"], ["layer"], []], "layer", "table").agg(F.round(100 * passed / F.sum("weight"), 2).alias("score"), F.count_if(~F.col("passed")).alias("failed"), F.array_join(failed, "; ").alias("hints"))
    return rows.withColumn("hints", sheet_cell(F.col("hints")))
