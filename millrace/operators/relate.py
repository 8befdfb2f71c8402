"""Undeclared relationships: which columns refer to which unique columns, scored by rules and then by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the rule score, and of the confidence that counts give.
THRESHOLD = 0.6
NAME, TYPE, UNIQUE, JOINED = 0.40, 0.15, 0.20, 0.45
BOTH_BONUS, UNCOUNTED_CAP, COUNT_WEIGHT, NOT_UNIQUE = 0.05, 0.7, 0.7, 0.3
FEW_DISTINCT, FEW_FACTOR, TIMEOUT_PENALTY, TIMEOUT_FLOOR = 5, 0.5, 0.15, 0.6

# Types that count as one family.
FAMILIES = {
    "integer": "int integer bigint smallint tinyint mediumint int2 int4 int8 serial bigserial smallserial".split(),
    "numeric": ["numeric", "decimal", "number", "money", "float", "real", "double", "double precision", "float4", "float8"],
    "string": ["text", "varchar", "character varying", "char", "character", "bpchar", "nvarchar", "nchar", "varchar2", "nvarchar2", "ntext", "citext", "string", "tinytext", "mediumtext", "longtext"],
    "uuid": ["uuid", "uniqueidentifier"],
    "date": ["date"],
    "timestamp": ["timestamp", "timestamptz", "timestamp with time zone", "timestamp without time zone", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "timestamp_ntz"],
}


def tokens(name: Column) -> Column:
    """Words of an identifier: cut at camelCase, underscores and signs, lower-cased."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")), r"[^\w]+|_"), lambda t: t != "")


def singular(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.rlike("(ses|xes|ches|shes)$"), F.left(w, n - 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.left(w, n - 1))
        .otherwise(w)
    )


def name_similarity(column: Column, table: Column, key: Column) -> Column:
    """How much the names say that column refers to table.key: 1 or 0.8 for <table>_id against a bare key, 0.9 for equal names."""
    own, other = tokens(column), tokens(key)
    bare = (F.size(other) == 1) & other[0].isin("id", "key")
    stem = singular(F.array_join(F.slice(own, 1, F.greatest(F.lit(0), F.size(own) - 1)), ""))
    target = singular(F.array_join(tokens(table), ""))
    against_bare = (
        F.when((F.size(own) < 2) | ~F.element_at(own, -1).isin("id", "key"), 0.0)
        .when(stem == target, 1.0)
        .when((F.length(stem) >= 3) & target.startswith(stem), 0.8)
        .otherwise(0.0)
    )
    nothing = (F.size(own) == 0) | ((F.size(own) == 1) & (own[0] == "id"))
    return F.when(nothing, 0.0).when(bare, against_bare).when(F.array_join(own, "_") == F.array_join(other, "_"), 0.9).otherwise(0.0)


def base_type(data_type: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(data_type, r"\(.*?\)", "")), r"\s+", " "))


def family(base: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, members in FAMILIES.items():
        out = F.when(base.isin(*members), name).otherwise(out)
    return out


def type_match(a: Column, b: Column) -> Column:
    """1 for the same base type, 0.8 for the same family, else 0."""
    x, y = base_type(a), base_type(b)
    return F.when(x == y, 1.0).when(family(x) == family(y), 0.8).otherwise(0.0)


def rule_score(name: Column, type_: Column, unique: Column, joined: Column) -> Column:
    return F.round(F.least(F.lit(1.0), NAME * name + TYPE * type_ + UNIQUE * unique + F.when(joined, JOINED).otherwise(0.0)), 4)


def guess_score(rule: Column, ai: Column, counted: Column) -> Column:
    """The better of two guesses (null: that one did not find the pair), with a bonus where both did."""
    held = F.when(counted, ai).otherwise(F.least(ai, F.lit(UNCOUNTED_CAP)))
    best = F.greatest(F.coalesce(rule, F.lit(0.0)), F.coalesce(F.when(ai.isNotNull(), held), F.lit(0.0)))
    return F.round(F.least(F.lit(1.0), best + F.when(rule.isNotNull() & ai.isNotNull(), BOTH_BONUS).otherwise(0.0)), 4)


def counted_confidence(guess: Column) -> Column:
    """From the guess and the six counts of fk_counts()."""
    unique = (F.col("target_values") > 0) & (F.col("target_values") == F.col("target_distinct"))
    rate = F.when(F.col("child_values") > 0, F.least(F.lit(1.0), F.col("matched_rows") / F.col("child_values"))).otherwise(0.0)
    few = F.when(F.col("child_distinct") < FEW_DISTINCT, FEW_FACTOR).otherwise(1.0)
    return F.when(~unique, NOT_UNIQUE).otherwise(F.round(COUNT_WEIGHT * rate * few + (1 - COUNT_WEIGHT) * guess, 4))


def timed_out_confidence(guess: Column) -> Column:
    return F.round(F.greatest(F.lit(TIMEOUT_FLOOR), guess - TIMEOUT_PENALTY), 4)


def candidates(columns: DataFrame, joins: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Scored candidate pairs from columns (table, column, data_type, unique: 1 declared, 0.8 profiled, 0 not).

    A pair needs equal names or a column named after the table, so pairs are formed by an equality join on the name a
    reference would have, not by trying every column against every key; mined joins (from_table, from_column, to_table,
    to_column) add the pairs whose names say nothing. Of x to y and y to x the stronger stays.
    """
    c = columns.select("table", "column", "data_type", "unique", F.array_join(tokens(F.col("column")), "_").alias("name"), tokens(F.col("column")).alias("words"))
    source = c.select(*[F.col(x).alias(f"from_{x}") for x in c.columns])
    target = c.where("unique > 0").select(*[F.col(x).alias(f"to_{x}") for x in c.columns])
    same = source.join(target, F.col("from_name") == F.col("to_name"))
    # against a bare key the column's stem is the table's name or a beginning of it, of three letters at least
    bare = target.where((F.size("to_words") == 1) & F.element_at("to_words", 1).isin("id", "key")).withColumn("stem_of", singular(F.array_join(tokens(F.col("to_table")), "")))
    starts = bare.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem_of")), lambda n: F.left("stem_of", n))))
    stems = source.withColumn("stem", singular(F.array_join(F.slice("from_words", 1, F.greatest(F.lit(0), F.size("from_words") - 1)), "")))
    named = stems.join(starts, F.col("stem") == F.col("start")).drop("stem", "start", "stem_of")
    pairs = same.unionByName(named).withColumn("joined", F.lit(False))
    if joins is not None:
        j = joins.select(F.col("from_table").alias("jft"), F.col("from_column").alias("jfc"), F.col("to_table").alias("jtt"), F.col("to_column").alias("jtc")).distinct()
        mined = j.join(source, (F.col("from_table") == F.col("jft")) & (F.col("from_column") == F.col("jfc"))).join(target, (F.col("to_table") == F.col("jtt")) & (F.col("to_column") == F.col("jtc")))
        pairs = pairs.unionByName(mined.drop("jft", "jfc", "jtt", "jtc").withColumn("joined", F.lit(True)))
    pairs = pairs.where(~((F.col("from_table") == F.col("to_table")) & (F.col("from_column") == F.col("to_column"))))
    keys = ["from_table", "from_column", "to_table", "to_column"]
    pairs = pairs.groupBy(*keys, "from_data_type", "to_data_type", "to_unique").agg(F.max("joined").alias("joined"))
    pairs = pairs.withColumn("name_score", name_similarity(F.col("from_column"), F.col("to_table"), F.col("to_column"))).withColumn("type_score", type_match(F.col("from_data_type"), F.col("to_data_type")))
    pairs = pairs.where((F.col("type_score") > 0) & ((F.col("name_score") > 0) | F.col("joined")))
    pairs = pairs.withColumn("score", rule_score(F.col("name_score"), F.col("type_score"), F.col("to_unique").cast("double"), F.col("joined")))
    pairs = pairs.where(F.col("score") + 1e-9 >= threshold)
    a, b = F.concat_ws(".", "from_table", "from_column"), F.concat_ws(".", "to_table", "to_column")
    best = pairs.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.max_by(F.struct(*pairs.columns), F.struct("score", "name_score", "from_table", "from_column")).alias("p"))
    return best.select("p.*").select(*keys, "name_score", "type_score", "joined", "score")


def fk_counts(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row of six counts for child.column referring to parent.column; no value leaves the engine.

    Both sides are counted by value first, so a hot value is one row in the join. matched_rows counts join rows: a parent
    value that occurs twice counts its children twice, as the rate is cut at 1 later.
    """
    c = child.groupBy(F.col(child_column).alias("v")).agg(F.count(F.lit(1)).alias("cn")).where("v IS NOT NULL")
    p = parent.groupBy(F.col(parent_column).alias("pv")).agg(F.count(F.lit(1)).alias("pn"))
    both = c.join(p.where("pv IS NOT NULL"), F.col("v") == F.col("pv"), "full")
    nulls = parent.agg(F.count(F.lit(1)).alias("target_rows"))
    sums = both.agg(
        F.coalesce(F.sum("pn"), F.lit(0)).alias("target_values"), F.count("pn").alias("target_distinct"), F.coalesce(F.sum("cn"), F.lit(0)).alias("child_values"), F.count("cn").alias("child_distinct"),
        F.coalesce(F.sum(F.col("cn") * F.col("pn")), F.lit(0)).alias("matched_rows"),
    )
    return nulls.crossJoin(sums)  # one row with one row


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows with a value that the parent does not have."""
    keys = parent.select(F.col(parent_column).alias("__k")).distinct()
    return child.where(F.col(child_column).isNotNull()).join(keys, F.col(child_column) == F.col("__k"), "left_anti")


def mined_joins(definitions: DataFrame, columns: DataFrame) -> DataFrame:
    """Column equalities in the text of views and routines (object, sql): (object, from_table, from_column, to_table, to_column).

    Aliases are read from FROM and JOIN clauses and comma lists; an equality counts when both sides are qualified columns of
    known tables. This reads conventional SQL only, it is no parser.
    """
    low = F.lower(F.regexp_replace("sql", r"\s+", " "))
    low = F.regexp_replace(low, r"\b(on|where|left|right|inner|full|cross|join|group|order|having|union)\b", ";$1")  # ends a list of tables
    d = definitions.select("object", low.alias("sql"))
    lists = F.regexp_extract_all("sql", F.lit(r"(?:from|join) ([a-z_][\w. ,]*)"), F.lit(1))
    each = d.select("object", F.explode(lists).alias("list")).select("object", F.explode(F.split("list", ",")).alias("item"))
    alias = each.select("object", F.regexp_extract(F.trim("item"), rf"^(?:\w+\.)?(\w+)", 1).alias("table"), F.regexp_extract(F.trim("item"), r"^[\w.]+ (?:as )?(?!on\b|where\b|join\b|left\b|right\b|inner\b|full\b|cross\b|group\b|order\b)(\w+)", 1).alias("as"))
    alias = alias.select("object", "table", F.when(F.col("as") == "", F.col("table")).otherwise(F.col("as")).alias("as")).distinct()
    equal = d.select("object", F.explode(F.expr(r"regexp_extract_all(sql, '(\\w+\\.\\w+) ?= ?(\\w+\\.\\w+)', 0)")).alias("e"))
    sides = equal.select("object", F.split_part("e", F.lit("."), F.lit(1)).alias("la"), F.regexp_extract("e", r"^\w+\.(\w+)", 1).alias("lc"), F.regexp_extract("e", r"= ?(\w+)\.", 1).alias("ra"), F.regexp_extract("e", r"(\w+)$", 1).alias("rc"))
    x, y = alias.select("object", F.col("as").alias("la"), F.col("table").alias("lt")), alias.select("object", F.col("as").alias("ra"), F.col("table").alias("rt"))
    found = sides.join(x, ["object", "la"]).join(y, ["object", "ra"])
    known = columns.select(F.lower("table").alias("kt"), F.lower("column").alias("kc")).distinct()
    found = found.join(known, (F.col("lt") == F.col("kt")) & (F.col("lc") == F.col("kc")), "left_semi").join(known, (F.col("rt") == F.col("kt")) & (F.col("rc") == F.col("kc")), "left_semi")
    return found.select("object", F.col("lt").alias("from_table"), F.col("lc").alias("from_column"), F.col("rt").alias("to_table"), F.col("rc").alias("to_column")).distinct()
