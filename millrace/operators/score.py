"""Quality checks of a warehouse model, and the scores they add up to.

A check is a function of the model's tables (DataFrames of metadata) that returns findings (object_id, table_id, layer,
passed, message). What a check does not apply to gives no row; that is neither a pass nor a failure.

The model: tables (table_id, layer, name, kind, grain, is_aggregate, is_time_based, scd_type, is_conformed, description,
generated), columns (column_id, table_id, name, role, kind, additivity, references, description, is_system, source_removed,
pii), mapped (column_id, branch, mapping_type, grouped, parses), inputs (column_id, input_layer, input_id, input_exists,
input_removed), flags (table_id, column_id, overridden), kpis (kpi_id, name, description), kpi_links (kpi_id, column_id).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stored

# Weights of the severities, floors of the grades, the best grade with an error open, the width limit.
WEIGHTS = {"error": 10, "warning": 3, "info": 1}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
WIDE = 60

Model = dict[str, DataFrame]
CHECKS: dict[str, tuple[str, Callable[[Model], DataFrame]]] = {}


def check(severity: str):
    def keep(f):
        CHECKS[f.__name__] = (severity, f)
        return f

    return keep


def _out(df: DataFrame, passed: Column, object_id: str = "table_id", message: str = "") -> DataFrame:
    return df.select(F.col(object_id).cast("string").alias("object_id"), F.col("table_id").cast("string").alias("table_id"), "layer", F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(message).alias("message"))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _tables(m: Model, kinds: tuple[str, ...] = (), layers: tuple[str, ...] = ("core", "mart")) -> DataFrame:
    t = m["tables"].where(F.col("layer").isin(*layers))
    return t.where(F.col("kind").isin(*kinds)) if kinds else t


def _columns(m: Model, kinds: tuple[str, ...] = (), layers: tuple[str, ...] = ("core", "mart")) -> DataFrame:
    t = _tables(m, kinds, layers).select("table_id", "layer", F.col("name").alias("table_name"), F.col("kind").alias("table_kind"), "generated", "is_aggregate")
    return m["columns"].join(t, "table_id")


def _targets(m: Model) -> DataFrame:
    """(column_id, target_kind, target_id) of foreign keys."""
    t = m["tables"].select(F.col("table_id").alias("target_id"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"))
    return m["columns"].where("role = 'fk'").select("column_id", F.col("table_id").alias("owner"), "references").join(t, F.col("references") == F.col("target_id"))


@check("error")
def fact_has_grain(m):
    return _out(_tables(m, ("fact",)), ~_blank("grain"))


@check("warning")
def column_covered(m):
    branches = m["mapped"].join(m["columns"].select("column_id", "table_id"), "column_id").groupBy("table_id").agg(F.count_distinct("branch").alias("branches"))
    done = m["mapped"].where("mapping_type <> 'unmapped'").groupBy("column_id").agg(F.count_distinct("branch").alias("n"))
    c = _columns(m).where("NOT generated").join(branches, "table_id", "left").join(done, "column_id", "left")
    return _out(c, F.col("is_system") | (F.coalesce("n", F.lit(0)) >= F.greatest(F.lit(1), F.coalesce("branches", F.lit(1)))), "column_id")


@check("error")
def aggregate_group_by(m):
    c = _columns(m, ("fact",)).where("is_aggregate AND role <> 'measure'").join(m["mapped"].select("column_id", "grouped"), "column_id")
    return _out(c, F.col("grouped"), "column_id")


@check("error")
def dimension_has_keys(m):
    roles = m["columns"].groupBy("table_id").agg(F.max(F.col("role") == "sk").alias("sk"), F.max(F.col("role") == "nk").alias("nk"))
    return _out(_tables(m, ("dimension",)).join(roles, "table_id", "left"), F.col("sk") & F.col("nk"))


@check("error")
def fact_has_dimension_fk(m):
    hit = _targets(m).where("target_kind IN ('dimension', 'date', 'time', 'bridge')").select(F.col("owner").alias("o")).distinct()
    return _out(_tables(m, ("fact",)).join(hit, F.col("table_id") == F.col("o"), "left"), F.col("o").isNotNull())


@check("error")
def no_fact_to_fact_fk(m):
    return _out(_columns(m, ("fact",)).join(_targets(m).select("column_id", "target_kind"), "column_id"), F.col("target_kind") != "fact", "column_id")


@check("warning")
def time_fact_has_date_dimension(m):
    hit = _targets(m).where("target_kind = 'date'").select(F.col("owner").alias("o")).distinct()
    return _out(_tables(m, ("fact",)).where("is_time_based").join(hit, F.col("table_id") == F.col("o"), "left"), F.col("o").isNotNull())


@check("warning")
def measure_has_additivity(m):
    return _out(_columns(m).where("role = 'measure'"), F.col("additivity").isNotNull(), "column_id")


@check("warning")
def dimension_has_scd_type(m):
    return _out(_tables(m, ("dimension",)), F.col("scd_type").isNotNull())


@check("info")
def no_deep_snowflake(m):
    out = _targets(m).where("target_kind = 'dimension'").select("owner", "target_id").where("owner <> target_id").distinct()
    deep = out.join(out.select(F.col("owner").alias("o2"), F.col("target_id").alias("t2")), F.col("target_id") == F.col("o2")).select(F.col("owner").alias("d")).distinct()
    return _out(_tables(m, ("dimension",)).join(deep, F.col("table_id") == F.col("d"), "left"), F.col("d").isNull())


@check("warning")
def fact_fk_is_lookup(m):
    fk = _columns(m, ("fact",), ("core",)).join(_targets(m).where("target_kind = 'dimension'").select("column_id"), "column_id", "left_semi")
    looked = m["mapped"].where("mapping_type = 'lookup'").select(F.col("column_id").alias("l")).distinct()
    return _out(fk.join(looked, F.col("column_id") == F.col("l"), "left"), F.col("l").isNotNull(), "column_id")


@check("warning")
def bridge_has_keys(m):
    roles = m["columns"].groupBy("table_id").agg(F.max(F.col("role") == "sk").alias("sk"), F.count_if(F.col("role") == "fk").alias("fks"))
    return _out(_tables(m, ("bridge",)).join(roles, "table_id", "left"), F.col("sk") & (F.col("fks") >= 2))


@check("warning")
def naming_conventions(m):
    t = _tables(m, (), ("staging", "core", "mart"))
    prefix = F.when(F.col("layer") == "staging", "stg_").when(F.col("kind") == "fact", "fact_").when(F.col("kind") == "bridge", "bridge_").otherwise("dim_")
    return _out(t, F.col("name").startswith(prefix) & F.col("name").rlike("^[a-z][a-z0-9_]*$") & (F.octet_length("name") <= 63))


@check("warning")
def same_name_same_type(m):
    c = _columns(m).where("NOT is_system")
    kinds = c.groupBy(F.lower("name").alias("low")).agg(F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    return _out(c.join(kinds, F.lower("name") == F.col("low")), F.col("kinds") == 1, "column_id")


@check("error")
def inputs_from_layer_below(m):
    below = F.when(F.col("layer") == "core", "staging").otherwise("core")
    return _out(_columns(m).join(m["inputs"].where("input_exists"), "column_id"), F.col("input_layer") == below, "column_id")


@check("info")
def conformed_dimension_shared(m):
    facts = m["tables"].where("kind = 'fact'").select(F.col("table_id").alias("owner"))
    use = _targets(m).join(facts, "owner").groupBy(F.col("target_id").alias("d")).agg(F.count_distinct("owner").alias("n"))
    return _out(_tables(m, ("dimension",)).where("is_conformed").join(use, F.col("table_id") == F.col("d"), "left"), F.col("n") >= 2)


@check("error")
def mapping_parses(m):
    return _out(_columns(m, (), ("staging", "core", "mart")).join(m["mapped"].select("column_id", "parses"), "column_id"), F.col("parses"), "column_id")


@check("error")
def inputs_exist(m):
    return _out(_columns(m).join(m["inputs"], "column_id"), F.col("input_exists"), "column_id")


@check("error")
def no_source_removed_inputs(m):
    return _out(_columns(m, (), ("staging", "core", "mart")).join(m["inputs"].where("input_exists"), "column_id"), ~F.col("input_removed"), "column_id")


@check("warning")
def review_flags_resolved(m):
    t = _tables(m, (), ("staging",)).select("table_id", "layer")
    return _out(m["flags"].join(t, "table_id"), F.col("overridden"), "column_id")


@check("info")
def table_has_description(m):
    return _out(_tables(m), ~_blank("description"))


@check("info")
def measure_has_description(m):
    return _out(_columns(m).where("role = 'measure'"), ~_blank("description"), "column_id")


def _kpis(m: Model) -> DataFrame:
    return m["kpis"].withColumns({"table_id": F.lit(None).cast("string"), "layer": F.lit("dw")})


@check("info")
def kpi_has_description(m):
    return _out(_kpis(m), ~_blank("description"), "kpi_id")


@check("warning")
def kpi_links_measure(m):
    measures = _columns(m).where("role = 'measure'").select("column_id")
    linked = m["kpi_links"].join(measures, "column_id", "left_semi").select(F.col("kpi_id").alias("k")).distinct()
    return _out(_kpis(m).join(linked, F.col("kpi_id") == F.col("k"), "left"), F.col("k").isNotNull(), "kpi_id")


@check("warning")
def surrogate_key_integer(m):
    return _out(_columns(m).where("role = 'sk'"), F.col("kind").isin("smallint", "integer", "bigint"), "column_id")


@check("warning")
def fact_no_free_text(m):
    return _out(_columns(m, ("fact",)).where("role IN ('attribute', 'measure')"), ~F.col("kind").isin("char", "string", "text"), "column_id")


@check("info")
def fact_width(m):
    n = m["columns"].groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    return _out(_tables(m, ("fact",)).join(n, "table_id", "left"), F.coalesce("n", F.lit(0)) <= WIDE)


@check("info")
def pii_in_mart(m):
    return _out(_columns(m, (), ("mart",)), ~F.coalesce("pii", F.lit(False)), "column_id")


def run_checks(model: Model, disabled: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all enabled checks, or of `only` some: check_code, severity, object_id, table_id, layer, passed, message.

    The model's tables are written once: every check reads them, and Spark then knows which are small enough to broadcast.
    """
    wanted = [code for code in CHECKS if code not in disabled and (not only or code in only)]
    # a single check reads its tables once or twice, which a copy of the whole model would not pay for
    model, parts = model if len(wanted) == 1 else {name: stored(df, f"model-{name}") for name, df in model.items()}, []
    for code, (severity, f) in CHECKS.items():
        if code in wanted:
            severe = F.when(F.col("layer") == "staging", "warning").otherwise(severity) if code == "no_source_removed_inputs" else F.lit(severity)
            parts.append(f(model).select(F.lit(code).alias("check_code"), severe.alias("severity"), "object_id", "table_id", "layer", "passed", "message"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def weight() -> Column:
    out = F.lit(0)
    for severity, w in WEIGHTS.items():
        out = F.when(F.col("severity") == severity, w).otherwise(out)
    return out


def percentage() -> Column:
    """Weighted share of passed findings in percent, null where there are none."""
    return F.round(F.try_divide(100.0 * F.sum(F.when(F.col("passed"), weight()).otherwise(0)), F.sum(weight()).cast("double")), 2)


def grade(score: Column, has_errors: Column) -> Column:
    plain = F.lit("F")
    for floor, g in reversed(GRADES):
        plain = F.when(score >= floor, g).otherwise(plain)
    return F.when(score.isNull(), None).when(has_errors & plain.isin("A", "B"), "C").otherwise(plain)


def has_errors() -> Column:
    return F.coalesce(F.max((F.col("severity") == "error") & ~F.col("passed")), F.lit(False))


def table_scores(findings: DataFrame) -> DataFrame:
    return findings.where("table_id IS NOT NULL").groupBy("table_id").agg(percentage().alias("score"))


def layer_scores(findings: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(layer, score, grade): table scores weighted by their columns; tables without findings are left out."""
    # the checks run once: what they add up to for a table is written, and both the scores and the errors are read from it
    good, all_ = F.sum(F.when(F.col("passed"), weight()).otherwise(0)), F.sum(weight())
    sums = stored(findings.groupBy(F.col("table_id").alias("st"), F.col("layer").alias("bl")).agg(good.alias("good"), all_.alias("all"), has_errors().alias("bad")), "model-sums")
    per = sums.where("st IS NOT NULL").groupBy("st").agg(F.round(F.try_divide(100.0 * F.sum("good"), F.sum("all").cast("double")), 2).alias("score"))
    n = columns.groupBy(F.col("table_id").cast("string").alias("nt")).agg(F.count(F.lit(1)).alias("n"))
    t = tables.select(F.col("table_id").cast("string").alias("tt"), "layer").join(per, F.col("tt") == F.col("st")).join(n, F.col("tt") == F.col("nt"), "left")
    w = F.greatest(F.lit(1), F.coalesce("n", F.lit(1)))
    scores = t.groupBy("layer").agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 2).alias("score"))
    bad = sums.groupBy("bl").agg(F.max("bad").alias("bad"))
    return scores.join(bad, F.col("layer") == F.col("bl")).select("layer", "score", grade(F.col("score"), F.col("bad")).alias("grade"))


def warehouse_score(findings: DataFrame) -> DataFrame:
    """One row (score, grade, capped) over core, mart and the warehouse-wide findings."""
    s = findings.where(F.col("layer").isin("core", "mart", "dw")).agg(percentage().alias("score"), has_errors().alias("bad"))
    return s.select("score", grade(F.col("score"), F.col("bad")).alias("grade"), (grade(F.col("score"), F.col("bad")) != grade(F.col("score"), F.lit(False))).alias("capped"))
