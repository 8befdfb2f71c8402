"""Column profiling: counts, ranges, lengths, frequent values, value patterns, findings and growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import stored

TOP_N, PATTERN_SAMPLE, PATTERN_SHARE = 10, 200, 0.8
MOSTLY_NULL, DROP, DAYS_PER_MONTH = 50.0, 0.2, 30.44

# The patterns a column's values are tested for, as full matches; phone is tried where iso_date is not found.
PATTERNS = {
    "email": r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}",
    "url": r"(?i)https?://\S+",
    "uuid": r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "ipv4": r"([0-9]{1,3})(\.[0-9]{1,3}){3}",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?.*)?",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
PHONE = r"\+?[0-9\s().-]{7,20}"


def kind_of(data_type: T.DataType) -> str:
    """text, ordered, key or other: decides which statistics a column can have."""
    if isinstance(data_type, T.StringType | T.CharType | T.VarcharType):
        return "text"
    if isinstance(data_type, T.BinaryType | T.ArrayType | T.MapType | T.StructType | T.VariantType):
        return "other"
    return "ordered"


def column_profile(df: DataFrame, row_cap: int | None = None, approximate: bool = False) -> DataFrame:
    """One row for each column: row_count, null_count, null_pct, distinct_count, min, max, avg_length, max_length.

    Distinct counts are exact: each column is grouped by its values, with partial counts before the shuffle, and all its
    figures come from those groups; a scan reads that column alone. With `approximate` they are estimates (HyperLogLog), and
    all columns are profiled in one aggregation over one scan: for wide tables of mostly unique columns. row_cap profiles
    the first rows only (in no set order), as an explicit sampling of the caller's.
    """
    if row_cap is not None:
        df = stored(df.limit(row_cap), "profiled")
    if approximate:
        return _one_pass(df)
    parts = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), kind_of(field.dataType)
        if kind == "other":
            figures = df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("n"))
        else:
            groups = df.select(c.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
            figures = groups.agg(
                F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("n"), F.count("v").alias("d"), F.min("v").cast("string").alias("lo"), F.max("v").cast("string").alias("hi"),
                *([F.sum(F.char_length("v") * F.col("k")).alias("chars"), F.max(F.char_length("v")).alias("ml")] if kind == "text" else []),
            )
        pick = lambda name, t: (F.col(name) if name in figures.columns else F.lit(None)).cast(t)  # noqa: B023, E731
        nulls = F.col("rows") - F.col("n")
        parts.append(figures.select(
            F.lit(field.name).alias("column_name"), F.col("rows").alias("row_count"), nulls.alias("null_count"), F.when(F.col("rows") > 0, F.lit(100.0) * nulls / F.col("rows")).otherwise(F.lit(0.0)).alias("null_pct"),
            pick("d", "long").alias("distinct_count"), pick("lo", "string").alias("min_value"), pick("hi", "string").alias("max_value"), (F.try_divide(pick("chars", "double"), F.col("n"))).alias("avg_length"), pick("ml", "int").alias("max_length"),
        ))
    return reduce(lambda a, b: a.unionAll(b), parts)


def _one_pass(df: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, field in enumerate(df.schema.fields):
        c, kind = F.col(f"`{field.name}`"), kind_of(field.dataType)
        aggregates.append(F.count(c).alias(f"n{i}"))
        if kind != "other":
            aggregates += [F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        if kind == "text":
            aggregates += [F.avg(F.char_length(c)).alias(f"al{i}"), F.max(F.char_length(c)).alias(f"ml{i}")]
    wide = df.agg(*aggregates)
    have = set(wide.columns)
    pick = lambda name, t: (F.col(name) if name in have else F.lit(None)).cast(t)
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.col("__rows").alias("row_count"), (F.col("__rows") - F.col(f"n{i}")).alias("null_count"),
            F.when(F.col("__rows") > 0, F.lit(100.0) * (F.col("__rows") - F.col(f"n{i}")) / F.col("__rows")).otherwise(F.lit(0.0)).alias("null_pct"),
            pick(f"d{i}", "long").alias("distinct_count"), pick(f"lo{i}", "string").alias("min_value"), pick(f"hi{i}", "string").alias("max_value"),
            pick(f"al{i}", "double").alias("avg_length"), pick(f"ml{i}", "int").alias("max_length"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return wide.select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, column: str, n: int = TOP_N) -> DataFrame:
    """(value, n): the most frequent non-null values, ties by value."""
    c = F.col(column)
    return df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(n)


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$") if not pattern.startswith("(?i)") else c.rlike(f"(?i)^(?:{pattern[4:]})$")


def pattern_shares(df: DataFrame, column: str, sample: int = PATTERN_SAMPLE) -> DataFrame:
    """(pattern, share, reported) over the first `sample` distinct trimmed values in order."""
    v = F.trim(F.col(column).cast("string"))
    values = df.select(v.alias("v")).where("v <> ''").distinct().orderBy("v").limit(sample)
    digits = F.length(F.regexp_replace("v", "[^0-9]", ""))
    tests = {k: full_match(F.col("v"), p) for k, p in PATTERNS.items()} | {"phone": full_match(F.col("v"), PHONE) & digits.between(7, 15)}
    shares = values.agg(*[F.avg(t.cast("int")).alias(k) for k, t in tests.items()])
    rows = shares.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pattern"), F.coalesce(k, F.lit(0.0)).alias("share"), F.col("iso_date").alias("iso")) for k in tests])))
    said = (F.col("share") >= PATTERN_SHARE) & ((F.col("pattern") != "phone") | ~(F.coalesce("iso", F.lit(0.0)) >= PATTERN_SHARE))
    return rows.select("pattern", "share", said.alias("reported"))


def findings(profiles: DataFrame, row_cap: int) -> DataFrame:
    """First finding that holds for each profile (with is_protected and is_key); columns without one are left out.

    Protected columns get findings about nulls only, and never a value.
    """
    null_pct, rows, distinct = F.col("null_pct"), F.col("row_count"), F.col("distinct_count")
    kind = (
        F.when((rows > 0) & (null_pct >= 100), "all_null")
        .when(null_pct > MOSTLY_NULL, "mostly_null")
        .when(F.col("is_protected"), None)
        .when((distinct == 1) & (rows > 0), "constant")
        .when((distinct == rows) & (rows > 0) & ~F.col("is_key"), "unique_not_key")
    )
    found = profiles.withColumn("finding", kind).where(F.col("finding").isNotNull())
    return found.withColumn("capped", rows >= row_cap).withColumn("value", F.when(F.col("finding") == "constant", F.col("min_value")))


def growth(points: DataFrame, key: str, at: str = "taken_at", size: str = "row_estimate") -> DataFrame:
    """Growth of each series of (key, at, size): first, latest, change_pct, per_month, in_12_months, dropped_at.

    The monthly rate counts from the last drop of more than a fifth. Series of one point or without a change are left out.
    """
    w = Window.partitionBy(key).orderBy(at)
    marked = points.select(key, at, size, (F.col(size) < F.lag(size).over(w) * (1 - DROP)).alias("drop"))
    facts = marked.groupBy(key).agg(
        F.min_by(size, at).alias("first"), F.max_by(size, at).alias("latest"), F.min(at).alias("began"), F.max(at).alias("ended"),
        F.max(F.when(F.col("drop"), F.struct(at, size))).alias("low"), F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"),
    )
    facts = facts.where((F.col("n") > 1) & (F.col("least") < F.col("most")))
    base, since = F.coalesce(F.col(f"low.{size}"), F.col("first")), F.coalesce(F.col(f"low.{at}"), F.col("began"))
    days = (F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(since.cast("timestamp"))) / F.lit(86_400.0)
    per_month = F.when(days != 0, (F.col("latest") - base) / days * DAYS_PER_MONTH).otherwise(F.lit(0.0))
    facts = facts.withColumn("per_month", per_month).withColumn("dropped_at", F.col(f"low.{at}"))
    change = F.when(F.col("first") != 0, (F.col("latest") - F.col("first")) / F.col("first") * 100)
    return facts.select(key, "first", "latest", change.alias("change_pct"), "per_month", F.greatest(F.lit(0.0), F.col("latest") + F.col("per_month") * 12).alias("in_12_months"), "dropped_at")


def left_out(tables: DataFrame, points: DataFrame) -> DataFrame:
    """(table_id, reason) of the tables (table_id, kind) whose growth is not told: it is a view, has no estimate, is new (one
    estimate), or unchanged. points: (table_id, row_estimate), one for each snapshot."""
    p = points.where("row_estimate IS NOT NULL").groupBy(F.col("table_id").alias("pt")).agg(F.count(F.lit(1)).alias("n"), F.min("row_estimate").alias("lo"), F.max("row_estimate").alias("hi"))
    reason = F.when(F.col("kind") == "view", "view").when(F.col("n").isNull(), "no_estimate").when(F.col("n") == 1, "new").when(F.col("lo") == F.col("hi"), "unchanged")
    return tables.join(p, F.col("table_id") == F.col("pt"), "left").select("table_id", reason.alias("reason")).where("reason IS NOT NULL")


def source_summaries(tables: DataFrame, findings: DataFrame) -> DataFrame:
    """(source, tables, documented_pct, profiled_pct, accepted, to_review, status) of each source.

    tables: (source, description, profiled), a row for each table; findings: (source, status). A source is complete when all
    its tables are documented and profiled and nothing waits for review, not_started when nothing has been done.
    """
    documented, profiled = F.count_if(F.coalesce(F.trim("description") != "", F.lit(False))), F.count_if("profiled")
    per = tables.groupBy("source").agg(F.count(F.lit(1)).alias("tables"), documented.alias("d"), profiled.alias("p"))
    found = findings.groupBy(F.col("source").alias("fs")).agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "suggested").alias("to_review"))
    both = per.join(found, F.col("source") == F.col("fs"), "left").fillna(0, ["accepted", "to_review"])
    nothing = (F.col("d") == 0) & (F.col("p") == 0) & (F.col("accepted") + F.col("to_review") == 0)
    everything = (F.col("d") == F.col("tables")) & (F.col("p") == F.col("tables")) & (F.col("to_review") == 0)
    share = lambda c: F.round(100.0 * F.col(c) / F.col("tables")).cast("long")
    status = F.when(nothing, "not_started").when(everything, "complete").otherwise("in_progress")
    return both.select("source", "tables", share("d").alias("documented_pct"), share("p").alias("profiled_pct"), "accepted", "to_review", status.alias("status"))
