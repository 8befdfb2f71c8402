"""Dimensional warehouse: generated calendars, lookups, slowly changing dimensions, mappings that run, KPIs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import stored

UNKNOWN_KEY = -1
#: Date and time keys are numbers that read as the date and the time.
_HIJRI_FIRST, _HIJRI_LAST = "1924-08-01", "2077-11-16"


def date_dimension(spark: SparkSession, first_year: int, last_year: int, weekend: tuple[int, ...] = (6, 7), fiscal_start: int = 1) -> DataFrame:
    """One row a day of the years given; weekend holds ISO week days (1 Monday), fiscal_start the fiscal year's first month."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date"), F.expr("interval 1 day"))).alias("full_date"))
    d = F.col("full_date")
    fiscal_month = F.pmod(F.month(d) - fiscal_start, F.lit(12)) + 1
    fiscal_year = F.year(d) + F.when((F.lit(fiscal_start) > 1) & (F.month(d) >= fiscal_start), 1).otherwise(0)
    dow = F.weekday(d) + 1
    return days.select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).alias("date_key"), "full_date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.day(d).alias("day_of_month"), dow.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofyear(d).alias("day_of_year"), F.weekofyear(d).alias("iso_week"), (F.year(d) * 100 + F.month(d)).alias("year_month"),
        dow.isin(*weekend).alias("is_weekend"), (d == F.last_day(d)).alias("is_month_end"), fiscal_year.alias("fiscal_year"), (F.floor((fiscal_month - 1) / 3).cast("int") + 1).alias("fiscal_quarter"), fiscal_month.alias("fiscal_month"),
    )


def time_dimension(spark: SparkSession) -> DataFrame:
    """One row for each minute of the day."""
    hour, minute = F.floor(F.col("id") / 60).cast("int"), F.pmod("id", F.lit(60)).cast("int")
    period = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    label = F.format_string("%02d:%02d", hour, minute)
    return spark.range(1440).select(
        (hour * 100 + minute).alias("time_key"), hour.alias("hour_24"), twelve.alias("hour_12"), minute.alias("minute"), F.when(hour < 12, "AM").otherwise("PM").alias("am_pm"), period.alias("day_period"), label.alias("time_label")
    )


def with_unknown_member(dim: DataFrame, key: str) -> DataFrame:
    """The dimension with a row for facts whose member is not known: the key is -1 and all else null."""
    row = dim.sparkSession.range(1).select(*[F.lit(UNKNOWN_KEY if f.name == key else None).cast(f.dataType).alias(f.name) for f in dim.schema.fields])
    return dim.unionByName(row)


def lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], key: str, into: str, unknown: int = UNKNOWN_KEY) -> DataFrame:
    """fact with the surrogate key of the dimension row that has its natural key, or the unknown key.

    Facts are never multiplied: of several rows of one natural key the smallest surrogate key counts.
    """
    one = dim.groupBy(*[F.col(d).alias(f"__{d}") for d in on.values()]).agg(F.min(key).alias("__key"))
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"__{d}") for f, d in on.items()])
    return fact.join(one, cond, "left").withColumn(into, F.coalesce("__key", F.lit(unknown))).drop("__key", *[f"__{d}" for d in on.values()])


def scd2_versions(changes: DataFrame, natural: str, at: str, attributes: list[str]) -> DataFrame:
    """Versions of each natural key from a log of its states: rows that change nothing are folded into the one before.

    Adds valid_from, valid_to (null while current, else the next version's start), current_flag and row_hash.
    """
    w = Window.partitionBy(natural).orderBy(at)
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(a).cast("string"), F.lit("\u0000")) for a in attributes]), 256)
    fresh = changes.select(natural, at, *attributes, digest.alias("row_hash")).withColumn("__before", F.lag("row_hash").over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col("row_hash")))
    ends = F.lead(at).over(w)
    return fresh.select(natural, *attributes, F.col(at).alias("valid_from"), ends.alias("valid_to"), ends.isNull().alias("current_flag"), "row_hash")


def asof_lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], as_of: str, key: str, into: str, strict: bool = False, unknown: int = UNKNOWN_KEY) -> DataFrame:
    """The key of the dimension version that was valid at the fact's as_of, or the unknown key.

    Default: half open, an open valid_to never ends. strict: BETWEEN with both ends, as the emitted text has it, where an
    open version matches nothing. The join is an equality on the natural key with the range as a residual, so it stays
    partitioned by key; where ranges touch or overlap, the one that begins last counts. Each fact is given once: strict
    versions are cut to spans that do not meet before the join, so no facts are grouped after it.
    """
    side = dim.select(*[F.col(d).alias(f"__{d}") for d in on.values()], F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"), F.col(key).alias("__key"))
    at = F.col(as_of)
    if strict:
        side = _apart(side, [f"__{d}" for d in on.values()])
        inside = ((at > F.col("__from")) | ((at == F.col("__from")) & F.col("__first"))) & ((at < F.col("__to")) | ((at == F.col("__to")) & F.col("__last")))
    else:
        inside = (at >= F.col("__from")) & (F.col("__to").isNull() | (at < F.col("__to")))
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"__{d}") for f, d in on.items()]) & inside
    joined = fact.join(side, cond, "left")
    return joined.select(*[joined[c] for c in fact.columns], F.coalesce("__key", F.lit(unknown)).alias(into))


def _apart(side: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __from, __to, __key, __first, __last): spans of versions (keys, __from, __to, __key), ends included, cut so that
    no two of a key meet; where several hold, the one that begins last does. __first and __last say whether an end is inside.

    A version ends where the next one begins. Only keys where a version outlasts a later one are cut at all their ends.
    """
    order = Window.partitionBy(*keys).orderBy("__from", "__to")
    known = side.where("__from <= __to").withColumn("__next", F.lead("__from").over(order)).withColumn("__outlasted", F.max("__to").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("__to"))
    known = stored(known.withColumn("__nested", F.coalesce(F.max("__outlasted").over(Window.partitionBy(*keys)), F.lit(False))).drop("__outlasted"), "versions")
    cut = F.coalesce(F.col("__next") <= F.col("__to"), F.lit(False))
    plain = known.where("NOT __nested").select(*keys, "__from", F.when(cut, F.col("__next")).otherwise(F.col("__to")).alias("__to"), "__key", F.lit(True).alias("__first"), (~cut).alias("__last"))
    nested = known.where("__nested").select(*keys, "__from", "__to", "__key")
    if nested.isEmpty():
        return plain
    ends = nested.select(*keys, F.explode(F.array("__from", "__to")).alias("__p")).distinct().withColumn("__q", F.lead("__p").over(Window.partitionBy(*keys).orderBy("__p")))
    spans = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.array(F.struct(F.col("__p").alias("p"), F.col("__p").alias("q"), F.lit(True).alias("ends")), F.struct(F.col("__p").alias("p"), F.col("__q").alias("q"), F.lit(False).alias("ends")))).alias("s"))
    holds = reduce(lambda a, b: a & b, [F.col(f"_{k}") == F.col(k) for k in keys]) & (F.col("__from") <= F.col("s.p")) & (F.col("s.q") <= F.col("__to"))
    held = spans.join(nested, holds).groupBy(*keys, "s").agg(F.max_by("__key", "__from").alias("__key"))
    return plain.unionByName(held.select(*keys, F.col("s.p").alias("__from"), F.col("s.q").alias("__to"), "__key", F.col("s.ends").alias("__first"), F.col("s.ends").alias("__last")))


@dataclass(frozen=True)
class Branch:
    """One SELECT of a mapping: a driving input, joins (table, condition, how), filters, and an expression for each column."""

    driving: str
    columns: dict[str, str | None]
    joins: list[tuple[str, str, str]] = field(default_factory=list)
    where: str | None = None
    group_by: list[str] = field(default_factory=list)
    having: str | None = None


@dataclass(frozen=True)
class Mapping:
    """A target table: columns with their Spark types, and the branches whose union fills it."""

    columns: dict[str, str]
    branches: list[Branch]


def run_mapping(mapping: Mapping, inputs: dict[str, DataFrame]) -> DataFrame:
    """The rows of a mapping. A column without an expression in a branch is a typed null; branches are united by name."""

    def one(branch: Branch) -> DataFrame:
        df = inputs[branch.driving].alias(branch.driving)
        for name, on, how in branch.joins:
            df = df.join(inputs[name].alias(name), F.expr(on), how)
        if branch.where:
            df = df.where(branch.where)
        cast = lambda c: (F.expr(branch.columns[c]) if branch.columns.get(c) else F.lit(None)).cast(mapping.columns[c]).alias(c)
        if not branch.group_by:
            return df.select(*[cast(c) for c in mapping.columns])
        plain = {c for c, e in branch.columns.items() if e in branch.group_by}
        grouped = df.groupBy(*[F.expr(g) for g in branch.group_by])
        out = grouped.agg(*[cast(c) for c in mapping.columns if c not in plain], *([F.expr(branch.having).alias("__having")] if branch.having else []))
        keys = {c: out.columns[branch.group_by.index(branch.columns[c])] for c in plain}
        if branch.having:
            out = out.where("__having")
        return out.select(*[F.col(f"`{keys[c]}`").cast(mapping.columns[c]).alias(c) if c in plain else F.col(c) for c in mapping.columns])

    return reduce(lambda a, b: a.unionByName(b), [one(b) for b in mapping.branches])


def mapping_problems(mapping: Mapping, inputs: dict[str, DataFrame]) -> list[tuple[int, str, str]]:
    """(branch number, problem, detail) of what keeps a mapping from running: unknown inputs, unmapped columns, names that
    Spark cannot resolve, plain columns of an aggregate that are not grouped."""
    found = []
    for k, b in enumerate(mapping.branches):
        missing = [n for n in [b.driving, *[j[0] for j in b.joins]] if n not in inputs]
        found += [(k, "broken_reference", n) for n in missing]
        found += [(k, "unmapped_column", c) for c in mapping.columns if not b.columns.get(c)]
        if missing:
            continue
        try:
            run_mapping(Mapping(mapping.columns, [b]), inputs).schema  # noqa: B018  analysis, no job
        except Exception as e:  # Spark says by name what it could not resolve
            text = str(e)
            kind = "not_in_group_by" if "AGGREGAT" in text else "broken_reference" if "UNRESOLVED" in text else "unparsed"
            found.append((k, kind, text.split("\n")[0][:200]))
    return found


def coverage(columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """Mapped share of each table in whole percent, rounded down: columns (table, column), mapped (table, branch, column)."""
    branches = mapped.groupBy("table").agg(F.count_distinct("branch").alias("branches"))
    per = mapped.groupBy("table", "column").agg(F.count_distinct("branch").alias("n")).select(F.col("table").alias("mt"), F.col("column").alias("mc"), "n")
    c = columns.join(branches, "table", "left").join(per, (F.col("table") == F.col("mt")) & (F.col("column") == F.col("mc")), "left")
    done = F.sum((F.coalesce("n", F.lit(0)) >= F.coalesce("branches", F.lit(1))).cast("int"))
    return c.groupBy("table").agg(F.count(F.lit(1)).alias("columns"), done.alias("covered")).withColumn("percent", F.floor(F.col("covered") * 100 / F.col("columns")))


def month_growth(facts: DataFrame, year: str, month: str, measure: Column) -> DataFrame:
    """(year, month, total, mom, yoy): growth against the previous month that has rows, and against the same month of the
    previous year that has it. Null where there is nothing before, or it is zero."""
    totals = facts.groupBy(year, month).agg(measure.alias("total"))
    by_month, by_year = Window.orderBy(year, month), Window.partitionBy(month).orderBy(year)  # one row a month
    change = lambda w: F.col("total") / F.nullif(F.lag("total").over(w), F.lit(0.0)) - 1
    return totals.select(year, month, "total", change(by_month).alias("mom"), change(by_year).alias("yoy"))


def ratio(a: Column, b: Column) -> Column:
    """SUM(a) over SUM(b), null where that is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0).cast("double")))


# The months of the Hijri year.
HIJRI_MONTHS = ("Muharram", "Safar", "Rabi al-Awwal", "Rabi al-Thani", "Jumada al-Ula", "Jumada al-Akhirah", "Rajab", "Shaaban", "Ramadan", "Shawwal", "Dhu al-Qadah", "Dhu al-Hijjah")


def hijri(df: DataFrame, day: str, months: DataFrame | None = None) -> DataFrame:
    """df with hijri_year, hijri_month, hijri_day, hijri_year_month and hijri_month_name of a date column.

    months (first_day, hijri_year, hijri_month) are the first days of an observed calendar's months, such as the Umm al-Qura
    one; a day belongs to the last month that begins no later, if the next one is given too. Without them the arithmetic
    (civil) calendar is used, with 11 leap years in 30 and null outside 1924-2077: it may differ by a day or two.
    """
    if months is None:
        inside = F.col(day).between(F.lit(_HIJRI_FIRST).cast("date"), F.lit(_HIJRI_LAST).cast("date"))
        n = F.date_diff(F.col(day), F.lit("0622-07-19").cast("date"))
        year = F.floor((30 * n + 10646) / 10631)
        first = lambda y: 354 * (y - 1) + F.floor((3 + 11 * y) / 30)
        rest = n - first(year)
        month = F.least(F.lit(12), F.ceil((rest + 0.5) / 29.5))
        month_day = rest - F.ceil(29.5 * (month - 1)) + 1
        keep = lambda c: F.when(inside, c.cast("int"))
        out = df.withColumns({"hijri_year": keep(year), "hijri_month": keep(month), "hijri_day": keep(month_day)})
    else:
        until = F.lead("first_day").over(Window.orderBy("first_day"))  # a row for each month of the calendar: some thousands
        spans = months.select(F.col("first_day").alias("__from"), until.alias("__until"), "hijri_year", "hijri_month")
        days = spans.where("__until IS NOT NULL").select(F.explode(F.sequence("__from", F.date_sub("__until", 1))).alias("__day"), F.col("hijri_year").cast("int").alias("hijri_year"), F.col("hijri_month").cast("int").alias("hijri_month"), "__from")
        out = df.join(days, F.col(day) == F.col("__day"), "left").withColumn("hijri_day", F.date_diff(F.col(day), F.col("__from")) + 1).drop("__day", "__from")
    name = F.element_at(F.array(*[F.lit(m) for m in HIJRI_MONTHS]), F.col("hijri_month"))
    return out.withColumns({"hijri_year_month": F.col("hijri_year") * 100 + F.col("hijri_month"), "hijri_month_name": F.when(F.col("hijri_month").isNotNull(), name)})
