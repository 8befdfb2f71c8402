"""Staging tables from source metadata: names that are safe on a platform, translated types, direct mappings and their edges.

Source columns are rows (system, schema, table, column, ordinal, data_type, nullable, table_id, column_id, table_no,
column_no); everything is expressions, one aggregation for collisions of names, and joins on table ids, so a catalog of any
size is a few shuffles.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.validators import bound


@dataclass(frozen=True)
class Platform:
    """What a target platform allows: bytes of a name, characters of a varchar, a decimal without precision, largest scale."""

    name_bytes: int
    varchar: int
    decimal: tuple[int, int]
    scale: int


# Limits of the supported platforms.
PLATFORMS = {
    "postgresql": Platform(63, 1_000_000, (38, 10), 38),
    "sqlserver": Platform(128, 8000, (38, 10), 38),
    "oracle": Platform(128, 4000, (38, 10), 38),
    "snowflake": Platform(255, 1_000_000, (38, 10), 37),
    "bigquery": Platform(300, 1_000_000, (38, 9), 9),
}

# Source type names by the neutral kind they become.
KINDS = {
    "smallint": "smallint int2 smallserial tinyint",
    "integer": "int integer int4 mediumint serial serial4 year",
    "bigint": "bigint int8 bigserial serial8",
    "decimal": "numeric decimal number dec money smallmoney",
    "double": "float double|precision double float8 binary_double float64",
    "float": "real float4 binary_float",
    "boolean": "boolean bool bit",
    "date": "date",
    "time": "time time|without|time|zone timetz time|with|time|zone",
    "timestamp": "timestamp timestamp|without|time|zone datetime datetime2 smalldatetime timestamp|with|local|time|zone",
    "timestamptz": "timestamptz timestamp|with|time|zone datetimeoffset",
    "uuid": "uuid uniqueidentifier",
    "json": "json jsonb",
    "char": "char character bpchar nchar national|character",
    "string": "varchar character|varying nvarchar varchar2 nvarchar2 varying|character national|character|varying nchar|varying name",
    "text": "text tinytext mediumtext longtext ntext clob nclob long citext xml xmltype sql_variant geometry geography point line polygon sdo_geometry",
    "binary": "bytea blob tinyblob mediumblob longblob image long|raw raw binary varbinary bfile",
}
# Types kept as text of a known length, and types whose translation is flagged.
AS_STRING = {"interval": 64, "hierarchyid": 4000, "inet": 45, "cidr": 49, "macaddr": 17, "oid": 20, "urowid": 4000, "rowid": 18, "enum": 255, "set": 255}
FALLBACK = "xml xmltype sql_variant geometry geography point line polygon sdo_geometry".split()
LOSSY = ("timetz", "time with time zone")
WIDEST = 38

# Words that the SQL standard reserves.
RESERVED = tuple(
    """all and any as asc between by case cast check column constraint create cross current_date current_time current_timestamp current_user default delete desc distinct drop else end except exists false for foreign from
    full group having in inner insert intersect into is join key left like limit not null on or order outer primary references right select set some table then to true union unique update user using values when where with""".split()
)


def translated(data_type: Column, platform: str, engine: Column | None = None) -> Column:
    """The staging type of a source type name: struct (kind, length, precision, scale, flags).

    flags holds lossy_type where values may lose something, fallback_type where the type is kept in a wider one. engine
    (oracle, sqlserver, ...) settles names that mean different things.
    """
    p = PLATFORMS[platform]
    engine = F.lit(None).cast("string") if engine is None else engine
    low = F.lower(F.trim(F.coalesce(data_type, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kind, names in KINDS.items() for name in names.split() for x in (name.replace("|", " "), kind)])

    def parts(t):
        """The name without its parameters, what is in them, and the first two numbers."""
        inside = F.regexp_extract(t, r"\(([^)]*)\)", 1)
        base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"\b(unsigned|zerofill|signed)\b", ""), r"\s+", " "))
        number = lambda i: F.nullif(F.regexp_extract(F.get(F.split(inside, ","), F.lit(i)), r"^\s*(-?[0-9]{1,9})(?:\s|$)", 1), F.lit("")).cast("int")
        return F.struct(t.alias("low"), inside.alias("inside"), base.alias("base"), number(0).alias("n"), number(1).alias("m"), engine.alias("engine"))

    def first_kind(x):
        """The kind by name, whether the name is known, and the length of types kept as text."""
        row_version = (x["engine"] == "sqlserver") & x["base"].isin("timestamp", "rowversion")
        kind = F.when(row_version, "binary").when((x["engine"] == "oracle") & (x["base"] == "date"), "timestamp").when((x["base"] == "float") & (x["n"] <= 24), "float").otherwise(F.try_element_at(known, x["base"]))
        length = F.coalesce(*[F.when((x["base"] == name) | x["base"].startswith(name + " "), length) for name, length in AS_STRING.items()])
        array = x["low"].endswith("[]") | x["low"].startswith("_") | x["low"].startswith("array")
        return F.struct(x.alias("x"), kind.alias("kind"), length.alias("length"), array.alias("array"), F.coalesce(row_version, F.lit(False)).alias("row_version"))

    def settled(y):
        x, named = y["x"], y["kind"].isNotNull()
        wide = F.coalesce((y["kind"] == "string") & (x["n"] > p.varchar), F.lit(False))
        text = y["kind"].isin("char", "string") & (F.trim(x["inside"]) == "max")
        kind = F.when(x["low"] == "", "text").when(y["array"], "json").when(text | wide, "text").when(named, y["kind"]).when(y["length"].isNotNull(), "string").otherwise("text")
        return F.struct(y.alias("y"), kind.alias("kind"), wide.alias("wide"), (named & ~y["array"] & (x["low"] != "")).alias("named"))

    def result(z):
        y, x, kind = z["y"], z["y"]["x"], z["kind"]
        asked = F.greatest(F.coalesce(x["m"], F.lit(0)), F.lit(0))
        money = F.when(x["base"] == "money", 19).when(x["base"] == "smallmoney", 10)
        digits = F.coalesce(money, F.least(x["n"], F.lit(WIDEST)), F.lit(p.decimal[0]))
        scale = F.when(money.isNotNull(), min(4, p.scale)).when(x["n"].isNull(), p.decimal[1]).otherwise(F.least(asked, F.lit(p.scale), digits))
        cut = money.isNull() & (x["n"].isNull() | (x["n"] > WIDEST) | (x["m"] < 0) | (asked > p.scale) | (asked > digits))
        length = (
            F.when(kind == "char", F.coalesce(x["n"], F.lit(1))).when((kind == "string") & z["named"], x["n"]).when(kind == "string", y["length"]).when(y["row_version"], 8).when((kind == "binary") & x["n"].between(1, 1_000_000), x["n"])
        )
        unnamed = ~z["named"] & ~y["array"] & (x["low"] != "")
        lossy = (z["named"] & (x["base"].isin(*LOSSY) | ((kind == "decimal") & F.coalesce(cut, F.lit(False))))) | (unnamed & y["length"].isNotNull())
        fallback = (x["low"] == "") | y["array"] | z["wide"] | (z["named"] & x["base"].isin(*FALLBACK)) | (unnamed & y["length"].isNull())
        flags = F.array_compact(F.array(F.when(lossy, F.lit("lossy_type")), F.when(fallback, F.lit("fallback_type"))))
        decimal = kind == "decimal"
        return F.struct(kind.alias("kind"), length.cast("int").alias("length"), F.when(decimal, digits).cast("int").alias("precision"), F.when(decimal, scale).cast("int").alias("scale"), flags.alias("flags"))

    return bound(bound(bound(bound(low, parts), first_kind), settled), result)


def _plain(name: str | None) -> str | None:
    """ASCII letters and digits in lower case joined by underscores; None where another script carries the name."""
    words: list[str] = []
    for c in unicodedata.normalize("NFKD", name or ""):
        if c.isascii():
            words.append(c.lower() if c.isalnum() else " ")
        elif not unicodedata.combining(c):
            if c.isalnum():
                return None
            words.append(" ")
    return "_".join("".join(words).split()) or None


@F.pandas_udf(StringType())
def sanitised(names: pd.Series) -> pd.Series:
    """Names in the form every platform takes; null for names of another script or of signs only. Arrow batches of names."""
    return names.map(_plain)


def _number(prefix: str, no: str) -> Column:
    """A placeholder name: the prefix and the number, three digits at least."""
    text = F.col(no).cast("string")
    return F.concat(F.lit(prefix + "_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def fitted(named: DataFrame, scope: list[str], key: str, limit: int, taken: tuple[str, ...] = ()) -> DataFrame:
    """named (base, `key` and others) with name and name_flags: names of at most `limit` bytes, unique within the scope.

    All names that meet, or meet a taken one, get the first six hex digits of their key's SHA-256, as do those that are too
    long; which ones does not depend on any order.
    """
    meets = F.count(F.lit(1)).over(Window.partitionBy(*scope, F.lower("base"))) > 1
    clash = meets | F.lower("base").isin(*[t.lower() for t in taken]) if taken else meets
    long = F.octet_length("base") > limit
    suffix = F.concat(F.lit("_"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 6))
    short = F.concat(F.regexp_replace(F.substring("base", 1, limit - 7), "_+$", ""), suffix)
    rows = named.withColumns({"__long": long, "__clash": clash})
    flags = F.array_compact(F.array(F.when(F.col("placeholder"), F.lit("placeholder")), F.when(F.col("__long"), F.lit("truncated")), F.when(F.col("__clash"), F.lit("collision"))))
    return rows.withColumns({"name": F.when(F.col("__long") | F.col("__clash"), short).otherwise(F.col("base")), "name_flags": flags}).drop("__long", "__clash", "placeholder", "base")


def staging(columns: DataFrame, platform: str, audit: tuple[str, str] = ("load_ts", "source_system"), reserved: tuple[str, ...] = RESERVED, longest: int = 128) -> DataFrame:
    """One row for each column of a staging table: staging_table, ordinal, staging_column, kind, length, precision, scale,
    nullable, role, mapping_type, sql, source_table_id, source_column_id, table_flags, flags.

    A source table becomes stg_<system>_<schema>_<table>, its columns direct mappings of their source, and two audit columns
    follow: when a row was loaded and from which system.
    """
    limit = min(PLATFORMS[platform].name_bytes, longest)
    tables = columns.groupBy("table_id").agg(*[F.min(c).alias(c) for c in ("system", "schema", "table", "table_no", "engine")], F.max("ordinal").alias("last"))
    tables = tables.withColumns({"__s": sanitised("schema"), "__t": sanitised("table")})
    schema = F.coalesce("__s", F.concat(F.lit("sch_"), F.substring(F.sha2("schema", 256), 1, 6)))
    base = F.concat_ws("_", F.lit("stg"), F.lower("system"), schema, F.coalesce("__t", _number("tbl", "table_no")))
    tables = tables.withColumns({"base": base, "placeholder": F.col("__s").isNull() | F.col("__t").isNull()}).drop("__s", "__t")
    tables = fitted(tables, [], "table_id", limit).withColumnsRenamed({"name": "staging_table", "name_flags": "table_flags"})

    own = columns.select("table_id", "column_id", "column", "column_no", "ordinal", "data_type", "nullable", "engine").withColumn("__c", sanitised("column"))
    base = F.coalesce("__c", _number("col", "column_no"))
    base = F.when(base.rlike("^[0-9]"), F.concat(F.lit("c_"), base)).otherwise(base)
    own = own.withColumns({"base": F.when(base.isin(*reserved), F.concat(base, F.lit("_col"))).otherwise(base), "placeholder": F.col("__c").isNull()}).drop("__c")
    own = fitted(own, ["table_id"], "column_id", limit, audit).withColumn("t", translated(F.col("data_type"), platform, F.col("engine"))).drop("engine")

    quoted = lambda c: F.when(F.col(c).rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col(c)).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    # tables are rows by the million where there are as many sources: names take many times what the source's file does, so
    # they are merged, never sent whole to all tasks through the driver
    slim = tables.select(F.col("table_id").alias("ti"), "staging_table", "schema", "table", "table_flags").hint("merge")
    direct = own.join(slim, F.col("table_id") == F.col("ti")).select(
        "staging_table", "ordinal", F.col("name").alias("staging_column"), "t.kind", "t.length", "t.precision", "t.scale", "nullable", F.lit("attribute").alias("role"), F.lit("direct").alias("mapping_type"),
        F.concat_ws(".", quoted("schema"), quoted("table"), quoted("column")).alias("sql"), F.col("table_id").alias("source_table_id"), F.col("column_id").alias("source_column_id"), "table_flags",
        F.concat("name_flags", "t.flags").alias("flags"),
    )
    added = F.array(
        F.struct(F.lit(1).alias("k"), F.lit(audit[0]).alias("name"), F.lit("timestamp").alias("kind"), F.lit(None).cast("int").alias("length"), F.lit("CURRENT_TIMESTAMP").alias("sql")),
        F.struct(F.lit(2).alias("k"), F.lit(audit[1]).alias("name"), F.lit("string").alias("kind"), F.lit(50).alias("length"), F.concat(F.lit("'"), F.replace("system", F.lit("'"), F.lit("''")), F.lit("'")).alias("sql")),
    )
    audits = tables.select("staging_table", "last", "table_id", "table_flags", F.explode(added).alias("a")).select(
        "staging_table", (F.col("last") + F.col("a.k")).alias("ordinal"), F.col("a.name").alias("staging_column"), "a.kind", "a.length", F.lit(None).cast("int").alias("precision"), F.lit(None).cast("int").alias("scale"),
        F.lit(False).alias("nullable"), F.lit("audit").alias("role"), F.lit("system").alias("mapping_type"), "a.sql", F.col("table_id").alias("source_table_id"), F.lit(None).cast("string").alias("source_column_id"), "table_flags",
        F.array().cast("array<string>").alias("flags"),
    )
    return direct.unionByName(audits)


def staging_edges(staged: DataFrame) -> DataFrame:
    """(source, target, kind): a value edge from each source column to its staging column."""
    target = F.concat_ws(".", "staging_table", "staging_column")
    return staged.where("source_column_id IS NOT NULL").select(F.col("source_column_id").alias("source"), target.alias("target"), F.lit("value").alias("kind"))


def review(staged: DataFrame) -> DataFrame:
    """(staging_table, staging_column, flag): what a person should look at; flags of a table have no column."""
    columns = staged.select("staging_table", "staging_column", F.explode("flags").alias("flag"))
    tables = staged.select("staging_table", F.lit(None).cast("string").alias("staging_column"), F.explode("table_flags").alias("flag")).distinct()
    return columns.unionByName(tables)
