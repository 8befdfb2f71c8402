"""Sinks: seed files, replacement by key, table definitions, safe sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seed_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, ISO dates, true/false, and nothing for null."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", dateFormat="yyyy-MM-dd")


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Replace all rows of the keys in df and leave others alone: dynamic overwrite of the key's partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def sheet_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


# Column types of the Spark types on each platform.
_DDL = {
    "spark": {"long": "BIGINT", "integer": "INT", "short": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP_NTZ", "binary": "BINARY"},
    "postgresql": {"long": "bigint", "integer": "integer", "short": "smallint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea"},
    "sqlserver": {"long": "bigint", "integer": "int", "short": "smallint", "double": "float(53)", "float": "real", "string": "nvarchar(max)", "boolean": "bit", "date": "date", "timestamp": "datetimeoffset", "timestamp_ntz": "datetime2", "binary": "varbinary(max)"},
}


_DDL |= {
    "oracle": {"long": "NUMBER(19)", "integer": "NUMBER(10)", "short": "NUMBER(5)", "double": "BINARY_DOUBLE", "float": "BINARY_FLOAT", "string": "CLOB", "boolean": "NUMBER(1)", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"},
    "snowflake": {"long": "BIGINT", "integer": "INTEGER", "short": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_TZ", "timestamp_ntz": "TIMESTAMP_NTZ", "binary": "BINARY"},
    "bigquery": {"long": "INT64", "integer": "INT64", "short": "INT64", "double": "FLOAT64", "float": "FLOAT64", "string": "STRING", "boolean": "BOOL", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME", "binary": "BYTES"},
}
_QUOTE = {"spark": "`{}`", "bigquery": "`{}`", "sqlserver": "[{}]"}


def create_table(name: str, schema: T.StructType, platform: str = "spark", key: list[str] = (), foreign: list[tuple[list[str], str, list[str]]] = ()) -> str:
    """CREATE TABLE text of a schema with its key, and an ALTER TABLE for each foreign key (columns, table, its columns)."""
    quoted = lambda x: ".".join(_QUOTE.get(platform, '"{}"').format(p) for p in x.split("."))
    listed = lambda xs: ", ".join(quoted(x) for x in xs)
    types = _DDL[platform]

    def one(f: T.StructField) -> str:
        t = f.dataType
        kind = f"DECIMAL({t.precision},{t.scale})" if isinstance(t, T.DecimalType) else types[t.typeName()]
        return f"  {quoted(f.name)} {kind}{'' if f.nullable else ' NOT NULL'}"

    unforced = " NOT ENFORCED" if platform == "bigquery" else ""
    lines = [one(f) for f in schema.fields] + ([f"  PRIMARY KEY ({listed(key)}){unforced}"] if key and platform != "spark" else [])
    tail = " USING parquet" if platform == "spark" else ""
    out = [f"CREATE TABLE {quoted(name)} (\n" + ",\n".join(lines) + f"\n){tail};"]
    if platform != "spark":
        out += [f"ALTER TABLE {quoted(name)} ADD FOREIGN KEY ({listed(cs)}) REFERENCES {quoted(to)} ({listed(rs)}){unforced};" for cs, to, rs in foreign]
    return "\n".join(out)


def insert_unknown(name: str, schema: T.StructType, key: str, platform: str = "spark", value: int = -1) -> str:
    """INSERT text of a dimension's unknown member: its surrogate key, empty texts where null is not allowed, else null."""
    quoted = lambda x: ".".join(_QUOTE.get(platform, '"{}"').format(p) for p in x.split("."))
    values = [str(value) if f.name == key else "NULL" if f.nullable else "'Unknown'" if isinstance(f.dataType, T.StringType) else str(value) for f in schema.fields]
    return f"INSERT INTO {quoted(name)} ({', '.join(quoted(f.name) for f in schema.fields)}) VALUES ({', '.join(values)});"


def pii_inventory(findings: DataFrame) -> DataFrame:
    """(category, columns, rules): distinct sorted lists joined by semicolons, safe for sheets; findings (category, column, rule)."""
    listed = lambda c: sheet_cell(F.array_join(F.sort_array(F.collect_set(c)), "; "))
    return findings.groupBy("category").agg(listed("column").alias("columns"), listed("rule").alias("rules"))
