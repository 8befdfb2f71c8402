"""Queries on staging generation, over the catalog of the tables themselves and over a table of sources for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import staging
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN", "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]"}
_SOURCE = "system string, schema string, table string, column string, ordinal int, data_type string, nullable boolean, table_id string, column_id string, table_no int, column_no int, engine string"


def catalog(spark, sf_dir):
    """The columns of the driver's tables, as a source catalog lists them."""
    rows = []
    for name in TABLES:
        for i, f in enumerate(table(spark, sf_dir, name).schema.fields):
            kind = f.dataType.simpleString()
            rows.append(("ERP", "main", name, f.name, i + 1, _SQL_TYPES.get(kind, kind.upper()), True, name, f"{name}.{f.name}", None, None, None))
    return spark.createDataFrame(rows, _SOURCE)


_CATALOG = "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal, lower(data_type) AS data_type FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
_KIND = "CASE WHEN data_type LIKE '%[]' THEN 'json' WHEN data_type = 'varchar' THEN 'string' WHEN data_type = 'timestamp with time zone' THEN 'timestamptz' WHEN data_type LIKE 'float%' THEN 'double' WHEN data_type LIKE 'decimal%' THEN 'decimal' ELSE data_type END"
_NAME = "CASE WHEN column_name IN (" + ", ".join(f"'{w}'" for w in staging.RESERVED) + ") THEN column_name || '_col' ELSE column_name END"


@query(
    f"WITH c AS ({_CATALOG}), l AS (SELECT table_name, max(ordinal) AS last FROM c GROUP BY 1) SELECT 'stg_erp_main_' || table_name AS staging_table, ordinal, {_NAME} AS staging_column, {_KIND} AS kind, 'direct' AS mapping_type, 'main.' || table_name || '.' || column_name AS sql, "
    "CASE WHEN data_type LIKE '%[]' THEN 'fallback_type' ELSE '' END AS flags FROM c UNION ALL SELECT 'stg_erp_main_' || table_name, last + 1, 'load_ts', 'timestamp', 'system', 'CURRENT_TIMESTAMP', '' FROM l UNION ALL SELECT 'stg_erp_main_' || table_name, last + 2, 'source_system', 'string', 'system', '''ERP''', '' FROM l"
)
def staging_of_catalog(spark, sf_dir):
    """A staging table for each of the tables, from their own catalog."""
    out = staging.staging(catalog(spark, sf_dir), "postgresql")
    return out.select("staging_table", "ordinal", "staging_column", "kind", "mapping_type", "sql", F.array_join("flags", ",").alias("flags"))


@query(f"WITH c AS ({_CATALOG}) SELECT table_name || '.' || column_name AS source, 'stg_erp_main_' || table_name || '.' || {_NAME} AS target, 'value' AS kind FROM c")
def staging_lineage(spark, sf_dir):
    return staging.staging_edges(staging.staging(catalog(spark, sf_dir), "postgresql"))


# a table of five columns for each part, named by its brand and type: many share a name
_PARTS = (
    "WITH p AS (SELECT p_partkey, p_name, p_brand, p_size FROM part), t AS (SELECT p_partkey, 'stg_parts_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM p), "
    "n AS (SELECT *, count(*) OVER (PARTITION BY base) > 1 AS meets, length(base) > 30 AS long FROM t), m AS (SELECT p_partkey, CASE WHEN meets OR long THEN rtrim(substr(base, 1, 23), '_') || '_' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 6) ELSE base END AS name, CASE WHEN long THEN 1 ELSE 0 END AS cut, CASE WHEN meets THEN 1 ELSE 0 END AS clash FROM n)"
)


def _part_columns(spark, sf_dir):
    """Five columns of a source table for each part."""
    kinds = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column"), F.lit(t).alias("data_type")) for i, (c, t) in enumerate([("Id", "bigint"), ("id", "number(12,2)"), ("Höhe", "varchar(9000)"), ("order", "timetz"), ("2nd", "money")])])
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        F.lit("PARTS").alias("system"), F.col("p_brand").alias("schema"), F.col("p_name").alias("table"), F.explode(kinds).alias("c"), key.alias("table_id"), F.lit(None).cast("string").alias("engine"),
    ).select("system", "schema", "table", "c.column", "c.ordinal", "c.data_type", F.lit(True).alias("nullable"), "table_id", F.concat_ws("/", "table_id", "c.ordinal").alias("column_id"), F.lit(1).alias("table_no"), "c.ordinal", "engine").toDF(
        "system", "schema", "table", "column", "ordinal", "data_type", "nullable", "table_id", "column_id", "table_no", "column_no", "engine"
    )


@query(
    f"{_PARTS} SELECT name AS staging_table, cut AS truncated, clash AS collision, 'id_' || substr(sha256(p_partkey || '/1'), 1, 6) || '|id_' || substr(sha256(p_partkey || '/2'), 1, 6) || '|hohe|order_col|c_2nd|load_ts|source_system' AS columns, "
    "'bigint|decimal(12,2)|text|time|decimal(19,4)|timestamp|string' AS kinds, 'collision|collision|fallback_type|lossy_type|||' AS flags FROM m"
)
def staging_generation(spark, sf_dir):
    """Staging tables of 30 bytes at most for as many source tables as there are parts, five columns each."""
    s = staging.staging(_part_columns(spark, sf_dir), "sqlserver", longest=30)
    kind = F.when(F.col("precision").isNotNull(), F.format_string("decimal(%d,%d)", "precision", "scale")).otherwise(F.col("kind"))
    row = F.struct("ordinal", "staging_column", kind.alias("kind"), F.array_join("flags", ",").alias("flags"))
    rows = s.groupBy("staging_table", "source_table_id").agg(F.sort_array(F.collect_list(row)).alias("c"), F.first("table_flags").alias("f"))
    joined = lambda part: F.array_join(F.transform("c", lambda x: x[part]), "|")
    return rows.select("staging_table", F.array_contains("f", "truncated").cast("int").alias("truncated"), F.array_contains("f", "collision").cast("int").alias("collision"), joined("staging_column").alias("columns"), joined("kind").alias("kinds"), joined("flags").alias("flags"))
