"""A schema brought in as sheets: read from CSV files or a workbook, checked row by row, and turned into a catalog with keys.

A sheet is a DataFrame of texts with `row`, its line in the file. A row that breaks a rule is an error and takes no further
part; what can be lived with is a warning. A catalog is given only for what no error concerns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import stored
from millrace.sources.files import workbook_rows

# The sheets with their columns, those that must be filled first; the most rows of one; words of flags.
SHEETS = {
    "schemas": (("schema",), ()),
    "tables": (("schema", "table", "kind"), ("row_count", "comment", "definition")),
    "columns": (("schema", "table", "column", "data_type"), ("ordinal", "is_nullable", "default", "comment")),
    "constraints": (("schema", "table", "constraint", "type", "columns"), ("ref_schema", "ref_table", "ref_columns")),
    "indexes": (("schema", "table", "index", "columns"), ("is_unique",)),
    "routines": (("schema", "name", "kind"), ("signature", "definition")),
}
NEEDED = ("tables", "columns")
MAX_ROWS = 500_000
TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")
_ISSUE = "sheet string, row int, severity string, code string, object string"


def read_sheets(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The sheets at path, a workbook or a folder of one CSV file a sheet, and the issues (sheet, row, severity, code, object) of
    their headers and sizes. Cells are trimmed, empty ones null."""
    raw: dict[str, DataFrame] = {}
    if path.lower().endswith(".xlsx"):
        rows = stored(workbook_rows(spark, path), "import")
        for r in rows.where("row = 1").select("sheet", "cells").collect():  # one for each sheet
            own = rows.where((F.col("sheet") == r["sheet"]) & (F.col("row") > 1))
            raw[r["sheet"].strip().lower()] = own.select("row", *[F.get("cells", F.lit(i)).alias(f"{i}:{(c or '').strip().lower()}") for i, c in enumerate(r["cells"])])
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect()  # one for each sheet
        for name, file in ((f["path"].rsplit("/", 1)[1][:-4].lower(), f["path"]) for f in found):
            df = spark.read.options(header=True, multiLine=True, escape='"').csv(file)
            lines = df.coalesce(1).withColumn("__row", (F.monotonically_increasing_id() + 2).cast("int"))  # one file is one piece
            raw[name] = lines.select(F.col("__row").alias("row"), *[F.col(f"`{c}`").alias(f"{i}:{c.strip().lower()}") for i, c in enumerate(df.columns)])
    issues, sheets = [], {}
    for name in NEEDED:
        if name not in raw:
            issues.append((name, None, "error", "sheet_missing", name))
    for name, df in raw.items():
        if name not in SHEETS:
            issues.append((name, None, "warning", "sheet_unknown", name))
            continue
        must, may = SHEETS[name]
        heads: dict[str, str] = {}
        for c in df.columns[1:]:
            head = c.partition(":")[2]
            if head in heads:
                issues.append((name, None, "error", "column_twice", head))
            elif head not in (*must, *may):
                issues.append((name, None, "warning", "column_unknown", head))
            heads.setdefault(head, c)
        issues += [(name, None, "error", "column_missing", c) for c in must if c not in heads]
        cell = lambda c, heads=heads: (F.nullif(F.trim(F.col(f"`{heads[c]}`")), F.lit("")) if c in heads else F.lit(None).cast("string")).alias(c)
        sheets[name] = df.select("row", *[cell(c) for c in (*must, *may)])
        if sheets[name].limit(MAX_ROWS + 1).count() > MAX_ROWS:
            issues.append((name, None, "error", "too_many_rows", name))
    return sheets, spark.createDataFrame(issues, _ISSUE)


class _Report:
    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def note(self, df: DataFrame, bad: Column, sheet: str, code: str, what: Column, severity: str = "error") -> DataFrame:
        """Report the rows that are bad; they go on."""
        row = F.col("row") if "row" in df.columns else F.lit(None).cast("int")
        self.parts.append(df.where(F.coalesce(bad, F.lit(False))).select(F.lit(sheet).alias("sheet"), row.alias("row"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), what.alias("object")))
        return df

    def refuse(self, df: DataFrame, bad: Column, sheet: str, code: str, what: Column) -> DataFrame:
        """Report the rows that are bad; the others go on."""
        return self.note(df, bad, sheet, code, what).where(~F.coalesce(bad, F.lit(False)))

    def filled(self, df: DataFrame, sheet: str) -> DataFrame:
        empty = F.lit(False)
        for c in SHEETS[sheet][0]:
            self.note(df, F.col(c).isNull(), sheet, "empty", F.lit(c))
            empty = empty | F.col(c).isNull()
        return df.where(~empty)

    def once(self, df: DataFrame, sheet: str, keys: list[str], what: Column) -> DataFrame:
        ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("row")))
        return self.refuse(ranked, F.col("__n") > 1, sheet, "listed_twice", what).drop("__n")

    def in_tables(self, df: DataFrame, sheet: str, tables: DataFrame) -> DataFrame:
        known = tables.select(F.col("schema").alias("__s"), F.col("table").alias("__t"))
        met = df.join(known, (F.col("schema") == F.col("__s")) & (F.col("table") == F.col("__t")), "left")
        return self.refuse(met, F.col("__t").isNull(), sheet, "unknown_table", F.concat_ws(".", "schema", "table")).drop("__s", "__t")


def _flag(c: str, default: bool) -> Column:
    low = F.lower(c)
    return F.when(low.isNull(), default).when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def _listed(c: str) -> Column:
    return F.filter(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def checked(sheets: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The catalog that the sheets describe, and the issues (sheet, row, severity, code, object) of their rows.

    Catalog: tables (schema, table, kind, row_count, comment, definition), columns (schema, table, column, data_type, ordinal,
    is_nullable, is_pk, default, comment), constraints (schema, table, constraint, type, columns, ref_schema, ref_table,
    ref_columns), indexes (schema, table, index, columns, is_unique), routines and schemas. Columns stand in order of their
    ordinals, those without one last, in the sheet's order.
    """
    report = _Report()
    spark = sheets["tables"].sparkSession
    some = lambda name: sheets[name] if name in sheets else spark.createDataFrame([], "row int, " + ", ".join(f"`{c}` string" for part in SHEETS[name] for c in part))
    full = F.concat_ws(".", "schema", "table")

    t = report.filled(some("tables"), "tables").withColumn("kind", F.lower("kind"))
    t = report.refuse(t, ~F.col("kind").isin("table", "view"), "tables", "kind_unknown", F.col("kind"))
    t = stored(report.once(t, "tables", ["schema", "table"], full), "import-tables")
    report.note(t, (F.col("kind") == "view") & F.col("definition").isNull(), "tables", "view_without_definition", full, "warning")
    report.note(t, (F.col("kind") == "table") & F.col("definition").isNotNull(), "tables", "definition_ignored", full, "warning")
    report.note(t, ~F.col("row_count").rlike("^[0-9]{1,18}$"), "tables", "not_a_number", F.col("row_count"))

    c = report.in_tables(report.filled(some("columns"), "columns"), "columns", t)
    name = F.concat_ws(".", "table", "column")
    c = report.once(c, "columns", ["schema", "table", "column"], name)
    c = stored(c, "import-columns")
    report.note(c, ~F.col("ordinal").rlike("^0*[1-9][0-9]{0,8}$"), "columns", "not_a_number", F.col("ordinal"))
    report.note(c, F.col("is_nullable").isNotNull() & _flag("is_nullable", True).isNull(), "columns", "not_a_flag", F.col("is_nullable"))
    held = c.select(F.col("schema").alias("cs"), F.col("table").alias("ct"), F.col("column").alias("cc"))
    bare = t.join(held.select("cs", "ct").distinct(), (F.col("schema") == F.col("cs")) & (F.col("table") == F.col("ct")), "left_anti").drop("row")
    report.note(bare, F.lit(True), "columns", "table_without_columns", full, "warning")

    k = report.in_tables(report.filled(some("constraints"), "constraints"), "constraints", t).withColumn("type", F.lower("type"))
    kind = F.when(F.col("type").isin("pk", "primary key", "primary_key"), "pk").when(F.col("type").isin("fk", "foreign key", "foreign_key"), "fk").when(F.col("type").isin("unique", "uq"), "unique")
    k = report.refuse(k.withColumn("__kind", kind), F.col("__kind").isNull(), "constraints", "type_unknown", F.col("type")).withColumn("type", F.col("__kind")).drop("__kind")
    k = report.once(k, "constraints", ["schema", "table", "constraint"], F.concat_ws(".", "table", "constraint"))
    k = stored(k.withColumns({"columns": _listed("columns"), "ref_columns": F.coalesce(_listed("ref_columns"), F.array().cast("array<string>")), "ref_schema": F.coalesce("ref_schema", "schema")}), "import-constraints")

    def absent(df: DataFrame, schema: str, table: str, columns: str, into: str) -> DataFrame:
        """df with the listed columns that a table does not have, as one text, null if it has them all."""
        each = df.select("row", F.col(schema).alias("es"), F.col(table).alias("et"), F.posexplode(columns).alias("place", "ec"))
        gone = each.join(held, (F.col("es") == F.col("cs")) & (F.col("et") == F.col("ct")) & (F.col("ec") == F.col("cc")), "left_anti")
        named = gone.groupBy(F.col("row").alias("gr")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "ec"))), lambda x: x["ec"]), ", ").alias(into))
        return df.join(named, F.col("row") == F.col("gr"), "left").drop("gr")

    said = lambda c: F.concat_ws(": ", "constraint", c)
    k = report.refuse(absent(k, "schema", "table", "columns", "__gone"), F.col("__gone").isNotNull(), "constraints", "unknown_columns", said("__gone")).drop("__gone")
    fk = F.col("type") == "fk"
    k = report.refuse(k, fk & (F.col("ref_table").isNull() | (F.size("ref_columns") == 0)), "constraints", "no_reference", F.col("constraint"))
    k = report.refuse(k, fk & (F.size("columns") != F.size("ref_columns")), "constraints", "reference_arity", F.col("constraint"))
    targets = t.select(F.col("schema").alias("ts"), F.col("table").alias("tt"))
    k = k.join(targets, fk & (F.col("ref_schema") == F.col("ts")) & (F.col("ref_table") == F.col("tt")), "left")
    k = stored(k.withColumn("__there", F.col("tt").isNotNull()).drop("ts", "tt"), "import-constraints")
    report.note(k, fk & ~F.col("__there"), "constraints", "reference_outside", said("ref_table"), "warning")
    k = absent(k.withColumn("__refs", F.when(F.col("__there"), F.col("ref_columns"))), "ref_schema", "ref_table", "__refs", "__gone")
    k = report.refuse(k, F.col("__gone").isNotNull(), "constraints", "unknown_reference_columns", said("__gone"))
    k = stored(k.drop("__gone", "__refs", "__there").withColumns({x: F.when(fk, F.col(x)) for x in ("ref_schema", "ref_table", "ref_columns")}), "import-constraints")

    i = report.in_tables(report.filled(some("indexes"), "indexes"), "indexes", t)
    i = report.once(i, "indexes", ["schema", "table", "index"], F.concat_ws(".", "table", "index"))
    report.note(i, F.col("is_unique").isNotNull() & _flag("is_unique", False).isNull(), "indexes", "not_a_flag", F.col("is_unique"))

    r = report.filled(some("routines"), "routines").withColumns({"kind": F.lower("kind"), "signature": F.coalesce("signature", F.lit(""))})
    r = report.refuse(r, ~F.col("kind").isin("procedure", "function"), "routines", "kind_unknown", F.col("kind"))
    r = report.once(r, "routines", ["schema", "kind", "signature", "name"], F.concat_ws(".", "schema", "name"))

    listed = some("schemas").where("schema IS NOT NULL").select("schema").distinct()
    used = t.select("schema").unionByName(r.select("schema")).distinct()
    if not listed.isEmpty():
        report.note(used.join(listed, "schema", "left_anti"), F.lit(True), "schemas", "schema_not_listed", F.col("schema"), "warning")

    keys = k.where("type = 'pk'").select(F.col("schema").alias("ks"), F.col("table").alias("kt"), F.explode("columns").alias("kc")).distinct()
    met = c.join(keys, (F.col("schema") == F.col("ks")) & (F.col("table") == F.col("kt")) & (F.col("column") == F.col("kc")), "left")
    place = F.try_to_number("ordinal", F.lit("999999999")).cast("int")
    order = Window.partitionBy("schema", "table").orderBy(place.asc_nulls_last(), "row")
    columns = met.select("schema", "table", "column", "data_type", F.coalesce(place, F.row_number().over(order)).alias("ordinal"), _flag("is_nullable", True).alias("is_nullable"), F.col("kc").isNotNull().alias("is_pk"), "default", "comment")
    catalog = {
        "tables": t.select("schema", "table", "kind", F.expr("try_cast(row_count AS bigint)").alias("row_count"), "comment", F.when(F.col("kind") == "view", F.col("definition")).alias("definition")),
        "columns": columns, "constraints": k.drop("row"), "indexes": i.select("schema", "table", "index", _listed("columns").alias("columns"), _flag("is_unique", False).alias("is_unique")), "routines": r.drop("row"), "schemas": listed.unionByName(used).distinct(),
    }
    return catalog, reduce(lambda a, b: a.unionByName(b), report.parts)
