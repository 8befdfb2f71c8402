"""Sources and sinks: what is written reads back the same, and what must not happen does not."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import session
from millrace.operators import relational, staging
from millrace.sources import files, sinks
from millrace.streaming import windows


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Ann, \"A\"", 1.5, True, None), (2, None, None, False, "x"), (3, "Bob", 0.0, None, "=1+1")], "id int, name string, score double, ok boolean, note string")


@pytest.mark.parametrize("kind", ["parquet", "orc", "json"])
def test_files_read_back(spark, people, tmp_path, kind):
    people.write.format(kind).save(f"{tmp_path}/people.{kind}")
    source = files.Files(spark, str(tmp_path), ["people"], kind)
    got = source.read("people").select(*people.columns)
    assert source.tables() == ["people"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, people.collect()))
    assert files.sample(source, "people", 2).count() == 2


def test_seed_csv_reads_back_with_its_types(spark, people, tmp_path):
    sinks.seed_csv(people, f"{tmp_path}/people.csv")
    got = files.Files(spark, str(tmp_path), ["people"], "csv").read("people")
    assert [f.dataType.typeName() for f in got.schema.fields] == ["integer", "string", "double", "boolean", "string"]
    assert {r["id"]: r["ok"] for r in got.collect()} == {1: True, 2: False, 3: None}
    assert {r["name"] for r in files.Files(spark, str(tmp_path), ["people"], "csv", {"escape": '"'}).read("people").collect()} >= {None, "Bob"}


def test_catalog_of_a_source(spark, people, tmp_path):
    people.write.parquet(f"{tmp_path}/people.parquet")
    got = files.catalog(files.Files(spark, str(tmp_path), ["people"])).orderBy("ordinal").collect()
    assert [(r["column"], r["data_type"]) for r in got] == [("id", "int"), ("name", "string"), ("score", "double"), ("ok", "boolean"), ("note", "string")]


def test_jdbc_options_are_read_only():
    out = files.jdbc_options("postgresql", "h", 5432, "db", "u", "p")
    assert out["url"] == "jdbc:postgresql://h:5432/db" and "READ ONLY" in out["sessionInitStatement"] and "sessionInitStatement" not in files.jdbc_options("sqlserver", "h", 1, "d", "u", "p")
    with pytest.raises(ValueError, match="unknown engine"):
        files.jdbc_options("dbase", "h", 1, "d", "u", "p")


def _xlsx(path):
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="First" sheetId="1" r:id="a"/><sheet name="Zwei" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>An</t></r><r><t>n</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="C3"><v>8</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>')


def test_workbooks_are_read_in_tasks(spark, tmp_path):
    _xlsx(tmp_path / "book.xlsx")
    first = files.xlsx(spark, f"{tmp_path}/book.xlsx")
    assert first.columns == ["name", "col2", "n"] and sorted(map(tuple, first.collect())) == [("", "", "8"), ("Ann", "", "7")]
    assert files.xlsx(spark, f"{tmp_path}/book.xlsx", "Zwei").count() == 0
    with pytest.raises(ValueError, match="sheet_not_found"):
        files.xlsx(spark, f"{tmp_path}/book.xlsx", "Drei")


def test_file_types_follow_signature_and_extension(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7"), ("b.txt", b"%PDF-1.7"), ("c.txt", "é".encode()), ("d.txt", b"\xff\xfe\xfa"), ("e.docx", b"PK\x03\x04"), ("f.bin", b"??")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["file_type"] for r in files.binary_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "pdf", "b.txt": None, "c.txt": "txt", "d.txt": None, "e.docx": "docx", "f.bin": None}


def test_replacing_by_key_leaves_other_keys_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(x, "v int, k string")
    sinks.replace_by_key(rows((1, "a"), (2, "a"), (3, "b")), path, "k")
    sinks.replace_by_key(rows((9, "a")), path, "k")
    assert sorted((r["v"], r["k"]) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_table_definitions():
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(12, 2))])
    text = sinks.create_table("core.dim", schema, "postgresql", ["id"], [(["name"], "core.other", ["name"])])
    assert text == 'CREATE TABLE "core"."dim" (\n  "id" bigint NOT NULL,\n  "name" text,\n  "amount" DECIMAL(12,2),\n  PRIMARY KEY ("id")\n);\nALTER TABLE "core"."dim" ADD FOREIGN KEY ("name") REFERENCES "core"."other" ("name");'
    assert "[id] bigint NOT NULL" in sinks.create_table("dim", schema, "sqlserver") and sinks.create_table("dim", schema).endswith("USING parquet;")
    for platform in ("oracle", "snowflake", "bigquery"):
        assert sinks.create_table("dim", schema, platform).startswith("CREATE TABLE ")
    assert sinks.insert_unknown("dim", schema, "id", "postgresql") == 'INSERT INTO "dim" ("id", "name", "amount") VALUES (-1, NULL, NULL);'


def test_capped_rows_say_whether_there_were_more(spark):
    assert relational.capped(spark.range(5), 5)[1] is False and relational.capped(spark.range(6), 5)[1] is True


def test_a_stream_of_batches_resumes_where_it_stopped(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    seen = []

    def apply(df, batch):
        seen.append(batch)
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "i int").coalesce(1).write.mode("append").parquet(source)
        windows.upsert_batches(spark.readStream.schema("i int").parquet(source), apply, f"{tmp_path}/progress").awaitTermination()
    assert seen == [0, 1] and sorted(r["i"] for r in spark.read.parquet(out).select("i").collect()) == list(range(5))


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(Cluster())


def test_approximate_profiles_are_close(spark):
    from millrace.operators import profile

    df = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("k"), F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("x"))
    exact, near = ({r["column_name"]: r.asDict() for r in profile.column_profile(df, approximate=a).collect()} for a in (False, True))
    for c in df.columns:
        assert abs(exact[c]["distinct_count"] - near[c]["distinct_count"]) <= 0.1 * exact[c]["distinct_count"]
        assert {k: v for k, v in exact[c].items() if k != "distinct_count"} == {k: v for k, v in near[c].items() if k != "distinct_count"}


@pytest.mark.parametrize(
    ("source", "platform", "engine", "want"),
    [
        ("NUMBER(12,2)", "oracle", "oracle", ("decimal", None, 12, 2, [])), ("number", "bigquery", None, ("decimal", None, 38, 9, ["lossy_type"])), ("numeric(40, 3)", "postgresql", None, ("decimal", None, 38, 3, ["lossy_type"])),
        ("number(5,-2)", "oracle", "oracle", ("decimal", None, 5, 0, ["lossy_type"])), ("decimal(4,9)", "postgresql", None, ("decimal", None, 4, 4, ["lossy_type"])), ("money", "bigquery", None, ("decimal", None, 19, 4, [])),
        ("varchar(9000)", "sqlserver", None, ("text", None, None, None, ["fallback_type"])), ("varchar2(100 char)", "oracle", "oracle", ("string", 100, None, None, [])), ("nvarchar(max)", "sqlserver", None, ("text", None, None, None, [])),
        ("char", "postgresql", None, ("char", 1, None, None, [])), ("int unsigned", "postgresql", None, ("integer", None, None, None, [])), ("float(24)", "postgresql", None, ("float", None, None, None, [])), ("float(53)", "postgresql", None, ("double", None, None, None, [])),
        ("timestamp", "sqlserver", "sqlserver", ("binary", 8, None, None, [])), ("date", "oracle", "oracle", ("timestamp", None, None, None, [])), ("time with time zone", "postgresql", None, ("time", None, None, None, ["lossy_type"])),
        ("integer[]", "postgresql", None, ("json", None, None, None, ["fallback_type"])), ("interval year to month", "postgresql", None, ("string", 64, None, None, ["lossy_type"])), ("wibble", "postgresql", None, ("text", None, None, None, ["fallback_type"])),
        ("", "postgresql", None, ("text", None, None, None, ["fallback_type"])), (None, "postgresql", None, ("text", None, None, None, ["fallback_type"])), ("XML", "postgresql", None, ("text", None, None, None, ["fallback_type"])), ("varbinary(20)", "postgresql", None, ("binary", 20, None, None, [])),
    ],
)
def test_source_types_become_staging_types(spark, source, platform, engine, want):
    df = spark.createDataFrame([(source, engine)], "t string, e string").select(staging.translated(F.col("t"), platform, F.col("e")).alias("r"))
    assert tuple(df.first()["r"]) == want


def test_a_schema_is_imported_from_csv_sheets(spark, tmp_path):
    from millrace.sources import schema_import

    (tmp_path / "tables.csv").write_text("Schema,Table,Kind,odd\ns, a ,table,1\ns,b,VIEW,\n")
    (tmp_path / "columns.csv").write_text('schema,table,column,data_type,ordinal,is_nullable\ns,a,id,"numeric(10,2)",,no\ns,a,name,text,1,\ns,b,x,int,,\n')
    (tmp_path / "constraints.csv").write_text('schema,table,constraint,type,columns,ref_schema,ref_table,ref_columns\ns,a,pk_a,PK,"id, name",,,\ns,b,fk_b,fk,x,,a,id\ns,b,fk_c,fk,x,,elsewhere,id\n')
    (tmp_path / "notes.csv").write_text("x\n1\n")
    sheets, issues = schema_import.read_sheets(spark, str(tmp_path))
    assert {(r["sheet"], r["severity"], r["code"], r["object"]) for r in issues.collect()} == {("tables", "warning", "column_unknown", "odd"), ("notes", "warning", "sheet_unknown", "notes")}
    catalog, found = schema_import.checked(sheets)
    assert {(r["row"], r["code"], r["object"]) for r in found.collect()} == {(3, "view_without_definition", "s.b"), (4, "reference_outside", "fk_c: elsewhere")}
    columns = {(r["table"], r["column"]): (r["data_type"], r["ordinal"], r["is_nullable"], r["is_pk"]) for r in catalog["columns"].collect()}
    assert columns == {("a", "id"): ("numeric(10,2)", 2, False, True), ("a", "name"): ("text", 1, True, True), ("b", "x"): ("int", 1, True, False)}
    assert {(r["constraint"], r["type"], r["ref_table"], tuple(r["columns"])) for r in catalog["constraints"].collect()} == {("pk_a", "pk", None, ("id", "name")), ("fk_b", "fk", "a", ("x",)), ("fk_c", "fk", "elsewhere", ("x",))}
    assert [r["schema"] for r in catalog["schemas"].collect()] == ["s"]


def test_an_import_without_its_sheets_says_so(spark, tmp_path):
    from millrace.sources import schema_import

    (tmp_path / "tables.csv").write_text("schema,table,table\ns,a,b\n")
    _, issues = schema_import.read_sheets(spark, str(tmp_path))
    assert {(r["sheet"], r["code"], r["object"]) for r in issues.collect()} >= {("columns", "sheet_missing", "columns"), ("tables", "column_missing", "kind")}
