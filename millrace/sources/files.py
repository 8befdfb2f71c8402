"""Sources: files of several formats and JDBC databases, behind one small protocol."""

from __future__ import annotations

import functools
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import prepare, stored


class Source(Protocol):
    """What a source offers: its tables, a whole table, and a capped sample."""

    def tables(self) -> list[str]: ...

    def read(self, table: str) -> DataFrame: ...


def sample(source: Source, table: str, limit: int = 100) -> DataFrame:
    return source.read(table).limit(limit)


@dataclass(frozen=True)
class Files:
    """A folder with one file or folder for each table, all of one format."""

    spark: SparkSession
    root: str
    names: list[str]
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def tables(self) -> list[str]:
        return list(self.names)

    def read(self, table: str) -> DataFrame:
        defaults = {"csv": {"header": "true", "inferSchema": "true", "samplingRatio": "1.0"}, "json": {}, "orc": {}, "parquet": {}}
        return self.spark.read.format(self.format).options(**(defaults[self.format] | self.options)).load(f"{self.root}/{table}.{self.format}")


# URL forms, read-only session statements and drivers of the supported engines.
_ENGINES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", "SET SESSION TRANSACTION READ ONLY"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", None),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver", "SET TRANSACTION READ ONLY"),
}


def jdbc_options(engine: str, host: str, port: int, database: str, user: str, password: str, timeout: int = 30) -> dict[str, str]:
    """Reader options of a read-only JDBC session."""
    if engine not in _ENGINES:
        raise ValueError(f"unknown engine {engine}; known: {', '.join(sorted(_ENGINES))}")
    url, driver, read_only = _ENGINES[engine]
    out = {"url": url.format(host=host, port=port, database=database), "driver": driver, "user": user, "password": password, "queryTimeout": str(timeout), "fetchsize": "10000"}
    return out | ({"sessionInitStatement": read_only} if read_only else {})


@dataclass(frozen=True)
class Jdbc:
    """Tables of one schema; split_on reads a table in parallel ranges of a numeric column (column, low, high, pieces)."""

    spark: SparkSession
    options: dict[str, str]
    schema: str
    names: list[str]
    split_on: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)

    def tables(self) -> list[str]:
        return list(self.names)

    def read(self, table: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self.options).option("dbtable", f"{self.schema}.{table}")
        if table in self.split_on:
            column, low, high, pieces = self.split_on[table]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=pieces)
        return reader.load()


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _workbook(content: bytes) -> dict[str, list[list[str | None]]]:
    """The rows of each sheet of a workbook, cells as text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(book.read(name))
    shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in tree("xl/_rels/workbook.xml.rels")}
    out = {}
    for sheet in tree("xl/workbook.xml").iter(f"{_SHEET}sheet"):
        rows: list[list[str | None]] = []
        for row in tree("xl/" + targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]).iter(f"{_SHEET}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_SHEET}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1 if letters else len(cells)
                value, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t")) if inline is not None else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells += [None] * (at - len(cells)) + [text]
            rows.append(cells)
        out[sheet.get("name")] = rows
    return out


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of every sheet of the workbooks at path: each is read in a task, a workbook being small by format."""

    def read(frames):
        for pdf in frames:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(where, name, i + 1, cells) for name, sheet in _workbook(content).items() for i, cells in enumerate(sheet)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, sheet string, row int, cells array<string>")


def xlsx(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A workbook's sheet, by name or place, all cells as text under the names of its first row; empty cells are empty texts."""
    rows = stored(workbook_rows(spark, path), "workbook")
    names = [r["sheet"] for r in rows.where("row = 1").select("sheet").collect()]  # one for each sheet
    name = names[sheet] if isinstance(sheet, int) else sheet
    own = rows.where(F.col("sheet") == name)
    head = own.where("row = 1").select("cells").first()
    if head is None:
        raise ValueError(f"sheet_not_found: {name}; there are {', '.join(names)}")
    return own.where("row > 1").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c or f"col{i + 1}") for i, c in enumerate(head["cells"])])


def catalog(source: Source, schema: str = "main") -> DataFrame:
    """(schema, table, column, ordinal, data_type, nullable) of all tables of a source, as their readers see them."""
    spark, rows = None, []
    for name in source.tables():
        df = source.read(name)
        spark = df.sparkSession
        rows += [(schema, name, f.name, i + 1, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "schema string, table string, column string, ordinal int, data_type string, nullable boolean")


# File signatures and the extensions that may carry them.
_MAGIC = [("25504446", "pdf", ("pdf",)), ("504B0304", "zip", ("docx", "xlsx", "zip")), ("89504E47", "png", ("png",)), ("FFD8FF", "jpeg", ("jpg", "jpeg")), ("47494638", "gif", ("gif",)), ("1F8B", "gzip", ("gz",))]
_TEXTS = ("txt", "md", "csv", "tsv", "json", "html", "htm", "sql", "xml")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, file_type): the type by signature, or by extension for strict UTF-8 text; null where they disagree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head, ext = F.hex(F.substring("content", 1, 8)), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin(*_TEXTS) & F.is_valid_utf8(F.col("content")), ext)
    for magic, name, extensions in _MAGIC:
        kind = F.when(head.startswith(magic), F.when(ext.isin(*extensions), F.lit(name) if len(extensions) < 3 else ext)).otherwise(kind)
    return files.select("path", "length", "content", kind.alias("file_type"))


# What is read of a document at most (characters kept, paragraphs and table rows), and its part with the text.
MAX_CHARS, MAX_PARAGRAPHS = 2_000_000, 100_000
_BODY, _WORD = "word/document.xml", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> Iterator[str]:
    """The paragraphs and table rows of a DOCX document in its order, cells apart by tabs, a form feed for each page break.

    The package's XML is unpacked and parsed piece by piece, and what has been read is let go, so memory does not grow with the
    document. Nested tables' paragraphs belong to the outer cell.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as package, package.open(_BODY) as body:
        text: list[str] = []
        cells: list[str] = []
        tables, path = 0, []
        for event, e in ElementTree.iterparse(body, ("start", "end")):
            tag = e.tag.removeprefix(_WORD)
            if event == "start":
                path.append(e)
                tables += tag == "tbl"
                continue
            path.pop()
            if tag == "t":
                text.append(e.text or "")
            elif tag == "tab" and path and path[-1].tag == f"{_WORD}r":
                text.append("\t")
            elif tag in ("br", "cr"):
                text.append("\f" if e.get(f"{_WORD}type") == "page" else "\n")
            elif tag == "p" and not tables:
                yield "".join(text)
                text.clear()
            elif tag == "p":
                text.append(" ")
            elif tag == "tc" and tables == 1:
                cells.append(" ".join("".join(text).split()))
                text.clear()
            elif tag == "tr" and tables == 1:
                yield "\t".join(cells)
                cells.clear()
            tables -= tag == "tbl"
            if path and tag in ("p", "tr", "tbl"):
                path[-1].remove(e)  # its parent would hold on to it


def docx_text(content: bytes, max_chars: int = MAX_CHARS, max_paragraphs: int = MAX_PARAGRAPHS) -> tuple[str | None, str, str | None]:
    """(text, status, reason) of a DOCX document: extracted, or no_text_found; reason says where a limit cut the text, or why
    there is none."""
    out, size, reason = [], 0, None
    try:
        for n, line in enumerate(docx_lines(content)):
            if n >= max_paragraphs:
                reason = f"only the first {max_paragraphs} paragraphs were read"
                break
            if size + len(line) > max_chars:
                out.append(line[: max_chars - size])
                reason = f"only the first {max_chars} characters were read"
                break
            out.append(line)
            size += len(line) + 1
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, NotImplementedError, RuntimeError) as why:
        reason = f"the document is damaged: {type(why).__name__}"
    text = "\n".join(out).replace("\x00", "").strip(" \n\t\r")
    return (text, "extracted", reason) if text.strip() else (None, "no_text_found", reason or "there is no text in it")


def document_texts(spark: SparkSession, path: str, max_chars: int = MAX_CHARS, max_paragraphs: int = MAX_PARAGRAPHS) -> DataFrame:
    """(path, file_type, text, status, reason) of the files at path: DOCX by paragraphs and pages, HTML by what is visible, other
    text as it stands; others are unsupported. Files are read by Spark, one at a time in a task; a text is cut at max_chars."""

    def read(batches):
        for pdf in batches:
            rows = [(p, *docx_text(content, max_chars, max_paragraphs)) for p, content in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "status", "reason"])

    prepare(spark)
    files = binary_files(spark, path)
    words = files.where("file_type = 'docx'").select("path", "content").mapInPandas(read, "path string, text string, status string, reason string").withColumn("file_type", F.lit("docx"))
    plain = F.when(F.col("file_type").isin(*_TEXTS), F.decode("content", "UTF-8"))
    shown = F.trim(F.when(F.col("file_type").isin("html", "htm"), html_text(plain)).otherwise(plain))
    cut = F.when(F.length(shown) > max_chars, f"only the first {max_chars} characters were read").when(F.col("file_type").isNull(), "the content does not match the extension").when(shown.isNull(), "files of this type are not read").when(shown == "", "there is no text in it")
    status = F.when(shown.isNull(), "unsupported").when(shown == "", "no_text_found").otherwise("extracted")
    other = files.where("file_type IS NULL OR file_type <> 'docx'").select("path", "file_type", F.when(shown != "", F.substring(shown, 1, max_chars)).alias("text"), status.alias("status"), cut.alias("reason"))
    return words.select("path", "file_type", "text", "status", "reason").unionByName(other)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, common entities read, white space folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def schema_problems(tables: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """(problem, object) of imported schema sheets: duplicates, columns of unknown tables, references that do not exist or
    whose lists differ in length. Sheets: tables (table), columns (table, column), constraints (table, name, columns,
    ref_table, ref_columns), lists comma separated."""
    twice_t = tables.groupBy("table").count().where("count > 1").select(F.lit("duplicate_table").alias("problem"), F.col("table").alias("object"))
    full = F.concat_ws(".", "table", "column")
    twice_c = columns.groupBy("table", "column").count().where("count > 1").select(F.lit("duplicate_column").alias("problem"), full.alias("object"))
    known = tables.select(F.col("table").alias("kt")).distinct()
    lost = columns.join(known, F.col("table") == F.col("kt"), "left_anti").select(F.lit("unknown_table").alias("problem"), full.alias("object"))
    fk = constraints.where("ref_table IS NOT NULL")
    no_target = fk.join(known, F.col("ref_table") == F.col("kt"), "left_anti").select(F.lit("unknown_reference").alias("problem"), F.col("name").alias("object"))
    arity = fk.where(F.size(F.split("columns", ",")) != F.size(F.split("ref_columns", ","))).select(F.lit("reference_arity").alias("problem"), F.col("name").alias("object"))
    used = constraints.select("table", "name", F.explode(F.split("columns", r"\s*,\s*")).alias("used"))
    kc = columns.select(F.col("table").alias("ct"), F.col("column").alias("cc")).distinct()
    missing = used.join(kc, (F.col("table") == F.col("ct")) & (F.col("used") == F.col("cc")), "left_anti").select(F.lit("unknown_column").alias("problem"), F.col("name").alias("object"))
    return twice_t.unionByName(twice_c).unionByName(lost).unionByName(no_target).unionByName(arity).unionByName(missing)
