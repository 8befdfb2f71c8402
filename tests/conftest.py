"""One local session for all tests, and the comparison of a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).is_dir():
        pytest.skip("the driver's tables are not here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    """A value as text, so that engines' types of numbers do not matter; large integers stay exact."""
    if v is None:
        return "~"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf):
    def compare(query, sql):
        df = query(spark, sf)
        expected = duck.execute(sql)
        names = [d[0] for d in expected.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(names, expected.fetchall())

    return compare
