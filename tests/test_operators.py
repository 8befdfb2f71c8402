"""Operators on small hand-made tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, guard, privacy, propagation, search, snapshots, warehouse
from millrace.sources import files


def _reached(df):
    return {(r["seed"], r["node"], r["hops"]) for r in df.collect()}


def _walk(edges, seeds):
    out = set()
    for seed in seeds:
        seen, layer, hops = {seed}, {seed}, 0
        while layer:
            out |= {(seed, n, hops) for n in layer}
            layer, hops = {t for s, t in edges if s in layer} - seen, hops + 1
            seen |= layer
    return out


@pytest.mark.parametrize("small", [0, 1000])
def test_reach_agrees_with_a_plain_walk_both_ways(spark, small):
    rng = random.Random(5)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    df = spark.createDataFrame([(s, t, "value") for s, t in edges] + [(None, 1, "value")], "source long, target long, kind string")
    found = graph.reach(df, spark.createDataFrame([(1,), (2,)], "node long"), small=small)
    assert _reached(found) == _walk(edges, [1, 2])


@pytest.mark.parametrize("small", [0, 1000])
def test_reach_stops_at_its_depth_and_takes_strings(spark, small):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "value") for i in range(6)], "source string, target string, kind string")
    found = graph.reach(chain, spark.createDataFrame([("n0",)], "node string"), depth=3, small=small)
    assert _reached(found) == {("n0", f"n{i}", i) for i in range(4)}


def test_reach_of_an_empty_graph_is_the_seeds(spark):
    empty = spark.createDataFrame([], "source long, target long, kind string")
    assert _reached(graph.reach(empty, spark.createDataFrame([(7,)], "node long"))) == {(7, 7, 0)}


@pytest.mark.parametrize(
    ("sql", "ok"),
    [
        ("SELECT k FROM t", True),
        ("SELECT k FROM t;", True),
        ("SELECT 'a;b' AS x FROM t", True),
        ("SELECT k FROM t; SELECT k FROM t", False),
        ("DELETE FROM t", False),
        ("SELECT ghost FROM t", False),
        ("SELECT * FROM other", False),
        ("SELECT java_method('java.lang.System', 'exit', 0)", False),
        ("SELECT k FROM parquet.`/etc`", False),
        ("SELECT k FROM secrets /* secrets as ( */", False),
        ("SELECT k FROM t WHERE k IN (SELECT k FROM secrets)", False),
        ("SELECT (SELECT max(k) FROM secrets) AS m FROM t", False),
        ("SELECT k FROM secrets UNION ALL (WITH secrets AS (SELECT 1 AS k) SELECT k FROM secrets)", False),
        ("WITH u AS (SELECT k FROM t) SELECT k FROM u ORDER BY (SELECT max(k) FROM secrets)", False),
        ("WITH u AS (SELECT k FROM t), w AS (SELECT k FROM u) SELECT k FROM w", True),
        ("WITH RECURSIVE t AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM t WHERE k < 5) SELECT k FROM t", False),
        ("WITH RECURSIVE u AS (SELECT k FROM t) SELECT k FROM u", False),
        ("SELECT current_user FROM t", False),
        ("SELECT k FROM t WHERE v = session_user", False),
        ("SELECT (SELECT user) AS u FROM t", False),
        ("WITH u AS (SELECT current_user AS c FROM t) SELECT c FROM u", False),
        ("SELECT current_date FROM t", True),
        ("", False),
    ],
)
def test_guard(spark, sql, ok):
    for view in ("t", "secrets"):
        spark.createDataFrame([(1, "x")], "k int, v string").createOrReplaceTempView(view)
    assert guard.accepts(spark, sql, {"t"}) is ok


def test_guard_masks_protected_columns_and_caps_rows(spark):
    people = spark.createDataFrame([(i, f"name{i}") for i in range(20)], "k int, name string")
    out = guard.run(spark, "SELECT k, name, upper(name) AS loud, count(*) AS n FROM people GROUP BY k, name", {"people": people}, {("people", "name")}, cap=5)
    rows = out.collect()
    assert len(rows) == 6 and {r["name"] for r in rows} == {"[masked]"} and {r["loud"] for r in rows} == {"[MASKED]"} and {r["n"] for r in rows} == {1}


def test_guard_masks_in_every_branch_and_subquery(spark):
    people = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "k int, name string")
    for sql in ("SELECT cast(k AS string) AS x FROM people UNION ALL SELECT name FROM people", "SELECT (SELECT max(name) FROM people) AS x FROM people", "WITH p AS (SELECT name AS x FROM people) SELECT x FROM p", "SELECT k AS x FROM people WHERE name = 'Ann'"):
        assert not {"Ann", "Bob"} & {r["x"] for r in guard.run(spark, sql, {"people": people}, {("people", "name")}).collect()}
    assert guard.run(spark, "SELECT k FROM people WHERE name = 'Ann'", {"people": people}, {("people", "name")}).count() == 0


def test_guard_leaves_the_callers_views_alone(spark):
    mine = spark.createDataFrame([(7, "mine")], "k int, name string")
    mine.createOrReplaceTempView("people")
    before = {t.name for t in spark.catalog.listTables()}
    one = guard.run(spark, "SELECT name FROM people", {"people": spark.createDataFrame([(1, "Ann")], "k int, name string")}, {("people", "k")})
    two = guard.run(spark, "WITH p AS (SELECT k, name FROM people) SELECT k AS name FROM p ORDER BY k LIMIT 3", {"people": mine}, {("people", "name")})
    assert [tuple(r) for r in one.collect()] == [("Ann",)] and [tuple(r) for r in two.collect()] == [(7,)]
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("people").first()["name"] == "mine"


def test_masking_by_place(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string").select("x", "y", "x")
    assert [tuple(r) for r in guard.masked_places(df, {2}).collect()] == [("a", "b", "[masked]")]


def test_reach_leaves_null_seeds_out_both_ways(spark):
    edges = spark.createDataFrame([(1, 2, "value"), (None, 3, "value"), (2, None, "value")], "source long, target long, kind string")
    seeds = spark.createDataFrame([(1,), (None,)], "node long")
    assert _reached(graph.reach(edges, seeds, small=0)) == _reached(graph.reach(edges, seeds, small=1000)) == {(1, 1, 0), (1, 2, 1)}


def test_redaction_keeps_numbers_that_fail_their_check(spark):
    text = "card 4111 1111 1111 1111, not 4111 1111 1111 1112; id 1000000008 not 1000000009; ip 10.0.0.1 not 999.1.1.1; SA0380000000608010167519 not SA0380000000608010167518; 0551234567"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(privacy.redacted(F.col("t")).alias("r"))
    marks = ("card_number", "national_id", "ip_address", "iban", "phone")
    want = "card [redacted: {}], not 4111 1111 1111 1112; id [redacted: {}] not 1000000009; ip [redacted: {}] not 999.1.1.1; [redacted: {}] not SA0380000000608010167518; [redacted: {}]".format(*marks)
    assert [r["r"] for r in df.collect()] == [want, None, ""]


def test_redaction_of_json(spark):
    df = spark.createDataFrame([('{"a": "mail x@y.org", "b": ["x@y.org", "z"], "n": 5}',)], "j string")
    out = df.select(privacy.redacted_json(F.col("j"), "a string, b array<string>, n int").alias("r")).first()["r"]
    assert out == '{"a":"mail [redacted: email]","b":["[redacted: email]","z"],"n":5}'


def test_hijri_days_of_a_given_calendar(spark):
    months = spark.createDataFrame([("2024-03-11", 1445, 9), ("2024-04-10", 1445, 10), ("2024-05-09", 1445, 11)], "d string, hijri_year int, hijri_month int").select(F.col("d").cast("date").alias("first_day"), "hijri_year", "hijri_month")
    days = spark.createDataFrame([("2024-03-10",), ("2024-03-11",), ("2024-04-09",), ("2024-04-10",), ("2024-05-09",)], "d string").select(F.col("d").cast("date").alias("d"))
    got = [(r["hijri_year_month"], r["hijri_day"], r["hijri_month_name"]) for r in warehouse.hijri(days, "d", months).orderBy("d").collect()]
    assert got == [(None, None, None), (144509, 1, "Ramadan"), (144509, 30, "Ramadan"), (144510, 1, "Shawwal"), (None, None, None)]


def _plain_mmr(rows, limit, weight=0.7):
    left, taken = sorted(rows, key=lambda r: (-r[0], r[1:])), []
    low = min(0, *(r[0] for r in rows))
    span = max(r[0] for r in rows) - low or 1
    while left and len(taken) < limit:
        gains = [weight * (r[0] - low) / span - (1 - weight) * max([0.0, *(0.0 if r[2] != t[2] else 1.0 if r[3] == t[3] else 0.3 for t in taken)]) for r in left]
        taken.append(left.pop(gains.index(max(gains))))
    return [r[1] for r in taken]


def test_diversity_agrees_with_a_plain_choice(spark):
    rng = random.Random(8)
    for n in (1, 2, 25):
        rows = [(rng.randrange(-3, 12) / 4, i, rng.randrange(3), rng.choice("ab")) for i in range(n)]
        df = spark.createDataFrame(rows, "score double, id int, file_id int, section string")
        assert [r["id"] for r in search.diversify(df, 10).orderBy("place").collect()] == _plain_mmr(rows, 10)
    assert search.diversify(df.where("false"), 10).count() == 0


def test_rename_pairs_are_taken_best_first(spark):
    rng = random.Random(9)
    rows = [(f"a{i}", f"b{j}", rng.randrange(5) / 4) for i in range(9) for j in range(9) if rng.random() < 0.6]
    used, want = set(), set()
    for a, b, c in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b, c))
    got = snapshots.greedy_pairs(spark.createDataFrame(rows, "from_name string, to_name string, confidence double"))
    assert {tuple(r) for r in got.collect()} == want


def test_passages_keep_pages_headings_and_tables_apart():
    rng = random.Random(3)
    sentence = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(4, 25))) + "."
    prose = lambda n: "\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(n))
    table = "| a | b |\n|---|:-:|\n" + "\n".join(f"| {i} | {'x' * 60} |" for i in range(60))
    text = prose(6) + "\n# One\n" + prose(9) + "\n" + table + "\nafter the table\n\f" + prose(3) + "\n## Two\n" + "y" * 9000
    got = search.passages(text, 250, 375, 40)
    assert all(search.tokens(p) <= 375 for _, _, p in got) and {h for h, _, _ in got} == {None, "One", "Two"} and {p for _, p, _ in got} == {1, 2}
    assert [h for h, p, _ in got if p == 2][0] == "One"
    tables = [p for _, _, p in got if p.startswith("| a | b |")]
    assert len(tables) > 1 and [line for t in tables for line in t.splitlines()[2:]] == table.splitlines()[2:]
    bare = search.passages(text, 250, 375)
    words = lambda t: re.findall(r"w[0-9]+", t)
    assert [w for _, _, p in bare for w in words(p)] == words(text) and sum(p.count("y") for _, _, p in bare) == 9000
    assert search.passages("", 10, 20) == [] and search.passages("one", 10, 20) == [(None, None, "one")]


def test_chunks_belong_to_their_parents(spark):
    text = "# T\n" + "\n\n".join(" ".join(f"a{i}b{j}" for j in range(60)) + "." for i in range(40))
    rows = search.chunked(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1, 3} and len({r["parent"] for r in rows if r["doc_id"] == 1}) > 1
    assert [r["chunk"] for r in rows if r["doc_id"] == 1] == list(range(len(rows) - 1))
    assert all(set(r["text"].split()) <= set(r["parent_text"].split()) for r in rows) and {r["section"] for r in rows} == {"T", "Part 1"}


def test_html_text(spark):
    page = "<html><style>p{}</style><script>var x = '<b>';</script><!-- no --><p>A &amp; B&nbsp;C</p>\n<b>d</b></html>"
    df = spark.createDataFrame([(page,), (None,)], "html string").select(files.html_text(F.col("html")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["A & B C d", None]


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy of the repository without the llm folders and the pipeline imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)




def test_outputs_are_traced_to_the_columns_behind_them(spark):
    from millrace.functions import validators as V

    people = spark.createDataFrame([(1, "a@b.co", "x"), (2, "c@d.org", "y")], "k int, mail string, note string")
    other = spark.createDataFrame([(1, "q")], "k int, name string")
    strong = {"email": V.email}
    found = lambda sql: {(r["column_name"], r["rule"]) for r in guard.recorded(spark, sql, {"people": people, "other": other}, strong, {}).collect()}
    assert found("SELECT lower(p.mail) AS m, name FROM people p JOIN other o ON p.k = o.k") == {("people.mail", "email")}
    assert found("WITH t AS (SELECT concat(note, mail) AS c FROM people) SELECT c FROM t UNION ALL SELECT name FROM other") == {("people.mail", "email"), ("people.note", "email"), ("other.name", "email")}
    assert found("SELECT (SELECT max(mail) FROM people) AS top, k FROM other") == {("people.mail", "email")}
    assert found("SELECT note, count(*) AS n FROM people WHERE mail LIKE '%@%' GROUP BY note") == set()
    assert guard.recorded(spark, "SELECT mail FROM people", {"people": people}, strong, {}, {("people", "mail")}).count() == 0  # masked


def test_formulas_are_checked_against_the_model(spark):
    from millrace.operators.formulas import formula_problems

    model = {("mart", "sales"): {"amount", "client_id"}, ("core", "sales"): {"amount", "note"}, ("core", "client"): {"id", "region"}}
    good = ["SELECT sum(amount) FROM sales", "select s.NOTE from core.sales s", "WITH t AS (SELECT id AS x FROM client) SELECT count(x) FROM t", "SELECT q.v FROM (SELECT amount AS v FROM sales) q", "SELECT amount AS a FROM sales ORDER BY a;"]
    assert [formula_problems(spark, f, model) for f in good] == [[]] * len(good)
    assert formula_problems(spark, "SELECT note FROM sales", model) == ["no table in the query has a column `note`"]  # the mart's table comes first
    assert formula_problems(spark, "SELECT s.x, s.y, t.z FROM mart.sales s", model) == ["`sales` has no column `x`", "`sales` has no column `y`", "`t` is not a table or alias in the query"]
    assert formula_problems(spark, "SELECT a, b, c, d, e, f, g FROM nowhere", model)[0] == "`nowhere` is not a core or mart table" and len(formula_problems(spark, "SELECT a, b, c, d, e, f, g FROM nowhere", model)) == 5
    assert formula_problems(spark, "DELETE FROM sales", model) == ["not one SELECT"] and formula_problems(spark, "SELECT 1; SELECT 2", model)[0].startswith("not valid SQL")
    assert formula_problems(spark, "SELECT anything FROM anywhere") == []


def test_renames_leave_literals_and_comments_alone(spark):
    mappings = spark.createDataFrame([(1, "T.code || 't.code' /* t.code\n */ || x.code -- t.code\n || t.code"), (2, "'t.code'"), (3, "u.a + it''s")], "mapping_id int, sql string")
    renames = spark.createDataFrame([("t", "code", "code2")], "table string, from_name string, to_name string")
    got = {r["mapping_id"]: r["sql"] for r in propagation.rewritten(mappings, renames).collect()}
    assert got == {1: "T.code2 || 't.code' /* t.code\n */ || x.code -- t.code\n || t.code2"}
