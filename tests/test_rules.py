"""Redaction windows, cover density, topics, set similarity, change sets, names, schemas and documents against plain versions."""

from __future__ import annotations

import io
import itertools
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import json_schema
from millrace.functions import text as X
from millrace.operators import graph, modelling, privacy, propagation, search, snapshots, warehouse
from millrace.plans import registry
from millrace.sources import files

# --- redaction


def luhn(d):
    return sum((int(c) * (1 + i % 2)) // 10 + (int(c) * (1 + i % 2)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def rule_of(d):
    if re.fullmatch("1[0-9]{9}", d) and luhn(d):
        return "national_id"
    if re.fullmatch("2[0-9]{9}", d) and luhn(d):
        return "iqama"
    if re.fullmatch(r"(0|(\+|00)?966)5[0-9]{8}", d):
        return "phone"
    return "card_number" if re.fullmatch("[0-9]{13,19}", d) and luhn(d) and len(set(d)) > 1 else None


def plain_numbers(text):
    """Windows of digit groups, the longest from the left, walked one by one over the text's tokens."""
    joiner = r"[\s\-().​‌‍⁠﻿­]?"

    def run(m):
        parts = re.findall(r"\+?\d+|[^\d+]+", m[0])
        out, i = "", 0
        while i < len(parts):
            best = None
            for j in range(i, len(parts), 2):
                digits = "".join(str(int(c)) if c.isdigit() else c for p in parts[i : j + 1 : 2] for c in p)
                if 9 <= len(digits.lstrip("+")) <= 19 and rule_of(digits):
                    best = j, rule_of(digits)
            out += f"[redacted: {best[1]}]" if best else parts[i]
            i = (best[0] if best else i) + 1
            if i < len(parts):
                out, i = out + parts[i], i + 1
        return out

    return re.sub(rf"(?<!\d)\+?\d(?:{joiner}\d){{8,}}(?!\d)", run, text)


def redacted_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", privacy.redacted(F.col("t")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_numbers_are_redacted_by_their_longest_windows(spark):
    rng = random.Random(12)
    known = ["1000000008", "2000000006", "0551234567", "4111111111111111", "+966551234567", "00966551234567", "378282246310005"]
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    texts = []
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(1, 7)):
            d = rng.choice([*known, "12", "7", "999", "1234567890", "0" * 12])
            for _ in range(rng.randrange(3)):
                k = rng.randrange(1, len(d)) if len(d) > 2 else 1
                d = d[:k] + rng.choice([" ", "-", ".", "", "​"]) + d[k:]
            words.append(d.translate(arabic) if rng.random() < 0.2 else d)
        texts.append(rng.choice([" ", ", ", "-", " x "]).join(words))
    got = redacted_of(spark, texts)
    assert got == [plain_numbers(t) for t in texts] and sum("card" in g for g in got) > 20


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1000000008 2000000006", "[redacted: national_id] [redacted: iqama]"),
        ("4111 1111 1111 1111 12", "[redacted: card_number] 12"),
        ("call (055.123-4567 or 966 55 123 4567, not 055 - 123 4567", "call ([redacted: phone] or [redacted: phone], not 055 - 123 4567"),
        ("at ::1 and fe80::1, not 12:30:45 or std::vector or 1:2:3:4:5:6:7:8:9", "at [redacted: ip_address] and [redacted: ip_address], not 12:30:45 or std::vector or 1:2:3:4:5:6:7:8:9"),
        ("10.0.0.1. v1.2.3.4 1.2.3.4.5 01.2.3.4", "[redacted: ip_address]. v1.2.3.4 1.2.3.4.5 01.2.3.4"),
        ("sa03 8000 0000 6080 1016 7519", "[redacted: iban]"),
        ("josé.müller@bücher.example x@y", "[redacted: email] x@y"),
        ("رقم ١٠٠٠٠٠٠٠٠٨ في ٢٠٢٤", "رقم [redacted: national_id] في ٢٠٢٤"),
        ("x" * 60_000, "x" * 60_000),
    ],
)
def test_redaction_of_written_forms(spark, text, want):
    assert redacted_of(spark, [text]) == [want]


def test_columns_with_dots_are_scanned_and_masked(spark):
    df = spark.createDataFrame([("a@b.co", 1), (None, 2)], "`e.mail` string, k int")
    assert {r["column_name"] for r in privacy.value_scan(df).where("matched > 0").collect()} == {"e.mail"}
    assert [tuple(r) for r in privacy.masked_columns(df, ["e.mail"]).collect()] == [("[masked]", 1), (None, 2)]


# --- cover density


def plain_covers(words, wanted, match):
    places = [(i, w) for i, w in enumerate(words) if w in wanted]
    if match == "any":
        return 0.1 * len(places)
    spans = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if {w for _, w in places[a : b + 1]} == set(wanted)]
    least = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    return sum(0.1 / (1 + (places[b][0] - places[a][0]) - (b - a)) for a, b in least)


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("query", ["red cars_9 running", "red red", "blue", "the red car"])
def test_cover_density_agrees_with_all_stretches(spark, match, query):
    rng = random.Random(5)
    vocabulary = ["red", "car", "cars", "cars_9", "run", "running", "the", "blue", "x", "y", "z"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))) for i in range(80)]
    one = lambda w: {"cars": "car", "running": "run", "the": "th", "blue": "blu"}.get(w, w)
    asked = [one(w) for w in query.split()]
    names = {w for w in asked if "_" in w}
    expected = []
    for i, t in docs:
        words = [one(w) for w in t.split()]
        score = plain_covers(words, set(asked), match)
        phrase = len(asked) > 1 and any(words[k : k + len(asked)] == asked for k in range(len(words)))
        if score:
            expected.append((not names & set(words), not phrase, -round(score, 9), i))
    got = search.cover_rank(spark.createDataFrame([*docs, (99, None)], "passage_id int, text string"), query, match, k=50).orderBy("position").collect()
    assert [(not r["identifier"], not r["phrase"], -round(r["signal"], 9), r["passage_id"]) for r in got] == sorted(expected)[:50]
    assert {r["t"] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select(X.stem(F.col("w")).alias("t")).collect()} == {one(w) for w in vocabulary}


def test_cover_density_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "passage_id int, text string")
    assert search.cover_rank(docs, " .,").collect() == [] and search.cover_rank(docs.limit(0), "a").collect() == []


# --- topics


def plain_topics(text, embed):
    parts = [s.strip() for s in re.split(r"(?<=[.!?؟])\s+|\n+", text) if s.strip()]
    if len(parts) < 2:
        return [text]
    v, out = embed(parts), [[parts[0]]]
    for a, b, s in zip(v, v[1:], parts[1:], strict=False):
        norm = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
        if (float((a * b).sum()) / norm if norm else 0.0) < 0.5:
            out.append([])
        out[-1].append(s)
    return [" ".join(x) for x in out]


def test_passages_end_where_the_topic_changes(spark):
    rng, embed = random.Random(7), search.bag_of_words()
    topics = [[f"t{k}w{j}" for j in range(6)] for k in range(4)]
    made = lambda n: " ".join(" ".join(rng.choices(rng.choice(topics), k=rng.randrange(4, 9))) + rng.choice([".", "!", ".\n"]) for _ in range(n))
    texts = [made(rng.randrange(1, 40)) for _ in range(12)]
    for t in texts:
        assert search.Topics(embed).cut(t) == plain_topics(t, embed)
        blocks = plain_topics(t, embed)
        whole = [p for _, _, p in search.passages(t, 10**6, 10**6, topics=search.Topics(embed))]
        assert whole == [b.strip() for b in blocks]
    rows = search.chunked(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string"), embed=embed).orderBy("doc_id", "chunk").collect()
    assert [r["parent_text"] for r in rows if r["doc_id"] == 0] == [b.strip() for b in plain_topics(texts[0], embed)]
    assert search.Topics(lambda s: embed(s)[1:]).cut(texts[0]) == [texts[0]]  # a wrong number of vectors


# --- set similarity


def test_alike_sets_agree_with_all_pairs(spark):
    rng = random.Random(3)
    sets = lambda p: {(s, f"{p}{i}"): {"ID", *(f"c{rng.randrange(9)}" for _ in range(rng.randrange(0, 7)))} for i in range(40) for s in [rng.choice(["x", "y", None])]}
    old, new = sets("o"), sets("n")
    flat = lambda d: spark.createDataFrame([(s, n, c) for (s, n), all_ in d.items() for c in all_] + [("x", next(iter(d))[1], None)], "scope string, name string, child string")
    expected = {(s, o, n, round(len(a & b) / len(a | b), 9)) for (s, o), a in old.items() for (t, n), b in new.items() if s == t and len(a & b) / len(a | b) >= 0.6}
    got = [(r["scope"], r["old"], r["new"], round(r["jaccard"], 9)) for r in snapshots.alike_sets(flat(old), flat(new)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_a_common_child_alone_joins_nothing(spark):
    make = lambda p: spark.createDataFrame([("s", f"{p}{i}", c) for i in range(300) for c in ("id", f"{p}{i}a", f"{p}{i}b")], "scope string, name string, child string")
    assert snapshots.alike_sets(make("o"), make("n")).collect() == []


def test_schemas_are_matched_before_their_tables(spark):
    rows = lambda s, ts: [(s, t, "table", c) for t, cs in ts.items() for c in cs]
    before = rows("sales", {"orders": "abcd", "clients": "efgh", "log": "xy"}) + rows("kept", {"one": "pq"})
    after = rows("sales2", {"orders": "abcd", "customers": "efghi", "log": "xy"}) + rows("kept", {"uno": "pq"})
    schema = "schema string, table string, kind string, child string"
    got = {(r["level"], r["schema"], r["from_name"], r["to_name"]) for r in snapshots.renames(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    assert got == {("table", "kept", "one", "uno")}  # half of the tables of sales went, which is too little
    after = rows("sales2", {"orders": "abcd", "customers": "efghi", "log": "xy", "more": "z"}) + rows("kept", {"one": "pq"})
    before += rows("sales", {"more": "z"})
    got = {(r["level"], r["schema"], r["from_name"], r["to_name"]) for r in snapshots.renames(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    assert got == {("schema", "sales2", "sales", "sales2"), ("table", "sales2", "clients", "customers")}


# --- graphs and change sets


@pytest.mark.parametrize("small", [0, 1000])
def test_spread_and_levels_agree_with_plain_walks(spark, small):
    rng = random.Random(small)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(50)}
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "source long, target long")
    reached, layer = {1, 2, 77}, {1, 2, 77}
    while layer:
        layer = {t for s, t in edges if s in layer} - reached
        reached |= layer
    assert {r["node"] for r in graph.spread(df, spark.createDataFrame([(1,), (2,), (77,), (None,), (1,)], "node long"), small).collect()} == reached
    forward = {(a, b) for a, b in edges if a < b} | {(38, 39), (39, 38)}
    level = {}
    for n in range(40):
        ready = [level.get(a) for a, b in forward if b == n]
        level[n] = None if n in (38, 39) or None in ready else 1 + max(ready, default=-1)
    got = graph.levels(spark.createDataFrame(list(forward), "source long, target long"), spark.range(40).withColumnRenamed("id", "node"))
    assert {r["node"]: r["level"] for r in got.collect()} == level


def test_hashed_columns_do_not_taint_alone(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (5, 6)]  # 3 is a hash; 4 has a path past it, 5 and 6 have none
    df = spark.createDataFrame([(a, b, "value") for a, b in edges] + [(6, 7, "uses"), (7, 8, "lookup")], "source long, target long, kind string")
    got = graph.propagate(df, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(3,), (1,)], "node long"))
    assert {(r["node"], r["status"], r["pseudonymised"]) for r in got.collect()} == {(1, "derived", False), (2, "derived", False), (3, "pseudonymised", True), (4, "derived", True), (5, "pseudonymised", True), (6, "pseudonymised", True), (7, "influenced", None)}


def plain_accept(items, selected, owner):
    """One by one, items in order; those on a cycle or behind one are left out first."""
    by, is_open = {i["item"]: i for i in items}, lambda s: s in ("pending", "needs_owner")
    known = {i for i in by}
    after = {i: i for i in known}
    status, reason = {i: by[i]["status"] for i in known}, {}
    dependents = lambda roots: _closed(roots, {i: [k for k in known if i in by[k]["depends_on"]] for i in known})
    dependencies = lambda roots: _closed(roots, {i: [d for d in by[i]["depends_on"] if d in known] for i in known})
    chosen = {i for i in dependencies(selected) if is_open(status[i])}
    held = {i for i in chosen if by[i]["required_role"] == "owner" and not owner}
    waiting = dependents(held) & chosen
    candidates = chosen - waiting
    cyclic = {i for i in known if i in _closed({d for d in by[i]["depends_on"] if d in known}, {k: [d for d in by[k]["depends_on"] if d in known] for k in known})}
    cyclic = dependents(cyclic)
    for i in candidates:
        if i in cyclic:
            reason[i] = "cycle"
        elif any(d not in known or (not is_open(by[d]["status"]) and by[d]["status"] != "accepted") for d in by[i]["depends_on"]):
            reason[i] = "not_applied"
        elif by[i]["stale"]:
            reason[i] = "stale"
    while more := {i for i in candidates - set(reason) if any(d in reason for d in by[i]["depends_on"])}:
        reason |= dict.fromkeys(more, "depends_on_skipped")
    for i in candidates:
        status[i] = "stale" if i in reason else "accepted"
    for i in waiting:
        status[i] = "needs_owner" if i in held else "pending"
    kept = dependents({i for i in after if status[i] == "needs_owner"})
    for i in known:
        if is_open(status[i]) and i not in waiting | kept:
            status[i] = "expired"
    return {(i, status[i], reason.get(i)) for i in known}


def _closed(roots, after):
    found, layer = set(roots), set(roots)
    while layer:
        layer = {t for n in layer for t in after.get(n, ())} - found
        found |= layer
    return found


@pytest.mark.parametrize(("seed", "owner"), [(1, False), (2, True)])
def test_accepted_items_agree_with_a_plain_walk(spark, seed, owner):
    rng = random.Random(seed)
    items = []
    for i in range(60):
        depends = sorted({rng.randrange(i) for _ in range(rng.randrange(3))}) if i else []
        items.append({"change_set": i // 20, "item": i, "depends_on": depends, "status": rng.choice(["pending"] * 6 + ["needs_owner", "accepted", "rejected"]), "required_role": rng.choice(["member"] * 7 + ["owner"]), "stale": rng.random() < 0.1})
    items[7]["depends_on"], items[9]["depends_on"], items[11]["depends_on"] = [9], [7], [500]
    selected = {i for i in range(60) if i % 3 != 1}
    schema = "change_set int, item int, depends_on array<int>, status string, required_role string, stale boolean"
    df = spark.createDataFrame([tuple(i.values()) for i in items], schema)
    got = modelling.accepted_items(df, spark.createDataFrame([(i,) for i in selected], "item int"), owner).collect()
    assert {(r["item"], r["status"], r["reason"]) for r in got} == plain_accept(items, selected, owner) and len(got) == 60


_SET_ITEMS = "change_set int, item int, depends_on array<int>, status string, required_role string, stale boolean"


def test_closed_change_sets_take_no_rounds(spark, monkeypatch):
    """Sets that nothing links are decided where they lie, however long their chains are."""
    written = []
    monkeypatch.setattr(modelling, "stored", lambda df, name, f=modelling.stored: written.append(name) or f(df, name))
    monkeypatch.setattr(modelling, "spread", None)
    rows = [(s, 100 * s + i, [100 * s + i - 1] if i else [-1] * (s == 3), "pending", "owner" if (s, i) == (1, 20) else "member", (s, i) == (2, 30)) for s in range(5) for i in range(40)]
    got = {r["item"]: (r["status"], r["reason"]) for r in modelling.accepted_items(spark.createDataFrame(rows, _SET_ITEMS)).collect()}
    want = {100 * s + i: ("accepted", None) for s in range(5) for i in range(40)}
    want |= {i: ("pending", None) for i in range(121, 140)} | {120: ("needs_owner", None)}
    want |= {i: ("stale", "depends_on_skipped") for i in [*range(231, 240), *range(301, 340)]} | {230: ("stale", "stale"), 300: ("stale", "not_applied")}
    assert got == want and len(written) <= 3


@pytest.mark.parametrize("copies", [1, 3])
def test_orders_as_change_sets_take_no_rounds(spark, sf, duck, tmp_path, monkeypatch, copies):
    """change_set_items over copies of the orders with shifted keys writes as few tables for many copies as for one."""
    written = []
    monkeypatch.setattr(modelling, "stored", lambda df, name, f=modelling.stored: written.append(name) or f(df, name))
    monkeypatch.setattr(modelling, "spread", None)
    path = tmp_path / "orders.parquet"
    duck.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + c * n AS o_orderkey, o_custkey + c * k AS o_custkey) FROM range({copies}) r(c), (SELECT max(o_orderkey) + 1 AS n, max(o_custkey) + 1 AS k FROM orders), orders o) TO '{path}' (FORMAT parquet)")
    got = registry.queries()["change_set_items"](spark, str(tmp_path)).collect()
    want = duck.execute(registry.oracle_sql()["change_set_items"].replace("FROM orders)", f"FROM '{path}')")).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == copies * duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert written == ["items", "items-linking", "sets-apart"]


@pytest.mark.parametrize(("seed", "owner"), [(3, False), (4, True)])
def test_change_sets_agree_whether_near_large_or_linked(spark, seed, owner):
    """Sets of 10, one of 40, two that share a dependency; then the same with items that are there twice or in no set."""
    rng = random.Random(seed)
    items = []
    for i in range(160):
        first = i // 10 * 10 if i < 120 else 120
        depends = sorted({rng.randrange(first, first + 10) for _ in range(rng.randrange(3))} - {i})
        items.append({"change_set": first // 10, "item": i, "depends_on": depends, "status": rng.choice(["pending"] * 6 + ["needs_owner", "accepted", "rejected"]), "required_role": rng.choice(["member"] * 9 + ["owner"]), "stale": rng.random() < 0.1})
    items[31]["depends_on"], items[45]["depends_on"], items[52]["depends_on"], items[61]["depends_on"] = [47], [900], [52], [900]
    selected = {i for i in range(160) if i % 3 != 1}
    chosen = spark.createDataFrame([(i,) for i in selected], "item int")
    rows = [tuple(i.values()) for i in items]
    told = lambda x, small: sorted((tuple(r) for r in modelling.accepted_items(spark.createDataFrame(x, _SET_ITEMS), chosen, owner, small).collect()), key=str)
    apart = modelling._sets_apart(spark.createDataFrame(rows, _SET_ITEMS), 20).collect()
    assert {r[0] for r in apart} == {3, 4, 12}
    mixed = told(rows, 20)
    assert {r[1:] for r in mixed} == plain_accept(items, selected, owner) and len(mixed) == 160
    rows += [(14, 75, [81], "pending", "owner", False), (None, 200, [93], "pending", "member", True), (None, 201, None, "pending", None, None)]
    assert told(rows, 20) == told(rows, 0)


def test_names_follow_their_chains_in_time(spark):
    rng = random.Random(4)
    log = [(rng.choice("st"), f"N{rng.randrange(8)}", f"n{rng.randrange(8)}", t) for t in range(60)]
    expected = {}
    for k, (scope, old, _, at) in enumerate(log):
        name, when = log[k][2], at
        while nxt := next((e for e in log if e[0] == scope and e[1].lower() == name and e[3] > when), None):
            name, when = nxt[2], nxt[3]
        expected[scope, old.lower()] = name
    got = propagation.names_now(spark.createDataFrame([*log, ("s", None, "x", 1)], "scope string, from_name string, to_name string, at int"))
    assert {(r["scope"], r["name"]): r["now"] for r in got.collect()} == expected


# --- schemas and documents

SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": {"type": "number"},
    "properties": {"a": {"type": ["string", "null"], "minLength": 2, "maxLength": 4}, "n": {"$ref": "#/$defs/node"}, "l": {"type": "array", "items": {"enum": ["x", "y", 1]}, "minItems": 1, "maxItems": 2}, "u": {"type": "string", "format": "uuid"}, "c": {"const": True}, "g": {"$ref": "#/nowhere"}},
    "$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer", "minimum": 0}, "next": {"anyOf": [{"$ref": "#/$defs/node"}, {"type": "null"}]}}, "required": ["v"], "additionalProperties": False}},
}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": "xyz"}', []), ('{"a": null, "z": 1.5}', []), ('{"a": "x"}', ["v.a: is too short"]), ('{"b": "q"}', ["v.a: is required", "v.b: must be of type number"]), ("[1]", ["v: must be of type object"]), ("nope", ["v: not JSON"]), (None, None),
        ('{"a": "abc", "n": {"v": 1, "next": {"v": 2, "next": null}}}', []), ('{"a": "abc", "n": {"v": 1, "next": {"v": -2}}}', ["v.n.next: does not match any allowed form"]), ('{"a": "abc", "n": {"v": 1.5, "w w": 2}}', ["v.n.v: must be of type integer", "v.n: the property (unusual name) is not allowed"]),
        ('{"a": "abc", "l": ["x", "z", 1]}', ["v.l: has too many items", "v.l[1]: must be one of 'x', 'y', 1"]), ('{"a": "abc", "l": []}', ["v.l: has too few items"]), ('{"a": "abc", "u": "12"}', ["v.u: must be a UUID"]), ('{"a": "abc", "c": 1}', ["v.c: is not the allowed constant"]),
        ('{"a": "abc", "g": 1}', ["v.g: the schema has an unresolvable reference"]), ('{"a": 7}', ["v.a: must be of type string/null"]),
    ],
)
def test_json_against_a_schema(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(json_schema.violations(F.col("t"), SCHEMA, "v").alias("r")).first()["r"] == want


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("word/document.xml", "w", force_zip64=True) as f:
        f.write(f"<w:document {W}><w:body>".encode())
        for part in [body] if isinstance(body, str) else body:
            f.write(part.encode())
        f.write(b"</w:body></w:document>")
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


def t(text):
    return f'<w:t xml:space="preserve">{text}</w:t>'


def test_text_of_documents(spark, tmp_path):
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    table = f"<w:tbl><w:tr>{cell(p(t('a')))}{cell(p(t('b')) + p(t('c')))}</w:tr><w:tr>{cell(p(t('d')))}{cell('<w:tbl><w:tr>' + cell(p(t('in'))) + '</w:tr></w:tbl>')}</w:tr></w:tbl>"
    body = p(t("One "), t("&amp; two"), "<w:tab/>", t("x")) + table + p(t("end")) + p('<w:br w:type="page"/>', t("next page"))
    (tmp_path / "a.docx").write_bytes(docx(body))
    (tmp_path / "empty.docx").write_bytes(docx(""))
    (tmp_path / "bad.docx").write_bytes(docx(body)[:200])
    (tmp_path / "t.txt").write_bytes("  täxt ".encode())
    (tmp_path / "h.html").write_bytes(b"<p>A <b>b</b></p>")
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["status"], r["reason"]) for r in files.document_texts(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("One & two\tx\na\tb c\nd\tin\nend\n\fnext page", "extracted", None)
    assert got["empty.docx"] == (None, "no_text_found", "there is no text in it") and got["bad.docx"] == (None, "no_text_found", "the document is damaged: BadZipFile")
    assert got["t.txt"] == ("täxt", "extracted", None) and got["h.html"] == ("A b", "extracted", None) and got["i.png"] == (None, "unsupported", "files of this type are not read")


def test_limits_of_documents_give_their_reason():
    assert files.docx_text(docx(p(t("abc")) * 10), max_paragraphs=2) == ("abc\nabc", "extracted", "only the first 2 paragraphs were read")
    assert files.docx_text(docx(p(t("abc")) * 10), max_chars=6) == ("abc\nab", "extracted", "only the first 6 characters were read")


def test_a_document_of_100_mb_is_read_in_bounded_memory():
    import tracemalloc

    line = p(t("word " * 40))
    content = docx(itertools.repeat(line * 1000, 430))
    tracemalloc.start()
    lines = sum(1 for _ in files.docx_lines(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 430_000 and 430 * len(line) * 1000 > 100_000_000 and peak < 30_000_000


@pytest.mark.parametrize(
    ("rule", "why"),
    [
        ({"name": "Bad Name"}, "name"), ({"category": "odd"}, "category"), ({"confidence": 0.1}, "confidence"), ({"keywords": ["k"] * 21}, "keywords"), ({"keywords": ["x" * 65]}, "keywords"), ({"keywords": ["--"]}, "letter or a digit"),
        ({"keywords": []}, "keyword or a pattern"), ({"pattern": "a" * 201}, "200"), ({"pattern": "(a+)+"}, "nested"), ({"pattern": "(a|b*c)*"}, "nested"), ({"pattern": "(x+){2,}"}, "nested"), ({"pattern": "("}, "no regular expression"),
    ],
)
def test_rules_of_ones_own_have_limits(rule, why):
    with pytest.raises(ValueError, match=why):
        privacy.custom_rule(**({"name": "badge", "category": "direct_identifier", "confidence": 0.8, "keywords": ["Badge No"]} | rule))


def test_rules_of_ones_own_fit_names_and_values(spark):
    by_name, fits = privacy.custom_rule("badge", "direct_identifier", 0.8, ["Badge No"], r"B-\d{4}")
    assert privacy.name_rule("employee_badge_no", [by_name]) == ("custom:badge", "direct_identifier", 0.8) and privacy.name_rule("email", [by_name])[0] == "email"
    df = spark.createDataFrame([("B-1234",), ("xB-1234",), (None,), ("B-1234" + " " * 300,)], "v string")
    assert [r["f"] for r in df.select(fits(F.col("v")).alias("f")).collect()] == [True, False, False, False]


def test_scores_of_guesses_and_counts_that_ran_out_of_time(spark):
    from millrace.operators import relate

    rows = [(0.6, 0.7, True), (0.6, 0.9, False), (None, 0.9, True), (None, 0.9, False), (0.6, None, True), (None, None, True), (0.98, 0.99, True)]
    df = spark.createDataFrame(rows, "rule double, ai double, counted boolean")
    best = relate.guess_score(F.col("rule"), F.col("ai"), F.col("counted"))
    got = df.select(best.alias("g"), relate.timed_out_confidence(best).alias("t")).collect()

    def plain(rule, ai, counted):
        held = None if ai is None else ai if counted else min(ai, relate.UNCOUNTED_CAP)
        both = relate.BOTH_BONUS if rule is not None and ai is not None else 0
        return round(min(1.0, max(rule or 0.0, held or 0.0) + both), 4)

    want = [plain(*r) for r in rows]
    assert [r["g"] for r in got] == want and [r["t"] for r in got] == [round(max(relate.TIMEOUT_FLOOR, g - relate.TIMEOUT_PENALTY), 4) for g in want]


def test_staging_tables_are_merged_not_broadcast(spark, sf):
    """A small file of sources makes tables that no driver could send around."""
    from millrace.operators import staging
    from millrace.plans.staging import _part_columns

    plan = staging.staging(_part_columns(spark, sf), "sqlserver", longest=30)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_likeness_is_that_of_difflib():
    import difflib

    r = random.Random(3)
    for alphabet in ("ab", "abcde_1", "large ringnew_0123456789") * 300:
        a, b = ("".join(r.choices(alphabet, k=r.choice((0, 1, 7, 25, 230)))) for _ in range(2))
        assert snapshots._ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_column_renames_of_a_full_place(spark):
    """A place with many columns is compared in many lots, each pair once; nulls meet nothing."""
    make = lambda p, n: spark.createDataFrame([("t", f"{p}{i}", "int", 1) for i in range(n)] + [("u", f"{p}u", "int", 1), (None, f"{p}n", "int", 1)], "table string, name string, data_type string, ordinal int")
    found = snapshots.column_renames(make("a", 30), make("b", 3 * snapshots.DEAL))
    got = [(r["from_name"], r["to_name"]) for r in found.collect()]
    assert sorted(got) == sorted([(f"a{i}", f"b{j}") for i in range(30) for j in range(3 * snapshots.DEAL)] + [("au", "bu")])
    assert "ShuffledHashJoin" in found._jdf.queryExecution().sparkPlan().toString()  # a broadcast leaves all pairs to the few tasks that read the columns


def test_topics_hold_the_vectors_of_a_lot_only(monkeypatch):
    monkeypatch.setattr(search.Topics, "LOT", 8)
    topics, most, seen = search.Topics(search.bag_of_words(16)), 0, []
    docs = [(i, " ".join(f"Word{i} is {j} here." for j in range(3)) if i != 4 else None) for i in range(40)]
    for lot in search._lots(iter(docs), topics):
        seen += lot
        assert all(s in topics.known for _, text in lot if text for s in search.sentences(text))
        most = max(most, len(topics.known))
    assert seen == docs and most <= 8 + 3


def test_each_formula_is_parsed_once(spark, monkeypatch):
    from millrace.operators import formulas

    asked = []
    monkeypatch.setattr(formulas, "LOT", 2)
    monkeypatch.setattr(formulas, "formula_problems", lambda _, sql, tables: asked.append(sql) or ([] if sql != "c" else ["bad", "worse"]))
    got = formulas.checked_formulas(spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(30, None)], "kpi long, sql string"), {})
    assert {r["kpi"]: r["problems"] for r in got.collect()} == {i: ["bad", "worse"] if i % 3 == 2 else [] for i in range(30)} | {30: None}
    assert sorted(asked) == ["a", "b", "c"]


def test_checks_run_once_for_scores_and_errors(spark):
    """Scores and errors are read from sums that are written once."""
    from millrace.operators import score

    runs = spark.sparkContext.accumulator(0)

    def passed(x):
        runs.add(1)
        return x != "a"

    findings = spark.createDataFrame([("error", "a", "core"), ("info", "b", "core"), ("warning", "c", "mart")], "severity string, table_id string, layer string")
    findings = findings.withColumn("passed", F.udf(passed, "boolean").asNondeterministic()("table_id"))
    tables = spark.createDataFrame([("a", "core"), ("b", "core"), ("c", "mart")], "table_id string, layer string")
    got = score.layer_scores(findings, tables, tables.select("table_id")).collect()
    assert {(r["layer"], r["score"], r["grade"]) for r in got} == {("core", 50.0, "F"), ("mart", 100.0, "A")} and runs.value == 3


@pytest.mark.parametrize("nested", [False, True])
def test_strict_lookups_group_no_facts(spark, nested):
    """Each fact is given once, with the version that begins last of those that hold, ends included."""
    rng = random.Random(5)
    spans = [(k, a, a + 4, 100 * k + a) for k in range(4) for a in (0, 4, 9)] + [(5, 0, None, 500), (6, 0, 3, 600), (6, 3, None, 603), (7, 0, 6, 700), (7, 2, 8, 702), (None, 0, 9, 1)]
    if nested:
        spans += [(k, a, a + rng.randrange(1, 9), 100 * k + a) for k in (8, 9) for a in rng.sample(range(12), 7)] + [(8, 20, 40, 820), (8, 25, 30, 825), (8, 26, 27, 826)]
    facts = [(n, k, at) for n, (k, at) in enumerate(itertools.product([*range(11), None], [*range(-1, 42), None]))]
    facts.append(facts[0])
    fact, dim = spark.createDataFrame(facts, "n int, k int, at int"), spark.createDataFrame(spans, "k int, valid_from int, valid_to int, sk int")

    def found(k, at):
        hit = [(a, sk) for x, a, b, sk in spans if None not in (x, at, b) and x == k and a <= at <= b]
        return max(hit)[1] if hit else -1

    out = warehouse.asof_lookup(fact, dim, {"k": "k"}, "at", "sk", "version", strict=True)
    assert sorted(tuple(r)[::3] for r in out.collect()) == sorted((n, found(k, at)) for n, k, at in facts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert nested or "Aggregate" not in plan


def test_each_text_is_rewritten_once(spark):
    """Many mappings share a text, some are there twice; no text goes along with the mappings of a table."""
    texts = ["T.a + u.b", "t.a", "u.b", "x.a", None, "t.a || 't.a'"]
    rows = [(i, texts[i % 6]) for i in range(600)] + [(0, texts[0]), (1, texts[2]), (None, "t.a"), (None, "t.a")]
    renames = spark.createDataFrame([("t", "a", "a2"), ("T", "A", "a2"), ("v", "b", "c"), (None, "a", "b"), ("u", "b", "b")], "table string, from_name string, to_name string")
    out = propagation.rewritten(spark.createDataFrame(rows, "mapping_id int, sql string"), renames)
    now = {0: "T.a2 + u.b", 1: "t.a2", 5: "t.a2 || 't.a'"}
    assert sorted(((r["mapping_id"], r["sql"]) for r in out.collect()), key=str) == sorted([(i, now[i % 6]) for i in range(600) if i % 6 in now] + [(None, "t.a2")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "collect_set" not in plan and "regexp" not in plan.lower()
