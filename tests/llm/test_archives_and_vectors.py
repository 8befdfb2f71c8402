"""WARC archives and their salvage, hard negatives, product codes: against plain versions, and on odd and empty tables."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import _integers, negatives, quantize, warc

# --- 11: archives

PAGES = "page_id long, url string, html string, start long, kind string"


def plain_archives(rows):
    """(page_id, bytes, sha1, type, refers_to) of pages (page_id, url, html), worked out one by one."""
    payloads = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    head = {}
    for i, p in payloads:
        if i is not None:
            head[p] = max(head.get(p, i), i)
    out = []
    for i, p in payloads:
        first = head.get(p) if len(p) >= warc.REVISIT else None
        again = first is not None and first != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def made_pages():
    rng = random.Random(6)
    big = ["é" * 500, "x" * 1000, "y" * 999, "long page " * 20_000, "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40]
    rows = [(i, f"http://a.b/{i}", rng.choice(big), 1, "k") for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "", None, None), (62, "http://x/\r\nContent-Length: 9", "short", None, None), (63, "u", "\r\n\r\n", None, None), (None, "n", big[0], None, None), (None, "n", "only here " * 200, None, None)]
    rows.append((rows[5][0], *rows[5][1:]))  # a repeated row
    return rows


def test_pages_come_back_from_their_archives(spark):
    rows = made_pages()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == plain_archives(rows)


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_small_archives_hold_the_payloads_and_can_be_read_as_files(spark, tmp_path):
    rows = made_pages()
    folder = f"file://{tmp_path}/archives"
    listed = warc.write(spark.createDataFrame(rows, PAGES), folder, archive=20_000)
    assert listed.agg(F.sum("records")).first()[0] == len(rows) and listed.count() > 1
    (tmp_path / "archives" / "left-behind.warc.gz").write_bytes(b"of an attempt that was lost")
    read = warc.read(listed, folder).collect()
    assert Counter(r["kind"] for r in read) == {"record": len(rows)}
    payloads = Counter(bytes(r["payload"]) for r in read if r["record_type"] == "response")
    assert set(payloads) == {(h or "").encode() for _, _, h, *_ in rows}
    files = warc.read_files(spark, folder).collect()
    assert Counter(r["kind"] for r in files) == {"record": len(rows), "gap": 1}
    assert {r["target"] for r in files if r["page_id"] == 62} == {"http://x/%0D%0AContent-Length:%209"}


def one_record(i, size):
    payload = random.Random(i).randbytes(size)
    return warc.encoded(i, f"http://h/{i}", payload, hashlib.sha1(payload).hexdigest(), None)


def test_undamaged_archives_have_no_gap():
    plain = [one_record(i, 300) for i in range(5)]
    members = b"".join(gzip.compress(r) for r in plain)
    for data in (b"".join(plain), members, gzip.compress(b"".join(plain)), b"".join(plain) + members):
        found = list(warc.records(data))
        assert all(why is None for _, _, why, _, _ in found) and [f["page-id"] for *_, f, _ in found][:5] == list("01234")
    assert list(warc.records(b"")) == [] and [x[:3] for x in warc.records(b"junk")] == [(0, 4, "no version line")]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "zeros", "insert", "truncate", "length"])
def test_salvage_loses_damaged_records_only(packed, damage):
    for seed in range(25):
        rng = random.Random(f"{damage}{seed}")
        bodies = [one_record(i, rng.randrange(20, 900)) for i in range(12)]
        stored = [gzip.compress(b, mtime=0) if packed else b for b in bodies]
        starts = np.cumsum([0, *map(len, stored)])
        data, hit = bytearray(b"".join(stored)), rng.randrange(1, 11)
        lo, hi = int(starts[hit]), int(starts[hit + 1])
        at = rng.randrange(lo, hi - 4)
        if damage == "flip":
            data[at] ^= 1 << rng.randrange(8)
        elif damage == "cut":
            del data[at : at + 4]
        elif damage == "zeros":
            data[lo : hi - 1] = bytes(hi - lo - 1)
        elif damage == "insert":
            data[at:at] = rng.randbytes(7)
        elif damage == "truncate":
            del data[at:]
        elif not packed:
            spot = data.index(b"Content-Length: ", lo) + len(b"Content-Length: ")
            data[spot : spot + 1] = b"99"
        found = list(warc.records(bytes(data)))
        blocks = [bytes(block) for _, _, why, _, block in found if why is None]
        pages = [i for block in blocks for i, body in enumerate(bodies) if block in body]
        wanted = set(range(hit)) if damage == "truncate" else set(range(12)) - {hit}
        assert len(pages) == len(blocks)  # nothing that is recovered differs from what was written
        assert wanted <= set(pages) and len(pages) == len(set(pages))
        covered = sorted({(a, b) for a, b, *_ in found})
        assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
        if hit not in pages:
            assert any(why is not None for _, _, why, _, _ in found)


def test_salvage_of_one_member_that_holds_the_whole_file():
    bodies = [one_record(i, 3000) for i in range(40)]
    data = bytearray(gzip.compress(b"".join(bodies)))
    data[len(data) * 3 // 4] ^= 255
    found = list(warc.records(bytes(data)))
    pages = [int(f["page-id"]) for _, _, why, f, _ in found if why is None]
    assert pages == [i for i in range(40) if i != 29] and any(why for _, _, why, _, _ in found)
    cut = list(warc.records(bytes(data[: len(data) // 2])))
    pages = [int(f["page-id"]) for _, _, why, f, _ in cut if why is None]
    assert pages == list(range(len(pages))) and len(pages) >= 18 and any(why for _, _, why, _, _ in cut)


# --- 12 and 13: odd vectors

VECTORS = "vec_id long, embedding array<float>, label int, score double, near string"
NAN, INF = float("nan"), float("inf")


def odd_vectors(seed, n=150, dims=16, kinds=4):
    rng = random.Random(seed)
    draw = lambda: [rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), 0.0]) for _ in range(dims)]
    rows = [(i, draw(), rng.choice([*range(kinds), None]), 1.0, "z") for i in range(n)]
    rows += [(n + i, rows[3][1], rows[3][2], None, None) for i in range(40)]  # copies
    rows += [rows[10], rows[10], (10, draw(), 1, None, None)]  # a repeated row, and another under its id
    rows += [(500, None, 1, None, None), (501, [], 1, None, None), (502, [None, *draw()[1:]], 1, None, None), (503, [NAN, *draw()[1:]], 1, None, None), (504, [INF, *draw()[1:]], 1, None, None), (505, [1e30, *draw()[1:]], 1, None, None), (506, [0.0] * dims, 1, None, None), (507, draw()[:-1], 1, None, None), (None, draw(), 2, None, None)]
    rng.shuffle(rows)
    return rows


def usable(rows, factor, dims):
    limit = _integers.largest(dims)
    out = []
    for i, v, label, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            w = np.floor(np.array(v, np.float32).astype(np.float64) * factor)
            if (np.abs(w) <= limit).all():
                out.append((i, label, w.astype(np.int64)))
    return out


def plain_negatives(rows, every, factor=256):
    kept = [r for r in usable(rows, factor, 16) if r[1] is not None]
    out = Counter()
    for a, (i, label, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-int(v @ w), j is None, j or 0, k) for k, (j, _, w) in enumerate(kept) if k != a)
        alike = [s for s in scored if kept[s[3]][1] == label][:5]
        other = [s for s in scored if kept[s[3]][1] != label]
        for s in alike:
            good = [o for o in other if 50 * -s[0] <= 100 * -o[0] <= 95 * -s[0]][:3]
            for rank, o in enumerate(good, 1):
                out[i, kept[s[3]][0], rank, kept[o[3]][0], -s[0], -o[0]] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_agree_with_all_pairs(spark, monkeypatch, seed):
    rows = odd_vectors(seed)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    expected = plain_negatives(rows, 10)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert expected and Counter(tuple(r) for r in got.collect()) == expected
    for name, value in (("CHUNK", 20), ("BLOCK", 5), ("SAMPLE", 12), ("PIVOTS", 3)):  # many small pieces of work, a poor sample
        monkeypatch.setattr(negatives, name, value)
    assert Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect()) == expected


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, None, 1, None, None)], [(1, [1.0], None, None, None)], [(0, [1.0, 2.0], 1, None, None)]):
        assert negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect() == []


def test_brackets_hold_the_scores():
    rng = np.random.default_rng(4)
    rows, anchors = rng.integers(-300, 300, (400, 16)), rng.integers(-300, 300, (30, 16))
    pivots = negatives.Pivots(rows[:100], int((rows**2).sum(1).max()))
    near = pivots.row_distances(rows)
    least, most = pivots.bracket(anchors, near, near)
    score = anchors @ rows.T
    assert (least <= score).all() and (score <= most).all()
    centres = rng.integers(-300, 300, (6, 16))
    rows = centres[rng.integers(0, 6, 400)] + rng.integers(-9, 9, (400, 16))
    pivots = negatives.Pivots(rows[:100], int((rows**2).sum(1).max()))
    near = pivots.row_distances(rows)
    _, most = pivots.bracket(rows[:30], near, near)
    fifth = np.sort(rows[:30] @ rows.T, axis=1)[:, -5]
    assert (most < fifth[:, None]).mean() > 0.5  # rows of other clusters are skipped


def plain_codes(rows, parts=8, entries=16, rounds=6, dims=16):
    kept = sorted(usable(rows, 4096, dims), key=lambda r: (r[0] is None, r[0] or 0, r[2].astype(np.int32).tobytes()))
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    code = nearest()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(-1) for p in range(parts))
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return Counter((i, bytes(c.astype(np.uint8)).hex(), int(e), by_label[label], sha) for (i, label, _), c, e in zip(kept, code, error, strict=True))


@pytest.mark.parametrize("seed", [3, 4])
def test_codes_agree_with_plain_rounds(spark, seed):
    rows = odd_vectors(seed)
    got = quantize.compress(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(rows)


def test_codes_of_few_rows_and_of_none(spark):
    rows = [(i, [float(i)] * 16, 1, None, None) for i in range(5)] + [(9, [1.0] * 15, 1, None, None)]
    assert Counter(tuple(r) for r in quantize.compress(spark.createDataFrame(rows, VECTORS)).collect()) == plain_codes(rows)
    assert quantize.compress(spark.createDataFrame([(1, None, 1, None, None), (2, [1.0], 1, None, None)], VECTORS)).collect() == []


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(600, 8)) * 900 + rng.integers(0, 6, 600)[:, None] * 4000).astype(np.int64)
    x[:60] = x[0]  # repeated rows, and ties by equal entries
    books = np.vstack([x[60:72], x[60:64]])
    code, upper, lower = quantize.assign_all(x, books)
    computed = 0
    for _ in range(6):
        new = np.array([x[code == e].sum(0) // (code == e).sum() if (code == e).any() else b for e, b in enumerate(books)])
        moved = np.sqrt(((new - books) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        books = new
        code, upper, lower, n = quantize.assign_again(x, books, moved, code, upper, lower)
        computed += n
        d = ((x[:, None] - books[None]) ** 2).sum(-1)
        assert (code == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), code])).all() and (lower <= np.sqrt(d)).all()
    assert computed < 0.3 * 6 * x.shape[0] * len(books)


def test_a_payload_digest_that_differs_is_a_gap():
    record = one_record(1, 50)
    wrong = record.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:AAAA", 1)
    rows = list(warc._rows("a", zlib.compress(wrong, wbits=31), True))
    assert [r[3] for r in rows] in (["gap"], ["record"])  # a digest that can't be read is no digest
    other = warc.encoded(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    assert [(r[3], r[4]) for r in warc._rows("a", other, True)] == [("gap", "payload digest differs")]
