"""Near-duplicate vectors by E8 lattice hashing.

Each of TABLES random projections takes a unit vector to eight dimensions, where it is decoded to its nearest point of the
E8 lattice: its cell. A vector is stored in its own cell of each table and looks into the PROBES nearest neighbouring cells
(the lattice points one minimal vector away). All pairs that meet in a cell, at least one of them at home there, are compared
by cosine in double precision, in blocks of a matrix product; links are counted, not listed.

The lattice is scaled by the number of distinct vectors, so that a cell holds about CELL of them if they are spread evenly,
but never finer than the threshold allows (REACH): the chance that a linked pair meets does not fall as the table grows;
cells of a large table hold more vectors instead.
Equal vectors are one vector with a multiplicity. A pair that shares several cells is counted in the first table in which
the two are at home together (each row carries its home cells of all tables); pairs that only meet by probing are listed
once. A cell of more than SPLIT vectors is dealt to chunks, and each pair of chunks is a piece of work of its own.

Defined cases: a null or zero vector, and one with null or non-finite components, links with nothing; vectors of different
length do not link; rows with one vec_id are separate vectors of that name; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._packed import mix
from millrace.llm._spark import prepare, width, written
from millrace.llm.components import components

THRESHOLD, TABLES, PROBES, CELL, SPLIT = 0.95, 6, 3, 24, 4096
#: Least scale of the lattice in units of sqrt(1 - threshold).
REACH = 5.6


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in zip(out, pairs, strict=True):
        row[i], row[j] = s, t
    halves = np.array([h for h in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0])
    return np.vstack([out, halves])


ROOTS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    worst, rows = np.abs(off).argmax(1), np.arange(len(x))
    other = near.copy()
    other[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return np.where((near.sum(1) % 2 != 0)[:, None], other, near)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row: of D8 and D8 shifted by one half the nearer one."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell_keys(points: np.ndarray, table: int, dims: int) -> np.ndarray:
    key = np.full(len(points), table * 1_000_003 + dims, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).view(np.uint64).T:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + column)
    return key


def cells(unit: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (rows x TABLES) and probed cells (rows x TABLES x PROBES) of unit vectors."""
    n, dims = unit.shape
    home, probed = np.empty((n, TABLES), np.uint64), np.empty((n, TABLES, PROBES), np.uint64)
    for t in range(TABLES):
        plane = np.random.default_rng(10_007 * (t + 1) + dims).normal(size=(dims, 8))
        if dims >= 8:
            plane = np.linalg.qr(plane)[0] * np.sqrt(dims)
        y = unit @ plane / scale
        point = decode(y)
        home[:, t] = _cell_keys(point, t, dims)
        near = np.argsort(-((y - point) @ ROOTS.T), axis=1, kind="stable")[:, :PROBES]
        for k in range(PROBES):
            probed[:, t, k] = _cell_keys(point + ROOTS[near[:, k]], t, dims)
    return home, probed


def cell_scale(n: int, threshold: float = THRESHOLD) -> float:
    """Scale of the lattice for n distinct vectors; two random unit vectors share a cell with a chance of scale^8 / (4 pi)^4."""
    even = (24_936.0 * CELL / max(1, n)) ** 0.125
    return min(4.0, max(0.4, REACH * max(0.0, 1 - threshold) ** 0.5, even))


def _packed(v: np.ndarray) -> bytes:
    """Components in four bytes each where nothing is lost, else in eight; the first byte says which."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return b"\4" + short.tobytes() if (short == v).all() else b"\10" + v.tobytes()


def _units(packed: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as unit vectors in double precision, one a row."""
    raw = np.vstack([np.frombuffer(p, np.float32 if p[0] == 4 else np.float64, offset=1) for p in packed]).astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _checked(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, key): the components as doubles and a hash of them, both null where the vector is unusable."""

    def look(batches):
        for batch in batches:
            out, keys = [], []
            for v in batch.column("embedding").to_pylist():
                v = None if v is None or any(x is None for x in v) else np.array(v, np.float64) + 0.0
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    out.append(None)
                    keys.append(None)
                else:
                    v = np.where(v == 0, 0.0, v)
                    out.append(_packed(v))
                    keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "vector", "key"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(look, "vec_id long, vector binary, key binary")


def _meetings(originals: DataFrame, scale: float) -> DataFrame:
    """(cell, home, node, mult, homes, vector): each original in its own and its neighbouring cells of every table.

    The vectors go along: in 8 of a vector's dimensions a cell at the threshold's scale holds so many others that pairs of ids
    for a later look-up would be larger than the vectors.
    """

    def place(batches):
        for batch in batches:
            data = batch.column("vector").to_pylist()
            sizes = np.array([(len(v) - 1) // v[0] for v in data])
            for dims in np.unique(sizes):
                pick = np.flatnonzero(sizes == dims)
                unit = _units([data[i] for i in pick])
                home, probed = cells(unit, scale)
                homes = [h.tobytes() for h in home]
                per = TABLES * (1 + PROBES)
                cell = np.concatenate([home[:, :, None], probed], axis=2).reshape(len(pick), per)
                rows = np.repeat(pick, per)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.ravel().view(np.int64)), pa.array(np.tile(np.arange(per) % (1 + PROBES) == 0, len(pick))), batch.column("node").take(pa.array(rows)),
                        batch.column("mult").take(pa.array(rows)), pa.array(homes, pa.binary()).take(pa.array(np.repeat(np.arange(len(pick)), per))),
                        batch.column("vector").take(pa.array(rows)),
                    ],
                    names=["cell", "home", "node", "mult", "homes", "vector"],
                )

    return originals.select("node", "mult", "vector").mapInArrow(place, "cell long, home boolean, node long, mult long, homes binary, vector binary")


def _compare(rows: dict, threshold: float, crossing: bool) -> tuple[list, list]:
    """Counts (node, links, smallest reachable) and listed pairs (a, ma, b, mb) of the vectors that meet in one cell.

    crossing: rows of two chunks, and only pairs across them count.
    """
    node, mult, home, homes, unit, side = (rows[k] for k in ("node", "mult", "home", "homes", "unit", "side"))
    n = len(node)
    label, count, listed, linked = np.arange(n), np.zeros(n, np.int64), [], []
    for lo in range(0, n, 512):
        part = slice(lo, lo + 512)
        hit = (unit[part] @ unit.T >= threshold) & (home[part, None] | home[None, :])
        if crossing:
            hit &= side[part, None] != side[None, :]
        hit[np.arange(len(node[part])), np.arange(lo, lo + len(node[part]))] = False
        x, y = np.nonzero(hit)
        if not len(x):
            continue
        x = x + lo
        same = homes[x] == homes[y]
        together = home[x] & home[y]
        first = same.argmax(1)  # the first table in which both are at home
        counted = together & (first == rows["table"])
        np.add.at(count, x[counted], mult[y[counted]])
        alone = ~same.any(1) & (node[x] < node[y])
        listed += zip(node[x[alone]].tolist(), mult[x[alone]].tolist(), node[y[alone]].tolist(), mult[y[alone]].tolist(), strict=True)
        linked.append((x[together], y[together]))
    if linked:
        x, y = np.concatenate([a for a, _ in linked]), np.concatenate([b for _, b in linked])
        rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
        label = rank.copy()
        while len(x):
            low = label.copy()
            np.minimum.at(low, x, label[y])
            low = np.minimum(low, low[np.argsort(rank, kind="stable")][low])
            if (low == label).all():
                break
            label = low
        by_rank = np.sort(node)
        touched = np.unique(x)
        return [(int(node[i]), int(count[i]), int(by_rank[label[i]])) for i in touched], listed
    return [], listed


def _linked(meetings: DataFrame, threshold: float, pieces: int) -> DataFrame:
    """(a, b, n, ma, mb): n >= 0 counts links of a and names b as reachable; n = -1 lists the pair."""

    def work(key, table):
        table = table.sort_by([("cell", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        cell, i, j = (table.column(c).to_numpy() for c in ("cell", "i", "j"))
        node, mult, home, side = (table.column(c).to_numpy() for c in ("node", "mult", "home", "side"))
        homes = np.frombuffer(b"".join(table.column("homes").to_pylist()), np.uint64).reshape(len(node), TABLES)
        vectors = table.column("vector").to_pylist()
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(new)
        counts, listed = [], []
        for lo, hi in zip(starts, [*starts[1:], len(cell)], strict=True):
            if hi - lo < 2 or not home[lo:hi].any():
                continue
            at = slice(lo, hi)
            table_of = int(np.flatnonzero(homes[lo:hi][home[lo:hi]][0].view(np.int64) == cell[lo])[0])
            rows = {"node": node[at], "mult": mult[at], "home": home[at], "homes": homes[at], "unit": _units(vectors[lo:hi]), "side": side[at], "table": table_of}
            c, p = _compare(rows, threshold, bool(i[lo] != j[lo]))
            counts += c
            listed += p
        a = [c[0] for c in counts] + [p[0] for p in listed]
        b = [c[2] for c in counts] + [p[2] for p in listed]
        n = [c[1] for c in counts] + [-1] * len(listed)
        ma, mb = [0] * len(counts) + [p[1] for p in listed], [0] * len(counts) + [p[3] for p in listed]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in (("a", a), ("b", b), ("n", n), ("ma", ma), ("mb", mb))})

    piece = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(pieces)).cast("int")
    return meetings.withColumn("piece", piece).groupBy("piece").applyInArrow(work, "a long, b long, n long, ma long, mb long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id."""
    prepare(vectors.sparkSession)
    checked = written(_checked(vectors), "vec-checked")
    grouped = checked.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult"), F.first("vector").alias("vector"))
    originals = written(grouped, "vec-originals")
    n = originals.count()
    placed = _meetings(originals, cell_scale(n, threshold))
    crowded = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("held")).where("rows > 1 AND held")
    crowded = written(crowded.select(F.col("cell").alias("cc"), F.ceil(F.col("rows") / F.lit(SPLIT)).cast("int").alias("chunks")), "vec-cells")
    shared = placed.join(crowded, F.col("cell") == F.col("cc")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cell", "home", "node", "mult", "homes", "vector", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    found = written(_linked(dealt, threshold, 4 * width(vectors.sparkSession)), "vec-links")
    pairs = found.where("n < 0").select("a", "b", "ma", "mb").distinct()
    parts = found.where("n >= 0").select(F.col("a").alias("node"), "n")
    parts = parts.unionByName(pairs.select(F.col("a").alias("node"), F.col("mb").alias("n"))).unionByName(pairs.select(F.col("b").alias("node"), F.col("ma").alias("n")))
    links = parts.groupBy(F.col("node").alias("ln")).agg(F.sum("n").alias("links"))
    labels = components(found.select("a", "b")).select(F.col("node").alias("cn"), "label")
    facts = originals.select("key", "node", "mult").join(links, F.col("node") == F.col("ln"), "left").join(labels, F.col("node") == F.col("cn"), "left")
    facts = facts.select(F.col("key").alias("fk"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    out = checked.select("vec_id", "key").join(facts, F.col("key") == F.col("fk"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
