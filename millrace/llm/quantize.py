"""Product codes of vectors, their codebooks found by Lloyd's rounds with Elkan's bounds.

A vector of integers is cut into `parts` equal pieces; each part position has a codebook of `entries` integer entries. A
round assigns every piece to its nearest entry and moves each entry to the floor of its pieces' mean.

Every row keeps, for each part, its entry, an upper bound of its distance and a lower bound for each entry. When the entries
have moved, upper bounds grow by the movement of the own entry and lower bounds fall by that of theirs. An entry is skipped
if the upper bound is below its lower bound or below half its distance from the own entry, strictly, so that an entry as
near as the own one is never skipped; what is left is compared by exact integer distances, ties to the lower index. Bounds
are rounded outwards to 32 bits.

Each round is one pass over the rows as the round before wrote them to the shared folder, and then deletes what that one
wrote, so two rounds' rows stand there at most. A task adds a row with the sums of
its pieces by entry, and these are added up in Spark; the driver sees the codebooks only, parts * entries entries. A hot
label or repeated rows change nothing about a pass, which deals by files.

Defined cases: rows whose vector is null or empty or has null, non-finite or too large components (beyond 2^30 / sqrt(dims),
where a long holds no squared distance) are dropped. All vectors have the length of the row of smallest vec_id whose length
`parts` divides; others are dropped. Equal vec_ids are ordered by their vectors' bytes, null ids last. With fewer rows
than entries the codebooks are as small. label_error is null where a long can't hold it. Further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._integers import integer_vectors, matrix
from millrace.llm._spark import discarded, written

#: Distances that are computed at once in a task.
BLOCK = 1_000_000
_KEPT = "vec_id long, label {label}, vector binary, code binary, bounds binary, sums array<bigint>"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-1)), np.float32(0))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def assign_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each piece, with its upper bound and the lower bounds of all entries; nothing is known before."""
    d = np.stack([_square(x, e) for e in entries], 1)
    code = d.argmin(1)
    root = np.sqrt(d.astype(np.float64))
    return code, _up(root[np.arange(len(x)), code]), _down(root)


def assign_again(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries have moved, from the bounds of the round before; also how many distances were computed."""
    code, u = code.copy(), upper.astype(np.float64) + moved[code]
    low = _down(np.maximum(lower.astype(np.float64) - moved, 0))
    half = np.sqrt(_square(entries[:, None], entries[None]).astype(np.float64)) / 2 * (1 - 1e-12)
    np.fill_diagonal(half, np.inf)
    open_ = np.flatnonzero(u >= half.min(1)[code])
    near = lambda rows, u: (u[:, None] >= low[rows]) & (u[:, None] >= half[code[rows]])  # noqa: E731  half is infinite for the own entry
    open_ = open_[near(open_, u[open_]).any(1)]
    own = _square(x[open_], entries[code[open_]])
    u[open_] = np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
    rows, others = np.nonzero(near(open_, u[open_]))
    d = np.full((len(open_), len(entries)), np.iinfo(np.int64).max)
    d[np.arange(len(open_)), code[open_]] = own
    d[rows, others] = _square(x[open_[rows]], entries[others])
    low[open_[rows], others] = _down(np.sqrt(d[rows, others].astype(np.float64)))
    code[open_] = d.argmin(1)
    u[open_] = np.sqrt(d.min(1).astype(np.float64)) if len(open_) else u[open_]
    return code, _up(u), low, len(open_) + len(rows)


def _pass(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, label: str) -> DataFrame:
    """One assignment of all rows, with a row of sums from each task."""
    parts, k, sub = books.shape

    def work(batches):
        sums = np.zeros((parts, k, sub + 1), np.int64)
        for batch in batches:
            step = max(1, BLOCK // (k * sub))
            for part in (batch.slice(at, step) for at in range(0, len(batch), step)):
                x = matrix(part.column("vector"), parts * sub).reshape(-1, parts, sub)
                n = len(x)
                codes, bounds = np.empty((n, parts), np.uint8), np.empty((n, parts, k + 1), np.float32)
                if moved is not None:
                    known = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    held = np.frombuffer(b"".join(part.column("bounds").to_pylist()), np.float32).reshape(n, parts, k + 1)
                for p in range(parts):
                    if moved is None:
                        code, upper, lower = assign_all(x[:, p], books[p])
                    else:
                        code, upper, lower, _ = assign_again(x[:, p], books[p], moved[p], known[:, p].astype(np.int64), held[:, p, 0], held[:, p, 1:])
                    codes[:, p], bounds[:, p, 0], bounds[:, p, 1:] = code, upper, lower
                    np.add.at(sums[p, :, :sub], code, x[:, p])
                    sums[p, :, sub] += np.bincount(code, minlength=k)
                arrays = [part.column("vec_id"), part.column("label"), part.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([b.tobytes() for b in bounds], pa.binary()), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "vector", "code", "bounds", "sums"])
                kind = part.column("label").type
        if sums.any():
            nothing = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["vec_id", "label", "vector", "code", "bounds", "sums"])

    return rows.mapInArrow(work, _KEPT.format(label=label))


def _moved_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after a round: floors of means, from the sums that the tasks left."""
    parts, k, sub = books.shape
    total = [0] * (parts * k * (sub + 1))
    slots = rows.where("sums IS NOT NULL").select(F.posexplode("sums").alias("slot", "x"))
    for slot, x in slots.groupBy("slot").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect():  # as many rows as the codebooks have numbers
        total[slot] = int(x)
    out = books.copy()
    for p in range(parts):
        for e in range(k):
            *s, count = total[(p * k + e) * (sub + 1) : (p * k + e + 1) * (sub + 1)]
            if count:
                out[p, e] = [v // count for v in s]
    return out


def codebooks_and_codes(vectors: DataFrame, factor: float = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, **columns) -> tuple[np.ndarray | None, DataFrame | None]:
    """The codebooks (parts, entries, numbers), and (vec_id, label, code, error) of each usable row; None and None if no row is.

    columns: names of the columns vec_id, vector and label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index of an entry is one byte")
    usable = written(integer_vectors(vectors, factor, **columns).where(F.length("vector") % (4 * parts) == 0), "pq-vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    first = usable.orderBy(*order).select(F.length("vector")).first()
    if first is None:
        return None, None
    dims = first[0] // 4
    rows = usable.where(F.length("vector") == first[0])
    start = rows.orderBy(*order).limit(entries).collect()
    books = np.array([np.frombuffer(r["vector"], np.int32) for r in start], np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    label = rows.schema["label"].dataType.simpleString()
    moved = last = None
    for _ in range(rounds):
        state = written(_pass(rows, books, moved, label), "pq-round")
        if last is not None:
            discarded(last)  # this round's rows are written, so that nothing goes back to the round before
        last = state
        new = _moved_books(state, books)
        moved = np.sqrt(_square(new, books).astype(np.float64)) * (1 + 1e-12)
        books, rows = new, state.where("vector IS NOT NULL")
    parts_, _, sub = books.shape

    def finish(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), parts_ * sub).reshape(-1, parts_, sub)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts_)
            error = sum((_square(x[:, p], books[p][code[:, p]]) for p in range(parts_)), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array(error)], names=["vec_id", "label", "code", "error"])

    final = _pass(rows, books, moved, label).where("vector IS NOT NULL")
    codes = written(final.mapInArrow(finish, f"vec_id long, label {label}, code binary, error long"), "pq-codes")
    if last is not None:
        discarded(last)
    return books, codes


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of all entries, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, **params) -> DataFrame:
    """One row for each usable row of vectors: vec_id, code (hex), error, label_error, codebooks_sha256."""
    books, coded = codebooks_and_codes(vectors, **params)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    by_label = written(coded.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error")), "pq-labels")
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
