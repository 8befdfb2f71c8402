"""Hard negatives of anchors, found through a table of distances to pivots.

Vectors are integers, the score of a row is its inner product with the anchor. A row v is augmented by sqrt(M^2 - |v|^2), M
the largest norm, and an anchor q by 0; then the squared distance of the two is |q|^2 + M^2 - 2 score, so large scores are
small distances. Every row stores its distances to a few pivots, which are rows themselves. By the triangle inequality the
distances of anchor and row to a pivot bracket their own distance, hence the score; rows whose bracket misses what is
looked for are skipped, and the others' scores are computed exactly in integers.

Rows are kept in cells (nearest pivot, ring of distance) of which the table holds the range of each pivot distance, so an
anchor only goes to cells whose bracket meets its range. Cells are dealt to chunks and anchors to blocks, and a task
compares a block with a chunk; from each only the first few rows go on. The pivots, the rings and the first floor of an
anchor's scores come from a sample of SAMPLE rows (those of least hash): they only decide how much is skipped, never the
result.

The first search takes an anchor's positives: its first rows of the same label by score, ties by vec_id. The second takes,
for each positive, the first rows of other labels whose score lies between `low` and `high` per cent of the positive's.

Defined cases: rows with a null label, a null or empty vector, or null, non-finite or too large components (beyond
2^30 / sqrt(dims)) take no part, nor do rows whose vector is not as long as that of the smallest vec_id (null ids last).
Rows equal in vec_id, label and vector are one unit with a count: as positives and negatives they count as often as they
occur, and as anchors their results are repeated. Rows of one vec_id that differ are different rows, ties by a hash. Rows
with a null vec_id are no anchors. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._integers import integer_vectors, matrix
from millrace.llm._spark import written

PIVOTS, RINGS, SAMPLE = 8, 4, 2048
#: Rows of a chunk, anchors of a block, and anchors compared at once.
CHUNK, BLOCK, STRIP = 16_384, 4_096, 64
_FOUND = "anchor_id long, anchor_key long, anchor_mult long, slot int, vec_id long, key long, mult long, score long"


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if len(a) and len(b) and a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Pivots:
    """The pivots, and what follows from them: distances of rows and anchors, and brackets of scores."""

    def __init__(self, sample: np.ndarray, top: int):
        self.top, norms = float(top), (sample**2).sum(1)
        lift = np.sqrt(np.maximum(0.0, self.top - norms))
        far, chosen = np.full(len(sample), np.inf), []
        at = int(norms.argmax())
        while len(chosen) < min(PIVOTS, len(sample)):  # each next pivot is the sampled row farthest from those before
            chosen.append(at)
            far = np.minimum(far, 2 * self.top - 2 * (_dot(sample, sample[[at]])[:, 0] + lift * lift[at]))
            at = int(far.argmax())
        self.rows, self.lift = sample[chosen], lift[chosen]
        nearest = self.row_distances(sample).min(1)
        self.limits = np.quantile(nearest, np.arange(1, RINGS) / RINGS)

    def row_distances(self, rows: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0.0, self.top - (rows**2).sum(1)))
        return np.sqrt(np.maximum(0.0, 2 * self.top - 2 * (_dot(rows, self.rows) + lift[:, None] * self.lift))).astype(np.float32)

    def anchor_distances(self, anchors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (anchors**2).sum(1)[:, None] + self.top - 2.0 * _dot(anchors, self.rows)))

    def cells(self, distances: np.ndarray) -> np.ndarray:
        near = distances.argmin(1)
        return near * RINGS + np.searchsorted(self.limits, distances[np.arange(len(near)), near])

    def bracket(self, anchors: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor with rows whose pivot distances lie between lowest and highest."""
        own = self.anchor_distances(anchors)
        near, far = np.zeros((len(anchors), len(lowest))), np.full((len(anchors), len(lowest)), np.inf)
        for p in range(own.shape[1]):
            q, lo, hi = own[:, p, None], lowest[None, :, p].astype(np.float64), highest[None, :, p].astype(np.float64)
            room = 1e-6 * (q + hi) + 1e-3  # distances are rounded to 32 bits
            np.maximum(near, np.maximum(q - hi, lo - q) - room, out=near)
            np.minimum(far, q + hi + room, out=far)
        both = (anchors**2).sum(1)[:, None] + self.top
        return (both - far**2) / 2 - 1, (both - near**2) / 2 + 1


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _placed(units: DataFrame, dims: int, pivots: Pivots) -> DataFrame:
    """Units with their pivot distances and their cell."""

    def work(batches):
        for batch in batches:
            near = pivots.row_distances(matrix(batch.column("vector"), dims))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(pivots.cells(near).astype(np.int32))], names=[*batch.schema.names, "near", "cell"])

    return units.mapInArrow(work, "vec_id long, lab long, vector binary, mult long, key long, near array<float>, cell int")


def _routed(asked: DataFrame, dims: int, pivots: Pivots, cells: dict, sample: dict, same: bool, m: int) -> DataFrame:
    """Each request once for every cell that it must look into; floors are raised to what the sample already reaches."""
    numbers = np.array(sorted(cells))
    lowest, highest = (np.array([cells[c][k] for c in numbers], np.float32) for k in (0, 1))

    def work(batches):
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, len(batch), 512)):
                q = matrix(part.column("vector"), dims)
                lab, key = _numbers(part.column("lab")), _numbers(part.column("key"))
                lows, highs = (np.array(part.column(c).to_pylist(), np.int64).reshape(len(q), -1) for c in ("lows", "highs"))
                score = _dot(q, sample["vector"])
                fits = ((lab[:, None] == sample["lab"]) == same) & (key[:, None] != sample["key"])
                for k in range(lows.shape[1]):
                    own = np.where(fits & (score >= lows[:, k, None]) & (score <= highs[:, k, None]), score, np.iinfo(np.int64).min)
                    if own.shape[1] >= m:
                        lows[:, k] = np.maximum(lows[:, k], np.partition(own, -m, axis=1)[:, -m])
                least, most = pivots.bracket(q, lowest, highest)
                dead = lows > highs
                floor, roof = np.where(dead, np.iinfo(np.int64).max, lows).min(1), np.where(dead, np.iinfo(np.int64).min, highs).max(1)
                row, cell = np.nonzero((most >= floor[:, None]) & (least <= roof[:, None]) & ~dead.all(1)[:, None])
                take = pa.array(row)
                arrays = [part.column(c).take(take) for c in ("vec_id", "lab", "vector", "mult", "key", "highs")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(lows), pa.list_(pa.int64())).take(take), pa.array(numbers[cell].astype(np.int32))], names=["vec_id", "lab", "vector", "mult", "key", "highs", "lows", "cell"])

    return asked.mapInArrow(work, "vec_id long, lab long, vector binary, mult long, key long, highs array<bigint>, lows array<bigint>, cell int")


def _compared(rows: pa.Table, asked: pa.Table, dims: int, pivots: Pivots, same: bool, m: int) -> pa.Table:
    """The first m rows of a chunk for each range of each request of a block."""
    out: list[list] = [[] for _ in range(8)]
    if rows.num_rows and asked.num_rows:
        rows = rows.sort_by([("vec_id", "ascending"), ("key", "ascending")])  # nulls last
        v = matrix(rows.column("vector").combine_chunks(), dims)
        near = np.array(rows.column("near").combine_chunks().flatten(), np.float32).reshape(len(v), -1)
        lab, key, mult = (_numbers(rows.column(c)) for c in ("lab", "key", "mult"))
        ids = rows.column("vec_id").to_pylist()
        names = asked.select(["vec_id", "key", "mult"]).to_pylist()
        q, qlab = matrix(asked.column("vector").combine_chunks(), dims), _numbers(asked.column("lab"))
        qkey = _numbers(asked.column("key"))
        lows, highs = (np.array(asked.column(c).to_pylist(), np.int64).reshape(len(q), -1) for c in ("lows", "highs"))
        for at in range(0, len(q), STRIP):
            strip = slice(at, at + STRIP)
            open_ = lows[strip] <= highs[strip]
            floor, roof = np.where(open_, lows[strip], np.iinfo(np.int64).max).min(1), np.where(open_, highs[strip], np.iinfo(np.int64).min).max(1)
            least, most = pivots.bracket(q[strip], near, near)
            maybe = (most >= floor[:, None]) & (least <= roof[:, None]) & ((qlab[strip, None] == lab) == same)
            columns = np.flatnonzero(maybe.any(0))
            score = _dot(q[strip], v[columns])
            hit = maybe[:, columns] & (score >= floor[:, None]) & (score <= roof[:, None])
            for i in range(len(score)):
                found = np.flatnonzero(hit[i])
                own = columns[found]
                not_self = (key[own] != qkey[at + i]) | (mult[own] > 1)
                found, own = found[not_self], own[not_self]
                order = np.argsort(-score[i, found], kind="stable")  # rows stand in order of vec_id
                s, own = score[i, found[order]], own[order]
                for slot in range(lows.shape[1]):
                    first = int(np.searchsorted(-s, -highs[at + i, slot]))
                    for r, x in zip(own[first : first + m], s[first : first + m], strict=True):
                        if x >= lows[at + i, slot]:
                            me = names[at + i]
                            for column, value in zip(out, (me["vec_id"], me["key"], me["mult"], slot, ids[r], int(key[r]), int(mult[r]) - int(key[r] == me["key"]), int(x)), strict=True):
                                column.append(value)
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4
    return pa.table({name.split()[0]: pa.array(c, kind) for name, c, kind in zip(_FOUND.split(", "), out, kinds, strict=True)})


def mine(vectors: DataFrame, anchors: Column, factor: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **columns) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors`, a condition on vec_id, picks.

    columns: names of the columns vec_id, vector and label.
    """
    spark = vectors.sparkSession
    nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = written(integer_vectors(vectors, factor, **columns).where("label IS NOT NULL"), "hn-vectors")
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.length("vector")).first()
    if first is None:
        return spark.createDataFrame([], nothing)
    dims = first[0] // 4
    same_row = usable.where(F.length("vector") == first[0]).groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("mult"))
    units = written(same_row.select("vec_id", F.xxhash64("label").alias("lab"), "vector", "mult", F.xxhash64("vec_id", "label", "vector").alias("key")), "hn-units")

    def norms(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([int((matrix(batch.column("vector"), dims) ** 2).sum(1).max())])], names=["top"])

    top = units.select("vector").mapInArrow(norms, "top long").agg(F.max("top")).first()[0]
    drawn = units.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector", "lab", "key").toArrow()
    sample = {"vector": matrix(drawn.column("vector").combine_chunks(), dims), "lab": _numbers(drawn.column("lab")), "key": _numbers(drawn.column("key"))}
    pivots = Pivots(sample["vector"], top)
    rows = written(_placed(units, dims, pivots), "hn-rows")
    reach = [f(F.col("near")[p]) for f in (F.min, F.max) for p in range(len(pivots.rows))]
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"x{i}") for i, c in enumerate(reach)]).collect()  # PIVOTS * RINGS rows at most
    cells = {r["cell"]: (list(r[2 : 2 + len(pivots.rows)]), list(r[2 + len(pivots.rows) :])) for r in stats}
    chunks = F.create_map(*[F.lit(x) for r in stats for x in (r["cell"], -(-r["n"] // CHUNK))])
    asking = written(rows.where(anchors).select("vec_id", "lab", "vector", "mult", "key"), "hn-anchors")
    blocks = max(1, -(-asking.count() // BLOCK))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks[F.col("cell")])).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: DataFrame, same: bool, m: int, name: str) -> DataFrame:
        """(anchor_id, anchor_key, anchor_mult, slot, vec_id, score, nth) of the first m rows for each range of each request."""
        sent = _routed(asked, dims, pivots, cells, sample, same, m)
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks[F.col("cell")].cast("long") - 1))).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        met = dealt.groupBy("cell", "chunk", "block").cogroup(sent.groupBy("cell", "chunk", "block"))
        found = met.applyInArrow(lambda left, right: _compared(left, right, dims, pivots, same, m), _FOUND)
        each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("mult", F.lit(m)))))
        order = Window.partitionBy("anchor_key", "anchor_id", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key", "copy")
        each = each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= m)
        return written(each.select("anchor_id", "anchor_key", "anchor_mult", "slot", "vec_id", "score", "nth"), name)

    long = lambda x: F.array(F.lit(x).cast("long"))
    near = search(asking.withColumn("lows", long(-(2**62))).withColumn("highs", long(2**62)), True, positives, "hn-positives")
    listed = near.groupBy(F.col("anchor_key").alias("k"), F.col("anchor_id").alias("a")).agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("p"))
    bands = listed.select(
        "k", "a", F.transform("p", lambda x: F.ceil(F.lit(low).cast("decimal(20,0)") * x["score"] / 100).cast("long")).alias("lows"),
        F.transform("p", lambda x: F.floor(F.lit(high).cast("decimal(20,0)") * x["score"] / 100).cast("long")).alias("highs"),
    )
    ranges = asking.join(bands, (F.col("key") == F.col("k")) & (F.col("vec_id") == F.col("a"))).select(*asking.columns, "lows", "highs")
    width = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.lit(0))
    pad = lambda c, x: F.slice(F.concat(c, F.transform(width, lambda i: F.lit(x).cast("long"))), 1, positives).alias(c)  # noqa: E731  equal lengths; the empty range fits nothing
    hard = search(ranges.select(*asking.columns, pad("lows", 1), pad("highs", 0)), False, negatives, "hn-negatives")
    pairs = near.select(F.col("anchor_key").alias("k"), F.col("anchor_id").alias("a"), F.col("nth").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = hard.join(pairs, (F.col("anchor_key") == F.col("k")) & (F.col("anchor_id") == F.col("a")) & (F.col("slot") + 1 == F.col("p")))
    met = met.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("anchor_mult"))))
    return met.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
