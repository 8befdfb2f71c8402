"""Vectorised words and packed rows for operators that run numpy inside Spark tasks.

Spark deals the work; a task turns the texts of an Arrow batch into word hashes at once, and what it sends on is packed:
one binary row for a bucket instead of a row for a word, which keeps shuffles near the size of their information.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once.
CHUNK = 2_000_000
_BASE, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (base is odd)."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        ups, downs = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        ups[0] = downs[0] = 1
        have = (np.multiply.accumulate(ups), np.multiply.accumulate(downs))
        if size <= 1 << 21:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch cut to runs of rows with about CHUNK bytes of text; a longer text comes alone. Null texts become empty."""
    i = batch.schema.get_field_index(text)
    col = batch.column(i)
    if col.null_count:
        batch = batch.set_column(i, text, pc.fill_null(col, pa.scalar("", col.type)))
        col = batch.column(i)
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        so_far = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, so_far + CHUNK, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row starts (one more entry than rows)."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the number of the first word of each row (one more entry than rows)."""
    data, offsets = utf8(col)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), side="right")))
        lo, hi = starts[at], ends[upto - 1]
        ups, downs = _powers(_BASE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * ups[: hi - lo], out=sums[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        out[at:upto] = mix((sums[e] - sums[s]) * downs[s] + (e - s).astype(np.uint64))
        at = upto
    return out, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, by the word it starts with; empty for fewer than k words."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.empty(len(hashes) - k + 1, np.uint64)
    for at in range(0, len(out), 1 << 19):
        part = hashes[at : min(len(hashes), at + (1 << 19) + k - 1)]
        ups, downs = _powers(_ROLL, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * ups[: len(part)], out=sums[1:])
        n = len(part) - k + 1
        out[at : at + n] = mix((sums[k:] - sums[:n]) * downs[:n])
    return out


def pack(*arrays: np.ndarray) -> bytes:
    raw = np.array([a.nbytes for a in arrays], "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def halves(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of 32-bit numbers: small ones have high halves that pack to almost nothing."""
    return (numbers & np.uint32(0xFFFF)).astype(np.uint16), (numbers >> np.uint32(16)).astype(np.uint16)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def groups_for(docs: DataFrame, least: int, each: int = 16_000_000) -> int:
    """Groups of about `each` bytes of text that docs are dealt to, `least` at least: counted, not taken from a setting."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // each))


def packed_docs(docs: DataFrame, groups: int) -> DataFrame:
    """docs (doc_id, text) as rows (g, kind 1, payload): packs of whole documents, g by hash of doc_id.

    A payload is the Arrow stream of a few hundred kB of documents; doc_documents() opens it.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))  # rows without a doc_id are dealt by their text
    keyed = docs.select(F.pmod(F.xxhash64(place), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def pack_up(batches):
        waiting: dict[int, list] = {}
        sizes: dict[int, int] = {}
        total = 0

        def blob(g):
            sizes.pop(g)
            return g, packed_batch(pa.Table.from_batches(waiting.pop(g)).combine_chunks())

        for batch in batches:
            for part in pieces(batch):
                out, order = [], np.argsort(part.column("g").to_numpy(), kind="stable")
                part = part.take(pa.array(order))
                gs = part.column("g").to_numpy()
                cuts = np.flatnonzero(np.diff(gs, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(gs)], strict=True):
                    own = part.slice(lo, hi - lo).select(["doc_id", "text"])
                    size = own.nbytes
                    g = int(gs[lo])
                    waiting.setdefault(g, []).append(own)
                    sizes[g] = sizes.get(g, 0) + size
                    total += size
                    if sizes[g] > 400_000:
                        total -= sizes[g]
                        out.append(blob(g))
                if total > 24_000_000:
                    out += [blob(g) for g in list(waiting)]
                    total = 0
                if out:
                    yield _rows(out)
        if waiting:
            yield _rows([blob(g) for g in list(waiting)])

    return keyed.mapInArrow(pack_up, "g int, kind int, payload binary")


def _rows(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([g for g, _ in blobs], pa.int32()), pa.array([1] * len(blobs), pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names=["g", "kind", "payload"]
    )


def packed_batch(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def documents_in(payload: bytes) -> Iterator[pa.RecordBatch]:
    for batch in pa.ipc.open_stream(payload):
        yield from pieces(batch)


def groups_of(batches, key: str, kind: str = "kind", payload: str = "payload"):
    """Rows sorted by (key, kind) as (key, kind, payload), batch after batch."""
    for batch in batches:
        yield from zip(batch.column(key).to_pylist(), batch.column(kind).to_pylist(), batch.column(payload), strict=True)


class Members:
    """A sorted set of 64-bit keys with a bit table in front, so most misses cost one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, min(24, int(len(keys)).bit_length() + 4))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(keys)] = True

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `keys` that are members, and the members' numbers."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[maybe]
        return maybe[hit], at[hit]
