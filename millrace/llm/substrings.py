"""Exact substring deduplication by fixed-block anchors.

A window is WINDOW = 50 consecutive words. Every run of 50 words covers at least one whole block of BLOCK = 25 words of a
fixed grid, so the non-overlapping blocks of every document are indexed as reference blocks, and every rolling 25-word
window of every document probes them. A probe that meets a reference block of another document is an anchor. Around the
anchors, and only there, the repeat is extended word by word to its full length: the 50-word windows that cover an anchor
are compared exactly across documents, and those that also start in a document with a smaller doc_id are removed. Their
union is the maximal repeat.

As jobs: (1) each task sends its probes, packed by hash bucket, each hash once for a group of documents; (2) a bucket finds the anchors and
answers each group of documents with the anchor hashes it has; (3) the groups' tasks meet their texts again, extend, and
ask for the smallest document of each window, one question for a window and group; (4) buckets answer; (5) the tasks
remove. A passage in a third of all documents costs a question for each group, not one for each pair of documents.
Windows are told apart by two independent 64-bit hashes taken together where it decides on removal.

Defined cases: a null text has no words; documents of fewer than 50 words keep all; rows with one doc_id do not remove
each other's words; a null doc_id neither lends nor loses words; an empty table gives an empty result; further columns
are ignored. A text of any length is handled; one document is the unit of memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _packed as P
from millrace.llm._spark import prepare, width

WINDOW, BLOCK = 50, 25
#: Rolling windows a task gathers before it sends them on.
GATHER = 2_000_000
_LOW = np.uint64(0xFFFFFFFF)
_SALT = np.uint64(0xA0761D6478BD642F)


def _key(h: np.ndarray, buckets: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash and the 32 bits that are sent within the bucket."""
    return (h % buckets).astype(np.uint32), ((h // buckets) & _LOW).astype(np.uint32)


def _split(order_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys in a sorted array."""
    if not len(order_keys):
        return []
    cuts = np.flatnonzero(np.diff(order_keys)) + 1
    lo = [0, *cuts.tolist()]
    return [(int(order_keys[a]), a, b) for a, b in zip(lo, [*lo[1:], len(order_keys)], strict=True)]


def _probes(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """(bucket, payload): per task and bucket the probes of many documents, one for each hash and group of documents.

    Two bits say whether one of them is a reference block, and whether several documents of the task have the hash.
    """
    nb = np.uint64(buckets)

    def send(batches):
        gathered, table, n = [], [], 0

        def flush():
            h = np.concatenate([x[0] for x in gathered])
            doc = np.concatenate([x[1] for x in gathered])
            aligned = np.concatenate([x[2] for x in gathered])
            g = np.array(table, np.uint32)[doc]
            bucket, rest = _key(h, nb)
            key = (bucket.astype(np.uint64) << np.uint64(32)) | rest
            order = np.argsort(key, kind="stable")
            key, doc, aligned, g = key[order], doc[order], aligned[order], g[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(key)))
            several = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), sizes)
            aligned = np.repeat(np.logical_or.reduceat(aligned, starts), sizes)
            again = np.flatnonzero(np.repeat(sizes > 1, sizes))  # only these can hold a hash and group twice
            again = again[np.lexsort((g[again], key[again]))]
            twice = again[1:][(key[again[1:]] == key[again[:-1]]) & (g[again[1:]] == g[again[:-1]])]
            keep = np.ones(len(key), bool)
            keep[twice] = False
            key, g, several, aligned = key[keep], g[keep], several[keep], aligned[keep]
            rest, runs = (key & _LOW).astype(np.uint32), _split((key >> np.uint64(32)).astype(np.int64))
            # hashes are sorted, so their steps are small
            blobs = [P.pack(*P.halves(np.diff(rest[a:b], prepend=np.uint32(0))), *P.halves(g[a:b]), np.packbits(aligned[a:b]), np.packbits(several[a:b])) for _, a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

        for batch in batches:
            for part in P.pieces(batch):
                hashes, first = P.words(part.column("text"))
                gs = part.column("g").to_pylist()
                for i, g in enumerate(gs):
                    own = hashes[first[i] : first[i + 1]]
                    if len(own) < WINDOW:
                        continue
                    h = P.windows(own, BLOCK)
                    gathered.append((h, np.full(len(h), len(table), np.uint16), np.arange(len(h)) % BLOCK == 0))
                    table.append(g)
                    n += len(h)
                    if n > GATHER or len(table) == 65_535:
                        yield flush()
                        gathered, table, n = [], [], 0
        if gathered:
            yield flush()

    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), "text")
    return keyed.mapInArrow(send, "bucket int, payload binary")


def _anchors(probes: DataFrame, buckets: int) -> DataFrame:
    """(g, kind 0, payload): for each group of documents the hashes it shares with another document's reference block."""

    def meet(key, table):
        bucket, rests, groups_of, aligned, several = key[0].as_py(), [], [], [], []
        for blob in table.column("payload").to_pylist():
            low, high, g_low, g_high, bits, more = P.unpack(blob, *[np.uint16] * 4, np.uint8, np.uint8)
            rest = np.cumsum(P.whole(low, high), dtype=np.uint32)
            rests.append(rest)
            groups_of.append(P.whole(g_low, g_high))
            aligned.append(np.unpackbits(bits, count=len(rest)).astype(bool))
            several.append(np.unpackbits(more, count=len(rest)).astype(bool))
        rest, g, aligned, several = np.concatenate(rests), np.concatenate(groups_of), np.concatenate(aligned), np.concatenate(several)
        order = np.argsort(rest, kind="stable")
        rest = rest[order]
        same = np.zeros(len(rest), bool)
        same[1:] = rest[1:] == rest[:-1]
        several, aligned, g = several[order], aligned[order], g[order]
        many = same | several
        many[:-1] |= same[1:]  # members of runs longer than one, or of one that stands for several documents
        rest, g, aligned = rest[many], g[many], aligned[many]
        out_g, out_blob = [], []
        if len(rest):
            starts = np.flatnonzero(np.diff(rest, prepend=rest[0] ^ np.uint32(1)))
            sizes = np.diff([*starts, len(rest)])
            keep = np.repeat(np.logical_or.reduceat(aligned, starts), sizes)
            pairs = np.unique((g[keep].astype(np.uint64) << np.uint64(32)) | rest[keep])
            gs, rs = (pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32)
            for group, a, b in _split(gs):
                out_g.append(group)
                out_blob.append(P.pack(np.array([bucket], np.uint32), rs[a:b]))
        n = len(out_g)
        return pa.table({"g": pa.array(out_g, pa.int32()), "kind": pa.array([0] * n, pa.int32()), "payload": pa.array(out_blob, pa.binary())})

    return probes.groupBy("bucket").applyInArrow(meet, "g int, kind int, payload binary")


def _window_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each 50-word window."""
    return P.windows(own, WINDOW), P.windows(P.mix(own ^ _SALT), WINDOW)


def _questions(docs: DataFrame, anchors: DataFrame, groups: int, buckets: int) -> DataFrame:
    """(bucket, g, payload): windows around anchors, with the smallest and largest doc_id of the group that has each."""
    nb = np.uint64(buckets)

    def extend(batches):
        current, found, members, asked, n = None, [], None, [], 0

        def flush():
            h1, h2, doc = (np.concatenate([x[k] for x in asked]) for k in range(3))
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            lo, hi = doc[starts], doc[np.append(starts[1:], len(doc)) - 1]
            h1, h2 = h1[starts], h2[starts]
            bucket = (h1 % nb).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            runs = _split(bucket[order])
            blobs = []
            for _, a, b in runs:
                o = order[a:b]
                blobs.append(P.pack(h1[o], (h2[o] & _LOW).astype(np.uint32), lo[o], (hi[o] - lo[o])))
            k = len(runs)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([current] * k, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "payload"])

        for g, kind, payload in P.groups_of(batches, "g"):
            if g != current:
                if asked:
                    yield flush()
                current, found, members, asked, n = g, [], None, [], 0
            if kind == 0:
                bucket, rest = P.unpack(payload.as_py(), np.uint32, np.uint32)
                found.append(rest.astype(np.uint64) * nb + bucket.astype(np.uint64))
                continue
            if members is None:
                members = P.Members(np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64))
            if not len(members.keys):
                continue
            for part in P.documents_in(payload.as_py()):
                hashes, first = P.words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                for i, doc_id in enumerate(ids):
                    own = hashes[first[i] : first[i + 1]]
                    if len(own) < WINDOW or doc_id is None:
                        continue
                    h = P.windows(own, BLOCK)
                    bucket, rest = _key(h, nb)
                    at, _ = members.find(rest.astype(np.uint64) * nb + bucket.astype(np.uint64))
                    if not len(at):
                        continue
                    # windows that cover an anchor start up to 25 words before it
                    opens = np.bincount(np.maximum(0, at - (WINDOW - BLOCK)), minlength=len(own) + 1)
                    closes = np.bincount(at + 1, minlength=len(own) + 1)
                    near = np.flatnonzero(np.cumsum(opens - closes)[: len(own) - WINDOW + 1])
                    if len(near):
                        h1, h2 = _window_keys(own)
                        asked.append((h1[near], h2[near], np.full(len(near), doc_id, np.int64)))
                        n += len(near)
                if n > 2 * GATHER:
                    yield flush()
                    asked, n = [], 0
        if asked:
            yield flush()

    both = P.packed_docs(docs, groups).unionByName(anchors)
    return both.repartition(width(docs.sparkSession), "g").sortWithinPartitions("g", "kind").mapInArrow(extend, "bucket int, g int, payload binary")


def _answers(questions: DataFrame) -> DataFrame:
    """(g, kind 0, payload): the smallest doc_id of each window that some document of the group must give up."""

    def least(key, table):
        h1s, h2s, los, his, gs = [], [], [], [], []
        for g, blob in zip(table.column("g").to_pylist(), table.column("payload").to_pylist(), strict=True):
            h1, h2, lo, more = P.unpack(blob, np.uint64, np.uint32, np.int64, np.int64)
            h1s.append(h1)
            h2s.append(h2)
            los.append(lo)
            his.append(lo + more)
            gs.append(np.full(len(h1), g, np.int32))
        h1, h2, lo, hi, g = (np.concatenate(x) for x in (h1s, h2s, los, his, gs))
        order = np.lexsort((h2, h1))
        h1, h2, lo, hi, g = (x[order] for x in (h1, h2, lo, hi, g))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        smallest = np.repeat(np.minimum.reduceat(lo, starts), np.diff([*starts, len(h1)]))
        gives = np.flatnonzero(smallest < hi)
        gives = gives[np.argsort(g[gives], kind="stable")]
        runs = _split(g[gives])
        blobs = [P.pack(h1[gives[a:b]], h2[gives[a:b]], smallest[gives[a:b]]) for _, a, b in runs]
        return pa.table({"g": pa.array([r[0] for r in runs], pa.int32()), "kind": pa.array([0] * len(runs), pa.int32()), "payload": pa.array(blobs, pa.binary())})

    return questions.groupBy("bucket").applyInArrow(least, "g int, kind int, payload binary")


def _removed(docs: DataFrame, answers: DataFrame, groups: int, want_text: bool) -> DataFrame:
    def remove(batches):
        current, found, members, first_hash, smallest = None, [], None, None, None
        for g, kind, payload in P.groups_of(batches, "g"):
            if g != current:
                current, found, members = g, [], None
            if kind == 0:
                found.append(P.unpack(payload.as_py(), np.uint64, np.uint32, np.int64))
                continue
            if members is None:
                h1, h2, least = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.uint32), (2, np.int64)))
                keys = P.mix(h1) ^ h2.astype(np.uint64)
                order = np.argsort(keys, kind="stable")
                members, first_hash, smallest = P.Members(keys[order]), h1[order], least[order]
            for part in P.documents_in(payload.as_py()):
                hashes, first = P.words(part.column("text"))
                data, offsets = P.utf8(part.column("text"))
                rows = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if want_text else {})
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = hashes[first[i] : first[i + 1]]
                    gone = None
                    if doc_id is not None and len(own) >= WINDOW and len(members.keys):
                        h1, h2 = _window_keys(own)
                        at, which = members.find(P.mix(h1) ^ (h2 & _LOW))
                        at = at[(first_hash[which] == h1[at]) & (smallest[which] < doc_id)]
                        if len(at):
                            cover = np.zeros(len(own) + 1, np.int32)
                            cover[at] += 1
                            cover[at + WINDOW] -= 1
                            gone = np.cumsum(cover)[:-1] > 0
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    kept = words if gone is None else [words[k] for k in np.flatnonzero(~gone)]
                    text = b" ".join(kept)
                    rows["doc_id"].append(doc_id)
                    rows["n_words"].append(len(words))
                    rows["n_removed"].append(len(words) - len(kept))
                    rows["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                    if want_text:
                        rows["kept"].append(text.decode())
                kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    both = P.packed_docs(docs, groups).unionByName(answers)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if want_text else "")
    return both.repartition(width(docs.sparkSession), "g").sortWithinPartitions("g", "kind").mapInArrow(remove, schema)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, and with_text the kept words joined by spaces."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = P.groups_for(docs, width(docs.sparkSession))
    buckets = groups
    anchors = _anchors(_probes(docs, groups, buckets), buckets)
    answers = _answers(_questions(docs, anchors, groups, buckets))
    return _removed(docs, answers, groups, with_text)
