"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary, all words of the corpus: the background model counts all documents, the target model
those labelled as target. They are matched: background counts are scaled by the target's share of all tokens, so both models
rest on the same mass and smoothing weighs the same in both. Both are conditional, p(w | v) = (c(v, w) + K p(w)) / (c(v) + K),
and back off to the model's own add-one unigram distribution. A document is scored without its own counts of words and
bigrams. It starts and ends with a boundary token. Its score is the mean over its tokens of the target loss less the
background loss: the lower, the more it reads like the target.

A context's count is the count of the word itself, so the loss of a text is a sum over its words of what only the word and
its bigram decide: -log(c(v, w) + K p(w)) + log(c(w) + K). All of it is known where a word's bigrams meet.

As jobs: (1) documents and labels are dealt together, and word counts of both kinds are summed by hash; the words that make
up more than one in HOT of all tokens are at most HOT, and become a small shared table. (2) Dealt the same way, every
document's bigrams are packed by the bucket of their word, each distinct bigram of a pack once; bigrams of a hot word are
dealt by the bigram instead. (3) A bucket sums the counts of its words and bigrams, turns them to losses and returns each
document's part of the sum. (4) The parts are added up. The number of buckets comes from the bytes of text; no document, word
or bigram is brought to one task, and no count is sampled or cut off.

Losses are summed as whole hundred-thousandths of a nat, so the order of adding does not matter.

Defined cases: a null or wordless text has n_tokens 1 (the end) and is scored on that; rows with one doc_id are one
document, scored together, and each row gets that score; a null doc_id gets null scores and is not counted; a missing or
empty set of targets makes the target model uniform and the background unscaled; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _packed as P
from millrace.llm._spark import prepare, width, written

K, HOT = 4.0, 2000
#: The boundary token's hash.
EDGE = np.uint64(0x5DEECE66D1234567)
#: Bigrams a task gathers before it packs and sends them.
GATHER = 2_000_000
UNIT = 1e5


def _flag_rows(targets: DataFrame, groups: int) -> DataFrame:
    """Target doc_ids as rows (g, kind 0, payload)."""

    def packed(batches):
        for batch in batches:
            g, ids = batch.column("g").to_numpy(), batch.column("doc_id").to_numpy()
            order = np.argsort(g, kind="stable")
            g, ids = g[order], ids[order]
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist()] if len(g) else []
            blobs = [P.pack(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(g)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(g[a]) for a in cuts], pa.int32()), pa.array([0] * len(cuts), pa.int32()), pa.array(blobs, pa.binary())], names=["g", "kind", "payload"])

    keyed = targets.where(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"))
    return keyed.mapInArrow(packed, "g int, kind int, payload binary")


def _dealt(docs: DataFrame, targets: DataFrame, groups: int) -> DataFrame:
    both = P.packed_docs(docs, groups).unionByName(_flag_rows(targets, groups))
    return both.repartition(width(docs.sparkSession), "g").sortWithinPartitions("g", "kind")


def _documents(batches):
    """Pieces of (g, doc_ids, is_target, word hashes, first word of each document) of dealt rows."""
    current, ids, found = None, np.zeros(0, np.int64), []
    for g, kind, payload in P.groups_of(batches, "g"):
        if g != current:
            current, ids, found = g, None, []
        if kind == 0:
            found.append(P.unpack(payload.as_py(), np.int64)[0])
            continue
        if ids is None:
            ids = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for part in P.documents_in(payload.as_py()):
            doc_ids = part.column("doc_id").to_numpy()
            hashes, first = P.words(part.column("text"))
            yield g, doc_ids, np.isin(doc_ids, ids), hashes, first


def _lines(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, owner) of every bigram of documents given as word hashes, with an edge before and after each."""
    n = np.diff(first)
    k = np.arange(len(n))
    line = np.full(len(hashes) + len(n) + 1, EDGE, np.uint64)
    line[np.arange(len(hashes)) + np.repeat(k, n) + 1] = hashes
    return line[:-1], line[1:], np.repeat(k, n + 1)


def _word_counts(dealt: DataFrame, buckets: int) -> DataFrame:
    """(word, n_all, n_target) of every word, the boundary among them."""

    def count(batches):
        words, target, n = [], [], 0

        def flush():
            w, t = np.concatenate(words), np.concatenate(target)
            w, at = np.unique(w, return_inverse=True)
            n_all, n_target = np.bincount(at, minlength=len(w)), np.bincount(at, weights=t, minlength=len(w)).astype(np.int64)
            bucket = (w % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist()]
            ends = [*cuts[1:], len(order)]
            blobs = [P.pack(w[order[a:b]], n_all[order[a:b]].astype(np.int64), n_target[order[a:b]]) for a, b in zip(cuts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[order[a]]) for a in cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

        for _, _, is_target, hashes, first in _documents(batches):
            words += [hashes, np.full(len(is_target), EDGE, np.uint64)]
            target += [np.repeat(is_target, np.diff(first)), is_target]
            n += len(hashes) + len(is_target)
            if n > GATHER:
                yield flush()
                words, target, n = [], [], 0
        if n:
            yield flush()

    def add(key, table):
        parts = [P.unpack(b, np.uint64, np.int64, np.int64) for b in table.column("payload").to_pylist()]
        w, n_all, n_target = (np.concatenate([p[k] for p in parts]) for k in range(3))
        w, at = np.unique(w, return_inverse=True)
        n_all, n_target = np.bincount(at, weights=n_all), np.bincount(at, weights=n_target)
        return pa.table({"word": pa.array(w.view(np.int64)), "n_all": pa.array(n_all.astype(np.int64)), "n_target": pa.array(n_target.astype(np.int64))})

    return dealt.mapInArrow(count, "bucket int, payload binary").groupBy("bucket").applyInArrow(add, "word long, n_all long, n_target long")


def _model(docs: DataFrame, targets: DataFrame, groups: int) -> dict:
    """What all tasks know of the models: the sizes, and the counts of hot words, HOT at most."""
    counted = written(_word_counts(_dealt(docs, targets, groups), groups), "lm-words")
    size = counted.agg(F.count(F.lit(1)), F.sum("n_all"), F.sum("n_target")).first()
    n_all, n_target = size[1] or 0, size[2] or 0
    hot = counted.where(F.col("n_all") * HOT > n_all).select("word", "n_all", "n_target").collect()
    hot.sort(key=lambda r: np.uint64(r["word"] & (2**64 - 1)))
    return {
        "words": size[0], "n_all": n_all, "n_target": n_target, "share": n_target / n_all if n_target else 1.0,
        "hot": np.array([r["word"] for r in hot], np.int64).view(np.uint64), "hot_all": np.array([r["n_all"] for r in hot], np.int64), "hot_target": np.array([r["n_target"] for r in hot], np.int64),
    }


def _place(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Each word's number among the hot ones, -1 for others."""
    if not len(hot):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, at, -1)


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return new


def _spans(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, loss_target, loss_background, difference (a token, in nats).

    targets: (doc_id) of the documents that the target model counts.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    groups = P.groups_for(known, width(spark), 8_000_000)  # a bucket is some twenty times its packed size when it is worked on
    shared = spark.sparkContext.broadcast(_model(known, targets, groups))

    def bigrams(batches):
        hot = shared.value["hot"]
        gathered, table, flags, n, current = [], [], [], 0, None

        def flush():
            before, word, doc = (np.concatenate([x[k] for x in gathered]) for k in range(3))
            ids, flag = np.array(table, np.int64), np.array(flags, np.uint8)
            pair = P.mix(before * np.uint64(0xD6E8FEB86659FD93) + word)
            bucket = np.where(_place(word, hot) >= 0, pair, P.mix(word)) % np.uint64(groups)
            # how often the document has the word
            mine = P.mix(word + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(mine, kind="stable")
            starts = np.flatnonzero(_fresh(mine[order]))
            has = np.empty(len(word), np.uint32)
            has[order] = np.repeat(_spans(starts, len(word)), _spans(starts, len(word)))
            # by bucket, word, bigram and document; equal ones become one entry
            key = (bucket << np.uint64(44)) | ((P.mix(word) >> np.uint64(42)) << np.uint64(22)) | (pair >> np.uint64(42))
            order = np.argsort(key, kind="stable")
            bucket, word, pair, doc, has = (x[order] for x in (bucket, word, pair, doc, has))
            entry = np.flatnonzero(_fresh(bucket, word, pair, doc))
            times = _spans(entry, len(word)).astype(np.uint32)
            bucket, word, pair, doc, has = (x[entry] for x in (bucket, word, pair, doc, has))
            pairs = np.flatnonzero(_fresh(bucket, word, pair))
            words = np.flatnonzero(_fresh(bucket[pairs], word[pairs]))
            runs = np.flatnonzero(_fresh(bucket[pairs[words]]))
            each_pair, each_word = _spans(pairs, len(word)).astype(np.uint32), _spans(words, len(pairs)).astype(np.uint32)
            steps, rest = np.diff(ids, prepend=0), (pair[pairs] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            blobs, names = [], []
            for a, b in zip(runs, [*runs[1:], len(words)], strict=True):
                p, q = words[a], words[b] if b < len(words) else len(pairs)
                x, y = pairs[p], pairs[q] if q < len(pairs) else len(word)
                names.append(int(bucket[x]))
                blobs.append(P.pack(word[pairs[words[a:b]]], each_word[a:b], rest[p:q], each_pair[p:q], doc[x:y], times[x:y], has[x:y], steps, flag))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([current] * len(names), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "payload"])

        for g, doc_ids, is_target, hashes, first in _documents(batches):
            if gathered and (g != current or n > GATHER or len(table) + len(doc_ids) > 65_000):
                yield flush()
                gathered, table, flags, n = [], [], [], 0
            current = g
            before, after, owner = _lines(hashes, first)
            gathered.append((before, after, (owner + len(table)).astype(np.uint16)))
            table += doc_ids.tolist()
            flags += is_target.tolist()
            n += len(owner)
        if gathered:
            yield flush()

    def losses(key, table):
        m = shared.value
        gs = table.column("g").to_pylist()
        parts = [P.unpack(b, np.uint64, np.uint32, np.uint32, np.uint32, np.uint16, np.uint32, np.uint32, np.int64, np.uint8) for b in table.column("payload").to_pylist()]
        words = np.concatenate([np.repeat(p[0], p[1]) for p in parts])  # of each pack's distinct bigrams
        pairs = np.concatenate([p[2] for p in parts]).astype(np.uint64)
        per_pair = np.concatenate([p[3] for p in parts])
        times, has = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (5, 6))
        target = np.concatenate([p[8][p[4]] for p in parts]).astype(np.int64)
        known, word_at = np.unique(words, return_inverse=True)
        _, pair_at = np.unique(P.mix(words) ^ P.mix(pairs), return_inverse=True)
        pair_of = np.repeat(np.arange(len(pairs)), per_pair)
        word_at, pair_at = word_at[pair_of], pair_at[pair_of]
        place = _place(known, m["hot"])
        loss = []
        for weight, counts, share, own in ((target, m["hot_target"], 1.0, target), (1, m["hot_all"], m["share"], 1)):
            c = np.bincount(pair_at, weights=times * weight)[pair_at] - times * own
            n = np.bincount(word_at, weights=times * weight, minlength=len(known))
            n[place >= 0] = counts[place[place >= 0]]
            n = n[word_at] - has * own
            mass = m["n_target"] if m["n_target"] or weight is target else m["n_all"]
            unigram = (share * n + 1) / (mass + m["words"])
            loss.append(np.rint((np.log(share * n + K) - np.log(share * c + K * unigram)) * UNIT).astype(np.int64) * times)
        out, lo = {}, 0
        for g, part in zip(gs, parts, strict=True):
            doc, steps = part[4], part[7]
            own = slice(lo, lo + len(doc))
            lo += len(doc)
            found = np.unique(doc)
            sums = []
            for x in (*loss, times):
                s = np.zeros(len(steps), np.int64)
                np.add.at(s, doc, x[own])
                sums.append(s[found])
            out.setdefault(g, []).append((np.cumsum(steps)[found], *sums))
        blobs = [P.pack(*(np.concatenate([x[k] for x in rows]) for k in range(4))) for rows in out.values()]
        return pa.table({"g": pa.array(list(out), pa.int32()), "payload": pa.array(blobs, pa.binary())})

    def total(key, table):
        parts = [P.unpack(b, np.int64, np.int64, np.int64, np.int64) for b in table.column("payload").to_pylist()]
        ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = []
        for k in (1, 2, 3):
            s = np.zeros(len(ids), np.int64)
            np.add.at(s, at, np.concatenate([p[k] for p in parts]))
            sums.append(s)
        return pa.table({"sd": pa.array(ids), "n_tokens": pa.array(sums[2]), "st": pa.array(sums[0]), "sb": pa.array(sums[1])})

    parts = _dealt(known, targets, groups).mapInArrow(bigrams, "bucket int, g int, payload binary").groupBy("bucket").applyInArrow(losses, "g int, payload binary")
    sums = parts.groupBy("g").applyInArrow(total, "sd long, n_tokens long, st long, sb long")
    per = lambda c: F.round(F.col(c) / F.lit(UNIT) / F.col("n_tokens"), 6)
    scored = sums.select("sd", "n_tokens", per("st").alias("loss_target"), per("sb").alias("loss_background"), F.round((F.col("st") - F.col("sb")) / F.lit(UNIT) / F.col("n_tokens"), 6).alias("difference"))
    return docs.select("doc_id").join(scored, F.col("doc_id") == F.col("sd"), "left").drop("sd")
