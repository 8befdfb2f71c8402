"""Language identification by nearest centroid.

A text's vector holds its letter n-grams (one to three letters, case folded, other characters as one blank), hashed to
DIMS places, as sqrt(count) times inverse document frequency, of unit length. Each language has up to CLUSTERS centroids,
found by spherical k-means on its training texts; a text gets the language of the centroid with the largest cosine. The
prediction is rejected by distance: where the cosine is below NEAR of the median that texts of the language and of this length
class reach. A short text has few n-grams and lies far from everything, so the sample's texts and their beginnings are scored,
each half of a language's texts by the centroids of the other half, and every doubling of the letters is a class of its own.

The classifier is fitted on a bounded sample: of each language the PER_LANGUAGE labelled texts, fewer where there are many
languages, that come first by a hash of doc_id and text over the whole table; SAMPLE in all, and so of the LANGUAGES most
frequent ones at most. Equal rows count once. The fit is one task on that sample; predictions are map-only over whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0, and rejected; without any labelled text every
text is; rows with one doc_id are judged each for itself; a null doc_id is never in the sample; an empty table gives an
empty result; further columns are ignored by the prediction and kept by `accepted`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _packed as P
from millrace.llm._spark import prepare, uniform, written

DIMS, CLUSTERS = 1 << 13, 3
PER_LANGUAGE, SAMPLE, LANGUAGES = 500, 6000, 1200
NEAR, CLASSES = 0.3, 16
#: Characters of the beginnings that the limits are learnt from.
PREFIXES = (2, 5, 10, 20, 40, 80, 160, 320, 640, 1280)
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point 0 where it is no letter, else the code point of its lower case."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low[0])
        _FOLD.append(table)
    return _FOLD[0]


def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (rows x DIMS) and the number of letters of each text."""
    fold = _fold()
    codes = [fold[np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)] for t in texts]
    letters = np.array([np.count_nonzero(c) for c in codes])
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, c in enumerate(codes):
        if not letters[i]:
            continue
        for lo in range(0, len(c), 1 << 20):  # a long text piece by piece
            part = c[max(0, lo - 2) : lo + (1 << 20)]
            blank = part == 0
            keep = np.ones(len(part), bool)
            keep[1:] = ~(blank[1:] & blank[:-1])
            s = part[keep].astype(np.uint64)
            if len(s) < 3:
                s = np.concatenate([np.zeros(1, np.uint64), s, np.zeros(1, np.uint64)])
            one = s * np.uint64(0x9E3779B97F4A7C15)
            two = one[:-1] * np.uint64(31) + s[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            three = two[:-1] * np.uint64(31) + s[2:] * np.uint64(0x165667B19E3779F9)
            grams = np.concatenate([one, two, three])
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 13)
            out[i] += np.bincount(grams.astype(np.int64), minlength=DIMS)
    return out, letters


def _unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _centroids(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; the centroids and each text's cosine to the nearest."""
    k = min(CLUSTERS, max(1, len(vectors) // 20))
    mean = vectors.mean(0)
    seeds = [int((vectors @ mean).argmax())]
    while len(seeds) < k:
        seeds.append(int((vectors @ vectors[seeds].T).max(1).argmin()))
    centres = vectors[seeds]
    for _ in range(12):
        own = (vectors @ centres.T).argmax(1)
        moved = np.vstack([vectors[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centres, (vectors @ centres.T).max(1)


def _refused(top: np.ndarray, reach: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return (letters == 0) | (top < NEAR * reach[np.arange(len(letters)), _length_class(letters)])


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), CLASSES - 1)


def _usual(cosine: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The median cosine of each length class; one of under five texts takes the class below, and the lowest ones the next above."""
    sizes = np.bincount(length, minlength=CLASSES)
    known = np.flatnonzero(sizes >= min(5, sizes.max()))
    medians = np.array([np.median(cosine[length == c]) for c in known])
    return medians[np.maximum(np.searchsorted(known, np.arange(CLASSES), side="right") - 1, 0)]


def held_out(doc_id) -> F.Column:
    """Documents the fit never sees: crc32 of the doc_id's decimal text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame) -> dict | None:
    """The model from a bounded sample of docs (doc_id, text, lang), held-out ones apart; None without labelled texts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    prepare(docs.sparkSession)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    known = written(rows.select("lang", "doc_id", "hash").distinct(), "lang-known")
    by = known.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    by = written(by, "lang-counts")
    languages = by.count()
    if not languages:
        return None
    bound = min(PER_LANGUAGE, SAMPLE // languages)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(uniform(F.lit(41), "doc_id", "hash"), "doc_id", "hash"))
    chosen = known.join(F.broadcast(by), F.col("lang") == F.col("l")).withColumn("place", place).where(F.col("place") <= bound)
    chosen = written(chosen.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), F.col("lang").alias("g")), "lang-sample")  # SAMPLE rows at most
    same = (F.col("doc_id") == F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("lang") == F.col("g"))
    rows = rows.join(F.broadcast(chosen), same, "left_semi").groupBy("doc_id", "lang", "hash").agg(F.min("text").alias("text")).select("doc_id", "lang", "text")

    sampled = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("size", pa.int32()), ("letters", pa.int64()), ("tf", pa.binary())])

    def dense(blobs):
        tf = np.zeros((len(blobs), DIMS), np.float32)
        for i, blob in enumerate(blobs):
            at, n = P.unpack(blob, np.uint16, np.float32)
            tf[i, at] = n
        return tf

    def vectorise(batches):
        for batch in batches:
            for part in P.pieces(batch):
                texts = part.column("text").to_pylist()
                for size in (0, *PREFIXES):  # 0: the whole text
                    pick = [i for i, x in enumerate(texts) if not size or len(x) > size]
                    for lo in range(0, len(pick), 256):
                        own = pick[lo : lo + 256]
                        tf, letters = counts([(texts[i][:size] if size else texts[i]).encode() for i in own])
                        rows = [(part.column("lang")[own[i]].as_py(), part.column("doc_id")[own[i]].as_py(), size, int(letters[i]), P.pack(np.flatnonzero(tf[i]).astype(np.uint16), tf[i][tf[i] > 0])) for i in np.flatnonzero(letters)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(sampled.types)], schema=sampled)

    def learn(batches):
        every = pa.Table.from_batches(list(batches), sampled).sort_by([("lang", "ascending"), ("doc_id", "ascending")])
        table = every.filter(pc.equal(every.column("size"), 0))
        langs = np.array(table.column("lang").to_pylist(), object)
        tf = dense(table.column("tf").to_pylist())
        idf = (np.log((1 + len(langs)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
        vectors = _unit(tf, idf)
        names, blobs, reaches = [""], [idf.tobytes()], [[0.0]]
        for lang in sorted(set(langs)):
            own = vectors[langs == lang]
            centres, _ = _centroids(own)
            ids = table.column("doc_id").to_numpy()[langs == lang]
            half = np.searchsorted(np.unique(ids), ids) % 2
            across = [_centroids(own[half != h])[0] if (half != h).any() else centres for h in (0, 1)]
            parts = every.filter(pc.equal(every.column("lang"), lang))
            side = np.searchsorted(np.unique(ids), np.minimum(parts.column("doc_id").to_numpy(), ids.max())) % 2
            cosine = np.zeros(len(parts), np.float32)
            for lo in range(0, len(parts), 512):
                v = _unit(dense(parts.column("tf")[lo : lo + 512].to_pylist()), idf)
                cosine[lo : lo + 512] = np.where(side[lo : lo + 512] == 0, (v @ across[0].T).max(1), (v @ across[1].T).max(1))
            reach = _usual(cosine, _length_class(parts.column("letters").to_numpy())).tolist()
            for c in centres:
                names.append(lang)
                blobs.append(c.astype(np.float32).tobytes())
                reaches.append(reach)
        if len(langs):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blobs, pa.binary()), pa.array(reaches, pa.list_(pa.float64()))], names=["lang", "vector", "reach"])

    model = rows.mapInArrow(vectorise, "lang string, doc_id long, size int, letters long, tf binary").repartition(1).mapInArrow(learn, "lang string, vector binary, reach array<double>").collect()
    if not model:
        return None
    return {
        "idf": np.frombuffer(model[0]["vector"], np.float32), "langs": [m["lang"] for m in model[1:]],
        "centres": np.vstack([np.frombuffer(m["vector"], np.float32) for m in model[1:]]), "reach": np.array([m["reach"] for m in model[1:]]),
    }


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids for each language: bounded by the sample

    def look(batches):
        m = shared.value
        for batch in batches:
            for part in P.pieces(batch):
                data, offsets = P.utf8(part.column("text"))
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                langs, scores, refused = [], [], []
                for lo in range(0, len(texts), 256):
                    tf, letters = counts(texts[lo : lo + 256])
                    if m is None:
                        langs += ["und"] * len(letters)
                        scores += [0.0] * len(letters)
                        refused += [True] * len(letters)
                        continue
                    cosine = _unit(tf, m["idf"]) @ m["centres"].T
                    best = cosine.argmax(1)
                    top = cosine[np.arange(len(best)), best].astype(float)
                    langs += [m["langs"][b] if n else "und" for b, n in zip(best, letters, strict=True)]
                    scores += np.where(letters > 0, np.clip(top, 0, 1), 0.0).tolist()
                    refused += _refused(top, m["reach"][best], letters).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(look, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those whose language is rejected. Documents of one doc_id stay or go together with their own text."""
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        m = shared.value
        for batch in batches:
            if m is None:
                yield batch.slice(0, 0)
                continue
            text = pc.fill_null(batch.column("text"), "").to_pylist()
            for lo in range(0, len(text), 256):
                tf, letters = counts([t.encode() for t in text[lo : lo + 256]])
                cosine = _unit(tf, m["idf"]) @ m["centres"].T
                best = cosine.argmax(1)
                good = ~_refused(cosine[np.arange(len(best)), best], m["reach"][best], letters)
                yield batch.slice(lo, len(good)).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
