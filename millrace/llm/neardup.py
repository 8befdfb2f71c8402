"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's elements are its five-word k-mers, each labelled with its occurrence number, so repeats count. Under each of
BANDS random orders the document's two smallest elements are sampled and written down in the order they have in the text;
documents that agree in one such ordered sample share a bucket. Unlike MinHash the sample changes when passages change
places, so it follows edit similarity. Two texts whose elements have a Jaccard similarity of J and keep their order agree in
one sample with a chance of J^2. Of texts of 100 words of which a fifth is changed one by one, 96 % meet in 112 samples.

Within a bucket every document is a candidate of the bucket's smallest doc_id, so a group of g copies costs g candidates and
no bucket is ever paired out. A bucket that a common passage fills holds documents unlike its leader; so REFINED of the
samples are also extended by the document's three smallest words, in text order, and these finer buckets have leaders of
their own. A document meets the leaders of all its buckets, coarse and fine: several representatives, never all members.

As jobs: tasks sample their documents, verify what meets among themselves, and reduce each bucket to its local leader before
the shuffle (a bucket with a third of all documents costs an entry a task); buckets are sorted by Spark and read as a stream;
the candidate pairs left, made unique, meet the texts once, and each leader's members are dealt by salt. Texts that are equal are one document here. A candidate is a link
when a banded alignment (longest common subsequence of words within a band of 20 % around the diagonal, bit-parallel) aligns
at least 80 % of the longer text's words. Texts of more than LONG words are first cut at shared k-mers that occur once in
both, so memory stays in proportion to their length; the sum over the parts is a lower bound of the alignment. Classes are
the connected components of the links, named by their smallest doc_id.

Defined cases: equal texts are one class, empty ones too; a null text or null doc_id is a class of its own (class_id null
for a null doc_id); a text of fewer than five words has one k-mer, all its words; several texts under one doc_id have each
their own class by their text, and a link to one of them is a link to the doc_id; an empty table gives an empty result;
further columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _packed as P
from millrace.llm._spark import prepare, written
from millrace.llm.components import components

KMER, BANDS, REFINED, THRESHOLD = 5, 112, 28, 0.8
#: Words up to which two texts are aligned in one piece.
LONG = 16_384
#: Members of a leader that are verified together.
SALT = 256
#: Sampled keys, and words, that a task gathers before it reduces and sends them.
GATHER, WORDS = 2_000_000, 8_000_000
_RANDOM = np.random.default_rng(7919)
_ODD = _RANDOM.integers(0, 2**63, BANDS + REFINED, dtype=np.uint64) | np.uint64(1)
#: A sampled value holds the element's place below, its hash above.
_PLACES = np.uint64(20)
_PLACE, _TOP = np.uint64((1 << 20) - 1), np.uint64(2**64 - 1)
_STEP, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _labelled(elements: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of the elements with their occurrence number within their document."""
    own = P.mix(elements + owner.astype(np.uint64) * _STEP)
    order = np.argsort(own, kind="stable")
    run = own[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = run[1:] != run[:-1]
    at = np.arange(len(run))
    nth = np.empty(len(run), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return np.where(nth > 0, P.mix(elements + nth * _STEP), elements)


def _samples(elements: np.ndarray, starts: np.ndarray, odds: np.ndarray, take: int) -> np.ndarray:
    """One key for each order (rows) and document (columns): its `take` smallest elements in text order.

    starts: the first element of each document, none of which is empty, and the end. A document with fewer elements
    repeats its last smallest one.
    """
    ends = starts[1:]
    cuts = [np.arange(a, b, 1 << 20) for a, b in zip(starts[:-1][ends - starts[:-1] > 1 << 20], ends[ends - starts[:-1] > 1 << 20], strict=True)]
    parts = np.unique(np.concatenate([starts[:-1], *cuts])) if cuts else starts[:-1]
    size = np.diff(np.append(parts, starts[-1]))
    place = np.arange(len(elements), dtype=np.uint64) - np.repeat(parts, size).astype(np.uint64)
    base = elements & ~_PLACE
    first_part = np.searchsorted(parts, starts[:-1])
    several = len(parts) > len(starts) - 1
    out = np.empty((len(odds), len(starts) - 1), np.uint64)
    v = np.empty(len(elements), np.uint64)
    for k, odd in enumerate(odds):
        np.multiply(base, odd, out=v)
        v += place
        found = []
        for _ in range(take):
            least = np.minimum.reduceat(v, parts)
            at, rank = parts + (least & _PLACE).astype(np.int64), least & ~_PLACE
            if several:  # the smallest over a document's parts
                best = np.minimum.reduceat(rank, first_part)
                at = np.where(rank == np.repeat(best, np.diff(np.append(first_part, len(parts)))), at, len(elements))
                at, rank = np.minimum.reduceat(at, first_part), best
            if found:  # nothing is left of a document with fewer elements
                at = np.where(rank == _TOP & ~_PLACE, found[-1], at)
            found.append(at)
            v[at] = _TOP
        places = np.sort(np.vstack(found), axis=0)
        key = np.full(len(starts) - 1, k + 2000, np.uint64)
        for row in places:
            key = P.mix(key * _FOLD + elements[row])
        out[k] = key
    return out


def sample_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents): the sampled keys of documents given as word hashes, and which documents have words."""
    n = np.diff(first)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return np.zeros((BANDS + REFINED, 0), np.uint64), full
    n = n[full]
    starts = np.append(0, np.cumsum(n))
    owner = np.repeat(np.arange(len(full)), n)
    every = P.windows(hashes, KMER)
    inside = np.flatnonzero(owner[: len(every)] == owner[KMER - 1 :]) if len(every) else np.zeros(0, np.int64)
    short = np.flatnonzero(n < KMER)
    whole = np.array([P.windows(hashes[starts[i] : starts[i + 1]], int(n[i]))[0] for i in short], np.uint64)
    at = np.concatenate([inside, starts[short]])
    order = np.argsort(at, kind="stable")
    kmers = np.concatenate([every[inside], whole])[order]
    counts = np.maximum(n - KMER + 1, 1)
    kmers = _labelled(kmers, np.repeat(np.arange(len(full)), counts))
    coarse = _samples(kmers, np.append(0, np.cumsum(counts)), _ODD[:BANDS], 2)
    fine = _samples(_labelled(hashes, owner), starts, _ODD[BANDS:], 3)
    return np.vstack([coarse, P.mix(coarse[:REFINED] * _FOLD + fine)]), full


def order_samples(words: np.ndarray) -> np.ndarray:
    """Keys of the samples of one document's word hashes."""
    return sample_keys(words, np.array([0, len(words)]))[0].ravel()


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of a and b within `band` of the diagonal, bit-parallel."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    size = min(n, 2 * band + 1)
    full = (1 << size) - 1
    lo, v, passed = 0, full, 0
    for j, w in enumerate(b.tolist()):
        want = min(max(0, j - band), n - size)
        while lo < want:  # the window moves one row down; the row that leaves is final
            passed += not v & 1
            v = (v >> 1) | (1 << (size - 1))
            lo += 1
        match = places.get(w)
        if match is not None:
            u = v & (match >> lo) & full
            v = ((v + u) | (v - u)) & full
    return passed + size - v.bit_count()


def _cuts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) to cut two long texts at: k-mers that occur once in both, on the longest chain that goes up in both.

    Where parts are still longer than LONG they are cut on their diagonal.
    """
    sides = []
    for x in (a, b):
        kmers = P.windows(P.mix(x.astype(np.uint64)), KMER)
        value, at, n = np.unique(kmers, return_index=True, return_counts=True)
        sides.append((value[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    order = np.argsort(sides[0][1][i], kind="stable")
    left, right = sides[0][1][i][order].tolist(), sides[1][1][j][order].tolist()
    tails, ends, before = [], [], []
    for k, y in enumerate(right):  # the longest increasing subsequence
        at = bisect_left(tails, y)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at], ends[at] = y, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append((left[k], right[k]))
        k = before[k]
    cuts, at = [], (0, 0)
    for i, j in [*chain[::-1], (len(a), len(b))]:
        wide = max(i - at[0], j - at[1])
        if wide < LONG // 4 and i < len(a):
            continue
        pieces = -(-wide // LONG)
        cuts += [(at[0] + (i - at[0]) * k // pieces, at[1] + (j - at[1]) * k // pieces) for k in range(1, pieces)] + [(i, j)]
        at = (i, j)
    return cuts


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether an alignment covers `threshold` of the longer one's words.

    What both begin and end with is aligned at once; words that stand at the same place bound the alignment from below,
    words that both have bound it from above, and only between the bounds it is worked out.
    """
    if len(a) < len(b):
        a, b = b, a
    need = threshold * len(a) - 1e-9
    if not len(a) or len(b) < need:
        return False
    band = math.ceil((1 - threshold) * len(a)) + 1  # an alignment that good strays no further
    equal = a[: len(b)] == b
    if np.count_nonzero(equal) >= need:
        return True
    head = int(equal.argmin())
    tail = int((a[len(a) - len(b) + head :] == b[head:])[::-1].argmin()) if len(b) > head else 0
    a, b, done = a[head : len(a) - tail], b[head : len(b) - tail], head + tail
    if done >= need:
        return True
    words, n = np.unique(a, return_counts=True)
    other, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(words, other, assume_unique=True, return_indices=True)
    if done + np.minimum(n[i], m[j]).sum() < need:
        return False
    if len(a) <= LONG:
        return done + aligned(a, b, band) >= need
    at = (0, 0)
    for i, j in _cuts(a, b):
        own = a[at[0] : i], b[at[1] : j]
        done += aligned(*own, max(map(len, own)))
        at = (i, j)
    return done >= need


def _reduced(keys: np.ndarray, owners: np.ndarray, ids: np.ndarray, words: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Each key with its document of the smallest id, and links (a, b) of that one with others of the key."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_rank = np.argsort(rank)
    owners = rank[owners]
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    leader = np.repeat(owners[new], np.diff(np.append(np.flatnonzero(new), len(keys))))
    met = np.unique(leader[leader != owners] * len(ids) + owners[leader != owners])
    root, a, b = list(range(len(ids))), [], []

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip((met % len(ids)).tolist(), (met // len(ids)).tolist(), strict=True):
        if (i := top(x)) != (j := top(y)) and similar(words[by_rank[x]], words[by_rank[y]], threshold):
            root[max(i, j)] = min(i, j)
            a.append(int(ids[by_rank[x]]))
            b.append(int(ids[by_rank[y]]))
    return keys[new], ids[by_rank[owners[new]]], a, b


def candidates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, leader, linked) of documents that share a bucket with a leader, some more than once; linked ones are verified."""

    def sample(batches):
        keys, owners, ids, words, size, long = [], [], [], [], 0, 0

        def flush():
            key, doc, a, b = _reduced(np.concatenate(keys), np.concatenate(owners), np.array(ids, np.int64), words, threshold)
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            other = np.append(np.zeros(len(key), np.int64), b)
            key = np.append(key, P.mix(a.astype(np.uint64) * _FOLD + b.astype(np.uint64)))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.append(doc, a)), pa.array(other, mask=np.arange(len(key)) < len(doc))], names=["key", "doc_id", "linked"])

        for batch in batches:
            for part in P.pieces(batch):
                hashes, first = P.words(part.column("text"))
                found, full = sample_keys(hashes, first)
                keys.append(found.ravel())
                owners.append(np.tile(full + len(ids), len(found)))
                ids += part.column("doc_id").to_pylist()
                words += np.split(hashes.astype(np.uint32), first[1:-1])
                size, long = size + found.size, long + len(hashes)
                if size > GATHER or long > WORDS:
                    yield flush()
                    keys, owners, ids, words, size, long = [], [], [], [], 0, 0
        if keys:
            yield flush()

    def lead(batches):
        key, leader = None, None
        for batch in batches:
            linked = batch.filter(pc.is_valid(batch.column("linked")))
            batch = batch.filter(pc.is_null(batch.column("linked")))
            pairs = np.zeros((2, 0), np.int64)
            if len(batch):
                k, d = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
                new = np.ones(len(k), bool)
                new[1:] = k[1:] != k[:-1]
                starts = np.flatnonzero(new)
                first = d[starts]
                if k[0] == key:
                    first[0] = leader
                key, leader = k[-1], first[-1]
                leaders = np.repeat(first, np.diff(np.append(starts, len(k))))
                pairs = np.unique(np.vstack([d, leaders])[:, leaders != d], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(pairs[0], linked.column("doc_id"))), pa.array(np.append(pairs[1], linked.column("linked"))), pa.array(np.arange(pairs.shape[1] + len(linked)) >= pairs.shape[1])], names=["doc_id", "leader", "linked"]
            )

    sampled = docs.select("doc_id", "text").mapInArrow(sample, "key long, doc_id long, linked long")
    return sampled.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lead, "doc_id long, leader long, linked boolean")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links (a, b) among pairs (doc_id, leader): every leader's members are read as a stream after the leader."""
    many = pairs.groupBy(F.col("leader").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT)).cast("int").alias("salts"))
    many = written(many, "near-leaders")
    members = pairs.join(many, F.col("leader") == F.col("grp")).select(F.col("doc_id").alias("node"), "grp", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    leaders = many.select(F.col("grp").alias("node"), "grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    wanted = members.unionByName(leaders)

    def tokens(batches):
        for batch in batches:
            for part in P.pieces(batch):
                hashes, first = P.words(part.column("text"))
                words = [hashes[a:b].astype(np.uint32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "salt", "kind", "node")), pa.array(words, pa.binary())], names=["grp", "salt", "kind", "node", "words"])

    def verify(batches):
        now, lead = None, []
        for batch in batches:
            a, b = [], []
            for grp, salt, kind, node, words in zip(*(batch.column(c).to_pylist() for c in ("grp", "salt", "kind", "node")), batch.column("words"), strict=True):
                if (grp, salt) != now:
                    now, lead = (grp, salt), []
                own = np.frombuffer(words.as_buffer(), np.uint32)
                if kind == 0:
                    lead.append(own)
                elif any(similar(own, x, threshold) for x in lead):
                    a.append(node)
                    b.append(grp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("node")).select("grp", "salt", "kind", "node", "text")
    met = met.mapInArrow(tokens, "grp long, salt int, kind int, node long, words binary")
    return met.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "kind").mapInArrow(verify, "a long, b long")


def _connected(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(cn, label) of all that is linked among pairs (doc_id, leader, linked).

    Every document is first verified with its smallest leader; of its other pairs only those that still join two classes
    are looked at, so that a large group is not verified once for each bucket that it meets in.
    """
    both = lambda links: links.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    open_ = pairs.where("NOT linked")
    first = written(open_.groupBy("doc_id").agg(F.min("leader").alias("leader")), "near-first")
    links = written(both(pairs.where("linked")).unionByName(verified(first, docs, threshold).distinct()), "near-links")
    labels = components(links)
    named = lambda df, side, to: df.join(labels.select(F.col("node").alias("ln"), F.col("label").alias("ll")), F.col(side) == F.col("ln"), "left").withColumn(to, F.coalesce("ll", side)).drop("ln", "ll")
    rest = open_.join(first.withColumnRenamed("doc_id", "fd").withColumnRenamed("leader", "fl"), (F.col("doc_id") == F.col("fd")) & (F.col("leader") == F.col("fl")), "left_anti")
    rest = named(named(rest.select("doc_id", "leader"), "doc_id", "la"), "leader", "lb").where("la <> lb")
    rest = written(rest, "near-rest")
    more = verified(rest.select("doc_id", "leader"), docs, threshold).distinct()
    more = written(named(named(more, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "near-joins")
    joined = components(more).select(F.col("node").alias("jn"), F.col("label").alias("jl"))
    far = labels.join(joined, F.col("label") == F.col("jn"), "left").select(F.col("node").alias("cn"), F.coalesce("jl", "label").alias("label"))
    return far.unionByName(joined.join(labels, F.col("jn") == F.col("node"), "left_anti").select(F.col("jn").alias("cn"), F.col("jl").alias("label")))


def _usable(docs: DataFrame) -> DataFrame:
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.where(F.col("text").isNotNull())


def _text_key(text) -> F.Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def _classified(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_key, class_id) for each row with a doc_id and a text."""
    prepare(docs.sparkSession)
    usable = _usable(docs)
    texts = written(usable.select("doc_id", _text_key(F.col("text")).alias("text_key")), "near-texts")
    groups = written(texts.groupBy("text_key").agg(F.min("doc_id").alias("original")), "near-originals")
    found = written(candidates(usable, threshold).distinct(), "near-candidates")
    # a pair stands for the originals of its texts, so equal texts are compared once
    names = texts.join(groups.withColumnRenamed("text_key", "tk"), F.col("text_key") == F.col("tk")).where("doc_id <> original").groupBy("doc_id").agg(F.min("original").alias("original"))
    names = written(names.select(F.col("doc_id").alias("nd"), "original"), "near-names")
    for side in ("doc_id", "leader"):
        found = found.join(names, F.col(side) == F.col("nd"), "left").withColumn(side, F.coalesce("original", side)).drop("nd", "original")
    pairs = found.where("doc_id <> leader").groupBy(F.greatest("doc_id", "leader").alias("doc_id"), F.least("doc_id", "leader").alias("leader")).agg(F.max("linked").alias("linked"))
    pairs = written(pairs, "near-pairs")
    labels = _connected(pairs, usable, threshold)
    # every text's class first (one row a text), then its documents
    named = groups.join(labels, F.col("original") == F.col("cn"), "left").select(F.col("text_key").alias("tk"), F.coalesce("label", "original").alias("class_id"))
    return texts.join(named, F.col("text_key") == F.col("tk")).select("doc_id", "text_key", "class_id")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id and class_id, the smallest doc_id of its class."""
    own = F.col("doc_id").cast("long")
    alone = docs.where(own.isNull() | F.col("text").isNull()).select(own.alias("doc_id"), own.alias("class_id"))
    return _classified(docs, threshold).select("doc_id", "class_id").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id.

    Of rows equal in doc_id and text the first by its JSON form stays; several texts under one doc_id stay each, so no
    text is lost. Rows without a doc_id or text stay as they are.
    """
    found = written(_classified(docs, threshold), "near-classes")
    gone = written(found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")).distinct(), "near-gone")
    twice = written(found.groupBy(F.col("doc_id").alias("__twice"), F.col("text_key").alias("__twice_key")).count().where("count > 1").drop("count"), "near-twice")
    key = _text_key(F.col("text"))
    own = lambda d, k: (F.col("doc_id") == F.col(d)) & (key == F.col(k))
    left = docs.join(gone, own("__gone", "__gone_key"), "left_anti")
    if twice.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = left.join(twice, own("__twice", "__twice_key"), "left_semi").groupBy("doc_id", key.alias("__k")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return left.join(twice, own("__twice", "__twice_key"), "left_anti").unionByName(repeated.select("__row.*"))
