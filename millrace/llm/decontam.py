"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least `threshold` of its distinct five-word shingles are in the document. Long
documents hold short items, so Jaccard similarity says nothing; containment is searched from the item's side. Items are
partitioned by size (doubling classes of their shingle count). An item's sketch is its m minimum shingle hashes, and m comes
from the upper bound b of its partition: m = b - ceil(threshold * b) + 1. At most q - ceil(threshold * q) of an item's q
shingles may be missing, so by the pigeonhole principle a document that contains it holds one of its m minimum hashes: the
search loses nothing, and the sketch is about a fifth of the item. A partition differs from others only in m and in the
shingles a document must have, so all are searched in one pass over the documents, each entry with its partition's need:
partitions searched one by one would read the documents once for each and find the same. Every shingle hash of every document probes the sketches;
documents with fewer shingles than an item of the partition needs are passed over. The hits are verified by counting exact
shingles, as text, in the documents hit.

Words are runs of letters and digits in the lower-cased text, so case and punctuation do not hide an item.

Defined cases: null or wordless texts and items, and items of fewer than five words, match nothing; rows with one doc_id
(or one item_id) are taken together as one document (item); an empty table gives an empty result; further columns are
ignored by the search and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._spark import written

SHINGLE = 5
THRESHOLD = 0.8
_SEPARATORS = r"[^\p{L}\p{N}]+"


def _words(text) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")


def _with(value, body) -> F.Column:
    """body(value), with value computed once a row: a bare reference inside a lambda would be computed at every step."""
    return F.transform(F.array(value), body)[0]


def _starts(words) -> F.Column:
    """1, 2, ... for each shingle of words; none where there are fewer than five."""
    return F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _hash_of(hashes, i) -> F.Column:
    return F.xxhash64(*[F.element_at(hashes, i + k) for k in range(SHINGLE)])


def _hashes(text) -> F.Column:
    """A hash of every shingle, made from the hashes of its words."""
    words = F.transform(_words(text), lambda w: F.xxhash64(w))
    return _with(words, lambda hs: F.transform(_starts(hs), lambda i: _hash_of(hs, i)))


def _shingles(text) -> F.Column:
    return _with(_words(text), lambda ws: F.array_distinct(F.transform(_starts(ws), lambda i: F.array_join(F.slice(ws, i, SHINGLE), " "))))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingle, n_item): the distinct shingles of each item, and how many it has."""
    each = items.select("item_id", F.explode(_shingles(F.col("text"))).alias("shingle")).distinct()
    sizes = each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    return each.join(sizes.withColumnRenamed("item_id", "__i"), F.col("item_id").eqNullSafe(F.col("__i"))).drop("__i")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, hash, need): the m minimum hashes of each item; m follows from the size partition's upper bound."""
    bound = F.pow(F.lit(2), F.ceil(F.log2("n_item")))
    m = bound - F.ceil(bound * F.lit(threshold) - F.lit(1e-9)) + 1
    hashed = shingles.withColumn("hash", _with(F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w)), lambda hs: _hash_of(hs, F.lit(1))))
    ranked = hashed.withColumn("__r", F.row_number().over(Window.partitionBy("item_id").orderBy("hash")))
    return ranked.where(F.col("__r") <= m).select("item_id", "hash", F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).alias("need"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item that a document contains."""
    shingles = written(item_shingles(items), "bench-shingles")
    index = written(sketches(shingles, threshold), "bench-sketches")  # its true size picks the join
    hashed = docs.select("doc_id", F.explode(F.array(_hashes(F.col("text")))).alias("hashes"))
    probes = hashed.select("doc_id", F.size("hashes").alias("n_doc"), F.explode("hashes").alias("probe"))
    hits = probes.join(index, (F.col("probe") == F.col("hash")) & (F.col("n_doc") >= F.col("need")))
    found = written(hits.select(F.col("doc_id").alias("__d")).distinct(), "bench-hits")
    held = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
    held = held.select("doc_id", F.explode(_shingles(F.col("text"))).alias("held"))
    shared = held.join(shingles, F.col("held") == F.col("shingle")).select("doc_id", "item_id", "n_item", "held").distinct()
    counted = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).withColumn(
        "containment", F.round(F.col("n_shared") / F.col("n_item"), 6)
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contain an item."""
    bad = written(contained(docs, items, threshold).select(F.col("doc_id").alias("__d")).distinct(), "bench-bad")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti")
