"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the k-th of n rows stands at (k - 1/2) / n. Sorting all
rows by that fraction interleaves the sources in proportion everywhere, so equal cuts of the order give shards that differ
by one row at most and hold every source in its share of the whole.

No rank needs one task for a source: the hash (and then the fraction) is cut into about sqrt(n) equal cells, rows are
numbered within their cell, and the cells' counts are summed up separately. A source with a third of the rows has a third
of the cells.

Defined cases: a null text has no bytes and the checksum of nothing (0); a null source is a source of its own; rows equal
in doc_id, source and text are interchangeable and get consecutive ranks; an empty table gives an empty result; further
columns are carried, but for columns named shard or slot, which the result's replace; names starting with two underscores are
reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._spark import uniform, written


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds __at: the row's 1-based rank within keys[:-1] by the cell keys[-1], then by order."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"{k}__r") for k in keys], F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__before"))
    within = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return within.join(starts, on, "inner").withColumn("__at", F.col("__before") + F.col("__in")).drop("__in", "__before", *[f"{k}__r" for k in keys])


def checksum(text) -> F.Column:
    """CRC-32 of the text's UTF-8 bytes, unsigned; of nothing for null."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def assign(docs: DataFrame, tie: str, shards: int = 24, seed: int = 29) -> DataFrame:
    """docs (doc_id, source, tie, ...) with shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    Counts differ by one at most. tie tells rows with one doc_id apart. All columns of docs are shuffled twice, so it is
    meant for a few short ones.
    """
    docs = docs.drop("shard", "slot")
    u = uniform(F.lit(seed), "doc_id", F.col("source").cast("string"), tie)
    stats = docs.groupBy(F.col("source").cast("string").alias("__src")).agg(F.count(F.lit(1)).alias("__n_s"))
    stats = written(stats.coalesce(1), "shard-sources")
    n = stats.agg(F.sum("__n_s")).first()[0] or 0
    cells = max(1, 4 * int(n**0.5))
    rows = docs.withColumn("__u", u).withColumn("__own", F.col("source").cast("string"))
    rows = rows.join(stats, F.col("__own").eqNullSafe(F.col("__src")), "inner").drop("__src")
    # a source has cells in proportion to its rows, so all cells hold about as many
    own_cells = F.greatest(F.lit(1), F.ceil(F.col("__n_s") * F.lit(cells) / F.lit(max(1, n))))
    rows = rows.withColumn("__cell", F.floor(F.col("__u") * own_cells))
    rows = _numbered(rows, ["__own", "__cell"], ["__u", "doc_id"])
    rows = rows.withColumn("__f", (F.col("__at") - 0.5) / F.col("__n_s")).drop("__at", "__n_s", "__cell")
    rows = rows.withColumn("__cell", F.least(F.lit(cells - 1), F.floor(F.col("__f") * cells)))
    rows = _numbered(rows, ["__cell"], ["__f", "__own", "__u", "doc_id"])
    at, size = F.col("__at") - 1, F.lit(max(1, n))
    number = F.floor(at * shards / size)
    first = F.ceil(number * size / F.lit(shards))  # the first position that floors to this shard
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], number.cast("int").alias("shard"), (at - first).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 29) -> DataFrame:
    """docs (doc_id, source, text, ...) with shard and slot, as assign() gives them.

    Places are worked out on short columns; the texts are shuffled once, to meet them. Rows that agree in doc_id, source
    and text are numbered on both sides and meet one to one.
    """
    docs = docs.drop("shard", "slot")
    same = F.xxhash64("doc_id", F.col("source").cast("string"), checksum(F.col("text")))
    slim = docs.select("doc_id", "source", checksum(F.col("text")).alias("__tie"), same.alias("__same"))
    placed = assign(slim, "__tie", shards, seed)
    nth = F.row_number().over(Window.partitionBy("__same").orderBy("shard", "slot"))
    placed = placed.select(F.col("__same").alias("__k"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), nth.alias("__j"))
    rows = docs.withColumn("__same", same).withColumn("__i", F.row_number().over(Window.partitionBy("__same").orderBy("__same")))
    # the number is compared as a range, so the join stays on the key that the texts are already dealt by
    met = rows.join(placed, (F.col("__same") == F.col("__k")) & (F.col("__i") >= F.col("__j")) & (F.col("__i") <= F.col("__j")))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
