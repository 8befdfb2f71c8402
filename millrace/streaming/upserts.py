"""Upserts of micro-batches that take effect once, whatever is replayed.

A table is a folder of buckets, rows being dealt by a hash of their keys. A batch rewrites the buckets that its keys fall
into, as new files beside the old ones, and then adds one file to the ledger: the batch's number and where its buckets are
now. That file appears by one rename, which is the commit: before it readers see the old buckets, after it the new ones. A
batch whose number stands in the ledger is not applied again; one that was killed before its commit leaves files that
nothing refers to, and its replay writes them anew. One stream writes a table at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rows of the touched buckets as they are, rows of the batch) -> rows of these buckets as they shall be.
Merge = Callable[[DataFrame, DataFrame], DataFrame]

_LEDGER = "batch_id long, bucket int, path string"


def latest(keys: list[str], order: str) -> Merge:
    """Of each key's rows the one of largest `order`; of equal ones the one whose columns are largest."""

    def merge(now: DataFrame, batch: DataFrame) -> DataFrame:
        both = now.unionByName(batch)
        row = F.struct(*[F.col(c) for c in both.columns])
        return both.groupBy(*keys).agg(F.max_by(row, F.struct(order, row)).alias("r")).select("r.*")

    return merge


class KeyedTable:
    """A table under `root`, a folder that driver and executors share, with rows of `schema` dealt to buckets by `keys`."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], merge: Merge, buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.merge, self.buckets = spark, root.rstrip("/"), schema, keys, merge, buckets

    def ledger(self) -> DataFrame:
        """(batch_id, bucket, path) of all batches that took effect."""
        try:
            return self.spark.read.schema(_LEDGER).option("recursiveFileLookup", True).parquet(f"{self.root}/ledger")
        except AnalysisException as missing:  # no batch yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LEDGER)

    def applied(self, batch_id: int) -> bool:
        return not self.ledger().where(F.col("batch_id") == batch_id).isEmpty()

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        now = self.ledger().groupBy("bucket").agg(F.max_by("path", "batch_id").alias("path"))
        if only is not None:
            now = now.where(F.col("bucket").isin(only))
        paths = [r["path"] for r in now.collect() if r["path"]]  # as many rows as there are buckets, at most
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, batch: DataFrame, batch_id: int) -> list[tuple[int, int, str]]:
        """Rewrite the touched buckets beside the old ones; what to put into the ledger."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows = batch.select(*[F.col(c) for c in names])
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # no more than the buckets
        where = f"{self.root}/data/{batch_id}-{uuid.uuid4().hex}"
        merged = self.merge(self.read(touched), rows).select(*names)
        merged.withColumn("__bucket", self._bucket()).repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(where)
        kept = {r[0] for r in self.spark.read.parquet(where).select("__bucket").distinct().collect()} if touched else set()
        # a bucket that the merge left empty has no folder
        return [(batch_id, b, f"{where}/__bucket={b}" if b in kept else None) for b in touched] or [(batch_id, -1, None)]

    def commit(self, entries: list[tuple[int, int, str]]) -> None:
        """Make a batch take effect: one file, which Spark writes elsewhere and renames."""
        self.spark.createDataFrame(entries, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: apply the batch unless it has been applied."""
        if not self.applied(batch_id):
            self.commit(self.write(batch, batch_id))
