"""Small helpers the corpus operators share: where intermediate tables go, and how wide to shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import prepare, stored

__all__ = ["WORD", "discarded", "prepare", "uniform", "width", "word_count", "written"]

#: A word, wherever a contract speaks of words: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Writes a DataFrame once to the shared folder and returns it read back: it cuts the lineage like checkpoint() and survives
#: lost executors, but stays columnar, so later reads prune columns, and Spark knows the true size when it picks a join.
written = stored


def width(spark: SparkSession) -> int:
    """Shuffle width of this session, used as the number of buckets that packed rows are dealt to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def word_count(text) -> F.Column:
    """Words of a text as long; null counts none. The text is never split: removed separators only delimit runs."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols) -> F.Column:
    """A number in [0, 1) that depends on the values alone, so reruns and recomputed tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def discarded(table: DataFrame) -> None:
    """Delete a table that written() gave, once nothing will read it again: what was made from it must be written itself."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
