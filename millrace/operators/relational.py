"""Relational operators that are more than one DataFrame call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 500


def similar_to(c: Column, pattern: str) -> Column:
    """SIMILAR TO / GLOB style match: the whole value must match the regular expression."""
    return c.rlike(f"^(?:{pattern})$")


def shaped_cell(c: Column, limit: int = CELL) -> Column:
    """Text cut after `limit` characters, with three dots where something was cut."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def capped(df: DataFrame, cap: int) -> tuple[list, bool]:
    """At most `cap` rows, and whether there were more: cap + 1 rows are fetched and no more."""
    rows = df.limit(cap + 1).collect()
    return rows[:cap], len(rows) > cap


def keyset_page(df: DataFrame, keys: list[str], cursor: list[Column] | None, limit: int) -> DataFrame:
    """The next limit + 1 rows after the cursor in descending order of keys; the one more says that there is a next page."""
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for k, c in zip(keys, cursor, strict=True):
            after, equal = after | (equal & (F.col(k) < c)), equal & (F.col(k) == c)
        df = df.where(after)
    return df.orderBy(*[F.desc(k) for k in keys]).limit(limit + 1)


def name_search(names: DataFrame, term: str, limit: int) -> DataFrame:
    """(kind, name) that contain the term whatever its case: equal ones first, then those that start with it, then the rest."""
    low, t = F.lower("name"), term.lower()
    rank = F.when(low == t, 0).when(low.startswith(t), 1).otherwise(2)
    return names.where(low.contains(t)).select("kind", "name", rank.alias("rank")).orderBy("rank", "name", "kind").limit(limit)


def undirected(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, confidence) merged whichever way they point, with the best confidence."""
    return pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


def identity_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, how): equal names first; of the rest, names that are equal but for case and unique on both sides."""
    a, b = left.select(F.col("id").alias("left_id"), F.col("name").alias("an")), right.select(F.col("id").alias("right_id"), F.col("name").alias("bn"))
    exact = a.join(b, F.col("an") == F.col("bn")).select("left_id", "right_id")
    one = lambda d, i, n: d.groupBy(F.lower(n).alias("fold" + i[:1])).agg(F.min(i).alias(i), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    rest_a, rest_b = a.join(exact, "left_id", "left_anti"), b.join(exact, "right_id", "left_anti")
    fold = one(rest_a, "left_id", "an").join(one(rest_b, "right_id", "bn"), F.col("foldl") == F.col("foldr")).select("left_id", "right_id")
    return exact.withColumn("how", F.lit("exact")).unionByName(fold.withColumn("how", F.lit("fold")))


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate with partial results instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(ranked.alias("__row")).select(*keys, "__row.*")
