"""Usage and run analytics over an event log of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, prompt, cached, completion) with cost in the model's currency; a model without a price gets null.

    Prices are a million tokens: input, cached_input, output. Cached tokens are never more than the prompt's. The price list
    is joined on the model without a hint; Spark broadcasts it while it is small.
    """
    p = prices.select(F.col("model").alias("__m"), "currency", "input", "cached_input", "output")
    cached = F.least("cached", "prompt")
    cost = ((F.col("prompt") - cached) * F.col("input") + cached * F.col("cached_input") + F.col("completion") * F.col("output")) / F.lit(1_000_000)
    return calls.join(p, F.col("model") == F.col("__m"), "left").withColumn("cost", cost).drop("__m", "input", "cached_input", "output")


def usage_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, failures, unpriced calls, tokens and cost for each key and currency. Unpriced calls are counted, not zeroed."""
    return calls.groupBy(*keys, "currency").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("failed")).alias("failed"), F.count_if(F.col("cost").isNull()).alias("unpriced"),
        F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum(F.col("cost").cast("decimal(30,10)")).cast("double").alias("cost"),
    )


def budget_used(calls: DataFrame, key: str, month_start, month_end) -> DataFrame:
    """Tokens of each key in the half-open month; keys without calls are left out."""
    inside = (F.col("ts") >= month_start) & (F.col("ts") < month_end)
    return calls.where(inside).groupBy(key).agg(F.coalesce(F.sum(F.col("prompt") + F.col("completion")), F.lit(0)).alias("tokens"))


def role_tokens(calls: DataFrame, key: str, role: str) -> DataFrame:
    """(key, total, by_role): tokens of each key with a map of its roles, most used key first."""
    per = calls.groupBy(key, role).agg(F.sum(F.col("prompt") + F.col("completion")).alias("t"))
    return per.groupBy(key).agg(F.sum("t").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(role, "t")))).alias("by_role")).orderBy(F.desc("total"), key)


def first_seen_between(calls: DataFrame, key: str, start, end) -> DataFrame:
    """Keys whose first call lies in the half-open range."""
    return calls.groupBy(key).agg(F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("calls")).where((F.col("first_seen") >= start) & (F.col("first_seen") < end))
