"""Queries on texts that leave or steer, word stems, names of columns, and the state of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import privacy, profile
from millrace.plans.base import Book
from millrace.plans.privacy import redact_steps
from millrace.plans.staging import catalog
from millrace.session import table

book = Book()
query = book.query


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(text, '(?im){_sql(p)}')" for p in X.INJECTIONS) + " AS steers FROM conversations")
def injection_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.instructs(F.col("text")).alias("steers"))


_QUOTED = f"q AS (SELECT conv_id, turn, regexp_replace(text, '{_sql(X.QUOTED)}', ' ', 'g') AS text FROM conversations)"
_STEPS, _AT = redact_steps("q", "conv_id, turn")
_BARE = "text"
for _p in X.VALUES:
    # DuckDB's patterns cannot look back, so what stands before a match is taken along and put back
    _before = _p.startswith(r"(?<![\w+])")
    _BARE = f"regexp_replace({_BARE}, '{_sql(_p.replace('(?<![', '(^|[^').replace('+])', '+])', 1)) if _before else _sql(_p)}', '{chr(92) + '1 ' if _before else ' '}', 'g')"


@query(
    f"WITH {_QUOTED}, {', '.join(_STEPS)}, b AS (SELECT conv_id, turn, {_BARE} AS text FROM {_AT}), w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+'), lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) <= {X.MOST_DIGITS}) AS words FROM b) "
    f"SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN md5(trim(substr(array_to_string(words, ' '), 1, {X.LONGEST}))) END AS query_hash FROM w"
)
def outbound_queries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.stripped(F.col("text"))).alias("query_hash"))


_PLURAL = "CASE WHEN regexp_matches(w, '^..+ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:sses|ches|shes|xes|zes)$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '(?:ss|us|is)$') THEN regexp_replace(w, 's$', '') ELSE w END"


@query(
    f"WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), p AS (SELECT w, {_PLURAL} AS p FROM d), r AS (SELECT w, p, regexp_extract(p, '^(..+?)(?:ing|ed)$', 1) AS r FROM p), "
    "v AS (SELECT w, CASE WHEN r <> '' AND regexp_matches(r, '[aeiou]') THEN CASE WHEN length(r) > 3 AND r[-1] = r[-2] AND r[-1] NOT IN ('l', 's', 'z', 'a', 'e', 'i', 'o', 'u') THEN left(r, length(r) - 1) ELSE r END ELSE p END AS v FROM r), "
    "y AS (SELECT w, CASE WHEN length(v) > 3 AND v LIKE '%y' THEN left(v, length(v) - 1) || 'i' ELSE v END AS y FROM v) SELECT w AS word, CASE WHEN length(w) <= 3 THEN regexp_replace(w, '^(..)e$', '\\1') WHEN length(y) >= 3 AND y LIKE '%e' THEN left(y, length(y) - 1) ELSE y END AS stem FROM y"
)
def word_stems(spark, sf_dir):
    """The stem of every word of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


@query(
    "WITH c AS (SELECT c_nationkey AS source, count(*) AS tables, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS documented, count(*) FILTER (WHERE c_acctbal > 0) AS profiled FROM customer GROUP BY 1), f AS (SELECT s_nationkey AS source, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS accepted, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS to_review FROM supplier GROUP BY 1) "
    "SELECT source, tables, CAST(round(100.0 * documented / tables) AS BIGINT) AS documented_pct, CAST(round(100.0 * profiled / tables) AS BIGINT) AS profiled_pct, coalesce(accepted, 0) AS accepted, coalesce(to_review, 0) AS to_review, "
    "CASE WHEN documented = 0 AND profiled = 0 AND coalesce(accepted, 0) + coalesce(to_review, 0) = 0 THEN 'not_started' WHEN documented = tables AND profiled = tables AND coalesce(to_review, 0) = 0 THEN 'complete' ELSE 'in_progress' END AS status FROM c LEFT JOIN f USING (source)"
)
def source_summaries(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tables = c.select(F.col("c_nationkey").alias("source"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("description"), (F.col("c_acctbal") > 0).alias("profiled"))
    status = F.element_at(F.array(F.lit("accepted"), F.lit("suggested"), F.lit("rejected")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return profile.source_summaries(tables, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), status.alias("status")))


@query()
def name_scan(spark, sf_dir):
    """Findings by the names of all columns of the tables, merged with what is known of them."""
    columns = catalog(spark, sf_dir).select("column_id", "column")
    known = spark.createDataFrame([("conversations.text", "address", 0.4, "rejected")], "column_name string, rule string, confidence double, status string")
    return privacy.merged_findings(known, privacy.name_scan(columns))


_JSON_STEPS, _JSON_AT = redact_steps("conversations", "conv_id, turn")


@query(f"WITH {', '.join(_JSON_STEPS)} SELECT conv_id, turn, md5(text) AS redacted FROM {_JSON_AT}")
def redacted_json_turns(spark, sf_dir):
    """Every turn as a JSON value with its text inside, redacted as JSON and read back."""
    c = table(spark, sf_dir, "conversations")
    made = F.to_json(F.struct("role", F.struct(F.array("text").alias("parts")).alias("body")))
    out = privacy.redacted_json(made, "role string, body struct<parts: array<string>>")
    return c.select("conv_id", "turn", F.md5(F.get_json_object(out, "$.body.parts[0]")).alias("redacted"))
