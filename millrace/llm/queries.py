"""The corpus operators as registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, lattice, lm, mixing, neardup, negatives, pii, quantize, sharding, substrings, urls, warc
from millrace.llm._spark import written
from millrace.session import table as _table

URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix."""
    rows = written(mixing.sized(_table(spark, sf_dir, "documents")), "mix-rows")
    each = mixing.shared(rows, written(mixing.copies(rows), "mix-copies"))
    source = F.col("__source_size").alias("source_size"), F.col("__target").alias("target")
    return each.select("doc_id", "size", *source, (F.col("size") * F.col("__c")).alias("taken"), "source", F.col("__c").alias("copies"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target model counts documents labelled good and not toxic."""
    labels = _table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0")
    return lm.score(_table(spark, sf_dir, "documents"), labels.select("doc_id"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(_table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with a containment of 0.8 or more."""
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL
), ds AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), b AS (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL
), bs AS (
    SELECT DISTINCT item_id, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS i FROM b WHERE len(words) >= 5)
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
shared AS (
    SELECT ds.doc_id, bs.item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.shingle = bs.shingle GROUP BY ds.doc_id, bs.item_id
)
SELECT s.doc_id, s.item_id, n.n_item, s.n_shared, round(s.n_shared / n.n_item, 6) AS containment
FROM shared s JOIN n ON s.item_id = n.item_id WHERE s.n_shared >= n.n_item * 0.8 - 1e-9
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    slim = docs.select("doc_id", "source", size.alias("size"), sharding.checksum(F.col("text")).alias("text_crc32"))
    out = sharding.assign(slim, "text_crc32", shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives it was written to."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
h AS (SELECT html, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
    CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id 50 divides, a seventh of the labels being moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("label")
    return negatives.mine(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, eight parts of sixteen entries after six rounds."""
    return quantize.compress(_table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 6) -> str:
    """The rounds written out one after another; each codebook is a small table of its own."""
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM v, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 16)",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, x.p, x, min(({distance}, e)) AS best FROM x JOIN b{k} b ON x.p = b.p GROUP BY ALL)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, best[2] AS e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS f FROM a{k}, range(1, 9) t(i) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY ALL)")
    sha = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {sha} AS codebooks_sha256 FROM r"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_lm_score": op2_lm_score,
        "op3_pii": op3_pii,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_decontamination": op5_decontamination,
        "op6_language": op6_language,
        "op7_substrings": op7_substrings,
        "op8_url_filter": op8_url_filter,
        "op9_vectors": op9_vectors,
        "op10_sharding": op10_sharding,
        "op11_warc": op11_warc,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins of the queries that SQL can express on whole tables."""
    return {"op5_decontamination": OP5_SQL, "op11_warc": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_codes": _op13_sql()}
