"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_TEXT = "the onwh thonre"


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text", F.col("lang").alias("language"), F.col("source").alias("file_id"), F.array("lang", "source").alias("tags"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding", F.col("label").alias("file_id"), F.when(F.col("label") % 3 == 0, "m2").otherwise("m1").alias("model"))


def _probe(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_COS = f"{_DOT} / ({_NORM.format('a')} * {_NORM.format('b')})"


@query(f"SELECT a.vec_id AS passage_id, round({_COS}, 6) AS signal FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {_COS} DESC, a.vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return search.vector_rank(_vectors(spark, sf_dir), _probe(spark, sf_dir)).select("passage_id", F.round("signal", 6).alias("signal"))


_BM25 = (
    "WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS words FROM documents), l AS (SELECT doc_id, len(words) AS len, words FROM d), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l), "
    "e AS (SELECT doc_id, len, unnest(words) AS w FROM l), t AS (SELECT doc_id, len, w, count(*) AS tf FROM e WHERE w IN ('the', 'onwh', 'thonre') GROUP BY 1, 2, 3), f AS (SELECT w, count(*) AS df FROM t GROUP BY w), "
    "r AS (SELECT doc_id AS passage_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS signal FROM t JOIN f ON t.w = f.w CROSS JOIN s GROUP BY doc_id)"
)


@query(f"{_BM25} SELECT passage_id, round(signal, 6) AS signal FROM r ORDER BY r.signal DESC, passage_id LIMIT 20")
def text_search_or_terms(spark, sf_dir):
    return search.text_rank(_passages(spark, sf_dir), _TEXT).select("passage_id", F.round("signal", 6).alias("signal"))


@query(
    f"{_BM25}, tx AS (SELECT passage_id, signal, row_number() OVER (ORDER BY signal DESC, passage_id) - 1 AS position FROM r ORDER BY signal DESC, passage_id LIMIT 20), "
    f"vx AS (SELECT passage_id, signal, row_number() OVER (ORDER BY signal DESC, passage_id) - 1 AS position FROM (SELECT a.vec_id AS passage_id, {_COS} AS signal FROM embeddings a, embeddings b WHERE b.vec_id = 0) ORDER BY signal DESC, passage_id LIMIT 20), "
    "u AS (SELECT passage_id, 1.0 / (60 + position + 1) AS part, signal >= 0.01 AS good FROM tx UNION ALL SELECT passage_id, 0.8 / (60 + position + 1), signal >= 0.3 FROM vx) SELECT passage_id, round(sum(part), 6) AS score FROM u GROUP BY passage_id HAVING max(good)"
)
def rrf_fusion(spark, sf_dir):
    text, vector = search.text_rank(_passages(spark, sf_dir), _TEXT), search.vector_rank(_vectors(spark, sf_dir), _probe(spark, sf_dir))
    return search.fuse([(text, 1.0, search.TEXT_FLOOR), (vector, 0.8, search.COSINE_FLOOR)]).select("passage_id", F.round("score", 6).alias("score"))


@query(
    f"{_BM25}, tx AS (SELECT passage_id, signal, row_number() OVER (ORDER BY signal DESC, passage_id) - 1 AS position FROM r ORDER BY signal DESC, passage_id LIMIT 20), "
    f"vx AS (SELECT passage_id, signal, row_number() OVER (ORDER BY signal DESC, passage_id) - 1 AS position FROM (SELECT a.vec_id AS passage_id, {_COS} AS signal FROM embeddings a, embeddings b WHERE b.vec_id = 0) ORDER BY signal DESC, passage_id LIMIT 20), "
    "u AS (SELECT passage_id, 1.0 / (60 + position + 1) AS part, signal >= 0.01 AS good FROM tx UNION ALL SELECT passage_id, 0.8 / (60 + position + 1), signal >= 0.3 FROM vx), fu AS (SELECT passage_id, sum(part) AS score FROM u GROUP BY passage_id HAVING max(good)) "
    "SELECT 'text' AS stage, passage_id, position, round(signal, 6) AS value FROM tx UNION ALL SELECT 'vector', passage_id, position, round(signal, 6) FROM vx UNION ALL SELECT 'fused', passage_id, row_number() OVER (ORDER BY score DESC, passage_id) - 1, round(score, 6) FROM fu"
)
def stage_trace(spark, sf_dir):
    """What each stage of a hybrid search ranked, and where."""
    text, vector = search.text_rank(_passages(spark, sf_dir), _TEXT), search.vector_rank(_vectors(spark, sf_dir), _probe(spark, sf_dir))
    fused = search.fuse([(text, 1.0, search.TEXT_FLOOR), (vector, 0.8, search.COSINE_FLOOR)])
    return search.stage_trace({"text": text, "vector": vector, "fused": fused}).withColumn("value", F.round("value", 6))


@query(
    "WITH g AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem WHERE l_linenumber % 3 = 2), h AS (SELECT c, min(l_linenumber - 1) AS first FROM lineitem JOIN g ON l_orderkey = c AND l_partkey = p WHERE l_linenumber > 1 GROUP BY c), a AS (SELECT DISTINCT c FROM g) "
    "SELECT avg(CASE WHEN first < 3 THEN 1.0 ELSE 0.0 END) AS recall, avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 / (first + 1) END) AS mrr FROM a LEFT JOIN h USING (c)"
)
def retrieval_metrics_of_orders(spark, sf_dir):
    """Every order is a case whose parts were found in the order of its lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("passage_id"), (F.col("l_linenumber") - 1).alias("position"))
    return search.retrieval_metrics(lines.where("position > 0"), lines.where("position % 3 = 1").select("case_id", "passage_id").distinct())


@query(
    "WITH RECURSIVE p AS (SELECT doc_id AS passage, source AS file_id, lang AS section, n_chars / 1000.0 AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30), s AS (SELECT max(score) AS top FROM p), "
    "c(place, i, taken) AS (SELECT 0, 1::BIGINT, [1::BIGINT] UNION ALL SELECT place + 1, b.i, list_append(taken, b.i) FROM c, LATERAL (SELECT p.i FROM p, s WHERE NOT list_contains(c.taken, p.i) ORDER BY 0.7 * p.score / s.top - 0.3 * (SELECT max(CASE WHEN q.file_id <> p.file_id THEN 0.0 WHEN q.section IS NOT DISTINCT FROM p.section THEN 1.0 ELSE 0.3 END) FROM p q WHERE list_contains(c.taken, q.i)) DESC, p.i LIMIT 1) b WHERE place < 9) "
    "SELECT place, passage FROM c JOIN p ON c.i = p.i"
)
def mmr_documents(spark, sf_dir):
    """The ten documents that relevance (here: length) against novelty takes from the thirty longest."""
    docs = table(spark, sf_dir, "documents").select((F.col("n_chars") / 1000.0).alias("score"), F.col("doc_id").alias("passage"), F.col("source").alias("file_id"), F.col("lang").alias("section"))
    return search.diversify(docs, 10).select("place", "passage")


@query("SELECT source AS file_id, doc_id % 4 AS parent_id, min(doc_id) AS passage_id FROM documents GROUP BY 1, 2")
def best_per_parent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select(F.col("doc_id").alias("passage_id"), (F.lit(1.0) / (F.col("doc_id") + 1)).alias("score"))
    parents = docs.select(F.col("doc_id").alias("passage_id"), F.col("source").alias("file_id"), (F.col("doc_id") % 4).alias("parent_id"))
    return search.best_per_parent(ranked, parents).select("file_id", "parent_id", "passage_id")


@query("SELECT doc_id AS passage_id FROM documents WHERE lang = 'en' AND list_contains([lang, source], 'src3')")
def metadata_filter(spark, sf_dir):
    return search.filtered(_passages(spark, sf_dir), tag="src3", language="en").select("passage_id")


@query("SELECT label AS file_id, count(*) AS total, count(embedding) AS embedded, count(*) FILTER (WHERE embedding IS NULL OR label % 3 = 0) AS stale FROM embeddings GROUP BY label")
def embedding_staleness(spark, sf_dir):
    return search.staleness(_vectors(spark, sf_dir), "m1")


@query("SELECT p_partkey AS passage_id, regexp_matches(p_name, '(^|[^A-Za-z0-9_-])(red|large)($|[^A-Za-z0-9_-])', 'i') AS exact, row_number() OVER (ORDER BY regexp_matches(p_name, '(^|[^A-Za-z0-9_-])(red|large)($|[^A-Za-z0-9_-])', 'i') DESC, p_partkey) - 1 AS place FROM part")
def exact_promotion(spark, sf_dir):
    """All parts, those first that hold one of two identifiers as written."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("passage_id"), F.col("p_name").alias("text"))
    ranked = parts.select("passage_id", F.lit(1.0).alias("score"))
    found = search.promoted(ranked, parts, ["red", "large"]).select("passage_id", "exact")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("exact"), "passage_id")) - 1)


_PLACES = (
    "WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS words FROM documents), p AS (SELECT doc_id, pos, words[pos] AS w FROM d, range(1, len(words) + 1) x(pos)), "
    "e AS (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS pos2 FROM p WHERE w IN ('of', 'the')), "
    "ph AS (SELECT doc_id, max(w = 'of' AND w2 IS NOT DISTINCT FROM 'the' AND pos2 = pos + 1) AS phrase FROM e GROUP BY doc_id)"
)


@query(
    f"{_PLACES}, r AS (SELECT e.doc_id, any_value(phrase) AS phrase, 0.1 * count(*) AS signal FROM e JOIN ph ON e.doc_id = ph.doc_id GROUP BY 1) SELECT doc_id AS passage_id, phrase, round(signal, 6) AS signal, row_number() OVER (ORDER BY phrase DESC, r.signal DESC, doc_id) - 1 AS position FROM r ORDER BY phrase DESC, r.signal DESC, doc_id LIMIT 20"
)
def cover_density_any(spark, sf_dir):
    """Documents that hold either of two words, those that hold them as a phrase first."""
    return search.cover_rank(_passages(spark, sf_dir), "of the", stemmed=False).select("passage_id", "phrase", F.round("signal", 6).alias("signal"), "position")


@query(
    f"{_PLACES}, l AS (SELECT *, least(max(i) FILTER (w = 'of') OVER t, max(i) FILTER (w = 'the') OVER t) AS b, max(i) FILTER (w = 'of') OVER t + max(i) FILTER (w = 'the') OVER t AS pair FROM e WINDOW t AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT doc_id, b, min(i) AS i FROM l WHERE pair IS NOT NULL GROUP BY doc_id, b), s AS (SELECT c.doc_id, sum(0.1 / (1 + (z.pos - a.pos) - (c.i - c.b))) AS signal FROM c JOIN e a ON c.doc_id = a.doc_id AND c.b = a.i JOIN e z ON c.doc_id = z.doc_id AND c.i = z.i GROUP BY c.doc_id) "
    "SELECT s.doc_id AS passage_id, phrase, round(signal, 6) AS signal FROM s JOIN ph ON s.doc_id = ph.doc_id ORDER BY phrase DESC, s.signal DESC, s.doc_id LIMIT 20"
)
def cover_density_all(spark, sf_dir):
    """Documents that hold both words, by the density of the shortest stretches that do."""
    return search.cover_rank(_passages(spark, sf_dir), "of the", match="all", stemmed=False).select("passage_id", "phrase", F.round("signal", 6).alias("signal"))


@query()
def semantic_chunks(spark, sf_dir):
    """Passages cut where neighbouring sentences stop being alike, sentences being counted words."""
    return search.chunked(table(spark, sf_dir, "documents"), embed=search.bag_of_words())


@query()
def chunk_documents(spark, sf_dir):
    return search.chunked(table(spark, sf_dir, "documents"))


_KINDS = "SELECT 'document' AS kind, source AS name FROM documents GROUP BY source UNION ALL SELECT 'table', p_brand FROM part GROUP BY p_brand UNION ALL SELECT 'kpi', r_name FROM region"


@query(f"WITH k AS ({_KINDS}), r AS (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) AS rn FROM k WHERE contains(lower(name), '1') OR contains(lower(name), 'a')) SELECT kind, name FROM r WHERE rn <= 5")
def workspace_search(spark, sf_dir):
    """Names of every kind that hold a term, a few of each kind."""
    parts = [table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct() for t, c, kind in (("documents", "source", "document"), ("part", "p_brand", "table"), ("region", "r_name", "kpi"))]
    hit = [p.where(F.lower("name").contains("1") | F.lower("name").contains("a")).orderBy("name").limit(5) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), hit)


_RANKED = (
    "w AS (SELECT p_name || '_' || p_partkey AS name, list_distinct(list_transform(list_filter(string_split_regex(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+'), lambda x: length(x) > 2), lambda x: CASE WHEN x LIKE '%s' AND length(x) > 3 THEN left(x, length(x) - 1) ELSE x END)) AS n, "
    "list_distinct(list_transform(list_filter(string_split_regex(lower(p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda x: length(x) > 2), lambda x: CASE WHEN x LIKE '%s' AND length(x) > 3 THEN left(x, length(x) - 1) ELSE x END)) AS d FROM part), q AS (SELECT unnest(['small', 'brand', 'red', 'part']) AS q), "
    "f AS (SELECT q, count(*) AS df, (SELECT count(*) FROM w) AS total FROM w JOIN q ON list_contains(n, q) OR list_contains(d, q) GROUP BY q), s AS (SELECT name, sum(sqrt(ln(1 + (total - df + 0.5) / (df + 0.5))) * (3 * list_contains(n, f.q)::INT + list_contains(d, f.q)::INT)) AS score FROM w JOIN f ON list_contains(n, f.q) OR list_contains(d, f.q) GROUP BY name)"
)


@query(f"WITH {_RANKED} SELECT w.name, round(coalesce(score, 0), 6) AS score FROM w LEFT JOIN s ON w.name = s.name")
def idf_rank_of_parts(spark, sf_dir):
    """All parts ranked by the words of a question in their names and descriptions."""
    items = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_name", "p_partkey").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("description"))
    return search.idf_rank(items, "small brands, red parts?").select("name", F.round("score", 6).alias("score"))


@query(
    "WITH l AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p, l_linenumber - 1 AS position FROM lineitem), g AS (SELECT DISTINCT c, p FROM l WHERE position % 3 < 2), x AS (SELECT DISTINCT c, p FROM l WHERE p % 3 = 0), "
    "j AS (SELECT x.c, bool_and((x.c, x.p) IN (SELECT (c, p) FROM l WHERE position < 3) AND (x.c, x.p) IN (SELECT (c, p) FROM g)) AS good FROM x GROUP BY x.c) SELECT avg(CASE WHEN coalesce(good, FALSE) THEN 1.0 ELSE 0.0 END) AS correctness FROM (SELECT DISTINCT c FROM g) a LEFT JOIN j ON a.c = j.c"
)
def citations_of_orders(spark, sf_dir):
    """Every order is a case whose answer cites those of its parts that three divides."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("passage_id"), (F.col("l_linenumber") - 1).alias("position")).distinct()
    return search.citation_correctness(lines.where("passage_id % 3 = 0"), lines, lines.where("position % 3 < 2"))
