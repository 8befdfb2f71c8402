"""Hybrid retrieval: text ranking, vector ranking, rank fusion, collapse to parents, diversity, promotion, metrics.

Text is ranked by the density of covers of the query's terms, with exact names and phrases first, or by BM25.
"""

from __future__ import annotations

import math
import re
import textwrap
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import stem
from millrace.functions.validators import normalised
from millrace.session import stored

# Fixed values of the fusion: rank constant, floors of the raw signals, weight of relevance against novelty, likeness of two
# sections of one document.
RRF, TEXT_FLOOR, COSINE_FLOOR, MMR, SAME_DOCUMENT, POOL = 60, 0.01, 0.3, 0.7, 0.3, 20


def terms(c: Column) -> Column:
    """Words of letters, digits and underscores, normalised."""
    return F.filter(F.split(normalised(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def text_rank(passages: DataFrame, query: str, k: int = POOL, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(passage_id, signal, position) of the k best passages by BM25 over any of the query's words.

    The texts are read once: each passage's length and its counts of the query's words are written as one narrow row, from
    which the number of passages, their mean length and the document frequencies come as one aggregate, a single row.
    """
    spark = passages.sparkSession
    wanted = sorted(set(spark.range(1).select(terms(F.lit(query)).alias("t")).first()["t"]))
    if not wanted:
        return passages.select("passage_id", F.lit(0.0).alias("signal"), F.lit(0).cast("long").alias("position")).limit(0)
    count = lambda words, w: F.size(F.filter(words, lambda x: x == F.lit(w)))
    read = passages.select("passage_id", terms(F.col("text")).alias("words"))
    rows = stored(read.select("passage_id", F.size("words").alias("len"), *[count(F.col("words"), w).alias(f"t{i}") for i, w in enumerate(wanted)]), "text-rank")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))]).first()
    signal = F.lit(0.0)
    for i in range(len(wanted)):
        idf = math.log(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5))
        tf = F.col(f"t{i}")
        signal = signal + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"] or 1.0)))
    hit = F.greatest(F.lit(0), *[F.col(f"t{i}") for i in range(len(wanted))]) > 0
    return _positions(rows.where(hit).select("passage_id", signal.alias("signal")), k)


# Fixed value: what a term without a label of its own weighs in a cover.
COVER_WEIGHT = 0.1


def _postings(words: Column, wanted: list[str], stemmed: bool) -> Column:
    """The places of the wanted terms among words, in order: an array of (pos, t), t being the term's number from 1.

    Only words that begin like a wanted stem are stemmed at all: stems keep the first two letters, but for Arabic words.
    """
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("w")))
    if stemmed:
        like = lambda x: F.left(x["w"], F.lit(2)).isin(sorted({w[:2] for w in wanted})) | x["w"].rlike("^[ء-ي]")
        placed = F.transform(F.filter(placed, like), lambda x: F.struct(x["pos"].alias("pos"), stem(x["w"]).alias("w")))
    known = F.array(*[F.lit(w) for w in wanted])
    kept = F.filter(placed, lambda x: x["w"].isin(wanted))
    return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), F.array_position(known, x["w"]).cast("int").alias("t")))


def _covers(found: Column, terms_: int) -> Column:
    """The summed density of all shortest stretches that hold each of the terms, by one sweep over their merged places.

    The sweep keeps the latest place of each term. The earliest of these begins the shortest stretch that ends at the present
    place; it is new if it begins behind the stretch before it. A stretch weighs COVER_WEIGHT over one plus its other words.
    """
    nowhere = F.array(*[F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("pos")) for _ in range(terms_)])
    start = F.struct(nowhere.alias("seen"), F.lit(-1).alias("begin"), F.lit(0.0).alias("density"))

    def step(state, x):
        seen = F.transform(state["seen"], lambda s, j: F.when(j + 1 == x["t"], F.struct(x["i"].alias("i"), x["pos"].alias("pos"))).otherwise(s))
        first = F.array_min(seen)
        new = first["i"] > state["begin"]
        others = (x["pos"] - first["pos"]) - (x["i"] - first["i"])
        density = state["density"] + F.when(new, F.lit(COVER_WEIGHT) / (1 + others)).otherwise(0.0)
        return F.struct(seen.alias("seen"), F.greatest(state["begin"], first["i"]).alias("begin"), density.alias("density"))

    return F.aggregate(F.transform(found, lambda x, i: F.struct(i.alias("i"), x["pos"].alias("pos"), x["t"].alias("t"))), start, step)["density"]


def cover_rank(passages: DataFrame, query: str, match: str = "any", stemmed: bool = True, k: int = POOL) -> DataFrame:
    """(passage_id, identifier, phrase, signal, position) of the k first passages that hold any, or all, of the query's terms.

    Passages that hold one of the query's identifiers (a word with an underscore or a digit) come first, then those with its
    words in order and adjacent, then by the density of the query's covers; ties by passage_id. If any term will do, each of
    its places is a cover by itself; if all must be there, covers are the shortest stretches that hold them all. The texts
    are read once, and only the places of the query's words are kept and written.
    """
    if match not in ("any", "all"):
        raise ValueError("match is any or all")
    named = lambda c: F.transform(terms(c), stem) if stemmed else terms(c)
    asked = passages.sparkSession.range(1).select(named(F.lit(query)).alias("t")).first()["t"]
    wanted = list(dict.fromkeys(asked))
    if not wanted:
        return passages.select("passage_id", F.lit(False).alias("identifier"), F.lit(False).alias("phrase"), F.lit(0.0).alias("signal"), F.lit(0).cast("long").alias("position")).limit(0)
    # written once: what follows names the places several times, and each time would read the texts again
    found = stored(passages.select("passage_id", _postings(terms(F.col("text")), wanted, stemmed).alias("found")), "cover-places")
    names = [i + 1 for i, w in enumerate(wanted) if "_" in w or any(ch.isdigit() for ch in w)]
    order = [wanted.index(w) + 1 for w in asked]

    def follows(e, i):
        """Whether the query's words stand here, one after the other; they are neighbours among the found places then."""
        here = F.lit(True)
        for n, t in enumerate(order):
            x = F.get("found", i + n)
            here = here & F.coalesce((x["t"] == t) & (x["pos"] == e["pos"] + n), F.lit(False))
        return here

    identifier = F.exists("found", lambda x: x["t"].isin(names)) if names else F.lit(False)
    phrase = F.exists(F.transform("found", follows), lambda x: x) if len(order) > 1 else F.lit(False)
    signal = F.size("found") * F.lit(COVER_WEIGHT) if match == "any" else _covers(F.col("found"), len(wanted))
    ranked = found.where(F.size("found") > 0).select("passage_id", identifier.alias("identifier"), phrase.alias("phrase"), signal.alias("signal")).where("signal > 0")
    by = [F.desc("identifier"), F.desc("phrase"), F.desc("signal"), F.col("passage_id")]
    return ranked.orderBy(*by).limit(k).withColumn("position", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))  # k rows


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_rank(passages: DataFrame, query: list[float], model: str | None = None, k: int = POOL) -> DataFrame:
    """(passage_id, signal, position) of the k nearest passages by exact cosine; only vectors of the same model and length."""
    q = F.lit([float(x) for x in query])
    fit = passages.where(F.size("embedding") == len(query))
    if model is not None:
        fit = fit.where(F.col("model") == model)
    return _positions(fit.select("passage_id", cosine(F.col("embedding"), q).alias("signal")).where("signal IS NOT NULL"), k)


def _positions(scored: DataFrame, k: int) -> DataFrame:
    top = scored.orderBy(F.desc("signal"), "passage_id").limit(k)
    return top.withColumn("position", (F.row_number().over(Window.orderBy(F.desc("signal"), "passage_id")) - 1).cast("long"))  # k rows


def fuse(rankings: list[tuple[DataFrame, float, float]]) -> DataFrame:
    """(passage_id, score) of weighted reciprocal ranks; rankings are (ranking, weight, floor).

    A passage counts when its raw signal reaches the floor in one ranking at least.
    """
    parts = [r.select("passage_id", (F.lit(w) / (RRF + F.col("position") + 1)).alias("part"), (F.col("signal") >= floor).alias("good")) for r, w, floor in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("passage_id").agg(F.sum("part").alias("score"), F.max("good").alias("good")).where("good").select("passage_id", "score").orderBy(F.desc("score"), "passage_id")


def stage_trace(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, passage_id, position, value) of the rankings that a search went through, each (passage_id, signal or score)."""
    parts = []
    for name, df in stages.items():
        value = F.col("signal" if "signal" in df.columns else "score")
        place = F.row_number().over(Window.orderBy(F.desc("v"), "passage_id")) - 1  # a pool of some dozens
        parts.append(df.select("passage_id", value.alias("v")).select(F.lit(name).alias("stage"), "passage_id", place.cast("long").alias("position"), F.col("v").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def best_per_parent(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """The best passage of each parent (passage_id, file_id, parent_id): by score, then id."""
    p = parents.select(F.col("passage_id").alias("pp"), "file_id", "parent_id")
    return ranked.join(p, F.col("passage_id") == F.col("pp")).groupBy("file_id", "parent_id").agg(F.min_by(F.struct("passage_id", "score"), F.struct(-F.col("score"), "passage_id")).alias("b")).select("b.passage_id", "b.score", "file_id", "parent_id")


def diversify(ranked: DataFrame, limit: int, weight: float = MMR, pool: int = 30) -> DataFrame:
    """ranked (score, file_id, section and others) with `place`: the `limit` rows that maximal marginal relevance takes.

    The best `pool` rows are one array, of bounded size, and each step of a fold over it takes the row with the most of
    weight x relevance - (1 - weight) x likeness to what has been taken; earlier rows win ties. Relevance is the score
    moved to start at zero and divided by the pool's largest; likeness is 1 in one section of a file, SAME_DOCUMENT in one
    file, else 0.
    """
    best = ranked.orderBy(F.desc("score"), *[c for c in ranked.columns if c != "score"]).limit(pool)
    row = F.struct((-F.col("score")).alias("by"), F.struct(*[F.col(c) for c in ranked.columns]).alias("row"))
    rows = best.agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["row"]).alias("rows"))
    low = F.least(F.lit(0.0), F.array_min(F.transform("rows", lambda r: r["score"])))
    most = F.array_max(F.transform("rows", lambda r: r["score"])) - low
    rows = rows.withColumns({"low": low, "span": F.when(most == 0, F.lit(1.0)).otherwise(most)})
    kind = rows.schema["rows"].dataType.simpleString()

    def alike(a, b):
        return F.when(~a["file_id"].eqNullSafe(b["file_id"]), F.lit(0.0)).when(a["section"].eqNullSafe(b["section"]), F.lit(1.0)).otherwise(F.lit(SAME_DOCUMENT))

    def take(taken, _):
        gain = lambda r: F.lit(weight) * (r["score"] - F.col("low")) / F.col("span") - F.lit(1 - weight) * F.coalesce(F.array_max(F.transform(taken, lambda t: alike(r, t["row"]))), F.lit(0.0))
        left = F.filter(F.transform("rows", lambda r, i: F.struct(gain(r).alias("gain"), (-i).alias("i"), r.alias("row"))), lambda x: ~F.exists(taken, lambda t: t["i"] == x["i"]))
        best_one = F.array_max(F.transform(left, lambda x: F.struct(x["gain"].alias("gain"), x["i"].alias("i"))))
        return F.concat(taken, F.filter(left, lambda x: x["i"] == best_one["i"]))

    nothing = F.expr(f"cast(array() as array<struct<gain:double,i:int,row:{kind.removeprefix('array<')[:-1]}>>)")
    chosen = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(limit), F.size("rows"))), nothing, take)
    return rows.where(F.size("rows") > 0).select(F.posexplode(chosen).alias("place", "c")).select("place", "c.row.*")


def promoted(ranked: DataFrame, texts: DataFrame, identifiers: list[str]) -> DataFrame:
    """ranked with passages first that hold one of the identifiers as written; otherwise in the same order."""
    pattern = "|".join(rf"(?<![\w-]){re.escape(i)}(?![\w-])" for i in identifiers) or "(?!)"
    t = texts.select(F.col("passage_id").alias("tp"), F.col("text").rlike(f"(?i){pattern}").alias("exact"))
    return ranked.join(t, F.col("passage_id") == F.col("tp")).drop("tp").orderBy(F.desc("exact"), F.desc("score"), "passage_id")


def filtered(passages: DataFrame, tag: str | None = None, **equal) -> DataFrame:
    """Passages whose metadata columns equal the given values and whose tags hold the given one."""
    for c, v in equal.items():
        passages = passages.where(F.col(c) == v)
    return passages.where(F.array_contains("tags", tag)) if tag is not None else passages


def staleness(passages: DataFrame, model: str) -> DataFrame:
    """(file_id, total, embedded, stale): passages with a vector, and those whose vector is of another model or missing."""
    stale = F.col("embedding").isNull() | ~F.col("model").eqNullSafe(F.lit(model))
    return passages.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("embedded"), F.count_if(stale).alias("stale"))


def retrieval_metrics(results: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """One row (recall, mrr) of results (case_id, passage_id, position from 0) against gold (case_id, passage_id)."""
    g = gold.select(F.col("case_id").alias("gc"), F.col("passage_id").alias("gp"))
    hit = results.join(g, (F.col("case_id") == F.col("gc")) & (F.col("passage_id") == F.col("gp"))).groupBy("gc").agg(F.min("position").alias("first"))
    per = gold.select("case_id").distinct().join(hit, F.col("case_id") == F.col("gc"), "left")
    return per.agg(F.avg(F.when(F.col("first") < k, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(F.col("first").isNotNull(), 1.0 / (F.col("first") + 1)).otherwise(0.0)).alias("mrr"))


def citation_correctness(cited: DataFrame, results: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """One row (correctness): the share of the cases of gold (case_id, passage_id) whose answers cite passages (case_id,
    passage_id), at least one, and only such as are among the first k results (case_id, passage_id, position from 0) and gold."""
    pair = lambda df, a, b: df.select(F.col("case_id").alias(a), F.col("passage_id").alias(b)).distinct()
    c = cited.select("case_id", "passage_id").distinct()
    met = c.join(pair(results.where(F.col("position") < k), "rc", "rp"), (F.col("case_id") == F.col("rc")) & (F.col("passage_id") == F.col("rp")), "left")
    met = met.join(pair(gold, "gc", "gp"), (F.col("case_id") == F.col("gc")) & (F.col("passage_id") == F.col("gp")), "left")
    good = met.groupBy(F.col("case_id").alias("c")).agg(F.min(F.col("rc").isNotNull() & F.col("gc").isNotNull()).alias("good"))
    per = gold.select("case_id").distinct().join(good, F.col("case_id") == F.col("c"), "left")
    return per.agg(F.avg(F.when(F.coalesce("good", F.lit(False)), 1.0).otherwise(0.0)).alias("correctness"))


def idf_rank(items: DataFrame, query: str, name_weight: int = 3) -> DataFrame:
    """(name, score) of items (name, description) by damped idf of the query's words; words in names count threefold."""
    words = lambda c: F.array_distinct(F.transform(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2), lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.left(w, F.length(w) - 1)).otherwise(w)))
    q = items.sparkSession.range(1).select(F.explode(words(F.lit(query))).alias("q"))
    tagged = items.select("name", words(F.regexp_replace("name", "_", " ")).alias("in_name"), words(F.col("description")).alias("in_text"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    hits = tagged.select("name", F.explode(F.array_union("in_name", "in_text")).alias("w"), "in_name", "in_text").join(q, F.col("w") == F.col("q"))
    df = hits.groupBy(F.col("w").alias("dw")).agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, F.col("w") == F.col("dw")).crossJoin(n)
    weight = F.sqrt(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = weight * (name_weight * F.array_contains("in_name", F.col("w")).cast("int") + F.array_contains("in_text", F.col("w")).cast("int"))
    return items.select("name").join(scored.groupBy(F.col("name").alias("sn")).agg(F.sum(part).alias("score")), F.col("name") == F.col("sn"), "left").select("name", F.coalesce("score", F.lit(0.0)).alias("score"))


# Tokens of a passage and of its parent (aimed at, at most), and tokens that neighbouring passages share.
CHILD, PARENT, OVERLAP = (250, 375), (1000, 1500), 40
_HEADING = re.compile(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*$")
_TABLE = re.compile(r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|[ \t:|-]*-[ \t:|-]*\|[ \t]*(?:\n[ \t]*\|.*\|[ \t]*)*")
_FINER = (r"\n\s*\n", r"\n", r"(?<=[.!?؟])\s+")
# Fixed value: neighbouring sentences less alike than this belong to different passages.
SAME_TOPIC = 0.5
_SENTENCE = re.compile(r"(?<=[.!?؟])\s+|\n+")

#: Texts to as many vectors, in one call for many texts.
Embedder = Callable[[list[str]], np.ndarray]


def tokens(text: str) -> int:
    """An estimate of a text's tokens: four characters make one."""
    return -(-len(text) // 4)


def _units(text: str, most: int) -> list[str]:
    """A text in pieces of at most `most` tokens: cut at paragraphs, what is too long at lines, then sentences, then words."""
    pieces = [text.strip()]
    for separator in _FINER:
        pieces = [x.strip() for p in pieces for x in ([p] if tokens(p) <= most else re.split(separator, p))]
    return [x for p in pieces if p for x in ([p] if tokens(p) <= most else textwrap.wrap(p, 4 * most))]


def _rows(table: str, most: int) -> list[str]:
    """A table in texts of at most `most` tokens, each with the header; a row that is too long is cut."""
    head, rule, *body = [line.strip() for line in table.splitlines()]
    header = f"{head}\n{rule}"
    room = most - tokens(header) - 1
    if room < 1:
        return _units(table, most)
    out, at = [], ""
    for row in (x for line in body for x in ([line] if tokens(line) <= room else textwrap.wrap(line, 4 * room))):
        if at and tokens(f"{at}\n{row}") > room:
            out.append(f"{header}\n{at}")
            at = ""
        at = f"{at}\n{row}" if at else row
    return [*out, f"{header}\n{at}"] if at else out


def _sections(text: str):
    """(heading, page, text) of each stretch under one heading on one page; a page goes on with the heading before it."""
    heading, paged = None, "\f" in text
    for number, page in enumerate(text.split("\f"), 1):
        marks = list(_HEADING.finditer(page))
        for m, until in zip([None, *marks], [*(x.start() for x in marks), len(page)], strict=True):
            heading = m[1] if m else heading
            yield heading, number if paged else None, page[m.end() if m else 0 : until]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s.strip()]


class Topics:
    """Cuts prose where neighbouring sentences stop being alike, by the vectors that an embedder gives.

    Vectors are asked for in lots of LOT sentences and kept until forget(), so that some documents together need few calls. An
    embedder that returns another number of vectors than it was given sentences is not used: cut() then gives the text whole.
    """

    LOT = 4096

    def __init__(self, embed: Embedder):
        self.embed, self.known = embed, {}

    def learn(self, texts: list[str]) -> None:
        new = [s for s in dict.fromkeys(texts) if s not in self.known]
        for lot in (new[i : i + self.LOT] for i in range(0, len(new), self.LOT)):
            vectors = np.asarray(self.embed(lot), np.float64)
            if len(vectors) == len(lot):
                self.known.update(zip(lot, vectors, strict=True))

    def forget(self) -> None:
        self.known.clear()

    def cut(self, prose: str) -> list[str]:
        parts = sentences(prose)
        self.learn(parts)
        if len(parts) < 2 or any(s not in self.known for s in parts):
            return [prose]
        v = np.stack([self.known[s] for s in parts])
        size = np.sqrt((v * v).sum(1))
        both = size[:-1] * size[1:]
        alike = np.divide((v[:-1] * v[1:]).sum(1), both, out=np.zeros(len(both)), where=both > 0)
        starts = [0, *(np.flatnonzero(alike < SAME_TOPIC) + 1).tolist(), len(parts)]
        return [" ".join(parts[lo:hi]) for lo, hi in zip(starts, starts[1:], strict=False)]


def passages(text: str, aim: int, most: int, overlap: int = 0, topics: Topics | None = None) -> list[tuple[str | None, int | None, str]]:
    """(heading, page, passage) of a text, in order: about `aim` tokens each and never more than `most`.

    A passage never crosses a page, a heading or a table; tables stand alone, split by rows under a repeated header. With
    topics it never crosses a change of topic either. Prose passages of one stretch share their last `overlap` tokens, as
    whole words, with the next, but for those on two sides of a change of topic.
    """
    out = []
    for heading, page, part in _sections(text):
        at = 0
        tables = [(m.start(), m.end(), m[0]) for m in _TABLE.finditer(part)]
        for start, end, table in [*tables, (len(part), len(part), None)]:
            for block in topics.cut(part[at:start]) if topics else [part[at:start]]:
                now = ""
                for unit in _units(block, min(aim, most - overlap)):
                    if now and tokens(f"{now}\n\n{unit}") > aim:
                        out.append((heading, page, now))
                        tail = now[-4 * overlap :].partition(" ")[2] if overlap else ""
                        now = tail if tail and tokens(f"{tail}\n\n{unit}") <= most else ""
                    now = f"{now}\n\n{unit}" if now else unit
                if now:
                    out.append((heading, page, now))
            if table:
                out += [(heading, page, x) for x in _rows(table, most)]
            at = end
    return out


#: Characters of passages and their parents that a task holds before it gives them on.
_GIVEN = 4_000_000


def _lots(docs, topics: Topics | None):
    """docs (id, text) in lists whose sentences, a lot of them or a document's, the topics have learnt and no others."""
    lot, new = [], {}
    for doc in docs:
        lot.append(doc)
        if topics and doc[1]:
            new |= dict.fromkeys(s for _, _, part in _sections(doc[1]) for prose in _TABLE.split(part) for s in sentences(prose))
        if len(new) >= Topics.LOT or len(lot) >= Topics.LOT:
            if topics:
                topics.forget()
                topics.learn(list(new))
            yield lot
            lot, new = [], {}
    if topics:
        topics.forget()
        topics.learn(list(new))
    yield lot


def chunked(docs: DataFrame, child: tuple[int, int] = CHILD, parent: tuple[int, int] = PARENT, overlap: int = OVERLAP, embed: Embedder | None = None) -> DataFrame:
    """(doc_id, parent, chunk, section, page, text, parent_text): passages to embed, cut from larger parents of about 1 000 tokens.

    section is the heading, or "Part n" by the parent's number where there is none; page is null in texts without page breaks.
    With an embedder (a function that can be sent to tasks), parents also end where the topic changes; a task asks it for the
    sentences of some documents at once, Topics.LOT or those of a single document, and holds no more vectors than these.
    """

    def cut(batches):
        topics = Topics(embed) if embed else None
        for pdf in batches:
            rows, size, names = [], 0, ["doc_id", "parent", "chunk", "section", "page", "text", "parent_text"]
            for lot in _lots(zip(pdf["doc_id"], pdf["text"], strict=True), topics):
                for doc_id, text in lot:
                    n = 0
                    for p, (heading, page, whole) in enumerate(passages(text or "", *parent, topics=topics)):
                        for _, _, piece in passages(whole, *child, overlap):
                            rows.append((doc_id, p, n, heading or f"Part {p + 1}", page, piece, whole))
                            n, size = n + 1, size + len(piece) + len(whole)
                            if size > _GIVEN:
                                yield pd.DataFrame(rows, columns=names).astype({"page": "Int32"})
                                rows, size = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, parent int, chunk int, section string, page int, text string, parent_text string")


def bag_of_words(dims: int = 512) -> Embedder:
    """An embedder without a model: each word adds one to the place that its hash picks."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                row[zlib.crc32(word.encode()) % dims] += 1
        return out

    return embed
