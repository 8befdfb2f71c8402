"""URL filter by a path-template tree.

Every host has a tree of path segments. Level by level, children that hold a fair share of their parent's pages, and not
just one or two of them, stay literal; all others are generalised to a wildcard of their shape (number, number with extension,
end of path, anything). Literal branches whose labelled share of bad pages does not differ from that of their labelled
siblings (a z test of one proportion against the pooled one) are merged. A leaf is a template.

Few hosts have labelled pages under every template, so the same trees are grown for each parent domain (the last two labels
of the host) and for all hosts together, and purity is smoothed down this line: one half, the pooled template's parent branch,
the pooled template, the domain's template, the host's template. Each is its labelled bad share with its predecessor counted
as `smooth` further pages. Thus labels decide most where they are, and a template that no label of its host reaches is
judged by what is known of its like elsewhere. A path with `least` labelled pages in its pooled branch and a purity of at
least `reject` is rejected.

A level is one aggregation with partial sums and one join with the literals kept, of which a parent has 1/share at most; the
literals are written first, so Spark knows their size: small tables are broadcast, and in a sorted join a host with a third of
the pages is one of the keys that adaptive execution splits. Levels end where nothing literal is left; what lies deeper is
generalised segment by segment.

Defined cases: a null url or one without "://" has an empty host and path; an empty table gives an empty result; equal
urls get equal verdicts; pages that no label speaks of are allowed; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url) -> F.Column:
    """From after the first :// to the next slash, question mark, hash or end; ASCII letters lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url) -> F.Column:
    """What follows the host, up to a question mark, hash or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_col, path_col, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest of the given (verdict, rule) that fits; nulls where none does.

    A rule is host/path; it fits its host and all subdomains when the path starts with the rule's. The list is a parameter,
    so it is short, and becomes one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):  # later ones stand further out, so longer ones win
        h, _, p = text.partition("/")
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _shape(segment) -> F.Column:
    return (
        F.when(segment.isNull(), F.lit("$"))
        .when(segment == "", F.lit("<end>"))
        .when(segment.rlike(r"^[0-9]+$"), F.lit("<n>"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("<n>."), F.lower(F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1))))
        .otherwise(F.lit("*"))
    )


def domain(host_col) -> F.Column:
    """The last two labels of a host, or all of it."""
    return F.substring_index(host_col, ".", -2)


def templates(pages: DataFrame, share: float = 0.02, least: int = 3, z: float = 2.0, support: int = 3) -> DataFrame:
    """(tree, path, template, n, labelled, bad) of each distinct tree and path in pages (tree, path, n, labelled, bad).

    share, support: the part of the parent's pages, and the pages, that keep a child literal. least: labelled pages below which
    a branch is not merged. Levels are gone down until one keeps no literal; all that is deeper goes by its shape.
    """
    rows = written(pages.groupBy("tree", "path").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]), "url-paths")  # every level reads it again
    rows = rows.withColumn("segments", F.split(F.regexp_replace("path", r"^/", ""), "/")).withColumn("template", F.lit(""))
    level = 0
    while True:
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        child = rows.where(F.col("segment").isNotNull() & (F.col("segment") != "")).groupBy("tree", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        parent = child.groupBy(F.col("tree").alias("pt"), F.col("template").alias("pp")).agg(F.sum("n").alias("n_all"))
        kept = child.join(parent, (F.col("tree") == F.col("pt")) & (F.col("template") == F.col("pp")))
        kept = kept.where((F.col("n") >= F.greatest(F.lit(support), F.col("n_all") * F.lit(share))) & ~F.col("segment").rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"))
        literals = kept.groupBy("tree", "template").agg(F.collect_list(F.struct("segment", "labelled", "bad")).alias("kept"))  # 1/share entries at most
        known = F.filter("kept", lambda k: k["labelled"] >= F.lit(least))
        total = F.aggregate(known, F.lit(0.0), lambda a, k: a + k["labelled"])
        literals = literals.withColumn("rate", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, k: a + k["bad"]), total))
        alike = F.filter(
            known,
            lambda k: F.abs(k["bad"] / k["labelled"] - F.col("rate")) <= F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / k["labelled"]) + F.lit(1e-12),
        )
        literals = literals.withColumn("alike", F.sort_array(F.transform(alike, lambda k: k["segment"])))
        literals = literals.select(F.col("tree").alias("lt"), F.col("template").alias("lp"), F.transform("kept", lambda k: k["segment"]).alias("kept"), "alike")
        literals = written(literals, f"url-level{level}")
        if literals.isEmpty():
            break
        rows = rows.join(literals, (F.col("tree") == F.col("lt")) & (F.col("template") == F.col("lp")), "left")
        merged = F.array_contains("alike", F.col("segment")) & (F.size("alike") > 1)
        token = F.when(merged, F.concat(F.lit("{"), F.array_join("alike", "|"), F.lit("}"))).when(F.array_contains("kept", F.col("segment")), F.col("segment"))
        step = F.concat(F.col("template"), F.lit("/"), F.coalesce(token, _shape(F.col("segment"))))
        rows = rows.withColumn("template", F.when(F.size("segments") < level + 1, F.col("template")).otherwise(step)).drop("lt", "lp", "kept", "alike")
        level += 1
        if level % 8 == 0:
            rows = written(rows, f"url-rows{level}")  # deep trees: the plan stays short
    deeper = F.transform(F.slice("segments", level + 1, F.greatest(F.lit(1), F.size("segments"))), lambda x: F.concat(F.lit("/"), _shape(x)))
    return rows.select("tree", "path", F.concat("template", F.array_join(deeper, "")).alias("template"), "n", "labelled", "bad")


def judged(pages: DataFrame, smooth: float = 1.0, reject: float = 0.9, least: int = 5, **tree) -> DataFrame:
    """(host, path, template, labelled, purity, rejected) of each distinct host and path in pages (host, path, label).

    label: 1 bad, 0 good, null unknown. labelled: the labelled pages of the pooled branch.
    """
    rows = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.sum(F.coalesce("label", F.lit(0)).cast("long")).alias("bad"))
    rows = written(rows, "url-hosts")
    names = [F.concat(F.lit("h:"), F.col("host")), F.concat(F.lit("d:"), domain(F.col("host"))), F.lit("a:")]
    leaves = written(templates(rows.select(F.explode(F.array(*names)).alias("tree"), "path", "n", "labelled", "bad"), **tree), "url-templates")
    sums = [F.sum("labelled").alias("l"), F.sum("bad").alias("b")]
    own = written(leaves.groupBy("tree", "template").agg(*sums), "url-purity")
    above = own.where("tree = 'a:'").groupBy(F.regexp_replace("template", r"/[^/]*$", "").alias("branch")).agg(F.sum("l").alias("l_up"), F.sum("b").alias("b_up"))
    out = rows.select("host", "path")
    for k, name in zip("hda", names, strict=True):
        place = leaves.where(F.col("tree").startswith(f"{k}:")).select(F.col("tree").alias("t1"), F.col("path").alias("p1"), F.col("template").alias("m1"))
        counts = own.select(F.col("tree").alias("t2"), F.col("template").alias("m2"), F.col("l").alias(f"l_{k}"), F.col("b").alias(f"b_{k}"))
        met = place.join(counts, (F.col("t1") == F.col("t2")) & (F.col("m1") == F.col("m2"))).drop("t2", "m2").withColumnRenamed("m1", f"m_{k}")
        out = out.join(met, (name == F.col("t1")) & (F.col("path") == F.col("p1"))).drop("t1", "p1")
    out = out.join(above, F.regexp_replace("m_a", r"/[^/]*$", "") == F.col("branch"))
    purity = F.lit(0.5)
    for k in ("up", "a", "d", "h"):
        purity = (F.col(f"b_{k}") + F.lit(smooth) * purity) / (F.col(f"l_{k}") + F.lit(smooth))
    out = out.withColumn("purity", purity)
    return out.select("host", "path", F.col("m_h").alias("template"), F.col("l_up").alias("labelled"), "purity", ((F.col("l_up") >= least) & (F.col("purity") >= reject)).alias("rejected"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], **params) -> DataFrame:
    """pages (page_id, url) with host, path, rule, template, purity and verdict.

    Pages under a rule take its verdict and are the trees' labelled pages; all others take their template's.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("ruled", ruled)
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("long"))
    tree = judged(parsed.select("host", "path", label.alias("label")), **params)
    tree = tree.select(F.col("host").alias("th"), F.col("path").alias("tp"), "template", "purity", "rejected")
    out = parsed.join(tree, (F.col("host") == F.col("th")) & (F.col("path") == F.col("tp")), "left")
    verdict = F.coalesce("ruled", F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
