"""Personal-data queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import validators as V
from millrace.operators import privacy
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query("SELECT c_custkey, sha256('pepper' || c_name) AS name_hash FROM customer")
def hash_customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", V.pseudonym(F.col("c_name"), "pepper").alias("name_hash"))


@query("SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[masked]' END AS customer_name, c_mktsegment FROM customer")
def mask_by_rule(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer_name"), "c_mktsegment")
    return privacy.masked_by_name(named)[0]


_J = r"[\s\-().\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]"
_MAIL = r"[\p{L}\p{N}_.%+\-]+@[\p{L}\p{N}](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}])?)*\.\p{L}{2,}"
_IBAN = rf"(?:^|[^A-Za-z0-9])[Ss][Aa](?:{_J}?[0-9A-Za-z]){{22}}(?:$|[^A-Za-z0-9])"
_FOUR = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:$|\.(?:$|[^0-9]))"
_NUMBERS = rf"\+?\p{{Nd}}(?:{_J}?\p{{Nd}}){{8,}}"
_MOD_97 = "list_reduce(list_prepend(0, list_transform(string_split(substr(i, 5) || substr(i, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, d: (a * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97) = 1"
_SUM = "list_sum(list_transform(range(length(d)), lambda i: CAST(d[length(d) - i] AS INTEGER) * (1 + i % 2) - CASE WHEN CAST(d[length(d) - i] AS INTEGER) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"


def _each(source: str, keys: str, pattern: str, shown: str) -> str:
    """Texts of source with each match h of the pattern, which needs no context, shown otherwise."""
    shown = re.sub(r"\bh\b", "z[2]", shown)
    return f"SELECT {keys}, array_to_string(list_transform(list_zip(string_split_regex(text, '{pattern}'), list_append(regexp_extract_all(text, '{pattern}'), '')), lambda z: z[1] || CASE WHEN z[2] = '' THEN '' ELSE {shown} END), '') AS text FROM {source}"


def redact_steps(source: str, keys: str) -> tuple[list[str], str]:
    """Common table expressions that redact the texts of source, kept with its keys, and the last one's name.

    Addresses are judged as whole tokens; numbers as a walk over all windows of their groups.
    """
    k = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    own = lambda t: ", ".join(f"{t}.{c}" for c in k)
    core = "regexp_extract(h, '[Ss][Aa].*[0-9A-Za-z]', 0, 's')"
    iban = f"CASE WHEN {_MOD_97.replace('substr(i,', f'substr(upper(regexp_replace({core}, {chr(39)}{_J}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})),')} AND regexp_matches(upper(regexp_replace({core}, '{_J}', '', 'g')), '^SA[0-9]{{2}}[0-9A-Z]{{20}}$') THEN replace(h, {core}, '[redacted: iban]') ELSE h END"
    dotted = "regexp_extract(h, '^(?:[0-9]{1,3}\\.){3}[0-9]{1,3}')"
    four = f"CASE WHEN regexp_matches(h, '{_FOUR}') AND list_max(list_transform(string_split({dotted}, '.'), lambda x: CASE WHEN x LIKE '0_%' THEN 999 ELSE CAST(x AS INTEGER) END)) <= 255 THEN '[redacted: ip_address]' || substr(h, length({dotted}) + 1) ELSE h END"
    six = "CASE WHEN regexp_matches(h, '^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$') AND (regexp_matches(h, '^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$') OR (length(h) - length(replace(h, '::', '')) = 2 AND NOT contains(h, ':::') AND NOT regexp_matches(h, '^:[^:]|[^:]:$'))) THEN '[redacted: ip_address]' ELSE h END"
    rule = f"CASE WHEN regexp_matches(d, '^1[0-9]{{9}}$') AND {_SUM} THEN 'national_id' WHEN regexp_matches(d, '^2[0-9]{{9}}$') AND {_SUM} THEN 'iqama' WHEN regexp_matches(d, '^(?:0|(?:\\+|00)?966)5[0-9]{{8}}$') THEN 'phone' WHEN regexp_matches(d, '^[0-9]{{13,19}}$') AND {_SUM} AND replace(d, left(d, 1), '') <> '' THEN 'card_number' END"
    return [
        f"s0 AS (SELECT {keys}, regexp_replace(text, '{_MAIL}', '[redacted: email]', 'g') AS text FROM {source})",
        f"s1 AS ({_each('s0', keys, _IBAN, iban)})",
        f"s2 AS ({_each('s1', keys, r'[\p{L}\p{N}_.]+', four)})",
        f"s3 AS MATERIALIZED ({_each('s2', keys, r'[\p{L}\p{N}_:]+', six)})",
        f"run AS (SELECT {keys}, n, run, regexp_extract_all(run, '\\+?\\p{{Nd}}+') AS g, string_split_regex(run, '\\+?\\p{{Nd}}+') AS b FROM (SELECT {keys}, generate_subscripts(r, 1) AS n, unnest(r) AS run FROM (SELECT {keys}, regexp_extract_all(text, '{_NUMBERS}') AS r FROM s3)))",
        f"win AS (SELECT {keys}, n, i, j, array_to_string(g[i:j], '') AS d FROM run, range(1, len(g) + 1) x(i), range(i, least(i + 19, len(g) + 1)) y(j))",
        f"fit AS (SELECT {keys}, n, i, max(j) AS j, arg_max(rule, j) AS rule FROM (SELECT {keys}, n, i, j, {rule} AS rule FROM win WHERE length(d) BETWEEN 9 AND 20) WHERE rule IS NOT NULL GROUP BY ALL)",
        f"walk AS (WITH RECURSIVE w AS (SELECT {keys}, n, 1 AS at FROM run UNION ALL SELECT {own('w')}, w.n, CAST(coalesce(f.j + 1, w.at + 1) AS INTEGER) FROM w JOIN run r ON {on('w', 'r')} AND w.n = r.n LEFT JOIN fit f ON {on('w', 'f')} AND w.n = f.n AND w.at = f.i WHERE w.at <= len(r.g)) SELECT * FROM w)",
        f"done AS (SELECT {own('r')}, r.n, string_agg(r.b[w.at] || CASE WHEN w.at > len(r.g) THEN '' WHEN f.rule IS NOT NULL THEN '[redacted: ' || f.rule || ']' ELSE r.g[w.at] END, '' ORDER BY w.at) AS run FROM walk w JOIN run r ON {on('w', 'r')} AND w.n = r.n LEFT JOIN fit f ON {on('w', 'f')} AND w.n = f.n AND w.at = f.i GROUP BY {own('r')}, r.n)",
        f"all_runs AS (SELECT {keys}, list(run ORDER BY n) AS runs FROM done GROUP BY {keys})",
        f"s4 AS (SELECT {own('s')}, CASE WHEN a.runs IS NULL THEN s.text ELSE array_to_string(list_transform(list_zip(string_split_regex(s.text, '{_NUMBERS}'), list_append(a.runs, '')), lambda z: z[1] || z[2]), '') END AS text FROM s3 s LEFT JOIN all_runs a ON {on('s', 'a')})",
    ], "s4"


_STEPS, _AT = redact_steps("documents", "doc_id")


@query(f"WITH {', '.join(_STEPS)} SELECT doc_id, md5(text) AS redacted FROM {_AT}")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(privacy.redacted(F.col("text"))).alias("redacted"))


@query(f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents) SELECT doc_id, v AS value FROM m")
def extract_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))).alias("value"))


_CARDS = "SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 7919 AS VARCHAR), 15, '0') AS v FROM orders"
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(v, i, 1) AS INTEGER) ELSE CASE WHEN CAST(substr(v, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(v, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(v, i, 1) AS INTEGER) * 2 END END)) % 10 = 0"


@query(f"WITH c AS ({_CARDS}) SELECT o_orderkey FROM c WHERE {_LUHN}")
def luhn_valid(spark, sf_dir):
    v = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 15, "0"))
    return table(spark, sf_dir, "orders").where(V.card_number(v)).select("o_orderkey")


@query(
    "WITH i AS (SELECT c_custkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS k, lpad(CAST(c_custkey * 31 AS VARCHAR), 18, '0') AS acc FROM customer) "
    "SELECT c_custkey FROM i WHERE CAST('80' || acc || '2810' || k AS HUGEINT) % 97 = 1"
)
def iban_valid(spark, sf_dir):
    """SA + two check digits + 80 + account: which of the customers' keys happen to be right check digits."""
    c = table(spark, sf_dir, "customer")
    iban = F.concat(F.lit("SA"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("80"), F.lpad((F.col("c_custkey") * 31).cast("string"), 18, "0"))
    return c.where(V.iban(iban)).select("c_custkey")


_RULES = "[" + ", ".join(f"'{r}'" for r in V.VALIDATORS) + "]"
_VALID_EMAIL = r"regexp_full_match(v, '[\w.%+\-]+@[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)*\.[^\W\d_]{2,}')"


@query(
    f"WITH m AS (SELECT unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE {_VALID_EMAIL}) AS hits FROM m), r AS (SELECT unnest({_RULES}) AS rule), c AS (SELECT unnest(['contact', 'note']) AS column_name), "
    "x AS (SELECT column_name, rule, CASE WHEN column_name = 'contact' AND rule = 'email' THEN hits ELSE 0 END AS matched, total FROM c, r, n) SELECT *, CASE WHEN total > 0 THEN matched / total ELSE 0.0 END::DOUBLE AS ratio FROM x"
)
def pii_value_scan(spark, sf_dir):
    emails = extract_emails(spark, sf_dir).select(F.col("value").alias("contact"), F.lit("-").alias("note"))
    return privacy.value_scan(emails)


@query("SELECT 'contact' AS column_name, 'email' AS rule, 'direct_identifier' AS category, 'value' AS source, 1.0::DOUBLE AS confidence")
def pii_value_findings(spark, sf_dir):
    return privacy.value_findings(pii_value_scan(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN 'en' END AS script FROM documents")
def script_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.script_language(F.col("text")).alias("script"))


_KNOWN = "o AS (SELECT c_custkey AS c, ['email', 'phone', 'iban'][c_custkey % 3 + 1] AS rule, (c_custkey % 10) / 10.0 AS conf, ['suggested', 'accepted', 'rejected'][c_nationkey % 3 + 1] AS status FROM customer WHERE c_custkey % 4 > 0), n AS (SELECT c_custkey AS c, ['email', 'phone'][c_custkey % 2 + 1] AS rule, (c_custkey % 7) / 7.0 AS conf FROM customer WHERE c_custkey % 5 > 0)"


@query(
    f"WITH {_KNOWN}, j AS (SELECT coalesce(o.c, n.c) AS c, o.rule AS o_rule, o.conf AS o_conf, status, n.rule AS n_rule, n.conf AS n_conf, coalesce(n.conf > coalesce(o.conf, -1), FALSE) AS up FROM o FULL JOIN n ON o.c = n.c) SELECT c AS column_name, "
    "CASE WHEN status IS NULL OR (status <> 'accepted' AND up) THEN n_rule ELSE o_rule END AS rule, CAST(greatest(o_conf, n_conf) AS DOUBLE) AS confidence, CASE WHEN status IS NULL OR (status = 'rejected' AND n_rule IS NOT NULL AND (n_rule <> o_rule OR up)) THEN 'suggested' ELSE status END AS status FROM j"
)
def finding_upsert_of_customers(spark, sf_dir):
    """Findings of most customers merged with a new scan of others."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    old = c.where(k % 4 > 0).select(k.alias("column_name"), pick(("email", "phone", "iban"), k % 3).alias("rule"), ((k % 10) / 10.0).alias("confidence"), pick(("suggested", "accepted", "rejected"), F.col("c_nationkey") % 3).alias("status"))
    return privacy.merged_findings(old, c.where(k % 5 > 0).select(k.alias("column_name"), pick(("email", "phone"), k % 2).alias("rule"), ((k % 7) / 7.0).alias("confidence")))
