"""Personal data in tables: name rules, value scans, masking and hashing of columns, redaction of text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from millrace.functions import validators as V

# Limits of the value scan.
MIN_RATIO, MIN_VALUES, RECORD_FROM = 0.3, 3, 0.5

# What a column's name says about it, first match wins. Names are compared folded: letters and digits only,
# Arabic letter forms unified.
NAME_RULES = [
    ("national_id", "direct_identifier", 0.9, r"national(id|no|num|number)|nationalidnumber|citizen(id|no|number)|saudiid|^nin$|^natid$|^nid$|رقمالهويه|الهويهالوطنيه|رقممدني|الرقمالقومي|الرقمالوطني"),
    ("iqama", "direct_identifier", 0.9, r"iqama|iqamah|igama|residen(t|ce)(id|no|number|permit)|رقمالاقامه|اقامه"),
    ("hawiya", "direct_identifier", 0.85, r"hawiya|hawiyah|huwiya|huwiyah|hawwiya|هويه"),
    ("passport", "direct_identifier", 0.9, r"passport|jawazsafar|جوازالسفر|رقمجواز"),
    ("driver_license", "direct_identifier", 0.8, r"driv(er|ing)licen[cs]e|licen[cs]e(no|number)|رخصهالقياده|رخصهقياده"),
    ("phone", "direct_identifier", 0.8, r"jawal|jawwal|mobile|cellphone|cellular|phone|telephone|^tel$|^tel(no|num|number)$|gsm|msisdn|جوال|موبايل|هاتف|تليفون|رقمالتلفون|رقمالجوال"),
    ("email", "direct_identifier", 0.9, r"e?mail(address|addr)?$|^e?mail|ايميل|البريدالالكتروني|بريدالكتروني"),
    ("person_name", "direct_identifier", 0.7, r"(first|last|middle|full|family|father|mother|given|maiden)name|surname|^(fname|lname|mname)$|^(customer|employee|patient|client|beneficiary)name$|الاسمالكامل|الاسمالاول|الاسمالاخير|اسمالعائله|اسمالاب|اسمالام|اسمالعميل|اسمالموظف|اسمالمريض|اسمالمستفيد"),
    ("ip_address", "direct_identifier", 0.7, r"ipaddress|ipaddr|^ip$|clientip|عنوانip"),
    ("iban", "financial", 0.9, r"iban|ايبان"),
    ("card_number", "financial", 0.85, r"(credit|debit|payment|bank)?card(no|num|number)|creditcard|^pan$|ccnum|رقمالبطاقه|بطاقهائتمان|رقمالفيزا"),
    ("bank_account", "financial", 0.8, r"(bank)?acc(ount|t)(no|num|number)|bankaccount|رقمالحساب|حسابمصرفي|حسابالبنكي"),
    ("salary", "financial", 0.7, r"salary|salaries|wage|income|راتب|مرتب|الدخل"),
    ("religion", "sensitive", 0.85, r"religio|^sect$|sectarian|الديانه|الدين|مذهب"),
    ("health", "sensitive", 0.8, r"diagnos|medical|health|disease|illness|disabilit|bloodtype|bloodgroup|medication|فصيلهالدم|التشخيص|تشخيص|الحالهالصحيه|مرض|الصحي|صحيه"),
    ("biometric_genetic", "sensitive", 0.85, r"biometric|fingerprint|faceid|genetic|^dna$|بصمه|الحمضالنووي"),
    ("criminal_political", "sensitive", 0.8, r"criminal|conviction|politic|ethnic|^race$|سوابق|انتماءسياسي|عرق"),
    ("birth_date", "quasi_identifier", 0.85, r"birth(date|day|year)|dateofbirth|yearofbirth|^dob|^bdate|تاريخالميلاد|تاريخميلاد|الميلاد"),
    ("birth_place", "quasi_identifier", 0.7, r"birthplace|placeofbirth|مكانالميلاد"),
    ("nationality", "quasi_identifier", 0.7, r"nationality|citizenship|^jinsiya$|جنسيه"),
    ("gender", "quasi_identifier", 0.6, r"gender|^sex$|^jins$|^الجنس$|^جنس$|النوعالاجتماعي"),
    ("marital_status", "quasi_identifier", 0.6, r"marital|الحالهالاجتماعيه"),
    ("address", "quasi_identifier", 0.7, r"address|street|zipcode|postcode|postalcode|^zip$|^unnumber$|nationaladdress|العنوان|عنوان|شارع|الرمزالبريدي"),
    ("commercial_registration", "quasi_identifier", 0.6, r"commercialregist|^cr(no|num|number)$|السجلالتجاري"),
]


def folded_name(name: str) -> str:
    """A column name as the rules compare it; names are metadata, a few for a table, so this runs on the driver."""
    n = unicodedata.normalize("NFKC", name).lower().translate({0x623: 0x627, 0x625: 0x627, 0x622: 0x627, 0x671: 0x627, 0x649: 0x64A, 0x629: 0x647})
    return re.sub(r"[\W_]|[ً-ٰٟـ]", "", n)


# Categories of rules, and the limits of a rule of one's own.
CATEGORIES = ("direct_identifier", "financial", "sensitive", "quasi_identifier")
MAX_KEYWORDS, MAX_KEYWORD, MAX_PATTERN, LEAST_SURE = 20, 64, 200, 0.5
_RULE_NAME, _NESTED = re.compile(r"[a-z][a-z0-9_]{0,39}"), re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)\s*(?:[+*]|\{\d*,\d*\})")


def custom_rule(name: str, category: str, confidence: float, keywords: list[str] = (), pattern: str | None = None):
    """A rule of one's own: what name_rule() takes for its keywords, and a function of a column for its pattern, or nulls.

    Keywords are parts of folded column names; the pattern must fit a value whole, of MAX_LENGTH characters at most. A
    ValueError names the limit that a rule breaks: a pattern may not repeat what is repeated inside it, as (a+)+ does, which
    can take a match forever.
    """
    if not _RULE_NAME.fullmatch(name):
        raise ValueError("the name is 1 to 40 lower-case letters, digits and underscores, a letter first")
    if category not in CATEGORIES:
        raise ValueError(f"the category is one of {', '.join(CATEGORIES)}")
    if not LEAST_SURE <= confidence <= 1:
        raise ValueError(f"the confidence is {LEAST_SURE} to 1")
    if len(keywords) > MAX_KEYWORDS or any(len(k) > MAX_KEYWORD for k in keywords):
        raise ValueError(f"there are {MAX_KEYWORDS} keywords of {MAX_KEYWORD} characters at most")
    folded = list(dict.fromkeys(map(folded_name, keywords)))
    if "" in folded:
        raise ValueError("a keyword needs a letter or a digit")
    if not folded and not pattern:
        raise ValueError("a rule needs a keyword or a pattern")
    if pattern:
        if len(pattern) > MAX_PATTERN:
            raise ValueError(f"the pattern has {MAX_PATTERN} characters at most")
        if _NESTED.search(pattern):
            raise ValueError("the pattern has a nested quantifier")
        try:
            re.compile(pattern)
        except re.error as why:
            raise ValueError(f"the pattern is no regular expression: {why}") from None

    def fits(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce((F.length(text) <= V.MAX_LENGTH) & text.rlike(f"^(?:{pattern})$"), F.lit(False))

    by_name = (f"custom:{name}", category, confidence, "|".join(map(re.escape, folded))) if folded else None
    return by_name, fits if pattern else None


def name_rule(name: str, custom: list[tuple[str, str, float, str]] = ()) -> tuple[str, str, float] | None:
    """The first rule that fits a column's name, custom ones before the fixed ones: (rule, category, confidence)."""
    n = folded_name(name)
    for rule, category, confidence, pattern in [*custom, *NAME_RULES]:
        if re.search(pattern, n):
            return rule, category, confidence
    return None


def name_scan(columns: DataFrame, floor: float = RECORD_FROM) -> DataFrame:
    """(column_name, rule, confidence) of the columns (column_id, column) whose names a rule fits, at least `floor` sure."""

    @F.pandas_udf("rule string, confidence double")
    def found(names: pd.Series) -> pd.DataFrame:
        hits = [name_rule(n) if n is not None else None for n in names]
        return pd.DataFrame([(h[0], max(floor, h[2])) if h else (None, None) for h in hits], columns=["rule", "confidence"])

    named = columns.select(F.col("column_id").alias("column_name"), found("column").alias("f"))
    return named.where("f.rule IS NOT NULL").select("column_name", "f.rule", "f.confidence")


def value_scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, rule, matched, total, ratio) for all rules and columns, in one pass with one aggregation."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "long", "integer")]
    named = [F.col(f"`{c}`") for c in columns]
    counts = [F.count(c).alias(f"t{i}") for i, c in enumerate(named)]
    counts += [F.count_if(c.isNotNull() & check(c)).alias(f"m{i}_{k}") for i, c in enumerate(named) for k, (_, _, check) in enumerate(V.VALIDATORS.values())]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"m{i}_{k}").alias("matched"), F.col(f"t{i}").alias("total")) for i, c in enumerate(columns) for k, rule in enumerate(V.VALIDATORS)]
    return df.agg(*counts).select(F.inline(F.array(*rows))).withColumn("ratio", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(F.lit(0.0)))


def value_findings(scan: DataFrame) -> DataFrame:
    """The best finding of each scanned column: (column_name, rule, category, source, confidence).

    A rule's value evidence is ratio times weight, from a ratio of 0.3 over three values; evidence of the same rule in the
    column's name adds up to 1 - (1 - n)(1 - v). Findings from 0.5 are recorded; ties go to the more specific rule.
    """
    order, weight, category = F.lit(None), F.lit(None), F.lit(None)
    for k, (rule, (cat, w, _)) in enumerate(V.VALIDATORS.items()):
        order, weight, category = F.when(F.col("rule") == rule, k).otherwise(order), F.when(F.col("rule") == rule, w).otherwise(weight), F.when(F.col("rule") == rule, cat).otherwise(category)
    names = {r["column_name"]: name_rule(r["column_name"]) for r in scan.select("column_name").distinct().collect()}  # metadata: a row for a column
    name_conf = F.lit(None).cast("double")
    for column, found in names.items():
        if found:
            name_conf = F.when((F.col("column_name") == column) & (F.col("rule") == found[0]), found[2]).otherwise(name_conf)
    value = F.col("ratio") * weight
    both = F.when(name_conf.isNotNull(), 1 - (1 - name_conf) * (1 - value)).otherwise(value)
    good = scan.where((F.col("ratio") >= MIN_RATIO) & (F.col("total") >= MIN_VALUES)).withColumn("confidence", F.round(both, 4)).withColumn("category", category).withColumn("rank", order)
    best = good.where(F.col("confidence") >= RECORD_FROM).groupBy("column_name").agg(F.max_by(F.struct("rule", "category", "confidence"), F.struct("confidence", -F.col("rank"))).alias("b"))
    return best.select("column_name", "b.rule", "b.category", F.lit("value").alias("source"), "b.confidence")


def masked_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the given columns masked; nulls stay null, so counts do not change."""
    return df.select(*[(V.masked(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`")) for c in df.columns])


def masked_by_name(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with every column masked whose name a rule fits, and their names."""
    hit = [c for c in df.columns if name_rule(c)]
    return masked_columns(df, hit), hit


# Characters that may stand between the digits of a written number, invisible ones among them; the least and the
# most digits of a number; the rules for numbers, first match wins.
JOINERS = r"[\s\-().\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]"
MIN_DIGITS, MAX_DIGITS = 9, 19
_W, _DIGIT, _HEX = r"[\p{L}\p{N}_]", r"\p{Nd}", "[0-9A-Fa-f]"

# What free text is searched for, in this order: rule, what a text must hold at all, pattern of a candidate, the
# check that the candidate without joiners must pass. Numbers come last, see _numbers().
REDACTIONS = [
    ("email", "@", rf"(?:(?<![\p{{L}}\p{{N}}_.%+\-])|\G)[\p{{L}}\p{{N}}_.%+\-]++@[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_\-]*[\p{{L}}\p{{N}}])?(?:\.[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_\-]*[\p{{L}}\p{{N}}])?)*\.\p{{L}}{{2,}}", V.email),
    ("iban", r"[Ss][Aa].?[0-9]", rf"(?<![A-Za-z0-9])[Ss][Aa](?:{JOINERS}?[0-9A-Za-z]){{22}}(?![A-Za-z0-9])", V.iban),
    ("ip_address", rf"{_DIGIT}\.{_DIGIT}", rf"(?<![\p{{L}}\p{{N}}_.])(?:{_DIGIT}{{1,3}}\.){{3}}{_DIGIT}{{1,3}}(?!{_W}|\.{_DIGIT})", V.ip_address),
    ("ip_address", f":{_HEX}{{0,4}}:", rf"(?<![\p{{L}}\p{{N}}_:])(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}(?![\p{{L}}\p{{N}}_:])", V.ip_address),
]
_RUN = rf"(?<!{_DIGIT})\+?{_DIGIT}(?:{JOINERS}?{_DIGIT}){{{MIN_DIGITS - 1},}}"


def redacted(c: Column) -> Column:
    """Text with each identifier that passes its check replaced by [redacted: rule]; all else stays as it is.

    Digits of any script count as digits. Of several numbers in a row, and of numbers written in groups, the longest window
    of groups that is an identifier is taken, from the left. A text without a rule's mark is not searched for it.
    """
    for rule, mark, pattern, holds in REDACTIONS:
        bare = (lambda hit: F.regexp_replace(hit, JOINERS, "")) if rule == "iban" else (lambda hit: hit)
        c = V.bound(c, _marker(mark, pattern, lambda hit, rule=rule, holds=holds, bare=bare: F.when(holds(bare(hit)), F.lit(f"[redacted: {rule}]")).otherwise(hit)))
    return V.bound(c, _marker(f"{_DIGIT}(?:{JOINERS}?{_DIGIT}){{{MIN_DIGITS - 1}}}", _RUN, _numbers))


def _marker(mark: str, pattern: str, shown):
    """A function of a text: the text between the candidates, and each candidate as `shown` gives it."""

    def marked(text: Column) -> Column:
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        each = F.zip_with(between, found, lambda t, hit: F.concat(t, F.when(hit.isNull(), F.lit("")).otherwise(shown(hit))))
        return F.when(text.rlike(mark), F.array_join(each, "")).otherwise(text)

    return marked


def _number_rule(digits: Column) -> Column:
    """The rule for a number of ASCII digits, perhaps behind a plus sign; null if none fits."""
    size = F.length(digits)
    return (
        F.when((size == 10) & V.national_id(digits), "national_id")
        .when((size == 10) & V.iqama(digits), "iqama")
        .when(F.length(F.ltrim(digits, F.lit("+"))).between(10, 14) & V.mobile(digits), "phone")
        .when(size.between(13, MAX_DIGITS) & V.card_number(digits), "card_number")
    )


def _numbers(run: Column) -> Column:
    """A run of digit groups with each longest window that is an identifier replaced, from the left.

    A window starts at the first group that is still free and ends at the last at which its digits, MAX_DIGITS at most, fit a
    rule. The groups' own digits are folded to ASCII for the check only, so what stays is as it was written.
    """

    def folded(parts):
        groups, between = parts["groups"], parts["between"]
        n = F.size(groups)

        def step(state, i):
            ends = F.sequence(i, F.least(i + MAX_DIGITS, n) - 1)
            window = lambda j: F.array_join(F.slice(parts["plain"], i + 1, j - i + 1), "")
            sized = F.filter(F.transform(ends, lambda j: F.struct(j.alias("j"), window(j).alias("digits"))), lambda w: F.length(F.ltrim(w["digits"], F.lit("+"))).between(MIN_DIGITS, MAX_DIGITS))
            ruled = F.filter(F.transform(sized, lambda w: F.struct(w["j"].alias("j"), _number_rule(w["digits"]).alias("rule"))), lambda w: w["rule"].isNotNull())
            best = F.get(F.reverse(ruled), F.lit(0))
            put = lambda text, at: F.struct(F.concat(state["out"], F.get(between, i), text).alias("out"), at.alias("at"))
            taken = V.bound(best, lambda b: F.when(b.isNotNull(), put(F.concat(F.lit("[redacted: "), b["rule"], F.lit("]")), b["j"] + 1)).otherwise(put(F.get(groups, i), i + 1)))
            return F.when(i < state["at"], state).otherwise(taken)

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.concat(F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["out"], F.element_at(between, -1))

    group = rf"\+?{_DIGIT}+"
    groups = F.regexp_extract_all(run, F.lit(group), F.lit(0))
    return V.bound(F.struct(groups.alias("groups"), F.split(run, group, -1).alias("between"), F.transform(groups, V.ascii_digits).alias("plain")), folded)


def redacted_json(c: Column, kind: str) -> Column:
    """A JSON text of the given Spark type with every string in it redacted; null where it is not of that type."""

    def walk(value, t):
        name = t.typeName()
        if name == "string":
            return redacted(value)
        if name == "array":
            return F.transform(value, lambda x: walk(x, t.elementType))
        if name == "map":
            return F.transform_values(value, lambda _, x: walk(x, t.valueType))
        if name == "struct":
            return F.when(value.isNotNull(), F.struct(*[walk(value[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return value

    parsed = DataType.fromDDL(kind)
    return F.to_json(walk(F.from_json(c, parsed), parsed))


def merged_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of findings by column: a decision is kept, confidence only rises, a rule changes only while suggested."""
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns]), new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = o.join(n, F.col("o_column_name") == F.col("n_column_name"), "full")
    stronger = F.col("n_confidence") > F.coalesce("o_confidence", F.lit(-1.0))
    reopened = (F.col("o_status") == "rejected") & ((F.col("n_rule") != F.col("o_rule")) | stronger)
    status = F.when(F.col("o_status").isNull() | F.coalesce(reopened, F.lit(False)), F.lit("suggested")).otherwise(F.col("o_status"))
    rule = F.when(F.col("o_status").isNull() | ((F.col("o_status") != "accepted") & F.coalesce(stronger, F.lit(False))), F.col("n_rule")).otherwise(F.col("o_rule"))
    return both.select(F.coalesce("o_column_name", "n_column_name").alias("column_name"), rule.alias("rule"), F.greatest("o_confidence", "n_confidence").alias("confidence"), status.alias("status"))
