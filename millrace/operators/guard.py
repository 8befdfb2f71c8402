"""A guarded read-only SELECT over given tables: one statement of allowed constructs, protected columns masked, rows capped.

Protected columns are masked in the views that the statement reads, before it runs, so no expression, set operation or
subquery can bring their values out. Spark's own parser reads the statement; the guard walks the parsed tree and refuses
every construct, function and relation that is not on its lists. Common table expressions are known only inside their scope,
and none may read itself. What the analysed statement then asks of the session itself (its user, its catalog) is refused too.
The views carry names of their own while the statement is analysed, so statements at the same time do not meet.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException
from py4j.protocol import Py4JJavaError

from millrace.functions.validators import masked
from millrace.operators.modelling import personal_columns

MAX_LENGTH = 20_000
_NODES = frozenset("Project Filter Join Aggregate Sort Distinct GlobalLimit LocalLimit Offset SubqueryAlias Union Intersect Except UnresolvedHaving OneRowRelation UnresolvedRelation UnresolvedWith".split())

# Functions a guarded statement may call.
FUNCTIONS = frozenset(
    """abs round ceil ceiling floor sqrt power pow sign signum trunc greatest least coalesce nullif if nvl nvl2 decode length char_length character_length lower upper initcap trim ltrim rtrim btrim substring substr concat
    concat_ws replace left right reverse position instr locate split_part translate ascii chr md5 overlay regexp_replace regexp_like rlike like ilike octet_length cast try_cast to_char to_number to_date to_timestamp date_format format_number
    extract current_date current_timestamp now datediff date_diff dateadd date_add date_sub timestampadd timestampdiff date_trunc year month day dayofmonth quarter hour minute second last_day add_months months_between count sum avg mean min max stddev
    stddev_samp variance var_samp collect_list array_agg listagg string_agg row_number rank dense_rank ntile lag lead first_value last_value mod div when between and or not in isnull isnotnull""".split()
)


class Refused(ValueError):
    """The statement is not one that the guard lets through."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan, known: frozenset[str]) -> None:
    """Refuse a parsed plan that has anything but allowed nodes and functions, or reads a relation that is not known."""
    name = plan.nodeName().lstrip("'")
    if name not in _NODES:
        raise Refused(f"{name} is not allowed")
    if name == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in known:
            raise Refused(f"unknown table {'.'.join(parts)}")
    if name == "UnresolvedWith":
        if plan.allowRecursion():
            raise Refused("recursion is not allowed")
        for cte in _items(plan.cteRelations()):  # each may read those before it
            _walk(cte._2(), known)
            known = known | {cte._1().lower()}
    if name == "Join" and re.search("Natural|Using", plan.joinType().toString()):
        raise Refused("joins without a condition are not allowed")
    for e in _items(plan.expressions()):
        _walk_expression(e, known)
    for child in _items(plan.children()):
        _walk(child, known)


def _walk_expression(e, known: frozenset[str]) -> None:
    if e.nodeName().lstrip("'") == "UnresolvedFunction":
        parts = _items(e.nameParts())
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise Refused(f"function {'.'.join(parts)} is not allowed")
    kind = e.getClass()
    if kind.getSimpleName() in ("Rollup", "Cube", "GroupingSets"):
        raise Refused("grouping sets are not allowed")
    if kind.getSuperclass().getSimpleName() == "SubqueryExpression":
        if kind.getSimpleName() not in ("ScalarSubquery", "Exists", "ListQuery"):
            raise Refused(f"{kind.getSimpleName()} is not allowed")
        _walk(e.plan(), known)
    for child in _items(e.children()):
        _walk_expression(child, known)


# Functions without brackets that parse as columns and tell about the session.
_SESSION = frozenset("CurrentUser CurrentCatalog CurrentDatabase CurrentTimeZone".split())


def _session_free(plan) -> None:
    """Refuse an analysed plan that tells about the session, in a subquery too."""
    for e in _items(plan.expressions()):
        stack = [e]
        while stack:
            x = stack.pop()
            kind = x.getClass()
            if kind.getSimpleName() in _SESSION:
                raise Refused(f"{x.prettyName()} is not allowed")
            if kind.getSuperclass().getSimpleName() == "SubqueryExpression":
                _session_free(x.plan())
            stack += _items(x.children())
    for part in (plan.children(), plan.innerChildren()):
        for child in _items(part):
            if hasattr(child, "expressions"):
                _session_free(child)


def check(spark: SparkSession, sql: str, views: set[str], named: dict[str, str] | None = None) -> str:
    """The statement, if it is one SELECT of allowed parts over the given views.

    named: where the views are registered, if not under their own names; the statement then comes back with these names
    bound in front of it.
    """
    sql = sql.strip().rstrip(";").strip()
    if len(sql) > MAX_LENGTH or "\0" in sql:
        raise Refused("too long, or holds a NUL")
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if "/*+" in bare or not re.match(r"(?i)(select|with)\b", bare):
        raise Refused("one SELECT is asked for")
    try:
        _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(v.lower() for v in views))
        if named:
            own = re.match(r"(?i)with\b", sql)
            sql = f"WITH {', '.join(f'`{v}` AS (SELECT * FROM `{at}`)' for v, at in named.items())}{',' if own else ''} {sql[own.end() :] if own else sql}"
        _session_free(spark.sql(sql)._jdf.queryExecution().analyzed())  # lazy: a SELECT is only analysed here
    except (ParseException, AnalysisException, Py4JJavaError) as e:
        raise Refused(str(e).split("\n")[0]) from None
    return sql


def _analysed(spark: SparkSession, sql: str, tables: dict[str, DataFrame], protected: set[tuple[str, str]]) -> tuple[DataFrame, dict[str, str]]:
    """The statement over the tables, uncapped, and which view stood for which table."""
    hidden = {(t.lower(), c.lower()) for t, c in protected}
    named = {name: f"guarded_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.select(*[(masked(F.col(f"`{c}`")) if (name.lower(), c.lower()) in hidden else F.col(f"`{c}`")).alias(c) for c in df.columns]).createOrReplaceTempView(named[name])
        return spark.sql(check(spark, sql, set(tables), named)), named
    finally:
        for at in named.values():  # the analysed statement needs them no longer
            spark.catalog.dropTempView(at)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], protected: set[tuple[str, str]] = frozenset(), cap: int = 1000) -> DataFrame:
    """The statement's rows, `cap` + 1 at most (one more says that there were more), over tables with protected columns masked.

    A view's protected columns read as masked text everywhere in the statement, in filters and groups too. Output columns
    without a plain name are named by their place. Views that the caller has registered are neither read nor replaced.
    """
    out, _ = _analysed(spark, sql, tables, protected)
    return out.toDF(*[n if re.fullmatch(r"[A-Za-z_]\w*", n) else f"col{i + 1}" for i, n in enumerate(out.columns)]).limit(cap + 1)


class _Origins:
    """Which table columns the attributes of an analysed plan are made from, by the attributes' numbers."""

    def __init__(self, views: dict[str, str]):
        self.views, self.of, self.ctes = views, {}, {}

    def plan(self, plan) -> list[set[tuple[str, str]]]:
        """The origins of each output column."""
        name = plan.nodeName()
        if name == "SubqueryAlias" and (table := self.views.get(plan.alias().lower())):
            for a in _items(plan.output()):
                self.of[a.exprId().id()] = {(table, a.name())}
            return [self.of[a.exprId().id()] for a in _items(plan.output())]
        if name == "WithCTE":
            for definition in _items(plan.cteDefs()):
                self.ctes[definition.id()] = self.plan(definition.child())
            return self.plan(plan.plan())
        if name == "CTERelationRef":
            for a, found in zip(_items(plan.output()), self.ctes[plan.cteId()], strict=True):
                self.of[a.exprId().id()] = found
        children = [self.plan(c) for c in _items(plan.children())]
        for e in _items(plan.expressions()):
            for alias in self.aliases(e):
                self.of[alias.exprId().id()] = self.expression(alias.child())
        outputs = [a.exprId().id() for a in _items(plan.output())]
        if name in ("Union", "Intersect", "Except"):
            for k, number in enumerate(outputs):
                self.of[number] = set().union(*[c[k] for c in children])
        return [self.of.get(number, set()) for number in outputs]

    def aliases(self, e) -> list:
        return [e] if e.nodeName() == "Alias" else [x for c in _items(e.children()) for x in self.aliases(c)]

    def expression(self, e) -> set[tuple[str, str]]:
        if e.nodeName() == "AttributeReference":
            return self.of.get(e.exprId().id(), set())
        found = set().union(*[self.expression(c) for c in _items(e.children())]) if e.children().size() else set()
        if e.getClass().getSuperclass().getSimpleName() == "SubqueryExpression":
            found = found.union(*self.plan(e.plan()))
        return found


def recorded(spark: SparkSession, sql: str, tables: dict[str, DataFrame], strong: dict, weak: dict, protected: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """(column_name, rule): the columns, as table.column, behind those output columns of a guarded statement whose values show
    personal data. strong, weak: validators by rule, as personal_columns() takes them. Columns that only filter, join or group
    are not behind an output. Of several rules the first by the outputs' order counts."""
    out, named = _analysed(spark, sql, tables, protected)
    behind = _Origins({at.lower(): name for name, at in named.items()}).plan(out._jdf.queryExecution().analyzed())
    places = out.toDF(*[str(i) for i in range(len(out.columns))])
    hits = {int(r["column_name"]): r["rule"] for r in personal_columns(places, strong, weak).collect()}  # a row for an output column
    found: dict[str, str] = {}
    for place, rule in sorted(hits.items()):
        for table, column in sorted(behind[place]):
            found.setdefault(f"{table}.{column}", rule)
    return spark.createDataFrame(list(found.items()), "column_name string, rule string")


def masked_places(df: DataFrame, places: set[int]) -> DataFrame:
    """df with the columns at the given places (from 0) masked, whatever their names; two may share one."""
    return df.toDF(*[f"__{i}" for i in range(len(df.columns))]).select(*[(masked(F.col(f"__{i}")) if i in places else F.col(f"__{i}")).alias(c) for i, c in enumerate(df.columns)])


def accepts(spark: SparkSession, sql: str, views: set[str]) -> bool:
    try:
        check(spark, sql, views)
    except Refused:
        return False
    return True
