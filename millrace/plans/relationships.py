"""Relationship inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import relate
from millrace.plans.base import Book
from millrace.session import table

book = Book()
query = book.query


def _counts_sql(child: str, cc: str, parent: str, pc: str) -> str:
    return (
        f"SELECT p.*, c.*, m.matched_rows FROM (SELECT count(*) AS target_rows, count({pc}) AS target_values, count(DISTINCT {pc}) AS target_distinct FROM {parent}) p CROSS JOIN "
        f"(SELECT count({cc}) AS child_values, count(DISTINCT {cc}) AS child_distinct FROM {child}) c CROSS JOIN (SELECT count(*) AS matched_rows FROM {child} x JOIN {parent} y ON x.{cc} = y.{pc}) m"
    )


@query(_counts_sql("orders", "o_custkey", "customer", "c_custkey"))
def fk_counts_orders_customer(spark, sf_dir):
    return relate.fk_counts(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query(_counts_sql("documents", "doc_id", "labels", "doc_id"))
def fk_counts_documents_labels(spark, sf_dir):
    return relate.fk_counts(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fk_orphans(spark, sf_dir):
    return relate.orphans(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


def _catalog(spark, sf_dir):
    """(table, column, data_type, unique) of the star schema, prefixes cut so that names can be compared."""
    rows = []
    keys = {"region": "regionkey", "nation": "nationkey", "customer": "custkey", "supplier": "suppkey", "part": "partkey", "orders": "orderkey", "documents": "doc_id"}
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels"):
        for f in table(spark, sf_dir, t).schema.fields:
            name = f.name.split("_", 1)[1] if f.name[1] == "_" else f.name
            rows.append((t, name, f.dataType.simpleString(), 0.8 if keys.get(t) == name else 0.0))
    return spark.createDataFrame(rows, "table string, column string, data_type string, unique double")


_EXPECTED = [
    ("nation", "regionkey", "region", "regionkey"), ("customer", "nationkey", "nation", "nationkey"), ("supplier", "nationkey", "nation", "nationkey"), ("orders", "custkey", "customer", "custkey"),
    ("lineitem", "orderkey", "orders", "orderkey"), ("lineitem", "partkey", "part", "partkey"), ("lineitem", "suppkey", "supplier", "suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


@query(" UNION ALL ".join(f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column, 0.9 ::DOUBLE AS name_score, 1.0::DOUBLE AS type_score, FALSE AS joined, 0.67::DOUBLE AS score" for a, b, c, d in _EXPECTED))
def inferred_relationships(spark, sf_dir):
    """All undeclared references of the star schema are found by the rules alone: 0.4 * 0.9 + 0.15 + 0.2 * 0.8."""
    return relate.candidates(_catalog(spark, sf_dir))


@query(
    "SELECT 'v' || s_suppkey AS object, 'orders' AS from_table, 'custkey' AS from_column, 'customer' AS to_table, 'custkey' AS to_column FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'v' || s_suppkey, 'lineitem', 'suppkey', 'supplier', 'suppkey' FROM supplier WHERE s_suppkey % 4 = 1 "
    "UNION ALL SELECT 'v' || s_suppkey, 'customer', 'nationkey', 'supplier', 'nationkey' FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT 'v' || s_suppkey, 'lineitem', 'partkey', 'part', 'partkey' FROM supplier WHERE s_suppkey % 4 = 2"
)
def mined_joins(spark, sf_dir):
    """A view for each supplier, whose text joins tables by aliases, comma lists or schemas, or not at all."""
    k = F.col("s_suppkey")
    texts = (
        "SELECT o.orderkey, c.name FROM orders o JOIN customer AS c ON o.custkey = c.custkey WHERE o.orderkey > {}",
        "SELECT {} FROM lineitem, supplier s, customer WHERE lineitem.suppkey = s.suppkey AND customer.nationkey = s.nationkey AND s.unknown = customer.custkey",
        "select p.name\nfrom dbo.part p\nleft join dbo.lineitem l on l.partkey=p.partkey\nwhere l.quantity > {}",
        "SELECT count(*) FROM orders WHERE orderkey = {}",
    )
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (k % 4 + 1).cast("int"))
    views = table(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), k.cast("string")).alias("object"), F.replace(text, F.lit("{}"), k.cast("string")).alias("sql"))
    return relate.mined_joins(views, _catalog(spark, sf_dir))


@query(
    f"WITH k AS ({_counts_sql('orders', 'o_custkey', 'customer', 'c_custkey')}) SELECT target_values > 0 AND target_values = target_distinct AS target_unique, "
    "round(CASE WHEN target_values > 0 AND target_values = target_distinct THEN round(0.7 * least(1.0, matched_rows / CAST(child_values AS DOUBLE)) * CASE WHEN child_distinct < 5 THEN 0.5 ELSE 1.0 END + 0.3 * 0.67, 4) ELSE 0.3 END, 4) AS confidence, greatest(0, child_values - matched_rows) AS orphan_rows FROM k"
)
def counted_relationship(spark, sf_dir):
    k = fk_counts_orders_customer(spark, sf_dir)
    unique = (F.col("target_values") > 0) & (F.col("target_values") == F.col("target_distinct"))
    return k.select(unique.alias("target_unique"), F.round(relate.counted_confidence(F.lit(0.67)), 4).alias("confidence"), F.greatest(F.lit(0), F.col("child_values") - F.col("matched_rows")).alias("orphan_rows"))
