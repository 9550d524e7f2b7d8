"""References to records that do not exist.

A Bloom filter of the parent keys, of bounded size, is sent to every task; a
reference it refuses is an orphan for certain and never shuffled. Only the
others are verified by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import hot_join
from symgrove.session import cut

#: Largest size of the broadcast filter; with more keys than it is good for, more references are verified exactly.
MAX_FILTER_BITS = 64 * 1024 * 1024
BITS_PER_KEY = 10


def bloom_filter(keys: DataFrame, col: str, n_keys: int, max_bits: int = MAX_FILTER_BITS) -> bytes:
    """Serialised Bloom filter of the LONG column ``col``, made by a tree of partial filters on the executors."""
    bits = max(64, min(max_bits, n_keys * BITS_PER_KEY))
    jvm = keys.sparkSession._jvm
    bf = keys.select(col).dropna()._jdf.stat().bloomFilter(col, max(1, n_keys), bits)
    out = jvm.java.io.ByteArrayOutputStream()
    bf.writeTo(out)
    return bytes(out.toByteArray())


def might_contain(keys: DataFrame, filter_bytes: bytes, col: str) -> Column:
    """Column that is false where the filter proves that the LONG column ``col`` is no key."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column

    jvm = keys.sparkSession._jvm
    util = jvm.org.apache.spark.sql.classic.ExpressionUtils
    expr = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
        util.expression(_to_java_column(F.lit(filter_bytes))), util.expression(_to_java_column(F.col(col)))
    )
    return Classic(util.column(expr))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` whose ``ref_id`` is no key of ``parents`` or was recorded there only later.

    refs: ``ref_id`` LONG, ``ref_at`` TIMESTAMP and any other columns. parents:
    ``id`` LONG, ``recorded_at`` TIMESTAMP. Adds ``reason``: ``absent`` (proved by
    the filter or by the join) or ``late``. ``ref_id`` NULL or 0 is no reference.
    Of a parent that stands there several times the earliest time counts; a NULL
    time on either side is never late. Empty parents make every reference absent.
    """
    refs = refs.filter(F.col("ref_id").isNotNull() & (F.col("ref_id") != 0))
    par = cut(
        parents.select(F.col("id").alias("ref_id"), "recorded_at").dropna(subset=["ref_id"]).groupBy("ref_id").agg(F.min("recorded_at").alias("_parent_at"), F.lit(True).alias("_found")),
        "parents",
    )
    n = par.count()
    if not n:
        return refs.withColumn("reason", F.lit("absent"))
    hit = might_contain(refs, bloom_filter(par, "ref_id", n), "ref_id")
    definite = refs.filter(~hit).withColumn("reason", F.lit("absent"))
    maybe = cut(refs.filter(hit), "maybe")
    joined = hot_join(maybe, par, ["ref_id"])
    reason = F.when(F.col("_found").isNull(), "absent").when(F.col("_parent_at") > F.col("ref_at"), "late")
    verified = joined.withColumn("reason", reason).filter("reason is not null").drop("_parent_at", "_found")
    return definite.unionByName(verified)


def graph_references(edges: DataFrame, branches: DataFrame) -> DataFrame:
    """The references of edges and branches to symbols, one row each: ref_table, ref_field, row_key, ref_id, ref_at."""
    e = edges.select(F.col("id").cast("string").alias("row_key"), F.col("recorded_at").alias("ref_at"), F.explode(F.create_map(F.lit("source_id"), F.col("source_id"), F.lit("target_id"), F.col("target_id"))).alias("ref_field", "ref_id"))
    e = e.withColumn("ref_table", F.lit("edges"))
    b = branches.select(
        F.concat(F.coalesce(F.col("symbol_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("branch_name", F.lit(""))).alias("row_key"),
        F.col("recorded_at").alias("ref_at"),
        F.lit("symbol_id").alias("ref_field"),
        F.col("symbol_id").alias("ref_id"),
        F.lit("branches").alias("ref_table"),
    )
    return e.unionByName(b)


def orphan_cases(edges: DataFrame, branches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct broken references of edges and branches: ref_table, ref_field, row_key, ref_month, reason, ref_id."""
    bad = orphan_references(graph_references(edges, branches), symbols.select("id", "recorded_at"))
    return bad.select("ref_table", "ref_field", "row_key", F.date_format("ref_at", "yyyy-MM").alias("ref_month"), "reason", "ref_id").distinct()


def orphan_report(cases: DataFrame) -> DataFrame:
    """Broken references per table, field, month and reason."""
    return cases.groupBy("ref_table", "ref_field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_ids"))
