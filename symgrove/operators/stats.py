"""Overview and status of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgrove.functions.text import label_kind


def in_branch(symbols: DataFrame, branches: DataFrame | None, branch: str = "") -> DataFrame:
    """Symbols of a branch; all of them without one. A membership that is stored twice counts once."""
    if not branch or branches is None:
        return symbols
    member = branches.filter(F.col("branch_name") == branch).select(F.col("symbol_id").alias("id"))
    return symbols.join(member, "id", "left_semi")


def kind_histogram(symbols: DataFrame) -> DataFrame:
    """repo, kind, n, pct of the repo's symbols; order by n descending, then kind."""
    w = Window.partitionBy("repo")  # a repo has a handful of kinds
    c = symbols.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(w), 6))


def edge_type_rollup(edges: DataFrame, limit: int = 10) -> DataFrame:
    """base, n, example: edge labels rolled up to their kind, each with its most frequent label (the smallest on a tie)."""
    c = edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("c")).withColumn("base", label_kind(F.col("edge_type")))
    best = F.min_by("edge_type", F.struct(-F.col("c"), F.col("edge_type")))
    return c.groupBy("base").agg(F.sum("c").alias("n"), best.alias("example")).orderBy(F.desc("n"), "base").limit(limit)


def top_referenced(edges: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """target_id, name, kind, refs of the symbols most edges point to; smaller ids first on a tie."""
    refs = edges.filter(F.col("target_id") != 0).groupBy("target_id").agg(F.count(F.lit(1)).alias("refs"))
    s = symbols.select(F.col("id").alias("target_id"), "name", "kind")
    return refs.join(s, "target_id").orderBy(F.desc("refs"), "target_id").limit(limit).select("target_id", "name", "kind", "refs")


def status(symbols: DataFrame, edges: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Per repo: n_symbols, n_edges, n_resolved, pct_resolved (0 without edges), n_docs, n_links (links with their section's ``repo``)."""
    s = symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("n_symbols"))
    e = edges.groupBy(F.col("source_repo").alias("repo")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("target_id") != 0).alias("n_resolved")).filter("repo is not null")
    d = docs.groupBy("repo").agg(F.count(F.lit(1)).alias("n_docs"))
    k = links.groupBy("repo").agg(F.count(F.lit(1)).alias("n_links"))
    j = s.join(e, "repo", "full").join(d, "repo", "full").join(k, "repo", "full").na.fill(0)
    pct = F.when(F.col("n_edges") > 0, F.round(100.0 * F.col("n_resolved") / F.col("n_edges"), 6)).otherwise(0.0)
    return j.select("repo", "n_symbols", "n_edges", "n_resolved", pct.alias("pct_resolved"), "n_docs", "n_links")
