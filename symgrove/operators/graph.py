"""Traversal of the symbol graph: call graph, inheritance, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.functions.text import label_kind
from symgrove.operators.skew import salted_join
from symgrove.session import cut, cut_counted


def kind_of(edges: DataFrame | None = None):
    """Kind of an edge, also where only the label is set."""
    return F.coalesce(F.col("edge_kind"), label_kind(F.col("edge_type")))


def steps(edges: DataFrame, kinds: list[str] | None, direction: str) -> DataFrame:
    """from_id, to_id of the resolved edges of some kinds; callees go along them, anything else against them."""
    e = edges.filter((F.col("source_id") != 0) & (F.col("target_id") != 0))
    if kinds:
        e = e.filter(kind_of(e).isin(kinds))
    a, b = ("source_id", "target_id") if direction == "callees" else ("target_id", "source_id")
    return e.select(F.col(a).alias("from_id"), F.col(b).alias("to_id")).distinct()


def reach(roots: DataFrame, step: DataFrame, max_depth: int) -> DataFrame:
    """root_id, id, depth of all nodes within ``max_depth`` steps of each root, by the shortest way; the root itself has depth 0.

    One join per level for all roots at once; nodes already met are not expanded
    again, so cycles end. Every level is cut; the steps of a hub are spread over
    many tasks.
    """
    rows = F.count(F.lit(1))
    step, n_steps = cut_counted(step, "steps", rows=rows)
    step = step.withColumnRenamed("from_id", "at")
    seen, front, n = [], cut(roots.select(F.col("id").alias("root_id"), "id").distinct().withColumn("depth", F.lit(0)), "level"), 1
    for depth in range(1, max_depth + 1):
        seen.append(front)
        met = front
        for x in seen[:-1]:
            met = met.unionByName(x)
        nxt = salted_join(step, front.select("root_id", F.col("id").alias("at")), ["at"], total=n_steps["rows"]).select("root_id", F.col("to_id").alias("id")).distinct()
        front, n = cut_counted(nxt.join(met, ["root_id", "id"], "left_anti").withColumn("depth", F.lit(depth)), "level", rows=rows)
        if not n["rows"]:
            break
    for x in seen:
        front = front.unionByName(x)
    return front


def call_graph(roots: DataFrame, edges: DataFrame, symbols: DataFrame, direction: str = "callers", max_depth: int = 3) -> DataFrame:
    """Callers (or callees) of the roots up to a depth: root_id, id, depth, name ('' for an unknown symbol)."""
    r = reach(roots, steps(edges, ["calls"], direction), max_depth)
    return r.join(symbols.select("id", "name"), "id", "left").select("root_id", "id", "depth", F.coalesce("name", F.lit("")).alias("name"))


def impact(roots: DataFrame, edges: DataFrame, symbols: DataFrame, max_depth: int = 3) -> DataFrame:
    """Everything that depends on the roots by any kind of edge, up to a depth."""
    r = reach(roots, steps(edges, None, "callers"), max_depth)
    return r.join(symbols.select("id", "name"), "id", "left").select("root_id", "id", "depth", F.coalesce("name", F.lit("")).alias("name"))


def inheritance_chain(edges: DataFrame) -> DataFrame:
    """ancestor_id, node_id, distance (the shortest) of all ancestors of every class, through each of its bases and through cycles; no class is its own ancestor.

    Each round doubles the length of the ways that are known; a base of very many
    classes is spread over many tasks.
    """
    counts = {"rows": F.count(F.lit(1)), "total": F.sum("depth")}
    near, size = cut_counted(steps(edges, ["inherits"], "callees").filter("from_id <> to_id").withColumn("depth", F.lit(1)), "ancestors", **counts)
    while True:
        far = near.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("far"), F.col("depth").alias("more"))
        longer = salted_join(near, far, ["to_id"], total=size["rows"]).filter("from_id <> far").select("from_id", F.col("far").alias("to_id"), (F.col("depth") + F.col("more")).alias("depth"))
        near, now = cut_counted(near.unionByName(longer).groupBy("from_id", "to_id").agg(F.min("depth").alias("depth")), "ancestors", **counts)
        if now == size:
            return near.select(F.col("to_id").alias("ancestor_id"), F.col("from_id").alias("node_id"), F.col("depth").alias("distance"))
        size = now
