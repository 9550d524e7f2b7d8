"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import hot_join
from symgrove.session import cut, cut_counted


def connected_components(links: DataFrame) -> DataFrame:
    """node, comp of every node in ``links`` (a, b of one type); comp is the smallest node of the component.

    Every round takes the smallest label among the neighbours and then the
    label's own label, so the distance covered about doubles. The state is cut
    after each round; hubs are joined by broadcast. NULLs are no links, loops and
    repeats change nothing. Empty links give no rows.
    """
    rows = F.count(F.lit(1))
    both = links.select("a", "b").dropna()
    e, n = cut_counted(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", rows=rows)
    n_links = n["rows"]
    lab, n = cut_counted(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels", rows=rows)
    n_nodes = n["rows"]
    while n_nodes:
        near = hot_join(e, lab.select(F.col("node").alias("b"), "comp"), ["b"], total=n_links).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = cut(lab.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid")), "labels")
        jump = hot_join(step, step.select(F.col("node").alias("mid"), F.col("mid").alias("far")), ["mid"], total=n_nodes)
        lab, n = cut_counted(jump.select("node", "old", F.least("mid", "far").alias("comp")), "labels", moved=F.count_if(F.col("comp") != F.col("old")))
        lab = lab.drop("old")
        if not n["moved"]:
            break
    return lab
