"""Resolution of edge targets by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import hot_join
from symgrove.session import cut


def resolve_targets(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """``raw`` (repo, file_path, edge_target and others) with ``target_id``: a symbol of that exact name in the same file, else in the repo, else 0.

    Of several the smallest id counts. All edges are resolved against all symbols
    at once, whatever their order.
    """
    by_file = symbols.groupBy("repo", "file_path", F.col("name").alias("edge_target")).agg(F.min("id").alias("_near"))
    by_repo = symbols.groupBy("repo", F.col("name").alias("edge_target")).agg(F.min("id").alias("_far"))
    near = hot_join(cut(raw, "raw"), by_file, ["repo", "file_path", "edge_target"])
    far = hot_join(cut(near, "near"), by_repo, ["repo", "edge_target"])
    return far.withColumn("target_id", F.coalesce("_near", "_far", F.lit(0).cast("long"))).drop("_near", "_far")
