"""Filling containers of fixed capacity with documents, by shortest-pack-first over the length histogram.

The histogram has at most ``capacity`` lengths whatever the corpus, so it is
packed on the driver: lengths from longest to shortest, each placed into the
least filled packs it fits. Packs are kept as runs of containers that are filled
alike (a packing pattern and its count); placing a length into a part of a run
splits the run. Every placement is an interval of ranks within the length and an
interval of containers, so the documents find their containers by their rank.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import number_rows
from symgrove.session import cut

#: Largest number of containers' sizes (profiles) and of placements that are handed to the tasks.
MAX_PROFILES = 1000
MAX_PLACEMENTS = 4_000_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, rank_from, n, container_from, filled_before) of a length histogram.

    Lengths must be between 1 and ``capacity``.
    """
    runs: list[tuple[int, int, int]] = []  # (filled, first container, containers), least filled first
    placed, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if runs and capacity - runs[0][0] >= length:
                filled, first, n = heapq.heappop(runs)
                take = min(n, left)
                if take < n:
                    heapq.heappush(runs, (filled, first + take, n - take))
            else:
                filled, first, take = 0, opened, left
                opened += take
            placed.append((length, rank, take, first, filled))
            left -= take
            rank += take
            if filled + length < capacity:
                heapq.heappush(runs, (filled + length, first, take))
    return placed


def _assign(table: dict[str, tuple[np.ndarray, ...]]):
    def run(batches):
        for b in batches:
            out = []
            for profile, g in b.groupby("profile", sort=False):
                key, rank_from, container, filled = table[profile]
                want = g["size"].to_numpy(np.int64) * (1 << 40) + g["rn"].to_numpy(np.int64)
                at = np.searchsorted(key, want, side="right") - 1
                step = g["rn"].to_numpy(np.int64) - rank_from[at]
                out.append(g.assign(container_id=container[at] + step, container_from=filled[at]))
            if out:
                r = pd.concat(out)
                yield r[["profile", "container_id", "doc_id", "part", "token_from", "size", "container_from"]]

    return run


def pack(sizes: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """Containers of each profile (name, capacity) for the rows of ``sizes`` (doc_id, n_tokens).

    Result, one row per part of a document: profile, container_id, doc_id, part,
    token_from (in the document), n_tokens, container_from (in the container). A
    document over the capacity is split into full parts and a rest; all others
    stay whole. Documents of no tokens (NULL counts as 0) take no space and stand
    in container 0. Repeated rows are items of their own. No profiles, or no
    rows, give no rows; a capacity under 1 is an error.
    """
    if len(profiles) > MAX_PROFILES or any(c < 1 for _, c in profiles):
        raise ValueError("too many profiles, or a capacity under 1")
    spark = sizes.sparkSession
    result = "profile string, container_id long, doc_id long, part int, token_from long, n_tokens long, container_from long"
    if not profiles:
        return spark.createDataFrame([], result)
    kinds = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("long").alias("capacity")) for p, c in profiles])
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    items = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.explode(kinds).alias("k")).select("doc_id", "n", "k.*")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity"))).cast("int")
    items = items.select("profile", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    items = items.withColumn("token_from", F.col("part") * F.col("capacity")).withColumn("size", F.least("capacity", F.col("n") - F.col("token_from"))).drop("n", "capacity")
    numbered = cut(number_rows(items, ["profile", "size"], ["doc_id", "part"]), "items")
    bins: dict[str, dict[int, int]] = {p: {} for p, _ in profiles}
    for r in numbered.filter("size > 0").groupBy("profile", "size").count().collect():  # at most the sum of the capacities
        bins[r["profile"]][r["size"]] = r["count"]
    table, total = {}, 0
    for name, capacity in profiles:
        placed = pack_histogram(bins[name], capacity)
        total += len(placed)
        a = np.array([(0, 0, 0, 0, 0), *placed], dtype=np.int64)
        a = a[np.lexsort((a[:, 1], a[:, 0]))]
        table[name] = (a[:, 0] * (1 << 40) + a[:, 1], a[:, 1], a[:, 3], a[:, 4])
    if total > MAX_PLACEMENTS:
        raise ValueError(f"{total} placements; capacities are too large for the histogram method")
    raw = result.replace("n_tokens", "size")
    packed = numbered.filter("size > 0").mapInPandas(_assign(table), raw)
    empty = numbered.filter("size = 0").select("profile", F.lit(0).cast("long").alias("container_id"), "doc_id", "part", "token_from", "size", F.lit(0).cast("long").alias("container_from"))
    return packed.unionByName(empty).withColumnRenamed("size", "n_tokens")


def pack_summary(packs: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """Per profile: containers, tokens, unused share."""
    kinds = F.broadcast(packs.sparkSession.createDataFrame(profiles, "profile string, capacity long"))
    s = packs.groupBy("profile").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_parts"))
    return s.join(kinds, "profile").withColumn("unused", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))
