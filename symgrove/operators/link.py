"""Set-similarity join of two sides by their token sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import hot_join
from symgrove.session import cut

#: Distinct token sets of either side that one task compares at once.
BLOCK_ROWS = 2_000
_PAIRS = "left_id long, right_id long, n_left long, n_right long, strength double"


def _classes(side: DataFrame, name: str) -> DataFrame:
    """One row per distinct token set of a block: the smallest id stands for all, with their number."""
    s = side.select("block", "id", F.array_sort("tokens").alias("tokens")).filter(F.size("tokens") > 0)
    return cut(s.groupBy("block", "tokens").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), f"{name}-sets")


def _parts(side: DataFrame, name: str, rows: int) -> DataFrame:
    """block and the number of parts its sets are split into."""
    return cut(side.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name)), "parts")


def _round6(x: np.ndarray) -> np.ndarray:
    """Six places as SQL's ``round`` gives them: halves go up, where numpy goes to the even digit. Not for negative values."""
    y = x * 1e6
    whole = np.floor(y)
    return (whole + (y - whole >= 0.5)) / 1e6


def _overlaps(threshold: float):
    """Links of two groups of sets: an inverted index of one side, read once for each row of the other; overlaps are counted by the row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.combine_chunks(), right.combine_chunks()
        ta, tb = (pa.concat_arrays(x.column("tokens").chunks) if x.num_rows else pa.array([], pa.list_(pa.string())) for x in (a, b))
        codes = pa.concat_arrays([ta.flatten(), tb.flatten()]).dictionary_encode().indices.to_numpy()
        na, nb = ta.value_lengths().to_numpy().astype(np.int64), tb.value_lengths().to_numpy().astype(np.int64)
        ca, cb = codes[: na.sum()], codes[na.sum() :]
        at = np.repeat(np.arange(len(nb)), nb)[np.argsort(cb, kind="stable")]
        ends = np.cumsum(np.bincount(cb, minlength=int(codes.max(initial=0)) + 1))
        starts = ends - np.diff(ends, prepend=0)
        first = np.cumsum(na) - na
        out: list[tuple] = []
        for i in range(len(na)):
            c = ca[first[i] : first[i] + na[i]]
            both = np.bincount(np.concatenate([at[x:y] for x, y in zip(starts[c], ends[c])]), minlength=len(nb))
            sim = both / (na[i] + nb - both)
            hit = np.flatnonzero(sim >= threshold)
            out.append((np.full(len(hit), i), hit, sim[hit]))
        i, j, sim = (np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in range(3))
        i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
        cols = [a.column("id").take(i), b.column("id").take(j), a.column("n").take(i), b.column("n").take(j), pa.array(_round6(sim))]
        return pa.table([x.cast(t) for x, t in zip(cols, [pa.int64()] * 4 + [pa.float64()])], names=[c.split()[0] for c in _PAIRS.split(", ")])

    return run


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, by: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """left_id, right_id, n_left, n_right, strength of all pairs of distinct token sets with Jaccard at least ``threshold``.

    Both sides have id and tokens (ARRAY<STRING>, distinct). With ``by`` only rows
    with the same value of that column are compared (NULL counts as ''). Rows with equal sets are
    one class, named by its smallest id (``members`` tells which). At the low
    thresholds of linking no prefix of a set rules anything out, so the overlap is
    counted in the join itself: either side of a block is split at random into parts
    of about ``block_rows`` sets, each two parts meet in one task, and there an
    inverted index on exact tokens counts the overlaps of a row with all others
    at once. Memory is bounded by the parts, whatever a block or a token holds.
    Empty sets have no partner. ``threshold`` must be over 0.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    block = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    a, b = _classes(left.withColumn("block", block), "left"), _classes(right.withColumn("block", block), "right")
    parts = _parts(a, "pa", block_rows).join(_parts(b, "pb", block_rows), "block")  # a block on one side only has no pairs

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        x = hot_join(side, parts, ["block"]).filter(f"{own} is not null")
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        return x.select("block", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "id", "n", "tokens")

    key = ["block", "pa", "pb"]
    return spread(a, "pa", "pb").groupBy(*key).cogroup(spread(b, "pb", "pa").groupBy(*key)).applyInArrow(_overlaps(threshold), _PAIRS)


def members(side: DataFrame, by: str | None = None) -> DataFrame:
    """id and class_id of every row with tokens: the smallest id with the same token set (and the same value of ``by``)."""
    block = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    s = side.select(block.alias("block"), "id", F.array_sort("tokens").alias("tokens")).filter(F.size("tokens") > 0)
    rep = s.groupBy("block", "tokens").agg(F.min("id").alias("class_id"))
    return s.join(rep, ["block", "tokens"]).select("id", "class_id")


def doc_code_links(docs: DataFrame, symbols: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Links of sections to symbols of the same repo in the stored form, every row on both sides; both have id, repo and tokens."""
    pairs = similarity_join(docs, symbols, threshold, by="repo")
    d, s = members(docs, "repo").withColumnRenamed("id", "doc_node_id"), members(symbols, "repo").withColumnRenamed("id", "symbol_id")
    j = pairs.join(d, pairs["left_id"] == d["class_id"]).drop("class_id").join(s, pairs["right_id"] == s["class_id"])
    return j.select("doc_node_id", "symbol_id", F.lit("semantic").alias("link_type"), "strength", F.lit("text").alias("source"))
