"""Per-key work on keys that hold most records.

``number_rows`` gives every row its exact position within its key without ever
gathering a key in one task; ``chunked_gaps`` is an order-dependent per-key
result built on it; ``hot_join`` joins on keys of which a few hold most rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgrove.session import cut, partitions

#: A key is hot if it has at least this share of all rows; there are at most 1/HOT_SHARE such keys.
HOT_SHARE = 0.01
#: Frames of fewer rows fit into one task whatever their keys, so nothing is singled out.
HOT_ROWS = 100_000


def _local_numbers(keys: list[str]):
    """mapInArrow function: rows arrive sorted by key; add the position within the key's run."""

    def run(batches):
        last, seen = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            change = None
            for k in keys:
                col = b.column(k)
                if n > 1:
                    x, y = col.slice(0, n - 1), col.slice(1)
                    d = pc.fill_null(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y)))
                    change = d if change is None else pc.or_(change, d)
            first = tuple(b.column(k)[0].as_py() for k in keys)
            starts = np.zeros(n, dtype=bool)
            starts[0] = True
            if n > 1:
                starts[1:] = change.to_numpy(zero_copy_only=False)
            pos = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, pos, 0))
            local = pos - begin
            if first == last:  # the run of the batch before goes on
                end = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else n
                local[:end] += seen
            last = tuple(b.column(k)[n - 1].as_py() for k in keys)
            seen = int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "_local"])

    return run


def number_rows(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``rn``: the row's 0-based position within its key, by ``order``.

    Rows are range-partitioned by key and order, so a key of any size is spread
    over as many tasks as its share of the rows. Each partition numbers its own
    rows; the counts per partition and key give, by prefix sum, the offset of the
    only key of a partition that can have begun before it, its first one. So at
    most one offset per partition is broadcast. NULL is a key like any other;
    rows equal in key and order are numbered in any order among themselves.
    The frame must not have columns named ``rn``, ``_local``, ``_pid``.
    """
    spark = df.sparkSession
    parts = parts or partitions(spark)
    sorted_ = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*sorted_.schema.fields, T.StructField("_local", T.LongType(), False)])
    numbered = sorted_.mapInArrow(_local_numbers(keys), schema).withColumn("_pid", F.spark_partition_id())
    t = cut(numbered, "numbered")
    runs = t.groupBy("_pid", *keys).agg((F.max("_local") + 1).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_off", F.sum("_n").over(w)).filter("_off > 0").drop("_n")
    o = F.broadcast(offsets.select(*[F.col(k).alias(f"_o_{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_o_pid"), "_off"))
    cond = t["_pid"] == o["_o_pid"]
    for i, k in enumerate(keys):
        cond = cond & t[k].eqNullSafe(o[f"_o_{i}"])
    j = t.join(o, cond, "left")
    return j.select(*[t[c] for c in df.columns], (t["_local"] + F.coalesce(F.col("_off"), F.lit(0))).alias("rn"))


def chunked_gaps(df: DataFrame, keys: list[str], at: str, tie: str, chunk_rows: int = 20_000, burst_s: int = 3600) -> DataFrame:
    """Ordered per-key result over keys of any size, by exact offset chunking.

    Rows are numbered within their key (:func:`number_rows`), cut into chunks of
    ``chunk_rows``, each chunk is processed on its own, and the chunks' boundary
    states are merged in order. Result per key: ``n_rows``, ``first_at``, ``last_at``, ``longest_gap_s`` (largest time between
    neighbouring rows, NULL for a single row) and ``n_bursts`` (runs of rows with
    no gap over ``burst_s``). Rows whose ``at`` is NULL come first; they count in
    ``n_rows`` and begin no burst. An empty frame gives no rows.
    """
    rows = number_rows(df.select(*keys, at, tie), keys, [at, tie])
    rows = rows.withColumn("chunk", F.floor(F.col("rn") / F.lit(chunk_rows)))
    w = Window.partitionBy(*keys, "chunk").orderBy("rn")
    secs = F.unix_micros(F.col(at).cast("timestamp"))
    gap = (secs - F.lag(secs).over(w)) / F.lit(1e6)
    states = (
        rows.withColumn("gap", gap)
        .groupBy(*keys, "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(at).alias("first_at"),
            F.max(at).alias("last_at"),
            F.max("gap").alias("max_gap"),
            F.count_if(F.col("gap") > burst_s).alias("breaks"),
        )
    )
    # one row per chunk: a key of r rows has r / chunk_rows of them
    ow = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    joint = (F.unix_micros(F.col("first_at").cast("timestamp")) - F.unix_micros(F.last("last_at", ignorenulls=True).over(ow).cast("timestamp"))) / F.lit(1e6)
    return (
        states.withColumn("joint", joint)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.greatest(F.max("max_gap"), F.max("joint")).alias("longest_gap_s"),
            (F.sum("breaks") + F.count_if(F.col("joint") > burst_s) + F.when(F.max("last_at").isNull(), 0).otherwise(1)).alias("n_bursts"),
        )
    )


def frequent_keys(per_key: DataFrame, total: int, share: float = 0.01) -> DataFrame:
    """Keys whose ``n_rows`` is at least ``share`` of ``total`` rows; none if there are no rows."""
    return per_key.filter(F.col("n_rows") >= share * total) if total else per_key.limit(0)


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, total: int | None = None, counts: DataFrame | None = None) -> list:
    """Keys (no NULL in them) with at least ``share`` of the rows: at most 1/share of them. ``total`` is the number of rows, if it is known, and
    ``counts`` (keys, _n) the rows of each key that stands more than once."""
    total = df.count() if total is None else total
    if total < HOT_ROWS:
        return []
    if counts is None:
        counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return [tuple(r[k] for k in keys) for r in counts.filter(F.col("_n") >= max(2, share * total)).select(*keys).collect()]


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], share: float = HOT_SHARE, total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Left join on ``keys``, each of which stands at most once in ``right``.

    Rows of hot keys are joined by broadcasting the at most 1/share rows of
    ``right`` they need; rows with a NULL key match nothing and skip the shuffle;
    all others go through the ordinary join. ``left`` is read three times, so
    it should be a table or cut before; ``total`` and ``counts`` are those of :func:`hot_keys`, if known.
    """
    extra = [c for c in right.columns if c not in keys]
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    nulls = left.filter(no_key).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra])
    rest = left.filter(~no_key)
    hot = hot_keys(left, keys, share, total, counts)
    if not hot:
        return rest.join(right, keys, "left").select(*left.columns, *extra).unionByName(nulls)
    schema = T.StructType([T.StructField(k, left.schema[k].dataType) for k in keys])
    h = F.broadcast(left.sparkSession.createDataFrame(hot, schema))
    few = F.broadcast(right.join(h, keys, "left_semi"))
    out = rest.join(h, keys, "left_semi").join(few, keys, "left").select(*left.columns, *extra)
    cold = rest.join(h, keys, "left_anti").join(right, keys, "left").select(*left.columns, *extra)
    return out.unionByName(cold).unionByName(nulls)


#: Parts into which the rows of a hot key are split by salting.
SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], share: float = HOT_SHARE, total: int | None = None) -> DataFrame:
    """Inner join on ``keys``, which may stand many times on both sides.

    Rows of ``left`` with a hot key are spread over SALTS tasks, and the rows of
    ``right`` with that key (at most 1/share keys) go to each of them. ``left`` is
    read three times, so it should be a table or cut before.
    """
    hot = hot_keys(left, keys, share, total)
    if not hot:
        return left.join(right, keys)

    def is_hot():
        return F.struct(*keys).isin([F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, t)]) for t in hot])

    many = F.when(is_hot(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = F.when(is_hot(), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    return left.withColumn("_salt", one).join(right.withColumn("_salt", F.explode(many)), [*keys, "_salt"]).drop("_salt")
