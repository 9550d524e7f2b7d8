"""Classes of similar sets, by MinHash banding with verification.

Sets of 32-bit shingle hashes are held whole, whatever their size: signatures
are those of the whole set, and similarities are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.components import connected_components
from symgrove.operators.skew import hot_join, hot_keys
from symgrove.session import cut, cut_counted

ROWS, BANDS = 10, 40
THRESHOLD = 0.8
#: Values of the signature that are compared before the sets are. Pairs that agree in less than NEAR of them (four
#: standard errors under 0.8) are no links; a row that agrees in SURE of them with a leader needs no other one.
SIGNS, NEAR, SURE = 256, 0.7, 0.88
FOLLOWS = -1
#: Buckets with this share of all rows are split into SALTS parts first.
HOT_BUCKET, SALTS = 0.002, 32

_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def bands(sketch: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One 64-bit hash per band of the MinHash signature of a set of int32, and a byte of each of its first values.

    The members are hashes themselves, so permutations of 32 bits (odd multiples, modulo 2^32) do.
    """
    x = sketch.view(np.uint32)
    sig = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(x), 128):  # what fits a core's cache
        now = x[i : i + 128, None] * _MUL
        now += _ADD
        np.minimum(sig, now.min(axis=0), out=sig)
    wide = sig.astype(np.uint64)
    out = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ wide.reshape(BANDS, ROWS)[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    signs = ((wide[:SIGNS] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)
    return out.astype(np.int64), signs.tobytes()


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Members of a column of sets, one after the other, and where each set ends (from 0 on)."""
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])


def _band_rows(batches):
    for b in batches:
        x, ends = _sets(b.column(2))
        got = [bands(x[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        out = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([g[0] for g in got] or [np.zeros(0, dtype=np.int64)])), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out, pa.array([g[1] for g in got], pa.binary())], names=["n", "block", "bands", "signs"])


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SIGNS)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of the values in which the signatures ``x`` and ``y`` (a row of bytes each) agree."""
    same = np.equal(x, y).view(np.uint64).sum(axis=1)  # bytes of 0 or 1: SIGNS / 8 of them add up within a byte
    return same.view(np.uint8).reshape(-1, 8).sum(axis=1) / SIGNS


#: Buckets of no more rows are compared pair by pair, those of one batch at once.
SMALL = 32


def _leaders(batches):
    """Rows sorted by bucket (part, n, hot, signs): pairs that agree with a leader of their bucket, the leaders of hot buckets, and
    once for each bucket with rows that follow a leader a row that says so (lead is FOLLOWS).

    A row is compared with all leaders met so far at once; it becomes a leader too
    unless one surely is like it. Only the leaders of one bucket are kept. Small buckets
    that lie within a batch are compared together; where none of their rows surely
    is like another, all are leaders and nothing is left to do.
    """
    part, lead, n_lead, told = None, np.zeros((64, SIGNS), dtype=np.uint8), 0, False
    ids = np.zeros(64, dtype=np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        sig = _signs(b.column(3))
        parts, ns, hots = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        size = np.diff([*starts, len(parts)])
        # the first bucket may have begun in the batch before, the last may go on in the next
        alone = (size <= SMALL) & ~hots[starts]
        alone[[0, -1]] = False
        at = np.repeat(np.where(alone, np.arange(len(starts)), -1), size)
        first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for d in range(1, int(size[alone].max(initial=1))):
            same = np.flatnonzero((at[d:] == at[:-d]) & (at[d:] >= 0))
            agree = _agree(sig[same], sig[same + d])
            first.append(same[agree >= NEAR])
            second.append(same[agree >= NEAR] + d)
            alone[at[same[agree >= SURE]]] = False
        first, second = np.concatenate(first), np.concatenate(second)
        done = alone[at[first]]
        out_n, out_lead = ns[second[done]].tolist(), ns[first[done]].tolist()
        out_part = [None] * len(out_n)
        todo = np.flatnonzero(~np.repeat(alone, size))
        for i, p, n, hot in zip(todo.tolist(), parts[todo].tolist(), ns[todo].tolist(), hots[todo].tolist()):
            if p != part:
                part, n_lead, told = p, 0, False
            sure = False
            if n_lead:
                agree = _agree(lead[:n_lead], sig[i])
                near = np.flatnonzero(agree >= NEAR)
                if len(near):
                    out_n += [n] * len(near)
                    out_lead += ids[near].tolist()
                    out_part += [None] * len(near)
                    sure = agree.max() >= SURE
            if sure and not told:
                told = True
                out_n.append(n)
                out_lead.append(FOLLOWS)
                out_part.append(p)
            if not sure:
                if n_lead == len(ids):
                    lead, ids = np.concatenate([lead, np.zeros_like(lead)]), np.concatenate([ids, np.zeros_like(ids)])
                lead[n_lead], ids[n_lead] = sig[i], n
                n_lead += 1
                if hot:
                    out_n.append(n)
                    out_lead.append(None)
                    out_part.append(p)
        yield pa.RecordBatch.from_arrays([pa.array(out_n, pa.int64()), pa.array(out_lead, pa.int64()), pa.array(out_part, pa.int64())], names=["n", "lead", "part"])


def _near(batches):
    """The pairs (n, lead, s1, s2) whose signatures agree in NEAR of their values."""
    for b in batches:
        near = pa.array(_agree(*(_signs(b.column(i)) for i in (2, 3))) >= NEAR)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["n", "lead"])


#: Members of sets that are sorted at once, unless one pair has more.
CELLS = 2_000_000


def _verified(threshold: float):
    """The pairs (n, lead, s1, s2) whose sets, neither of them empty, have a similarity of ``threshold``."""

    def run(batches):
        for b in batches:
            (x, ex), (y, ey) = _sets(b.column(2)), _sets(b.column(3))
            ends, i, found = ex + ey, 0, []
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + CELLS, "right")) - 1)
                a, c = np.diff(ex[i : j + 1]), np.diff(ey[i : j + 1])
                pair = np.concatenate([np.repeat(np.arange(j - i), a), np.repeat(np.arange(j - i), c)])
                members = np.concatenate([x[ex[i] : ex[j]], y[ey[i] : ey[j]]]).view(np.uint32)
                key = np.sort((pair.astype(np.uint64) << np.uint64(32)) | members)
                both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=j - i)
                found.append(both / (a + c - both) >= threshold)
                i = j
            like = pa.array(np.concatenate(found or [np.zeros(0, dtype=bool)]))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(like), b.column(1).filter(like)], names=["n", "lead"])

    return run


def _links(pairs: DataFrame, rows: DataFrame, threshold: float, total: int) -> DataFrame:
    """The ``pairs`` (n, lead; ``total`` of them) whose sets are similar."""
    # sizes go first, as sets are long; a row has no more pairs than it has bands and leaders, a leader may have any number
    size = rows.select("n", F.size("sketch").alias("z"))
    sized = hot_join(pairs, size.select(F.col("n").alias("lead"), F.col("z").alias("z2")), ["lead"], total=total).join(size, "n")
    fits, n = cut_counted(sized.filter((F.col("z") >= threshold * F.col("z2")) & (F.col("z2") >= threshold * F.col("z"))).select("n", "lead"), "fits", rows=F.count(F.lit(1)))
    both = hot_join(fits, rows.select(F.col("n").alias("lead"), F.col("sketch").alias("s2")), ["lead"], total=n["rows"]).join(rows.select("n", F.col("sketch").alias("s1")), "n")
    return both.select("n", "lead", "s1", "s2").mapInArrow(_verified(threshold), "n long, lead long")


def similar_classes(items: DataFrame, threshold: float = THRESHOLD, total: int | None = None) -> DataFrame:
    """id, cls of every row of ``items`` (id unique, block, sketch ARRAY<INT>: the whole set, each member once).

    Rows are linked if they share a block and a band and their similarity is at
    least ``threshold``; classes are the connected components of the links, named
    by a number that holds within this result; ``total`` is the number of rows, if known. Equal sets (by 128 bits of hash) are one class at once
    and go on as one row. A bucket is read once: each row is compared, by signature,
    with the rows of the bucket that resemble none before them, and what agrees is
    verified by set; no bucket is cut short and none is paired out. Large buckets
    are read in parts whose leaders are then compared. Rows that were surely like a
    leader are none themselves, so a second pass compares, in the buckets that have
    such rows, all pairs that the links found so far leave in different classes. A
    link is missed only if its rows share no band (about 1 % at 0.8) or their
    signatures disagree by four standard errors. Empty sets make a class of
    their own each.
    """
    set_id = {"set_id": F.xxhash64("block", "sketch"), "set_id2": F.xxhash64(F.lit(1), "block", "sketch")}
    count = {"rows": F.count(F.lit(1))}
    full, n = cut_counted(items.select("id", F.size("sketch").alias("z"), F.xxhash64("block").alias("block"), *[x.alias(k) for k, x in set_id.items()]).withColumn("n", F.monotonically_increasing_id()), "sets", **count)
    n_full = n["rows"]
    reps = cut(full.filter("z > 0").groupBy("set_id", "set_id2").agg(F.min_by(F.struct("n", "id", "block"), "n").alias("r")).select("set_id", "set_id2", F.col("r.n").alias("rep"), F.col("r.id").alias("id"), F.col("r.block").alias("block")), "representatives")
    rows = cut(items.select("id", "sketch").join(reps.select("id", F.col("rep").alias("n"), "block"), "id").select("n", "block", "sketch"), "reps")
    reps = reps.select("set_id", "set_id2", "rep")
    banded, n = cut_counted(rows.mapInArrow(_band_rows, "n long, block long, bands array<long>, signs binary"), "banded", **count)
    b = banded.select("n", F.explode(F.transform("bands", lambda h, band: F.xxhash64("block", band, h))).alias("bucket"))
    shared = cut(b.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared")
    m, n = cut_counted(hot_join(b, shared, ["bucket"], total=n["rows"] * BANDS, counts=shared).filter("_n > 1").drop("_n"), "members", **count)
    hot = [k for (k,) in hot_keys(m, ["bucket"], HOT_BUCKET, n["rows"], counts=shared)]
    is_hot = F.col("bucket").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("n"), F.lit(SALTS))).otherwise(0)
    rows_in = m.join(banded.select("n", "signs"), "n").withColumn("part", F.xxhash64("bucket", salt))
    first = rows_in.select("part", "n", is_hot.alias("hot"), "signs").repartition("part").sortWithinPartitions("part", "n").mapInArrow(_leaders, "n long, lead long, part long")
    first = cut(first, "leaders")
    if hot:
        parts = m.filter(F.col("bucket").isin(hot)).select("n", "bucket", F.xxhash64("bucket", salt).alias("part"))
        again = first.filter("lead is null").join(parts, ["n", "part"]).join(banded.select("n", "signs"), "n").select("bucket", "n", F.lit(False).alias("hot"), "signs")
        first = first.unionByName(again.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(_leaders, "n long, lead long, part long"))
    pairs, n = cut_counted(first.filter(F.col("lead") != FOLLOWS).select("n", "lead").distinct(), "pairs", **count)
    links, n = cut_counted(_links(pairs, rows, threshold, n["rows"]), "links", **count)

    def joined(found: DataFrame) -> DataFrame:
        return cut(connected_components(found.select(F.col("n").alias("a"), F.col("lead").alias("b"))), "classes")

    comp = joined(links)
    # second pass: hot buckets always have rows that follow
    part = m.withColumn("part", F.xxhash64("bucket", salt))
    led = part.join(first.filter(F.col("lead") == FOLLOWS).select("part").distinct(), "part", "left_semi").select("bucket").distinct()
    if hot:
        led = led.unionByName(m.filter(F.col("bucket").isin(hot)).select("bucket")).distinct()
    mixed = cut(m.join(led, "bucket", "left_semi").join(comp.withColumnRenamed("node", "n"), "n", "left").select("n", "bucket", F.coalesce("comp", "n").alias("g")), "followed")
    apart = mixed.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high")
    side, n = cut_counted(mixed.join(apart, "bucket", "left_semi").join(banded.select("n", "signs"), "n"), "apart", **count)
    if n["rows"]:
        other = side.select("bucket", F.col("n").alias("lead"), F.col("g").alias("g2"), F.col("signs").alias("s2"))
        met = side.withColumnRenamed("signs", "s1").join(other, "bucket").filter("lead < n and g <> g2").select("n", "lead", "s1", "s2")
        near, n = cut_counted(met.mapInArrow(_near, "n long, lead long").distinct(), "pairs", **count)
        if n["rows"]:
            more, n = cut_counted(_links(near, rows, threshold, n["rows"]), "links", **count)
            if n["rows"]:
                comp = joined(links.unionByName(more))
    comp = comp.select(F.col("node").alias("rep"), "comp")
    named = hot_join(full, reps, ["set_id", "set_id2"], total=n_full).select("id", F.coalesce("rep", "n").alias("rep"))
    return hot_join(cut(named, "named"), comp, ["rep"], total=n_full).select("id", F.coalesce("comp", "rep").alias("cls"))
