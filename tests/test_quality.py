"""Problems 5 to 7: brute force on small fixtures and the edge cases."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from symgrove.operators import components as C
from symgrove.operators import hierarchy as H
from symgrove.operators import orphans as O
from symgrove.operators import skew as S

DAY = datetime(2024, 3, 1)


def at(n):
    return DAY + timedelta(hours=n)


def test_orphans(spark):
    parents = spark.createDataFrame([(1, at(0), "x"), (2, at(9), "y"), (2, at(5), "y"), (3, None, "z"), (None, at(0), "n")], "id long, recorded_at timestamp, ref_at string")
    refs = spark.createDataFrame([("a", 1, at(1)), ("b", 2, at(4)), ("c", 2, at(5)), ("d", 7, at(1)), ("e", 0, at(1)), ("f", None, at(1)), ("g", 3, at(0)), ("h", -4, None), ("d", 7, at(1)), ("i", 1, None)], "row_key string, ref_id long, ref_at timestamp")
    got = sorted((r.row_key, r.reason) for r in O.orphan_references(refs, parents).collect())
    assert got == [("b", "late"), ("d", "absent"), ("d", "absent"), ("h", "absent")]
    assert O.orphan_references(refs, parents.limit(0)).count() == 8
    assert O.orphan_references(refs.limit(0), parents).count() == 0


def test_orphans_by_brute_force(spark):
    rnd = random.Random(1)
    par = {i: rnd.randint(0, 99) for i in rnd.sample(range(1, 5000), 2000)}
    rows = [(str(k), 7 if rnd.random() < 0.4 else rnd.randint(0, 5000), rnd.randint(0, 99)) for k in range(6000)]
    parents = spark.createDataFrame([(i, at(t)) for i, t in par.items()], "id long, recorded_at timestamp")
    refs = spark.createDataFrame([(k, i, at(t)) for k, i, t in rows], "row_key string, ref_id long, ref_at timestamp")
    want = {k for k, i, t in rows if i and (i not in par or par[i] > t)}
    assert {r.row_key for r in O.orphan_references(refs, parents).collect()} == want


def test_filter_has_no_false_negatives_and_is_bounded(spark):
    keys = spark.range(0, 30000, 3).withColumnRenamed("id", "k")
    b = O.bloom_filter(keys, "k", 10000)
    hit = spark.range(30000).withColumn("m", O.might_contain(keys, b, "id"))
    assert hit.filter("id % 3 = 0 and not m").count() == 0
    assert hit.filter("id % 3 <> 0 and m").count() < 1000
    assert len(O.bloom_filter(keys, "k", 10000, max_bits=4096)) < 1024


def test_references_of_a_branch_without_name(spark):
    e = spark.createDataFrame([], "id long, source_id long, target_id long, recorded_at timestamp")
    b = spark.createDataFrame([(9, None, at(0)), (9, None, at(0))], "symbol_id long, branch_name string, recorded_at timestamp")
    s = spark.createDataFrame([], "id long, recorded_at timestamp")
    assert [tuple(r)[:4] for r in O.orphan_cases(e, b, s).collect()] == [("branches", "symbol_id", "9:", "2024-03")]


def brute_gaps(rows, burst):
    by = defaultdict(list)
    for k, t, i in rows:
        by[k].append((t, i))
    out = {}
    for k, v in by.items():
        v.sort()
        gaps = [(b[0] - a[0]).total_seconds() for a, b in zip(v, v[1:])]
        out[k] = (len(v), v[0][0], v[-1][0], max(gaps) if gaps else None, 1 + sum(g > burst for g in gaps))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 100000])
def test_gaps_of_a_hot_key(spark, chunk):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 30)}", at(rnd.randint(0, 3000)), i) for i in range(2000)]
    rows += [(None, at(1), -1), ("lone", at(2), -2), ("tie", at(3), -3), ("tie", at(3), -4)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i long")
    got = {r.k: (r.n_rows, r.first_at, r.last_at, r.longest_gap_s, r.n_bursts) for r in S.chunked_gaps(df, ["k"], "t", "i", chunk_rows=chunk, burst_s=3600).collect()}
    assert got == brute_gaps(rows, 3600)


def test_gaps_without_times(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", at(0), 2), ("b", None, 3)], "k string, t timestamp, i long")
    got = {r.k: (r.n_rows, r.n_bursts) for r in S.chunked_gaps(df, ["k"], "t", "i").collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}
    assert S.chunked_gaps(df.limit(0), ["k"], "t", "i").count() == 0


def test_numbers_are_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["x", "x", "x", "y", None]), rnd.randint(0, 10**6)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = defaultdict(list)
    for r in S.number_rows(df, ["k"], ["o"], parts=7).collect():
        got[r.k].append((r.rn, r.o))
    for k, v in got.items():
        v.sort()
        assert [n for n, _ in v] == list(range(len(v)))
        assert [o for _, o in v] == sorted(o for kk, o in rows if kk == k)


def test_frequent_keys(spark):
    df = spark.createDataFrame([("a", 98), ("b", 1), ("c", 2)], "key string, n_rows long")
    assert {r.key for r in S.frequent_keys(df, 101, 0.015).collect()} == {"a", "c"}
    assert S.frequent_keys(df, 0).count() == 0


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(i, -i) for i in range(2, 40)] + [(None, 0)], "k long, v long")
    right = spark.createDataFrame([(1, "one"), (5, "five")], "k long, name string")
    got = sorted((r.v, r.name) for r in S.hot_join(left, right, ["k"]).collect() if r.name)
    assert len(got) == 501 and S.hot_join(left, right, ["k"]).count() == left.count()
    assert S.hot_keys(left, ["k"]) == [(1,)]


def brute_tree(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in {*parent, *parent.values()}:
        path, x, seen = [n], n, {n}
        while x in parent:
            x = parent[x]
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
        out[n] = (0, -1, []) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def random_forest(seed, n=400):
    rnd = random.Random(seed)
    links = [(i, rnd.randint(max(1, i - 9), i - 1) if rnd.random() < 0.9 else 1) for i in range(2, n)]
    links += [(n + 1, n + 2), (n + 2, n + 3), (n + 3, n + 1), (n + 4, n + 2), (n + 5, n + 5), (n + 6, n + 4), (n + 7, None), (None, n)]
    return links + links[:5] + [(2, 1)]


@pytest.mark.parametrize("limit", [10**6, 3])
def test_hierarchy(spark, limit):
    links = random_forest(4)
    df = spark.createDataFrame(links, "child long, parent long")
    want = brute_tree(links)
    rows = H.hierarchy(df, max_component=limit).collect()
    got = {r.node_id: (r.root_id, r.node_depth, list(r.path)) for r in rows}
    assert got == want and len(rows) == len(want)
    below = defaultdict(int)
    for root, depth, path in want.values():
        for a in path[:-1]:
            below[a] += 1
    assert {r.node_id: r.n_descendants for r in rows if r.node_depth >= 0} == {n: below[n] for n, v in want.items() if v[1] >= 0}
    assert sum(r.back_edge for r in rows) == 2
    pairs = {(r.ancestor_id, r.node_id, r.distance) for r in H.descendants(H.hierarchy(df)).collect()}
    assert pairs == {(a, n, len(p) - 1 - i) for n, (_, _, p) in want.items() for i, a in enumerate(p[:-1])}


def test_long_chain_and_long_cycle(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    ring = [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(2000 + i, 2001 + i) for i in range(20)] + [(2020, 1003)]
    got = {r.node_id: (r.root_id, r.node_depth) for r in H.hierarchy(spark.createDataFrame(chain + ring, "child long, parent long")).collect()}
    assert got[1] == (300, 299) and got[300] == (300, 0) and got[1000] == (0, -1) and got[2000] == (0, -1) and len(got) == 300 + 37 + 21


def test_large_components_have_the_same_rows(spark):
    ring = [(1, 2), (2, 3), (3, 1), (5, 4), (4, 1), (6, 3), (7, 7), (8, 7), (9, 8)] + [(100 + i, 100 + (i + 1) % 11) for i in range(11)] + [(200 + i, 201 + i) for i in range(30)] + [(230, 104)]
    links = spark.createDataFrame(ring + [(1000 + c, 1000 + p) for c, p in random_forest(9, 60)[:50]], "child long, parent long")
    fields = ["node_id", "parent_id", "root_id", "node_depth", "back_edge", "component", "path", "n_descendants"]
    small, large = (sorted(tuple(map(str, r)) for r in H.hierarchy(links, max_component=m).select(fields).collect()) for m in (10**6, 2))
    assert small == large
    backs = {int(r[0]) for r in small if r[4] == "True"}
    assert backs == {3, 7, 110}
    plain = [sorted(tuple(map(str, r)) for r in H.hierarchy(links, max_component=m, paths=False).select(fields[:6]).collect()) for m in (10**6, 2)]
    assert plain[0] == plain[1] == [r[:6] for r in small]


def test_walk_of_a_long_chain_holds_no_paths():
    import tracemalloc

    rows = [(i, i + 1 if i < 50_000 else None, 50_000) for i in range(1, 50_001)]
    tracemalloc.start()
    depth = max(r[3] for r in H._walk(rows, False))
    assert depth == 49_999 and tracemalloc.get_traced_memory()[1] < 100 * 2**20
    tracemalloc.stop()


def test_no_links(spark):
    assert H.hierarchy(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_symbol_links(spark):
    s = spark.createDataFrame(
        [(1, "r", "f", "A", "class", None), (2, "r", "f", "B", "class", None), (3, "r", "f", "A::m", "method", "A"), (4, "r", "f", "A::x", "field", "A"), (5, "r", "g", "A::y", "field", "A"), (6, "r", "f", "A", "class", "A"), (7, "r", "f", "h", "function", None)],
        "id long, repo string, file_path string, name string, kind string, parent_class string",
    )
    e = spark.createDataFrame([(2, 1, "inherits:A", None), (2, 1, "inherits:A", "inherits"), (2, 3, "contains:m", "contains"), (9, 4, "contains:x", "contains"), (7, 0, "calls:z", "calls")], "source_id long, target_id long, edge_type string, edge_kind string")
    got = {(r.child, r.parent) for r in H.symbol_links(s, e).collect()}
    assert got == {(2, 1), (3, 2), (4, 1), (6, 1)}


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.comp for r in C.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("a", at(0), 1, 5), ("a", at(1), 2, 6)], "k string, t timestamp, i long, chunk long")
    assert S.chunked_gaps(df.select("k", "t", "i", F.col("chunk").alias("gap")), ["k"], "t", "i").first().n_rows == 2
