"""Problems 2, 8 and 9: round trips, brute force, edge cases."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symgrove.llm import origin as O
from symgrove.llm import packing as P
from symgrove.llm import similar as S
from symgrove.llm import tokenizing as T

ODD = ["", " ", "a", "don't we'll", "  x \n\n y", "中文。ok", "<|endoftext|>", "x" * 500, "\t\t", "1 22 333", "'s", "''re", "👩‍💻"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'srelvdtm12中。é-aA\u00a0²<|>_", max_size=60), st.integers(1, 9))
def test_tree_equals_whole(text, leaf):
    assert T.encode(text, leaf=leaf) == T.encoder().encode_ordinary(text)


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for x in ODD:
        assert T.encode(x, leaf=3) == t.encode(x, add_special_tokens=False).ids


def test_join_is_associative():
    enc = T.encoder()
    a, b, c = ((x, enc.encode_ordinary(x)) for x in ("it is wha", "t we'l", "l see  \n now"))
    assert T.join(enc, T.join(enc, a, b), c) == T.join(enc, a, T.join(enc, b, c)) == ("it is what we'll see  \n now", enc.encode_ordinary("it is what we'll see  \n now"))


def test_corpus(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice([" the", "word", "\n", "中", "'ll", " 12"]) for _ in range(4000))
    rows = [(i, x, "e") for i, x in enumerate(ODD)] + [(90, None, "e"), (None, "x", "e"), (91, long, "e"), (91, long, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = [(r.doc_id, list(r.ids)) for r in T.encode_corpus(d, split_chars=700).collect()]
    assert sorted(map(str, got)) == sorted(str((i, T.encoder().encode_ordinary(x or ""))) for i, x, _ in rows)
    back = {(r.doc_id, r.text) for r in T.decode_corpus(T.encode_corpus(d)).collect()}
    assert back == {(i, x or "") for i, x, _ in rows}
    assert sum(r.n_tokens for r in T.encode_corpus(d, counts=True, split_chars=700).collect()) == sum(len(i) for _, i in got)
    assert T.encode_corpus(d.limit(0)).count() == 0


def check(rows, sizes, profiles):
    by = defaultdict(list)
    for r in rows:
        by[(r.profile, r.container_id)].append(r)
    parts = defaultdict(list)
    for (p, _), v in by.items():
        cap = dict(profiles)[p]
        v = sorted((r.container_from, r.n_tokens) for r in v if r.n_tokens)
        at = 0
        for start, n in v:
            assert start == at
            at += n
        assert at <= cap
    for r in rows:
        parts[(r.profile, r.doc_id)].append((r.part, r.token_from, r.n_tokens))
    for (p, doc), v in parts.items():
        n, cap = sizes[doc] or 0, dict(profiles)[p]
        assert sum(x[2] for x in v) == n and len(v) == max(1, -(-n // cap))
    assert len(parts) == len(sizes) * len(profiles)
    return by


def test_packing(spark):
    rnd = random.Random(2)
    sizes = {i: min(300, int(rnd.lognormvariate(3, 1))) for i in range(800)} | {900: 0, 901: None, 902: 64, 903: 1}
    profiles = [("s", 64), ("l", 250)]
    d = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    by = check(P.pack(d, profiles).collect(), sizes, profiles)
    for p, cap in profiles:
        used = sum(1 for k in by if k[0] == p)
        assert used <= 1.06 * sum(x or 0 for x in sizes.values()) / cap + 1
    s = {r.profile: r for r in P.pack_summary(P.pack(d, profiles), profiles).collect()}
    assert s["s"].n_tokens == sum(x or 0 for x in sizes.values())
    assert P.pack(d.limit(0), profiles).count() == 0 and P.pack(d, []).count() == 0
    with pytest.raises(ValueError):
        P.pack(d, [("x", 0)])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_histogram(hist):
    fill, per = defaultdict(int), defaultdict(int)
    for length, rank, n, first, filled in P.pack_histogram(hist, 20):
        assert rank == per[length]
        per[length] += n
        for c in range(first, first + n):
            assert fill[c] == filled
            fill[c] += length
    assert dict(per) == hist and all(x <= 20 for x in fill.values()) and sorted(fill) == list(range(len(fill)))


def test_similar_classes_by_brute_force(spark):
    rnd = random.Random(3)
    base = [sorted(rnd.sample(range(-(2**31), 2**31), 120)) for _ in range(25)]
    sets = {}
    for i, b in enumerate(base):
        for j in range(6):
            x = set(b)
            for _ in range(rnd.choice([0, 0, 2, 5, 30])):
                x.discard(rnd.choice(b))
                x.add(rnd.randint(-(2**31), 2**31 - 1))
            sets[f"{i}-{j}"] = sorted(x)
    sets["none"], sets["none2"] = [], []
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            u = {*sets[a]} | {*sets[b]}
            if a < b and u and len({*sets[a]} & {*sets[b]}) / len(u) >= 0.8:
                root[find(b)] = find(a)
    d = spark.createDataFrame([(k, "x", v) for k, v in sets.items()], "id string, block string, sketch array<int>")
    cls = {r.id: r.cls for r in S.similar_classes(d).collect()}
    groups = lambda f: {frozenset(k for k in sets if f(k) == c) for c in map(f, sets)}
    assert groups(cls.get) == groups(find)
    apart = d.withColumn("block", d["id"])
    assert len({r.cls for r in S.similar_classes(apart).collect()}) == len(sets)
    assert S.similar_classes(d.limit(0)).count() == 0


def test_long_files_of_different_length_are_linked(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(12):  # a long file with a fifth added to it
        words = [f"w{i}" if rnd.random() < 0.5 else rnd.choice(["+", "-", "*", "/", "(", ")", ";", "<", ">", "{", "}", "return", "if", "for"]) for _ in range(3000)]
        more = [rnd.choice(["&", "|", "^", "while", "case", "goto", "!", "?"]) for _ in range(450)]
        rows += [(2 * i, "r", f"a{i}.cpp", " ".join(words)), (2 * i + 1, "r", f"b{i}.cpp", " ".join(words + more))]
    f = O.scan_files(spark.createDataFrame(rows, "id long, repo string, file_path string, definition string")).collect()
    sets = {r.file_path: set(r.masked) for r in f}
    assert min(map(len, sets.values())) > 1024 and all(0.8 <= len(sets[f"a{i}.cpp"] & sets[f"b{i}.cpp"]) / len(sets[f"a{i}.cpp"] | sets[f"b{i}.cpp"]) < 0.85 for i in range(12))
    d = spark.createDataFrame([(r.file_path, "x", sorted(r.masked)) for r in f], "id string, block string, sketch array<int>")
    cls = {r.id: r.cls for r in S.similar_classes(d).collect()}
    assert all(cls[f"a{i}.cpp"] == cls[f"b{i}.cpp"] for i in range(12)) and len(set(cls.values())) == 12


def test_edge_of_a_group_is_linked_through_a_follower(spark):
    rnd = random.Random(9)
    new = lambda n: set(rnd.sample(range(-(2**31), 2**31), n))
    rows = []
    for i in range(3):  # a group around r; x is like r only
        r = new(1000)
        group = [set(rnd.sample(sorted(r), 955)) | new(45) for _ in range(60)]
        x = set(rnd.sample(sorted(r), 905)) | new(95)
        rows += [*((f"{i}-{j}", g) for j, g in enumerate(group)), (f"{i}-r", r), (f"{i}-x", x)]
        assert len(r & x) / len(r | x) >= 0.8 > max(len(g & x) / len(g | x) for g in group)
    d = spark.createDataFrame([(k, "x", sorted(v)) for k, v in rows], "id string, block string, sketch array<int>")
    cls = {r.id: r.cls for r in S.similar_classes(d).collect()}
    assert len(set(cls.values())) == 3 and all(cls[f"{i}-x"] == cls[f"{i}-r"] for i in range(3))


def hot(spark, monkeypatch, df):
    from symgrove.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    return {r.id: r.cls for r in S.similar_classes(df).collect()}


def test_hot_bucket_is_read_in_parts(spark, monkeypatch):
    base = list(range(1, 200))
    d = spark.createDataFrame([(str(i), "x", sorted([*base, 1000 + i])) for i in range(120)], "id string, block string, sketch array<int>")
    assert len(set(hot(spark, monkeypatch, d).values())) == 1


def code(rnd, n):
    words = ["alpha", "beta", "gamma", "delta", "omega", "theta", "kappa", "sigma"]
    ops = ["if (!{a}({b}, {n})) {{ return {c}; }}", "auto {a}_ = {b}({c}.size());", "{a}::{b}({c}[i]);", "for (int i = 0; i < {n}; i++) {{ {a}(i); }}", "{a}->{b} = {c} + {n};", "while ({a} != {b}) {c}++;"]
    return "\n".join(rnd.choice(ops).format(a=rnd.choice(words), b=rnd.choice(words), c=rnd.choice(words), n=rnd.randint(0, 99)) for _ in range(n))


def test_origins(spark):
    rnd = random.Random(4)
    own = [(f"r{i}", f"src/own{i}.cpp", code(rnd, 40)) for i in range(12)]
    shared = code(rnd, 30)
    blob = "static const int t[] = {" + ", ".join(hex(rnd.randint(0, 255)) for _ in range(400)) + "};"
    mini = "function a(e,t,n){" + "".join(f"e.x{i % 7}=t+{i};for(var i=0;i<{i};i++)b(i);" for i in range(60)) + "}"
    rows = [
        *own,
        ("a", "lib/x.cpp", shared),
        ("b", "other/x.cpp", shared.replace("\n", "\r\n  ")),
        ("a", "third_party/z/y.cpp", code(rnd, 20)),
        ("a", "src/vendors/y.cpp", code(rnd, 20)),
        ("a", "src/deps_graph/y.cpp", code(rnd, 20)),
        ("a", "src/m.js", mini),
        ("a", "src/t.h", blob),
        ("a", "src/short.h", "static const int t[] = {1, 2, 3, 4};"),
        ("a", "src/g.cpp", "// Code generated by tool 1.2. DO NOT EDIT.\n" + code(rnd, 20)),
        ("a", "src/g2.py", "# Diese Datei wurde maschinell erzeugt und darf nicht geändert werden.\ndef f(): pass"),
        ("a", "src/h.cpp", 'static const char* k = "Code generated by tool. DO NOT EDIT.";\n// used to be generated, now kept by hand\n' + code(rnd, 20)),
        ("a", "api/x_pb2.py", "class A: pass"),
        ("a", "src/none.cpp", None),
        (None, None, ""),
    ]
    s = spark.createDataFrame([(i, r, p, c, "k") for i, (r, p, c) in enumerate(rows + rows[:3])], "id long, repo string, file_path string, definition string, class_id string")
    got = {(r.repo, r.file_path): r.origin for r in O.file_origins(s).collect()}
    want = {("a", "lib/x.cpp"): "vendored", ("b", "other/x.cpp"): "vendored", ("a", "third_party/z/y.cpp"): "vendored", ("a", "src/m.js"): "minified", ("a", "src/t.h"): "data", ("a", "src/g.cpp"): "generated", ("a", "src/g2.py"): "generated", ("a", "api/x_pb2.py"): "generated"}
    assert {k: v for k, v in got.items() if v != "hand-written"} == want and len(got) == len(rows)
    assert O.file_origins(s.limit(0)).count() == 0


def test_families_within_a_repo(spark):
    rnd = random.Random(5)
    shape = code(rnd, 60)
    rows = [(i, "r", f"src/f{i}.cpp", shape.replace("alpha", f"alpha{i}").replace("beta", f"beta{i}")) for i in range(6)] + [(99, "r", "src/x.cpp", "\n".join(f"switch ({chr(97 + i)}) {{ case {i}: throw {chr(98 + i)} ? 1 : -{i} % 7; default: break; }}" for i in range(20)))]
    s = spark.createDataFrame(rows, "id long, repo string, file_path string, definition string")
    got = {r.file_path: (r.family, r.origin) for r in O.file_origins(s).collect()}
    assert all(got[f"src/f{i}.cpp"] == (True, "generated") for i in range(6)) and got["src/x.cpp"] == (False, "hand-written")


def test_hot_file_is_merged(spark, monkeypatch):
    from symgrove.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rnd = random.Random(6)
    rows = [(i, "r", "big.cpp" if i % 2 else f"f{i}.cpp", code(rnd, 5)) for i in range(80)]
    s = spark.createDataFrame(rows, "id long, repo string, file_path string, definition string")
    got = {r.file_path: r for r in O.scan_files(s).collect()}
    monkeypatch.setattr(skew, "HOT_ROWS", 10**9)
    want = {r.file_path: r for r in O.scan_files(s).collect()}
    assert got == want and len(got) == 41


def test_notices_by_masked_shingles():
    for line in ("Code generated by protoc-gen-go v1.2. DO NOT EDIT.", "Generated by the protocol buffer compiler. DO NOT EDIT!", "@generated 1d94fe226691 */", "AUTOGENERATED bridge 7eb", "自动生成的文件，请勿手工修改", "This file was automatically produced from schema/page.idl; changes will be lost.", "Ce fichier a été généré automatiquement, ne pas le modifier."):
        assert O.is_notice(line)
    for line in ("Code generated by hand is checked twice", "generated names are sorted first", "The created files are listed here.", "Licensed under the terms of the LICENSE file.", ""):
        assert not O.is_notice(line)


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for j in (0.5, 0.8, 0.95):
        u = rng.integers(-(2**31), 2**31, 3000).astype(np.int32)
        k = int(3000 * j)
        a, b = (np.frombuffer(S.bands(np.sort(x))[1], dtype=np.uint8) for x in (u[: k + (3000 - k) // 2], np.concatenate([u[:k], u[k + (3000 - k) // 2 :]])))
        assert abs((a == b).mean() - j) < 4 * (j * (1 - j) / S.SIGNS) ** 0.5 + 0.01


def test_texts_of_many_files_are_folded_at_once(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(11)
    rows = [("r", f"f{i // 3:03}." + ("py" if i // 3 % 2 else "cpp"), rnd.choice([code(rnd, 4), 'x = r"a b" + b.c1 # no', "a", "", None])) for i in range(600)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("abc", r)) for r in rows[i : i + 170]], pa.schema([(c, pa.string()) for c in "abc"])) for i in range(0, 600, 170)]
    table = lambda: [r for b in O._scan_files(iter(batches)) for r in b.to_pylist()]
    calls, real = [], O.shingles
    monkeypatch.setattr(O, "shingles", lambda *a: calls.append(1) or real(*a))
    got = table()
    assert len(calls) == 2 and len(got) == len({r[1] for r in rows})
    monkeypatch.setattr(O._Files, "FILES", 1)  # each file by itself
    assert table() == got and len(calls) == 2 + 2 * len(got)
    assert all(r["masked"] == sorted(set(r["masked"])) for r in got) and any(r["masked"] for r in got) and not all(r["masked"] for r in got)


def test_fast_tokens_are_the_tokens():
    import re

    rnd = random.Random(12)
    bits = ["a", "r", "b1", "f", "R", "x.y2", "1.5e3", "7", ".", "'", '"', "`", '"""', "'''", "//", "/*", "*/", "#", "\\", "\n", " ", "\t", "(", ")", ",", "_", "é", "日本", "-"]
    slow = [re.compile(p.pattern[len(O._FAST) :], re.S) for p in (O._TOKEN, O._TOKEN_PY)]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25)))
        for fast, p in zip((O._TOKEN, O._TOKEN_PY), slow):
            assert fast.findall(text) == p.findall(text)


def test_small_buckets_are_compared_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(13)
    rows, n = [], 0
    for part in range(300):  # of each bucket some rows are near the first and a few surely like it
        base = rnd.integers(0, 256, S.SIGNS, dtype=np.uint8)
        for _ in range(int(rnd.integers(2, 45 if part % 50 == 0 else 6))):
            x = base.copy()
            k = int(rnd.choice([0, 12, 30, 45, 120], p=[0.04, 0.06, 0.3, 0.3, 0.3]))
            x[rnd.permutation(S.SIGNS)[:k]] = rnd.integers(0, 256, k)
            rows.append((part, n, part % 70 == 69, x.tobytes()))
            n += 1
    want, lead = set(), {}
    for part, n, hot, x in rows:
        agree = [(m, (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) for m, y in lead.get(part, [])]
        want |= {(n, m, None) for m, a in agree if a >= S.NEAR}
        if any(a >= S.SURE for _, a in agree):
            want |= {(S.FOLLOWS, part)}
        else:
            lead.setdefault(part, []).append((n, x))
            want |= {(n, None, part)} if hot else set()
    calls, real = [], S._agree
    monkeypatch.setattr(S, "_agree", lambda x, y: calls.append(1) or real(x, y))
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("signs", pa.binary())])
    for step in (400, 7, 1):
        calls.clear()
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + step]), schema)], schema=schema) for i in range(0, len(rows), step)]
        got = [(r["n"], r["lead"], r["part"]) for b in S._leaders(batches) for r in b.to_pylist()]
        assert {(S.FOLLOWS, p) if m == S.FOLLOWS else (k, m, p) for k, m, p in got} == want
        assert step < 400 or len(calls) < len(rows) / 2
    assert {x[0] for x in want} >= {S.FOLLOWS} and any(x[1] is None for x in want if len(x) == 3)


def test_pairs_are_verified_by_whole_sets(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(14)
    rows = []
    for i in range(300):
        x = rnd.sample(range(-(2**31), 2**31), rnd.randint(1, 60))
        y = [v for v in x if rnd.random() < 0.92] + rnd.sample(range(-(2**31), 2**31), rnd.randint(0, 8))
        rows.append((i, -i, x, y or [5]))
    rows += [(300, -300, [1, 2, 3, 4], [4, 3, 2, 1, 0]), (301, -301, [-1], [-1]), (302, -302, [1], [2])]  # 0.8 itself, and negative members
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2)], names=["n", "lead", "s1", "s2"])
    want = [(n, m) for n, m, x, y in rows if len({*x} & {*y}) / len({*x} | {*y}) >= 0.8]
    for cells in (S.CELLS, 100, 1):
        monkeypatch.setattr(S, "CELLS", cells)
        got = [(r["n"], r["lead"]) for b in S._verified(0.8)([batch.slice(0, 100), batch.slice(100), batch.slice(0, 0)]) for r in b.to_pylist()]
        assert got == want and (300, -300) in got and (301, -301) in got and (302, -302) not in got
    assert S._agree(np.ones((1, S.SIGNS), np.uint8), np.ones(S.SIGNS, np.uint8))[0] == 1.0
