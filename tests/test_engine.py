"""Extraction, documents, store, linking, graph, indexing."""

import json
import subprocess
from io import StringIO

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symgrove.extract.cpp import extract
from symgrove.functions.text import tokens
from symgrove.operators import docs as D
from symgrove.operators import graph as G
from symgrove.operators import link as L
from symgrove.operators import resolve as R
from symgrove.operators import search as Q
from symgrove.operators import stats as A
from symgrove.operators import store as W
from symgrove.plans import api
from symgrove.plans import index as I
from symgrove.sources import files as S
from symgrove.streaming import ingest as N

INHERIT = """
/// Base.
class Base {
public:
  virtual int area() = 0;
};
struct Box : public Base {
  int area() override { help(); return help(); }
  int w_;
};
int run(Box b, int n = 2) { return twice(b); }
int twice(Box b) { return 2; }
"""


def edges_of(r):
    return {(r.symbols[s].name, k, t) for s, k, t, _ in r.edges}


def test_extract_inheritance():
    r = extract(INHERIT)
    assert [(s.kind, s.name) for s in r.symbols] == [("class", "Base"), ("field", "Base::area()"), ("struct", "Box"), ("method", "Box::area"), ("field", "Box::w_"), ("function", "run"), ("function", "twice")]
    e = edges_of(r)
    assert ("Box", "inherits", "Base") in e and ("Box::area", "overrides", "area") in e and ("Box", "contains", "w_") in e and ("Box::area", "calls", "help") in e
    assert ("run", "param_type", "Box") in e and ("run", "returns", "int") in e and ("Box::w_", "field_type", "int") in e
    assert sum(k == "param_type" for s, k, _ in e if s == "run") == 1


def test_extract_comments():
    src = "/// a\n\n//! b\nint f() { return 1; }\n/**\n * x\n */\nint g() { return 1; }\n// plain\nint h() { return 1; }\n/** one */\nvoid k() {}\n"
    d = {s.name: s.definition for s in extract(src).symbols}
    assert d["f"].startswith("/// a\n//! b\nint f") and d["g"].startswith("*/\nint g") and d["h"].startswith("int h") and d["k"].startswith("/** one */")
    assert not any(k == "returns" for s, k, *_ in extract("void k() {}").edges)


def test_extract_scopes_and_traps():
    src = 'namespace a { namespace b {\ntemplate <class T> struct V { T x; };\n} }\nextern "C" { int c(void) { return 0; } }\n#if 0\nint hidden() { return 1; }\n#endif\nconst char* s = "}{ int no() {}";\n// int no2() {}\nenum class E : int { A };\nstruct W { W() : a{1}, b(2) { go(); } int a, b; };\n'
    names = [s.name for s in extract(src).symbols]
    assert names == ["V", "V::x", "c", "hidden", 's = "}{ int no() {}"', "E", "W", "W::W", "W::a"]
    assert "hidden" not in [s.name for s in extract(src, descend_macros=False).symbols]
    assert ("W::W", "calls", "go") in edges_of(extract(src))
    assert extract("", "cpp").symbols == [] and extract("def f(): pass", "python").symbols == [] and extract("int f( {").symbols == []
    big = "int f() {" + "{" * 500 + "}" * 500 + "}"
    assert [s.name for s in extract(big).symbols] == ["f"]


SECTIONS = "intro\n\n## One\n\n\ntext\n### Two\n#### deep\n# Title\nlost? no\n## Three\n```\n## Four\n```\n"


def test_sections():
    got = D.sections(SECTIONS, "stem")
    assert [(t, s, n) for t, s, _, n in got] == [("stem", "", 0), ("stem", "One", 2), ("Title", "", 3), ("Title", "Three", 2), ("Title", "Four", 2), ("Title", "", 1)]
    assert got[1][2] == "text\n" and got[-1][2] == SECTIONS
    assert D.sections("", "s") == [("s", "", "", 1)]


def test_glossary_and_includes(spark):
    assert D.glossary("## fast lane (dev/x)\nfirst\nsecond\n\n## a / b-1\n# no branch\n### q → main\n") == [("fast lane", "dev/x", "first second"), ("a", "b-1", ""), ("q", "main", "")]
    f = spark.createDataFrame([("r", "a.h", '#include <v>\n#include "x/y.h"\n'), ("r", "b.h", "#include <v>"), ("r", "n.h", None)], "repo string, file_path string, content string")
    inc = D.file_includes(f)
    assert inc.count() == 3 and D.include_edges(inc).count() == 2
    assert {r.file_path for r in D.doc_sections(f).collect()} == {"a.h", "b.h"}


KEYED = "content_hash string, file_path string, name string, repo string, id long, kind string, line_start int, line_end int"


def test_upsert(spark):
    old = spark.createDataFrame([("h", "f", "n", "r", 1, "k", 1, 2)], KEYED)
    new = spark.createDataFrame([("h", "f", "n", "r", 5, "other", 7, 8), ("h", "f", "n", "r", 6, "other", 9, 10), ("h2", "f", None, "r", 7, "k", 1, 1)], KEYED)
    got = {r.id: (r.kind, r.line_start) for r in W.upsert_symbols(old, new, ["id"]).collect()}
    assert got == {1: ("k", 9), 7: ("k", 1)}
    once = W.upsert_symbols(old, new, ["id"])
    assert sorted(W.upsert_symbols(once, new, ["id"]).collect()) == sorted(once.collect())


def test_insert_replace_delete(spark):
    e = "source_id long, edge_type string, source_repo string, v int"
    old = spark.createDataFrame([(1, "a", None, 1)], e)
    new = spark.createDataFrame([(1, "a", None, 2), (2, "a", "r", 4), (2, "a", "r", 3)], e)
    assert sorted(r.v for r in W.insert_or_ignore(old, new, ["source_id", "edge_type", "source_repo"], ["v"]).collect()) == [1, 3]
    assert [r.v for r in W.replace_latest(new, ["source_id"], ["v"]).orderBy("source_id").collect()] == [2, 4]
    b = spark.createDataFrame([("r", "x"), ("", "x"), (None, "x"), ("q", "x"), ("r", None)], "repo string, branch_name string")
    assert {tuple(r) for r in W.delete_branch(b, "x", "r").collect()} == {("q", "x"), ("r", None)}


def test_similarity_join(spark):
    import random

    rnd = random.Random(0)
    a = [(i, rnd.choice(["r", "q", None]), rnd.sample("abcdefghij", rnd.randint(0, 6))) for i in range(60)]
    b = [(i, rnd.choice(["r", "q", "", "p"]), rnd.sample("abcdefghij", rnd.randint(0, 6))) for i in range(60)]
    da, db = (spark.createDataFrame(x, "id long, repo string, tokens array<string>") for x in (a, b))

    def like(x, y, t):
        return x and y and len({*x} & {*y}) / len({*x} | {*y}) >= t

    want = {(i, j) for i, r, x in a for j, q, y in b if (r or "") == (q or "") and like(x, y, 0.3)}
    assert {(r.doc_node_id, r.symbol_id) for r in L.doc_code_links(da, db, 0.3).collect()} == want
    for t, rows in ((0.05, 7), (1.0, 2000)):
        left, right = ({frozenset(x) for _, _, x in side if x} for side in (a, b))
        want = sorted((min(i for i, _, z in a if {*z} == x), min(i for i, _, z in b if {*z} == y)) for x in left for y in right if like(x, y, t))
        assert sorted((r.left_id, r.right_id) for r in L.similarity_join(da, db, t, block_rows=rows).collect()) == want
    assert L.similarity_join(da.limit(0), db, 0.1, by="repo").count() == 0
    with pytest.raises(ValueError):
        L.similarity_join(da, db, 0)


def test_salted_join(spark, monkeypatch):
    from symgrove.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    left = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(300)] + [(None, 1)], "k long, a long")
    right = spark.createDataFrame([(7, 1), (7, 2), (4, 3), (4, 4), (5, 5), (None, 6)], "k long, b long")
    got = sorted(tuple(r) for r in skew.salted_join(left, right, ["k"], share=0.1).collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").collect()) and len(got) == 302


def test_resolve(spark):
    s = spark.createDataFrame([(1, "r", "f", "x"), (2, "r", "g", "x"), (3, "r", "g", "y"), (4, "q", "f", "z")], "id long, repo string, file_path string, name string")
    raw = spark.createDataFrame([("r", "g", "x"), ("r", "f", "y"), ("r", "f", "z"), ("r", "f", None)], "repo string, file_path string, edge_target string")
    assert sorted(r.target_id for r in R.resolve_targets(raw, s).collect()) == [0, 0, 2, 3]


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, "calls:x", None) for a, b in pairs], "source_id long, target_id long, edge_type string, edge_kind string")


def test_reach(spark):
    e = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (5, 2), (6, 0), (1, 2)])
    s = spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)], "id long, name string")
    roots = spark.createDataFrame([(1,), (9,)], "id long")
    got = {(r.root_id, r.id): (r.depth, r.name) for r in G.call_graph(roots, e, s, "callees", 2).collect()}
    assert got == {(1, 1): (0, "n1"), (1, 2): (1, "n2"), (1, 3): (1, "n3"), (1, 4): (2, "n4"), (9, 9): (0, "")}
    up = {r.id: r.depth for r in G.call_graph(roots.limit(1), e, s, "anything", 3).collect()}
    assert up == {1: 0, 4: 1, 3: 2, 2: 3}


def test_stats_and_search_on_empty_tables(spark):
    from symgrove.schemas import empty

    s, e, d = (empty(spark, t) for t in ("symbols", "edges", "doc_nodes"))
    assert A.status(s, e, d, empty(spark, "doc_code_links")).count() == 0 and A.kind_histogram(s).count() == 0 and A.edge_type_rollup(e).count() == 0 and A.top_referenced(e, s).count() == 0
    assert Q.semantic_search(d, s, "anything here").count() == 0 and Q.get_definition(s, "x").count() == 0 and Q.full_text(s, "x").count() == 0


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=t@t", "-c", "user.name=t", *args], check=True, capture_output=True)


def snapshot(store):
    s = sorted((r.file_path, r.name, r.id) for r in store.read("symbols").collect())
    e = sorted((r.source_id, r.target_id, r.edge_type) for r in store.read("edges").collect())
    return s, e, store.read("doc_nodes").count(), store.read("doc_code_links").count()


def test_index(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "skip").mkdir()
    (root / "src/a.cpp").write_text(INHERIT)
    (root / "src/b.cpp").write_text('#include "a.h"\nint other() { return run(1); }\n')
    (root / "src/bad.cpp").write_bytes(b"int x\xff\xfe() {}")
    (root / "skip/c.cpp").write_text("int skipped() { return 1; }")
    (root / ".symgroveignore").write_text("# none\nskip/\n")
    (root / "doc.md").write_text("# Area\n## Twice run\nThe function twice calls help area box.\n## lane (dev)\nfast\n")
    git(root.parent, "init", "-q", "-b", "main", str(root))
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    store = W.Store(spark, str(tmp_path / "store"))
    r = I.index(spark, store, str(root), "demo")
    assert r.mode == "full" and r.symbols == 8 and r.sections == 3
    before = snapshot(store)
    names = {n: i for _, n, i in before[0]}
    assert (names["other"], names["run"], "calls:run") in before[1] and (0, 0, "includes:a.h") in before[1] and (names["Box"], names["Box::area"], "contains:area") in before[1]
    assert I.index(spark, store, str(root), "demo").mode == "up to date" and snapshot(store) == before
    # a branch with one file changed and one removed
    git(root, "checkout", "-qb", "dev")
    (root / "src/b.cpp").write_text("int newer() { return twice(1); }\n")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "two")
    r = I.index(spark, store, str(root), "demo")
    assert r.mode == "from parent" and r.files == 1
    view = lambda b: {x.name for x in A.in_branch(store.read("symbols"), store.read("branches"), b).collect()}
    assert "newer" in view("dev") and "other" not in view("dev") and "run" in view("dev") and "other" in view("main") and "newer" not in view("main")
    (root / "src/b.cpp").unlink()
    git(root, "add", "-A")
    git(root, "commit", "-qm", "three")
    assert I.index(spark, store, str(root), "demo").mode == "incremental"
    assert "newer" not in view("dev") and "newer" not in view("") and "other" in view("main")
    assert [x.alias for x in store.read("branch_glossary").collect()] == ["lane"]
    I.set_alias(store, "demo", "dev", "lane", "slow")
    assert [x.description for x in store.read("branch_glossary").collect()] == ["slow"]
    # the text face
    assert "Symbols:" in api.overview(store, "demo") and "resolved" in api.status(store, "demo")
    assert "already shown" not in api.get_call_graph(store, "twice", "demo") and "run" in api.get_call_graph(store, "twice", "demo")
    assert "Box::area" in api.list_symbols(store, "AREA", "demo") and "No exact" in api.get_definition(store, "Box:", "demo") and "int twice" in api.get_definition(store, "twice", "demo")
    assert "help" in api.search(store, "help", "demo") or "Box" in api.search(store, "help", "demo")
    assert "twice" in api.semantic_search(store, "twice box area help", "demo").lower()
    out = StringIO()
    api.serve(store, ['{"id":1,"method":"tools/list"}', "nope", '{"id":2,"method":"x"}', '{"method":"note"}', '{"id":3,"method":"tools/call","params":{"name":"status","arguments":{"repo":"demo"}}}'], out)
    a = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(a) == 4 and a[1]["error"]["code"] == -32700 and a[2]["error"]["code"] == -32601 and "Symbols" in a[3]["result"]["content"][0]["text"]
    other = store.copy_to(str(tmp_path / "copy"))
    assert snapshot(other)[0] == snapshot(store)[0]
    I.clean(store, "demo", "dev")
    assert store.read("branches").filter("branch_name = 'dev'").count() == 0
    I.clean(store, "demo")
    assert store.read("symbols").count() == 0
    I.clean(other)
    assert other.read("symbols").count() == 0


def test_production_links_are_registered(spark, data):
    from symgrove.plans.catalogue import QUERIES

    got = [r.strength for r in QUERIES["link_pairs"](spark, data).collect()]
    assert min(got) >= I.LINK_THRESHOLD == 0.05 and any(x < 0.3 for x in got)


def test_strengths_are_rounded_as_in_sql(spark):
    import duckdb

    sets, pairs = {"left": [], "right": []}, []
    for union in (128, 640):  # of the first odd overlaps are halves at the sixth place, of the second halves that floats do not hold
        half = [f"t{k}" for k in range(union // 2)]
        sets["left"].append((union, str(union), half))
        for both in range(1, union // 2, 2):
            sets["right"].append((1000 * union + both, str(union), half[:both] + [f"x{k}" for k in range(union // 2)]))
            pairs.append(f"({union}, {both})")
    want = {(u, 1000 * u + i): r for u, i, r in duckdb.sql(f"select u, i, round(i / u, 6) from (values {', '.join(pairs)}) t(u, i)").fetchall()}
    left, right = (spark.createDataFrame(sets[k], "id long, repo string, tokens array<string>") for k in ("left", "right"))
    got = {(r.left_id, r.right_id): r.strength for r in L.similarity_join(left, right, 1e-6, by="repo").collect()}
    assert got == want and got[128, 128009] == 0.070313


def test_all_bases_are_ancestors(spark):
    e = [(3, 1), (3, 2), (4, 3), (2, 5), (6, 7), (7, 6), (8, 6), (9, 9), (10, 9), (4, 5), (11, 0)]
    edges = spark.createDataFrame([(a, b, "inherits:x", None) for a, b in e + e[:2]] + [(1, 12, "calls:x", None)], "source_id long, target_id long, edge_type string, edge_kind string")
    got = sorted(tuple(r) for r in G.inheritance_chain(edges).select("node_id", "ancestor_id", "distance").collect())
    assert got == [(2, 5, 1), (3, 1, 1), (3, 2, 1), (3, 5, 2), (4, 1, 2), (4, 2, 2), (4, 3, 1), (4, 5, 1), (6, 7, 1), (7, 6, 1), (8, 6, 1), (8, 7, 2), (10, 9, 1)]


def test_searches_take_every_50th_row(spark, data):
    from symgrove.plans.catalogue import QUERIES
    from symgrove.session import table

    ids = lambda name, col: {r[0] for r in table(spark, data, name).filter(f"{col} % 50 = 0").select(col).collect()}
    got = QUERIES["semantic_search_many"](spark, data).collect()
    assert {(r.query_source, r.query_id) for r in got} == {("doc", i) for i in ids("doc_nodes", "id")} | {("symbol", i) for i in ids("symbols", "id")}
    assert {r.query_id for r in QUERIES["nearest_vectors_many"](spark, data).collect()} == ids("embeddings", "vec_id")


def test_many_searches_do_not_join_rows_on_tokens(spark, data):
    from symgrove.plans.catalogue import QUERIES

    plan = QUERIES["semantic_search_many"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_many_searches_as_by_hand(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join({words[min(int(rnd.expovariate(0.12)), 59)] for _ in range(rnd.choice((0, 2, 5, 9, 30)))}) for _ in range(700)]
    docs = [(k, "t", "p", x) for k, x in enumerate(texts[:200])] + [(7, "t", "p", texts[7]), (None, "t", "p", texts[7])]  # an id twice, and none
    syms = [(k, "method", f"n{k % 5}", x) for k, x in enumerate(texts[200:])] + [(9, None, None, None)]
    d, s = spark.createDataFrame(docs, "id long, title string, section_path string, content string"), spark.createDataFrame(syms, "id long, kind string, name string, definition string")
    asked = [("doc", 7, texts[7].split()), ("doc", 1, [])] + [("symbol", k, ["method", *texts[200 + k].split(), "unknown"][k % 2 :]) for k in range(0, 500, 9)]
    q = spark.createDataFrame(asked, "query_source string, query_id long, tokens array<string>")
    own = lambda *x: set(" ".join(v for v in x if v).split())
    rows = [("doc", i, t, own(t, p, c) - {"t", "p"}, Q.DOC_MIN) for i, t, p, c in docs] + [("symbol", i, n, own(k, n, c), Q.SYMBOL_MIN) for i, k, n, c in syms]
    want = []
    for qs, qi, tokens in asked:
        near = [(qs, qi, src, i, label, round(len(t & set(tokens)) / len(t | set(tokens)), 6)) for src, i, label, t, least in rows if t & set(tokens) and len(t & set(tokens)) / len(t | set(tokens)) > least]
        want += sorted(near, key=lambda x: (-x[5], x[2], x[3] is None, x[3] or 0))[:10]
    key = lambda x: (x[0], x[1], -x[5], x[2], x[3] is None, x[3] or 0)
    usual = Q.semantic_search_many(d, s, q).collect()
    assert sorted(map(tuple, usual), key=key) == sorted(want, key=key) and any(r.id is None for r in usual)
    monkeypatch.setattr(Q, "GROUP_QUERIES", 20)
    assert sorted(map(tuple, Q.semantic_search_many(d, s, q).collect()), key=key) == sorted(want, key=key)
    for name, value in (("INDEX_ROWS", 25), ("DENSE_TOKENS", 30), ("FIRST_ROWS", 12)):
        monkeypatch.setattr(Q, name, value)
    table = pa.table([*map(list, zip(*[(src, i, label, sorted(t), least) for src, i, label, t, least in rows]))], names=["source", "id", "label", "t", "least"])
    queries = pa.table([*map(list, zip(*asked))], names=["query_source", "query_id", "t"])
    bound, got = np.zeros(len(asked)), {}
    for k in range(0, table.num_rows, 150):  # the bounds of the first blocks hold for the next
        for r in Q._best_rows(queries, table.slice(k, 150), bound, 10).to_pylist():
            got.setdefault((r["query_source"], r["query_id"]), []).append(tuple(r.values()))
    assert sorted([r for x in got.values() for r in sorted(x, key=key)[:10]], key=key) == sorted(want, key=key)


def test_call_graph_of_many_symbols_of_one_name(spark):
    class Frames:
        frames = {
            "symbols": spark.createDataFrame([(i, "r", "dup") for i in range(1, 71)] + [(i, "r", f"by{i}") for i in range(101, 171)], "id long, repo string, name string"),
            "branches": spark.createDataFrame([], "symbol_id long, repo string, branch_name string"),
            "edges": spark.createDataFrame([(i, 100 + i, i, "calls:dup", "calls") for i in range(1, 71)], "id long, source_id long, target_id long, edge_type string, edge_kind string"),
        }

        def read(self, name, repo=None):
            return self.frames[name]

    Frames.spark = spark
    got = api.get_call_graph(Frames(), "dup", "r")
    assert all(f"● dup (id={i})" in got and f"↳ by{100 + i} (calls:dup)" in got for i in range(1, 71))


def test_scan_without_git(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.txt").write_text("y")
    got = S.scan(spark, str(tmp_path)).select("path", "content", "language", "valid").orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a.py", "x = 1", "python", True), ("b.txt", "y", None, True)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.cpp").write_text("int f() { return g(); }\n")
    store = W.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        N.ingest(N.source_stream(spark, str(src), "r"), store, str(tmp_path / "cp")).awaitTermination(120)
    assert [r.name for r in store.read("symbols").collect()] == ["f"]


def test_tokens_are_null_safe(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r[0] for r in df.select(F.size(tokens(F.col("t")))).collect()] == [0, 0]


def test_configuration(tmp_path):
    from symgrove.config import Config, Project, Repo

    path = tmp_path / "c.json"
    assert Config.load(str(path)) == Config()
    path.write_text('{"projects": {"p": {"repos": {"r": {"root": "/x", "languages": ["cpp"]}, "q": {"root": "/y"}}, "link_threshold": 0.1}, "e": null}}')
    assert Config.load(str(path)).projects == {"p": Project({"r": Repo("/x", ["cpp"]), "q": Repo("/y")}, None, 0.1), "e": Project()}
    with pytest.raises(ValueError):
        Config.of({"projects": {"p": {"thresh": 1}}})


def test_embedders(spark):
    from symgrove.functions.embedders import NullEmbedder, TokenEmbedder, VectorEmbedder

    df = spark.createDataFrame([("read the file", "file read twice")], "a string, b string")
    for e, want in ((TokenEmbedder(), 2 / 3), (VectorEmbedder(lambda c: F.array(F.length(c).cast("float"), F.lit(0.0)), 2), 1.0), (NullEmbedder(), 0.0)):
        assert df.select(e.similarity(e.embed(F.col("a")), e.embed(F.col("b"))).alias("s")).first().s == pytest.approx(want)


def test_http():
    import threading
    import urllib.request

    server = api.http_server(None)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/"

    def post(body):
        with urllib.request.urlopen(urllib.request.Request(url, data=body, method="POST")) as r:
            return json.loads(r.read())

    try:
        got = post(b'{"id": 1, "method": "tools/list"}')["result"]["tools"]
        assert len(got) == 11 and got[2]["inputSchema"]["required"] == ["pattern"] and got[4]["inputSchema"]["properties"]["max_depth"]["default"] == 3
        assert post(b"{")["error"]["code"] == -32700 and post(b'{"id": 1, "method": "x"}')["error"]["code"] == -32601
    finally:
        server.shutdown()


def test_store_replaces_one_repository(spark, tmp_path):
    store = W.Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(i, r, b, None, None) for i, r, b in x], store.read("branches").schema)
    store.write("branches", rows((1, "r", "m"), (2, "q", "m"), (3, None, "m")))
    held = store.read("branches")
    assert store.read("branches", "r").count() == 1 and store.read("branches", "").count() == 1
    assert store.replace("branches", "r", rows((1, "r", "m"), (4, "r", "d"))) == 2
    store.replace("branches", "", delete_rows := W.delete_branch(store.read("branches", ""), "m", "r"))
    assert delete_rows.columns and sorted(r.symbol_id for r in store.read("branches").collect()) == [1, 2, 4]
    assert held.count() == 3  # a reader of the old state is not disturbed
    assert sorted(r.symbol_id for r in store.copy_to(str(tmp_path / "t")).read("branches").collect()) == [1, 2, 4]
    assert W.Store(spark, str(tmp_path / "none")).read("symbols", "r").count() == 0
