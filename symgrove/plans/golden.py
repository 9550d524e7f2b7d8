"""A small source tree under git, and queries that run the whole indexing path over it, with the rows they must give."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove.functions.text import ignored
from symgrove.operators.docs import branch_glossary
from symgrove.operators.stats import in_branch
from symgrove.operators.store import Store
from symgrove.plans import api
from symgrove.plans import index as I
from symgrove.session import shared_dir, ship
from symgrove.sources import git

REPO = "golden"
#: The tree at its first commit; what the last five hold must not be indexed.
TREE: dict[str, bytes] = {
    "include/shapes.h": b"""#ifndef SHAPES_H
#define SHAPES_H
#include <vector>
#include "core/base.h"

/// Anything with an area.
class Shape {
public:
  virtual double area() const = 0;
};

//! A box.
struct Box : public Shape {
  double area() const override { return scale(w_ * h_, 2); }
  double w_;
  Colour edge_ = RED;
};

enum Colour { RED, GREEN };
#endif
""",
    "src/shapes.cpp": b"""#include <vector>
#include "shapes.h"

/**
 * Times a factor.
 */
double scale(double x, long by) { return x * by; }

namespace geo {
template <class T> T total(const std::vector<T>& all, int from = 0) {
  T sum = scale(from, 1);
  for (auto& b : all) sum += b.area();
  return scale(sum, 1) + scale(sum, 2);
}
}
int counter = 7;
extern "C" { void report(Box box) { geo::total(box); printf("}{ %d", counter); } }
""",
    "src/run.cpp": b"int run() { report(Box()); return scale(2, 3); }\n",
    "tools/gen.py": b"def gen():\n    pass\n",
    "docs/guide.md": b"""before

# Shapes
## Area of a box

The box area is scale of both.
### Notes
#### deep
## fast lane (dev/x)
all new work
goes here

## stable / v1.0
# End
""",
    ".symgroveignore": b"# made by a tool\nskip/\n*.gen.cpp\n",
    ".gitignore": b"build/\n",
    "skip/a.cpp": b"int skipped() { return 1; }\n",
    "src/x.gen.cpp": b"int made() { return 1; }\n",
    "build/out.cpp": b"int built() { return 1; }\n",
    "src/bad.cpp": b"int broken\xff\xfe() { return 1; }\n",
}
NEWER = b"int run() { return newer(); }\nint newer() { return scale(1, 1); }\n"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_made: dict[str, dict] = {}


def _git(root: Path, *args: str) -> None:
    who = {f"GIT_{x}_{k}": v for x in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "golden"), ("EMAIL", "golden@localhost"), ("DATE", "2024-01-01T00:00:00Z"))}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=os.environ | who)


def _write(root: Path, tree: dict[str, bytes]) -> None:
    for path, content in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)


def golden(spark: SparkSession) -> dict:
    """The stores of the tree after its runs, made once per application in the shared folder (which must be a file system of the driver)."""
    key = spark.sparkContext.applicationId
    if key in _made:
        return _made[key]
    ship(spark)
    base = Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / f"golden-{key}"
    root = base / "tree"
    _write(root, TREE)
    _git(root, "init", "-q", "-b", "main")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    store = Store(spark, f"file://{base}/store")
    runs = [I.index(spark, store, str(root), REPO), I.index(spark, store, str(root), REPO)]
    first = store.copy_to(f"file://{base}/first")
    I.set_alias(store, REPO, "dev", "lab", "old words")
    I.set_alias(store, REPO, "dev", "lab", "new words")
    _git(root, "checkout", "-qb", "dev")
    _write(root, {"src/run.cpp": NEWER})
    _git(root, "commit", "-qam", "two")
    runs.append(I.index(spark, store, str(root), REPO))
    _git(root, "rm", "-q", "src/run.cpp")
    _git(root, "commit", "-qm", "three")
    runs.append(I.index(spark, store, str(root), REPO))
    head = git.head_commit(str(root))
    heads = {r["branch_name"]: r["head_commit"] for r in store.read("git_index_state", REPO).collect()}
    parent = git.nearest_parent(str(root), head, {k: v for k, v in heads.items() if k != "dev"} | {"gone": "0" * 40})
    cleaned = store.copy_to(f"file://{base}/cleaned")
    I.clean(cleaned, REPO, "dev")
    _made[key] = {"first": first, "store": store, "cleaned": cleaned, "runs": runs, "parent": parent and parent[0]}
    return _made[key]


def query(names: str, rows: str):
    """Register a query and the rows it must give (SQL VALUES)."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = f"SELECT * FROM (VALUES {rows}) AS t({names})"
        return fn

    return add


@query(
    "step, mode, n_files, n_bad, n_symbols, n_edges, n_sections, n_includes",
    """(1, 'full', 4, 1, 12, 25, 4, 4), (2, 'up to date', 0, 0, 0, 0, 4, 4), (3, 'from parent', 1, 0, 2, 32, 4, 4), (4, 'incremental', 0, 0, 0, 28, 4, 4)""",
)
def index_runs(spark: SparkSession, d: str) -> DataFrame:
    """Counters of four runs: all, nothing new, a branch off its parent, a removed file."""
    rows = [(i, r.mode, r.files, r.unreadable, r.symbols, r.edges, r.sections, r.includes) for i, r in enumerate(golden(spark)["runs"], 1)]
    return spark.createDataFrame(rows, "step int, mode string, n_files int, n_bad int, n_symbols int, n_edges int, n_sections int, n_includes int")


@query(
    "file_path, name, kind, line_start, line_end, signature, parent_class",
    """('include/shapes.h', 'Shape', 'class', 7, 10, 'Shape', NULL), ('include/shapes.h', 'Shape::area() const', 'field', 9, 9, 'Shape::area() const: double', 'Shape'),
('include/shapes.h', 'Box', 'struct', 13, 17, 'Box', NULL), ('include/shapes.h', 'Box::area', 'method', 14, 14, 'Box::area', 'Box'),
('include/shapes.h', 'Box::w_', 'field', 15, 15, 'Box::w_: double', 'Box'), ('include/shapes.h', 'Box::edge_', 'field', 16, 16, 'Box::edge_: Colour', 'Box'), ('include/shapes.h', 'Colour', 'enum', 19, 19, NULL, NULL),
('src/shapes.cpp', 'scale', 'function', 7, 7, 'scale', NULL), ('src/shapes.cpp', 'total', 'function', 10, 14, 'total', NULL), ('src/shapes.cpp', 'counter = 7', 'variable', 16, 16, NULL, NULL),
('src/shapes.cpp', 'report', 'function', 17, 17, 'report', NULL), ('src/run.cpp', 'run', 'function', 1, 1, 'run', NULL)""",
)
def index_symbols(spark, d):
    """Symbols of the first run."""
    return golden(spark)["first"].read("symbols", REPO).select("file_path", "name", "kind", "line_start", "line_end", "signature", "parent_class")


@query("name, line", """('Shape', '/// Anything with an area.'), ('Box', '//! A box.'), ('scale', '*/')""")
def index_comments(spark, d):
    """First line of the definitions that begin with a documentation comment."""
    return golden(spark)["first"].read("symbols", REPO).select("name", F.substring_index("definition", "\n", 1).alias("line")).filter("line like '/%' or line like '*%'")


@query(
    "source_name, edge_type, target_name, branch_name",
    """('Box', 'inherits:Shape', 'Shape', 'main'), ('Shape', 'contains:area() const', 'Shape::area() const', 'main'), ('Shape::area() const', 'field_type:double', '', 'main'),
('Box', 'contains:area', 'Box::area', 'main'), ('Box', 'contains:w_', 'Box::w_', 'main'), ('Box', 'contains:edge_', 'Box::edge_', 'main'), ('Box::w_', 'field_type:double', '', 'main'), ('Box::edge_', 'field_type:Colour', 'Colour', 'main'),
('Box::area', 'returns:double', '', 'main'), ('Box::area', 'overrides:area', '', 'main'), ('Box::area', 'calls:scale', 'scale', 'main'),
('scale', 'returns:double', '', 'main'), ('scale', 'param_type:double', '', 'main'), ('scale', 'param_type:long', '', 'main'),
('total', 'returns:T', '', 'main'), ('total', 'param_type:std::vector<T>', '', 'main'), ('total', 'calls:scale', 'scale', 'main'), ('total', 'calls:b.area', '', 'main'),
('report', 'param_type:Box', 'Box', 'main'), ('report', 'calls:geo::total', '', 'main'), ('report', 'calls:printf', '', 'main'),
('run', 'returns:int', '', 'main'), ('run', 'calls:report', 'report', 'main'), ('run', 'calls:Box', 'Box', 'main'), ('run', 'calls:scale', 'scale', 'main'),
('', 'includes:vector', '', NULL), ('', 'includes:core/base.h', '', NULL), ('', 'includes:shapes.h', '', NULL)""",
)
def index_edges(spark, d):
    """Edges of the first run with the names of their ends, '' where there is none."""
    store = golden(spark)["first"]
    n = store.read("symbols", REPO).select("id", "name")
    e = store.read("edges", REPO).join(n.withColumnsRenamed({"id": "source_id", "name": "s"}), "source_id", "left").join(n.withColumnsRenamed({"id": "target_id", "name": "t"}), "target_id", "left")
    return e.select(F.coalesce("s", F.lit("")).alias("source_name"), "edge_type", F.coalesce("t", F.lit("")).alias("target_name"), "branch_name")


@query(
    "title, section_path, level, content, file_format, branch_name",
    """('Shapes', 'Area of a box', 2, 'The box area is scale of both.' || chr(10), 'md', 'main'), ('Shapes', 'Notes', 3, '#### deep' || chr(10), 'md', 'main'),
('Shapes', 'fast lane (dev/x)', 2, 'all new work' || chr(10) || 'goes here' || chr(10) || chr(10), 'md', 'main')""",
)
def index_sections(spark, d):
    """Sections of the document, the whole text left out; what stands right before a title line is dropped."""
    rows = golden(spark)["first"].read("doc_nodes", REPO).select("title", "section_path", "level", "content", "file_format", "branch_name")
    return rows.filter("not (section_path = '' and level = 1)")


@query("alias, branch_name, description, doc_path", """('fast lane', 'dev/x', 'all new work goes here', 'docs/guide.md'), ('lab', 'dev', 'new words', NULL), ('stable', 'v1.0', '', 'docs/guide.md')""")
def index_aliases(spark, d):
    """Aliases from the document's headings, and one that was set twice."""
    return golden(spark)["store"].read("branch_glossary", REPO).select("alias", "branch_name", "description", "doc_path")


@query("place, alias", "(1, 'fast lane'), (2, 'lab'), (3, 'stable')")
def list_aliases(spark, d):
    """The alias listing in its order."""
    rows = I.list_aliases(golden(spark)["store"], REPO).collect()  # a listing
    return spark.createDataFrame([(i, r["alias"]) for i, r in enumerate(rows, 1)], "place int, alias string")


@query("branch_name, parent_ref, ref_type, indexed_files", "('main', NULL, 'branch', 4), ('dev', 'main', 'branch', 0)")
def index_state(spark, d):
    """One state per branch: the latest run's."""
    s = golden(spark)["store"].read("git_index_state", REPO)
    return s.select("branch_name", F.when(F.col("branch_name") == "main", F.col("parent_ref")).otherwise("main").alias("parent_ref"), "ref_type", "indexed_files")


@query(
    "branch_name, name",
    """('main', 'Shape'), ('main', 'Shape::area() const'), ('main', 'Box'), ('main', 'Box::area'), ('main', 'Box::w_'), ('main', 'Box::edge_'), ('main', 'Colour'), ('main', 'scale'), ('main', 'total'), ('main', 'counter = 7'), ('main', 'report'), ('main', 'run'),
('dev', 'Shape'), ('dev', 'Shape::area() const'), ('dev', 'Box'), ('dev', 'Box::area'), ('dev', 'Box::w_'), ('dev', 'Box::edge_'), ('dev', 'Colour'), ('dev', 'scale'), ('dev', 'total'), ('dev', 'counter = 7'), ('dev', 'report')""",
)
def index_views(spark, d):
    """Symbols in the view of each branch; the removed file is gone from the one that removed it."""
    store = golden(spark)["store"]
    s, b = store.read("symbols", REPO), store.read("branches", REPO)
    views = [in_branch(s, b, x).select(F.lit(x).alias("branch_name"), "name") for x in ("main", "dev")]
    return views[0].unionByName(views[1])


@query("section_path, name, strong", """('Area of a box', 'scale', true)""")
def index_links(spark, d):
    """The link of the section on areas to the function it names."""
    store = golden(spark)["first"]
    k = store.read("doc_code_links", REPO).join(store.read("doc_nodes", REPO).select(F.col("id").alias("doc_node_id"), "section_path"), "doc_node_id").join(store.read("symbols", REPO).select(F.col("id").alias("symbol_id"), "name"), "symbol_id")
    return k.filter("section_path = 'Area of a box' and name = 'scale' and link_type = 'semantic' and source = 'text'").select("section_path", "name", (F.col("strength") >= I.LINK_THRESHOLD).alias("strong"))


@query("table_name, n_dev, n_other", "('branches', 0, 12), ('git_index_state', 0, 1), ('branch_glossary', 0, 2), ('doc_nodes', 0, 0), ('symbols', NULL, 12)")
def index_cleaned(spark, d):
    """Rows that stay when a branch is removed: none of its own, all of the others, and every symbol."""
    store = golden(spark)["cleaned"]
    out = None
    for t in ("branches", "git_index_state", "branch_glossary", "doc_nodes"):
        dev = F.col("branch_name") == "dev"
        one = store.read(t, REPO).agg(F.lit(t).alias("table_name"), F.count_if(dev).alias("n_dev"), F.count_if(~F.coalesce(dev, F.lit(False))).alias("n_other"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(store.read("symbols", REPO).agg(F.lit("symbols").alias("table_name"), F.lit(None).cast("long").alias("n_dev"), F.count(F.lit(1)).alias("n_other")))


@query("parent", "('main')")
def index_parent(spark, d):
    """The indexed branch whose merge base is newest; one that git cannot compare is passed over."""
    return spark.createDataFrame([(golden(spark)["parent"],)], "parent string")


#: Calls of the tools, and the lines they must answer.
CALLS: list[tuple[str, dict]] = [
    ("overview", {}),
    ("status", {}),
    ("list_symbols", {"pattern": "AREA"}),
    ("list_symbols", {"pattern": "nowhere"}),
    ("get_definition", {"name": "run"}),
    ("get_definition", {"name": "Box::"}),
    ("get_call_graph", {"name": "scale"}),
    ("get_call_graph", {"name": "repo", "direction": "callees", "max_depth": 1}),
    ("get_call_graph", {"name": "nowhere"}),
    ("search", {"query": "counter"}),
    ("push", {}),
    ("teleport", {}),
]
_ANSWERS = [
    """=== golden ===
Symbols: 12  |  Edges: 28  |  Docs: 4

Symbols by kind:
  function    :     4 (33.3%)
  field       :     3 (25.0%)
  class       :     1 (8.3%)
  enum        :     1 (8.3%)
  method      :     1 (8.3%)
  struct      :     1 (8.3%)
  variable    :     1 (8.3%)

Edges by type:
  calls               :     8  (e.g. calls:scale)
  contains            :     4  (e.g. contains:area)
  param_type          :     4  (e.g. param_type:Box)
  returns             :     4  (e.g. returns:double)
  field_type          :     3  (e.g. field_type:double)
  includes            :     3  (e.g. includes:core/base.h)
  inherits            :     1  (e.g. inherits:Shape)
  overrides           :     1  (e.g. overrides:area)

Top symbols (most referenced):
  scale                                    [function]  refs=3
  Box                                      [struct]  refs=2
  Shape                                    [class]  refs=1
  Shape::area() const                      [field]  refs=1
  Box::area                                [method]  refs=1
  Box::w_                                  [field]  refs=1
  Box::edge_                               [field]  refs=1
  Colour                                   [enum]  refs=1
  report                                   [function]  refs=1""",
    None,
    """Symbols matching 'AREA' in golden:
  [method    ] Box::area                                 @ include/shapes.h:14
  [field     ] Shape::area() const                       @ include/shapes.h:9""",
    """Symbols matching 'nowhere' in golden:
  (none)""",
    """run [function] @ src/run.cpp:1
int run() { report(Box()); return scale(2, 3); }""",
    """No exact match for 'Box::'. Similar symbols:
  Box::area [method] @ include/shapes.h:14
  Box::edge_ [field] @ include/shapes.h:16
  Box::w_ [field] @ include/shapes.h:15""",
    """Call graph for 'scale' (callers):
  ● scale (id=9)
    ↳ Box::area (calls:scale)
    ↳ run (calls:scale)
    ↳ total (calls:scale)""",
    """Call graph for 'repo' → auto-matched 'report' (callees):
  ● report (id=12)""",
    """Symbol 'nowhere' not found in golden""",
    """Search 'counter' in golden:
  [variable  ] counter = 7  @ src/shapes.cpp
  [function  ] report  @ src/shapes.cpp  extern "C" { void report(Box box) { geo::total(box); printf("}{ %d", counter); }""",
    """'push' is run on the driver: see symgrove.plans.index and Store.copy_to.""",
    """Unknown tool: teleport""",
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("call_no, line_no, line", ", ".join(f"({i}, {j}, {_sql_text(x)})" for i, a in enumerate(_ANSWERS) if a for j, x in enumerate(a.split("\n"))))
def tool_answers(spark, d):
    """Answers of the tools, line by line (that of ``status`` is checked as rows elsewhere)."""
    store = golden(spark)["first"]
    rows = [(i, j, line) for i, (tool, args) in enumerate(CALLS) if _ANSWERS[i] for j, line in enumerate(api.call(store, tool, args if tool in ("push", "teleport") else args | {"repo": REPO}).split("\n"))]
    return spark.createDataFrame(rows, "call_no int, line_no int, line string")


@query(
    "request, answer",
    """('initialize', '2024-11-05'), ('tools/list', '11'), ('tools/call', '1'), ('nothing', '-32601'), ('{', '-32700'), ('note', '')""",
)
def protocol(spark, d):
    """What the request handler answers: version, number of tools, contents of a call, errors; a notification gets no answer."""
    store = golden(spark)["first"]
    ask = {m: api.handle(store, {"jsonrpc": "2.0", "id": 1, "method": m, "params": {"name": "get_definition", "arguments": {"name": "run", "repo": REPO}}}) for m in ("initialize", "tools/list", "tools/call", "nothing")}
    rows = [
        ("initialize", ask["initialize"]["result"]["protocolVersion"]),
        ("tools/list", str(len(ask["tools/list"]["result"]["tools"]))),
        ("tools/call", str(len(ask["tools/call"]["result"]["content"]))),
        ("nothing", str(ask["nothing"]["error"]["code"])),
        ("{", str(api.answer(store, "{")["error"]["code"])),
        ("note", "" if api.handle(store, {"method": "note"}) is None else "?"),
    ]
    return spark.createDataFrame(rows, "request string, answer string")


#: Paths, patterns and whether one ignores the other.
IGNORE_CASES = [
    ("test/test_foo.cpp", "test/", True),
    ("./test/foo.cpp", "test/", True),
    ("/home/repo/test/foo.cpp", "test/", True),
    ("src/test.cpp", "test/", False),
    ("foo.test.cpp", "*.test.cpp", True),
    ("foo.cpp", "*.test.cpp", False),
    ("bar.md", "*.md", True),
    ("src/generated_foo.cpp", "generated*", True),
    ("src/normal.cpp", "generated*", False),
    ("path/to/examples/demo.cpp", "examples", True),
    ("include/third_party/foo.h", "third_party", True),
]


@query("path, pattern, hit", ", ".join(f"('{p}', '{x}', {hit})" for p, x, hit in IGNORE_CASES))
def ignore_cases(spark, d):
    """Ignore patterns on their fixed cases."""
    rows = spark.createDataFrame([(p, x) for p, x, _ in IGNORE_CASES], "path string, pattern string")
    hit = F.lit(False)
    for x in dict.fromkeys(x for _, x, _ in IGNORE_CASES):
        hit = F.when(F.col("pattern") == x, ignored(F.col("path"), [x])).otherwise(hit)
    return rows.select("path", "pattern", hit.alias("hit"))
