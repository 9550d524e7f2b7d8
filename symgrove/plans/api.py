"""Tool calls by name over a store, with text answers; the thin driver-side face of the queries."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators import graph as G
from symgrove.operators import search as Q
from symgrove.operators import stats as A
from symgrove.operators.store import Store
from symgrove.session import cut

VERSION = "0.2.0"
#: Tools by name: what they do, their arguments (type and default; None is required).
TOOLS: dict[str, tuple[str, dict[str, tuple[str, object]]]] = {
    "overview": ("Symbols, edges and sections of a repository by kind", {"repo": ("string", "default"), "branch": ("string", "")}),
    "status": ("State of the index of a repository", {"repo": ("string", "default"), "branch": ("string", "")}),
    "list_symbols": ("Symbols whose name contains a pattern", {"pattern": ("string", None), "repo": ("string", "default"), "branch": ("string", ""), "limit": ("integer", 20)}),
    "get_definition": ("Definition of a symbol", {"name": ("string", None), "repo": ("string", "default"), "branch": ("string", "")}),
    "get_call_graph": ("Callers or callees of a function", {"name": ("string", None), "repo": ("string", "default"), "branch": ("string", ""), "direction": ("string", "callers"), "max_depth": ("integer", 3)}),
    "search": ("Full-text search over names and definitions", {"query": ("string", None), "repo": ("string", "default"), "branch": ("string", ""), "limit": ("integer", 20)}),
    "semantic_search": ("Search over sections and symbols by shared words", {"query": ("string", None), "repo": ("string", "default"), "branch": ("string", ""), "limit": ("integer", 10)}),
    "index": ("Index a source tree", {"path": ("string", "."), "branch": ("string", ""), "repo": ("string", "")}),
    "pull": ("Copy the store from elsewhere", {"source": ("string", None)}),
    "push": ("Copy the store elsewhere", {"source": ("string", "")}),
    "switch_branch": ("Make another branch the current one", {"name": ("string", None)}),
}
#: Nodes of a call graph that are drawn; the answer says so where it stops.
DRAWN = 2_000


def tool_schema(tool: str) -> dict:
    """Description of a tool and the JSON schema of its arguments."""
    about, args = TOOLS[tool]
    properties = {k: {"type": t} | ({} if v in (None, "") else {"default": v}) for k, (t, v) in args.items()}
    return {"name": tool, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": [k for k, (_, v) in args.items() if v is None]}}


def _of(store: Store, repo: str, branch: str):
    return A.in_branch(store.read("symbols", repo), store.read("branches", repo), branch)


def overview(store: Store, repo: str = "default", branch: str = "") -> str:
    s, e = _of(store, repo, branch), store.read("edges", repo)
    out = [f"=== {repo} ===", f"Symbols: {s.count()}  |  Edges: {e.count()}  |  Docs: {store.read('doc_nodes', repo).count()}", "", "Symbols by kind:"]
    out += [f"  {r['kind']:12}: {r['n']:5} ({r['pct']:.1f}%)" for r in A.kind_histogram(s).orderBy(F.desc("n"), "kind").collect()]  # a repo has a handful of kinds
    out += ["", "Edges by type:", *(f"  {r['base']:20}: {r['n']:5}  (e.g. {r['example']})" for r in A.edge_type_rollup(e).collect())]
    out += ["", "Top symbols (most referenced):", *(f"  {r['name']:40} [{r['kind']}]  refs={r['refs']}" for r in A.top_referenced(e, s).collect())]
    return "\n".join(out)


def status(store: Store, repo: str = "default", branch: str = "") -> str:
    r = A.status(_of(store, repo, branch), store.read("edges", repo), store.read("doc_nodes", repo), store.read("doc_code_links", repo)).first()
    if r is None:
        return f"No index found for repo '{repo}'."
    return f"Repo: {repo}\n  Symbols: {r['n_symbols']}  |  Edges: {r['n_edges']} (resolved: {r['n_resolved']} / {r['pct_resolved']:.1f}%)  |  Docs: {r['n_docs']}\n  Doc-code links: {r['n_links']}"


def list_symbols(store: Store, pattern: str = "", repo: str = "default", branch: str = "", limit: int = 20) -> str:
    rows = Q.list_symbols(_of(store, repo, branch), pattern, limit).collect()
    return "\n".join([f"Symbols matching '{pattern}' in {repo}:", *([f"  [{r['kind']:10}] {r['name']:40}  @ {r['file_path'][:60]}:{r['line_start']}" for r in rows] or ["  (none)"])])


def get_definition(store: Store, name: str, repo: str = "default", branch: str = "") -> str:
    rows = Q.get_definition(_of(store, repo, branch), name).collect()
    if rows and rows[0]["match_type"] == "exact":
        return "\n\n".join(f"{r['name']} [{r['kind']}] @ {r['file_path']}:{r['line_start']}\n{(r['definition'] or '')[:800]}" for r in rows)
    return "\n".join([f"No exact match for '{name}'. Similar symbols:", *(f"  {r['name']} [{r['kind']}] @ {r['file_path']}:{r['line_start']}" for r in rows)])


def _neighbourhood(store: Store, repo: str, branch: str, roots: DataFrame, direction: str, max_depth: int):
    """Labelled edges from a node to the next ones, and names, of at most DRAWN nodes within ``max_depth - 1`` steps of the roots; True if there are more.

    The edges out of the last level are not read, as they are not drawn.
    """
    calls = store.read("edges", repo).filter((G.kind_of() == "calls") & (F.col("source_id") != 0) & (F.col("target_id") != 0))
    a, b = ("source_id", "target_id") if direction == "callees" else ("target_id", "source_id")
    step = calls.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), "edge_type", F.col("id").alias("edge_id"))
    near = G.reach(roots, step.select("from_id", "to_id").distinct(), max(max_depth - 1, 0)).groupBy("id").agg(F.min("depth").alias("depth"))
    near = cut(near.orderBy("depth", "id").limit(DRAWN + 1), "near")
    order = ["from_id", "edge_type", "edge_id"] if direction == "callees" else ["from_id", "edge_id"]
    first = F.min(F.struct("depth", *order)).alias("_o")
    drawn = step.join(near.select(F.col("id").alias("from_id"), "depth"), "from_id").groupBy("from_id", "to_id", "edge_type").agg(first)
    drawn = drawn.orderBy("_o", "to_id").limit(DRAWN + 1).select("from_id", "to_id", "edge_type", *[F.col(f"_o.{c}").alias(f"_{c}") for c in order])
    rows = sorted(drawn.collect(), key=lambda r: tuple(r[f"_{c}"] for c in order))
    ids = near.select("id").unionByName(store.spark.createDataFrame([(r["to_id"],) for r in rows], "id long")).distinct()
    names = {r["id"]: r["name"] for r in _of(store, repo, branch).join(ids, "id", "left_semi").select("id", "name").collect()}
    kids: dict[int, list[tuple[int, str]]] = {}
    for r in rows[:DRAWN]:
        kids.setdefault(r["from_id"], []).append((r["to_id"], r["edge_type"]))
    return kids, names, len(rows) > DRAWN


def get_call_graph(store: Store, name: str, repo: str = "default", branch: str = "", direction: str = "callers", max_depth: int = 3) -> str:
    """Call graph as an indented walk, depth first; a node that was shown is not expanded again.

    Without a symbol of that name the first one that contains it is drawn, and up
    to five others are named.
    """
    s = _of(store, repo, branch)
    frame = cut(s.filter(F.col("name") == name).select("id", "name"), "roots")
    roots = frame.orderBy("id").limit(DRAWN).collect()
    head = [f"Call graph for '{name}' ({direction}):"]
    if not roots:
        similar = s.filter(Q.contains(F.col("name"), name)).select("id", "name").orderBy("id").limit(6).collect()
        if not similar:
            return f"Symbol '{name}' not found in {repo}"
        roots = similar[:1]
        also = ", ".join(r["name"] for r in similar[1:])
        head = [f"Call graph for '{name}' → auto-matched '{roots[0]['name']}' ({direction}):", *([f"Also found: {also}"] if also else [])]
        frame = store.spark.createDataFrame([(roots[0]["id"],)], "id long")
    kids, names, more = _neighbourhood(store, repo, branch, frame.select("id"), direction, max_depth)
    out, seen = head, set()
    for r in roots:
        seen.add(r["id"])
        out.append(f"  ● {r['name']} (id={r['id']})")
        stack = [(k, label, 1) for k, label in reversed(kids.get(r["id"], ()))] if max_depth > 0 else []
        while stack:
            node, label, depth = stack.pop()
            again = node in seen
            out.append(f"{'  ' * (depth + 1)}↳ {names.get(node, '')} ({'already shown' if again else label})")
            if not again:
                seen.add(node)
                if depth < max_depth:
                    stack += [(k, x, depth + 1) for k, x in reversed(kids.get(node, ()))]
    return "\n".join([*out, *([f"  … only the nearest {DRAWN} calls are drawn"] if more else [])])


def search(store: Store, query: str, repo: str = "default", branch: str = "", limit: int = 20) -> str:
    rows = Q.full_text(_of(store, repo, branch), query, limit).orderBy("tier", "id").collect()
    return "\n".join([f"Search '{query}' in {repo}:", *(f"  [{r['kind']:10}] {r['name']}  @ {r['file_path'][:50]}" + (f"  {r['snippet'][:80]}" if r["tier"] else "") for r in rows)])


def semantic_search(store: Store, query: str, repo: str = "default", branch: str = "", limit: int = 10) -> str:
    rows = Q.semantic_search(store.read("doc_nodes", repo), _of(store, repo, branch), query, limit).collect()
    return "\n".join([f"Semantic search '{query}' in {repo}:", *(f"  {r['sim']:.3f} [{r['source']}] {r['label']} (#{r['id']})" for r in rows)])


def call(store: Store, tool: str, args: dict | None = None) -> str:
    """Answer of one tool; unknown tools are named as such, tools that only the command line has give a hint."""
    args = args or {}
    if tool in ("index", "pull", "push", "switch_branch"):
        return f"'{tool}' is run on the driver: see symgrove.plans.index and Store.copy_to."
    fn = globals().get(tool) if tool in TOOLS else None
    return fn(store, **args) if fn else f"Unknown tool: {tool}"


def handle(store: Store, message: dict) -> dict | None:
    """Answer of one JSON-RPC request; notifications give None."""
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return head | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "symgrove", "version": VERSION}}}
    if method == "tools/list":
        return head | {"result": {"tools": [tool_schema(t) for t in TOOLS]}}
    if method == "tools/call":
        return head | {"result": {"content": [{"type": "text", "text": call(store, params.get("name", ""), params.get("arguments"))}]}}
    return head | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def answer(store: Store, text: str | bytes) -> dict | None:
    """Answer of one request as text; what is no JSON gets a parse error."""
    try:
        return handle(store, json.loads(text))
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}


def serve(store: Store, lines=sys.stdin, out=sys.stdout) -> None:
    """Requests line by line."""
    for line in filter(str.strip, lines):
        got = answer(store, line)
        if got is not None:
            print(json.dumps(got), file=out, flush=True)


#: Largest request body that is read.
MAX_BODY = 10_000_000


def http_server(store: Store, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Server of the same requests over HTTP POST, one a request; start it with ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if not 0 < size <= MAX_BODY:
                self.send_error(413 if size else 400)
                return
            body = json.dumps(answer(store, self.rfile.read(size))).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
