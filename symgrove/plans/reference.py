"""Queries of the graph engine's own operators over the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove.functions import text as T
from symgrove.operators import docs as D
from symgrove.operators import graph as G
from symgrove.operators import link as L
from symgrove.operators import resolve as R
from symgrove.operators import search as Q
from symgrove.operators import stats as A
from symgrove.operators import store as W
from symgrove.operators.skew import hot_join
from symgrove.plans.index import LINK_THRESHOLD, extract_files
from symgrove.session import cut, table
from symgrove.streaming.ingest import windowed_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Fixed parameters of the registered queries.
PATTERN, NAME, MISSING, TEXT, ASK = "queue", "atlas", "load_", "attempts", "which entries of the symbol table are kept in memory after a full scan"
IGNORE = ["tests/", "*.go", "generated*", "third_party"]
BRANCH = "main"

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _sql_tokens(text: str) -> str:
    return rf"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[^\p{{L}}\p{{Nd}}\p{{Nl}}\p{{No}}\p{{Mn}}\p{{Mc}}]+'), lambda x: lower(x)), lambda x: strlen(x) >= 2 AND NOT list_contains([{_STOP}], x)))"


_SYM_TEXT = "concat_ws(' ', kind, name, definition)"
_DOC_TEXT = "concat_ws(' ', title, section_path, content)"
_KIND = "coalesce(edge_kind, split_part(edge_type, ':', 1))"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query("SELECT repo, kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY repo), 6) AS pct FROM symbols GROUP BY 1, 2")
def overview_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by repo and kind with their share."""
    return A.kind_histogram(table(spark, d, "symbols"))


@query(
    """WITH c AS (SELECT edge_type, count(*) AS c, split_part(edge_type, ':', 1) AS base FROM edges GROUP BY 1)
SELECT base, CAST(sum(c) AS BIGINT) AS n, arg_min(edge_type, {'c': -c, 't': edge_type}) AS example FROM c GROUP BY 1 ORDER BY n DESC, base LIMIT 10"""
)
def overview_edge_types(spark, d):
    """Edge labels rolled up to their kind, with the most frequent label."""
    return A.edge_type_rollup(table(spark, d, "edges"))


@query("SELECT target_id, name, kind, count(*) AS refs FROM edges JOIN symbols s ON s.id = target_id WHERE target_id <> 0 GROUP BY 1, 2, 3 ORDER BY refs DESC, target_id LIMIT 10")
def overview_top_referenced(spark, d):
    """The most referenced symbols."""
    return A.top_referenced(table(spark, d, "edges"), table(spark, d, "symbols"))


@query(
    """WITH s AS (SELECT repo, count(*) AS n_symbols FROM symbols GROUP BY 1),
e AS (SELECT source_repo AS repo, count(*) AS n_edges, count(*) FILTER (target_id <> 0) AS n_resolved FROM edges WHERE source_repo IS NOT NULL GROUP BY 1),
x AS (SELECT repo, count(*) AS n_docs FROM doc_nodes GROUP BY 1),
k AS (SELECT d.repo, count(*) AS n_links FROM doc_nodes d JOIN symbols s ON s.repo = d.repo AND s.name = d.title GROUP BY 1)
SELECT repo, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_edges, 0) AS n_edges, coalesce(n_resolved, 0) AS n_resolved,
  CASE WHEN coalesce(n_edges, 0) > 0 THEN round(100.0 * n_resolved / n_edges, 6) ELSE 0.0 END AS pct_resolved, coalesce(n_docs, 0) AS n_docs, coalesce(n_links, 0) AS n_links
FROM s FULL JOIN e USING (repo) FULL JOIN x USING (repo) FULL JOIN k USING (repo)"""
)
def status_counts(spark, d):
    """Counts and the share of resolved edges, per repo; sections titled with a symbol's name stand for the links, as the tables hold none."""
    s, docs = table(spark, d, "symbols"), table(spark, d, "doc_nodes")
    links = docs.select("repo", F.col("title").alias("name")).join(s.select("repo", "name"), ["repo", "name"]).select("repo")
    return A.status(s, table(spark, d, "edges"), docs, links)


@query(f"SELECT id, kind, name, file_path, line_start FROM symbols WHERE name ILIKE '%{PATTERN}%' ORDER BY name, id LIMIT 20")
def list_symbols(spark, d):
    """Symbols whose name contains a pattern."""
    return Q.list_symbols(table(spark, d, "symbols"), PATTERN)


_DEF = "id, name, kind, file_path, line_start, definition"


def _definition_sql(name: str) -> str:
    return f"""WITH e AS (SELECT 'exact' AS match_type, {_DEF} FROM symbols WHERE name = '{name}' ORDER BY id LIMIT 5),
l AS (SELECT 'like' AS match_type, {_DEF} FROM symbols WHERE name LIKE '%{name}%' ORDER BY name, id LIMIT 10)
SELECT * FROM e UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM e)"""


@query("WITH n AS (SELECT min(name) AS name FROM symbols) SELECT 'exact' AS match_type, id, s.name, kind, file_path, line_start, definition FROM symbols s, n WHERE s.name = n.name ORDER BY id LIMIT 5")
def definition_exact(spark, d):
    """Definitions of the first name."""
    s = table(spark, d, "symbols")
    return Q.get_definition(s, s.agg(F.min("name")).first()[0] or "")


@query(_definition_sql(MISSING))
def definition_fallback(spark, d):
    """Definitions of a name that is only part of others."""
    return Q.get_definition(table(spark, d, "symbols"), MISSING)


@query(
    f"""SELECT * FROM (SELECT 0 AS tier, id, name, kind, file_path, '' AS snippet FROM symbols WHERE name ILIKE '%{TEXT}%' ORDER BY id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 1, id, name, kind, file_path, substr(definition, 1, 120) FROM symbols WHERE definition ILIKE '%{TEXT}%' AND NOT coalesce(name ILIKE '%{TEXT}%', false) ORDER BY id LIMIT 20)"""
)
def full_text_search(spark, d):
    """Hits in names, then in definitions only."""
    return Q.full_text(table(spark, d, "symbols"), TEXT)


@query(
    f"""WITH q AS (SELECT {_sql_tokens(f"'{ASK}'")} AS t),
x AS (SELECT 'doc' AS source, id, coalesce(title, '') AS label, {_sql_tokens(_DOC_TEXT)} AS t, 0.05 AS least FROM doc_nodes
  UNION ALL SELECT 'symbol', id, name, {_sql_tokens(_SYM_TEXT)}, 0.02 FROM symbols),
y AS (SELECT source, x.id, label, least, len(list_intersect(x.t, q.t)) AS i, len(x.t) + len(q.t) AS n FROM x, q)
SELECT source, id, label, round(i / (n - i), 6) AS sim FROM y WHERE n > i AND i / (n - i) > least ORDER BY sim DESC, source, id LIMIT 10"""
)
def semantic_search(spark, d):
    """Sections and symbols by token overlap with a question."""
    return Q.semantic_search(table(spark, d, "doc_nodes"), table(spark, d, "symbols"), ASK)


@query(
    f"""WITH x AS (SELECT 'doc' AS source, id, coalesce(title, '') AS label, {_sql_tokens(_DOC_TEXT)} AS t, 0.05 AS least FROM doc_nodes
  UNION ALL SELECT 'symbol', id, name, {_sql_tokens(_SYM_TEXT)}, 0.02 FROM symbols),
y AS (SELECT q.source AS query_source, q.id AS query_id, x.source, x.id, x.label, x.least, len(list_intersect(x.t, q.t)) AS i, len(x.t) + len(q.t) AS n FROM x, x AS q WHERE q.id % 50 = 0)
SELECT query_source, query_id, source, id, label, round(i / (n - i), 6) AS sim FROM y WHERE n > i AND i / (n - i) > least
QUALIFY row_number() OVER (PARTITION BY query_source, query_id ORDER BY round(i / (n - i), 6) DESC, source, id) <= 10"""
)
def semantic_search_many(spark, d):
    """Sections and symbols by token overlap with every 50th section and symbol."""
    docs, syms = table(spark, d, "doc_nodes"), table(spark, d, "symbols")
    fifty = F.col("id") % 50 == 0
    q = docs.filter(fifty).select(F.lit("doc").alias("query_source"), F.col("id").alias("query_id"), Q.doc_tokens(docs).alias("tokens"))
    q = q.unionByName(syms.filter(fifty).select(F.lit("symbol").alias("query_source"), F.col("id").alias("query_id"), Q.symbol_tokens(syms).alias("tokens")))
    return Q.semantic_search_many(docs, syms, q)


def _sides(spark, d):
    docs, syms = table(spark, d, "doc_nodes"), table(spark, d, "symbols")
    return docs.select("id", "repo", Q.doc_tokens(docs).alias("tokens")), syms.select("id", "repo", Q.symbol_tokens(syms).alias("tokens"))


@query(
    f"""WITH a AS (SELECT coalesce(repo, '') AS repo, list_sort({_sql_tokens(_DOC_TEXT)}) AS t, min(id) AS left_id, count(*) AS n_left FROM doc_nodes GROUP BY 1, 2),
b AS (SELECT coalesce(repo, '') AS repo, list_sort({_sql_tokens(_SYM_TEXT)}) AS t, min(id) AS right_id, count(*) AS n_right FROM symbols GROUP BY 1, 2),
ea AS (SELECT repo, left_id, unnest(t) AS w FROM a), eb AS (SELECT repo, right_id, unnest(t) AS w FROM b),
i AS (SELECT left_id, right_id, count(*) AS i FROM ea JOIN eb USING (repo, w) GROUP BY 1, 2)
SELECT left_id, right_id, n_left, n_right, round(i / (len(a.t) + len(b.t) - i), 6) AS strength FROM i JOIN a USING (left_id) JOIN b USING (right_id) WHERE i / (len(a.t) + len(b.t) - i) >= {LINK_THRESHOLD}"""
)
def link_pairs(spark, d):
    """Links of sections to symbols of the same repo between distinct token sets, at the threshold of the indexing pipeline."""
    return L.similarity_join(*_sides(spark, d), LINK_THRESHOLD, by="repo")


@query(f"WITH t AS (SELECT id, list_sort({_sql_tokens(_DOC_TEXT)}) AS t FROM doc_nodes) SELECT id, min(id) OVER (PARTITION BY t) AS class_id FROM t WHERE len(t) > 0")
def link_members(spark, d):
    """Sections and the section that stands for their token set."""
    return L.members(_sides(spark, d)[0])


@query(f"SELECT id, CAST(len({_sql_tokens(_SYM_TEXT)}) AS INTEGER) AS n_tokens FROM symbols")
def token_counts(spark, d):
    """Number of distinct tokens of every symbol."""
    return _sides(spark, d)[1].select("id", F.size("tokens").alias("n_tokens"))


def _reach_sql(start: str, step: str, depth: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT {step} FROM edges WHERE source_id <> 0 AND target_id <> 0),
r AS (SELECT id AS root_id, id, 0 AS depth FROM symbols WHERE {start}
  UNION SELECT root_id, e.b, depth + 1 FROM r JOIN e ON e.a = r.id WHERE depth < {depth}),
m AS (SELECT root_id, id, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT root_id, m.id, CAST(depth AS INTEGER) AS depth, coalesce(name, '') AS name FROM m LEFT JOIN symbols s ON s.id = m.id"""


def _roots(spark, d):
    return table(spark, d, "symbols").filter("id % 50 = 0").select("id")  # the stated set of queries, against all rows


@query(_reach_sql("id % 50 = 0", f"target_id AS a, source_id AS b, {_KIND} AS k", 3).replace("<> 0)", f"<> 0 AND {_KIND} = 'calls')", 1))
def callers(spark, d):
    """Callers of every 50th symbol up to depth 3."""
    return G.call_graph(_roots(spark, d), table(spark, d, "edges"), table(spark, d, "symbols"), "callers", 3)


@query(_reach_sql("id % 50 = 0", f"source_id AS a, target_id AS b, {_KIND} AS k", 3).replace("<> 0)", f"<> 0 AND {_KIND} = 'calls')", 1))
def callees(spark, d):
    """Callees of every 50th symbol up to depth 3."""
    return G.call_graph(_roots(spark, d), table(spark, d, "edges"), table(spark, d, "symbols"), "callees", 3)


@query(_reach_sql("id % 50 = 0", "target_id AS a, source_id AS b", 3))
def impact(spark, d):
    """What depends on every 50th symbol, by any edge, up to the default depth."""
    return G.impact(_roots(spark, d), table(spark, d, "edges"), table(spark, d, "symbols"))


@query(
    f"""WITH RECURSIVE p AS (SELECT DISTINCT source_id AS c, target_id AS p FROM edges WHERE {_KIND} = 'inherits' AND source_id <> 0 AND target_id <> 0),
w AS (SELECT c AS node, p AS anc, [c, p] AS path FROM p WHERE c <> p UNION ALL SELECT node, p.p, list_append(path, p.p) FROM w JOIN p ON p.c = w.anc WHERE NOT list_contains(path, p.p))
SELECT anc AS ancestor_id, node AS node_id, CAST(min(len(path)) - 1 AS INTEGER) AS distance FROM w GROUP BY 1, 2"""
)
def inheritance_chain(spark, d):
    """All ancestors of every class, through all of its bases."""
    return G.inheritance_chain(table(spark, d, "edges"))


@query(
    """WITH raw AS (SELECT e.id, s.repo, s.file_path, coalesce(edge_target, substr(edge_type, strpos(edge_type, ':') + 1)) AS t FROM edges e JOIN symbols s ON s.id = e.source_id),
f AS (SELECT repo, file_path, name, min(id) AS n FROM symbols GROUP BY 1, 2, 3), g AS (SELECT repo, name, min(id) AS n FROM symbols GROUP BY 1, 2)
SELECT raw.id AS edge_id, coalesce(f.n, g.n, 0) AS target_id FROM raw LEFT JOIN f ON f.repo = raw.repo AND f.file_path = raw.file_path AND f.name = t LEFT JOIN g ON g.repo = raw.repo AND g.name = t"""
)
def resolve_targets(spark, d):
    """Targets of all edges by name: same file, then same repo, then 0."""
    s = table(spark, d, "symbols")
    target = F.coalesce("edge_target", T.label_target(F.col("edge_type")))
    raw = table(spark, d, "edges").select(F.col("id").alias("edge_id"), "source_id", target.alias("edge_target")).join(s.select(F.col("id").alias("source_id"), "repo", "file_path"), "source_id")
    return R.resolve_targets(raw, s).select("edge_id", "target_id")


@query("SELECT b.repo, b.branch_name, count(DISTINCT s.id) AS n_symbols, count(DISTINCT CASE WHEN s.kind = 'method' THEN s.id END) AS n_methods FROM branches b JOIN symbols s ON s.id = b.symbol_id GROUP BY 1, 2")
def branch_view(spark, d):
    """Symbols and methods in the view of every branch."""
    b = table(spark, d, "branches").select("symbol_id", "repo", "branch_name").distinct()
    s = table(spark, d, "symbols").select(F.col("id").alias("symbol_id"), "kind")
    return b.join(s, "symbol_id").groupBy("repo", "branch_name").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("kind") == "method").alias("n_methods"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, d):
    """Texts that stand in several documents, by their hash."""
    x = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("content_hash"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(
    """SELECT arg_min(id, (recorded_at, id)) AS id, repo, name, arg_min({'k': kind}, (recorded_at, id)).k AS kind, file_path, content_hash, arg_max({'l': line_start}, (recorded_at, id)).l AS line_start, arg_max({'l': line_end}, (recorded_at, id)).l AS line_end,
arg_min({'s': signature}, (recorded_at, id)).s AS signature FROM symbols GROUP BY content_hash, file_path, name, repo"""
)
def upsert_symbols(spark, d):
    """Re-indexed symbols merged: the first row stays, with the latest lines."""
    s = table(spark, d, "symbols")
    early = F.col("recorded_at") < F.lit("2024-01-01").cast("timestamp_ntz")
    merged = W.upsert_symbols(s.filter(early), s.filter(~early), ["recorded_at", "id"])
    return merged.select("id", "repo", "name", "kind", "file_path", "content_hash", "line_start", "line_end", "signature")


@query("SELECT id, source_id, edge_type, source_repo, target_id FROM edges QUALIFY row_number() OVER (PARTITION BY source_id, edge_type, source_repo ORDER BY id) = 1")
def insert_or_ignore_edges(spark, d):
    """Edges of each key as first delivered."""
    e = table(spark, d, "edges").select("id", "source_id", "edge_type", "source_repo", "target_id")
    half = F.col("id") <= e.agg(F.expr("avg(id)").cast("long")).first()[0]
    keys = ["source_id", "edge_type", "source_repo"]
    return W.insert_or_ignore(W.first_row(e.filter(half), keys, ["id"]), e.filter(~half), keys, ["id"])


@query("SELECT DISTINCT symbol_id, repo, branch_name FROM branches")
def insert_or_ignore_members(spark, d):
    """Memberships without repeats."""
    return table(spark, d, "branches").select("symbol_id", "repo", "branch_name").distinct()


@query("SELECT repo, branch_name, arg_max(head_commit, (indexed_at, head_commit)) AS head_commit, arg_max(indexed_files, (indexed_at, head_commit)) AS indexed_files, max(indexed_at) AS indexed_at FROM git_index_state GROUP BY 1, 2")
def latest_state(spark, d):
    """Latest index state of every branch."""
    s = table(spark, d, "git_index_state").select("repo", "branch_name", "head_commit", "indexed_files", "indexed_at")
    return W.replace_latest(s, ["repo", "branch_name"], ["indexed_at", "head_commit"])


@query(
    """WITH l AS (SELECT repo, branch_name, arg_max({'p': parent_ref}, (indexed_at, head_commit)).p AS parent_ref FROM git_index_state GROUP BY 1, 2)
SELECT l.repo, l.branch_name, l.parent_ref, p.branch_name IS NOT NULL AS parent_known FROM l LEFT JOIN l p ON p.repo = l.repo AND p.branch_name = l.parent_ref"""
)
def branch_parents(spark, d):
    """Parent of every branch and whether it has a state itself."""
    s = W.replace_latest(table(spark, d, "git_index_state").select("repo", "branch_name", "parent_ref", "indexed_at", "head_commit"), ["repo", "branch_name"], ["indexed_at", "head_commit"])
    p = s.select("repo", F.col("branch_name").alias("parent_ref"), F.lit(True).alias("k"))
    return s.join(p, ["repo", "parent_ref"], "left").select("repo", "branch_name", "parent_ref", F.coalesce("k", F.lit(False)).alias("parent_known"))


@query(f"SELECT id, repo, branch_name FROM doc_nodes WHERE NOT coalesce(branch_name = '{BRANCH}' AND (repo = 'atlas-core' OR repo IS NULL OR repo = ''), false)")
def delete_branch(spark, d):
    """Sections that stay when a branch is removed."""
    return W.delete_branch(table(spark, d, "doc_nodes"), BRANCH, "atlas-core").select("id", "repo", "branch_name")


@query("SELECT id, name FROM symbols WHERE id IN (SELECT symbol_id FROM removed_symbols)")
def semi_join(spark, d):
    """Symbols that were removed once and indexed again."""
    return table(spark, d, "symbols").join(table(spark, d, "removed_symbols").select(F.col("symbol_id").alias("id")), "id", "left_semi").select("id", "name")


@query("SELECT id, name FROM symbols WHERE id NOT IN (SELECT symbol_id FROM branches WHERE symbol_id IS NOT NULL)")
def anti_join(spark, d):
    """Symbols in no branch."""
    return table(spark, d, "symbols").join(table(spark, d, "branches").select(F.col("symbol_id").alias("id")), "id", "left_anti").select("id", "name")


@query(
    r"""SELECT repo, header, count(*) AS n FROM (SELECT source_repo AS repo, unnest(regexp_extract_all('#include <' || coalesce(edge_target, substr(edge_type, strpos(edge_type, ':') + 1)) || '>', '#include\s*[<"]([^>"]+)[>"]', 1)) AS header FROM edges WHERE starts_with(edge_type, 'includes:')) GROUP BY 1, 2"""
)
def includes(spark, d):
    """Headers per repo in the include directives of texts made from the stored include edges."""
    e = table(spark, d, "edges").filter(T.label_kind(F.col("edge_type")) == "includes")
    text = F.concat(F.lit("#include <"), F.coalesce("edge_target", T.label_target(F.col("edge_type"))), F.lit(">"))
    x = D.file_includes(e.select(F.col("source_repo").alias("repo"), F.lit("").alias("file_path"), text.alias("content")))
    return x.groupBy("repo", "header").agg(F.count(F.lit(1)).alias("n"))


_LINES = r"""f AS (SELECT id, content, regexp_replace(content, '\r?\n\z', '') AS c FROM doc_nodes WHERE content IS NOT NULL),
l AS (SELECT id, unnest(regexp_split_to_array(c, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(c, '\r?\n'), 1) AS pos FROM f WHERE content <> '')"""


@query(
    rf"""WITH {_LINES},
h AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*###\s') THEN 3 WHEN regexp_matches(line, '^\s*##\s') THEN 2 WHEN regexp_matches(line, '^\s*#\s') THEN 1 END AS h FROM l),
s AS (SELECT *, count(h) OVER (PARTITION BY id ORDER BY pos) AS seg FROM h),
b AS (SELECT *, max(CASE WHEN h IS NULL AND line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY id, seg ORDER BY pos) AS begun FROM s),
g AS (SELECT id, seg, max(h) AS h, coalesce(string_agg(line || chr(10), '' ORDER BY pos) FILTER (h IS NULL AND begun = 1), '') AS content, bool_or(h IS NULL AND regexp_matches(line, '\S')) AS body,
  max(CASE WHEN h = 1 THEN trim(regexp_replace(line, '^\s*#\s', '')) END) AS h1, coalesce(max(CASE WHEN h >= 2 THEN trim(regexp_replace(line, '^\s*##+\s', '')) END), '') AS section_path FROM b GROUP BY 1, 2),
n AS (SELECT *, lead(h) OVER (PARTITION BY id ORDER BY seg) AS next_h, coalesce(last_value(CASE WHEN h >= 2 THEN h END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seg), 0) AS level,
  coalesce(last_value(h1 IGNORE NULLS) OVER (PARTITION BY id ORDER BY seg), CAST(id AS VARCHAR)) AS title, coalesce(last_value(h1 IGNORE NULLS) OVER (PARTITION BY id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), CAST(id AS VARCHAR)) AS last_title FROM g),
a AS (SELECT id, title, section_path, level, content FROM n WHERE (body OR section_path <> '') AND coalesce(next_h, 0) <> 1 UNION ALL SELECT f.id, coalesce(max(last_title), CAST(f.id AS VARCHAR)), '', 1, f.content FROM f LEFT JOIN n ON n.id = f.id GROUP BY f.id, f.content)
SELECT CAST(id AS VARCHAR) AS file_path, title, section_path, CAST(level AS INTEGER) AS level, sha256(content) AS content_hash FROM a"""
)
def doc_sections(spark, d):
    """Sections of every stored text, read as Markdown: title, section, level and hash of the content."""
    x = table(spark, d, "doc_nodes").select("repo", F.col("id").cast("string").alias("file_path"), "content")
    return D.doc_sections(x).select("file_path", "title", "section_path", "level", F.sha2("content", 256).alias("content_hash"))


_CPP = r"""regexp_matches(file_path, '[^/]\.(cpp|cc|cxx|hpp|hxx|c|h)$')"""


def _extracted(spark, d):
    """Symbols and edges of every C++ definition, each read as a file of its own."""
    s = table(spark, d, "symbols").select("repo", F.col("id").cast("string").alias("file_path"), F.col("definition").alias("content"), T.language_of(F.col("file_path")).alias("language")).filter("language = 'cpp'")
    return extract_files(s)


@query(f"SELECT id, name FROM symbols WHERE {_CPP} AND kind IN ('function', 'method', 'class', 'struct', 'enum')")
def extracted_symbols(spark, d):
    """Functions, classes and enums that the extractor finds in C++ definitions: the stored names."""
    x = _extracted(spark, d).select(F.col("file_path").cast("long").alias("id"), F.explode("symbols").alias("s")).select("id", "s.name", "s.kind")
    stored = table(spark, d, "symbols").select("id", F.col("kind").alias("stored"))
    outer = F.col("stored").isin("function", "method") & F.col("kind").isin("function", "method") | (F.col("stored") == F.col("kind")) & F.col("kind").isin("class", "struct", "enum")
    return x.join(stored, "id").filter(outer).select("id", "name")


@query(f"SELECT DISTINCT source_id, edge_type FROM edges e JOIN symbols s ON s.id = e.source_id WHERE {_CPP} AND kind IN ('function', 'method') AND split_part(edge_type, ':', 1) IN ('calls', 'returns', 'param_type')")
def extracted_edges(spark, d):
    """Stored calls, return and parameter types of C++ functions that the extractor finds in their definitions."""
    x = _extracted(spark, d).select(F.col("file_path").cast("long").alias("source_id"), F.explode("edges").alias("e")).select("source_id", F.concat_ws(":", "e.edge_kind", "e.edge_target").alias("edge_type")).distinct()
    of = table(spark, d, "symbols").filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("source_id"))
    stored = table(spark, d, "edges").filter(T.label_kind(F.col("edge_type")).isin("calls", "returns", "param_type")).select("source_id", "edge_type")
    return x.join(stored, ["source_id", "edge_type"], "left_semi").join(of, "source_id", "left_semi")


@query(rf"SELECT id, regexp_extract(definition, '(?m)^(?:class|struct)\s+\w+\s*:\s*(?:public\s+|private\s+|protected\s+)?([\w:]+)\s*\{{', 1) AS base FROM symbols WHERE {_CPP} AND kind IN ('class', 'struct') AND regexp_matches(definition, '(?m)^(?:class|struct)\s+\w+\s*:[^:{{]')")
def extracted_bases(spark, d):
    """Bases that the extractor finds in C++ classes."""
    x = _extracted(spark, d).select(F.col("file_path").cast("long").alias("id"), F.explode("edges").alias("e")).filter("e.edge_kind = 'inherits'")
    return x.select("id", F.col("e.edge_target").alias("base"))


@query("SELECT id, sha256(name || ' ' || coalesce(signature, '') || ' ' || coalesce(substr(definition, 1, 512), '')) AS text_hash FROM symbols")
def symbol_texts(spark, d):
    """Hash of every symbol's text for embedding."""
    return table(spark, d, "symbols").select("id", F.sha2(T.symbol_text(F.col("name"), F.col("signature"), F.col("definition")), 256).alias("text_hash"))


@query(
    """SELECT DISTINCT repo, file_path FROM symbols WHERE NOT (contains(file_path, '/tests/') OR starts_with(file_path, 'tests/') OR starts_with(file_path, './tests/')
OR ends_with(file_path, '.go') OR contains(file_path, 'generated') OR contains(file_path, 'third_party'))"""
)
def ignore_filter(spark, d):
    """Files that no ignore pattern names."""
    s = table(spark, d, "symbols")
    return s.filter(~T.ignored(F.col("file_path"), IGNORE)).select("repo", "file_path").distinct()


@query(
    """SELECT DISTINCT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS base,
CASE WHEN x IN ('cpp', 'cc', 'cxx', 'hpp', 'hxx', 'c', 'h') THEN 'cpp' WHEN x = 'py' THEN 'python' WHEN x = 'java' THEN 'java' WHEN x IN ('ts', 'tsx', 'js', 'jsx') THEN 'typescript' WHEN x = 'go' THEN 'go' END AS language
FROM (SELECT file_path, regexp_extract(file_path, '[^/]\\.([^./]*)$', 1) AS x FROM symbols)""".replace("\\\\", "\\")
)
def language_by_path(spark, d):
    """Language of every file by its suffix."""
    p = F.col("file_path")
    return table(spark, d, "symbols").select("file_path", T.basename(p).alias("base"), T.language_of(p).alias("language")).distinct()


@query(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])))), 4) AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 10"""
)
def nearest_vectors(spark, d):
    """The vectors closest to the first one."""
    v = table(spark, d, "embeddings")
    return Q.nearest_vectors(v, v.orderBy("vec_id").first()["embedding"])


@query(
    """SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 4) AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, v.vec_id) <= 10"""
)
def nearest_vectors_many(spark, d):
    """The vectors closest to every 50th one."""
    v = table(spark, d, "embeddings")
    return Q.nearest_vectors_many(v, v.filter("vec_id % 50 = 0"))


@query("SELECT e.id AS edge_id, coalesce(s.name, '') AS source_name, coalesce(t.name, '') AS target_name FROM edges e LEFT JOIN symbols s ON s.id = e.source_id LEFT JOIN symbols t ON t.id = e.target_id")
def edge_names(spark, d):
    """Names of both ends of every edge, '' where there is no symbol."""
    e = table(spark, d, "edges").select(F.col("id").alias("edge_id"), "source_id", "target_id")
    n = table(spark, d, "symbols")
    a = hot_join(e, n.select(F.col("id").alias("source_id"), F.col("name").alias("sn")), ["source_id"])
    b = hot_join(cut(a, "named"), n.select(F.col("id").alias("target_id"), F.col("name").alias("tn")), ["target_id"])
    return b.select("edge_id", F.coalesce("sn", F.lit("")).alias("source_name"), F.coalesce("tn", F.lit("")).alias("target_name"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: events per day and type."""
    return windowed_counts(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))
