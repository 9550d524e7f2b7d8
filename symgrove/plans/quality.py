"""Queries p5 to p7 over the graph tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgrove.operators import hierarchy as H
from symgrove.operators import orphans as O
from symgrove.operators import skew as S
from symgrove.session import cut, table

FIELDS = ("target_id", "edge_type")


def _cases(spark, d):
    return O.orphan_cases(table(spark, d, "edges").select("id", "source_id", "target_id", "recorded_at"), table(spark, d, "branches"), table(spark, d, "symbols"))


def p5_found(spark, d):
    """Broken references, one row each."""
    return _cases(spark, d).select("ref_table", "ref_field", "row_key", "ref_month").distinct()


def p5_report(spark, d):
    """Broken references per table, field, month and reason."""
    return O.orphan_report(_cases(spark, d))


def _key_rows(spark, d):
    e = table(spark, d, "edges").select("id", "recorded_at", "target_id", "edge_type")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("edge_field"), F.col(f).cast("string").alias("key_value")) for f in FIELDS])).alias("p")
    return e.select("id", "recorded_at", pairs).select("p.edge_field", "p.key_value", "recorded_at", "id")


def p6_gaps(spark, d):
    """Per value of target_id and of edge_type: rows, first and last time, longest gap, bursts."""
    return S.chunked_gaps(_key_rows(spark, d), ["edge_field", "key_value"], "recorded_at", "id")


def p6_found(spark, d):
    """Values that stand in at least 1 % of all rows of edges, from the per-key results."""
    return S.frequent_keys(p6_gaps(spark, d), table(spark, d, "edges").count()).filter("key_value is not null").select("edge_field", "key_value")


def _tree(spark, d, paths=True):
    edges = table(spark, d, "edges").select("source_id", "target_id", "edge_type", "edge_kind")
    return H.hierarchy(H.symbol_links(table(spark, d, "symbols"), edges), paths=paths)


def p7_found(spark, d):
    """Root and depth of every symbol that has a parent or a child."""
    return _tree(spark, d, paths=False).select("node_id", "root_id", "node_depth")


def p7_tree(spark, d):
    """Full path, number of descendants, component and back edges of every node."""
    t = _tree(spark, d)
    return t.select("node_id", "parent_id", "root_id", "node_depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("full_path"), "n_descendants", "back_edge", "component")


def p7_descendants(spark, d):
    """All pairs of ancestor and descendant with their distance."""
    return H.descendants(cut(_tree(spark, d), "tree"))


QUERIES = {f.__name__: f for f in (p5_found, p5_report, p6_found, p6_gaps, p7_found, p7_tree, p7_descendants)}

_BAD = """
WITH refs AS (
  SELECT 'edges' AS ref_table, 'source_id' AS ref_field, CAST(id AS VARCHAR) AS row_key, source_id AS ref_id, recorded_at AS ref_at FROM edges
  UNION ALL SELECT 'edges', 'target_id', CAST(id AS VARCHAR), target_id, recorded_at FROM edges
  UNION ALL SELECT 'branches', 'symbol_id', CAST(symbol_id AS VARCHAR) || ':' || branch_name, symbol_id, recorded_at FROM branches
), par AS (SELECT id, min(recorded_at) AS at FROM symbols GROUP BY id),
bad AS (
  SELECT DISTINCT ref_table, ref_field, row_key, strftime(ref_at, '%Y-%m') AS ref_month, CASE WHEN par.id IS NULL THEN 'absent' ELSE 'late' END AS reason, ref_id
  FROM refs LEFT JOIN par ON par.id = refs.ref_id WHERE ref_id <> 0 AND (par.id IS NULL OR par.at > ref_at)
)"""

_KEYS = """
WITH k AS (
  SELECT 'target_id' AS edge_field, CAST(target_id AS VARCHAR) AS key_value, recorded_at, id FROM edges
  UNION ALL SELECT 'edge_type', edge_type, recorded_at, id FROM edges
), g AS (
  SELECT *, epoch_us(recorded_at) / 1e6 - lag(epoch_us(recorded_at) / 1e6) OVER (PARTITION BY edge_field, key_value ORDER BY recorded_at, id) AS gap FROM k
), r AS (
  SELECT edge_field, key_value, CAST(count(*) AS BIGINT) AS n_rows, min(recorded_at) AS first_at, max(recorded_at) AS last_at, max(gap) AS longest_gap_s, CAST(count(*) FILTER (gap > 3600) + 1 AS BIGINT) AS n_bursts
  FROM g GROUP BY 1, 2
)"""

_TREE = """
WITH RECURSIVE e AS (
  SELECT DISTINCT coalesce(edge_kind, split_part(edge_type, ':', 1)) AS k, source_id AS s, target_id AS t FROM edges
  WHERE source_id IN (SELECT id FROM symbols) AND target_id IN (SELECT id FROM symbols)
), base AS (SELECT s AS c, min(t) AS p FROM e WHERE k = 'inherits' GROUP BY 1),
own AS (SELECT t AS c, min(s) AS p FROM e WHERE k = 'contains' GROUP BY 1),
nm AS (SELECT repo, file_path, name, min(id) AS p FROM symbols WHERE kind IN ('class', 'struct') GROUP BY 1, 2, 3),
par AS (
  SELECT s.id AS c, CASE WHEN s.kind IN ('class', 'struct') THEN coalesce(base.p, own.p, nullif(nm.p, s.id)) ELSE coalesce(own.p, nm.p) END AS p
  FROM symbols s LEFT JOIN base ON base.c = s.id LEFT JOIN own ON own.c = s.id
  LEFT JOIN nm ON nm.repo = s.repo AND nm.file_path = s.file_path AND nm.name = s.parent_class
), link AS (SELECT * FROM par WHERE p IS NOT NULL),
node AS (SELECT c AS n FROM link UNION SELECT p FROM link),
walk AS (
  SELECT n AS node_id, CAST(NULL AS BIGINT) AS parent_id, n AS root_id, 0 AS node_depth, CAST(n AS VARCHAR) AS full_path FROM node WHERE n NOT IN (SELECT c FROM link)
  UNION ALL SELECT l.c, l.p, w.root_id, w.node_depth + 1, w.full_path || '/' || l.c FROM walk w JOIN link l ON l.p = w.node_id
), tree AS (
  SELECT node_id, parent_id, root_id, node_depth, full_path FROM walk
  UNION ALL SELECT n, (SELECT p FROM link WHERE c = n), 0, -1, '' FROM node WHERE n NOT IN (SELECT node_id FROM walk)
), pairs AS (
  SELECT CAST(a AS BIGINT) AS ancestor_id, node_id, CAST(node_depth - pos AS INTEGER) AS distance FROM (
    SELECT node_id, node_depth, unnest(string_split(full_path, '/')) AS a, unnest(range(node_depth + 1)) AS pos FROM walk
  ) WHERE pos < node_depth
)"""

ORACLE = {
    "p5_found": _BAD + " SELECT DISTINCT ref_table, ref_field, row_key, ref_month FROM bad",
    "p5_report": _BAD + " SELECT ref_table, ref_field, ref_month, reason, count(*) AS n_refs, count(DISTINCT ref_id) AS n_ids FROM bad GROUP BY 1, 2, 3, 4",
    "p6_found": _KEYS + " SELECT edge_field, key_value FROM r WHERE n_rows >= 0.01 * (SELECT count(*) FROM edges)",
    "p6_gaps": _KEYS + " SELECT * FROM r",
    "p7_found": _TREE + " SELECT node_id, root_id, CAST(node_depth AS INTEGER) AS node_depth FROM tree",
    "p7_tree": _TREE
    + """, cnt AS (SELECT ancestor_id, count(*) AS c FROM pairs GROUP BY 1),
up AS (SELECT node_id AS n, parent_id AS a FROM tree WHERE node_depth < 0 UNION SELECT up.n, l.p FROM up JOIN link l ON l.c = up.a),
ring AS (SELECT DISTINCT n FROM up WHERE n = a),
low AS (SELECT up.n, min(up.a) AS low FROM up JOIN ring ON ring.n = up.a GROUP BY 1)
SELECT node_id, parent_id, root_id, CAST(node_depth AS INTEGER) AS node_depth, full_path, CAST(CASE WHEN node_depth < 0 THEN -1 ELSE coalesce(c, 0) END AS BIGINT) AS n_descendants,
  node_depth < 0 AND node_id IN (SELECT n FROM ring) AND parent_id = low AS back_edge, coalesce(low, root_id) AS component
FROM tree LEFT JOIN cnt ON ancestor_id = node_id LEFT JOIN low ON low.n = node_id""",
    "p7_descendants": _TREE + " SELECT ancestor_id, node_id, distance FROM pairs",
}
