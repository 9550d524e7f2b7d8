"""Schemas of the stored tables, their keys, and empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "symbols": "id long, repo string, name string, kind string, definition string, content_hash string, file_path string, line_start int, line_end int, language string, signature string, parent_class string, namespace string",
    "edges": "id long, source_id long, target_id long, edge_type string, edge_kind string, edge_target string, source_repo string, target_repo string, branch_name string",
    "branches": "symbol_id long, repo string, branch_name string, override_def string, override_hash string",
    "git_index_state": "repo string, branch_name string, head_commit string, parent_ref string, ref_type string, indexed_files int, indexed_at timestamp",
    "branch_glossary": "repo string, branch_name string, alias string, description string, doc_path string",
    "doc_nodes": "id long, repo string, title string, section_path string, content string, level int, file_path string, file_format string, branch_name string",
    "doc_code_links": "doc_node_id long, symbol_id long, link_type string, strength double, source string, repo string",
}
KEYS = {
    "symbols": ["content_hash", "file_path", "name", "repo"],
    "edges": ["source_id", "edge_type", "source_repo"],
    "branches": ["symbol_id", "repo", "branch_name"],
    "git_index_state": ["repo", "branch_name"],
    "branch_glossary": ["repo", "branch_name", "alias"],
    "doc_code_links": ["doc_node_id", "symbol_id"],
}
#: Column that names the repository, where it is not ``repo``.
REPO = {"edges": "source_repo"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
