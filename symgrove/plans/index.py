"""Indexing of a source tree: files to symbols, edges, sections, links; full, incremental, per branch."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgrove.extract.cpp import extract
from symgrove.operators import docs as D
from symgrove.operators.link import doc_code_links
from symgrove.operators.resolve import resolve_targets
from symgrove.operators.search import doc_tokens, symbol_tokens
from symgrove.operators.skew import number_rows
from symgrove.operators.store import Store, add_branch, delete_branch, insert_or_ignore, replace_latest
from symgrove.schemas import SCHEMAS, empty
from symgrove.session import cut, cut_counted
from symgrove.sources import files as S
from symgrove.sources import git

LINK_THRESHOLD = 0.05
_SYMBOL = [("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("definition", pa.string()), ("content_hash", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string()), ("parent_class", pa.string())]
_EDGE = [("src", pa.int32()), ("edge_kind", pa.string()), ("edge_target", pa.string()), ("tgt", pa.int32())]
RAW = (
    "repo string, file_path string, language string, symbols array<struct<ordinal: int, name: string, kind: string, definition: string, content_hash: string, line_start: int, line_end: int, signature: string, parent_class: string>>, "
    "edges array<struct<src: int, edge_kind: string, edge_target: string, tgt: int>>"
)


@dataclass
class IndexResult:
    """What an index run did."""

    mode: str
    files: int
    symbols: int
    edges: int
    sections: int
    links: int
    includes: int = 0  # directives met, repeats counted
    unreadable: int = 0  # source files that are no UTF-8


def extract_files(files: DataFrame) -> DataFrame:
    """Symbols and edges of files (repo, file_path, content, language), one row per file; unreadable files give none."""

    def run(batches):
        for b in batches:
            repo, path, content, lang = (c.to_pylist() for c in b.columns)
            got = [extract(c, x) if c else extract("", x) for c, x in zip(content, lang)]
            syms = [[dict(zip([n for n, _ in _SYMBOL], (i, s.name, s.kind, s.definition, s.content_hash, s.line_start, s.line_end, s.signature, s.parent_class))) for i, s in enumerate(r.symbols)] for r in got]
            edges = [[dict(zip([n for n, _ in _EDGE], e)) for e in r.edges] for r in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array(repo, pa.string()), pa.array(path, pa.string()), pa.array(lang, pa.string()), pa.array(syms, pa.list_(pa.struct(_SYMBOL))), pa.array(edges, pa.list_(pa.struct(_EDGE)))],
                names=["repo", "file_path", "language", "symbols", "edges"],
            )

    return files.select("repo", "file_path", "content", "language").mapInArrow(run, RAW)


def new_symbols(raw: DataFrame) -> DataFrame:
    """Symbols of extracted files, still without ids; keys that repeat within a file count once."""
    s = raw.select("repo", "file_path", "language", F.explode("symbols").alias("s")).select("repo", "file_path", "language", "s.*")
    s = s.withColumn("namespace", F.lit(None).cast("string"))
    w = Window.partitionBy("repo", "file_path", "content_hash", "name").orderBy("ordinal")
    return s.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def assign_ids(symbols: DataFrame, after: int) -> DataFrame:
    """Ids above ``after`` in the order of repo, file and ordinal."""
    one = symbols.withColumn("_all", F.lit(0))
    return number_rows(one, ["_all"], ["repo", "file_path", "ordinal"]).withColumn("id", F.col("rn") + F.lit(after + 1)).drop("_all", "rn")


def new_edges(raw: DataFrame, symbols: DataFrame, branch: str) -> DataFrame:
    """Edges of extracted files, resolved against ``symbols`` (with ids); members of a class by their place, all others by name."""
    e = raw.select("repo", "file_path", F.explode("edges").alias("e"), "symbols").select("repo", "file_path", "e.*", F.expr("symbols[e.src]").alias("s"), F.expr("case when e.tgt is null then null else symbols[e.tgt] end").alias("t"))
    key = ["repo", "file_path", "content_hash", "name"]
    ids = symbols.select(*key, "id")
    e = e.select("repo", "file_path", "src", "edge_kind", "edge_target", F.col("s.content_hash").alias("content_hash"), F.col("s.name").alias("name"), F.col("t.content_hash").alias("th"), F.col("t.name").alias("tn"))
    e = e.join(ids.withColumnRenamed("id", "source_id"), key).drop("content_hash", "name")
    placed = ids.select("repo", "file_path", F.col("content_hash").alias("th"), F.col("name").alias("tn"), F.col("id").alias("placed"))
    e = e.join(placed, ["repo", "file_path", "th", "tn"], "left").drop("th", "tn")
    r = resolve_targets(e, symbols)
    return r.select(
        "source_id", F.coalesce("placed", "target_id").alias("target_id"), F.concat_ws(":", "edge_kind", "edge_target").alias("edge_type"), "edge_kind", "edge_target", F.col("repo").alias("source_repo"), F.lit(None).cast("string").alias("target_repo"), F.lit(branch).alias("branch_name")
    )


def _numbered(df: DataFrame, after: int, order: list[str]) -> DataFrame:
    return number_rows(df.withColumn("_all", F.lit(0)), ["_all"], order).withColumn("id", F.col("rn") + F.lit(after + 1)).drop("_all", "rn")


def index(spark: SparkSession, store: Store, root: str, repo: str, branch: str | None = None, parent: str | None = None, link_threshold: float = LINK_THRESHOLD) -> IndexResult:
    """Bring the store up to date with the tree at ``root``.

    Nothing new at the indexed commit: only sections, includes and links are made
    anew. An indexed branch: files changed since its commit. A new branch with an
    indexed parent (named or found): files changed since the merge base, all other
    memberships are taken over. Else, or without git: everything. Files are
    replaced as a whole, so running twice changes nothing.
    """
    branch = branch or git.current_branch(root) or "main"
    head = git.head_commit(root)
    states = store.read("git_index_state", repo)
    heads = {r["branch_name"]: r["head_commit"] for r in states.select("branch_name", "head_commit").collect()}  # one row per branch of one repo
    mode, since, base_branch = "full", None, None
    if head and heads.get(branch) == head:
        mode = "up to date"
    elif head and branch in heads:
        since, mode = heads[branch], "incremental"
    elif head and heads:
        found = (parent, git.merge_base(root, heads[parent], head)) if parent in heads else git.nearest_parent(root, head, heads)
        if found and found[1]:
            base_branch, since, mode = found[0], found[1], "from parent"
    changed = git.changed_files(root, since) if since else None
    if since and changed is None:
        mode, base_branch = "full", None
    # everything is of this repository from here on; the others' parts are not opened
    old = store.read("symbols", repo)
    members = store.read("branches", repo)
    n_files = n_symbols = n_edges = n_bad = 0
    if mode != "up to date":
        src = S.scan_sources(spark, root)
        if changed is not None:
            names = spark.createDataFrame([(x,) for x in changed], "path string")
            src = src.join(names, "path", "left_semi")
        src, n = cut_counted(src.select(F.lit(repo).alias("repo"), F.col("path").alias("file_path"), "content", "language", "valid"), "sources", files=F.count_if("valid"), bad=F.count_if(~F.col("valid")))
        n_files, n_bad = n["files"], n["bad"]
        raw = cut(extract_files(src.filter("valid")), "raw")
        fresh = new_symbols(raw)
        key = ["content_hash", "file_path", "name", "repo"]
        known = old.select(*key, F.col("id").alias("old_id"))
        j = cut(fresh.join(known, key, "left"), "fresh")
        added = assign_ids(j.filter("old_id is null").drop("old_id"), store.top_id("symbols"))
        kept = j.filter("old_id is not null").withColumnRenamed("old_id", "id")
        now = cut(added.unionByName(kept.select(added.columns)), "now")
        n_symbols = now.count()
        touched = src.select("repo", "file_path") if changed is None else spark.createDataFrame([(repo, x) for x in changed], "repo string, file_path string")
        # other branches may still need the old symbols of a file, so only this branch lets go of them
        mine = members.filter(F.col("branch_name") == (base_branch or branch))
        stay = spark.createDataFrame([], mine.schema)
        if changed is not None:
            file_of = old.select(F.col("id").alias("symbol_id"), "file_path")
            gone = touched.select("file_path").distinct()
            stay = mine.join(file_of, "symbol_id").join(gone, "file_path", "left_anti").select(mine.columns).withColumn("branch_name", F.lit(branch))
        others = members.filter(~F.coalesce(F.col("branch_name") == branch, F.lit(False)))
        members = cut(add_branch(others.unionByName(stay), now, repo, branch), "members")
        used = members.select(F.col("symbol_id").alias("id")).distinct()
        lines = now.select("id", F.col("line_start").alias("ls"), F.col("line_end").alias("le"))
        rest = old.join(lines, "id", "left").withColumn("line_start", F.coalesce("ls", "line_start")).withColumn("line_end", F.coalesce("le", "line_end")).select(old.columns)
        brand = now.join(old.select("id"), "id", "left_anti").select(old.columns)
        all_symbols = cut(rest.unionByName(brand).join(used, "id", "left_semi"), "symbols")
        edges = new_edges(raw, now.select(*key, "id").unionByName(all_symbols.select(*key, "id")).distinct(), branch)
        old_edges = store.read("edges", repo).join(all_symbols.select(F.col("id").alias("source_id")).unionByName(spark.createDataFrame([(0,)], "source_id long")), "source_id", "left_semi")
        old_edges = old_edges.join(now.select(F.col("id").alias("source_id")), "source_id", "left_anti")
        merged = cut(insert_or_ignore(old_edges.select(edges.columns), edges, ["source_id", "edge_type", "source_repo"], ["edge_target"]), "edges")
        n_edges = merged.count()
        store.replace("symbols", repo, all_symbols)
        store.replace("branches", repo, members)
        store.replace("edges", repo, _numbered(merged, store.top_id("edges", without=repo), ["source_id", "edge_type"]))
        if head:
            row = [(repo, branch, head, base_branch, "branch", n_files, datetime.now(UTC).replace(tzinfo=None))]
            store.replace("git_index_state", repo, replace_latest(states.unionByName(spark.createDataFrame(row, states.schema)), ["repo", "branch_name"], ["indexed_at"]))
    n_sections = index_docs(spark, store, root, repo, branch)
    n_includes = index_includes(spark, store, root, repo)
    n_links = index_links(store, repo, link_threshold)
    return IndexResult(mode, n_files, n_symbols, n_edges, n_sections, n_links, n_includes, n_bad)


def index_docs(spark: SparkSession, store: Store, root: str, repo: str, branch: str) -> int:
    """Sections and glossary of the documentation files, in place of those of the same files."""
    files = S.scan_docs(spark, root).select(F.lit(repo).alias("repo"), F.col("path").alias("file_path"), "content")
    found = D.doc_sections(files).withColumn("file_format", F.regexp_extract("file_path", r"\.([^.]*)$", 1)).withColumn("branch_name", F.lit(branch))
    fresh = _numbered(cut(found, "sections"), store.top_id("doc_nodes", without=repo), ["file_path", "ordinal"])
    n = store.replace("doc_nodes", repo, fresh)
    g = D.branch_glossary(files).select("repo", "branch_name", "alias", "description", F.col("file_path").alias("doc_path"))
    _add_aliases(store, repo, g)
    return n


def _add_aliases(store: Store, repo: str, rows: DataFrame) -> None:
    """New rows of an alias take the place of stored ones; of several new ones the last by document stays."""
    both = store.read("branch_glossary", repo).withColumn("_o", F.lit(0)).unionByName(rows.withColumn("_o", F.lit(1)))
    store.replace("branch_glossary", repo, replace_latest(both, ["repo", "branch_name", "alias"], ["_o", "doc_path"]).drop("_o"))


def index_includes(spark: SparkSession, store: Store, root: str, repo: str) -> int:
    """Include edges of the repo, one for each header; the number of directives."""
    files = S.scan_headers(spark, root).select(F.lit(repo).alias("repo"), F.col("path").alias("file_path"), "content")
    inc, n = cut_counted(D.file_includes(files), "includes", rows=F.count(F.lit(1)))
    kept = store.read("edges", repo).filter(~F.coalesce(F.col("edge_kind") == "includes", F.lit(False)))
    none = F.lit(None).cast("string")
    new = _numbered(D.include_edges(inc), store.top_id("edges"), ["edge_type"]).withColumns({"target_repo": none, "branch_name": none})
    store.replace("edges", repo, kept.unionByName(new.select(kept.columns)))
    return n["rows"]


def index_links(store: Store, repo: str, threshold: float) -> int:
    """Links of the repo's sections to its symbols, in place of the old ones."""
    d, s = store.read("doc_nodes", repo), store.read("symbols", repo)
    links = doc_code_links(d.select("id", "repo", doc_tokens(d).alias("tokens")), s.select("id", "repo", symbol_tokens(s).alias("tokens")), threshold)
    return store.replace("doc_code_links", repo, links.withColumn("repo", F.lit(repo)))


def set_alias(store: Store, repo: str, branch: str, alias: str, description: str | None = None) -> None:
    """Name a branch; the newest description of an alias stays."""
    _add_aliases(store, repo, store.spark.createDataFrame([(repo, branch, alias, description, None)], store.read("branch_glossary").schema))


def list_aliases(store: Store, repo: str) -> DataFrame:
    """alias, branch_name, description of a repo's aliases, by alias and branch."""
    return store.read("branch_glossary", repo).select("alias", "branch_name", "description").orderBy("alias", "branch_name")


def clean(store: Store, repo: str | None = None, branch: str | None = None) -> None:
    """Remove a branch of a repo, a repo, or everything."""
    if repo is None:
        store.drop()
        return
    if branch is None:
        for t in SCHEMAS:
            store.replace(t, repo, empty(store.spark, t))
        return
    for t in ("branches", "git_index_state", "branch_glossary", "doc_nodes"):
        for part in {repo, ""}:  # rows without a repo go too
            rows = store.read(t, part)
            store.replace(t, part, delete_branch(rows, branch, repo))
