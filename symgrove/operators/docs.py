"""Markdown sections, branch glossary, include directives."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: pattern of a heading that names a branch.
GLOSSARY_HEADING = re.compile(r"^#{1,4}\s+(.+?)\s*[\(/→]\s*([a-zA-Z0-9][-a-zA-Z0-9/_\.]+)\s*[\)]?")


def split_lines(text: str) -> list[str]:
    """Lines without their ends; no empty last line after a final newline."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def sections(text: str, title: str) -> list[tuple[str, str, str, int]]:
    """(title, section, content, level) of a Markdown text.

    ``##`` and ``###`` begin a section of level 2 and 3, wherever the heading stands
    in its line and even inside code; ``#`` gives the title and throws away the
    section before it that has not been closed. Text before any heading is section
    '' of level 0. Deeper headings are text. Empty lines before a section's text
    are dropped. The last row is the whole text, section '', level 1.
    """
    out: list[tuple[str, str, str, int]] = []
    name, level, body = "", 0, []

    def close():
        content = "".join(x + "\n" for x in body)
        if content.strip() or name:
            out.append((title, name, content, level))

    for line in split_lines(text):
        t = line.strip()
        mark = next((m for m in ("### ", "## ", "# ") if t.startswith(m)), None)
        if mark == "# ":
            title, name, body = t[2:].strip(), "", []
        elif mark:
            close()
            name, level, body = t[len(mark) :].strip(), len(mark) - 1, []
        elif line or body:
            body.append(line)
    close()
    out.append((title, "", text, 1))
    return out


def glossary(text: str) -> list[tuple[str, str, str]]:
    """(alias, branch, description) of headings like ``## alias (branch)``; the description is the lines up to a blank or a heading."""
    found: list[tuple[str, str, list[str]]] = []
    words: list[str] | None = None  # of the entry that is still open
    for line in split_lines(text):
        bare = line.strip()
        if not bare or bare[0] == "#":
            words = None
            heading = GLOSSARY_HEADING.match(line)
            if heading:
                words = []
                found.append((*(x.strip() for x in heading.groups()), words))
        elif words is not None:
            words.append(bare)
    return [(alias, branch, " ".join(w)) for alias, branch, w in found]


def _exploded(df: DataFrame, fn, n_keys: int, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(*key, i, *r) for *key, text, extra in zip(*(c.to_pylist() for c in b.columns)) if text is not None for i, r in enumerate(fn(text, extra))]
            cols = list(zip(*rows)) if rows else [[]] * (n_keys + 1 + len(names))
            kt = [b.schema.types[i] for i in range(n_keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*kt, pa.int32(), *types])], names=[*b.schema.names[:n_keys], "ordinal", *names])

    return df.mapInArrow(run, schema)


def doc_sections(files: DataFrame) -> DataFrame:
    """repo, file_path, ordinal, title, section_path, content, level of files (repo, file_path, content); a NULL content gives no rows.

    The title before the first ``#`` is the file's name without its suffix.
    """
    src = files.select("repo", "file_path", "content", F.regexp_extract("file_path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"))
    return _exploded(src, sections, 2, ["title", "section_path", "content", "level"], [pa.string(), pa.string(), pa.string(), pa.int32()], "repo string, file_path string, ordinal int, title string, section_path string, content string, level int")


def branch_glossary(files: DataFrame) -> DataFrame:
    """repo, file_path, ordinal, alias, branch_name, description of the glossary headings of files."""
    src = files.select("repo", "file_path", "content", F.lit("").alias("x"))
    return _exploded(src, lambda t, _: glossary(t), 2, ["alias", "branch_name", "description"], [pa.string()] * 3, "repo string, file_path string, ordinal int, alias string, branch_name string, description string")


def file_includes(files: DataFrame) -> DataFrame:
    """repo, file_path, header of every include directive, repeats kept."""
    return files.select("repo", "file_path", F.explode(F.regexp_extract_all("content", F.lit(r'#include\s*[<"]([^>"]+)[>"]'), 1)).alias("header"))


def include_edges(includes: DataFrame) -> DataFrame:
    """Edges of the includes, one for each repo and header; both ends are 0."""
    zero = F.lit(0).cast("long")
    label = F.concat(F.lit("includes:"), "header")
    return includes.select(zero.alias("source_id"), zero.alias("target_id"), label.alias("edge_type"), F.lit("includes").alias("edge_kind"), F.col("header").alias("edge_target"), F.col("repo").alias("source_repo")).distinct()
