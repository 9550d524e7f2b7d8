"""Scans of source and documentation trees."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove.functions.text import extension, ignore_patterns, ignored, language_of
from symgrove.session import ship
from symgrove.sources import git

IGNORE_FILE = ".symgroveignore"
DOC_SUFFIXES = ["md", "rst"]


def load_ignore(root: str) -> list[str]:
    """Patterns of the ignore file in ``root``; none without one."""
    p = Path(root, IGNORE_FILE)
    return ignore_patterns(p.read_text("utf-8", "replace")) if p.is_file() else []


def scan(spark: SparkSession, root: str, suffixes: list[str] | None = None, tracked: set[str] | None = None) -> DataFrame:
    """path (below ``root``), content, language, modified, valid of the files below ``root``.

    Left out: what lies in ``.git``, what the ignore file names, suffixes other than
    those given, and, with ``tracked``, paths not in it. Contents that are no
    UTF-8 are NULL with ``valid`` false.
    """
    ship(spark)
    base = Path(root).resolve().as_posix().rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    full = F.regexp_replace("path", r"^file:/*", "/")
    path = F.substring(full, len(base) + 1, 1 << 20)
    df = raw.select(path.alias("path"), F.col("content").alias("bytes"), F.col("modificationTime").alias("modified"))
    df = df.filter(~F.concat(F.lit("/"), "path").contains("/.git/") & ~ignored(F.col("path"), load_ignore(root)) & (F.col("path") != IGNORE_FILE))
    if suffixes is not None:
        df = df.filter(extension(F.col("path")).isin(suffixes))
    if tracked is not None:
        allow = spark.createDataFrame([(x,) for x in sorted(tracked)], "path string")
        df = df.join(allow, "path", "left_semi")
    text = F.try_validate_utf8(F.col("bytes").cast("string"))
    return df.select("path", text.alias("content"), language_of(F.col("path")).alias("language"), "modified", text.isNotNull().alias("valid"))


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """Source files of the known languages that git tracks (all, if git cannot say)."""
    return scan(spark, root, tracked=git.tracked_files(root)).filter("language is not null")


def scan_docs(spark: SparkSession, root: str) -> DataFrame:
    """Documentation files; git is not asked."""
    return scan(spark, root, DOC_SUFFIXES)


def scan_headers(spark: SparkSession, root: str) -> DataFrame:
    """Files that may hold include directives; only the ignore file counts."""
    return scan(spark, root, ["h", "hpp", "hxx", "cpp", "cxx", "cc", "c"])
