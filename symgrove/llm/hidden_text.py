"""Natural language inside code: comments and strings, their languages and their share of each file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm.langid import language
from symgrove.llm.lexing import family, pieces, running_text, units


def texts(code: str, fam: str) -> list[tuple[str, str, str]]:
    """(language, ``comment`` or ``string``, text) of every sentence or phrase in a source text."""
    out = []
    for kind, _, _, text in pieces(code, fam):
        for _, s in units(text):
            words = running_text(s)
            lang = words and language(words)
            if lang:
                out.append((lang, kind, s))
    return out


def _rows(batches):
    names = ["symbol_id", "repo", "file_path", "piece", "lang", "place", "text", "n_bytes"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        out: list[tuple] = []
        for i, repo, path, code, lang in zip(*(c.to_pylist() for c in b.columns)):
            if code:
                code = code.replace("\r\n", "\n").replace("\r", "\n")
                out += [(i, repo, path, n, g, k, s, len(s.encode())) for n, (g, k, s) in enumerate(texts(code, family(lang, path)))]
        cols = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def text_pieces(symbols: DataFrame) -> DataFrame:
    """Every piece of running text in the definitions: symbol_id, repo, file_path, piece, lang, place, text, n_bytes.

    Code-like comments and literals are left out. NULL and empty definitions give
    no rows; repeated rows give their pieces again.
    """
    src = symbols.select(F.col("id").cast("long"), "repo", "file_path", "definition", "language")
    return src.mapInArrow(_rows, "symbol_id long, repo string, file_path string, piece int, lang string, place string, text string, n_bytes long")


def language_shares(symbols: DataFrame) -> DataFrame:
    """Bytes of running text per file and language, and their share of the file's bytes: repo, file_path, lang, n_texts, text_bytes, share.

    A file is all its rows in ``symbols``; a file without text gives no rows.
    """
    per = text_pieces(symbols).groupBy("repo", "file_path", "lang").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_bytes").alias("text_bytes"))
    size = symbols.groupBy(F.col("repo").alias("r"), F.col("file_path").alias("p")).agg(F.sum(F.octet_length("definition")).alias("file_bytes"))
    j = per.join(size, F.col("repo").eqNullSafe(F.col("r")) & F.col("file_path").eqNullSafe(F.col("p")))
    return j.select("repo", "file_path", "lang", "n_texts", "text_bytes", F.round(F.col("text_bytes") / F.col("file_bytes"), 6).alias("share"))
