"""Encoding of a corpus with a public byte-level BPE tokenizer, and back.

Encoding is a monoid: a long text is halved recursively, the leaves are
encoded, and neighbours are joined by re-encoding a window around the seam. The
window grows on either side until it ends at a *hard cut*: a place where the
tokenizer's pre-splitting pattern must cut whatever stands around it. Tokens
beyond a hard cut cannot depend on the text before it, so those outside the
window are final. Texts over ``SPLIT_CHARS`` are halved into rows of their own,
so that one giant text is encoded by many tasks.
"""

from __future__ import annotations

import base64
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-splitting pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 32_768
SPLIT_CHARS = 1_000_000
WINDOW = 64

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per process; no special tokens, their strings are ordinary text."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _kind(ch: str) -> str:
    if ch.isspace() or unicodedata.category(ch).startswith("Z"):
        return "S"
    return {"L": "L", "N": "N"}.get(unicodedata.category(ch)[0], "O")


def hard_cut(text: str, i: int) -> bool:
    """Whether the pattern cuts between text[i-1] and text[i] in every context.

    A piece never goes on from a letter, digit or sign into another class or into
    white space. White space before something else may join it, and an
    apostrophe may take letters with it, so these are not hard.
    """
    a, b = _kind(text[i - 1]), _kind(text[i])
    if a == "S" or a == b:
        return False
    return not (text[i - 1] == "'" and b == "L")


def last_cut(text: str) -> int:
    """Last hard cut, searched in windows that double; 0 if there is none."""
    size, seen = WINDOW, len(text)
    while seen > 1:
        low = max(1, len(text) - size)
        for i in range(seen - 1, low - 1, -1):
            if hard_cut(text, i):
                return i
        seen, size = low, size * 2
    return 0


def first_cut(text: str) -> int:
    """First hard cut, searched in windows that double; len(text) if there is none."""
    size, seen = WINDOW, 1
    while seen < len(text):
        high = min(len(text), size)
        for i in range(seen, high):
            if hard_cut(text, i):
                return i
        seen, size = high, size * 2
    return len(text)


def join(enc, a: tuple[str, list[int]], b: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """Monoid product of two encoded texts: the encoding of their concatenation. (``("", [])`` is its unit.)"""
    if not a[0] or not b[0]:
        return (a[0] + b[0], a[1] + b[1])
    p, q = last_cut(a[0]), first_cut(b[0])
    tail, head = a[0][p:], b[0][:q]
    keep = len(a[1]) - len(enc.encode_ordinary(tail))
    skip = len(enc.encode_ordinary(head))
    return (a[0] + b[0], a[1][:keep] + enc.encode_ordinary(tail + head) + b[1][skip:])


def encode(text: str | None, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of a text by tree reduction; NULL and empty give no ids."""
    if not text:
        return []
    enc = encoder(vocabulary)

    def tree(t: str) -> tuple[str, list[int]]:
        if len(t) <= leaf:
            return t, enc.encode_ordinary(t)
        half = len(t) // 2
        return join(enc, tree(t[:half]), tree(t[half:]))

    return tree(text)[1]


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """Text of the ids: the bytes of the tokens, concatenated."""
    return encoder(vocabulary).decode_bytes(list(ids)).decode("utf-8")


def _encode_rows(vocabulary: str, counts: bool):
    def run(batches):
        for b in batches:
            ids = [encode(t, vocabulary) for t in b.column(b.num_columns - 1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "n_tokens" if counts else "ids"])

    return run


def _join_rows(vocabulary: str):
    def run(key, pdf):
        enc = encoder(vocabulary)
        parts = sorted(zip(pdf["piece"], pdf["text"], pdf["ids"]))
        whole = ("", [])
        for _, text, ids in parts:  # two at most
            whole = join(enc, whole, (text, list(ids)))
        import pandas as pd

        return pd.DataFrame({"key": [key[0]], "piece": [key[1]], "n_pieces": [(int(pdf["n_pieces"].iloc[0]) + 1) // 2], "text": [whole[0]], "ids": [whole[1]]})

    return run


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, counts: bool = False, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """One row per row of ``df``: ``key`` and ``ids`` ARRAY<INT> (with ``counts``: ``n_tokens`` LONG instead).

    NULL and empty texts give an empty list. Repeated rows come out repeated; the
    key may be NULL. Other columns of ``df`` are not read. An empty frame gives no rows.
    """
    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = kept.schema["key"].dataType.simpleString()
    value = "n_tokens long" if counts else "ids array<int>"
    longest = kept.agg(F.max(F.length("text"))).first()[0] or 0
    whole = kept if longest <= split_chars else kept.filter(F.coalesce(F.length("text"), F.lit(0)) <= split_chars)
    out = whole.mapInArrow(_encode_rows(vocabulary, counts), f"key {key_type}, {value}")
    if longest > split_chars:
        giants = kept.filter(F.length("text") > split_chars).withColumn("row", F.monotonically_increasing_id())
        n = F.ceil(F.length("text") / F.lit(split_chars)).cast("int")
        pieces = giants.select(F.struct("row", "key").alias("key"), n.alias("n_pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"), "text")
        pieces = pieces.withColumn("text", F.expr(f"substring(text, piece * {split_chars} + 1, {split_chars})"))
        pieces = pieces.repartition("key", "piece").select("key", "n_pieces", "piece", "text", F.col("text").alias("t"))
        kt = f"struct<row: bigint, key: {key_type}>"
        from symgrove.session import cut

        level = cut(pieces.mapInArrow(_encode_rows(vocabulary, False), f"key {kt}, n_pieces int, piece int, text string, ids array<int>"), "leaves")
        top = -(-longest // split_chars)
        while top > 1:
            level = level.groupBy("key", F.floor(F.col("piece") / 2).cast("int").alias("piece")).applyInPandas(_join_rows(vocabulary), f"key {kt}, piece int, n_pieces int, text string, ids array<int>")
            top = (top + 1) // 2
        out = out.unionByName(level.select(F.col("key.key").alias("key"), F.size("ids").cast("long").alias("n_tokens") if counts else F.col("ids")))
    return out.withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of encoded rows; NULL and empty lists give an empty text."""

    def run(batches):
        for b in batches:
            texts = [decode(x or [], vocabulary) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    src = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
