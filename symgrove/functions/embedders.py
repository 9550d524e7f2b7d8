"""What stands for a text in similarity search; a model can be plugged in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from symgrove.functions.text import cosine, jaccard, tokens


class Embedder(Protocol):
    """Column of a text's embedding, and of the similarity (0 to 1) of two embeddings."""

    dimension: int | None

    def embed(self, text: Column) -> Column: ...

    def similarity(self, a: Column, b: Column) -> Column: ...


class TokenEmbedder:
    """Token sets compared by their overlap; the default, all in built-in functions."""

    dimension = None

    def embed(self, text: Column) -> Column:
        return tokens(text)

    def similarity(self, a: Column, b: Column) -> Column:
        return jaccard(a, b)


class VectorEmbedder:
    """Vectors made by a function of columns (a pandas UDF of a model, say), compared by cosine."""

    def __init__(self, embed, dimension: int):
        self._embed, self.dimension = embed, dimension

    def embed(self, text: Column) -> Column:
        return self._embed(text)

    def similarity(self, a: Column, b: Column) -> Column:
        return cosine(a, b)


class NullEmbedder:
    """No embedding at all; nothing is similar to anything."""

    dimension = 0

    def embed(self, text: Column) -> Column:
        return F.array().cast("array<float>")

    def similarity(self, a: Column, b: Column) -> Column:
        return F.lit(0.0)
