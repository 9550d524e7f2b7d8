"""Code-knowledge analytics on Spark: ingest, graph, text and data-quality operators."""

__version__ = "0.1.0"
