"""Streams of source files and events (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgrove.functions.text import language_of
from symgrove.operators.store import Store
from symgrove.plans.index import assign_ids, extract_files, new_symbols
from symgrove.session import cut


def source_stream(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    """New files below a folder as a stream: repo, file_path, content, language."""
    raw = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder)
    path = F.col("_metadata.file_path")
    return raw.select(F.lit(repo).alias("repo"), path.alias("file_path"), F.col("value").alias("content"), language_of(path).alias("language"))


def ingest(files: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Bring the symbols of every micro-batch into the store, for what is there now.

    A file that comes again takes the place of its old symbols, which keep their ids
    where they are the same; a batch that is run again changes nothing. Only the
    repositories of the batch are rewritten.
    """
    key = ["content_hash", "file_path", "name", "repo"]

    def batch(df: DataFrame, _: int) -> None:
        raw = cut(extract_files(df), "raw")
        for (repo,) in raw.select("repo").distinct().collect():  # a source stream has one
            own = raw.filter(F.col("repo") == repo)
            old = store.read("symbols", repo)
            fresh = cut(new_symbols(own).join(old.select(*key, F.col("id").alias("old_id")), key, "left"), "fresh")
            added = assign_ids(fresh.filter("old_id is null").drop("old_id"), store.top_id("symbols"))
            now = added.unionByName(fresh.filter("old_id is not null").withColumnRenamed("old_id", "id").select(added.columns))
            kept = old.join(own.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
            store.replace("symbols", repo, cut(kept.select(old.columns).unionByName(now.select(old.columns)), "symbols"))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their sum per window and type; on streams, rows over ``late`` behind are dropped by the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


