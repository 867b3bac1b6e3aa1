"""Incremental indexing, in batches and as a stream, and windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import store as ST
from ..sources.tables import stored


def index_changes(store: ST.Store, docs: DataFrame, strategy: str = "recursive", delete_missing: bool = True, **options) -> DataFrame:
    """docs (path, content) against the store: what is new or changed is chunked and replaced, what is gone is removed.
    Returns (status, n)."""
    status = stored(store.changes(docs), "changes")
    todo = status.filter(F.col("status").isin("new", "changed")).select("path")
    rows = stored(docs.join(todo, "path", "left_semi").select(F.col("path").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.col("path").alias("source"), "content", F.lit(None).cast("string").alias("metadata")), "changed-docs")
    if delete_missing:
        store.remove_by_source(status.filter("status = 'deleted'").select(F.col("path").alias("source")))
    store.insert(rows, C.chunk(rows, strategy, **options), ST.fingerprints(rows.select(F.col("source").alias("path"), "content")))
    return status.groupBy("status").agg(F.count("*").alias("n"))


def index_stream(spark: SparkSession, source: DataFrame, store: ST.Store, checkpoint: str, strategy: str = "recursive", **options):
    """A stream of (path, content): every micro-batch replaces the documents it brings. A batch that runs again leaves the store
    the same, so delivery may repeat. Within a batch the last version of a path by `seq`, if there is such a column, holds."""

    def apply(batch: DataFrame, _: int) -> None:
        if "seq" in batch.columns:
            batch = batch.groupBy("path").agg(F.max_by("content", "seq").alias("content"))
        index_changes(store, batch.select("path", "content").dropDuplicates(["path"]), strategy, delete_missing=False, **options)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) by event time; in a stream, rows later than the watermark are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events with no gap between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
