"""Ingest and read counts as streams. Batch is the rule here; these run the same plans over arriving data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.scrub import scrub
from lorespark.operators import ingest as ing
from lorespark.sources.store import Store
from lorespark.sources.tables import materialize, release


def unique_contents(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming items once for each content within the watermark."""
    hashed = items.withColumn("content_hash", ing.tx.content_hash(F.col("text")))
    return hashed.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["content_hash", "workspace"])


def reference_counts(references: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Reads of each memory row in tumbling or sliding windows of event time; late rows count up to the delay."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return references.withWatermark("ts", delay).groupBy(w.alias("w"), "id").agg(F.count(F.lit(1)).alias("reads"))


def reading_sessions(references: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of reads of each row, ended by a gap."""
    return references.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "id").agg(F.count(F.lit(1)).alias("reads"))


def ingest_into(items: DataFrame, store: Store, checkpoint: str, pii: bool = False):
    """Writes each micro-batch of items to the store's tables; contents that it holds aren't embedded again."""

    def one(batch: DataFrame, _: int) -> None:
        # Scrubbed once and written, so that what follows reads it three times and scrubs nothing again.
        clean = materialize(scrub(batch, "text", pii).drop("redactions"), "stream-batch")
        got = ing.ingest(clean, store.read("chunks"), store.read("chunk_acl"), store.read("raw_events"))
        store.upsert("raw_events", got.events, ing.EVENT_KEY)
        store.insert_absent("chunk_acl", got.acl, ["content_hash", "workspace"])
        store.insert_absent("chunks", got.chunks, ["content_hash"])
        release(clean, got.rows)

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
