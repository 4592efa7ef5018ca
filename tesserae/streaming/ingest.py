"""Turns as a stream: each micro-batch goes through the batch ingestion into the store's next version.

Exposures and attributions are keyed, so a batch that comes again after a failure changes nothing; the versions are
written whole and committed by number, so a reader never sees half a batch, and a batch that another writer overtook is
ingested again into that writer's version. The stream's own state is a watermark that drops turns
that come again within EXPOSURE_DAYS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae import schema as S
from tesserae.operators import provenance
from tesserae.sources import store as st

EVENT = f"{provenance.TURNS}, ledger array<struct<memory_id:string,channel:string,score:double,bm25_only:boolean,seq:long>>"


def ledger_of(events: DataFrame) -> DataFrame:
    """The ledger rows of turn events (EVENT)."""
    rows = events.select("session_id", "turn_id", "created_at", F.explode("ledger").alias("l"))
    return rows.select("session_id", "turn_id", "l.memory_id", "l.channel", "l.score", "l.bm25_only", "created_at", "l.seq")


def turns_of(events: DataFrame) -> DataFrame:
    return events.drop("ledger")


def ingest_batch(root: str):
    """A foreachBatch function that brings turn events into the store at root."""

    def run(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        once = events.dropDuplicates(["session_id", "turn_id"]).persist()
        try:
            if not once.isEmpty():
                st.changed(spark, root, lambda store: provenance.ingested(store, ledger_of(once), turns_of(once)))
        finally:
            once.unpersist()

    return run


def start(spark: SparkSession, source: str, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Reads JSON turn events from a folder and keeps the store at root up to date."""
    events = spark.readStream.schema(EVENT).json(source)
    events = events.withWatermark("created_at", f"{S.EXPOSURE_DAYS} days").dropDuplicatesWithinWatermark(["session_id", "turn_id"])
    writer = events.writeStream.foreachBatch(ingest_batch(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def exposure_counts(exposures: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, mode, n) of an exposure stream, or of a table of exposures, by windows of time."""
    rows = exposures.withWatermark("created_at", late) if exposures.isStreaming else exposures
    return rows.groupBy(F.window("created_at", window).alias("w"), "mode").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "mode", "n")
