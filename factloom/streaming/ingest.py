"""Streaming variants (an extension): evidence arriving as a stream, and facts merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from factloom.functions import confidence as C
from factloom.sources.store import Store, upsert


def windowed_confidence(evidence: DataFrame, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Noisy-or per fact and window of extracted_at over a stream; rows later than the watermark are left out."""
    return (
        evidence.withWatermark("extracted_at", lateness)
        .groupBy("fact_id", F.window("extracted_at", window).alias("w"))
        .agg(C.noisy_or(F.col("confidence")).alias("confidence"), F.count(F.lit(1)).alias("n_evidence"))
        .select("fact_id", F.col("w.start").alias("window_start"), "confidence", "n_evidence")
    )


def into_store(stream: DataFrame, store: Store, table: str, key: str, checkpoint: str, then: Callable[[], None] | None = None) -> StreamingQuery:
    """Upsert a stream's batches into a table of the store, all that is there at the time it starts.

    A batch that runs again after a failure writes the same rows, so it counts once.
    """

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        store.commit(**{table: upsert(store.table(table), df.dropDuplicates([key]), key)})
        if then:
            then()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
