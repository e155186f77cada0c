"""Structured Streaming jobs. Each one reads what has arrived, then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotewright.operators.pricing import estimate_cost
from quotewright.operators.validation import accepted, quarantined, validate_requests
from quotewright.streaming import batches
from quotewright.streaming.batches import BATCH
from quotewright.streaming.device_state import device_state, stream_device_state
from quotewright.streaming.upload_sessions import stream_upload_sessions

__all__ = ["device_state", "price_batch", "pricing_counts", "stream_device_state", "stream_pricing", "stream_upload_sessions"]

COUNTS = f"requests bigint, accepted bigint, rejected bigint, {BATCH} bigint"


def price_batch(requests: DataFrame, batch_id: int, out: str) -> None:
    """Price the accepted requests of a batch and keep the rejected ones with what they violate.

    The batch is read once: it is checked and held, and its counts are observed on the
    way to the first sink. Both sinks and the counts have a folder per batch, so a batch that
    runs again replaces its rows instead of adding them twice.
    """
    seen = Observation(f"pricing-{batch_id}")
    fine = F.size("violations") == 0
    checked = validate_requests(requests).persist()
    try:
        counted = checked.observe(
            seen, F.count("*").alias("requests"), F.count(F.when(fine, 1)).alias("accepted"), F.count(F.when(~fine, 1)).alias("rejected"))
        batches.put(quarantined(counted), f"{out}/rejected", batch_id)
        batches.put(estimate_cost(accepted(checked)), f"{out}/priced", batch_id)
        found = seen.get
        counts = requests.sparkSession.createDataFrame(
            [(found["requests"], found["accepted"], found["rejected"])], COUNTS.replace(f", {BATCH} bigint", ""))
        batches.put(counts, f"{out}/counts", batch_id)
    finally:
        checked.unpersist()


def pricing_counts(spark: SparkSession, out: str) -> DataFrame:
    return batches.read(spark, f"{out}/counts", COUNTS)


def stream_pricing(requests: DataFrame, out: str, checkpoint: str) -> None:
    """Price requests as they arrive into ``out``/priced, ``out``/rejected and ``out``/counts."""
    query = (
        requests.writeStream.foreachBatch(lambda batch, batch_id: price_batch(batch, batch_id, out))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
