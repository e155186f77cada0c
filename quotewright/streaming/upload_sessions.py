"""Upload sessions of a stream, with nothing lost: closed, still open, and late uploads.

A batch becomes session fragments per device, which are merged with the fragments that
the batch before left open. The watermark is the newest upload of all earlier batches and this one
minus ``lateness``. A fragment whose ten minutes ended by then is closed and comes
out; the others are the open sessions that the next batch starts from. An upload that is
not newer than the watermark before its batch is late: it may belong to a session that
is out already, so it goes to a table of its own. ``flush`` closes what is open, and
``settled`` merges all three into the sessions that a batch job would find.

Every batch writes folders of its own from those of the batch before, so a repeated
batch changes nothing. State is a row of a few numbers per open session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotewright.streaming import batches
from quotewright.streaming.batches import BATCH

TTL = "INTERVAL 10 MINUTES"
FRAGMENTS = f"device_id string, first timestamp, last timestamp, files bigint, {BATCH} bigint"
LATE = f"device_id string, ts timestamp, {BATCH} bigint"
CLOCK = f"newest timestamp, {BATCH} bigint"
TABLES = {"closed": FRAGMENTS, "open": FRAGMENTS, "late": LATE, "clock": CLOCK}


def fragments(uploads: DataFrame) -> DataFrame:
    """Sessions among ``uploads`` (device_id, ts) alone. Partial counts are combined before the shuffle."""
    window = F.session_window("ts", "10 minutes")
    found = uploads.groupBy("device_id", window.alias("window")).agg(F.count("*").alias("files"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select("device_id", "first", "last", "files")


def merged(parts: DataFrame) -> DataFrame:
    """Join fragments of a device that overlap or lie at most ten minutes apart."""
    order = Window.partitionBy("device_id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("_starts", (reach.isNull() | (F.col("first") > reach + F.expr(TTL))).cast("int"))
    numbered = starts.withColumn("_session", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("device_id", "_session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("files").alias("files")).drop("_session")


def _watermark(spark: SparkSession, out: str, upto: int, lateness: str):
    """The watermark after batch ``upto``; None before any upload."""
    newest = batches.read(spark, f"{out}/clock", CLOCK, upto - 1, upto).agg(F.max("newest").alias("newest"))
    return newest.select((F.col("newest") - F.expr(f"INTERVAL {lateness}")).alias("mark")).first()["mark"]


def _last_batch(spark: SparkSession, out: str) -> int:
    return max(batches.numbers(spark, f"{out}/clock", BATCH, finished=True))


def apply(batch: DataFrame, batch_id: int, out: str, lateness: str) -> None:
    spark = batch.sparkSession
    uploads = batch.select("device_id", F.col("ts").cast("timestamp").alias("ts")).where("device_id <> '' AND ts IS NOT NULL").persist()
    try:
        before = max((n for n in batches.numbers(spark, f"{out}/clock", BATCH) if n < batch_id), default=-1)
        mark = _watermark(spark, out, before, lateness)
        late = F.col("ts") <= F.lit(mark) if mark is not None else F.lit(False)
        batches.put(uploads.where(late), f"{out}/late", batch_id)
        newest = uploads.agg(F.max("ts").alias("newest")).unionByName(batches.read(spark, f"{out}/clock", CLOCK, before - 1, before).select("newest"))
        batches.put(newest.agg(F.max("newest").alias("newest")), f"{out}/clock", batch_id)
        left = batches.read(spark, f"{out}/open", FRAGMENTS, before - 1, before).drop(BATCH)
        sessions = merged(left.unionByName(fragments(uploads.where(~late)))).persist()
        try:
            mark = _watermark(spark, out, batch_id, lateness)
            over = F.col("last") + F.expr(TTL) <= F.lit(mark) if mark is not None else F.lit(False)
            batches.put(sessions.where(over), f"{out}/closed", batch_id)
            batches.put(sessions.where(~over), f"{out}/open", batch_id)
        finally:
            sessions.unpersist()
    finally:
        uploads.unpersist()


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("device_id", F.col("first").alias("session_start"), (F.col("last") + F.expr(TTL)).alias("session_end"), "files")


def closed_sessions(spark: SparkSession, out: str) -> DataFrame:
    return _shown(batches.read(spark, f"{out}/closed", FRAGMENTS))


def open_sessions(spark: SparkSession, out: str) -> DataFrame:
    last = _last_batch(spark, out)
    return _shown(batches.read(spark, f"{out}/open", FRAGMENTS, last - 1, last))


def late_uploads(spark: SparkSession, out: str) -> DataFrame:
    return batches.read(spark, f"{out}/late", LATE).drop(BATCH)


def flush(spark: SparkSession, out: str) -> None:
    """Close all open sessions, as at the end of the input; repeating it changes nothing."""
    last = _last_batch(spark, out)
    held = batches.read(spark, f"{out}/open", FRAGMENTS, last - 1, last).drop(BATCH)
    batches.put(held, f"{out}/closed", last + 1)
    batches.put(held.limit(0), f"{out}/open", last + 1)
    batches.put(held.limit(0).select(F.col("device_id"), F.col("first").alias("ts")), f"{out}/late", last + 1)
    batches.put(batches.read(spark, f"{out}/clock", CLOCK, last - 1, last).drop(BATCH), f"{out}/clock", last + 1)


def settled(spark: SparkSession, out: str) -> DataFrame:
    """Closed and open sessions and late uploads together: the sessions of all uploads, whatever order they came in."""
    last = _last_batch(spark, out)
    kept = batches.read(spark, f"{out}/closed", FRAGMENTS).unionByName(batches.read(spark, f"{out}/open", FRAGMENTS, last - 1, last)).drop(BATCH)
    return _shown(merged(kept.unionByName(fragments(late_uploads(spark, out)))))


def stream_upload_sessions(uploads: DataFrame, out: str, checkpoint: str, lateness: str) -> None:
    """Keep closed and open sessions and late uploads below ``out`` until all that has arrived is read."""
    spark = uploads.sparkSession
    if not batches.numbers(spark, f"{out}/clock", BATCH):
        for name, schema in TABLES.items():
            batches.start(spark, f"{out}/{name}", schema)
    query = (
        uploads.writeStream.foreachBatch(lambda batch, batch_id: apply(batch, batch_id, out, lateness))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
