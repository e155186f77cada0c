"""The device table as incremental state.

A batch writes its proposals to a log by day, their counts per device and hour, and a new
state row for each device that it touches and that is registered. If the device's first
registration stays the same, the batch's own later proposals are added to the old
row. If the batch brings an earlier registration than the known one, or the first, the
count is corrected from the kept hours, and from the log of the one day on which the
registration falls. So the work of a batch depends on the batch and the devices it
touches, not on the log.

Rows of a batch are computed from the batches before it, and every batch has its own
folders, so a repeated batch writes the same again. After ``compact_every`` batches the
newest row of each device and the sums of its hours become a base table by device bucket,
marked with the batch it goes through; folders that two bases cover are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators.history import proposals_after, registrations
from quotewright.streaming import batches
from quotewright.streaming.batches import BATCH

ACTIONS = ("register", "record_proposal")
_SEEN = "struct<ts:timestamp_ntz,event_id:bigint>"
STATE = (
    f"device_id string, first_seen {_SEEN}, last_registered timestamp_ntz, user_name string, named_at {_SEEN}, "
    f"proposal_count bigint, last_proposal timestamp_ntz, {BATCH} bigint"
)
HOURS = f"device_id string, hour timestamp, n bigint, last timestamp_ntz, {BATCH} bigint"
LOG = f"device_id string, ts timestamp_ntz, event_id bigint, hour timestamp, {BATCH} bigint, day date"
#: Folders of a base table.
BUCKETS = 64


def _bucket() -> F.Column:
    return F.pmod(F.hash("device_id"), F.lit(BUCKETS)).alias("bucket")


@dataclass(frozen=True)
class DeviceTable:
    """The tables below ``path``."""

    spark: SparkSession
    path: str

    def start(self) -> None:
        for name, schema in (("state", STATE), ("hours", HOURS)):
            batches.start(self.spark, f"{self.path}/{name}", schema)
        batches.put(self.spark.createDataFrame([], LOG).drop(BATCH), f"{self.path}/log", -1, "day")

    def base(self, upto: int) -> int:
        """The last batch that a finished base goes through, at most ``upto``; -1 without one."""
        both = [set(batches.numbers(self.spark, f"{self.path}/base_{n}", "through", finished=True)) for n in ("state", "hours")]
        return max((n for n in both[0] & both[1] if n <= upto), default=-1)

    def _rows(self, name: str, schema: str, upto: int, buckets: list[int] | None) -> DataFrame:
        """Base and later batches together, of the devices in ``buckets``."""
        through = self.base(upto)
        rows = batches.read(self.spark, f"{self.path}/{name}", schema, through, upto)
        if through >= 0:
            base = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/base_{name}/through={through}")
            base = base if buckets is None else base.where(F.col("bucket").isin(buckets))
            rows = rows.unionByName(base.drop("bucket").withColumn(BATCH, F.lit(through).cast("bigint")))
        return rows if buckets is None else rows.where(_bucket().isin(buckets))

    def devices(self, upto: int, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each registered device after batch ``upto``."""
        rows = self._rows("state", STATE, upto, buckets)
        newest = rows.groupBy("device_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("device_id", BATCH)]), BATCH).alias("row"))
        return newest.select("device_id", "row.*")

    def hours(self, upto: int, buckets: list[int] | None = None) -> DataFrame:
        rows = self._rows("hours", HOURS, upto, buckets)
        return rows.groupBy("device_id", "hour").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def log(self, upto: int, days: list) -> DataFrame:
        rows = batches.read(self.spark, f"{self.path}/log", LOG, None, upto)
        return rows.where(F.col("day").isin(days)).select("device_id", "ts", "event_id", "hour")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Write what ``batch`` changes; computed from the batches before it alone."""
        hour = F.date_trunc("hour", "ts")
        kept = batch.where(F.col("action").isin(*ACTIONS)).select("event_id", "ts", "device_id", "action", "user_name").persist()
        try:
            proposals = kept.where("action = 'record_proposal'").select("device_id", "ts", "event_id", hour.alias("hour"))
            batches.put(proposals.withColumn("day", F.to_date("ts")), f"{self.path}/log", batch_id, "day")
            hourly = proposals.groupBy("device_id", "hour").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
            batches.put(hourly, f"{self.path}/hours", batch_id)
            touched = kept.select("device_id").distinct()
            buckets = [r["bucket"] for r in touched.select(_bucket()).distinct().collect()]
            if not buckets:
                return batches.put(self.spark.createDataFrame([], STATE).drop(BATCH), f"{self.path}/state", batch_id)
            old = self.devices(batch_id - 1, buckets).join(touched, "device_id", "left_semi")
            known = old.withColumn("old_first", F.col("first_seen"))
            new = registrations(kept)
            merged = known.unionByName(new, allowMissingColumns=True).groupBy("device_id").agg(
                F.min("first_seen").alias("first_seen"), F.max("last_registered").alias("last_registered"),
                F.max_by("user_name", "named_at").alias("user_name"), F.max("named_at").alias("named_at"),
                F.max("proposal_count").alias("proposal_count"), F.max("last_proposal").alias("last_proposal"),
                F.min("old_first").alias("old_first")).persist()
            try:
                fresh = F.col("old_first").isNull() | (F.col("first_seen") < F.col("old_first"))
                self._write_state(merged.withColumn("fresh", fresh), hourly, proposals, batch_id, buckets)
            finally:
                merged.unpersist()
        finally:
            kept.unpersist()

    def _write_state(self, merged: DataFrame, hourly: DataFrame, proposals: DataFrame, batch_id: int, buckets: list[int]) -> None:
        same, fresh = merged.where("not fresh"), merged.where("fresh")
        added = proposals_after(hourly, proposals, same)
        days = [r["day"] for r in fresh.select(F.to_date("first_seen.ts").alias("day")).distinct().collect()]
        if days:
            ids = fresh.select("device_id")
            hours = self.hours(batch_id, buckets).join(ids, "device_id", "left_semi")
            added = added.unionByName(proposals_after(hours, self.log(batch_id, days).join(ids, "device_id", "left_semi"), fresh))
        counted = merged.join(added.withColumnsRenamed({"proposal_count": "more", "last_proposal": "later"}), "device_id", "left")
        before = F.when(~F.col("fresh"), F.col("proposal_count"))
        rows = counted.select(
            "device_id", "first_seen", "last_registered", "user_name", "named_at",
            (F.coalesce(before, F.lit(0)) + F.coalesce("more", F.lit(0))).alias("proposal_count"),
            F.greatest(F.when(~F.col("fresh"), F.col("last_proposal")), "later").alias("last_proposal"))
        batches.put(rows, f"{self.path}/state", batch_id)

    def compact(self, batch_id: int) -> None:
        """Fold everything through ``batch_id`` into a base; delete what is older than the base before it."""
        previous = self.base(batch_id - 1)
        for name, rows in (("state", self.devices(batch_id)), ("hours", self.hours(batch_id))):
            by_bucket = rows.withColumn("bucket", _bucket()).repartition("bucket")
            by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base_{name}/through={batch_id}")
        for name in ("state", "hours"):
            for n in batches.numbers(self.spark, f"{self.path}/{name}", BATCH):
                if 0 <= n <= previous:
                    batches.drop(self.spark, f"{self.path}/{name}/{BATCH}={n}")
            for n in batches.numbers(self.spark, f"{self.path}/base_{name}", "through"):
                if n < previous:
                    batches.drop(self.spark, f"{self.path}/base_{name}/through={n}")


def device_state(spark: SparkSession, path: str, upto: int = 2**62) -> DataFrame:
    """The device table after the last batch, or after batch ``upto`` while its folders are kept."""
    return DeviceTable(spark, path).devices(upto).select(
        "device_id", F.coalesce("user_name", F.lit("")).alias("user_name"), F.col("first_seen.ts").alias("created_at"),
        F.greatest("last_registered", "last_proposal").alias("last_seen"), "proposal_count")


def stream_device_state(events: DataFrame, path: str, checkpoint: str, compact_every: int = 20) -> None:
    """Keep the device table below ``path`` up to date with ``events`` until all that has arrived is read."""
    table = DeviceTable(events.sparkSession, path)
    if not batches.numbers(table.spark, f"{path}/state", BATCH):
        table.start()

    def write(batch: DataFrame, batch_id: int) -> None:
        own = DeviceTable(batch.sparkSession, path)
        own.apply(batch, batch_id)
        if (batch_id + 1) % compact_every == 0:
            own.compact(batch_id)

    query = (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
