"""Streaming jobs run over the given tables until they have read everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotewright.functions import dates
from quotewright.operators.pricing import COST_PARTS
from quotewright.plans.inputs import COST, with_ctes, with_lists
from quotewright.plans.pricing import AMOUNTS
from quotewright.plans.records import ROLLUP_SQL, _shown
from quotewright.plans.registry import query
from quotewright.sources import scratch, tables
from quotewright.streaming import jobs, upload_sessions


def stream_table(spark, sf, name):
    schema = tables.read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(with_ctes(f"""SELECT request_id, {AMOUNTS}, industry_applied, '' AS violations FROM costs
    UNION ALL SELECT request_id, {', '.join('NULL' for _ in COST_PARTS)}, NULL, concat_ws(',',
      CASE WHEN duration_months < 1 THEN 'duration_months:too_small' WHEN duration_months > 60 THEN 'duration_months:too_large' END,
      CASE WHEN expected_users < 10 THEN 'expected_users:too_small' END)
    FROM requests WHERE duration_months NOT BETWEEN 1 AND 60 OR expected_users < 10""", *COST))
def stream_pricing(spark, sf):
    arriving = spark.sql(
        tables.REQUESTS, orders=stream_table(spark, sf, "orders"), customer=tables.read_table(spark, sf, "customer"))
    out = scratch.fresh_path(spark, "priced")
    jobs.stream_pricing(with_lists(arriving), out, scratch.fresh_path(spark, "priced-state"))
    rejected = spark.read.parquet(f"{out}/rejected").select(
        "request_id", *[F.lit(None).cast("bigint").alias(c) for c in COST_PARTS], F.lit(None).cast("string").alias("industry_applied"),
        F.array_join("violations", ",").alias("violations"))
    priced = spark.read.parquet(f"{out}/priced").select("request_id", *COST_PARTS, "industry_applied", F.lit("").alias("violations"))
    return priced.unionByName(rejected)


@query(with_ctes(ROLLUP_SQL, "device_events"))
def stream_device_state(spark, sf):
    arriving = spark.sql(tables.DEVICE_EVENTS, events=stream_table(spark, sf, "events"))
    table = scratch.fresh_path(spark, "devices")
    jobs.stream_device_state(arriving, table, scratch.fresh_path(spark, "devices-state"))
    return _shown(jobs.device_state(spark, table))


# Sessions closed by the watermark, and those still open at the end of the input.
@query(with_ctes("""SELECT device_id, epoch_us(start_ts) AS start_us, epoch_us(last_ts) + 600000000 AS end_us, files,
    CASE WHEN last_ts + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM device_events WHERE action = 'upload') THEN 'closed' ELSE 'open' END AS state
    FROM (
    SELECT device_id, start_ts, max(ts) AS last_ts, count(*) AS files FROM (
      SELECT *, max(CASE WHEN gap IS NULL OR gap > INTERVAL 10 MINUTE THEN ts END) OVER (PARTITION BY device_id ORDER BY ts) AS start_ts FROM (
        SELECT *, ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) AS gap FROM device_events WHERE action = 'upload') a) b
    GROUP BY device_id, start_ts) c""", "device_events"))
def stream_upload_sessions(spark, sf):
    arriving = spark.sql(tables.DEVICE_EVENTS, events=stream_table(spark, sf, "events")).where("action = 'upload'")
    out = scratch.fresh_path(spark, "sessions")
    jobs.stream_upload_sessions(arriving, out, scratch.fresh_path(spark, "sessions-state"), "10 minutes")
    closed = upload_sessions.closed_sessions(spark, out).withColumn("state", F.lit("closed"))
    found = closed.unionByName(upload_sessions.open_sessions(spark, out).withColumn("state", F.lit("open")))
    return found.select(
        "device_id", dates.epoch_micros(F.col("session_start")).alias("start_us"),
        dates.epoch_micros(F.col("session_end")).alias("end_us"), "files", "state")
