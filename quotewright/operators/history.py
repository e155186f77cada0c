"""Device registry and proposal history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions.text import size_kb
from quotewright.operators.responses import _whole_json
from quotewright.operators.validation import stored_user_name

HISTORY_LIMIT = 100


def registrations(events: DataFrame) -> DataFrame:
    """First registration, last refresh, and last non-blank name with its time, per device."""
    order = F.struct("ts", "event_id")
    name = stored_user_name(F.col("user_name"))
    return events.where("action = 'register'").groupBy("device_id").agg(
        F.min(order).alias("first_seen"),
        F.max("ts").alias("last_registered"),
        F.max_by(F.when(name != "", name), F.when(name != "", order)).alias("user_name"),
        F.max(F.when(name != "", order)).alias("named_at"),
    )


def proposals_after(hourly: DataFrame, proposals: DataFrame, devices: DataFrame) -> DataFrame:
    """proposal_count and last_proposal after ``first_seen`` of each device that has any.

    ``hourly`` has n and last per device and hour; single rows of ``proposals`` (with
    their hour) matter only in the hour of the registration itself.
    """
    first = devices.select("device_id", "first_seen", F.date_trunc("hour", F.col("first_seen.ts")).alias("first_hour"))
    later = hourly.join(first, "device_id").where("hour > first_hour").select("device_id", "n", "last")
    same = (
        proposals.join(first.withColumnRenamed("first_hour", "hour"), ["device_id", "hour"])
        .where(F.struct("ts", "event_id") > F.col("first_seen"))
        .groupBy("device_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    )
    return later.unionByName(same).groupBy("device_id").agg(
        F.sum("n").alias("proposal_count"), F.max("last").alias("last_proposal"))


def device_rollup(events: DataFrame) -> DataFrame:
    """One row per registered device; only proposals after its registration count.

    Proposals are counted per device and hour before they meet the registration, so a
    device with very many shrinks where it is read.
    """
    devices = registrations(events)
    hour = F.date_trunc("hour", "ts")
    proposals = events.where("action = 'record_proposal'").select("device_id", "ts", "event_id", hour.alias("hour"))
    hourly = proposals.groupBy("device_id", "hour").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    counted = proposals_after(hourly, proposals, devices)
    return devices.join(counted, "device_id", "left").select(
        "device_id",
        F.coalesce("user_name", F.lit("")).alias("user_name"),
        F.col("first_seen.ts").alias("created_at"),
        F.greatest("last_registered", "last_proposal").alias("last_seen"),
        F.coalesce("proposal_count", F.lit(0).cast("bigint")).alias("proposal_count"),
    )


def history_top_n(proposals: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest ``limit`` proposals per device.

    Each input partition keeps only its own newest rows before the shuffle, so a
    device with very many proposals does not reach one task whole. Spark does so for a
    ``limit`` below its spark.sql.window.group.limit threshold, 1000 unless set.
    """
    newest = Window.partitionBy("device_id").orderBy(F.desc("created_at"), F.desc("id"))
    return proposals.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)


def history_total(proposals: DataFrame) -> DataFrame:
    return proposals.agg(F.count("*").alias("total"))


def device_history(devices: DataFrame, proposals: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Device rows with their newest proposals nested, newest first (at most ``limit``)."""
    nested = history_top_n(proposals, limit).groupBy("device_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "id", "created_at", "filename"))).alias("history")
    )
    empty = F.array().cast("array<struct<position:int,id:bigint,created_at:timestamp_ntz,filename:string>>")
    return devices.join(nested, "device_id", "left").withColumn("history", F.coalesce("history", empty))


def with_links(history: DataFrame) -> DataFrame:
    """Add the download and view addresses of each stored file."""
    return history.withColumns({
        "download_url": F.concat(F.lit("/proposals/"), F.col("filename")),
        "view_url": F.concat(F.lit("/proposals/"), F.col("filename"), F.lit("?inline=true")),
    })


def history_artifacts(proposals: DataFrame, artifacts: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """History rows with the size of their file; a missing file has size 0."""
    history = with_links(history_top_n(proposals, limit))
    files = artifacts.select("filename", "size_bytes")
    return history.join(files, "filename", "left").withColumns({
        "exists": F.col("size_bytes").isNotNull(),
        "size_kb": F.coalesce(size_kb(F.col("size_bytes")), F.lit(0.0)),
    }).drop("size_bytes")


def owned_sections(wanted: DataFrame, proposals: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Sections of the wanted (device_id, id) pairs that are in the device's history.

    Only devices asked for are ranked, by id and time alone; sections are fetched and
    parsed for the pairs that remain.
    """
    asked = proposals.select("device_id", "id", "created_at").join(wanted.select("device_id").distinct(), "device_id", "left_semi")
    kept = history_top_n(asked, limit).select("device_id", "id").join(wanted, ["device_id", "id"], "left_semi")
    found = proposals.select("device_id", "id", "sections_json").join(kept, ["device_id", "id"], "left_semi")
    return found.withColumn("sections", _whole_json(F.col("sections_json"))).where(
        F.col("sections").isNotNull()
        & ~F.to_json("sections").isin("{}", "[]", '""', "0", "false", "null")
    ).drop("sections_json")
