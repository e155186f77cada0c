"""Streaming jobs against their batch twins, for any order, split and repetition."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotewright.operators import history, uploads
from quotewright.operators.validation import validate_requests
from quotewright.streaming import batches, device_state, jobs, upload_sessions

T0 = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, device_id string, action string, user_name string"


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(device_state, "BUCKETS", 3)


def split(rows, rng, parts):
    """The rows in random order, cut in ``parts`` batches, some of them empty."""
    rows = rows[:]
    rng.shuffle(rows)
    cuts = sorted(rng.randint(0, len(rows)) for _ in range(parts - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def device_events(rng, n):
    """Registrations that come after proposals, ties in time, blank names, other actions, one device with a third of all."""
    out = []
    for i in range(n):
        device = "hot" if rng.random() < 0.34 else f"d{rng.randint(0, 12)}"
        action = rng.choice(["register", "record_proposal", "record_proposal", "record_proposal", "upload"])
        ts = T0 + timedelta(minutes=rng.randint(0, 6_000)) if rng.random() < 0.8 else T0 + timedelta(hours=rng.randint(0, 3))
        out.append((i, ts, device, action, rng.choice(["", "  ", " Ann ", f"n{i}"])))
    return out


def as_rows(df):
    return sorted(map(tuple, df.select("device_id", "user_name", "created_at", "last_seen", "proposal_count").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_device_state(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = device_events(rng, 240)
    table = device_state.DeviceTable(spark, str(tmp_path / "devices"))
    table.start()
    arrived = []
    for number, part in enumerate(split(rows, rng, 4)):
        arrived += part
        batch = spark.createDataFrame(part, EVENTS)
        for _ in range(2 if number == seed else 1):  # a batch may run again
            table.apply(batch, number)
            if number in (1, 2):
                table.compact(number)
        if number in (1, 3):
            want = history.device_rollup(spark.createDataFrame(arrived, EVENTS))
            assert as_rows(device_state.device_state(spark, table.path)) == as_rows(want)


def test_a_batch_reads_bases_and_recent_batches_only(spark, tmp_path):
    table = device_state.DeviceTable(spark, str(tmp_path / "devices"))
    table.start()
    for number in range(4):
        table.apply(spark.createDataFrame(device_events(random.Random(number), 20), EVENTS), number)
        if number in (0, 2):
            table.compact(number)
    assert table.base(3) == 2 and table.base(1) == 0
    assert [n for n in batches.numbers(spark, f"{table.path}/state", "batch_id") if n >= 0] == [1, 2, 3]
    plan = table.devices(3, [0, 1])._jdf.queryExecution().executedPlan().toString()
    filters = sorted(line.split("PartitionFilters: ")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters" in line)
    assert len(filters) == 2 and any("> 2" in f for f in filters) and any("bucket" in f for f in filters), plan


def test_device_stream(spark, tmp_path):
    rows = device_events(random.Random(8), 120)
    source = str(tmp_path / "in")
    for part in split(rows, random.Random(9), 4):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        device_state.stream_device_state(stream, str(tmp_path / "out"), str(tmp_path / "mark"), compact_every=2)
    found = device_state.device_state(spark, str(tmp_path / "out"))
    assert as_rows(found) == as_rows(history.device_rollup(spark.createDataFrame(rows, EVENTS)))


def upload_events(rng, n):
    return [
        (rng.choice(["hot", "hot", "d1", "d2", "d3"]), T0 + timedelta(seconds=rng.choice([1, 60, 600]) * rng.randint(0, 90)))
        for _ in range(n)]


def sessions_of(spark, rows):
    full = [(d, i, 0, "f.pdf", 1, "t", ts) for i, (d, ts) in enumerate(rows)]
    df = spark.createDataFrame(full, "device_id string, upload_id bigint, pos int, filename string, size_bytes bigint, text string, ts timestamp_ntz")
    return sorted((r.device_id, r.session_start, r.session_end, r.files) for r in uploads.upload_sessions(df).collect())


def shown(df):
    return sorted((r.device_id, r.session_start, r.session_end, r.files) for r in df.select(
        "device_id", F.col("session_start").cast("timestamp_ntz"), F.col("session_end").cast("timestamp_ntz"), "files").collect())


@pytest.mark.parametrize(("seed", "lateness"), [(1, "10 minutes"), (2, "1 minute"), (3, "100 hours")])
def test_upload_sessions(spark, tmp_path, seed, lateness):
    """Closed, open and late together are the batch sessions, in any order and with repeated batches."""
    rng = random.Random(seed)
    rows, out = upload_events(rng, 150), str(tmp_path / "out")
    for name, schema in upload_sessions.TABLES.items():
        batches.start(spark, f"{out}/{name}", schema)
    for number, part in enumerate(split(rows, rng, 4)):
        batch = spark.createDataFrame(part, "device_id string, ts timestamp_ntz")
        for _ in range(2 if number == seed else 1):
            upload_sessions.apply(batch, number, out, lateness)
    want = sessions_of(spark, rows)
    assert shown(upload_sessions.settled(spark, out)) == want
    late = upload_sessions.late_uploads(spark, out).count()
    assert (late > 0) == (lateness != "100 hours")
    counted = sum(r.files for df in (upload_sessions.closed_sessions(spark, out), upload_sessions.open_sessions(spark, out)) for r in df.collect())
    assert counted + late == len(rows)
    for _ in range(2):
        upload_sessions.flush(spark, out)
        assert upload_sessions.open_sessions(spark, out).isEmpty()
    assert shown(upload_sessions.settled(spark, out)) == want


def test_sessions_in_order_need_no_settling(spark, tmp_path):
    rows, out = sorted(upload_events(random.Random(5), 120), key=lambda r: r[1]), str(tmp_path / "out")
    source = str(tmp_path / "in")
    for a in range(0, 120, 40):
        spark.createDataFrame(rows[a : a + 40] + [("", rows[a][1]), (None, rows[a][1])], "device_id string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("device_id string, ts timestamp_ntz").parquet(source)
        upload_sessions.stream_upload_sessions(stream, out, str(tmp_path / "mark"), "0 minutes")
    assert {r.device_id for r in upload_sessions.late_uploads(spark, out).collect()} <= {r[0] for r in rows}
    upload_sessions.flush(spark, out)
    assert shown(upload_sessions.settled(spark, out)) == sessions_of(spark, rows)


REQUESTS = "request_id bigint, project_title string, industry string, duration_months int, expected_users bigint, tech_stack array<string>"


def test_pricing_keeps_what_it_rejects(spark, tmp_path):
    rows = [(i, "Title" if i % 5 else "x", "it", i % 70, 100, ["go"]) for i in range(140)]
    df, out = spark.createDataFrame(rows, REQUESTS), str(tmp_path / "priced")
    for number in (0, 1, 1, 0):  # both batches run twice
        jobs.price_batch(df.where(F.col("request_id") % 2 == number), number, out)
    priced, rejected = spark.read.parquet(f"{out}/priced"), spark.read.parquet(f"{out}/rejected")
    bad = {r.request_id: r.violations for r in validate_requests(df).where(F.size("violations") > 0).collect()}
    assert {r.request_id: r.violations for r in rejected.collect()} == bad
    assert sorted([r.request_id for r in priced.collect()] + [*bad]) == [*range(140)]
    counts = jobs.pricing_counts(spark, out).orderBy("batch_id").collect()
    assert [(r.requests, r.accepted + r.rejected) for r in counts] == [(70, 70), (70, 70)]
    assert sum(r.rejected for r in counts) == len(bad)


def test_pricing_stream_writes_both_sinks(spark, tmp_path):
    rows = [(i, "Title", "it", i % 70, 100, ["go"]) for i in range(70)]
    spark.createDataFrame(rows, REQUESTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    jobs.stream_pricing(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert spark.read.parquet(str(tmp_path / "out/priced")).count() == 60
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 10
