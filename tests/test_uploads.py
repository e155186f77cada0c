"""Upload scans over many segments, and prompts with the documents that a request sees."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quotewright.functions.text import content_tag
from quotewright.operators import prompts, segments, uploads
from test_records import T0, UPLOADS, sessions_by_hand, upload_rows, wrapped

ASKS = "request_id bigint, device_id string, ts timestamp_ntz"


@pytest.fixture(scope="module")
def crowded(spark):
    """One device with a third of the rows, one with hundreds of files in one second, ties in time."""
    rng = random.Random(4)
    rows = upload_rows(rng, 500)
    rows += [("burst", 10_000 + i, i % 3, f"b{i}.pdf", 1, "u" * (i % 5 + 1), T0 + timedelta(microseconds=i // 40)) for i in range(600)]
    rng.shuffle(rows)
    asks = [(i, rng.choice(["hot", "hot", "burst", "d1", "d3", "nobody"]), T0 + timedelta(seconds=rng.randint(0, 60_000))) for i in range(400)]
    asks += [(1_000 + i, r[0], r[6]) for i, r in enumerate(rows[:80])] + [(5_000, "", T0), (5_001, None, T0)]
    df = spark.createDataFrame(rows, UPLOADS)
    tags = {r[0]: r[1] for r in df.select("device_id", content_tag(F.col("device_id"), "s")).distinct().collect()}
    return rows, df, asks, spark.createDataFrame(asks, ASKS), tags


def seen_by_hand(rows, asks):
    sessions = sessions_by_hand(rows)
    for request_id, device, ts in asks:
        docs = next((v for (d, start), v in sessions.items() if d == device and start <= ts <= v[-1][6] + timedelta(seconds=600)), [])
        yield request_id, [r for r in docs if r[6] <= ts]


@pytest.mark.parametrize("count", [1, 7, 40])
def test_scan_in_segments(crowded, count):
    rows, df, asks, requests, tags = crowded
    by_hand = sessions_by_hand(rows)
    found = {(r.device_id, r.session_start): (r.session_end, r.files, r.chars) for r in uploads.upload_sessions(df, count).collect()}
    assert found == {k: (v[-1][6] + timedelta(seconds=600), len(v), sum(len(r[5]) for r in v)) for k, v in by_hand.items()}
    places = Counter((r.device_id, r.session_start, r.position, r.part) for r in uploads.upload_context(df, "s", count).collect())
    order = {k: sorted(v, key=lambda r: (r[6], r[1], r[2])) for k, v in by_hand.items()}
    assert places == Counter((*k, i + 1, wrapped(tags, r)) for k, v in order.items() for i, r in enumerate(v))
    state = {r.request_id: r for r in uploads.request_upload_state(requests, df, count).collect()}
    assert len(state) == len(asks)
    for request_id, docs in seen_by_hand(rows, asks):
        assert (state[request_id].docs_available, state[request_id].context_chars) == (
            len(docs), len("\n\n".join(wrapped(tags, r) for r in docs)))


def test_a_long_device_is_spread_over_segments(spark, tmp_path):
    """40 000 uploads of one device, half of them in one second: no segment holds much more than its share."""
    rows = spark.range(40_000).select(
        F.lit("long").alias("device_id"), F.when(F.col("id") < 20_000, F.lit(0)).otherwise(F.col("id") * 1_000_000).alias("us"), F.col("id").alias("row"))
    dealt = segments.in_segments(rows, "device_id", ["us", "row"], "long", 20)
    sizes = [r["count"] for r in dealt.groupBy(segments.SEGMENT).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 40_000 / 20
    ends = dealt.groupBy(segments.SEGMENT).agg(F.min("row").alias("low"), F.max("row").alias("high")).orderBy(segments.SEGMENT).collect()
    assert all(a.high < b.low for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize(("limit", "count"), [(10**6, None), (10**6, 9), (2_000, 9), (10, 3)])
def test_reference_text(crowded, limit, count):
    rows, df, asks, requests, tags = crowded
    found = {r.request_id: r.reference_text for r in uploads.with_reference_text(requests, df, "s", limit, count).collect()}
    assert len(found) == len(asks)
    for request_id, docs in seen_by_hand(rows, asks):
        docs = sorted(docs, key=lambda r: (r[6], r[1], r[2]))
        parts, used = [], 0
        for d in docs:
            used += len(wrapped(tags, d)) + (2 if parts else 0)
            if used > limit:
                break
            parts.append(wrapped(tags, d))
        left = len(docs) - len(parts)
        assert found[request_id] == "\n\n".join(parts + ([f"[{left} more documents left out]"] if left else []))


def test_each_text_is_read_once_and_never_shuffled_per_request(crowded):
    _, df, _, requests, _ = crowded
    plan = uploads.with_reference_text(requests, df, "s")._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "Relation" in line and "text#" in line]
    assert len(texts) == 1, plan
    joined = plan.index("Join")  # the join with the sessions' texts is the last one: nothing is grouped or joined after it
    assert "Aggregate" not in plan[:joined]


def test_prompts_hold_documents_and_user(spark, crowded):
    rows, df, asks, requests, tags = crowded
    full = requests.withColumns({
        "project_title": F.lit("T"), "industry": F.lit("it"), "duration_months": F.lit(3), "expected_users": F.lit(50).cast("bigint"),
        "tech_stack": F.array(F.lit("go")), "client_name": F.lit("C"), "user_name": F.lit("Ada"), "custom_notes": F.lit(None).cast("string"),
        "compliance_requirements": F.lit(None).cast("array<string>"),
        **{c: F.lit(None).cast("string") for c in ("budget_range", "project_priority", "deployment_model", "target_audience", "competitors")}})
    made = prompts.render_prompts(uploads.with_reference_text(full, df, "s"), F.lit("2024-01-02").cast("timestamp"), "s")
    found = {r.request_id: r.prompt for r in made.collect()}
    for request_id, docs in seen_by_hand(rows, asks):
        assert ", prepared by Ada" in found[request_id]
        assert ("Reference documents:\n" in found[request_id]) == bool(docs)
        assert all(wrapped(tags, d) in found[request_id] for d in docs)


def test_a_session_of_very_many_documents(spark):
    """100 000 documents in one session, asked for by many requests: only those within the limit are put together."""
    files = spark.range(100_000).select(
        F.lit("d").alias("device_id"), F.col("id").alias("upload_id"), F.lit(0).alias("pos"), F.lit("f.pdf").alias("filename"),
        F.lit(1).cast("bigint").alias("size_bytes"), F.repeat(F.lit("w"), 100).alias("text"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") / 50).cast("int"))).alias("ts"))
    asks = spark.range(500).select(F.col("id").alias("request_id"), F.lit("d").alias("device_id"), F.lit("2024-01-01 00:33:00").cast("timestamp_ntz").alias("ts"))
    found = uploads.with_reference_text(asks, files, "s", 50_000, 16).select("request_id", F.length("reference_text").alias("n"), F.right("reference_text", F.lit(40)).alias("tail"))
    rows = found.collect()
    assert len(rows) == 500 and len({(r.n, r.tail) for r in rows}) == 1
    assert rows[0].n < 50_100 and rows[0].tail.endswith("more documents left out]")
