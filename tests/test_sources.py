import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotewright.operators import pricing
from quotewright.operators.history import device_rollup
from quotewright.sources import artifacts, cost_reports, proposals, requests, scratch
from quotewright.streaming import jobs

T0 = datetime(2024, 1, 1)


def test_read_requests(spark, tmp_path):
    lines = [
        json.dumps({"request_id": 1, "project_title": "p", "duration_months": "12", "expected_users": 5000, "tech_stack": ["go"], "other": 1}),
        json.dumps({"request_id": 2, "duration_months": "soon", "provider": "groq"}), "{broken",
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    rows = requests.read_requests(spark, str(tmp_path)).collect()
    by_id = {r.request_id: r for r in rows}
    assert (by_id[1].duration_months, by_id[1].expected_users, by_id[1].provider) == (12, 5000, "ollama")
    assert (by_id[2].duration_months, by_id[2].provider) == (None, "groq")
    assert by_id[None]["_corrupt"] == "{broken"


def test_read_reports_of_several_generations(spark, tmp_path):
    new = [("development_cost", "750000.0"), ("total_estimated_cost", "846000.0"), ("currency", "INR"),
           ("details", '"{""duration_months"": 5, ""infra_per_user"": 42.0}"')]
    old = [("development_cost", "120000.0"), ("details", '"{""duration_months"": 6, ""expected_users"": 12000, ""infra_per_user"": 0.2}"')]
    for name, rows in (("new.csv", new), ("old.csv", old)):
        (tmp_path / name).write_text("\r\n".join(["key,value", *[f"{k},{v}" for k, v in rows]]) + "\r\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "old.csv").write_text("key,value\r\ndevelopment_cost,1.0\r\n")  # the same name in another folder
    found = {r.report_id.split(f"{tmp_path.name}/")[1]: r for r in cost_reports.read_cost_reports(spark, [str(tmp_path), str(tmp_path / "more")]).collect()}
    assert found["more/old.csv"].development_cost == 1.0 and len(found) == 3
    assert (found["new.csv"].development_cost, found["new.csv"].currency, found["new.csv"].details.infra_per_user) == (750000.0, "INR", 42.0)
    assert (found["old.csv"].currency, found["old.csv"].total_estimated_cost, found["old.csv"].details.expected_users) == (None, None, 12000)


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 500, "healthcare"), (2, 6, 50, "zz")], "request_id bigint, duration_months int, expected_users bigint, industry string")
    estimates = pricing.estimate_cost(df)
    cost_reports.write_cost_reports_csv(estimates, str(tmp_path / "csv"))
    found = {r.report_id: r for r in cost_reports.read_cost_reports(spark, str(tmp_path / "csv"), True).collect()}
    assert found["1"].development_cost == 1012500.0 and found["1"].details.contingency_pct == 0.15
    assert found["2"].total_estimated_cost == 992100.0 and found["2"].industry_applied == "general"
    cost_reports.write_cost_reports_json(estimates, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    for batch in ("a", "b", "a"):  # the first batch runs twice
        cost_reports.write_cost_reports_json(estimates, str(tmp_path / "batches"), batch)
        cost_reports.write_cost_reports_csv(estimates, str(tmp_path / "csv-batches"), batch)
    assert spark.read.json(str(tmp_path / "batches")).groupBy("batch").count().orderBy("batch").collect() == [("a", 2), ("b", 2)]
    assert cost_reports.read_cost_reports(spark, str(tmp_path / "csv-batches"), True).count() == 2


def test_artifacts(spark, tmp_path):
    for name, size in (("proposal_1.pdf", 1280), ("proposal_2.pdf", 10), ("cost_report_1.json", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "proposal_3.pdf").write_bytes(b"x")
    listed = artifacts.list_artifacts(spark, str(tmp_path))
    rows = artifacts.artifact_order(listed).collect()
    assert [(r.filename, r.size_kb, r.download_url) for r in rows] == [
        ("proposal_2.pdf", 0.0, "/proposals/proposal_2.pdf"), ("proposal_1.pdf", 1.2, "/proposals/proposal_1.pdf")]
    assert artifacts.list_artifacts(spark, str(tmp_path), artifacts.REPORT_FILES).count() == 1
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_append_proposals(spark, tmp_path):
    schema = "id bigint, client_name string, provider string, model string, sections_json string, created_at timestamp_ntz"
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, None, "", None, "{}", T0)], schema)
    second = spark.createDataFrame([(2, "c", "groq", "m", '{"a": 1}', T0 + timedelta(days=40)), (3, "c", "groq", "m", None, T0)], schema)
    for batch, rows in (("a", first), ("b", second), ("a", first), ("b", second)):  # every batch runs twice
        proposals.append_proposals(rows, path, batch)
    assert proposals.read_proposals(spark, path).groupBy("batch").count().orderBy("batch").collect() == [("a", 1), ("b", 2)]
    rows = [tuple(r) for r in proposals.read_proposals(spark, path).orderBy("id").select("client_name", "provider", "model", "sections_json", "created_month").collect()]
    assert [r[:4] for r in rows] == [("", "ollama", "auto", None), ("c", "groq", "m", '{"a": 1}'), ("c", "groq", "m", None)]


def test_shared_folder_comes_from_the_session(spark):
    assert scratch.fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


EVENTS = "event_id bigint, ts timestamp_ntz, device_id string, action string, user_name string"


def batches_of(rows, seed):
    """The rows in random order, cut at random places."""
    rng = random.Random(seed)
    mixed = rng.sample(rows, len(rows))
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 3)), len(rows)]
    return [mixed[a:b] for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("seed", [1, 2])
def test_device_stream_in_any_order(spark, tmp_path, seed):
    """Whatever the order and the batches, the stream gives the table of one batch job."""
    rows = [(i, T0 + timedelta(seconds=i * 97), f"d{i % 7}", ["record_proposal", "register", "record_proposal"][i % 3], ["", " n ", "m"][i % 4 % 3]) for i in range(90)]
    table, state, source = (str(tmp_path / n) for n in ("table", "state", "in"))
    for batch in batches_of(rows, seed):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_device_state(spark.readStream.schema(EVENTS).parquet(source), table, state)
    expected = device_rollup(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, jobs.device_state(spark, table).collect())) == sorted(map(tuple, expected.collect()))


def test_clean_up(spark, tmp_path):
    folder = str(tmp_path / "shared")
    spark.range(1).write.parquet(scratch.fresh_path(spark, "x", folder))
    assert scratch.clean_up(spark, folder) and not scratch.clean_up(spark, folder)
