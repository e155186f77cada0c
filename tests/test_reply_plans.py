"""How replies are planned: what is compiled, what is left out, what is sent where."""

import pytest

from quotewright.operators import pricing, reports, responses, risks, team

REPLY = "request_id bigint, raw string, expected_weeks int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def replies(spark, *raw):
    return spark.createDataFrame([(i, r, 4) for i, r in enumerate(raw)], REPLY)


def test_replies_are_merged_not_broadcast(spark):
    requests = spark.createDataFrame(
        [(0, "T", "it", 3, 50, ["go"])],
        "request_id bigint, project_title string, industry string, duration_months int, expected_users bigint, tech_stack array<string>")
    parsed = responses.parse_response(replies(spark, "x"))
    full = reports.proposal_projection(team.estimate_team(pricing.estimate_cost(requests)), parsed)
    physical = full.select("request_id", "status")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [request_id" in physical


def test_generators_of_replies_only_unpack(spark):
    """A generator with a lambda in it is interpreted as a whole."""
    generators = [line for line in plan(responses.parse_response(replies(spark, "x"))).splitlines() if "Generate inline" in line]
    assert generators and not any("lambda" in line or "try_variant_get" in line for line in generators)


@pytest.mark.parametrize("section, other", [("timeline", "$.deliverables"), ("deliverables", "$.risk_assessment")])
def test_sections_that_nobody_wants_are_not_typed(spark, section, other):
    df = replies(spark, "x")
    assert other not in plan(responses.parse_response(df, (section,)).select("request_id", section))
    assert other not in plan(responses.parse_response(df).select("request_id", section))


@pytest.mark.parametrize("raw, status", [
    ("{ \n }", "fallback_text"), ("[\t]", "fallback_text"), ("x { } y", "fallback_text"), ("[[]]", "error"), ("0.0", "fallback_text"), ("1", "error"),
    ("false", "fallback_text"), ("null", "fallback_text"), ('""', "fallback_text"), ("{}\u2003", "fallback_text"), ("\u2003```json{} ```", "fallback_text"),
    ('{"a": null}', "ok"), ("", "fallback_text"), (None, "fallback_text"), ("```\n[1] {\"b\": 2} ```", "ok")])
def test_blank_replies(spark, raw, status):
    assert responses.parse_response(replies(spark, raw)).first().status == status


def test_levels(spark):
    given = ["HIGH", " low\u00a0", "hıgh", "high er", "Medium", None, "\x1fhigh\n", "ſow"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, impact string")
    found = [r.impact for r in risks.normalise_risk(df).orderBy("i").collect()]
    assert found == ["High", "Low", "Medium", "Medium", "Medium", "Medium", "High", "Medium"]
