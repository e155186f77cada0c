import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quotewright.operators import pricing, reports, responses, team

GOOD = {
    "executive_summary": "**A** b", "technical_approach": 5,
    "timeline": [{"phase": "`Build`", "weeks": 4}, {"phase": "Ship", "weeks": 4, "description": "# go"}],
    "risk_assessment": [{"risk": "r", "impact": " HIGH", "probability": "low"}, {"risk": "s"}], "deliverables": ["*a*", "b"],
}


def parse(spark, raw, weeks=4):
    df = spark.createDataFrame([(1, raw, weeks)], "request_id bigint, raw string, expected_weeks int")
    return responses.parse_response(df).first()


@pytest.mark.parametrize("raw, found", [
    ('{"a": 1}', '{"a":1}'), ('```json\n{"a": 1}\n```', '{"a":1}'), ('see {"a": {"b": 2}} ok', '{"a":{"b":2}}'),
    ('[1]', '[1]'), ('{"a": 1} {"b": 2}', None), ('no json', None), ('', None), ('{"a": }', None), ('1, 2', None), ('"x"', '"x"'),
])
def test_extract(spark, raw, found):
    value = spark.createDataFrame([(raw,)], "raw string").select(F.to_json(responses.extract_json(F.col("raw")))).first()[0]
    assert value == found


def test_good_reply(spark):
    r = parse(spark, "Sure: " + json.dumps(GOOD))
    assert (r.status, r.executive_summary, r.technical_approach) == ("ok", "A b", "5")
    assert [(p.phase, p.weeks, p.description) for p in r.timeline] == [("Build", 2.0, None), ("Ship", 2.0, "go")]
    assert [(x.risk, x.impact, x.probability) for x in r.risk_assessment] == [("r", "High", "low"), ("s", "Medium", None)]
    assert r.deliverables == ["a", "b"] and r.timeline_text is None


def test_repeated_keys_keep_the_last_value(spark):
    r = parse(spark, '{"executive_summary": "a", "executive_summary": "b", "timeline": "x", "timeline": "y"}')
    assert (r.status, r.executive_summary, r.timeline_text) == ("ok", "b", "y")


def test_missing_and_odd_sections(spark):
    r = parse(spark, json.dumps({"timeline": "# soon", "deliverables": [], "risk_assessment": ["loose *text*", {"risk": "r"}]}))
    assert (r.status, r.executive_summary, r.timeline, r.timeline_text) == ("ok", "N/A", None, "soon")
    assert r.deliverables == [] and r.deliverables_text is None
    assert [(x.is_object, x.risk, x.impact) for x in r.risk_assessment] == [(False, "loose text", None), (True, "r", "Medium")]


@pytest.mark.parametrize("raw", ["## just *text*", "{}", "[]", "0", '""', "null", "false"])
def test_fallback(spark, raw):
    r = parse(spark, raw)
    assert r.status == "fallback_text"
    assert r.executive_summary == r.timeline_text == r.deliverables_text and r.timeline is None


@pytest.mark.parametrize("raw, kind", [("[1, 2]", "list"), ("7", "int"), ("1.5", "float"), ('"x"', "str"), ("true", "bool")])
def test_not_an_object(spark, raw, kind):
    r = parse(spark, raw)
    assert r.status == "error" and r.executive_summary.endswith(f"'{kind}' object has no attribute 'get'")


@pytest.mark.parametrize("weeks, kinds", [
    (["four"], "'int' and 'str'"), ([None], "'int' and 'NoneType'"), ([2, [1]], "'int' and 'list'"), ([2.5, {}], "'float' and 'dict'"),
])
def test_bad_weeks(spark, weeks, kinds):
    r = parse(spark, json.dumps({"timeline": [{"phase": "p", "weeks": w} for w in weeks]}))
    assert r.status == "error" and r.timeline_text.endswith(kinds)


def test_weeks_that_count_as_numbers(spark):
    raw = json.dumps({"timeline": [{"phase": "a"}, {"phase": "b", "weeks": True}, "note", {"phase": "c", "weeks": 7.0}]})
    assert [p.weeks for p in parse(spark, raw).timeline] == [1.0, 1.0, None, 2.0]
    assert [p.weeks for p in parse(spark, raw, 0).timeline] == [None, 1.0, None, 7.0]


def test_digest(spark):
    text = json.dumps({"z": "w" * 401, "a": [1, 2], "m": {"k": 1}, "b": None})
    digest = spark.createDataFrame([(text,)], "s string").select(responses.section_digest(F.col("s"))).first()[0]
    assert digest == '{\n  "z": "' + "w" * 400 + '...",\n  "a": [... 2 items ...],\n  "m": <...>,\n  "b": <...>\n}'


def test_read_sections(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, ""), (4, None)], "id bigint, sections_json string")
    assert [r.id for r in responses.read_sections(df).where("sections IS NOT NULL").collect()] == [1]


def plain_clean(text):
    text = re.sub(r"#{1,6}\s*", "", re.sub(r"\*{1,3}", "", text))
    text = re.sub(r"^\s*[-*+]\s+", "", text, flags=re.MULTILINE).replace("`", "")
    return re.sub(r"\s+", " ", re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", text)).strip()


def deep_clean(value):
    if isinstance(value, str):
        return plain_clean(value)
    if isinstance(value, dict):
        return {k: deep_clean(v) for k, v in value.items()}
    return [deep_clean(v) for v in value] if isinstance(value, list) else value


def random_json(rng, depth):
    bits = ["*a*", "# b", "\n- c", "`d`", "[t](u)", '"q"', "\\", '\\"', "é", " ", ":", '":', '",', "{", "]", " ", "\t", "\x07", "\\u0041", "/"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([text(), text(), 1, -2.5, 10**20, None, True])
    if kind < 0.7:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {text(): random_json(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_clean_value_of_any_shape(spark):
    """Random nested values, great depth, and a text of very many escapes."""
    rng = random.Random(1)
    values = [random_json(rng, 6) for _ in range(1_500)]
    values += [{"deep": json.loads("[" * 200 + '"*x*"' + "]" * 200)}, "*" * 5 + "y\\" * 20_000, "", {}, [[]]]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)], "i int, j string")
    found = df.select("i", F.to_json(responses.clean_value(F.try_parse_json("j"))).alias("o")).collect()
    assert all(json.loads(r.o) == deep_clean(values[r.i]) for r in found)
    missing = spark.createDataFrame([(None,)], "j string").select(responses.clean_value(F.try_parse_json("j"))).first()[0]
    assert missing is None


def test_other_keys_come_back(spark):
    reply = {"executive_summary": "a", "timeline": [{"phase": "*p*", "weeks": 8, "owner": {"name": "`Ann`"}}], "appendix": {"notes": ["# n", 3]}}
    df = spark.createDataFrame([(1, json.dumps(reply), 8)], "request_id bigint, raw string, expected_weeks int")
    kept = responses.parse_response(df).select(F.to_json("sections")).first()[0]
    assert json.loads(kept) == deep_clean(reply)


def test_only_wanted_sections_are_shown(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD), 8)], "request_id bigint, raw string, expected_weeks int")
    assert set(responses.parse_response(df, ("deliverables",)).columns) == {
        "request_id", "expected_weeks", "sections", "status", "deliverables", "deliverables_text"}


def test_a_text_of_marks_alone_is_no_blank_reply(spark):
    assert parse(spark, '"**"').status == "error"


def test_requests_without_a_reply_stay(spark):
    requests = spark.createDataFrame(
        [(1, "T", "it", 3, 50, ["go"]), (2, "U", "it", 3, 50, ["go"])],
        "request_id bigint, project_title string, industry string, duration_months int, expected_users bigint, tech_stack array<string>")
    replies = spark.createDataFrame([(1, json.dumps(GOOD), 12), (9, "x", 12)], "request_id bigint, raw string, expected_weeks int")
    full = reports.proposal_projection(team.estimate_team(pricing.estimate_cost(requests)), responses.parse_response(replies))
    rows = {r.request_id: (r.status, json.loads(r.stored)) for r in full.select("request_id", "status", reports.stored_sections(full).alias("stored")).collect()}
    assert {k: v[0] for k, v in rows.items()} == {1: "ok", 2: "missing"}
    stored = rows[1][1]
    assert stored["deliverables"] == ["a", "b"] and stored["estimated_cost"]["total_estimated_cost"] > 0
    assert stored["team_composition"][0]["role"] == "Project Manager" and stored["timeline"][0]["phase"] == "Build"


def test_body_rows(spark):
    raw = [(1, json.dumps({"timeline": "# soon", "risk_assessment": [], "deliverables": ["a"]}), 4), (2, "just text", 4)]
    parsed = responses.parse_response(spark.createDataFrame(raw, "request_id bigint, raw string, expected_weeks int"))
    rows = reports.body_rows(parsed, has_team=False).orderBy("request_id", "pos").collect()
    assert [(r.heading, r.body) for r in rows if r.request_id == 1] == [
        ("2. Executive Summary", "N/A"), ("3. Technical Approach", "N/A"), ("5. Project Timeline", "soon")]
    assert [r.heading for r in rows if r.request_id == 2][-1] == "7. Risk Assessment" and {r.body for r in rows if r.request_id == 2} == {"just text"}
