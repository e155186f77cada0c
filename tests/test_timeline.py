import random

import pytest
from pyspark.sql import functions as F

from quotewright.operators import grouped, risks, timeline

SCHEMA = "request_id bigint, seq int, phase string, weeks int, is_object boolean, expected_weeks int"


def table(spark, *requests):
    """Each request is (expected, [weeks or None for an entry that is not an object])."""
    rows = [
        (i, n, f"P{n}", w, w is not None, expected)
        for i, (expected, weeks) in enumerate(requests) for n, w in enumerate(weeks)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(expected, weeks):
    """The rule as a plain loop over one timeline."""
    total = sum(w for w in weeks if w is not None)
    if total in (0, expected):
        return list(weeks)
    out, used = [], 0
    for i, w in enumerate(weeks):
        if w is None:
            out.append(None)
        elif i == len(weeks) - 1:
            out.append(expected - used)
        else:
            out.append(max(1, round(w * (expected / total))))
            used += out[-1]
    return out


def rescaled(df, **kw):
    out = {}
    for r in timeline.timeline_rescale(df, **kw).orderBy("request_id", "seq").collect():
        out.setdefault(r.request_id, []).append(r)
    return out


def test_known_cases(spark):
    cases = [(8, [3, 3, 4]), (4, [4, 1, 1, 1, 1, 20]), (10, [5, 5]), (10, [0, 0]), (8, [3, 3, None]), (6, [None, 3])]
    found = rescaled(table(spark, *cases))
    assert [[r.new_weeks for r in found[i]] for i in range(6)] == [
        [2, 2, 4], [1, 1, 1, 1, 1, -1], [5, 5], [0, 0], [4, 4, None], [None, 6]]
    assert [r.is_infeasible for r in found[1]] == [False] * 5 + [True]


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_any_timeline_also_when_groups_are_split(spark, block_rows):
    rng = random.Random(7)
    cases = [
        (4 * rng.randint(1, 60), [rng.choice([None, 0, 1, 2, 5, 9, 40]) for _ in range(rng.randint(1, 25))])
        for _ in range(150)
    ]
    found = rescaled(table(spark, *cases), block_rows=block_rows)
    for i, (expected, weeks) in enumerate(cases):
        new = [r.new_weeks for r in found[i]]
        assert new == by_hand(expected, weeks), (expected, weeks)
        if weeks[-1] is not None and sum(w or 0 for w in weeks) > 0:
            assert sum(w or 0 for w in new) == expected


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_gantt(spark, block_rows):
    rng = random.Random(3)
    cases = [(4, [rng.randint(0, 9) for _ in range(rng.randint(1, 30))]) for _ in range(60)] + [(4, [0, 0])]
    df = timeline.gantt_offsets(table(spark, *cases), block_rows=block_rows)
    found = {(r.request_id, r.seq): (r.start_week, r.end_week) for r in df.collect()}
    expected = {}
    for i, (_, weeks) in enumerate(cases):
        if any(weeks):
            expected.update({(i, n): (sum(weeks[:n]), sum(weeks[:n + 1])) for n in range(len(weeks))})
    assert found == expected


def test_a_heavy_group_is_spread(spark):
    """One request holds a third of the rows; no window sees more than a block of it."""
    df = table(spark, (8, list(range(1000))), *[(8, [1, 2, 3, 4]) for _ in range(500)])
    blocks = grouped.in_blocks(df, "seq", 100).groupBy("request_id", "_block").count()
    assert blocks.agg(F.max("count")).first()[0] <= 100
    found = rescaled(df, block_rows=100)
    assert [r.new_weeks for r in found[0]] == by_hand(8, list(range(1000)))


def test_unnamed_phases_count_from_one(spark):
    rows = [(1, seq, None, 2, True, 8) for seq in (0, 1)] + [(2, 1, None, 2, True, 8)]
    df = spark.createDataFrame(rows, "request_id int, seq int, phase string, weeks int, is_object boolean, expected_weeks int")
    found = timeline.gantt_offsets(df).orderBy("request_id", "seq").collect()
    assert [r.phase for r in found] == ["Phase 1", "Phase 2", "Phase 1"]


def test_array_form_agrees_with_rows(spark):
    rng = random.Random(11)
    cases = [(4 * rng.randint(1, 30), [rng.choice([None, 0, 1, 3, 8]) for _ in range(rng.randint(1, 8))]) for _ in range(80)]
    rows = [(i, float(e), [(w is not None, "p", None if w is None else float(w), "d") for w in ws]) for i, (e, ws) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, e double, t array<struct<is_object:boolean,phase:string,weeks:double,description:string>>")
    for r in df.select("i", timeline.rescale_array(F.col("t"), F.col("e")).alias("t")).collect():
        assert [p.weeks for p in r.t] == by_hand(*cases[r.i])


def test_risks(spark):
    df = spark.createDataFrame(
        [(" HIGH ", None, "x" * 30), ("severe", "Low", "r"), (None, "Unknown", None)], "impact string, probability string, risk string")
    points = risks.risk_points(risks.normalise_risk(df)).orderBy("impact", F.desc("x")).collect()
    assert sorted((p.impact, p.x, p.y, p.colour, p.label) for p in points) == [
        ("High", 2, 3, "#ef4444", "x" * 28 + "..."), ("Medium", 1, 2, "#f59e0b", "r"), ("Medium", 2, 2, "#f59e0b", "")]
