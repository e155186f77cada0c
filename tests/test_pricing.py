import pytest
from pyspark.sql import functions as F

from quotewright import seeds
from quotewright.functions.industry import resolve_for_prompts, resolve_industry
from quotewright.operators import pricing, reports, team

SCHEMA = "request_id bigint, duration_months int, expected_users bigint, tech_stack array<string>, industry string"


def requests(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("raw, cost, prompt", [
    ("", "healthcare", "healthcare"), ("it", "healthcare", "healthcare"), ("Development", "automotive", None),
    ("Retail Analytics", "ai_ml", "retail"), ("retail banking", "finance", "finance"),
    (" AUTOMOBILE ", "automotive", "automotive"), ("Technology", "saas", "saas"),
    ("Infrastructure", "construction", "cloud"), ("Restaurant Tech", "hospitality", "food"),
    ("Insurance Tech", None, "insurance"), ("maritime", None, None), ("BUILDING", None, None),
    ("FURNITURE", None, None), ("MACHINERY", None, None), ("HOUSEHOLD", None, None),
    ("ai_ml", "ai_ml", "ai_ml"), ("real estate", "real estate", "real estate"), ("x\ny", None, None),
])
def test_resolver(spark, raw, cost, prompt):
    row = spark.createDataFrame([(raw,)], "industry string").select(
        resolve_industry(F.col("industry")), resolve_for_prompts(F.col("industry"))).first()
    assert row[0] == cost
    if raw != "Development":
        assert row[1] == prompt


def test_resolver_by_hand(spark):
    """The expression against the rule written as plain loops, on many short and long keys."""
    words = {text for entry in (*seeds.COST_ALIASES, *seeds.KB_ALIASES) for text in entry} | set(seeds.INDUSTRIES)
    keys = sorted(words | {w[i:j] for w in words for i in (0, 1, 3) for j in (2, 4, 6)} | {f"my {w} firm" for w in words} | {"zz", "q"})

    def by_hand(raw, aliases):
        key = raw.strip().lower()
        if key in seeds.INDUSTRIES:
            return key
        exact = dict(aliases).get(key)
        return exact or next((owner for alias, owner in aliases if alias in key or key in alias), None)

    df = spark.createDataFrame([(k,) for k in keys], "industry string")
    found = df.select("industry", resolve_industry(F.col("industry")), resolve_for_prompts(F.col("industry"))).collect()
    for key, cost, prompt in found:
        assert cost == by_hand(key, seeds.COST_ALIASES), key
        assert prompt == by_hand(key, seeds.KB_ALIASES), key


def test_short_keys_can_be_refused(spark):
    df = spark.createDataFrame([("it",), ("ai",), ("hospital",)], "industry string")
    found = [r[0] for r in df.select(resolve_industry(F.col("industry"), min_key_len=3)).collect()]
    assert found == [None, "ai_ml", "healthcare"]


@pytest.mark.parametrize("months, users, expected", [
    (5, 500, (750000, 21000, 75000, 846000, 169200)),
    (6, 50, (900000, 2100, 90000, 992100, 165350)),
    (6, 500, (900000, 21000, 90000, 1011000, 168500)),
])
def test_known_reports(spark, months, users, expected):
    row = pricing.estimate_cost(requests(spark, (months, users, ["go"], "maritime"))).first()
    parts = ("development_cost", "infrastructure_cost", "contingency", "total_estimated_cost", "monthly_average")
    assert tuple(row[p] for p in parts) == tuple(100 * v for v in expected)
    assert (row.industry_applied, row.currency) == ("general", "INR")


def test_tiers_apply_to_the_whole_volume(spark):
    rows = pricing.estimate_cost(requests(spark, *[(1, n, ["go"], "maritime") for n in (1000, 1001, 10000, 10001)])).orderBy("request_id").collect()
    assert [r.infrastructure_cost // 100 for r in rows] == [42000, 29029, 290000, 170017]


def test_old_generation_prices(spark):
    """Older reports: 20000 a month and 0.2 per user; no months and no users give zero."""
    df = requests(spark, (6, 12000, ["go"], "maritime"), (0, 0, ["go"], "maritime"))
    rows = pricing.estimate_cost(df, rate_paise=2_000_000, tiers=(), top_tier_paise=20).orderBy("request_id").collect()
    assert [rows[0][p] / 100 for p in pricing.COST_PARTS] == [120000, 2400, 12000, 0, 134400, 22400]
    assert [rows[1][p] for p in pricing.COST_PARTS] == [0] * 6


def test_discount_and_components_add_up(spark):
    df = requests(spark, *[(m, u, ["go"], i) for m in (1, 7, 60) for u in (10, 9999, 100_000_000) for i in ("finance", "hr", "x")])
    for row in pricing.estimate_cost(df, discount_bps=1250).collect():
        subtotal = row.development_cost + row.infrastructure_cost + row.contingency
        assert abs(row.discount - subtotal * 0.125) <= 1
        assert abs(row.total_estimated_cost - (subtotal - row.discount)) <= 2
        months = row.duration_months
        assert abs(row.monthly_average * months - row.total_estimated_cost) <= months


def test_rupees_and_details(spark):
    row = pricing.in_rupees(pricing.estimate_cost(requests(spark, (5, 500, ["go"], "healthcare")))).select(
        "development_cost", pricing.details_json(F.col("details")).alias("details")).first()
    assert str(row.development_cost) == "1012500.00"
    assert row.details == (
        '{"duration_months": 5, "expected_users": 500, "infra_per_user": 52.5, "dev_rate_per_month": 202500.0, '
        '"contingency_pct": 0.15, "discount_pct": 0.0, "industry_dev_multiplier": 1.35, "industry_infra_multiplier": 1.25}')


def test_team_cliffs(spark):
    df = requests(spark, (3, 10, ["Go"], "x"), (4, 10, [" react"], "x"), (5, 10000, ["REACT"], "finance"), (6, 50000, [], "x"))
    teams = {r.request_id: {m.role: m.headcount for m in r.team} for r in team.estimate_team(df).collect()}
    base = {"Project Manager": 1, "Backend Developer": 1, "Frontend Developer": 1, "QA Engineer": 1}
    assert teams[0] == base
    # Stack items are compared without trimming.
    assert teams[1] == {**base, "Backend Developer": 2, "DevOps Engineer": 1, "Business Analyst": 1}
    assert teams[2] == {
        "Project Manager": 1, "Backend Developer": 2, "Frontend Developer": 2, "QA Engineer": 2, "DevOps Engineer": 1,
        "UI/UX Designer": 1, "Database Administrator": 1, "Business Analyst": 1, "Security / Compliance Analyst": 1}
    assert "Solution Architect" in teams[3]
    assert list(teams[2])[-1] == "Security / Compliance Analyst"


def test_headcount_ranges(spark):
    rows = spark.createDataFrame([("Dev", "2-3"), ("Dev", "1"), ("Ops", "0"), (None, None)], "role string, headcount string")
    assert {(r.role, r.teams, r.heads) for r in team.team_headcount(rows).collect()} == {("Dev", 2, 3), ("Unknown", 1, 1)}


def test_shares(spark):
    df = pricing.estimate_cost(requests(spark, (5, 500, ["go"], "x"), (7, 20000, ["go"], "food")), discount_bps=500)
    for row in reports.cost_shares(df).groupBy("request_id").agg(F.sum("share_permille").alias("s"), F.count("*").alias("n")).collect():
        assert abs(row.s - 1000) <= 2 and row.n == 4
    labels = [r.label for r in reports.cost_table_rows(df).where("request_id = 1").orderBy("pos").collect()]
    assert labels == ["Development Cost", "Infrastructure Cost", "Contingency (10%)", "Discount Applied", "TOTAL ESTIMATED COST", "Monthly average"]


def test_pricing_does_not_shuffle(spark):
    plan = pricing.estimate_cost(requests(spark, (5, 500, ["go"], "x")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_seed_sizes():
    assert len(seeds.MULTIPLIERS) == len(seeds.KNOWLEDGE_BASE) == 31
    assert len(seeds.COST_ALIASES) == 89 and len(seeds.KB_ALIASES) == 119 and len(seeds.EXTRA_ROLES) == 13
    assert {owner for _, owner in (*seeds.COST_ALIASES, *seeds.KB_ALIASES)} <= set(seeds.INDUSTRIES)


def test_contingency_and_discount_in_basis_points(spark):
    """12.5 % where the industry has less, its own rate where it has more; a discount shows as a row and in the JSON."""
    df = spark.createDataFrame([(1, 5, 500, "zz"), (2, 5, 500, "healthcare")], "request_id bigint, duration_months int, expected_users bigint, industry string")
    found = {r.request_id: r for r in pricing.estimate_cost(df, contingency_bps=1250, discount_bps=333).collect()}
    assert found[1].contingency == 75_000_000 * 125 // 1000 and found[2].contingency == 101_250_000 * 15 // 100
    subtotal = found[1].development_cost + found[1].infrastructure_cost + found[1].contingency
    assert found[1].discount == (subtotal * 333 + 5000) // 10_000
    assert found[1].total_estimated_cost == (subtotal * 9_667 + 5000) // 10_000
    estimates = pricing.estimate_cost(df, contingency_bps=1250, discount_bps=333)
    labels = [r.label for r in reports.cost_table_rows(estimates).where("request_id = 1").orderBy("pos").collect()]
    assert labels[2:5] == ["Contingency (12.5%)", "Discount Applied", "TOTAL ESTIMATED COST"]
    shares = reports.cost_shares(estimates).where("request_id = 1").orderBy("pos").collect()
    assert shares[-1].component == "Discount" and abs(sum(r.share_permille for r in shares) - 1000) <= 2
    text = {r.key: r.value for r in reports.cost_report_kv(estimates).where("request_id = 1").collect()}["details"]
    assert '"contingency_pct": 0.125, "discount_pct": 0.0333' in text
