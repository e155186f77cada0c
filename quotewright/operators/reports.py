"""Datasets behind the proposal report: tables, shares and key-value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.money import amount_text, hundredths_text, percent_text, round_div
from quotewright.functions.dates import long_date
from quotewright.functions.text import tech_csv, thousands
from quotewright.operators.pricing import COST_PARTS, details_json

# Component labels in chart order, table labels, currency signs.
SHARE_LABELS = (
    ("development_cost", "Development"), ("infrastructure_cost", "Infrastructure"),
    ("contingency", "Contingency"), ("discount", "Discount"),
)
CURRENCY_SIGN = "Rs."
OTHER_SIGN = "$"
TOP_STACK = 4


def _components() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(label).alias("component"), F.col(name).alias("amount"))
        for i, (name, label) in enumerate(SHARE_LABELS)
    ])


def _share(amount: Column, whole: Column) -> Column:
    """Tenths of a percent, so that the value is exact."""
    return round_div(amount * 1000, whole)


def cost_shares(estimates: DataFrame) -> DataFrame:
    """Share of each positive component of each estimate. No shuffle."""
    positive = F.filter(_components(), lambda c: c["amount"] > 0)
    return estimates.select(
        "request_id", positive.alias("parts"),
        F.aggregate(positive, F.lit(0).cast("bigint"), lambda acc, c: acc + c["amount"]).alias("whole"),
    ).select("request_id", "whole", F.inline("parts")).select(
        "request_id", "pos", "component", "amount",
        _share(F.col("amount"), F.col("whole")).alias("share_permille"),
    )


def portfolio_shares(estimates: DataFrame) -> DataFrame:
    """Share of each component in all estimates together: one aggregate to one row."""
    totals = estimates.agg(*[F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name, _ in SHARE_LABELS])
    positive = F.filter(_components(), lambda c: c["amount"] > 0)
    whole = F.aggregate(positive, F.lit(0).cast("decimal(38,0)"), lambda acc, c: (acc + c["amount"]).cast("decimal(38,0)"))
    return totals.select(whole.alias("whole"), F.inline(positive)).select(
        "pos", "component", "amount",
        F.round(F.col("amount") * 1000 / F.col("whole"), 0).cast("bigint").alias("share_permille"),
    )


def cost_table_rows(estimates: DataFrame) -> DataFrame:
    """Rows of the cost table with formatted amounts and the contingency rate that applied."""
    sign = F.when(F.col("currency") == "INR", CURRENCY_SIGN).otherwise(OTHER_SIGN)

    def row(pos: int, label: str | Column, amount: str) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(
            F.lit(pos).alias("pos"), label.alias("label"),
            F.concat(sign, F.lit(" "), amount_text(F.col(amount))).alias("amount"),
        )

    contingency = F.concat(
        F.lit("Contingency ("), percent_text(F.col("details.contingency_bps")), F.lit("%)")
    )
    rows = F.array(
        row(1, "Development Cost", "development_cost"),
        row(2, "Infrastructure Cost", "infrastructure_cost"),
        row(3, contingency, "contingency"),
        F.when(F.col("discount") > 0, row(4, "Discount Applied", "discount")),
        row(5, "TOTAL ESTIMATED COST", "total_estimated_cost"),
        F.when(F.col("monthly_average") > 0, row(6, "Monthly average", "monthly_average")),
    )
    return estimates.select("request_id", F.inline(F.array_compact(rows)))


def cost_report_kv(estimates: DataFrame) -> DataFrame:
    """Each estimate as ordered ``key, value`` rows; ``details`` is JSON text."""
    pairs = [(name, hundredths_text(F.col(name))) for name in COST_PARTS]
    pairs += [(name, F.col(name)) for name in ("currency", "industry_applied", "cost_adjustment_reason")]
    pairs.append(("details", details_json(F.col("details"))))
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return estimates.select("request_id", F.posexplode(rows).alias("pos", "kv")).select(
        "request_id", "pos", "kv.*"
    )


def overview_rows(requests: DataFrame) -> DataFrame:
    """The six parameter rows at the top of a report."""
    values = (
        ("Project Title", F.col("project_title")),
        ("Client", F.coalesce(F.nullif("client_name", F.lit("")), F.lit("-"))),
        ("Industry", F.col("industry")),
        ("Duration", F.concat(F.col("duration_months").cast("string"), F.lit(" months"))),
        ("Expected Users", thousands(F.col("expected_users"))),
        ("Tech Stack", tech_csv(F.col("tech_stack"))),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("parameter"), v.alias("details")) for k, v in values])
    return requests.select("request_id", F.posexplode(rows).alias("pos", "r")).select("request_id", "pos", "r.*")


def tech_top4(items: Column) -> Column:
    return F.concat_ws(", ", F.slice(items, 1, TOP_STACK))


def _number_text(c: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def timeline_rows(sections: DataFrame) -> DataFrame:
    return sections.select("request_id", F.posexplode("timeline").alias("pos", "p")).select(
        "request_id", "pos", F.coalesce("p.phase", F.lit("")).alias("phase"),
        F.concat(F.coalesce(_number_text(F.col("p.weeks")), F.lit("")), F.lit("w")).alias("duration"),
        F.coalesce("p.description", F.lit("")).alias("description"),
    )


def team_table_rows(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "pos", "role", F.col("headcount").cast("string").alias("headcount"), "allocation")


def risk_rows(sections: DataFrame, has_team: bool) -> DataFrame:
    """Risk table rows; the section number depends on whether a team is shown."""
    number = F.lit(8 if has_team else 7)
    return sections.select(
        "request_id", number.alias("section_no"), F.posexplode("risk_assessment").alias("pos", "r")
    ).select(
        "request_id", "section_no", "pos", F.coalesce("r.risk", F.lit("")).alias("risk"), "r.impact",
        F.coalesce("r.probability", F.lit("-")).alias("probability"),
        F.coalesce("r.mitigation", F.lit("")).alias("mitigation"),
    )


def deliverable_rows(sections: DataFrame) -> DataFrame:
    return sections.select("request_id", F.posexplode("deliverables").alias("pos", "deliverable")).select(
        "request_id", F.concat((F.col("pos") + 1).cast("string"), F.lit(".")).alias("no"), "deliverable"
    )


def proposal_projection(planned: DataFrame, sections: DataFrame) -> DataFrame:
    """The full response per request: cost, team and sections in one join.

    ``planned`` are priced requests with their team, which are row-local. A request without a
    reply stays, with ``status`` missing; a reply without a request is left out. Replies grow with
    the requests, so they are sorted and merged: the size of their files, or of the few columns
    that are read of them, would have the planner send them all through the driver.
    """
    cost = F.struct(*COST_PARTS, "currency", "industry_applied", "cost_adjustment_reason", "details")
    joined = planned.select("request_id", cost.alias("estimated_cost"), "team").join(sections.hint("merge"), "request_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("missing")))


def _either(name: str) -> Column:
    """A list section as it is stored: the list, or the text where it is none."""
    return F.when(F.col(name).isNotNull(), F.to_variant_object(F.col(name))).otherwise(F.col(f"{name}_text").cast("variant"))


def stored_sections(full: DataFrame) -> Column:
    """Sections, cost and team of a row of ``proposal_projection`` as one JSON text, as the history stores them."""
    return F.to_json(F.struct(
        "executive_summary", "technical_approach", *[_either(name).alias(name) for name in ("timeline", "risk_assessment", "deliverables")],
        "estimated_cost", F.col("team").alias("team_composition")))


def cover_rows(requests: DataFrame, as_of: Column) -> DataFrame:
    """The labelled lines of the cover page; without a client there is no line for it."""
    values = (
        ("Prepared for", F.nullif("client_name", F.lit(""))),
        ("Industry", F.coalesce("industry", F.lit(""))),
        ("Duration", F.concat(F.coalesce(F.col("duration_months").cast("string"), F.lit("")), F.lit(" months"))),
        ("Users", F.concat(thousands(F.coalesce("expected_users", F.lit(0))), F.lit("+"))),
        ("Tech Stack", tech_top4(F.col("tech_stack"))),
        ("Date", long_date(as_of)),
    )
    rows = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(i).alias("pos"), F.lit(k).alias("label"), v.alias("value"))) for i, (k, v) in enumerate(values)])
    return requests.select("request_id", "project_title", F.inline(F.array_compact(rows)))


# Headings of the report in their order, with the column of their body text.
BODY_SECTIONS = (
    ("2. Executive Summary", "executive_summary"), ("3. Technical Approach", "technical_approach"),
    ("4. Key Deliverables", "deliverables_text"), ("5. Project Timeline", "timeline_text"),
)
RISK_HEADING = "Risk Assessment"


def body_rows(sections: DataFrame, has_team: bool) -> DataFrame:
    """Heading and running text of each section that is text, and not a table, in report order."""
    named = [*BODY_SECTIONS, (f"{8 if has_team else 7}. {RISK_HEADING}", "risk_assessment_text")]
    rows = F.array(*[
        F.when(F.col(name).isNotNull(), F.struct(F.lit(i).alias("pos"), F.lit(heading).alias("heading"), F.col(name).alias("body")))
        for i, (heading, name) in enumerate(named)])
    return sections.select("request_id", F.inline(F.array_compact(rows)))
