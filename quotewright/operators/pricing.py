"""Cost estimates in whole paise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright import seeds
from quotewright.functions.binding import once
from quotewright.functions.industry import resolve_industry
from quotewright.functions.money import div, fraction_text, hundredths_text, round_div, rupees

COST_PARTS = (
    "development_cost", "infrastructure_cost", "contingency", "discount",
    "total_estimated_cost", "monthly_average",
)


def multiplier_lookup(
    requests: DataFrame, contingency_bps: int = 100 * seeds.DEFAULT_CONTINGENCY_PCT
) -> DataFrame:
    """Add the industry multipliers; unresolved industries get the neutral ones.

    The contingency is the larger of the industry's and the given one, in basis points;
    ``contingency_pct`` has its whole percent.
    """
    resolved = once(requests, {"industry_applied": resolve_industry(F.col("industry"))})
    found = seeds.lookup(
        resolved, seeds.industry_multipliers(requests.sparkSession), "industry_applied"
    )
    return found.withColumns({
        "industry_applied": F.coalesce("industry_applied", F.lit(seeds.UNRESOLVED_LABEL)),
        "dev_pct": F.coalesce(F.col("dev_pct").cast("bigint"), F.lit(100).cast("bigint")),
        "infra_pct": F.coalesce(F.col("infra_pct").cast("bigint"), F.lit(100).cast("bigint")),
        "contingency_bps": F.greatest(F.col("contingency_pct").cast("bigint") * 100, F.lit(contingency_bps).cast("bigint")),
        "cost_adjustment_reason": F.coalesce("reason", F.lit(seeds.DEFAULT_REASON)),
    }).withColumn("contingency_pct", div(F.col("contingency_bps"), 100)).drop("reason")


def user_tier(users: Column, tiers=seeds.USER_TIERS, top=seeds.TOP_TIER_PAISE) -> Column:
    """Price per user in paise; the tier applies to the whole volume, not to the margin."""
    price = F.lit(top)
    for limit, paise in reversed(tiers):
        price = F.when(users <= limit, paise).otherwise(price)
    return price.cast("bigint")


def estimate_cost(
    requests: DataFrame,
    rate_paise: int = seeds.DEV_RATE_PAISE,
    contingency_bps: int = 100 * seeds.DEFAULT_CONTINGENCY_PCT,
    discount_bps: int = 0,
    tiers=seeds.USER_TIERS,
    top_tier_paise: int = seeds.TOP_TIER_PAISE,
) -> DataFrame:
    """Price every request: one broadcast lookup, no shuffle.

    Rates are whole basis points. Amounts are exact in units of a millionth of a paisa
    until each one is rounded once.
    """
    unit = 1_000_000
    priced = multiplier_lookup(requests, contingency_bps)
    months, users = F.col("duration_months").cast("bigint"), F.col("expected_users").cast("bigint")
    dev_rate = F.lit(rate_paise).cast("bigint") * F.col("dev_pct")
    per_user = user_tier(users, tiers, top_tier_paise) * F.col("infra_pct")
    dev = dev_rate * months * 10_000
    infra = per_user * users * 10_000
    contingency = dev_rate * months * F.col("contingency_bps")
    subtotal = dev + infra + contingency
    # Split so that the product with the discount rate stays within 64 bits.
    discount = (
        div(subtotal, 10_000) * discount_bps + div((subtotal % 10_000) * discount_bps, 10_000)
        if discount_bps else F.lit(0).cast("bigint")
    )
    total = subtotal - discount
    paid_months = F.greatest(months, F.lit(1))
    return priced.withColumns({
        "development_cost": round_div(dev, unit),
        "infrastructure_cost": round_div(infra, unit),
        "contingency": round_div(contingency, unit),
        "discount": round_div(discount, unit),
        "total_estimated_cost": round_div(total, unit),
        "monthly_average": round_div(total, paid_months * unit),
        "currency": F.lit(seeds.CURRENCY),
        "details": F.struct(
            months.alias("duration_months"),
            users.alias("expected_users"),
            round_div(per_user, 100).alias("infra_per_user"),
            round_div(dev_rate, 100).alias("dev_rate_per_month"),
            F.col("contingency_pct").alias("contingency_pct"),
            F.col("contingency_bps").alias("contingency_bps"),
            F.lit(discount_bps).cast("bigint").alias("discount_bps"),
            F.col("dev_pct").alias("industry_dev_pct"),
            F.col("infra_pct").alias("industry_infra_pct"),
        ),
    }).drop("dev_pct", "infra_pct", "contingency_pct", "contingency_bps")


def in_rupees(estimates: DataFrame) -> DataFrame:
    """The same estimates with amounts as exact decimal rupees."""
    return estimates.withColumns({name: rupees(F.col(name)) for name in COST_PARTS})


def details_json(details: Column) -> Column:
    """The ``details`` struct as JSON text with amounts in rupees and rates as fractions."""
    fields = (
        ("duration_months", details["duration_months"].cast("string")),
        ("expected_users", details["expected_users"].cast("string")),
        ("infra_per_user", hundredths_text(details["infra_per_user"])),
        ("dev_rate_per_month", hundredths_text(details["dev_rate_per_month"])),
        ("contingency_pct", fraction_text(details["contingency_bps"])),
        ("discount_pct", fraction_text(details["discount_bps"])),
        ("industry_dev_multiplier", hundredths_text(details["industry_dev_pct"])),
        ("industry_infra_multiplier", hundredths_text(details["industry_infra_pct"])),
    )
    parts = [F.concat(F.lit(f'"{name}": '), text) for name, text in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
