"""Request validation as arrays of violated rules, and the split by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.text import clean_tech_stack, normalise_text, strip

# --------------------------------------------------------------------------
# Bounds of each field. Text lengths count before trimming.
# --------------------------------------------------------------------------
CORE_TEXT = (("project_title", 3, 200), ("industry", 2, 100))
CORE_NUMBERS = (("duration_months", 1, 60), ("expected_users", 10, 100_000_000))
REQUEST_TEXT = (
    ("client_name", 200), ("custom_notes", 2000), ("budget_range", 50),
    ("project_priority", 20), ("deployment_model", 30), ("target_audience", 200),
    ("competitors", 500), ("device_id", 128), ("user_name", 80),
)
TECH_ITEMS = (1, 15)
COMPLIANCE_ITEMS = 10
EDIT_TEXT = (("client_name", 200), ("device_id", 128))
INSTRUCTION = (5, 1000)
PREBUILT_TEXT = (("client_name", 150), ("device_id", 128))
DEVICE_ID = (10, 128)
USER_NAME_LIMIT = 80


def _required_text(name: str, low: int, high: int) -> list[Column]:
    size = F.length(name)
    return [
        F.when(F.col(name).isNull(), f"{name}:missing")
        .when(size < low, f"{name}:too_short")
        .when(size > high, f"{name}:too_long")
    ]


def _bounded(name: str, low: int, high: int | None) -> list[Column]:
    c = F.col(name)
    rule = F.when(c.isNull(), f"{name}:missing").when(c < low, f"{name}:too_small")
    return [rule if high is None else rule.when(c > high, f"{name}:too_large")]


def _optional_text(df: DataFrame, rules) -> list[Column]:
    return [
        F.when(F.length(name) > high, f"{name}:too_long")
        for name, high in rules if name in df.columns
    ]


def _blank_text(name: str) -> Column:
    return F.when(F.col(name).isNotNull() & (F.length(name) > 0) & (strip(F.col(name)) == ""), f"{name}:blank")


def _item_count(name: str, low: int, high: int | None) -> Column:
    rule = F.when(F.col(name).isNull(), f"{name}:missing").when(F.size(name) < low, f"{name}:too_few")
    return rule if high is None else rule.when(F.size(name) > high, f"{name}:too_many")


def _with(df: DataFrame, rules: list[Column]) -> DataFrame:
    # ``concat_ws`` skips NULLs in generated code; filtering an array would be interpreted.
    codes = F.concat_ws(",", *rules)
    none = F.array().cast("array<string>")
    return df.withColumn("violations", F.when(codes == "", none).otherwise(F.split(codes, ",")))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``violations``; an empty array means the request is valid."""
    rules = [r for rule in CORE_TEXT for r in _required_text(*rule)]
    rules += [r for rule in CORE_NUMBERS for r in _bounded(*rule)]
    rules.append(_item_count("tech_stack", *TECH_ITEMS))
    rules += _optional_text(requests, REQUEST_TEXT)
    if "compliance_requirements" in requests.columns:
        rules.append(F.when(F.size("compliance_requirements") > COMPLIANCE_ITEMS,
                            "compliance_requirements:too_many"))
    rules += [_blank_text(name) for name, _, _ in CORE_TEXT]
    blank = strip(F.array_join("tech_stack", "")) == ""
    rules.append(F.when((F.size("tech_stack") >= 1) & blank, "tech_stack:blank"))
    return _with(requests, rules)


def validate_edits(edits: DataFrame) -> DataFrame:
    """Edit requests: the core bounds, no item maximum, sections and an instruction."""
    rules = [r for rule in CORE_TEXT for r in _required_text(*rule)]
    rules += [r for rule in CORE_NUMBERS for r in _bounded(*rule)]
    rules.append(_item_count("tech_stack", 1, None))
    rules += _optional_text(edits, EDIT_TEXT)
    rules.append(F.when(F.col("current_sections").isNull(), "current_sections:missing"))
    rules += _required_text("edit_instruction", *INSTRUCTION)
    return _with(edits, rules)


def validate_prebuilt(requests: DataFrame) -> DataFrame:
    """Requests with ready sections: fewer users allowed, the stack may be empty."""
    filled = requests.withColumn(
        "tech_stack", F.coalesce("tech_stack", F.array().cast("array<string>"))
    )
    rules = [r for rule in CORE_TEXT for r in _required_text(*rule)]
    rules += _bounded(*CORE_NUMBERS[0]) + _bounded("expected_users", 1, None)
    rules += _optional_text(filled, PREBUILT_TEXT)
    rules.append(F.when(F.col("sections").isNull(), "sections:missing"))
    return _with(filled, rules)


def registration_filter(registrations: DataFrame) -> DataFrame:
    """Keep acceptable registrations and store their names trimmed."""
    kept = registrations.where(
        F.length("device_id").between(*DEVICE_ID)
        & (F.length(F.coalesce("user_name", F.lit(""))) <= USER_NAME_LIMIT)
    )
    return kept.withColumn("user_name", stored_user_name(F.col("user_name")))


def stored_user_name(name: Column) -> Column:
    return F.left(strip(F.coalesce(name, F.lit(""))), F.lit(USER_NAME_LIMIT))


def accepted(checked: DataFrame) -> DataFrame:
    """Valid requests with their cleaned title, industry and stack."""
    return checked.where(F.size("violations") == 0).drop("violations").withColumns({
        "project_title": normalise_text(F.col("project_title")),
        "industry": normalise_text(F.col("industry")),
        "tech_stack": clean_tech_stack(F.col("tech_stack")),
    })


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)
