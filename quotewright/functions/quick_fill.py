"""A project request read from one line of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.text import strip

# --------------------------------------------------------------------------
# Patterns and defaults.
# --------------------------------------------------------------------------
ANY = r"[^\n\r\x{2028}\x{2029}]"
TITLE = f"for ({ANY}*?) in"
TITLE_TO_END = f"for ({ANY}*)"
MONTHS = r"([0-9]+)\s*month"
USERS = r"([0-9]+)\s*user"
USERS_K = r"([0-9]+k)\s*user"
INDUSTRY = "(healthcare|finance|ecommerce|retail|education|cloud|saas|manufacturing|logistics)"
STACK = "in (react|aws|python|java|go|node|postgres)"
DEFAULTS = {"title": "Magic Project", "months": 6, "users": 5000, "industry": "Technology",
            "stack": "Cloud Native, Fullstack"}


def _first(c: Column, pattern: str) -> Column:
    """First group of the first match, NULL if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, "(?i)" + pattern, 1), F.lit(""))


def quick_fill(lines: DataFrame) -> DataFrame:
    """Add the request fields found in ``txt``; lines without any text are refused and left out."""
    txt = F.col("txt")
    title = strip(F.coalesce(
        F.when(txt.rlike("(?i)" + TITLE), _first(txt, TITLE)).otherwise(_first(txt, TITLE_TO_END)),
        F.lit(DEFAULTS["title"]),
    ))
    users = F.coalesce(
        _first(txt, USERS), F.replace(F.lower(_first(txt, USERS_K)), F.lit("k"), F.lit("000"))
    )
    stack = F.regexp_extract_all(txt, F.lit("(?i)" + STACK), F.lit(1))
    return lines.where(strip(txt) != "").withColumns({
        "project_title": title,
        "client_name": F.when(title.contains("Inc") | title.contains("Corp"), title).otherwise(""),
        "industry": F.coalesce(_first(F.lower(txt), INDUSTRY), F.lit(DEFAULTS["industry"])),
        "duration_months": F.coalesce(_first(txt, MONTHS).try_cast("bigint"), F.lit(DEFAULTS["months"])),
        "expected_users": F.coalesce(users.try_cast("bigint"), F.lit(DEFAULTS["users"])),
        "tech_stack": F.when(F.size(stack) > 0, F.array_join(stack, ", ")).otherwise(DEFAULTS["stack"]),
    })
