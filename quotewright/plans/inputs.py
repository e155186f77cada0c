"""Inputs shared by the queries, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright import seeds
from quotewright.functions import text
from quotewright.functions.dates import from_epoch_micros
from quotewright.operators.validation import accepted, validate_requests
from quotewright.sources import tables


#: Secret of the queries' content tags; a deployment uses its own.
SALT = "query-salt"


def with_lists(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        "tech_stack": F.split("tech_text", ","),
        "compliance_requirements": F.split("compliance_text", ","),
    }).drop("tech_text", "compliance_text")


def all_requests(spark: SparkSession, sf: str) -> DataFrame:
    return with_lists(tables.view(spark, sf, tables.REQUESTS))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    return with_lists(tables.view(spark, sf, tables.EDITS))


def valid_requests(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(validate_requests(all_requests(spark, sf)))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.view(spark, sf, tables.UPLOADS)
    return files.withColumn("ts", from_epoch_micros(F.col("ts_us"))).drop("ts_us")


def upload_requests(spark: SparkSession, sf: str) -> DataFrame:
    asks = tables.view(spark, sf, tables.UPLOAD_REQUESTS)
    return asks.withColumn("ts", from_epoch_micros(F.col("ts_us"))).drop("ts_us")


def prompt_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Valid requests with the device and time of their uploads, and the user's name."""
    asks = with_lists(tables.view(spark, sf, tables.PROMPT_REQUESTS))
    asks = asks.withColumns({"ts": from_epoch_micros(F.col("ts_us")), "device_id": F.col("upload_device")}).drop("ts_us", "upload_device")
    return accepted(validate_requests(asks))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "documents").select("doc_id", "text")


# --------------------------------------------------------------------------
# The same inputs in SQL.
# --------------------------------------------------------------------------
def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACE = f"[{text.SPACE_CLASS}]"


def sql_pattern(pattern: str) -> str:
    """A pattern of the text rules with the space class every dialect knows."""
    return pattern.replace(text.SPACE, SPACE)


SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in text.SPACE_CHARS) + ")"


def sql_strip(c: str) -> str:
    return f"trim({c}, {SPACES})"


def sql_normalise(c: str) -> str:
    collapsed = f"regexp_replace({c}, '{SPACE}+', ' ', 'g')"
    return sql_strip(collapsed)


def sql_cents(c: str) -> str:
    return (
        f"concat(cast({c} // 100 AS varchar), '.', CASE WHEN {c} % 10 = 0 "
        f"THEN cast({c} % 100 // 10 AS varchar) ELSE lpad(cast({c} % 100 AS varchar), 2, '0') END)"
    )


_STACK = "list_filter(list_transform(string_split(tech_text, ','), lambda t: trim(t)), lambda t: t <> '')"

CTES = {
    "requests": tables.portable(tables.REQUESTS),
    "valid": f"""SELECT request_id, device_id, {sql_normalise('project_title')} AS project_title, client_name,
        {sql_normalise('industry')} AS industry, duration_months, expected_users, {_STACK} AS stack,
        project_priority, deployment_model, compliance_text, budget_range, target_audience, competitors,
        custom_notes, provider, created_at
        FROM requests WHERE duration_months BETWEEN 1 AND 60 AND expected_users BETWEEN 10 AND 100000000""",
    "edits": tables.portable(tables.EDITS),
    "phases": tables.portable(tables.PHASES),
    "risks": tables.portable(tables.RISKS),
    "raw_responses": tables.portable(tables.RAW_RESPONSES),
    "device_events": tables.portable(tables.DEVICE_EVENTS),
    "proposals": tables.portable(tables.PROPOSALS),
    "artifacts": tables.portable(tables.ARTIFACTS),
    "uploads": tables.portable(tables.UPLOADS),
    "upload_requests": tables.portable(tables.UPLOAD_REQUESTS),
    "prompt_requests": tables.portable(tables.PROMPT_REQUESTS),
    "quick_lines": tables.portable(tables.QUICK_LINES),
    "mult": seeds.values_sql(seeds.MULTIPLIERS, seeds.MULTIPLIER_COLUMNS),
    "aliases": seeds.values_sql(seeds.numbered(seeds.COST_ALIASES), seeds.ALIAS_COLUMNS),
    "kb_aliases": seeds.values_sql(seeds.numbered(seeds.KB_ALIASES), seeds.ALIAS_COLUMNS),
    "roles": seeds.values_sql(seeds.EXTRA_ROLES, seeds.ROLE_COLUMNS),
    "kb": seeds.values_sql(seeds.KNOWLEDGE_BASE, seeds.KB_COLUMNS),
    "keys": "SELECT DISTINCT industry AS raw, lower(trim(industry)) AS k FROM requests",
}
for _name, _aliases in (("resolved", "aliases"), ("kb_resolved", "kb_aliases")):
    CTES[f"{_name}_hit"] = (
        f"SELECT raw, min_by(a.industry, a.ord) AS hit FROM keys JOIN {_aliases} a "
        "ON contains(k, a.alias) OR contains(a.alias, k) GROUP BY raw"
    )
    CTES[_name] = (
        "SELECT DISTINCT k, coalesce(m.industry, e.industry, h.hit) AS resolved FROM keys "
        f"LEFT JOIN mult m ON m.industry = k LEFT JOIN {_aliases} e ON e.alias = k "
        f"LEFT JOIN {_name}_hit h ON h.raw = keys.raw"
    )
CTES["costs"] = f"""
    SELECT *, (2 * total_estimated_cost + duration_months) // (2 * duration_months) AS monthly_average FROM (
      SELECT *, development_cost + infrastructure_cost + contingency AS total_estimated_cost FROM (
        SELECT v.*, coalesce(r.resolved, 'general') AS industry_applied,
          cast(coalesce(m.dev_pct, 100) AS bigint) AS dev_pct, cast(coalesce(m.infra_pct, 100) AS bigint) AS infra_pct,
          greatest(10, coalesce(m.contingency_pct, 10)) AS cont_pct,
          coalesce(m.reason, '{seeds.DEFAULT_REASON}') AS cost_adjustment_reason,
          150000::BIGINT * coalesce(m.dev_pct, 100) * duration_months AS development_cost,
          cast(expected_users * CASE WHEN expected_users <= 1000 THEN 42 WHEN expected_users <= 10000 THEN 29
               ELSE 17 END * coalesce(m.infra_pct, 100) AS bigint) AS infrastructure_cost,
          150000::BIGINT * coalesce(m.dev_pct, 100) * duration_months * greatest(10, coalesce(m.contingency_pct, 10)) // 100 AS contingency,
          cast(0 AS bigint) AS discount, 'INR' AS currency
        FROM valid v JOIN resolved r ON r.k = lower(v.industry) LEFT JOIN mult m ON m.industry = r.resolved) a) b"""
CTES["members"] = """
    SELECT request_id, pos, role, headcount, allocation FROM (
      SELECT request_id, 1 AS pos, 'Project Manager' AS role, 1 AS headcount, 'Full-time' AS allocation FROM valid
      UNION ALL SELECT request_id, 2, 'Backend Developer', greatest(1, (duration_months + 2) // 3), 'Full-time' FROM valid
      UNION ALL SELECT request_id, 3, 'Frontend Developer', greatest(1, (duration_months + 3) // 4), 'Full-time' FROM valid
      UNION ALL SELECT request_id, 4, 'QA Engineer', CASE WHEN duration_months <= 4 THEN 1 ELSE 2 END, 'Full-time' FROM valid
      UNION ALL SELECT request_id, 5, 'DevOps Engineer', 1, 'Part-time' FROM valid WHERE duration_months >= 4 OR expected_users >= 5000
      UNION ALL SELECT request_id, 6, 'UI/UX Designer', 1, 'Part-time' FROM valid
        WHERE list_has_any(list_transform(stack, lambda t: lower(t)), [""" + ", ".join(sql_text(s) for s in seeds.FRONTEND_STACKS) + """])
      UNION ALL SELECT request_id, 7, 'Database Administrator', 1, 'Part-time' FROM valid WHERE expected_users >= 10000
      UNION ALL SELECT request_id, 8, 'Solution Architect', 1, 'Part-time' FROM valid WHERE duration_months >= 6 OR expected_users >= 50000
      UNION ALL SELECT request_id, 9, 'Business Analyst', 1, 'Part-time' FROM valid WHERE duration_months >= 4
      UNION ALL SELECT v.request_id, 10, x.role, x.headcount, x.allocation FROM valid v
        JOIN resolved r ON r.k = lower(v.industry) JOIN roles x ON x.industry = r.resolved) t"""
CTES["team"] = """SELECT request_id, cast(row_number() OVER (PARTITION BY request_id ORDER BY pos) AS int) AS pos,
    role, cast(headcount AS int) AS headcount, allocation FROM members"""
CTES["history"] = """SELECT *, cast(row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, id DESC) AS int) AS position
    FROM proposals QUALIFY position <= 100"""
CTES["verdicts"] = """
    SELECT device_id, upload_id, count(*) AS files,
      CASE WHEN count(*) > 3 THEN 'too_many_files' ELSE min_by(problem, pos) FILTER (WHERE problem IS NOT NULL) END AS reason,
      CASE WHEN count(*) <= 3 THEN min(pos) FILTER (WHERE problem IS NOT NULL) END AS failed_pos,
      count(*) <= 3 AND count(problem) = 0 AS accepted
    FROM (SELECT *, CASE WHEN lower(regexp_extract(filename, '(\\.[^./]*)$', 1)) NOT IN ('.pdf', '.doc', '.docx', '.xls', '.xlsx')
                         THEN 'unsupported_type' WHEN size_bytes > 15728640 THEN 'too_large' END AS problem FROM uploads) u
    GROUP BY device_id, upload_id"""
CTES["kept"] = """
    SELECT u.* REPLACE (CASE WHEN length(u.text) > 12000 THEN concat(left(u.text, 12000), chr(10), '... [truncated to 12000 chars]') ELSE u.text END AS text)
    FROM uploads u JOIN verdicts v USING (device_id, upload_id) WHERE v.accepted"""
CTES["parts"] = f"""
    SELECT *, max(CASE WHEN gap IS NULL OR gap > 600000000 THEN ts_us END) OVER (PARTITION BY device_id ORDER BY ts_us, upload_id, pos) AS start_us
    FROM (SELECT device_id, upload_id, pos, ts_us, text,
            concat('<UPLOADED_DOC_', tag, ' name="', filename, '">', chr(10), text, chr(10), '</UPLOADED_DOC_', tag, '>') AS part,
            ts_us - lag(ts_us) OVER (PARTITION BY device_id ORDER BY ts_us, upload_id, pos) AS gap
          FROM (SELECT *, upper(left(sha256(concat(device_id, '{SALT}')), 8)) AS tag FROM kept WHERE device_id <> '') k) g"""


def with_ctes(select: str, *names: str) -> str:
    """``select`` after the named expressions, given in the order they depend on each other."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + select


COST = ("requests", "valid", "mult", "aliases", "keys", "resolved_hit", "resolved", "costs")
TEAM = ("requests", "valid", "mult", "aliases", "roles", "keys", "resolved_hit", "resolved", "members", "team")
KB = ("requests", "valid", "mult", "kb_aliases", "kb", "keys", "kb_resolved_hit", "kb_resolved")
CTES["reference"] = """
    SELECT q.request_id, string_agg(p.part, chr(10) || chr(10) ORDER BY p.ts_us, p.upload_id, p.pos) AS reference_text
    FROM prompt_requests q
    JOIN (SELECT device_id, start_us, max(ts_us) + 600000000 AS end_us FROM parts GROUP BY ALL) s
      ON s.device_id = q.upload_device AND q.ts_us BETWEEN s.start_us AND s.end_us
    JOIN parts p ON p.device_id = s.device_id AND p.start_us = s.start_us AND p.ts_us <= q.ts_us
    GROUP BY q.request_id"""
UPLOAD = ("uploads", "verdicts", "kept")


def iso(c: str) -> str:
    """Timestamp as ISO text in SQL."""
    return f"concat(regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''), '+00:00')"
