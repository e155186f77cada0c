"""History, upload and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotewright.functions import dates, text
from quotewright.operators import history, reports, uploads, validation
from quotewright.operators.pricing import COST_PARTS
from quotewright.operators.responses import read_sections as stored_sections
from quotewright.operators.segments import written
from quotewright.plans import inputs
from quotewright.plans.inputs import COST, UPLOAD, iso, with_ctes
from quotewright.plans.pricing import AMOUNTS, estimates, full_proposals
from quotewright.plans.registry import query
from quotewright.sources import artifacts as files
from quotewright.sources import cost_reports, proposals, requests, scratch, tables


def events(spark, sf):
    return tables.view(spark, sf, tables.DEVICE_EVENTS)


def stored(spark, sf):
    return tables.view(spark, sf, tables.PROPOSALS)


ROLLUP_SQL = f"""
    SELECT d.device_id, coalesce(d.user_name, '') AS user_name, {iso('d.created_at')} AS created_at,
           {iso('greatest(d.last_registered, coalesce(max(p.ts), d.last_registered))')} AS last_seen, count(p.event_id) AS proposal_count
    FROM (SELECT device_id, min(ts) AS created_at, min(event_id) FILTER (WHERE true) AS _id, max(ts) AS last_registered,
            arg_max(trim(user_name), ts) FILTER (WHERE trim(user_name) <> '') AS user_name
          FROM device_events WHERE action = 'register' GROUP BY device_id) d
    LEFT JOIN device_events p ON p.device_id = d.device_id AND p.action = 'record_proposal' AND p.ts > d.created_at
    GROUP BY d.device_id, d.user_name, d.created_at, d.last_registered"""


def _shown(devices):
    return devices.withColumns({c: dates.utc_iso(F.col(c)) for c in ("created_at", "last_seen")})


@query(with_ctes(ROLLUP_SQL, "device_events"))
def device_rollup(spark, sf):
    return _shown(history.device_rollup(events(spark, sf)))


@query(with_ctes("SELECT id, device_id, filename, project_title, position FROM history", "proposals", "history"))
def history_top_n(spark, sf):
    return history.history_top_n(stored(spark, sf)).select("id", "device_id", "filename", "project_title", "position")


@query(with_ctes("SELECT count(*) AS total FROM proposals", "proposals"))
def history_total(spark, sf):
    return history.history_total(stored(spark, sf))


@query(with_ctes("""SELECT r.device_id, user_name, proposal_count, cast(count(h.id) AS int) AS shown,
    coalesce(string_agg(h.filename, ',' ORDER BY position), '') AS files
    FROM (""" + ROLLUP_SQL + """) r LEFT JOIN history h ON h.device_id = r.device_id GROUP BY r.device_id, user_name, proposal_count""",
    "device_events", "proposals", "history"))
def device_history(spark, sf):
    devices = history.device_rollup(events(spark, sf))
    return history.device_history(devices, stored(spark, sf)).select(
        "device_id", "user_name", "proposal_count", F.size("history").alias("shown"),
        F.array_join("history.filename", ",").alias("files"))


@query(with_ctes("""SELECT id, device_id, h.filename, position, size_bytes IS NOT NULL AS "exists",
    CASE WHEN size_bytes IS NULL THEN 0 ELSE round_even(size_bytes / 1024.0::DOUBLE, 1) END AS size_kb,
    '/proposals/' || h.filename AS download_url, '/proposals/' || h.filename || '?inline=true' AS view_url
    FROM history h LEFT JOIN artifacts a USING (filename)""", "proposals", "history", "artifacts"))
def history_artifacts(spark, sf):
    found = history.history_artifacts(stored(spark, sf), tables.view(spark, sf, tables.ARTIFACTS))
    return found.drop("project_title", "created_at", "sections_json")


@query(with_ctes("""SELECT id, '/proposals/' || filename AS download_url, '/proposals/' || filename || '?inline=true' AS view_url FROM proposals""", "proposals"))
def history_projection(spark, sf):
    return history.with_links(stored(spark, sf)).select("id", "download_url", "view_url")


@query(with_ctes("""SELECT id, json_valid(sections_json) AS readable, CASE WHEN json_valid(sections_json) THEN sections_json ->> '$.executive_summary' END AS executive_summary FROM proposals""", "proposals"))
def read_sections(spark, sf):
    return stored_sections(stored(spark, sf)).select(
        "id", F.col("sections").isNotNull().alias("readable"),
        F.try_variant_get("sections", "$.executive_summary", "string").alias("executive_summary"))


# Every stored proposal is asked for by its own device and by device 1.
@query(with_ctes("""SELECT device_id, id, sections_json ->> '$.executive_summary' AS executive_summary FROM history
    WHERE json_valid(sections_json)""", "proposals", "history"))
def owned_sections(spark, sf):
    asked = stored(spark, sf).select("device_id", "id")
    asked = asked.union(asked.select(F.lit("device-00000001").alias("device_id"), "id")).distinct()
    return history.owned_sections(asked, stored(spark, sf)).select(
        "device_id", "id", F.try_variant_get("sections", "$.executive_summary", "string").alias("executive_summary"))


@query(with_ctes("""SELECT event_id, device_id, trim(user_name) AS user_name FROM device_events
    WHERE action = 'register' AND length(device_id) BETWEEN 10 AND 128 AND length(user_name) <= 80""", "device_events"))
def registration_filter(spark, sf):
    arrivals = events(spark, sf).where("action = 'register'")
    return validation.registration_filter(arrivals).select("event_id", "device_id", "user_name")


@query(with_ctes(f"SELECT event_id, {iso('ts')} AS created_at FROM device_events", "device_events"))
def utc_iso(spark, sf):
    return events(spark, sf).select("event_id", dates.utc_iso(F.col("ts")).alias("created_at"))


@query(with_ctes("SELECT event_id, TIMESTAMP '2024-01-30 00:00:00' - ts < INTERVAL 1 DAY AS is_new FROM device_events", "device_events"))
def is_new(spark, sf):
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    return events(spark, sf).select("event_id", dates.is_new(F.col("ts"), as_of).alias("is_new"))


@query(with_ctes("SELECT filename, round_even(size_bytes / 1024.0::DOUBLE, 1) AS size_kb FROM artifacts", "artifacts"))
def size_kb(spark, sf):
    return tables.view(spark, sf, tables.ARTIFACTS).select("filename", text.size_kb(F.col("size_bytes")).alias("size_kb"))


@query(with_ctes("SELECT filename, size_bytes FROM artifacts ORDER BY filename DESC", "artifacts"))
def artifact_order(spark, sf):
    return files.artifact_order(tables.view(spark, sf, tables.ARTIFACTS))


@query(with_ctes("""SELECT request_id, concat('Project ', cast(request_id AS varchar), ' / rollout') AS display_name FROM valid""", "requests", "valid"))
def display_name(spark, sf):
    name = F.concat(F.replace("project_title", F.lit(" "), F.lit("_")), F.lit("_Proposal.pdf"))
    return inputs.valid_requests(spark, sf).select("request_id", text.display_name(name).alias("display_name"))


@query(with_ctes("SELECT doc_id, lower(regexp_extract(filename, '(\\.[^./]*)$', 1)) AS ext FROM uploads", "uploads"))
def file_ext(spark, sf):
    return inputs.uploads(spark, sf).select("doc_id", text.file_ext(F.col("filename")).alias("ext"))


@query(with_ctes("SELECT * FROM verdicts", *UPLOAD[:2]))
def upload_admission(spark, sf):
    return uploads.upload_admission(inputs.uploads(spark, sf))


@query(with_ctes("SELECT upload_id, pos, filename, cast(length(text) AS int) AS chars, left(text, 500) AS preview FROM kept", *UPLOAD))
def upload_summary(spark, sf):
    return uploads.upload_summary(inputs.uploads(spark, sf))


@query(with_ctes("SELECT doc_id, filename, cast(length(text) AS int) AS chars, text FROM uploads", "uploads"))
def reference_documents(spark, sf):
    return inputs.uploads(spark, sf).select("doc_id", "filename", F.length("text").alias("chars"), "text")


@query(with_ctes("""SELECT device_id, start_us, row_number() OVER (PARTITION BY device_id, start_us ORDER BY ts_us, upload_id, pos) AS position,
    cast(length(part) AS int) AS chars, md5(part) AS part_md5 FROM parts""", *UPLOAD, "parts"))
def upload_context(spark, sf):
    contexts = uploads.upload_context(uploads.admitted(inputs.uploads(spark, sf)), inputs.SALT)
    return contexts.select(
        "device_id", dates.epoch_micros(F.col("session_start")).alias("start_us"), "position",
        F.length("part").alias("chars"), F.md5("part").alias("part_md5"))


@query(with_ctes("""SELECT device_id, start_us, max(ts_us) + 600000000 AS end_us, count(*) AS files, cast(sum(length(text)) AS bigint) AS chars
    FROM parts GROUP BY device_id, start_us""", *UPLOAD, "parts"))
def upload_sessions(spark, sf):
    found = uploads.upload_sessions(uploads.admitted(inputs.uploads(spark, sf)))
    return found.select(
        "device_id", dates.epoch_micros(F.col("session_start")).alias("start_us"),
        dates.epoch_micros(F.col("session_end")).alias("end_us"), "files", "chars")


@query(with_ctes("""SELECT request_id, device_id, start_us, docs AS docs_available, cast(length(context) AS bigint) AS chars FROM (
    SELECT q.request_id, q.device_id, s.start_us, count(p.part) AS docs,
           coalesce(string_agg(p.part, chr(10) || chr(10) ORDER BY p.ts_us, p.upload_id, p.pos), '') AS context
    FROM upload_requests q
    LEFT JOIN (SELECT device_id, start_us, max(ts_us) + 600000000 AS end_us FROM parts GROUP BY ALL) s
      ON s.device_id = q.device_id AND q.ts_us BETWEEN s.start_us AND s.end_us
    LEFT JOIN parts p ON p.device_id = s.device_id AND p.start_us = s.start_us AND p.ts_us <= q.ts_us
    GROUP BY q.request_id, q.device_id, s.start_us) c""", *UPLOAD, "parts", "upload_requests"))
def request_upload_context(spark, sf):
    docs = uploads.admitted(inputs.uploads(spark, sf))
    found = uploads.request_upload_state(inputs.upload_requests(spark, sf), docs)
    return found.select(
        "request_id", "device_id", dates.epoch_micros(F.col("session_start")).alias("start_us"), "docs_available",
        F.col("context_chars").alias("chars"))


@query(with_ctes("""SELECT request_id, project_title, trim(industry) AS industry, duration_months, expected_users, 'ollama' AS provider,
    len(string_split(tech_text, ',')) AS items FROM requests""", "requests"))
def read_requests(spark, sf):
    path = scratch.fresh_path(spark, "requests")
    sent = inputs.all_requests(spark, sf).select(
        "request_id", "project_title", F.trim("industry").alias("industry"), "tech_stack",
        F.col("duration_months").cast("string").alias("duration_months"), "expected_users",
        F.lit("not declared").alias("something_else"))
    sent.write.json(path)
    return requests.read_requests(spark, path).select(
        "request_id", "project_title", "industry", "duration_months", "expected_users", "provider",
        F.size("tech_stack").cast("bigint").alias("items"))


@query(with_ctes(f"SELECT request_id, {AMOUNTS}, industry_applied FROM costs", *COST))
def write_cost_reports_json(spark, sf):
    path = scratch.fresh_path(spark, "cost-json")
    cost_reports.write_cost_reports_json(estimates(spark, sf), path)
    columns = ", ".join(["request_id bigint", "industry_applied string", *[f"{c} bigint" for c in COST_PARTS]])
    return spark.read.schema(columns).json(path)


@query(with_ctes(f"""SELECT cast(request_id AS varchar) AS report_id, {', '.join(f'{c} / 100.0::DOUBLE AS {c}' for c in COST_PARTS)},
    currency, industry_applied, cost_adjustment_reason, cast(duration_months AS bigint) AS duration_months,
    cont_pct / 100.0::DOUBLE AS contingency_pct FROM costs""", *COST))
def read_cost_reports(spark, sf):
    path = scratch.fresh_path(spark, "cost-csv")
    cost_reports.write_cost_reports_csv(estimates(spark, sf), path)
    return cost_reports.read_cost_reports(spark, path, has_report_id=True).select(
        "report_id", *COST_PARTS, "currency", "industry_applied", "cost_adjustment_reason",
        "details.duration_months", "details.contingency_pct")


# The second batch is added twice, as by a job that ran again.
@query(with_ctes("""SELECT v.request_id AS id, v.device_id, v.client_name, coalesce(nullif(v.provider, ''), 'ollama') AS provider, 'auto' AS model,
    strftime(v.created_at, '%Y-%m') AS created_month, concat('half-', v.request_id % 2) AS batch,
    CASE WHEN v.request_id % 7 < 3 THEN concat('Order ', v.request_id, ' summary') END AS executive_summary,
    CASE WHEN v.request_id % 7 < 3 THEN 'b' END AS second_deliverable, c.total_estimated_cost, t.roles
    FROM valid v JOIN costs c USING (request_id)
    JOIN (SELECT request_id, cast(count(*) AS int) AS roles FROM team GROUP BY request_id) t USING (request_id)""",
    "requests", "valid", "mult", "aliases", "roles", "keys", "resolved_hit", "resolved", "costs", "members", "team"))
def append_proposals(spark, sf):
    path = scratch.fresh_path(spark, "proposals")
    full = full_proposals(spark, sf)
    full = full.select("request_id", reports.stored_sections(full).alias("sections_json"))
    rows = inputs.valid_requests(spark, sf).join(full, "request_id").select(
        F.col("request_id").alias("id"), "device_id", "client_name", "provider", F.lit(" ").substr(2, 1).alias("model"),
        "sections_json", "created_at")
    rows = written(rows, "proposal-rows")  # the batches below read it three times
    for half in (0, 1, 1):
        proposals.append_proposals(rows.where(F.col("id") % 2 == half), path, f"half-{half}")
    history_rows = proposals.read_proposals(spark, path)
    sections = stored_sections(history_rows)

    def get(what, kind):
        return F.try_variant_get("sections", what, kind)

    is_text = get("$.deliverables[1]", "string").isNotNull()
    # what is shown of the sections is taken before the join, which would move them whole
    shown = sections.select(
        "id", F.when(is_text, get("$.executive_summary", "string")).alias("executive_summary"), get("$.deliverables[1]", "string").alias("second_deliverable"),
        get("$.estimated_cost.total_estimated_cost", "bigint").alias("total_estimated_cost"), F.size(get("$.team_composition", "array<variant>")).alias("roles"))
    return history_rows.join(shown.hint("merge"), "id").select(
        "id", "device_id", "client_name", "provider", "model", F.col("created_month").cast("string").alias("created_month"), "batch",
        "executive_summary", "second_deliverable", "total_estimated_cost", "roles")
