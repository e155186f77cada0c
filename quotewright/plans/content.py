"""Text, reply, timeline and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotewright.functions import quick_fill as quick
from quotewright.functions import text
from quotewright.operators import assembly, reports, responses, risks, timeline
from quotewright.operators.team import estimate_team
from quotewright.plans.inputs import documents, sql_normalise, sql_pattern, sql_strip, sql_text, valid_requests, with_ctes
from quotewright.plans.pricing import sql_sanitize
from quotewright.plans.registry import query
from quotewright.sources import tables


def sql_clean(c: str) -> str:
    c = f"regexp_replace(replace({c}, '*', ''), '{sql_pattern(text.HEADING)}', '', 'g')"
    c = f"replace(regexp_replace({c}, '(?m){sql_pattern(text.LINE_BULLET)}', '', 'g'), '`', '')"
    return sql_normalise(f"regexp_replace({c}, '{text.LINK}', '\\1', 'g')")



def marked(spark, sf):
    return tables.view(spark, sf, tables.MARKED_DOCUMENTS)


MARKED_SQL = f"({tables.portable(tables.MARKED_DOCUMENTS)}) marked"


@query(f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM {MARKED_SQL}")
def clean_text(spark, sf):
    return marked(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"""SELECT doc_id, {sql_strip(f"regexp_replace(replace(replace(replace(regexp_replace(text, '(?i){sql_pattern(text.INJECTION)}', '{text.REDACTED}', 'g'), '</', '[/'), '<|', '[|'), '|>', '|]'), '(?i){sql_pattern(text.ROLE_MARKER)}', '{chr(92)}1{chr(92)}2:', 'g')")} AS sanitized FROM {MARKED_SQL}""")
def sanitize_text(spark, sf):
    return marked(spark, sf).select("doc_id", text.sanitize_text(F.col("text")).alias("sanitized"))


def _fold_sql(c: str) -> str:
    signs = "concat(" + ", ".join(f"chr({ord(ch)})" for ch in text.FOLD_SINGLE[0]) + ")"
    c = f"translate({c}, {signs}, {sql_text(text.FOLD_SINGLE[1])})"
    for sign, to in text.FOLD_MULTI:
        c = f"replace({c}, chr({ord(sign)}), '{to}')"
    return f"regexp_replace(regexp_replace({c}, '{text.CONTROL_CHARS}', '', 'g'), '{text.NOT_LATIN1}', '?', 'g')"


@query(f"SELECT doc_id, {_fold_sql('text')} AS folded FROM {MARKED_SQL}")
def latin1_fold(spark, sf):
    return marked(spark, sf).select("doc_id", text.latin1_fold(F.col("text")).alias("folded"))


_TRUNCATE = """CASE WHEN length(text) > 12000 THEN concat(left(text, 12000), chr(10), '... [truncated to 12000 chars]') ELSE text END"""


@query(f"SELECT doc_id, {_TRUNCATE} AS kept FROM documents")
def truncate_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.truncate_text(F.col("text")).alias("kept"))


@query("SELECT doc_id, left(text, 500) AS preview FROM documents")
def preview_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.preview_text(F.col("text")).alias("preview"))


@query(with_ctes("""SELECT request_id, risk_id, line_no, CASE WHEN length(risk) > 28 THEN concat(left(risk, 28), '...') ELSE risk END AS label FROM risks""", "risks"))
def ellipsis_label(spark, sf):
    return tables.view(spark, sf, tables.RISKS).select(
        "request_id", "risk_id", "line_no", text.ellipsis_label(F.col("risk")).alias("label"))


# Each line of a document is a table row, and a comma with a blank splits its cells.
@query(f"""SELECT doc_id, row_no, doc_row, sheet_row FROM (
    SELECT doc_id, row_no, array_to_string(list_filter(list_transform(cells, lambda x: {sql_strip('x')}), lambda x: x <> ''), ' | ') AS doc_row,
           CASE WHEN len(list_filter(cells, lambda x: x <> '')) > 0 THEN array_to_string(cells, ' | ') END AS sheet_row
    FROM (SELECT doc_id, cast(generate_subscripts(lines, 1) - 1 AS int) AS row_no, string_split(unnest(lines), ', ') AS cells
          FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) a) b) c""")
def join_cells(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    cells = F.split("line", ", ")
    return rows.select(
        "doc_id", "row_no", F.coalesce(text.join_cells(cells), F.lit("")).alias("doc_row"),
        text.join_cells(cells, keep_blanks=True).alias("sheet_row"))


# Every line of a document is a row of its sheet, named after its source, and a row of a word table.
@query(f"""SELECT doc_id, md5(sheet) AS sheet_md5, cast(length(sheet) AS bigint) AS sheet_chars, left(words, 12000) AS word_text, cast(length(words) AS bigint) AS word_chars FROM (
    SELECT doc_id, concat('[Sheet: ', min(source), ']', coalesce(chr(10) || string_agg(sheet_row, chr(10) ORDER BY row_no) FILTER (WHERE sheet_row IS NOT NULL), '')) AS sheet,
           string_agg(nullif(doc_row, ''), chr(10) ORDER BY row_no) AS words
    FROM (SELECT doc_id, source, row_no, array_to_string(list_filter(list_transform(cells, lambda x: {sql_strip('x')}), lambda x: x <> ''), ' | ') AS doc_row,
                 CASE WHEN len(list_filter(cells, lambda x: x <> '')) > 0 THEN array_to_string(cells, ' | ') END AS sheet_row
          FROM (SELECT doc_id, source, generate_subscripts(lines, 1) - 1 AS row_no, string_split(unnest(lines), ', ') AS cells
                FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents) a) b) c GROUP BY doc_id) d""")
def assemble_texts(spark, sf):
    lines = tables.read_table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    rows = lines.select("doc_id", F.lit(0).alias("sheet_no"), F.col("source").alias("sheet"), "row_no", F.split("line", ", ").alias("cells"))
    sheets = assembly.assembled(assembly.sheet_lines(rows)).select("doc_id", F.md5("text").alias("sheet_md5"), F.col("chars").alias("sheet_chars"))
    none = rows.select("doc_id", F.lit(0).alias("at"), F.lit("").alias("text")).limit(0)
    words = assembly.assembled(assembly.word_lines(none, rows.select("doc_id", F.col("row_no").alias("at"), "cells")), limit=12_000)
    words = words.select("doc_id", F.col("text").alias("word_text"), F.col("chars").alias("word_chars"))
    return sheets.join(words, "doc_id", "left")


@query(f"""SELECT line_id, project_title, CASE WHEN contains(project_title, 'Inc') OR contains(project_title, 'Corp') THEN project_title ELSE '' END AS client_name,
    coalesce(nullif(regexp_extract(lower(txt), '(?i){quick.INDUSTRY}', 1), ''), 'Technology') AS industry,
    coalesce(try_cast(nullif(regexp_extract(txt, '(?i){quick.MONTHS}', 1), '') AS bigint), 6) AS duration_months,
    coalesce(try_cast(coalesce(nullif(regexp_extract(txt, '(?i){quick.USERS}', 1), ''),
             replace(lower(nullif(regexp_extract(txt, '(?i){quick.USERS_K}', 1), '')), 'k', '000')) AS bigint), 5000) AS expected_users,
    CASE WHEN len(stack) > 0 THEN array_to_string(stack, ', ') ELSE 'Cloud Native, Fullstack' END AS tech_stack
    FROM (SELECT line_id, txt, regexp_extract_all(txt, '(?i){quick.STACK}', 1) AS stack,
      {sql_strip(f"coalesce(CASE WHEN regexp_matches(txt, '(?i){quick.TITLE}') THEN nullif(regexp_extract(txt, '(?i){quick.TITLE}', 1), '') ELSE nullif(regexp_extract(txt, '(?i){quick.TITLE_TO_END}', 1), '') END, 'Magic Project')")} AS project_title
      FROM ({tables.portable(tables.QUICK_LINES)}) q) t""")
def quick_fill(spark, sf):
    return quick.quick_fill(tables.view(spark, sf, tables.QUICK_LINES)).drop("txt")


_JSON = """SELECT *, CASE WHEN request_id % 7 IN (0, 1, 2, 6) THEN json(regexp_extract(raw, '(?s)\\{.*\\}', 0))
    WHEN request_id % 7 IN (4, 5) THEN json(raw) END AS js FROM raw_responses"""


@query(with_ctes(f"""SELECT request_id, js IS NOT NULL AS found, js ->> '$.executive_summary' AS executive_summary,
    js ->> '$.timeline[0].weeks' AS first_weeks, try_cast(js ->> '$.timeline[1].weeks' AS bigint) AS second_weeks
    FROM ({_JSON}) j""", "raw_responses"))
def extract_json(spark, sf):
    found = tables.view(spark, sf, tables.RAW_RESPONSES).withColumn("js", responses.extract_json(F.col("raw")))

    def get(path, kind):
        return F.try_variant_get("js", path, kind)

    return found.select(
        "request_id", F.col("js").isNotNull().alias("found"),
        get("$.executive_summary", "string").alias("executive_summary"),
        get("$.timeline[0].weeks", "string").alias("first_weeks"),
        get("$.timeline[1].weeks", "bigint").alias("second_weeks"))


_PLAIN = f"""CASE WHEN request_id % 7 IN (3, 5) THEN {sql_clean('raw')}
    WHEN request_id % 7 = 4 THEN 'Unexpected error: AttributeError: ''list'' object has no attribute ''get'''
    WHEN request_id % 7 = 6 THEN 'Unexpected error: TypeError: unsupported operand type(s) for +: ''int'' and ''str''' END"""
_OK = "request_id % 7 < 3"
# Build has 4 weeks and Ship 1 to 9; the total is 4 + ship.
_BUILD = """CASE WHEN 4 + ship = expected_weeks THEN 4 ELSE greatest(1, cast(round_even(4 * (expected_weeks / (4.0::DOUBLE + ship)), 0) AS bigint)) END"""


@query(with_ctes(f"""SELECT request_id, status, CASE WHEN {_OK} THEN concat('Order ', cast(request_id AS varchar), ' summary') ELSE plain END AS executive_summary,
    CASE WHEN {_OK} THEN 'N/A' ELSE plain END AS technical_approach,
    CASE WHEN {_OK} THEN concat('Build=', build, '; Ship=', CASE WHEN 4 + ship = expected_weeks THEN ship ELSE expected_weeks - build END) END AS timeline,
    plain AS timeline_text, CASE WHEN {_OK} THEN 'r: Medium' END AS risks, CASE WHEN {_OK} THEN 'a; b' END AS deliverables
    FROM (SELECT request_id, expected_weeks, {_PLAIN} AS plain, 1 + request_id % 9 AS ship,
            CASE WHEN {_OK} THEN 'ok' WHEN request_id % 7 IN (3, 5) THEN 'fallback_text' ELSE 'error' END AS status,
            {_BUILD.replace('ship', '(1 + request_id % 9)')} AS build FROM raw_responses) r""", "raw_responses"))
def parse_response(spark, sf):
    parsed = responses.parse_response(tables.view(spark, sf, tables.RAW_RESPONSES))
    phases = F.transform("timeline", lambda p: F.concat(p["phase"], F.lit("="), p["weeks"].cast("bigint").cast("string")))
    listed = F.transform("risk_assessment", lambda r: F.concat(r["risk"], F.lit(": "), r["impact"]))

    def joined(items):
        return F.when(items.isNotNull(), F.array_join(items, "; "))

    return parsed.select(
        "request_id", "status", "executive_summary", "technical_approach", joined(phases).alias("timeline"),
        "timeline_text", joined(listed).alias("risks"), joined(F.col("deliverables")).alias("deliverables"))


# Whole documents and turns as nested JSON of several shapes, with keys that no section has.
_NESTED = """SELECT doc_id AS id, to_json(named_struct('note', text, 'by', named_struct('lang', concat('*', lang, '*'), 'chars', n_chars),
      'parts', array(array(concat('# ', source)), array(text, source)))) AS js FROM {documents}
    UNION ALL SELECT -1 - conv_id * 1000 - turn, to_json(named_struct('turns', array(named_struct('`role`', role, 'text', concat('- ', text)))))
    FROM {conversations}"""


@query(f"""SELECT doc_id AS id, {sql_clean('text')} AS note, {sql_clean("concat('*', lang, '*')")} AS lang, n_chars AS chars,
    {sql_clean("concat('# ', source)")} AS first_part, {sql_clean('text')} AS second_part, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS turn FROM documents
    UNION ALL SELECT -1 - conv_id * 1000 - turn, NULL, NULL, NULL, NULL, NULL, {sql_clean('role')}, {sql_clean("concat('- ', text)")} FROM conversations""")
def clean_value(spark, sf):
    nested = tables.view(spark, sf, _NESTED).select("id", responses.clean_value(F.try_parse_json("js")).alias("v"))

    def get(path, kind="string"):
        return F.try_variant_get("v", path, kind)

    return nested.select(
        "id", get("$.note").alias("note"), get("$.by.lang").alias("lang"), get("$.by.chars", nested_type(spark, sf)).alias("chars"),
        get("$.parts[0][0]").alias("first_part"), get("$.parts[1][0]").alias("second_part"),
        get("$.turns[0]['`role`']").alias("role"), get("$.turns[0].text").alias("turn"))


def nested_type(spark, sf):
    return tables.read_table(spark, sf, "documents").schema["n_chars"].dataType.simpleString()


def ok_sections(spark, sf, name, view=tables.RAW_RESPONSES):
    return responses.parse_response(tables.view(spark, sf, view), (name,)).where("status = 'ok'")


# Replies of the documents' own lines: each line a deliverable and a risk, behind prose or in a fence.
_DOCUMENT_REPLIES = """SELECT doc_id AS request_id, 0 AS expected_weeks,
    CASE doc_id % 3 WHEN 0 THEN concat('```json\n', js, '\n```') WHEN 1 THEN concat('Here it is: ', js, ' - done.') ELSE js END AS raw
    FROM (SELECT doc_id, to_json(named_struct('executive_summary', source, 'deliverables', split(text, '\n'), 'owner', named_struct('lang', lang),
      'risk_assessment', transform(split(text, '\n'), l -> named_struct('risk', l, 'mitigation', concat('# ', lang),
        'impact', CASE length(l) % 4 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'low' WHEN 2 THEN 'severe' END)))) AS js FROM {documents}) j"""
_LINES_SQL = "SELECT doc_id, lang, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents) a"


@query(f"SELECT doc_id AS request_id, concat(pos + 1, '.') AS no, {sql_clean('line')} AS deliverable FROM ({_LINES_SQL}) b")
def deliverable_rows(spark, sf):
    return reports.deliverable_rows(ok_sections(spark, sf, "deliverables", _DOCUMENT_REPLIES))


@query(with_ctes(f"""SELECT request_id, pos, phase, concat(weeks, 'w') AS duration, '' AS description FROM (
    SELECT request_id, 0 AS pos, 'Build' AS phase, build AS weeks FROM b
    UNION ALL SELECT request_id, 1, 'Ship', CASE WHEN 4 + ship = expected_weeks THEN ship ELSE expected_weeks - build END FROM b) t""",
    "raw_responses").replace("\nSELECT request_id, pos", f""",
    b AS (SELECT *, {_BUILD} AS build FROM (SELECT request_id, expected_weeks, 1 + request_id % 9 AS ship FROM raw_responses WHERE {_OK}) s)
    SELECT request_id, pos""", 1))
def timeline_rows(spark, sf):
    return reports.timeline_rows(ok_sections(spark, sf, "timeline"))


@query(f"""SELECT doc_id AS request_id, 8 AS section_no, cast(pos AS int) AS pos, {sql_clean('line')} AS risk,
    CASE length(line) % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS impact, '-' AS probability, lang AS mitigation
    FROM ({_LINES_SQL}) b""")
def risk_rows(spark, sf):
    return reports.risk_rows(ok_sections(spark, sf, "risk_assessment", _DOCUMENT_REPLIES), has_team=True)


_IMPACT = "CASE lower(trim(impact)) WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END"


@query(with_ctes(f"SELECT request_id, risk_id, line_no, risk, {_IMPACT} AS impact, probability FROM risks", "risks"))
def normalise_risk(spark, sf):
    return risks.normalise_risk(tables.view(spark, sf, tables.RISKS))


@query(with_ctes(f"""SELECT CASE coalesce(probability, 'Medium') WHEN 'High' THEN 3 WHEN 'Low' THEN 1 ELSE 2 END AS x,
    CASE {_IMPACT} WHEN 'High' THEN 3 WHEN 'Low' THEN 1 ELSE 2 END AS y,
    CASE {_IMPACT} WHEN 'High' THEN '#ef4444' WHEN 'Low' THEN '#22c55e' ELSE '#f59e0b' END AS colour, count(*) AS risks
    FROM risks GROUP BY ALL""", "risks"))
def risk_matrix(spark, sf):
    return risks.risk_matrix(risks.normalise_risk(tables.view(spark, sf, tables.RISKS)))


@query(with_ctes("""SELECT request_id, count(*) AS phases, cast(sum(CASE WHEN is_object THEN weeks ELSE 0 END) AS bigint) AS total_weeks
    FROM phases GROUP BY request_id""", "phases"))
def phase_totals(spark, sf):
    return timeline.phase_totals(tables.view(spark, sf, tables.PHASES))


@query(with_ctes("""SELECT request_id, seq, phase, is_object, weeks, expected_weeks, new_weeks, NOT keep AND new_weeks < 1 AS is_infeasible FROM (
    SELECT *, CASE WHEN keep THEN weeks WHEN seq = last_seq THEN expected_weeks - used ELSE scaled END AS new_weeks FROM (
      SELECT *, cast(coalesce(sum(CASE WHEN is_object AND seq <> last_seq THEN scaled END) OVER (PARTITION BY request_id), 0) AS bigint) AS used FROM (
        SELECT *, total IN (0, expected_weeks) OR NOT is_object AS keep,
               greatest(1, cast(round_even(weeks * (expected_weeks::DOUBLE / nullif(total, 0)), 0) AS bigint)) AS scaled FROM (
          SELECT *, sum(CASE WHEN is_object THEN weeks ELSE 0 END) OVER (PARTITION BY request_id) AS total,
                 max(seq) OVER (PARTITION BY request_id) AS last_seq FROM phases) a) b) c) d""", "phases"))
def timeline_rescale(spark, sf):
    return timeline.timeline_rescale(tables.view(spark, sf, tables.PHASES))


@query(with_ctes("""SELECT request_id, seq, phase, start_week, start_week + weeks AS end_week, weeks FROM (
    SELECT *, cast(coalesce(sum(weeks) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_week,
           max(weeks) OVER (PARTITION BY request_id) AS largest FROM phases) p WHERE largest > 0""", "phases"))
def gantt_offsets(spark, sf):
    return timeline.gantt_offsets(tables.view(spark, sf, tables.PHASES))
