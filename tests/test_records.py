import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotewright.functions.text import TRUNCATION_NOTE, content_tag
from quotewright.operators import history, uploads, validation

T0 = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, device_id string, action string, user_name string"


def events(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), d, a, n) for i, (s, d, a, n) in enumerate(rows)], EVENTS)


def replay(rows):
    """Devices after applying the events one by one."""
    devices = {}
    for s, d, action, name in rows:
        name = (name or "").strip()[:80]
        if action == "register":
            if d in devices:
                devices[d] = (name or devices[d][0], devices[d][1], s, devices[d][3])
            else:
                devices[d] = (name, s, s, 0)
        elif action == "record_proposal" and d in devices:
            old = devices[d]
            devices[d] = (old[0], old[1], s, old[3] + 1)
    return devices


@pytest.mark.parametrize("spread", [1, 60])
def test_device_rollup_equals_replay(spark, spread):
    rng = random.Random(5)
    rows = sorted((
        (rng.randint(0, 500) * spread, "hot" if rng.random() < 0.4 else f"d{rng.randint(0, 20)}",
         rng.choice(["register", "record_proposal", "record_proposal", "other"]), rng.choice(["", " a ", "b", None]))
        for _ in range(400)), key=lambda r: r[0])
    found = {
        r.device_id: (r.user_name, (r.created_at - T0).seconds, (r.last_seen - T0).seconds, r.proposal_count)
        for r in history.device_rollup(events(spark, rows)).collect()}
    assert found == replay(rows)


def test_history(spark):
    rows = [(i, "hot" if i % 3 else f"d{i % 5}", f"f{i}", T0 + timedelta(seconds=i // 2), '{"a": 1}') for i in range(400)]
    stored = spark.createDataFrame(rows, "id bigint, device_id string, filename string, created_at timestamp_ntz, sections_json string")
    top = history.history_top_n(stored)
    assert [r.id for r in top.where("device_id = 'hot'").orderBy("position").collect()] == sorted(
        (r[0] for r in rows if r[1] == "hot"), reverse=True)[:100]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([("hot", 398), ("hot", 1), ("d0", 398)], "device_id string, id bigint")
    assert [(r.device_id, r.id) for r in history.owned_sections(wanted, stored).collect()] == [("hot", 398)]
    files = spark.createDataFrame([("f398", 1280)], "filename string, size_bytes bigint")
    found = {r.filename: (r.exists, r.size_kb) for r in history.history_artifacts(stored, files).collect()}
    assert found["f398"] == (True, 1.2) and found["f397"] == (False, 0.0)


UPLOADS = "device_id string, upload_id bigint, pos int, filename string, size_bytes bigint, text string, ts timestamp_ntz"


def upload_rows(rng, n):
    """Gaps around ten minutes, one device with a third of the uploads."""
    clock, rows = {}, []
    for i in range(n):
        device = "hot" if rng.random() < 0.34 else f"d{rng.randint(0, 6)}"
        step = rng.choice([0, 1, 30, 60, 599, 600, 601, 3000])
        clock[device] = clock.get(device, rng.randint(0, 90)) + step
        rows.append((device, i, 0, f"f{i}.pdf", 1, "t" * rng.randint(1, 9), T0 + timedelta(seconds=clock[device])))
    return rows


def sessions_by_hand(rows):
    """(device, start) -> rows in order; a gap above 600 seconds starts a new session."""
    found, last, start = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[6], r[1])):
        if r[0] not in last or (r[6] - last[r[0]]).total_seconds() > 600:
            start[r[0]] = r[6]
        last[r[0]] = r[6]
        found.setdefault((r[0], start[r[0]]), []).append(r)
    return found


def wrapped(tags, r):
    return f'<UPLOADED_DOC_{tags[r[0]]} name="{r[3]}">\n{r[5]}\n</UPLOADED_DOC_{tags[r[0]]}>'


@pytest.fixture(scope="module")
def uploaded(spark):
    rows = upload_rows(random.Random(2), 300)
    df = spark.createDataFrame(rows, UPLOADS)
    tags = {r[0]: r[1] for r in df.select("device_id", content_tag(F.col("device_id"), "s")).distinct().collect()}
    return rows, df, tags


def test_sessions(spark, uploaded):
    rows, df, _ = uploaded
    found = {
        (r.device_id, r.session_start): (r.session_end, r.files, r.chars) for r in uploads.upload_sessions(df).collect()}
    assert found == {
        k: (v[-1][6] + timedelta(seconds=600), len(v), sum(len(r[5]) for r in v)) for k, v in sessions_by_hand(rows).items()}


def test_context(spark, uploaded):
    rows, df, tags = uploaded
    found = {}
    for r in uploads.upload_context(df, "s").orderBy("device_id", "session_start", "position").collect():
        found.setdefault((r.device_id, r.session_start), []).append((r.position, r.part))
    assert found == {k: [(i + 1, wrapped(tags, r)) for i, r in enumerate(v)] for k, v in sessions_by_hand(rows).items()}


def test_request_context(spark, uploaded):
    rows, df, tags = uploaded
    rng = random.Random(9)
    asks = [(i, "hot" if rng.random() < 0.4 else f"d{rng.randint(0, 8)}", T0 + timedelta(seconds=rng.randint(0, 40000))) for i in range(300)]
    asks += [(1000 + r[1], r[0], r[6]) for r in rows[:60]] + [(5000, "", T0), (5001, None, T0)]
    requests = spark.createDataFrame(asks, "request_id bigint, device_id string, ts timestamp_ntz")
    found = {r.request_id: r for r in uploads.request_upload_state(requests, df).collect()}
    assert len(found) == len(asks)
    sessions = sessions_by_hand(rows)
    for request_id, device, ts in asks:
        seen = next(
            (v for (d, start), v in sessions.items() if d == device and start <= ts <= v[-1][6] + timedelta(seconds=600)), [])
        seen = [r for r in seen if r[6] <= ts]
        got = found[request_id]
        assert got.docs_available == len(seen)
        assert got.context_chars == len("\n\n".join(wrapped(tags, r) for r in seen))


def test_uploads_without_a_device_belong_to_nobody(spark):
    rows = [("", 1, 0, "a.pdf", 1, "x", T0), (None, 2, 0, "a.pdf", 1, "x", T0), ("d1", 3, 0, "a.pdf", 1, "x", T0)]
    df = spark.createDataFrame(rows, UPLOADS)
    asks = spark.createDataFrame([(1, "", T0), (2, None, T0), (3, "d1", T0)], "request_id bigint, device_id string, ts timestamp_ntz")
    assert {r.request_id: r.docs_available for r in uploads.request_upload_state(asks, df).collect()} == {1: 0, 2: 0, 3: 1}
    assert [r.device_id for r in uploads.upload_context(df, "s").collect()] == ["d1"]
    assert [r.device_id for r in uploads.upload_sessions(df).collect()] == ["d1"]


def test_a_shared_upload_id_is_judged_per_device(spark):
    rows = [("d1", 1, 0, "a.exe", 1, "x", T0), ("d2", 1, 0, "b.pdf", 1, "y", T0)]
    df = spark.createDataFrame(rows, UPLOADS)
    assert [r.device_id for r in uploads.admitted(df).collect()] == ["d2"]
    assert [r.filename for r in uploads.upload_summary(df).collect()] == ["b.pdf"]


def test_tags_need_a_salt():
    for salt in ("", "  "):
        with pytest.raises(ValueError):
            content_tag(F.lit("d"), salt)


def test_admission(spark):
    def up(upload_id, *files):
        return [("d", upload_id, i, name, size, "x" * 12001, T0) for i, (name, size) in enumerate(files)]

    mib15 = 15 * 1024 * 1024
    rows = (up(1, ("a.pdf", 1), ("b.XLSX", mib15)) + up(2, ("a.pdf", 1), ("b.txt", 1), ("c.pdf", mib15 + 1))
            + up(3, ("a.doc", mib15 + 1), ("b.txt", 1)) + up(4, *[("a.txt", 1)] * 4) + up(5, (None, 1)))
    df = spark.createDataFrame(rows, UPLOADS)
    found = {r.upload_id: (r.accepted, r.reason, r.failed_pos) for r in uploads.upload_admission(df).collect()}
    assert found == {1: (True, None, None), 2: (False, "unsupported_type", 1), 3: (False, "too_large", 0),
                     4: (False, "too_many_files", None), 5: (False, "unsupported_type", 0)}
    assert {(r.upload_id, r.pos, r.chars) for r in uploads.upload_summary(df).collect()} == {
        (1, pos, 12000 + len(TRUNCATION_NOTE)) for pos in (0, 1)}


REQUEST = ("request_id bigint, project_title string, industry string, duration_months int, expected_users bigint, tech_stack array<string>, "
           "client_name string, compliance_requirements array<string>, current_sections string, edit_instruction string, sections string")


def request(spark, **changes):
    row = {"request_id": 1, "project_title": "abc", "industry": "it", "duration_months": 1, "expected_users": 10, "tech_stack": ["go"],
           "client_name": None, "compliance_requirements": None, "current_sections": "{}", "edit_instruction": "shorter", "sections": "{}"}
    return spark.createDataFrame([tuple({**row, **changes}.values())], REQUEST)


@pytest.mark.parametrize("changes, codes", [
    ({}, []), ({"project_title": "  a  "}, []), ({"project_title": "   "}, ["project_title:blank"]), ({"project_title": "ab"}, ["project_title:too_short"]),
    ({"project_title": None}, ["project_title:missing"]), ({"industry": "x" * 101}, ["industry:too_long"]),
    ({"duration_months": 61, "expected_users": 9}, ["duration_months:too_large", "expected_users:too_small"]),
    ({"expected_users": None}, ["expected_users:missing"]), ({"tech_stack": []}, ["tech_stack:too_few"]), ({"tech_stack": [" "]}, ["tech_stack:blank"]),
    ({"tech_stack": ["x"] * 16}, ["tech_stack:too_many"]), ({"client_name": "c" * 201}, ["client_name:too_long"]),
    ({"compliance_requirements": ["c"] * 11}, ["compliance_requirements:too_many"]),
])
def test_request_rules(spark, changes, codes):
    assert validation.validate_requests(request(spark, **changes)).first().violations == codes


def test_other_rules(spark):
    long_stack = {"tech_stack": ["x"] * 20}
    assert validation.validate_edits(request(spark, **long_stack)).first().violations == []
    assert validation.validate_edits(request(spark, current_sections=None, edit_instruction="cut")).first().violations == [
        "current_sections:missing", "edit_instruction:too_short"]
    assert validation.validate_prebuilt(request(spark, expected_users=1, tech_stack=None)).first().violations == []
    assert validation.validate_prebuilt(request(spark, expected_users=0, client_name="c" * 151, sections=None)).first().violations == [
        "expected_users:too_small", "client_name:too_long", "sections:missing"]


def test_split_keeps_every_row(spark):
    rows = request(spark).unionByName(request(spark, project_title="x")).unionByName(request(spark, tech_stack=[" go ", ""]))
    checked = validation.validate_requests(rows)
    assert validation.accepted(checked).count() + validation.quarantined(checked).count() == 3
    assert [r.tech_stack for r in validation.accepted(checked).collect()] == [["go"], ["go"]]


def test_registration(spark):
    df = spark.createDataFrame([("d" * 9, "a"), ("d" * 10, " a "), ("d" * 129, "a"), ("e" * 10, None), ("f" * 10, "n" * 81)], "device_id string, user_name string")
    assert [(r.device_id, r.user_name) for r in validation.registration_filter(df).collect()] == [("d" * 10, "a"), ("e" * 10, "")]
