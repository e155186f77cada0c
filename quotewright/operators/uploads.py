"""Uploaded documents: admission, sessions of ten minutes, and prompt context.

Sessions, positions and what a request sees come from one segmented scan over the
uploads and requests of each device in order of time (``segments``). The scan knows
lengths only; texts are read once, when a context is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.dates import epoch_micros, from_epoch_micros
from quotewright.functions.text import (
    content_tag, file_ext, preview_text, truncate_text, wrap_document, wrapped_chars,
)
from quotewright.operators.segments import SEGMENT, before, earlier_segments, in_segments, upto, within, written

# Upload limits.
MAX_FILES = 3
MAX_BYTES = 15 * 1024 * 1024
EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx")
TTL_US = 600 * 1_000_000

SEPARATOR = "\n\n"
#: Characters of documents that a context holds at most; later documents are left out and counted.
CONTEXT_CHARS = 1_000_000
#: Order of a device's rows: uploads come before requests of the same instant.
_ORDER = ["us", "kind", "first", "second", "row"]


def upload_admission(files: DataFrame) -> DataFrame:
    """One verdict per upload request; the first failing file decides.

    A request is accepted or rejected as a whole.
    """
    ext = file_ext(F.coalesce("filename", F.lit("")))
    reason = F.when(~ext.isin(*EXTENSIONS), "unsupported_type").when(
        F.col("size_bytes") > MAX_BYTES, "too_large"
    )
    verdicts = files.groupBy("device_id", "upload_id").agg(
        F.count("*").alias("files"),
        F.min(F.when(reason.isNotNull(), F.struct(F.col("pos").alias("pos"), reason.alias("reason")))).alias("bad"),
    )
    too_many = F.col("files") > MAX_FILES
    return verdicts.select(
        "device_id", "upload_id", "files",
        F.when(too_many, "too_many_files").otherwise(F.col("bad.reason")).alias("reason"),
        F.when(~too_many, F.col("bad.pos")).alias("failed_pos"),
        (~too_many & F.col("bad").isNull()).alias("accepted"),
    )


def _accepted(rows: DataFrame, files: DataFrame) -> DataFrame:
    verdicts = upload_admission(files).where("accepted").select("device_id", "upload_id")
    return rows.join(verdicts, ["device_id", "upload_id"], "left_semi")


def admitted(files: DataFrame) -> DataFrame:
    """Files of accepted uploads, with their text cut to the limit and its length.

    Both are computed before the join, so that whole texts are not shuffled and
    uses of the length alone move no text at all.
    """
    cut = files.withColumn("text", truncate_text(F.col("text")))
    return _accepted(cut.withColumn("text_chars", F.length("text").cast("bigint")), files)


def upload_summary(files: DataFrame) -> DataFrame:
    """Characters kept and a preview for each admitted file."""
    cut = truncate_text(F.col("text"))
    shown = files.select(
        "device_id", "upload_id", "pos", "filename", F.length(cut).alias("chars"), preview_text(cut).alias("preview")
    )
    return _accepted(shown, files).select("upload_id", "pos", "filename", "chars", "preview")


def staged(uploads: DataFrame) -> DataFrame:
    """``uploads`` written once with a number for each row, so that lengths can be read without the texts."""
    if "row" in uploads.columns:
        return uploads
    return written(uploads.withColumns({"text_chars": _text_chars(uploads), "row": F.monotonically_increasing_id()}), "uploads")


def _text_chars(uploads: DataFrame) -> Column:
    return F.col("text_chars") if "text_chars" in uploads.columns else F.length("text").cast("bigint")


def owned(rows: DataFrame) -> DataFrame:
    """Rows of a known device. Uploads without one belong to nobody and are in no session."""
    return rows.where(F.col("device_id") != "")


def _events(rows: DataFrame, kind: int, **values: Column) -> DataFrame:
    return owned(rows).select(
        "device_id", epoch_micros(F.col("ts")).alias("us"), F.lit(kind).alias("kind"), *[v.cast("bigint").alias(n) for n, v in values.items()])


def _uploaded(uploads: DataFrame) -> DataFrame:
    """The uploads as rows of the scan; ``chars`` is what a document takes in a context with the separator after it."""
    size = wrapped_chars(F.col("filename"), F.col("text_chars")) + len(SEPARATOR)
    return _events(uploads, 0, first=F.col("upload_id"), second=F.col("pos"), row=F.col("row"), chars=size, text_chars=F.col("text_chars"))


def _asked(requests: DataFrame) -> DataFrame:
    return _events(requests, 1, first=F.col("request_id"), second=F.lit(0), row=F.lit(0), chars=F.lit(None), text_chars=F.lit(None))


def _scanned(events: DataFrame, segments: int | None) -> DataFrame:
    """Add to every row what its device uploaded up to it.

    ``docs`` and ``taken`` count documents and their characters, ``last_us`` is the time
    of the latest one, and ``session`` has the start of that one's session with the
    documents and characters before it. A session starts at a document without an
    earlier one in the last ten minutes.
    """
    rows = in_segments(events, "device_id", _ORDER, "upload-scan", segments)
    window = within("device_id", _ORDER)
    doc_us = F.when(F.col("kind") == 0, F.col("us"))
    here = rows.withColumns({
        "docs": F.count("chars").over(upto(window)),
        "taken": F.coalesce(F.sum("chars").over(upto(window)), F.lit(0)),
        "last_us": F.max(doc_us).over(upto(window)),
        "_previous": F.max(doc_us).over(before(window)),
    })
    # starts that the segment knows by itself: all but that of its first document
    start = F.when(doc_us - F.col("_previous") > TTL_US, _session(F.col("us"), F.col("docs") - 1, F.col("taken") - F.col("chars")))
    here = here.withColumn("_start", start).withColumn("_open", F.max("_start").over(upto(window))).drop("_start", "_previous")

    totals = here.groupBy("device_id", SEGMENT).agg(
        F.count("chars").alias("_n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("_chars"),
        F.min(doc_us).alias("_first"), F.max(doc_us).alias("_last"), F.max("_open").alias("_opened"))
    earlier = earlier_segments("device_id")
    chained = totals.withColumns({
        "_docs_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
        "_chars_before": F.coalesce(F.sum("_chars").over(earlier), F.lit(0)),
        "_last_before": F.max("_last").over(earlier),
    })
    fresh = F.col("_last_before").isNull() | (F.col("_first") - F.col("_last_before") > TTL_US)
    shift = lambda s: F.when(s.isNotNull(), _session(
        s["start_us"], s["docs"] + F.col("_docs_before"), s["taken"] + F.col("_chars_before")))
    chained = chained.withColumn(
        "_first_open", F.when(F.col("_first").isNotNull() & fresh, _session(F.col("_first"), F.col("_docs_before"), F.col("_chars_before"))))
    in_force = F.coalesce(shift(F.col("_opened")), F.col("_first_open"))
    chained = chained.withColumn("_in_force", in_force).withColumn("_carried", F.max("_in_force").over(earlier))
    fixes = ["_docs_before", "_chars_before", "_last_before", "_first_open", "_carried"]
    joined = here.join(chained.select("device_id", SEGMENT, *fixes), ["device_id", SEGMENT])
    at_first = F.when(F.col("docs") > 0, F.col("_first_open"))
    return joined.withColumn("session", F.coalesce(shift(F.col("_open")), at_first, F.col("_carried"))).withColumns({
        "docs": F.col("docs") + F.col("_docs_before"), "taken": F.col("taken") + F.col("_chars_before"),
        "last_us": F.coalesce("last_us", "_last_before"),
    }).drop("_open", *fixes)


def _session(start_us: Column, docs: Column, taken: Column) -> Column:
    return F.struct(start_us.alias("start_us"), docs.cast("bigint").alias("docs"), taken.cast("bigint").alias("taken"))


def _places(scanned: DataFrame) -> DataFrame:
    """Session, position and end of each document in its session's context."""
    return scanned.where("kind = 0").select(
        "row", "device_id", "us", F.col("session.start_us").alias("start_us"),
        (F.col("docs") - F.col("session.docs")).alias("position"),
        (F.col("taken") - F.col("session.taken") - len(SEPARATOR)).alias("ends"), "text_chars")


def _seen(scanned: DataFrame) -> DataFrame:
    """What each request sees: start of the open session, its documents so far, and their length."""
    open_ = F.col("us") - F.col("last_us") <= TTL_US
    return scanned.where("kind = 1").withColumn("session", F.when(open_, F.col("session"))).select(
        F.col("first").alias("request_id"), "device_id", F.col("session.start_us").alias("start_us"),
        F.coalesce(F.col("docs") - F.col("session.docs"), F.lit(0)).alias("docs_available"),
        F.greatest(F.coalesce(F.col("taken") - F.col("session.taken"), F.lit(0)) - len(SEPARATOR), F.lit(0)).alias("context_chars"))


def upload_sessions(uploads: DataFrame, segments: int | None = None) -> DataFrame:
    """Files, characters and time range of each session; a gap over ten minutes starts a new one."""
    places = _places(_scanned(_uploaded(staged(uploads)), segments))
    return places.groupBy("device_id", "start_us").agg(
        F.count("*").alias("files"), F.sum("text_chars").alias("chars"), F.max("us").alias("last_us")
    ).select(
        "device_id", from_epoch_micros(F.col("start_us")).alias("session_start"),
        from_epoch_micros(F.col("last_us") + TTL_US).alias("session_end"), "files", "chars",
    )


def _parts(docs: DataFrame, places: DataFrame, salt: str) -> DataFrame:
    """The documents of ``places`` as prompt text: device_id, start_us, position, part."""
    part = wrap_document(F.col("filename"), F.col("text"), content_tag(F.col("device_id"), salt))
    return docs.select("row", "filename", "text").join(places, "row").select("device_id", "start_us", "position", part.alias("part"))


def upload_context(uploads: DataFrame, salt: str, segments: int | None = None) -> DataFrame:
    """Every document of each session as prompt text, with its position by arrival.

    A request sees the first ``docs_available`` of them (``request_upload_state``),
    joined by SEPARATOR.
    """
    docs = staged(uploads)
    parts = _parts(docs, _places(_scanned(_uploaded(docs), segments)), salt)
    return parts.select("device_id", from_epoch_micros(F.col("start_us")).alias("session_start"), "position", "part")


def request_upload_state(requests: DataFrame, uploads: DataFrame, segments: int | None = None) -> DataFrame:
    """What each request sees: the open session, its documents so far and their text length.

    No request is paired with single documents. A request without a device sees nothing.
    """
    docs = staged(uploads)
    found = _seen(_scanned(_uploaded(docs).unionByName(_asked(requests)), segments)).select(
        "request_id", "device_id", from_epoch_micros(F.col("start_us")).alias("session_start"), "docs_available", "context_chars")
    nothing = requests.where(~F.coalesce(F.col("device_id") != "", F.lit(False))).select(
        "request_id", "device_id", F.lit(None).cast(found.schema["session_start"].dataType).alias("session_start"),
        F.lit(0).cast("bigint").alias("docs_available"), F.lit(0).cast("bigint").alias("context_chars"),
    )
    return found.unionByName(nothing)


def with_reference_text(
    requests: DataFrame, uploads: DataFrame, salt: str, limit: int = CONTEXT_CHARS, segments: int | None = None
) -> DataFrame:
    """Add ``reference_text``: the documents of the device's open session that came before the request.

    A prefix join. Documents and requests are scanned together once; a request learns how
    many documents of which session it sees. Each session that is asked for is put
    together once, as the array of its documents within ``limit`` characters, so its row is bounded
    however many documents it has. The requests meet it in an equi-join and take the first
    ones; their texts never go through a shuffle once per request, and a session with very
    many requests is split by the adaptive planner. Documents beyond ``limit`` are counted in a last line.
    ``requests`` needs request_id (unique), device_id and ts. Without documents the text is empty.
    """
    docs = staged(uploads)
    # written once: the sample for the ranges, the scan, and requests with and without documents all read them
    requests = written(requests, "requests")
    scanned = written(_scanned(_uploaded(docs).unionByName(_asked(requests)), segments), "scanned")
    seen = _seen(scanned).where("docs_available > 0").select("request_id", "start_us", "docs_available")
    asked = requests.join(seen, "request_id", "left")
    wanted = _places(scanned).where(F.col("ends") <= limit).join(
        _seen(scanned).where("docs_available > 0").select("device_id", "start_us").distinct(), ["device_id", "start_us"], "left_semi")
    sessions = _parts(docs, wanted, salt).groupBy("device_id", "start_us").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "part"))), lambda p: p["part"]).alias("_parts"))
    left_out = F.col("docs_available") - F.size("_held")
    more = F.when(left_out > 0, F.concat(F.lit("["), left_out.cast("string"), F.lit(" more documents left out]")))
    held = F.slice(F.coalesce("_parts", F.array().cast("array<string>")), 1, F.col("docs_available").cast("int"))
    text = F.concat_ws(SEPARATOR, F.array_join("_held", SEPARATOR), more)
    # requests that see nothing have no session and stay out of the join with the texts
    sees = F.col("docs_available").isNotNull()
    with_docs = asked.where(sees).join(sessions, ["device_id", "start_us"], "left").withColumn("_held", held).withColumn(
        "reference_text", F.when(F.size("_held") > 0, text).otherwise(more))
    without = asked.where(~sees).withColumn("reference_text", F.lit(""))
    columns = [*requests.columns, "reference_text"]
    return with_docs.select(columns).unionByName(without.select(columns))
