"""Raw model replies to typed proposal sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.binding import let, once_compiled
from quotewright.functions.json import map_variant
from quotewright.functions.text import SPACE, clean_text, strip, strip_column
from quotewright.operators.risks import normalise_impact
from quotewright.operators.timeline import rescale_array

# Section names and markers.
SECTIONS = (
    "executive_summary", "technical_approach", "timeline", "risk_assessment", "deliverables",
)
MISSING = "N/A"
_END = "end-of-reply"


def _paired(text: Column) -> Column:
    """``text`` parsed as the first element of a pair.

    ``try_parse_json`` ignores what follows the first value, so the second element,
    a mark, must survive (``_first``).
    """
    # Text that cannot start a JSON value is not tried; a failed parse is costly.
    candidate = F.when(text.rlike(r'^\s*[\[{"\-0-9tfn]'), text)
    return F.try_parse_json(F.concat(F.lit("["), candidate, F.lit(f', "{_END}"]')))


def _first(pair: Column) -> Column:
    """The value in a pair, or NULL if more than one value was in its text."""
    alone = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    return F.when(alone, F.try_variant_get(pair, "$[0]", "variant"))


def _whole_json(text: Column) -> Column:
    """``text`` as a variant if all of it is one JSON value, else NULL."""
    return let(_paired(text), _first)


def _unfenced(raw: Column) -> Column:
    return F.replace(F.regexp_replace(raw, f"(?U)```(?:json)?{SPACE}*", ""), F.lit("```"), F.lit(""))


def _in_braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def extract_json(raw: Column) -> Column:
    """The JSON value of a reply: without code fences, else from first to last brace."""
    return let(strip(_unfenced(raw)), lambda text: F.coalesce(_whole_json(text), _whole_json(_in_braces(text))))


def _extracted(responses: DataFrame) -> DataFrame:
    """Add ``_json``, as ``extract_json`` finds it in ``raw``, and ``_text``, the text it was read from.

    One step per column: a lambda that binds a step would be interpreted with all in it.
    """
    raw, text, whole = F.col("raw"), F.col("_bare"), F.col("_whole")
    steps = responses.withColumn("_bare", F.when(F.contains(raw, F.lit("```")), _unfenced(raw)).otherwise(raw))
    steps = steps.withColumn("_bare", strip_column("_bare")).withColumn("_pair", _paired(text))
    steps = steps.withColumn("_whole", _first(F.col("_pair")))
    steps = steps.withColumn("_braces", F.when(whole.isNull(), _in_braces(text)))
    steps = steps.withColumn("_pair", _paired(F.col("_braces")))
    return once_compiled(steps, {
        "_json": F.coalesce(whole, _first(F.col("_pair"))), "_text": F.when(whole.isNull(), F.col("_braces")).otherwise(text),
    }).drop("_bare", "_pair", "_whole", "_braces")


def _kind(value: Column) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    schema = F.schema_of_variant(value)
    return F.substring_index(F.substring_index(schema, "<", 1), "(", 1)


# The list sections and their types. A list entry that is not an
# object reads as NULL; weeks stay untyped to tell numbers apart.
LIST_TYPES = {
    "timeline": "array<struct<phase:string, weeks:variant, description:string>>",
    "risk_assessment": "array<struct<risk:string, impact:string, probability:string, mitigation:string>>",
    "deliverables": "array<string>",
}

# Type names used in error texts, by variant kind.
TYPE_NAMES = (
    ("ARRAY", "list"), ("OBJECT", "dict"), ("STRING", "str"), ("BIGINT", "int"),
    ("DECIMAL", "float"), ("DOUBLE", "float"), ("BOOLEAN", "bool"), ("VOID", "NoneType"),
)


def _type_name(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_NAMES for x in pair]), kind)


def _week_error(kinds: Column) -> Column:
    """The error text for the first kind that is not a number, or NULL."""
    bad = F.get(F.filter(kinds, lambda k: k.isin("STRING", "VOID", "ARRAY", "OBJECT")), F.lit(0))
    before = F.slice(kinds, F.lit(1), F.array_position(kinds, bad).cast("int") - 1)
    left = F.when(F.exists(before, lambda k: k.isin("DECIMAL", "DOUBLE")), "float").otherwise("int")
    return F.when(bad.isNotNull(), F.concat(
        F.lit("Unexpected error: TypeError: unsupported operand type(s) for +: '"), left,
        F.lit("' and '"), _type_name(bad), F.lit("'"),
    ))


def _reply_kind(value: Column, text: Column) -> Column:
    """``_kind`` of a value read from ``text``, which shows containers at its first sign."""
    inner = F.when(F.startswith(text, F.lit("{")), "OBJECT").when(F.startswith(text, F.lit("[")), "ARRAY").otherwise(_kind(value))
    return F.when(value.isNotNull(), inner)


def _is_blank(value: Column, kind: Column, text: Column) -> Column:
    """Values that count as no reply: empty containers and text, zero, false, null. ``text`` is what was read."""
    number = kind.isin("BIGINT", "DECIMAL", "DOUBLE")
    container = kind.isin("OBJECT", "ARRAY")
    return (kind == "VOID") | F.when(number, value.try_cast("double") == 0).when(
        container, text.rlike(r"^[\[{][ \t\r\n]*[\]}]\z")
    ).otherwise(F.to_json(value).isin('""', "false"))


def _phase(p: Column, text: Column) -> Column:
    return F.struct(
        p.isNotNull().alias("is_object"),
        clean_text(F.when(p.isNull(), text).otherwise(p["phase"])).alias("phase"),
        p["weeks"].try_cast("double").alias("weeks"),
        clean_text(p["description"]).alias("description"),
    )


def _risk(r: Column, text: Column) -> Column:
    return F.struct(
        r.isNotNull().alias("is_object"),
        clean_text(F.when(r.isNull(), text).otherwise(r["risk"])).alias("risk"),
        F.when(r.isNotNull(), normalise_impact(clean_text(r["impact"]))).alias("impact"),
        clean_text(r["probability"]).alias("probability"),
        clean_text(r["mitigation"]).alias("mitigation"),
    )


def clean_value(value: Column) -> Column:
    """A variant with every text in it cleaned, at any depth; keys and other values stay."""
    return map_variant(value, clean_text)


def parse_response(responses: DataFrame, wanted: tuple[str, ...] = SECTIONS) -> DataFrame:
    """The ``wanted`` sections and a ``status`` (ok, fallback_text, error) for every reply.

    Needs ``raw`` and ``expected_weeks``. List sections also have a ``_text``
    column, set when the section is not a list. Nothing is shuffled, and a bad
    reply is a row with an error text, not a failed task. ``sections`` is the whole
    reply, cleaned at any depth, with the keys that no column shows.
    """
    json, kind, reply = F.col("_json"), F.col("_kind"), F.col("_text")
    typed = {name: F.col(f"_{name}") for name in LIST_TYPES}

    def listed(name: str) -> Column:
        return F.when(kind == "OBJECT", F.try_variant_get(json, f"$.{name}", LIST_TYPES[name]))

    parsed = once_compiled(_extracted(responses), {"_kind": _reply_kind(json, reply)})
    parsed = once_compiled(parsed, {"_blank": json.isNull() | _is_blank(json, kind, reply), "_timeline": listed("timeline")})
    week_kinds = F.transform(
        F.filter(typed["timeline"], lambda p: p.isNotNull()),
        lambda p: F.coalesce(_kind(p["weeks"]), F.lit("BIGINT")),
    )
    parsed = once_compiled(parsed, {"_weeks": F.when(F.col("expected_weeks") > 0, week_kinds)})
    error = F.when(F.col("_blank"), F.lit(None).cast("string")).when(
        kind != "OBJECT",
        F.concat(
            F.lit("Unexpected error: AttributeError: '"), _type_name(kind),
            F.lit("' object has no attribute 'get'"),
        ),
    ).otherwise(_week_error(F.col("_weeks")))
    parsed = once_compiled(parsed, {"_error": error})
    status = F.when(F.col("_blank"), "fallback_text").when(F.col("_error").isNotNull(), "error").otherwise("ok")
    plain = F.when(F.col("_blank"), clean_text(F.col("raw"))).otherwise(F.col("_error"))
    routed = once_compiled(parsed, {"status": status, "_plain": plain})
    routed = routed.withColumns({f"_{name}": listed(name) for name in LIST_TYPES if name != "timeline"})
    ok = F.col("status") == "ok"

    def text_of(name: str) -> Column:
        absent = F.try_variant_get(json, f"$.{name}", "variant").isNull()
        text = clean_text(F.try_variant_get(json, f"$.{name}", "string"))
        return F.when(~ok, F.col("_plain")).when(absent, MISSING).otherwise(text)

    columns = {name: text_of(name) for name in SECTIONS[:2]}
    for name, convert in (("timeline", _phase), ("risk_assessment", _risk)):
        # Texts of the entries, needed where one is not an object.
        texts = F.when(
            F.exists(typed[name], lambda e: e.isNull()), F.try_variant_get(json, f"$.{name}", "array<string>")
        ).otherwise(F.array().cast("array<string>"))
        columns[name] = F.when(ok, F.zip_with(typed[name], texts, convert))
    columns["deliverables"] = F.when(ok, F.transform(typed["deliverables"], clean_text))
    for name in SECTIONS[2:]:
        columns[f"{name}_text"] = F.when(~ok | typed[name].isNull(), text_of(name))
    columns = {c: column for c, column in columns.items() if c.removesuffix("_text") in wanted}
    # Few sections are computed once, whatever uses them; of all of them, those that nobody reads are left out.
    sections = once_compiled(routed, columns) if len(wanted) < len(SECTIONS) else routed.withColumns(columns)
    sections = sections.drop(
        "_kind", "_text", "_blank", "_weeks", "_error", "_plain", "raw", *[f"_{name}" for name in LIST_TYPES]
    )
    weeks = F.col("expected_weeks").cast("double")
    if "timeline" in wanted:
        sections = sections.withColumn(
            "timeline", F.when(weeks > 0, rescale_array(F.col("timeline"), weeks)).otherwise(F.col("timeline")))
    return sections.withColumn("sections", clean_value(json)).drop("_json")


def section_digest(sections_json: Column, limit: int = 400) -> Column:
    """One line per section: the start of a text, the size of a list, a mark for the rest."""

    def line(name: Column, value: Column) -> Column:
        kind = _kind(value)
        text = F.concat(F.lit('"'), F.left(value.try_cast("string"), F.lit(limit)), F.lit('..."'))
        items = F.size(value.try_cast("array<variant>")).cast("string")
        shown = F.when(kind == "STRING", text).when(
            kind == "ARRAY", F.concat(F.lit("[... "), items, F.lit(" items ...]"))
        ).otherwise("<...>")
        return F.concat(F.lit('  "'), name, F.lit('": '), shown)

    def lines(values: Column) -> Column:
        # The variant sorts its keys; the key list keeps the order of the text.
        return F.transform(
            F.json_object_keys(sections_json),
            lambda name: let(F.element_at(values, name), lambda value: line(name, value)),
        )

    by_name = F.try_parse_json(sections_json).try_cast("map<string,variant>")
    return F.concat(F.lit("{\n"), F.array_join(let(by_name, lines), ",\n"), F.lit("\n}"))


def read_sections(proposals: DataFrame) -> DataFrame:
    """Stored sections per proposal; NULL when there are none or they are not JSON."""
    return proposals.select("id", _whole_json(F.col("sections_json")).alias("sections"))
