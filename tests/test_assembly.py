"""Texts from many lines, and aliases as a table, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quotewright import seeds
from quotewright.functions.industry import resolve_industry
from quotewright.operators import aliases, assembly

ROWS = "doc_id int, sheet_no int, sheet string, row_no int, cells array<string>"


def workbook(rng):
    rows = []
    for doc in range(6):
        for sheet in range(rng.randint(1, 3)):
            n = rng.choice([0, 1, 30, 200])
            rows += [(doc, sheet, f"S{sheet}", None, None)] if not n else []
            rows += [(doc, sheet, f"S{sheet}", i, [rng.choice(["", "a", " b ", None, "🙂"]) for _ in range(rng.randint(0, 4))]) for i in range(n)]
    return rows


def sheet_text(rows, doc):
    out = []
    for sheet in sorted({r[1] for r in rows if r[0] == doc}):
        out.append(f"[Sheet: S{sheet}]")
        for r in sorted((r for r in rows if r[:2] == (doc, sheet) and r[3] is not None), key=lambda r: r[3]):
            cells = ["" if c is None else c for c in r[4]]
            if any(cells):
                out.append(" | ".join(cells))
    return "\n".join(out)


@pytest.mark.parametrize(("limit", "block"), [(None, 7), (None, 4096), (40, 7), (3, 1)])
def test_sheets(spark, limit, block):
    rows = workbook(random.Random(3))
    df = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), ROWS)
    found = {r.doc_id: (r.text, r.chars) for r in assembly.assembled(assembly.sheet_lines(df), limit, block).collect()}
    want = {d: sheet_text(rows, d) for d in {r[0] for r in rows}}
    assert found == {d: (t[:limit], len(t)) for d, t in want.items()}


def test_word_documents(spark):
    paragraphs = spark.createDataFrame([(1, 1, " b "), (1, 0, "a"), (1, 2, "  "), (2, 0, None)], "doc_id int, at int, text string")
    cells = spark.createDataFrame([(1, 0, [" x ", "", "y"]), (1, 1, ["", " "]), (2, 0, ["z"])], "doc_id int, at int, cells array<string>")
    found = {r.doc_id: r.text for r in assembly.assembled(assembly.word_lines(paragraphs, cells)).collect()}
    assert found == {1: "a\nb\nx | y", 2: "z"}


def test_a_sheet_of_a_million_rows(spark):
    rows = spark.range(1_000_000, numPartitions=8).select(
        F.lit(1).alias("doc_id"), F.lit(0).alias("sheet_no"), F.lit("S").alias("sheet"), F.col("id").alias("row_no"), F.array(F.col("id").cast("string"), F.lit("x")).alias("cells"))
    lines = assembly.sheet_lines(rows)
    whole = assembly.assembled(lines).select("chars", F.sha2("text", 256).alias("sha")).first()
    text = "\n".join(["[Sheet: S]", *[f"{i} | x" for i in range(1_000_000)]])
    import hashlib

    assert (whole.chars, whole.sha) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    cut = assembly.assembled(lines, limit=12_000).first()
    assert (cut.text, cut.chars) == (text[:12_000], len(text))


ALIASES = "ord int, alias string, industry string"


def by_hand(keys, canonical, rows):
    out = {}
    for raw in keys:
        k = None if raw is None else raw.strip().lower()
        exact = {a: i for _, a, i in sorted(rows, reverse=True)}
        near = [i for _, a, i in sorted(rows) if k is not None and (a in k or k in a)]
        out[raw] = k if k in canonical else exact.get(k) if k in exact else near[0] if near else None
    return out


def test_aliases_of_any_length(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n)).strip()
    rows = [(i, a, f"i{i % 9}") for i, a in enumerate(sorted({word(rng.randint(1, 9)) for _ in range(120)} - {""}, key=lambda _: rng.random()))]
    keys = list({word(rng.randint(0, 12)) for _ in range(300)} | {"", " ABA ", "i3"}) + [None]
    df = spark.createDataFrame([(k,) for k in keys], "industry string")
    canonical = spark.createDataFrame([("i3",), ("aba",)], "industry string")
    found = aliases.resolve_by_table(df, canonical, spark.createDataFrame(rows, ALIASES))
    assert {r.industry: r.resolved for r in found.collect()} == by_hand(keys, {"i3", "aba"}, rows)


@pytest.mark.parametrize("raw", ["cost", "prompts"])
def test_seed_aliases_as_a_table(spark, raw):
    table = {"cost": seeds.COST_ALIASES, "prompts": seeds.KB_ALIASES}[raw]
    keys = ["", "it", "Development", "Retail Analytics", " retail banking ", "AUTOMOBILE", "Technology", "maritime", "x", "ev", "HOUSEHOLD", "ai_ml", None]
    df = spark.createDataFrame([(k,) for k in keys], "industry string")
    found = aliases.resolve_by_table(df, seeds.industry_multipliers(spark), seeds.industry_aliases(spark, table))
    rows = found.select("industry", "resolved", resolve_industry(F.col("industry"), table).alias("want")).collect()
    assert len(rows) == len(keys) and all(r.resolved == r.want for r in rows)


def test_many_aliases_without_a_nested_loop(spark):
    """100 000 aliases, some of which begin alike, and one key with most of the requests."""
    rows = spark.range(100_000).select(
        F.col("id").alias("ord"), F.concat(F.when(F.col("id") % 3 == 0, "sup").otherwise(F.left(F.md5(F.col("id").cast("string")), F.lit(6))), F.col("id").cast("string")).alias("alias"),
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("industry"))
    asked = spark.range(30_000).select(F.when(F.col("id") < 20_000, "the sup300 team").otherwise(F.concat(F.lit("Sup"), (F.col("id") % 50 * 3).cast("string"))).alias("industry"))
    found = aliases.resolve_by_table(asked, spark.createDataFrame([("none",)], "industry string"), rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.industry, r.resolved): r["count"] for r in found.groupBy("industry", "resolved").count().collect()}
    # "sup3" comes before "sup30" and "sup300" in the table; equal aliases win for short keys
    assert got["the sup300 team", "i3"] == 20_000 and len(got) == 51 and got["Sup147", "i147"] == 200
