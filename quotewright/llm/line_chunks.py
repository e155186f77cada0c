"""Removal of repeated runs of lines, cut at content-defined boundaries. Built-in expressions only.

A rolling hash over the hashes of the last WINDOW lines ends a chunk where it is
divisible by DIVISOR, so the same run of lines is cut alike wherever it stands. Chunks
of two or more lines are compared over all documents by digest first, without their
text; then the bytes of each candidate are compared with those of the first chunk of
its digest. The first one stays, the others go.

Chunks miss most passages of a few lines. ``passage_dedup`` adds every repeated run of
lines of over PASSAGE_WORDS words, wherever it begins: of each line
that is not blank, the shortest such run from it and the shortest up to it are compared
over all documents by SHA-256. These runs cover each longer one in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.binding import once
from quotewright.llm.common import order_id, possible, stored, whole, with_lists

WINDOW = 2
BASE = 31
DIVISOR = 4
LEAST_LINES = 2
#: A repeated run of lines goes if it has more words than this.
PASSAGE_WORDS = 50
#: Lines that hold a run nearly always; longer ones are summed up separately.
NEAR_LINES = 8


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5 digest as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def rolling(hashes: Column, end: Column) -> Column:
    """Polynomial over the hashes of the last WINDOW lines up to line ``end`` (from 1)."""
    terms = (F.coalesce(F.get(hashes, end - 1 - j), F.lit(0)) * BASE**j for j in range(WINDOW))
    return sum(terms, F.lit(0))


def joined(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("lines", start, length), "\n")


def chunks(docs: DataFrame) -> DataFrame:
    """start, length and digest of all chunks of LEAST_LINES lines or more; ``docs`` has did, text_id, text."""
    lines = once(docs.select("did", "text_id", F.split("text", "\n", -1).alias("lines")), {"hashes": F.transform("lines", line_hash)})
    n = F.size("lines")
    ended = once(lines, {
        "ends": F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (rolling(F.col("hashes"), i) % DIVISOR == 0))})
    bounds = F.zip_with(
        "ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)),
        lambda end, before: F.struct((before + 1).alias("start"), (end - before).alias("length")))
    long_enough = F.filter(bounds, lambda c: c["length"] >= LEAST_LINES)
    with_digest = F.transform(long_enough, lambda c: F.struct(
        c["start"].alias("start"), c["length"].alias("length"), F.md5(joined(c["start"], c["length"])).alias("digest")))
    return ended.select("did", "text_id", F.inline(with_digest))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Chunks that an earlier one equals byte by byte, as ``cuts`` (start, length) of each did and text_id."""
    all_chunks = chunks(docs)
    # written first, so that the joins read plain shuffles, whose hot keys Spark can split
    repeated = stored(
        all_chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("did", "start", "text_id")).alias("first"))
        .where("n > 1").drop("n"), "repeated-chunks")
    candidates = stored(
        all_chunks.join(repeated, "digest")
        .withColumn("leads", F.struct("did", "start") == F.struct("first.did", "first.start"))
        .where("not leads or text_id = first.text_id")
        .groupBy("did", "text_id").agg(F.collect_list(F.struct("start", "length", "digest", "leads")).alias("found")),
        "chunk-candidates")
    texts = with_lists(docs, candidates, "found", only=True).withColumn("lines", F.split("text", "\n", -1))
    texts = once(texts.drop("text"), {"pieces": F.transform("found", lambda c: c.withField("chunk", joined(c["start"], c["length"])))})
    texts = stored(texts.select("did", "text_id", F.inline("pieces")), "chunk-texts")
    first = stored(texts.where("leads").select("digest", F.col("chunk").alias("first_chunk")).dropDuplicates(["digest"]), "first-chunks")
    same = texts.where("not leads").join(first, "digest").where("chunk = first_chunk")
    return same.groupBy("did", "text_id").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))


def reach(words: Column, k: Column, within: int) -> Column:
    """Number of lines from line ``k`` (from 1) that have more than PASSAGE_WORDS words together; null if ``within`` have not."""
    summed = F.aggregate(
        F.slice(words, k, within), F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
        lambda acc, w: F.when(acc["words"] > PASSAGE_WORDS, acc).otherwise(F.struct((acc["words"] + w).alias("words"), (acc["lines"] + 1).alias("lines"))))
    return F.when(summed["words"] > PASSAGE_WORDS, summed["lines"])


def passages(docs: DataFrame) -> DataFrame:
    """Shortest runs of over PASSAGE_WORDS words from and up to each line: at, size (in lines that are not blank), spots and run.

    ``docs`` has did, text_id, text; ``spots`` are the numbers (from 1) of all lines that are not blank.
    """
    rows = once(docs.select("did", "text_id", F.split("text", "\n", -1).alias("all_lines")), {
        "spots": F.filter(F.sequence(F.lit(1), F.size("all_lines")), lambda i: F.get("all_lines", i - 1).rlike(r"\S"))})
    rows = once(rows, {"lines": F.transform("spots", lambda i: F.get("all_lines", i - 1))}).drop("all_lines")
    rows = once(rows, {"words": F.transform("lines", lambda x: F.size(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+")))})
    rows = once(rows.where("aggregate(words, 0, (a, w) -> a + w) > " + str(PASSAGE_WORDS)), {"back": F.reverse("words")})
    n, places = F.size("words"), F.sequence(F.lit(1), F.size("words"))

    def sizes(words: str) -> Column:
        # a line that is not blank has a word, so this many lines are enough
        return F.transform(places, lambda k: F.coalesce(reach(F.col(words), k, NEAR_LINES), reach(F.col(words), k, PASSAGE_WORDS + 1)))

    ahead = F.zip_with(places, sizes("words"), lambda k, size: F.struct(k.alias("at"), size.alias("size")))
    behind = F.zip_with(places, sizes("back"), lambda k, size: F.struct((n - k - size + 2).alias("at"), size.alias("size")))
    found = once(rows, {"found": F.array_distinct(F.filter(F.concat(ahead, behind), lambda r: r["size"].isNotNull()))})
    flat = found.select("did", "text_id", "spots", "lines", F.inline("found"))
    return flat.select("did", "text_id", "at", "size", "spots", joined(F.col("at"), F.col("size")).alias("run"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Runs of passages that an earlier one equals, as ``cuts`` (start, length) of each did and text_id."""
    runs = passages(docs)
    repeated = stored(runs.groupBy(F.xxhash64("run").alias("key")).count().where("count > 1").select("key"), "repeated-runs")
    maybe = possible(runs, F.xxhash64("run"), repeated).where("maybe")
    # the lines that a run spans, with blank ones inside, and the place of each line of it
    found = stored(maybe.select("did", "text_id", "at", "size", F.slice("spots", F.col("at"), F.col("size")).alias("spots"), F.unhex(F.sha2("run", 256)).alias("digest")), "runs")
    first = stored(
        found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("did", "at", "text_id")).alias("first")).where("n > 1").drop("n"), "first-runs")
    later = (
        found.join(first, "digest").where("did <> first.did or (text_id = first.text_id and at > first.at)")
        # of a run that overlaps its first one, in a text that repeats itself, only what lies beyond
        .withColumn("skip", F.when(F.col("did") == F.col("first.did"), F.greatest(F.lit(0), F.col("first.at") + F.col("size") - F.col("at"))).otherwise(0))
        .where("skip < size")
    )
    begin, end = F.get("spots", F.col("skip")), F.get("spots", F.col("size") - 1)
    cuts = later.select("did", "text_id", begin.alias("start"), (end - begin + 1).alias("length"))
    return cuts.groupBy("did", "text_id").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(order_id().alias("did"), F.xxhash64(whole()).alias("text_id"), whole().alias("text"), row.alias("row"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated chunks: all its columns with the new text, and lines_removed.

    The first of equal chunks, by doc_id and place, stays; lines outside such chunks
    stay as they are. n_chars, where there is such a column, follows the text. A text
    from which nothing goes is unchanged, a missing one stays missing. Rows without a
    doc_id come last and, like rows that share a doc_id, count as one document.
    """
    keyed = keyed_rows(docs)
    return without_lines(docs, keyed, stored(repeated_chunks(keyed.drop("row")), "cuts"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """As ``line_dedup``, but repeated passages of over PASSAGE_WORDS words go too, wherever they begin.

    Blank lines do not count in a passage; those inside one go with it.
    """
    keyed = keyed_rows(docs)
    both = repeated_chunks(keyed.drop("row")).union(repeated_passages(keyed.drop("row")))
    cuts = both.groupBy("did", "text_id").agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts"))
    return without_lines(docs, keyed, stored(cuts, "cuts"))


def without_lines(docs: DataFrame, keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """``docs`` without the lines of ``cuts``, and lines_removed; ``keyed`` are its ``keyed_rows``."""
    names = docs.columns
    lines = once(with_lists(keyed, cuts, "cuts"), {"lines": F.when(F.col("cuts").isNotNull(), F.split("text", "\n", -1))})
    gone = F.flatten(F.transform("cuts", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))
    kept = once(lines, {"kept": F.array_except(F.sequence(F.lit(1), F.size("lines")), gone)})
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i - 1)), "\n")
    cut = once(kept, {"new_text": text})
    changed = {"text": F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(F.col("new_text"))}
    if "n_chars" in names:
        n_chars = F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new_text"))
        changed["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    removed = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names], removed.alias("lines_removed"))


#: The same in SQL, for a table ``documents`` with distinct ids.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
hashed AS (SELECT *, CAST(concat('0x', substr(md5(line), 1, 8)) AS BIGINT) AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
ended AS (SELECT *, i = n OR (h + {BASE} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {DIVISOR} = 0 AS ends FROM hashed),
numbered AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended),
chunks AS (SELECT doc_id, chunk, min(i) AS start, count(*) AS length, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk),
ranked AS (SELECT *, length >= {LEAST_LINES} AND row_number() OVER (PARTITION BY length >= {LEAST_LINES}, body ORDER BY doc_id, start) > 1 AS gone FROM chunks),
rebuilt AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (WHERE NOT gone), '') AS body,
         CAST(coalesce(sum(length) FILTER (WHERE gone), 0) AS BIGINT) AS lines_removed FROM ranked GROUP BY doc_id)
SELECT doc_id, CASE WHEN lines_removed = 0 THEN text ELSE body END AS text, lang, source,
       CASE WHEN lines_removed = 0 THEN n_chars ELSE length(body) END AS n_chars, lines_removed
FROM documents JOIN rebuilt USING (doc_id)
"""
