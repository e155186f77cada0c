"""Texts put together from many ordered lines, such as the rows of a workbook.

One list of all lines of a document would gather in one task, however long it is. Lines
are joined per block of positions first, blocks are measured, and only those that a
``limit`` of characters lets in are merged in order. So a task holds a block of lines, or the
blocks of one text within its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions.money import div
from quotewright.functions.text import join_cells, strip

#: Lines that are joined at once.
BLOCK_LINES = 4_096
# Header line of a sheet.
SHEET_HEADER = ("[Sheet: ", "]")


def sheet_lines(rows: DataFrame) -> DataFrame:
    """doc_id, part, at and line of workbooks given as rows (doc_id, sheet_no, sheet, row_no, cells).

    Each sheet begins with its header, also one without rows (a row whose ``row_no`` is
    missing). Rows of blank cells leave no line; row numbers from 0 on.
    """
    header = F.concat(F.lit(SHEET_HEADER[0]), F.col("sheet"), F.lit(SHEET_HEADER[1]))
    headers = rows.groupBy("doc_id", "sheet_no").agg(F.min("sheet").alias("sheet")).select(
        "doc_id", F.col("sheet_no").alias("part"), F.lit(-1).cast("bigint").alias("at"), header.alias("line"))
    lines = rows.where("row_no IS NOT NULL").select(
        "doc_id", F.col("sheet_no").alias("part"), F.col("row_no").cast("bigint").alias("at"), join_cells(F.col("cells"), keep_blanks=True).alias("line"))
    return headers.unionByName(lines.where("line IS NOT NULL"))


def word_lines(paragraphs: DataFrame, table_rows: DataFrame) -> DataFrame:
    """The same for word documents: paragraphs (doc_id, at, text), then table rows (doc_id, at, cells); blank ones leave no line."""
    text = paragraphs.select("doc_id", F.lit(0).alias("part"), F.col("at").cast("bigint").alias("at"), strip(F.col("text")).alias("line"))
    rows = table_rows.select("doc_id", F.lit(1).alias("part"), F.col("at").cast("bigint").alias("at"), join_cells(F.col("cells")).alias("line"))
    return text.unionByName(rows).where(F.coalesce("line", F.lit("")) != "")


def _joined(order: list[str], value: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    return F.array_join(F.transform(rows, lambda r: r[value]), "\n")


def assembled(lines: DataFrame, limit: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """doc_id, text of the lines in order of (part, at), and chars, the length that all of it has.

    With ``limit`` the text is cut after so many characters; blocks behind it are never
    gathered. Without it, a text has to fit in one row.
    """
    block = div(F.col("at") + 1, block_lines).alias("block")
    blocks = lines.select("doc_id", "part", "at", "line", block).groupBy("doc_id", "part", "block").agg(_joined(["at"], "line").alias("lines"))
    measured = blocks.withColumn("size", F.length("lines").cast("bigint") + 1)
    before = Window.partitionBy("doc_id").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = measured.select("doc_id", "part", "block", "size").withColumn("begins", F.coalesce(F.sum("size").over(before), F.lit(0)))
    totals = sizes.groupBy("doc_id").agg((F.sum("size") - 1).alias("chars"))
    kept = measured if limit is None else measured.join(
        sizes.where(F.col("begins") < limit).select("doc_id", "part", "block"), ["doc_id", "part", "block"], "left_semi")
    texts = kept.groupBy("doc_id").agg(_joined(["part", "block"], "lines").alias("text"))
    cut = F.col("text") if limit is None else F.left("text", F.lit(limit))
    return texts.join(totals, "doc_id").select("doc_id", cut.alias("text"), "chars")
