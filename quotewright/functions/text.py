"""Text rules as column expressions. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# The characters counted as white space (the Unicode set plus the
# four ASCII separators), as characters and as regex classes. SPACE is the fast
# form for Java patterns and needs (?U); SPACE_CLASS is for any dialect.
# --------------------------------------------------------------------------
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = r"[\s\x1c-\x1f]"

# --------------------------------------------------------------------------
# Markdown and injection patterns, size limits, marker texts.
# --------------------------------------------------------------------------
HEADING = f"#{{1,6}}{SPACE}*"
LINE_BULLET = f"^{SPACE}*[-*+]{SPACE}+"
LINK = r"\[([^\]]+)\]\([^)]+\)"
REDACTED = "[REDACTED]"
INJECTION = (
    rf"(ignore|forget|disregard|override){SPACE}+(previous|prior|above|all|any)"
    rf"{SPACE}*(instructions?|rules?|context|constraints?|prompts?)"
)
INJECTION_STRICT = (
    rf"(ignore|forget|disregard|override)({SPACE}+(previous|prior|above|all|any|the|your))+"
    rf"{SPACE}*(instructions?|rules?|context|constraints?|prompts?)"
)
EDIT_INJECTION = (
    rf"(ignore|forget|disregard){SPACE}+(all|previous|prior|above)"
    rf"{SPACE}*(instructions?|rules?|context)"
)
ROLE_MARKER = rf"(^|\n){SPACE}*(SYSTEM|ASSISTANT|USER){SPACE}*:"
TEXT_LIMIT = 12_000
TRUNCATION_NOTE = "\n... [truncated to 12000 chars]"
PREVIEW_LIMIT = 500
LABEL_LIMIT = 28

# Characters replaced before the Latin-1 fold.
FOLD_SINGLE = ("\u2014\u2013\u2012\u2011\u2019\u2018\u201c\u201d\u00a0\u2022\u00e2", "----''\"\" -a")
FOLD_MULTI = (("\u2026", "..."), ("\u20b9", "Rs."), ("\u2192", "->"))
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
NOT_LATIN1 = r"[^\x{00}-\x{ff}]"


def strip(c: Column) -> Column:
    """Trim every kind of white space; Spark's plain ``trim`` only drops U+0020."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def strip_column(name: str) -> Column:
    """``strip`` of a plain column; texts without white space at an end skip the walk over all of their characters."""
    c = F.col(name)
    loose = F.contains(F.lit(SPACE_CHARS), F.left(c, F.lit(1))) | F.contains(F.lit(SPACE_CHARS), F.right(c, F.lit(1)))
    return F.when(loose, strip(c)).otherwise(c)


def normalise_text(c: Column) -> Column:
    """Trim and collapse white space to single blanks."""
    return strip(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def clean_tech_stack(items: Column) -> Column:
    """Trim stack items and drop the blank ones."""
    return F.filter(F.transform(items, strip), lambda t: t != "")


#: What a text must have for ``clean_text`` to change it: a mark, a bullet, or white space that is not one blank between words.
_UNCLEAN = r"[*#`\[" + SPACE_CLASS.replace(" ", "") + r"]|  |^ | \z|^[-+] "


def clean_text(c: Column) -> Column:
    """Drop Markdown emphasis, headings, bullets, backticks and links. A look for any of them spares plain texts the five rules."""
    return F.when(c.rlike(_UNCLEAN), _cleaned(c)).otherwise(c)


def _cleaned(c: Column) -> Column:
    c = F.replace(c, F.lit("*"), F.lit(""))
    c = F.regexp_replace(c, "(?U)" + HEADING, "")
    c = F.regexp_replace(c, "(?Udm)" + LINE_BULLET, "")
    c = F.replace(c, F.lit("`"), F.lit(""))
    c = F.regexp_replace(c, LINK, "$1")
    return normalise_text(c)


def sanitize_text(c: Column, strict: bool = False) -> Column:
    """Redact injection phrases and defuse tag and role markers.

    ``strict`` also catches several qualifiers in a row, which the default lets through.
    """
    pattern = INJECTION_STRICT if strict else INJECTION
    c = F.regexp_replace(c, "(?iU)" + pattern, REDACTED)
    for mark, safe in (("</", "[/"), ("<|", "[|"), ("|>", "|]")):
        c = F.replace(c, F.lit(mark), F.lit(safe))
    return strip(F.regexp_replace(c, "(?iU)" + ROLE_MARKER, "$1$2:"))


def redact_instruction(c: Column) -> Column:
    """The narrower guard applied to edit instructions."""
    return F.regexp_replace(normalise_text(c), "(?iU)" + EDIT_INJECTION, REDACTED)


def content_tag(identity: Column, salt: str) -> Column:
    """Eight hex digits that stay the same when a job is run again with the same secret ``salt``.

    Without the salt the tag could be computed, and the fence closed, from outside.
    """
    if not salt or not salt.strip():
        raise ValueError("content_tag needs a salt")
    return F.upper(F.left(F.sha2(F.concat(identity.cast("string"), F.lit(salt)), 256), F.lit(TAG_CHARS)))


def wrap_content(c: Column, tag: Column) -> Column:
    """Fence user content between tags that carry ``tag``."""
    return F.concat(
        F.lit("<USER_CONTENT_"), tag, F.lit(">\n"), c, F.lit("\n</USER_CONTENT_"), tag, F.lit(">")
    )


# The pieces around a document, in order; the tag follows the first and fourth.
DOCUMENT_FENCE = ("<UPLOADED_DOC_", ' name="', '">\n', "\n</UPLOADED_DOC_", ">")
TAG_CHARS = 8


def wrap_document(name: Column, c: Column, tag: Column) -> Column:
    """Fence one uploaded document between tags that carry ``tag`` and its name."""
    start, named, body, end, close = (F.lit(piece) for piece in DOCUMENT_FENCE)
    return F.concat(start, tag, named, name, body, c, end, tag, close)


def wrapped_chars(name: Column, text_chars: Column) -> Column:
    """Length of a fenced document, known without its text."""
    fence = sum(len(piece) for piece in DOCUMENT_FENCE) + 2 * TAG_CHARS
    return text_chars + F.length(name) + fence


def latin1_fold(c: Column) -> Column:
    """Fold text into Latin-1: known signs by table, other characters to ``?``."""
    c = F.translate(c, *FOLD_SINGLE)
    for sign, text in FOLD_MULTI:
        c = F.replace(c, F.lit(sign), F.lit(text))
    c = F.regexp_replace(c, CONTROL_CHARS, "")
    return F.regexp_replace(c, NOT_LATIN1, "?")


def _shorten(c: Column, limit: int, mark: str) -> Column:
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))
    ).otherwise(c)


def truncate_text(c: Column) -> Column:
    """Uploaded text keeps 12000 characters and says so when it was longer."""
    return _shorten(c, TEXT_LIMIT, TRUNCATION_NOTE)


def preview_text(c: Column) -> Column:
    return F.left(c, F.lit(PREVIEW_LIMIT))


def ellipsis_label(c: Column) -> Column:
    return _shorten(c, LABEL_LIMIT, "...")


def title_case(c: Column) -> Column:
    """Capitalise every run of letters (``e-commerce`` gives ``E-Commerce``)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def capitalise(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def tech_csv(items: Column) -> Column:
    return F.concat_ws(", ", items)


def safe_title(c: Column) -> Column:
    return F.translate(c, " /", "__")


def file_ext(name: Column) -> Column:
    """Lower-cased extension of a file name; leading dots do not start one."""
    return F.lower(F.regexp_extract(name, r"[^./]\.*(\.[^./]*)$", 1))


def display_name(filename: Column) -> Column:
    """The title part of a stored file name."""
    return F.replace(F.substring_index(filename, "_Proposal", 1), F.lit("_"), F.lit(" "))


def join_cells(cells: Column, keep_blanks: bool = False) -> Column:
    """Join table cells; sheets keep blank cells, document tables drop them.

    Rows without any text become NULL, so that ``concat_ws`` over rows skips them.
    """
    if keep_blanks:
        cells = F.transform(cells, lambda x: F.coalesce(x, F.lit("")))
        filled = F.exists(cells, lambda x: x != "")
    else:
        cells = F.filter(F.transform(cells, strip), lambda x: x != "")
        filled = F.size(cells) > 0
    return F.when(filled, F.concat_ws(" | ", cells))


def size_kb(n_bytes: Column) -> Column:
    return F.bround(n_bytes / 1024, 1)
