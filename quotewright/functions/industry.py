"""Industry resolution: exact name, exact alias, then first alias by containment.

The alias tables have a fixed size, so the rule is a row-local expression. A
join on the key would shuffle every request by a handful of industry names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotewright import seeds
from quotewright.functions.binding import let
from quotewright.functions.text import strip


def industry_key(raw: Column) -> Column:
    return F.lower(strip(raw))


def _columns(aliases) -> tuple[Column, Column]:
    """Alias names and their industries as two constant arrays."""
    names, owners = zip(*aliases)
    return F.split(F.lit("\n".join(names)), "\n"), F.split(F.lit("\n".join(owners)), "\n")


def first_match(key: Column, aliases=seeds.COST_ALIASES, min_key_len: int = 0) -> Column:
    """Industry of the first alias, in table order, that contains ``key`` or is contained in it."""
    return let(key, lambda k: _first_match(k, aliases, min_key_len))


def _first_match(key: Column, aliases, min_key_len: int) -> Column:
    names, owners = _columns(aliases)

    # A search in the newline-joined aliases finds the first alias around the key.
    joined = "\n".join(alias for alias, _ in aliases)
    # ``contains`` compares bytes and is much faster than the search for the place.
    found = F.contains(F.lit(joined), key) & (F.length(key) >= min_key_len)
    at = F.when(found, F.instr(F.lit(joined), key)).otherwise(0)
    before = F.left(F.lit(joined), at)
    around = F.when(
        (at > 0) & ~F.contains(key, F.lit("\n")),
        F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1,
    )
    inside = F.nullif(
        F.array_position(F.transform(names, lambda alias: F.contains(key, alias)), True), F.lit(0)
    )
    return F.get(owners, F.least(around, inside).cast("int") - 1)


def resolve_industry(raw: Column, aliases=seeds.COST_ALIASES, min_key_len: int = 0) -> Column:
    """Canonical industry of ``raw``, or NULL.

    Short keys match inside longer aliases (``it`` is in ``hospital``, the empty
    text is in everything); ``min_key_len`` above 0 turns that off for keys
    shorter than it.
    """
    names, owners = _columns(aliases)

    def resolve(key: Column) -> Column:
        return F.coalesce(
            F.when(key.isin(*seeds.INDUSTRIES), key),
            F.try_element_at(F.map_from_arrays(names, owners), key),
            _first_match(key, aliases, min_key_len),
        )

    return let(industry_key(raw), resolve)


def resolve_for_prompts(raw: Column, min_key_len: int = 0) -> Column:
    return resolve_industry(raw, seeds.KB_ALIASES, min_key_len)
