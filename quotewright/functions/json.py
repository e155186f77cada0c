"""JSON text walked token by token, without a schema and to any depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotewright.functions.binding import let

#: Stand for an escaped backslash and an escaped quote; JSON text cannot hold these signs as they are.
_BACKSLASH, _QUOTE = "\x01", "\x02"
#: A string, with the colon behind it if it is a key, or what lies between strings.
_TOKEN = r'"[^"]*":?|[^"]+'
#: What a string must escape.
_SPECIAL = r'["\\\x00-\x1f]'


def quoted(c: Column) -> Column:
    """Text as a JSON string."""
    escaped = F.to_json(F.array(c))
    return F.when(c.rlike(_SPECIAL), F.substr(escaped, F.lit(2), F.length(escaped) - 2)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def _unquoted(token: Column) -> Column:
    """The text of a JSON string."""
    plain = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(plain)


def map_strings(text: Column, change: Callable[[Column], Column]) -> Column:
    """``text``, compact JSON as ``to_json`` writes it, with ``change`` applied to each string value at any depth.

    Keys, numbers, and the order of everything stay. Once escaped quotes are marked, a
    string ends at the next quote, so the text splits into tokens by a pattern that does
    not recurse: neither depth nor length is limited, and a row needs no other row.
    """
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def restored(token: Column) -> Column:
        return F.replace(F.replace(token, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))

    def changed(token: Column) -> Column:
        is_value = F.startswith(token, F.lit('"')) & ~F.endswith(token, F.lit('":'))
        value = let(_unquoted(restored(token)), lambda text: let(change(text), quoted))
        return F.when(is_value, value).otherwise(restored(token))

    return F.array_join(F.transform(F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0)), changed), "")


def map_variant(value: Column, change: Callable[[Column], Column]) -> Column:
    """A variant with ``change`` applied to each string in it; a missing one stays missing."""
    return F.try_parse_json(map_strings(F.to_json(value), change))
