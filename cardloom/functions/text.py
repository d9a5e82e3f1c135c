"""Text, truth and time as the collections' writers understand them, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode spaces included (SQL's trim only takes blanks).
_ENDS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def filled(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(text, F.lit(""))


def filled_stripped(text: Column) -> Column:
    return filled(strip(text))


def lookup(table: dict[str, str], key: Column) -> Column:
    """table[key], null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def instant(text: Column) -> Column:
    """ISO text as a timestamp (no offset means the session's zone, UTC); null when it can't be read."""
    return F.try_to_timestamp(text.cast("string"))


def url_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def plain_number(text: Column) -> Column:
    """A plain decimal number, else 0."""
    bare = strip(text)
    return F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), bare.try_cast("double")).otherwise(F.lit(0.0))


def first_upper(text: Column) -> Column:
    """Only the first character changes."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
