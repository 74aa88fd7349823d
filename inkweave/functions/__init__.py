"""Column functions: every one takes Columns and returns a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so a body that uses it many times does not repeat its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """A column of a ``select`` whose value is worked out once a row, however many filters and joins above use it.

    Filters move below a plain column and work its expression out again, each for itself; they stay
    above a generator, here one of a single row.
    """
    return F.explode(F.array(value))


def only_if(value: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """Change a value only when a cheap test says that there is something to change."""
    return let(value, lambda v: F.when(test(v), change(v)).otherwise(v))


def has(text: str) -> Callable[[Column], Column]:
    """Byte search for a literal: far cheaper than starting a regular expression."""
    return lambda value: value.contains(text)


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


# All characters that count as white space in Unicode text.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip_space(value: Column) -> Column:
    """Trim all Unicode white space, not only the blank."""
    return F.btrim(value, F.lit(WHITE_SPACE))
