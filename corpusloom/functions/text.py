"""Small text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any kind at either end, as a Java pattern.
_EDGE_BLANKS = r"(?U)^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$"


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends; null stays null."""
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def key(c: Column) -> Column:
    """An identifier compared without surrounding blanks and letter case; empty counts as null."""
    k = F.lower(strip(c))
    return F.when(k != "", k)


def filled(c: Column) -> Column:
    """Whether the text holds something but blanks; null counts as not."""
    return F.coalesce(strip(c) != "", F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
