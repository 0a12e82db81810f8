"""Intermediate values of long expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: expressions that use their input twice would double with every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def named(**columns: Column) -> Column:
    """A struct of the given columns."""
    return F.struct(*[c.alias(n) for n, c in columns.items()])
