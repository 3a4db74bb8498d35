"""Helpers for writing Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often, and in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def one_of(value: Column, names) -> Column:
    return value.isin(*sorted(names)) if names else F.lit(False)
