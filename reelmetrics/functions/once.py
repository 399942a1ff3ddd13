"""Evaluate an expensive expression once where it would otherwise be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters use as it is.

    A filter over a plain column is pushed below it and would parse every text twice.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))
