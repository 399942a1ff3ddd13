"""Order-dependent columns (running totals, previous and next row) that survive hot keys.

A plain window puts all rows of a key into one task.  Here each key's rows are cut
into slices of the order column; slices are scanned in parallel and only one row per
slice is looked at across slices.  Work per task is bounded by the slice, not by the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"
# The keys in a struct: never null itself, and equal where the keys are equal or both null.
KEY = "__key"


def with_slice(rows: DataFrame, order: str, width: int) -> DataFrame:
    """Adds the slice number; never null by type, so joins on it add no filter of their own."""
    return rows.withColumn(SLICE, F.coalesce(F.floor(F.col(order) / F.lit(width)).cast("long"), F.lit(0)))


def ordered_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    width: int,
    totals: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add columns computed along `order` within `keys`.

    `totals` maps a new column to the value summed up to and including the row (null adds 0);
    `previous` and `following` map a new column to the column whose neighbouring
    value it takes.  `order` is a number, unique within `keys`; a null stands before all others.
    Keys may be null: rows with null keys make up a key of their own.
    """
    totals, previous, following = dict(totals or {}), dict(previous or {}), dict(following or {})
    sliced = with_slice(rows, order, width).withColumn(KEY, F.struct(*keys))
    for name, value in totals.items():
        sliced = sliced.withColumn(f"__v_{name}", F.coalesce(value, F.lit(0)))

    def picked(columns: Mapping[str, str]) -> Column:
        return F.struct(*[F.col(source).alias(name) for name, source in columns.items()])

    summaries = [F.sum(f"__v_{name}").alias(f"__t_{name}") for name in totals]
    if previous:
        summaries.append(F.max_by(picked(previous), F.col(order)).alias("__last"))
    if following:
        summaries.append(F.min_by(picked(following), F.col(order)).alias("__first"))
    across = Window.partitionBy(KEY).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in totals]
    if previous:
        carried.append(F.lag("__last").over(across).alias("__carry_previous"))
    if following:
        carried.append(F.lead("__first").over(across).alias("__carry_following"))
    edges = sliced.groupBy(KEY, SLICE).agg(*summaries).select(KEY, SLICE, *carried)

    within = Window.partitionBy(KEY, SLICE).orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    added = [(F.sum(f"__v_{n}").over(upto) + F.col(f"__c_{n}")).alias(n) for n in totals]
    if previous:
        added.append(F.coalesce(F.lag(picked(previous)).over(within), F.col("__carry_previous")).alias("__prev"))
    if following:
        added.append(F.coalesce(F.lead(picked(following)).over(within), F.col("__carry_following")).alias("__next"))
    scanned = sliced.join(edges, [KEY, SLICE]).select(*rows.columns, *added)
    return scanned.select(
        *rows.columns,
        *totals,
        *[F.col(f"__prev.{n}").alias(n) for n in previous],
        *[F.col(f"__next.{n}").alias(n) for n in following],
    )
