"""Windows, ranks and correlations that the panel operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def strict(x: Column, n: int, agg: Callable[[Column], Column], over: WindowSpec) -> Column:
    """``agg`` of the last ``n`` rows, null unless all of them have a value."""
    rows = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(rows) == n, agg(x).over(rows))


def average_rank(x: Column, *partition: str | Column) -> Column:
    """Rank within the partition divided by its size; ties share their mean rank, nulls have none."""
    part = Window.partitionBy(*partition)
    rank = F.rank().over(part.orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*partition, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(part))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 1e-15, F.covar_samp(x, y) / spread)


def change(now: Column, before: Column) -> Column:
    """now / before - 1 where before is positive."""
    return F.when(before > 0, now / before - 1)


def null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)
