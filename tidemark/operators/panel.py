"""The dense panel of sessions by tickers, and as-of alignment.

The panel stays long: one row per session and ticker, nulls where a ticker did not trade. The calendar has
at most one row per day (36,525 for a century), whatever the number of tickers, so it is broadcast; tickers
are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.dedupe import one_per_key

def calendar(quotes: DataFrame, column: str = "close", group: str = "ticker") -> DataFrame:
    """Sessions in which any member has a value of ``column``."""
    return quotes.filter(F.col(column).isNotNull()).select("date").distinct()


def dense(quotes: DataFrame, column: str = "close", group: str = "ticker", order: str | None = None) -> DataFrame:
    """Every session of the market for every member, with the columns of ``quotes``.

    A repeated (date, member) counts once: its last row by ``order``.
    """
    rows = one_per_key(quotes, ("date", group), order)
    members = rows.filter(F.col(column).isNotNull()).select(group).distinct()
    return members.crossJoin(F.broadcast(calendar(rows, column, group))).join(rows, ["date", group], "left")


def session_numbers(dates: DataFrame) -> DataFrame:
    """(date, n) with n = 0, 1, ...; on distinct dates only, so one small partition."""
    return dates.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")) - 1)


def as_of_calendar(events: DataFrame, dates: DataFrame, event_date: str) -> DataFrame:
    """Adds ``session``: the last session on or before each event's date."""
    days = dates.select(F.col("date").alias("_d"), F.col("date").alias("_s")).unionByName(events.select(F.col(event_date).alias("_d")).distinct().withColumn("_s", F.lit(None).cast("date")))
    known = days.withColumn("session", F.last("_s", ignorenulls=True).over(Window.orderBy("_d", F.asc_nulls_last("_s")).rowsBetween(Window.unboundedPreceding, 0)))
    # a date that is a session itself appears twice; the row order puts the session first
    return events.join(known.groupBy("_d").agg(F.max("session").alias("session")), F.col(event_date) == F.col("_d"), "left").drop("_d")


def forward_filled(external: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, series, value) on the market's sessions: the last published value, never interpolated."""
    series = external.select("series").distinct()
    grid = series.crossJoin(F.broadcast(dates.select("date").distinct())).withColumn("value", F.lit(None).cast("double")).withColumn("_market", F.lit(1))
    both = external.select("series", "date", "value").withColumn("_market", F.lit(0)).unionByName(grid.select("series", "date", "value", "_market"))
    over = Window.partitionBy("series").orderBy("date", "_market").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(over)).filter("_market = 1").select("date", "series", "value")
