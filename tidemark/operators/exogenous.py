"""External series on the market's calendar and their interaction with sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import change
from tidemark.operators.panel import forward_filled
from tidemark.settings import ExternalSettings


def variations(aligned: DataFrame, window: int, lag: int) -> DataFrame:
    """(date, series, variation) over ``window`` sessions, seen ``lag`` sessions late."""
    w = Window.partitionBy("series").orderBy("date")
    v = change(F.lag("value", lag).over(w), F.lag("value", lag + window).over(w))
    return aligned.select("date", "series", v.alias("variation"))


def interactions(changes: DataFrame, tickers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(date, ticker, series, value): the variation for the tickers of the mapped sector; others have no row and count as nought.

    ``mapping`` is (series, sector), a setting. Two equi-joins, by series and by sector, so rows are as many as sectors have members.
    """
    mapped = changes.join(F.broadcast(mapping.select("series", "sector")), "series")
    return mapped.join(tickers.select("ticker", "sector"), "sector").select("date", "ticker", "series", F.coalesce("variation", F.lit(0.0)).alias("value"))


def with_noughts(sparse: DataFrame, dates: DataFrame, tickers: DataFrame, mapping: DataFrame) -> DataFrame:
    """The dense view of :func:`interactions`: a row for every date, ticker and series whose sector some ticker has, by definition."""
    present = mapping.join(tickers.select("sector").distinct(), "sector", "left_semi").select("series")
    grid = dates.select("date").distinct().crossJoin(F.broadcast(present)).crossJoin(tickers.select("ticker"))
    return grid.join(sparse, ["date", "ticker", "series"], "left").fillna(0.0, ["value"])


def external_features(external: DataFrame, dates: DataFrame, tickers: DataFrame, mapping: DataFrame, settings: ExternalSettings = ExternalSettings()) -> DataFrame:
    """Sparse interactions on the market's calendar; the sample fills in noughts where it joins them."""
    return interactions(variations(forward_filled(external, dates), settings.window, settings.lag), tickers, mapping)


def wide(long: DataFrame, series: list[str]) -> DataFrame:
    """One column ``exo_<series>`` for each of the named series, null where a ticker has no row of it."""
    out = long.groupBy("date", "ticker").pivot("series", series).agg(F.first("value"))
    return out.select("date", "ticker", *[F.col(f"`{s}`").alias(f"exo_{s}") for s in series])


def coverage(external: DataFrame) -> DataFrame:
    rows = external.filter("value is not null")
    return rows.groupBy("series").agg(F.count("*").alias("points"), F.min("date").alias("first"), F.max("date").alias("last"))
