"""Dividends: dated credits, spread fallback, coverage, trailing yield and the mean-reversion signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import as_of_calendar, calendar
from tidemark.operators.stats import mean_reversion


def dated_yields(quotes: DataFrame, dividends: DataFrame, implausible: float = 0.40, by: Sequence[str] = ()) -> DataFrame:
    """(session, ticker, fiscal_year, ex_date, amount, yield) of each usable dividend.

    The price is that of the last market session on or before the ex-date; without a price there the dividend is
    dropped. A yield above ``implausible`` refuses that ticker's dividends up to its date. Columns ``by`` (a source of
    dividends, say) keep their rows apart.
    """
    events = as_of_calendar(dividends.filter("amount > 0"), calendar(quotes), "ex_date").filter("session is not null")
    prices = quotes.filter("close > 0").select(F.col("date").alias("session"), "ticker", "close")
    rows = events.join(prices, ["session", "ticker"]).withColumn("yield", F.col("amount") / F.col("close"))
    frontier = F.max(F.when(F.col("yield") > implausible, F.col("session"))).over(Window.partitionBy(*by, "ticker"))
    rows = rows.withColumn("_frontier", frontier).filter("_frontier is null or session > _frontier")
    return rows.select(*by, "session", "ticker", "fiscal_year", "ex_date", "amount", "yield")


def credited(yields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(date, ticker, accrued) with one row per session and ticker that is credited."""
    return yields.groupBy(*by, F.col("session").alias("date"), "ticker").agg(F.sum("yield").alias("accrued"))


def covered_years(yields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return yields.filter("fiscal_year is not null").select(*by, "ticker", F.col("fiscal_year").alias("year")).distinct()


def accrual(quotes: DataFrame, dividends: DataFrame, fundamentals: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(date, ticker, accrued): dated dividends, and yields spread over the year where none is dated.

    A spread year replaces whatever was credited to the ticker in its sessions.
    """
    yields = dated_yields(quotes, dividends, by=by)
    dated = credited(yields, by)
    if fundamentals is None:
        return dated
    published = fundamentals.filter("indicator = 'yield' and value is not null").groupBy("ticker", F.year("date").alias("year")).agg(F.max("value").alias("value"))
    sessions = calendar(quotes).select("date", F.year("date").alias("year")).withColumn("_n", F.count("*").over(Window.partitionBy("year")))
    traded = quotes.filter("close is not null").select("ticker").distinct()
    if by:  # a published yield spreads in every scenario that has no dated one
        published = published.crossJoin(F.broadcast(dividends.select(*by).distinct()))
    spread = published.join(covered_years(yields, by), [*by, "ticker", "year"], "left_anti").join(traded, "ticker", "left_semi").join(sessions, "year")
    spread = spread.select(*by, "date", "ticker", (F.col("value") / 100 / F.col("_n")).alias("_spread"))
    return dated.join(spread, [*by, "date", "ticker"], "full_outer").select(*by, "date", "ticker", F.coalesce("_spread", "accrued").alias("accrued"))


def coverage(quotes: DataFrame, dividends: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """One row: traded (session, ticker) pairs, those whose year's dividend is known, their share, and the years."""
    known = covered_years(dated_yields(quotes, dividends))
    if fundamentals is not None:
        known = known.union(fundamentals.filter("indicator = 'yield'").select("ticker", F.year("date"))).distinct()
    pairs = quotes.filter("close is not null").select("date", "ticker", F.year("date").alias("year"))
    out = pairs.join(known.withColumn("_known", F.lit(1)), ["ticker", "year"], "left").agg(F.count("*").alias("pairs"), F.count("_known").alias("known"))
    years = known.agg(F.concat_ws(",", F.sort_array(F.collect_set(F.col("year").cast("string")))).alias("years"))
    return out.withColumn("share", F.coalesce(F.try_divide("known", "pairs"), F.lit(0.0))).crossJoin(years)


def trailing_yield(quotes: DataFrame, dividends: DataFrame, days: int = 365) -> DataFrame:
    """(date, ticker, yield) on each traded session: dividends of the last ``days`` days over the close."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    prices = quotes.filter("close > 0").select("ticker", "date", day("date").alias("_day"), "close", F.lit(0.0).alias("amount"))
    events = dividends.select("ticker", F.lit(None).cast("date").alias("date"), day("ex_date").alias("_day"), F.lit(None).cast("double").alias("close"), "amount")
    window = Window.partitionBy("ticker").orderBy("_day").rangeBetween(-(days - 1), 0)
    both = prices.unionByName(events).withColumn("_sum", F.sum("amount").over(window)).filter("date is not null")
    return both.select("date", "ticker", (F.col("_sum") / F.col("close")).alias("yield"))


def yield_signal(quotes: DataFrame, dividends: DataFrame, horizon: int = 60, tickers: DataFrame | None = None) -> DataFrame:
    """How far each ticker's trailing yield lies above its equilibrium, in deviations; nulls last."""
    yields = trailing_yield(quotes, dividends)
    if tickers is not None:
        yields = yields.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    fit = mean_reversion(yields, "yield")
    gap = F.when(F.col("spread") > 0, (F.col("last") - F.col("equilibrium")) / F.col("spread"))
    out = fit.select("ticker", F.col("last").alias("yield"), "equilibrium", gap.alias("gap"), "half_life", (F.col("half_life") <= horizon).alias("usable"))
    return out.orderBy(F.desc_nulls_last("gap"), "ticker")
