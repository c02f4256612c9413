"""Predictor sweep with false-discovery control, mean reversion by ticker, seasonal dividend yield."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dividends import dated_yields
from tidemark.operators.features import forward_return, predictors, with_log_return
from tidemark.operators.settle import settled
from tidemark.operators.stats import benjamini_hochberg, information_coefficients, mean_coefficient, mean_reversion, with_p_value
from tidemark.settings import FeatureSettings, SweepSettings


def segments(reference: DataFrame, least_members: int = 4) -> DataFrame:
    """(segment, ticker): the whole market, and every sector with enough members."""
    sized = reference.filter("sector is not null").groupBy("sector").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_members)
    own = reference.join(sized, "sector").select(F.col("sector").alias("segment"), "ticker")
    return reference.select(F.lit("market").alias("segment"), "ticker").unionByName(own)


def sweep_cells(panel: DataFrame, reference: DataFrame, settings: SweepSettings = SweepSettings(), scale: FeatureSettings = FeatureSettings(), names: Sequence[str] | None = None) -> DataFrame:
    """(segment, predictor, horizon): mean coefficient, error and t of each, on the pair's common rows."""
    registry = predictors(scale)
    used = list(names or registry)
    rows = with_log_return(panel).select("date", "ticker", *[registry[p]().alias(p) for p in used], *[forward_return(h).alias(f"h{h}") for h in settings.horizons])
    long = rows.unpivot(["date", "ticker", *[f"h{h}" for h in settings.horizons]], used, "predictor", "value").filter("value is not null")
    pairs = long.select("date", "ticker", "predictor", "value", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("forward")) for h in settings.horizons])).alias("_p"))
    pairs = pairs.select("date", "ticker", "predictor", "value", "_p.horizon", "_p.forward").filter("forward is not null").join(segments(reference, settings.least_members), "ticker")
    cell = ["segment", "predictor", "horizon"]
    ics = information_coefficients(pairs, "value", "forward", [*cell, "date"], settings.least_members)
    return mean_coefficient(ics, F.col("horizon"), cell, least_periods=3)


def sweep(panel: DataFrame, reference: DataFrame, settings: SweepSettings = SweepSettings(), scale: FeatureSettings = FeatureSettings()) -> DataFrame:
    """All cells with p-value and whether they are discoveries, largest |t| first."""
    cells = settled(with_p_value(sweep_cells(panel, reference, settings, scale)), "cells")  # the control reads them five times
    return benjamini_hochberg(cells, settings.discovery_rate).orderBy(F.desc_nulls_last(F.abs("t")), "segment", "predictor", "horizon")


def return_to_mean(quotes: DataFrame, least_rows: int = 500, slowest: float = 120.0) -> DataFrame:
    """Mean reversion of log closes: equilibrium price, half-life and whether it can be used.

    ``by_chance`` is the number of tickers that 5 % of the tested ones make.
    """
    logs = quotes.filter("close > 0").withColumn("log", F.ln("close"))
    enough = logs.groupBy("ticker").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_rows)
    fit = mean_reversion(logs.join(enough, "ticker", "left_semi"), "log")
    tested = fit.agg((0.05 * F.count("*")).alias("by_chance"))
    out = fit.select("ticker", "rows", F.exp("last").alias("close"), F.exp("equilibrium").alias("equilibrium"), "theta", "half_life", "statistic", (F.col("half_life") <= slowest).alias("usable"))
    return out.crossJoin(F.broadcast(tested))


def seasonal_yield(quotes: DataFrame, dividends: DataFrame, days: int = 365, least_sessions: int = 100, least_members: int = 8) -> DataFrame:
    """(season, members, ic): does a season's dividend yield rank the returns of the year after it?"""
    seasons = dated_yields(quotes, dividends).groupBy("ticker", F.year("session").alias("season")).agg(F.sum("yield").alias("yield"), F.max("session").alias("start"))
    # a year from the start lies in the season's year and the next: two rows a season join by ticker and year
    seasons = seasons.withColumn("_year", F.explode(F.array("season", F.col("season") + 1)))
    prices = quotes.filter("close is not null").select("ticker", "date", "close", F.year("date").alias("_year"))
    held = seasons.join(prices, ["ticker", "_year"]).filter((F.col("date") >= F.col("start")) & (F.col("date") <= F.date_add("start", days)))
    each = held.groupBy("ticker", "season", "yield").agg(F.count("*").alias("_n"), F.min_by("close", "date").alias("_first"), F.max_by("close", "date").alias("_last"))
    each = each.filter((F.col("_n") >= least_sessions) & (F.col("_first") > 0)).withColumn("forward", F.col("_last") / F.col("_first") - 1)
    return information_coefficients(each, "yield", "forward", ["season"], least_members).filter("ic is not null")
