"""Rolling features on the dense panel, all in one pass over the ticker windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.panel import by_ticker, change, strict
from tidemark.settings import FeatureSettings

FEATURES = ("momentum", "trend", "volatility", "liquidity")


def momentum(window: int, skip: int) -> Column:
    """Close ``skip`` sessions ago over close ``window`` sessions ago, less one."""
    w = by_ticker()
    return change(F.lag("close", skip).over(w) if skip else F.col("close"), F.lag("close", window).over(w))


def trend(short: int, long: int) -> Column:
    w = by_ticker()
    return F.try_divide(strict(F.col("close"), short, F.avg, w), strict(F.col("close"), long, F.avg, w)) - 1


def volatility(window: int, sessions_a_year: int) -> Column:
    """Annual sample deviation of log returns; expects the column ``log_return``."""
    return strict(F.col("log_return"), window, F.stddev_samp, by_ticker()) * F.sqrt(F.lit(float(sessions_a_year)))


def liquidity(window: int) -> Column:
    """Median traded value of up to ``window`` sessions; a session without trade counts as nought."""
    return F.percentile(F.coalesce("volume_value", F.lit(0.0)), F.lit(0.5)).over(by_ticker().rowsBetween(-(window - 1), 0))


def amplitude(window: int) -> Column:
    spread = F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close"))
    return strict(spread, window, F.avg, by_ticker())


def gap_to_mean(window: int) -> Column:
    return F.try_divide(F.col("close"), strict(F.col("close"), window, F.avg, by_ticker())) - 1


def forward_return(horizon: int) -> Column:
    return change(F.lead("close", horizon).over(by_ticker()), F.col("close"))


def with_log_return(panel: DataFrame) -> DataFrame:
    log = F.when(F.col("close") > 0, F.ln("close"))
    return panel.withColumn("log_return", log - F.lag(log).over(by_ticker()))


def sliding_median(panel: DataFrame, value: Column, window: int, into: str) -> DataFrame:
    """Adds the median of ``value`` over the up to ``window`` sessions of a ticker that end with the row; nulls are left out.

    A ticker's sessions become one array, and a task keeps the order statistics of the sliding window (a skip list: one value
    enters, one leaves), so a row costs about the same for any window, where a window function sorts all its values anew.
    Only the values go to Python. On long histories call it inside :func:`in_blocks`, so that an array is a block.
    NaN and infinite values count as missing; sessions of a ticker are distinct; no rows give no rows.
    """

    @F.pandas_udf("array<double>")
    def medians(histories: pd.Series) -> pd.Series:
        return histories.map(lambda v: pd.Series(v, dtype="float64").rolling(window, min_periods=1).median().to_numpy())

    rest = [c for c in panel.columns if c not in ("ticker", into)]
    rows = panel.withColumn("_value", value.cast("double")).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "_value", F.struct(*rest).alias("_rest")))).alias("_rows"))
    rows = rows.withColumn("_medians", medians(F.transform("_rows", lambda r: r["_value"])))
    each = rows.select("ticker", F.explode(F.arrays_zip("_rows", "_medians")).alias("_at"))
    median = F.col("_at._medians")
    return each.select("ticker", "_at._rows._rest.*", F.when(~F.isnan(median), median).alias(into)).select(*[c for c in panel.columns if c != into], into)


def rolling_features(panel: DataFrame, settings: FeatureSettings = FeatureSettings(), slide: bool = False) -> DataFrame:
    """Adds momentum, trend, volatility and liquidity to the dense panel, for all sessions.

    ``slide`` takes liquidity from :func:`sliding_median`, for long windows; it comes last, so that it groups rows where the windows
    have them, without a shuffle of its own.
    """
    out = with_log_return(panel).withColumns({
        "momentum": momentum(settings.momentum, settings.skip),
        "trend": trend(settings.short_mean, settings.long_mean),
        "volatility": volatility(settings.volatility, settings.sessions_a_year),
    }).drop("log_return")
    if slide:
        return sliding_median(out, F.coalesce("volume_value", F.lit(0.0)), settings.liquidity, "liquidity")
    return out.withColumn("liquidity", liquidity(settings.liquidity))


def in_blocks(panel: DataFrame, sessions: DataFrame, build: Callable[[DataFrame], DataFrame], size: int, back: int, ahead: int = 0) -> DataFrame:
    """``build`` over blocks of ``size`` sessions of each ticker instead of its whole history.

    A block also gets the ``back`` sessions before it and the ``ahead`` after it, so any column that looks no further is the
    same as over the whole history; a task then holds blocks, not tickers. ``sessions`` is (date, n), the market's calendar: one row a
    session, broadcast. Rows move (size + back + ahead) / size times. ``build`` sees a ticker of its own for each block.
    """
    n = F.col("_n")
    rows = panel.join(F.broadcast(sessions.select("date", F.col("n").alias("_n"))), "date")
    blocks = F.sequence(F.greatest(F.floor((n - ahead) / size), F.lit(0)), F.floor((n + back) / size))
    rows = rows.withColumn("_block", F.explode(blocks)).withColumn("ticker", F.struct("ticker", "_block"))
    own = build(rows).filter(F.floor(n / size) == F.col("_block"))
    return own.withColumn("ticker", F.col("ticker.ticker")).drop("_n", "_block")


def blocked_features(panel: DataFrame, sessions: DataFrame, settings: FeatureSettings = FeatureSettings(), size: int = 1000, slide: bool = True) -> DataFrame:
    """:func:`rolling_features` of long histories, by blocks of sessions."""
    return in_blocks(panel, sessions, lambda rows: rolling_features(rows, settings, slide), size, settings.look_back)


def predictors(scale: FeatureSettings = FeatureSettings()) -> dict[str, Callable[[], Column]]:
    """Registry of predictor columns for the sweep; callers may add their own."""
    half = scale.momentum // 2
    return {
        "momentum_long": lambda: momentum(scale.momentum, scale.skip),
        "momentum_half": lambda: momentum(half, scale.skip),
        "reversal": lambda: -momentum(scale.skip, 0),
        "trend": lambda: trend(scale.short_mean, scale.long_mean),
        "volatility": lambda: volatility(scale.volatility, scale.sessions_a_year),
        "liquidity": lambda: liquidity(scale.liquidity),
        "amplitude": lambda: amplitude(scale.volatility),
        "gap_to_mean": lambda: gap_to_mean(scale.momentum),
    }


def latest(features: DataFrame) -> DataFrame:
    """Rows of the last session."""
    return features.join(features.agg(F.max("date").alias("date")), "date")
