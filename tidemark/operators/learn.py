"""Learning sample, walk-forward validation with purge, and current probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import average_rank
from tidemark.operators.features import FEATURES, forward_return, latest, rolling_features
from tidemark.operators.logistic import fits, with_probability
from tidemark.operators.ranking import weighted
from tidemark.operators.settle import settled
from tidemark.operators.stats import information_coefficients, mean_coefficient
from tidemark.settings import FeatureSettings, LearningSettings, RankingSettings


def sample(panel: DataFrame, horizon: int, features: FeatureSettings = FeatureSettings(), external: DataFrame | None = None) -> DataFrame:
    """(date, ticker, ranks, forward, label): label is a forward return above the session's median.

    Sessions with fewer than four rows are left out; a missing liquidity ranks as missing and counts as the middle.
    """
    rows = rolling_features(panel, features).withColumn("forward", forward_return(horizon)).dropna(subset=["momentum", "trend", "volatility", "forward"])
    day = Window.partitionBy("date")
    rows = rows.withColumn("_n", F.count("*").over(day)).filter("_n >= 4").withColumn("_median", F.percentile("forward", F.lit(0.5)).over(day))
    out = rows.select("date", "ticker", "forward", (F.col("forward") > F.col("_median")).cast("double").alias("label"), *[F.coalesce(average_rank(F.col(k), "date"), F.lit(0.5)).alias(k) for k in FEATURES])
    if external is not None:
        names = [c for c in external.columns if c not in ("date", "ticker")]
        out = out.join(external, ["date", "ticker"], "left").fillna(0.0, names)
    return out


def composite(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumn("composite", weighted(weights, {k: F.col(k) for k in weights}))


def composite_coefficient(df: DataFrame, weights: dict[str, float], horizon: int) -> DataFrame:
    """Mean coefficient of the weighted score on the whole sample; nothing is learned."""
    return mean_coefficient(information_coefficients(composite(df, weights), "composite", "forward", ["date"], 3), horizon)


def feature_coefficients(df: DataFrame, horizon: int, names: Sequence[str] = FEATURES) -> DataFrame:
    long = df.unpivot(["date", "ticker", "forward"], list(names), "feature", "value")
    return mean_coefficient(information_coefficients(long, "value", "forward", ["feature", "date"], 3), horizon, ["feature"])


def folds(df: DataFrame, k: int, horizon: int) -> DataFrame:
    """(fold, date, part): train and test sessions; training ends ``horizon`` sessions before the test begins."""
    dates = df.select("date").distinct().withColumns({"_n": F.row_number().over(Window.orderBy("date")), "_block": F.ntile(k + 1).over(Window.orderBy("date"))})
    starts = dates.groupBy("_block").agg(F.min("_n").alias("_start")).filter("_block > 1").select((F.col("_block") - 1).alias("fold"), "_start")
    both = dates.crossJoin(F.broadcast(starts))
    part = F.when(F.col("_block") == F.col("fold") + 1, "test").when(F.col("_n") <= F.col("_start") - 1 - horizon, "train")
    return both.select("fold", "date", part.alias("part")).filter("part is not null")


def walk_forward(df: DataFrame, settings: LearningSettings = LearningSettings(), weights: dict[str, float] | None = None, names: Sequence[str] = FEATURES) -> DataFrame | None:
    """Out-of-fold rows with probability, composite and fold; None where there is too little to learn from.

    All folds are fitted at once: a row trains in each fold that it precedes, at most ``folds`` times. The result is settled.
    """
    df = settled(df, "sample")
    size = df.agg(F.count("*").alias("rows"), F.countDistinct("date").alias("dates")).first()
    if size.rows < settings.least_rows or size.dates < settings.folds + 2:
        return None
    parts = settled(folds(df, settings.folds, settings.horizon), "folds")
    # (session, fold) pairs: the calendar times the number of folds, whatever the number of tickers
    dealt = df.join(F.broadcast(parts), "date")
    fitted = fits(dealt.filter("part = 'train'").select("fold", "label", *names), "fold", names, settings.penalty)
    if fitted is None:
        return None
    tested = with_probability(dealt.filter("part = 'test'").drop("part"), fitted, "fold", names)
    return settled(composite(tested, weights or RankingSettings().weights), "tested")


def validation(rows: DataFrame, horizon: int) -> DataFrame:
    """For each fold and pooled (fold null): coefficients of model and composite, and the share of right calls.

    Coefficients are computed once by (score, fold, session) and pooled from there; calls are summed by fold first.
    """
    long = rows.unpivot(["fold", "date", "forward"], ["probability", "composite"], "score", "value")
    pooled = F.explode(F.array("fold", F.lit(None).cast("int")))
    ics = information_coefficients(long, "value", "forward", ["score", "fold", "date"], 3).select("score", pooled.alias("fold"), "ic")
    means = mean_coefficient(ics, horizon, ["score", "fold"])
    of = lambda name, c: F.max(F.when(F.col("score") == name, F.col(c)))
    scores = means.groupBy("fold").agg(
        of("probability", "ic").alias("probability_ic"), of("probability", "error").alias("probability_error"), of("probability", "sessions").alias("sessions"),
        of("composite", "ic").alias("composite_ic"), of("composite", "error").alias("composite_error"),
    )
    right = ((F.col("probability") >= 0.5).cast("double") == F.col("label")).cast("long")
    calls = rows.groupBy("fold").agg(F.sum(right).alias("_right"), F.count("label").alias("_all")).select(pooled.alias("fold"), "_right", "_all")
    calls = calls.groupBy("fold").agg((F.sum("_right") / F.sum("_all")).alias("precision"))
    return scores.alias("s").join(F.broadcast(calls).alias("c"), F.col("s.fold").eqNullSafe(F.col("c.fold"))).select("s.*", "c.precision")


def probabilities(df: DataFrame, panel: DataFrame, features: FeatureSettings = FeatureSettings(), settings: LearningSettings = LearningSettings(), names: Sequence[str] = FEATURES, first: int | None = None) -> DataFrame | None:
    """(date, ticker, probability) of the last session from a fit on the whole sample; highest first, the ``first`` of them or all."""
    df = settled(df, "sample")
    one = F.lit(0).alias("_fit")
    fitted = fits(df.select(one, "label", *names), "_fit", names, settings.penalty)
    if fitted is None:
        return None
    now = latest(rolling_features(panel, features)).dropna(subset=["momentum", "trend", "volatility"])
    now = now.select(one, "date", "ticker", *[F.coalesce(average_rank(F.col(k), "date"), F.lit(0.5)).alias(k) for k in FEATURES])
    external = [c for c in names if c not in FEATURES]
    if external:
        last = latest(df).select("ticker", *external)
        now = now.join(last, "ticker", "left").fillna(0.0, external)
    out = with_probability(now, fitted, "_fit", names).select("date", "ticker", "probability").orderBy(F.desc("probability"), "ticker")
    return out if first is None else out.limit(first)
