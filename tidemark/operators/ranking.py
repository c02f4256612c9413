"""Cross-sectional ranking: liquidity gate, complete rows, percentile ranks, weighted score, sector
neutralisation, order. Written for all sessions at once, partitioned by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import average_rank
from tidemark.operators.features import FEATURES
from tidemark.settings import RankingSettings


def gate(features: DataFrame, least_liquidity: float) -> DataFrame:
    """Rows whose liquidity (null: nought) reaches the threshold; comes before any rank."""
    return features.filter(F.coalesce("liquidity", F.lit(0.0)) >= least_liquidity)


def complete(features: DataFrame) -> DataFrame:
    return features.dropna(subset=list(FEATURES))


def weighted(weights: dict[str, float], ranks: dict[str, Column]) -> Column:
    """Sum of weight times rank over the sum of absolute weights, for the ranks there are."""
    used = {k: w for k, w in weights.items() if k in ranks}
    return sum((F.lit(w) * ranks[k] for k, w in used.items()), F.lit(0.0)) / F.lit(sum(abs(w) for w in used.values()) or 1.0)


def neutralised(df: DataFrame, least_members: int, column: str = "score") -> DataFrame:
    """Moves sectors with enough members to the market's mean; others, and no sector, stay."""
    market, sector = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    enough = F.col("sector").isNotNull() & (F.count("*").over(sector) >= least_members)
    moved = F.col(column) - F.avg(column).over(sector) + F.avg(column).over(market)
    return df.withColumn(column, F.when(enough, moved).otherwise(F.col(column)))


def ranking(features: DataFrame, reference: DataFrame, settings: RankingSettings = RankingSettings()) -> DataFrame:
    """Adds sector, name, score and place (1 is best) to the rows that pass the gate, for each session."""
    rows = complete(gate(features, settings.least_liquidity))
    ranked = rows.select("*", *[average_rank(F.col(k), "date").alias(f"rank_{k}") for k in settings.weights])
    score = 100 * (weighted(settings.weights, {k: F.col(f"rank_{k}") for k in settings.weights}) + 0.5)
    named = ranked.withColumn("score", score).join(reference.select("ticker", "name", "sector"), "ticker", "left")
    moved = neutralised(named, settings.least_sector).withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))
    return moved.withColumn("place", place).drop(*[f"rank_{k}" for k in settings.weights])
