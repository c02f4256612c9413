"""The last session and single tickers: changes, breadth, turnover, sparklines, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import by_ticker, change


def changes(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """Change of the last session against the market session before it, with name and sector."""
    moved = panel.withColumn("change", change(F.col("close"), F.lag("close").over(by_ticker())))
    last = moved.join(F.broadcast(panel.agg(F.max("date").alias("date"))), "date").filter("close is not null")
    return last.select("date", "ticker", "close", "change", "volume_shares", "volume_value").join(reference.select("ticker", "name", "sector"), "ticker", "left")


def select_tickers(rows: DataFrame, sectors: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Sector filter (none: all) and literal text search in ticker or name, ignoring case."""
    if sectors:
        rows = rows.filter(F.col("sector").isin(sectors))
    if text:
        rows = rows.filter(F.lower("ticker").contains(text.lower()) | F.lower("name").contains(text.lower()))
    return rows


def by_sector(moves: DataFrame) -> DataFrame:
    return moves.groupBy("sector").agg(F.median("change").alias("median_change"), F.count("*").alias("companies"), F.avg(F.when(F.col("change").isNotNull(), (F.col("change") > 0).cast("double"))).alias("rising"))


def breadth(moves: DataFrame) -> DataFrame:
    """One row: rising, flat and falling, median change, turnover, most traded ticker and its share."""
    return moves.agg(
        F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") == 0).alias("flat"), F.count_if(F.col("change") < 0).alias("down"),
        F.median("change").alias("median_change"), F.sum("volume_value").alias("turnover"), F.max_by("ticker", F.struct("volume_value", "ticker")).alias("most_traded"),
        F.try_divide(F.max("volume_value"), F.sum("volume_value")).alias("most_traded_share"),
    )


def turnover(quotes: DataFrame, sessions: int = 12) -> DataFrame:
    """Traded value and rows of the last sessions, newest first."""
    return quotes.groupBy("date").agg(F.sum("volume_value").alias("turnover"), F.count("*").alias("rows")).orderBy(F.desc("date")).limit(sessions)


def extremes(moves: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` worst and best changes."""
    known = moves.filter("change is not null").select("ticker", "change")
    worst = known.orderBy("change", "ticker").limit(n).withColumn("side", F.lit("worst"))
    return worst.unionByName(known.orderBy(F.desc("change"), "ticker").limit(n).withColumn("side", F.lit("best")))


def sparklines(quotes: DataFrame, sessions: int = 30) -> DataFrame:
    """(ticker, closes) after the date of the ``sessions``-th last session: one value fewer."""
    bound = quotes.select("date").distinct().orderBy(F.desc("date")).limit(sessions).agg(F.min("date").alias("_bound"))
    rows = quotes.filter("close is not null").crossJoin(F.broadcast(bound)).filter(F.col("date") > F.col("_bound"))
    return rows.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("closes"))


def returns_back(quotes: DataFrame, rows_back: tuple[int, ...] = (21, 63, 250)) -> DataFrame:
    """Last close of each ticker and its return over the given numbers of own rows."""
    w = by_ticker()
    own = quotes.filter("close is not null")
    out = own.select("date", "ticker", "close", *[change(F.col("close"), F.lag("close", n).over(w)).alias(f"back_{n}") for n in rows_back], F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("_r"))
    return out.filter("_r = 1").drop("_r")


def fundamentals_sheet(fundamentals: DataFrame, indicators: list[str]) -> DataFrame:
    """Year by indicator for each ticker, newest first."""
    return fundamentals.groupBy("ticker", "date").pivot("indicator", indicators).agg(F.first("value")).orderBy("ticker", F.desc("date"))


def latest_points(rows: DataFrame, group: str = "series") -> DataFrame:
    return rows.filter("value is not null").groupBy(group).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def latest_yields(fundamentals: DataFrame, reference: DataFrame) -> DataFrame:
    """Yields of the last published year, of known companies."""
    rows = fundamentals.filter("indicator = 'yield' and value is not null")
    last = rows.agg(F.max("date").alias("date"))
    return rows.join(F.broadcast(last), "date").join(reference.select("ticker", "name"), "ticker").select("ticker", "name", F.col("value").alias("yield"))


def yield_overview(yields: DataFrame) -> DataFrame:
    """One row: companies with a yield of the last published year, and their median."""
    return yields.agg(F.count("*").alias("companies"), F.percentile("yield", F.lit(0.5)).alias("median_yield"))


def table_sizes(quotes: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: sessions, tickers and companies known by sector."""
    return quotes.agg(F.countDistinct("date").alias("sessions"), F.countDistinct("ticker").alias("tickers")).crossJoin(reference.agg(F.count("*").alias("companies"), F.countDistinct("sector").alias("sectors")))
