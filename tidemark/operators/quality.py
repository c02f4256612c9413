"""Checks of quotes and dividends: impossible sessions, limits, disagreeing sources, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import by_ticker

FACTORS = tuple(range(2, 11))


def ghost_rows(quotes: DataFrame, tolerance: float = 0.12, factors: tuple[int, ...] = FACTORS) -> DataFrame:
    """Rows near a multiple (or fraction) of both neighbours; ``factor`` is the last that matches."""
    w = by_ticker()
    rows = quotes.filter(F.col("close").isNotNull()).withColumns({"previous": F.lag("close").over(w), "following": F.lead("close").over(w)})
    multiples = F.array(*[F.lit(m) for k in factors for m in (float(k), 1 / k)])
    before, after = F.try_divide("close", "previous"), F.try_divide("close", "following")
    near = F.filter(multiples, lambda m: (F.abs(before - m) / m < tolerance) & (F.abs(after - m) / m < tolerance))
    return rows.withColumn("_near", near).filter(F.size("_near") > 0).withColumn("factor", F.element_at("_near", -1)).select("date", "ticker", "close", "previous", "following", "factor")


def ghost_summary(ghosts: DataFrame) -> DataFrame:
    return ghosts.groupBy("ticker").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.round("factor", 4))).alias("factors"), F.min("date").alias("first"), F.max("date").alias("last"))


def limit_breaches(quotes: DataFrame, limit_percent: float = 7.5, slack: float = 0.1) -> DataFrame:
    """Changes beyond the daily limit, each with its probable cause."""
    w = by_ticker()
    rows = quotes.filter(F.col("close").isNotNull()).withColumns({"previous": F.lag("close").over(w), "_day": F.lag("date").over(w)})
    percent = 100 * (F.try_divide("close", "previous") - 1)
    days = F.datediff("date", "_day")
    cause = F.when(days > 7, "gap").when(F.month("date").between(5, 8), "dividend season").otherwise("to examine")
    return rows.select("date", "ticker", "close", "previous", percent.alias("change"), days.alias("days"), cause.alias("cause")).filter(F.abs("change") > limit_percent + slack)


def incoherent_changes(quotes: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Rows whose announced change (percent) differs from that of closes by more than the tolerance."""
    computed = 100 * (F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1)
    return quotes.withColumn("computed", computed).filter(F.abs(F.col("announced") - F.col("computed")) > tolerance)


def coherence_share(quotes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Share of rows where close over the published previous close matches the published change."""
    computed = 100 * (F.try_divide("close", "previous") - 1)
    known = computed.isNotNull() & F.col("announced").isNotNull()
    agree = known & (F.abs(computed - F.col("announced")) < tolerance)
    return quotes.agg(F.count_if(known).alias("compared"), F.count_if(agree).alias("agreeing")).withColumn("share", F.try_divide("agreeing", "compared"))


def repeated_sessions(quotes: DataFrame, columns: tuple[str, ...] = ("volume_shares", "volume_value")) -> DataFrame:
    """Rows that repeat the row before on all volume columns, positive ones."""
    w = by_ticker()
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) > 0) & (F.col(c) == F.lag(c).over(w))
    return quotes.withColumn("_same", same).filter("_same").drop("_same")


def inconsistent_ohlc(quotes: DataFrame) -> DataFrame:
    return quotes.filter(~((F.col("low") <= F.col("close")) & (F.col("close") <= F.col("high"))))


def valued(quotes: DataFrame) -> DataFrame:
    """Fills a missing traded value with shares times the middle of low and high."""
    return quotes.withColumn("volume_value", F.coalesce("volume_value", F.col("volume_shares") * (F.col("low") + F.col("high")) / 2))


def witness(quotes: DataFrame, known: DataFrame) -> DataFrame:
    """Which unit a generic volume has: compares known sessions (date, ticker, shares, value)."""
    both = quotes.select("date", "ticker", F.col("volume").alias("_v")).join(known, ["date", "ticker"])
    unit = F.when(F.abs(F.col("_v") - F.col("shares")) < 1, "shares").when(F.abs(F.col("_v") - F.col("value")) < 1, "value")
    return both.select("date", "ticker", unit.alias("unit"))


def witness_verdict(quotes: DataFrame, known: DataFrame, source: str = "ticker") -> DataFrame:
    """(source, unit, compared) for each source of ``quotes``: a unit only if every compared session has it.

    Otherwise it says why: ``undecided`` where sessions match neither unit or not all the same one, ``unavailable`` where none is known.
    """
    seen = witness(quotes, known).join(quotes.select("date", "ticker", F.col(source).alias("_source")), ["date", "ticker"])
    told = seen.groupBy("_source").agg(F.count("*").alias("compared"), F.count("unit").alias("_told"), F.min("unit").alias("_lo"), F.max("unit").alias("_hi"))
    every = quotes.select(F.col(source).alias("_source")).distinct().join(told, "_source", "left")
    unit = F.when(F.col("compared").isNull(), "unavailable").when((F.col("compared") == F.col("_told")) & (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise("undecided")
    return every.select(F.col("_source").alias("source"), unit.alias("unit"), F.coalesce("compared", F.lit(0)).alias("compared"))


def provisional(quotes: DataFrame, today: Column, hour: Column, closing_hour: int) -> DataFrame:
    """Marks rows of a session that is still open: today's, seen before closing."""
    return quotes.withColumn("provisional", (F.col("date") == today) & (hour < closing_hour))


def closed_sessions(quotes: DataFrame, today: Column, hour: Column, closing_hour: int) -> DataFrame:
    """Rows of sessions that are over; those of a session that is still open are refused."""
    return provisional(quotes, today, hour, closing_hour).filter(~F.coalesce("provisional", F.lit(False))).drop("provisional")


def yearly_totals(dividends: DataFrame) -> DataFrame:
    return dividends.filter(F.col("fiscal_year").isNotNull()).groupBy("ticker", "fiscal_year").agg(F.sum("amount").alias("dated"))


def disagreements(dividends: DataFrame, fundamentals: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """(ticker, year) where the two dividend sources differ by more than the tolerance, widest first."""
    other = fundamentals.filter("indicator = 'dividend' and value > 0").groupBy("ticker", F.year("date").alias("fiscal_year")).agg(F.sum("value").alias("published"))
    both = yearly_totals(dividends).join(other, ["ticker", "fiscal_year"])
    gap = F.abs(F.try_divide("dated", "published") - 1)
    return both.withColumn("gap", gap).filter(F.col("gap") > tolerance).orderBy(F.desc("gap"), "ticker", "fiscal_year")


def with_other_source(dividends: DataFrame, fundamentals: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Dividends with the other source's amount where they disagree: all on the year's first row."""
    wrong = disagreements(dividends, fundamentals, tolerance).select("ticker", "fiscal_year", "published")
    first = F.row_number().over(Window.partitionBy("ticker", "fiscal_year").orderBy("ex_date", "amount")) == 1
    amount = F.when(F.col("published").isNull(), F.col("amount")).when(F.col("_first"), F.col("published")).otherwise(0.0)
    out = dividends.withColumn("_first", first).join(wrong, ["ticker", "fiscal_year"], "left").withColumn("amount", amount)
    return out.filter("amount > 0").select(*dividends.columns)


def freshness(quotes: DataFrame, today: Column, tolerance: int = 1) -> DataFrame:
    """Last session, working days since, sessions held, and whether that is stale."""
    out = quotes.agg(F.max("date").alias("last"), F.countDistinct("date").alias("sessions"))
    days = F.when(F.col("last") < today, F.size(F.filter(F.sequence(F.date_add("last", 1), today), lambda d: F.weekday(d) < 5))).otherwise(0)
    return out.withColumn("days", days).withColumn("stale", F.col("days") > tolerance)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and the sum of every numeric column."""
    sums = [F.sum(c).alias(f"sum_{c}") for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint")]
    return df.agg(F.count("*").alias("n"), *sums)


def quality_report(quotes: DataFrame, dividends: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """One row for each finding of the archive: check, ticker, where, value."""
    ghosts = ghost_rows(quotes).select(F.lit("ghost").alias("check"), "ticker", F.col("date").cast("string").alias("at"), F.col("factor").alias("value"))
    limits = limit_breaches(quotes).select(F.concat(F.lit("limit: "), "cause").alias("check"), "ticker", F.col("date").cast("string").alias("at"), F.col("change").alias("value"))
    sources = disagreements(dividends, fundamentals).select(F.lit("disagreement").alias("check"), "ticker", F.col("fiscal_year").cast("string").alias("at"), F.col("gap").alias("value"))
    return ghosts.unionByName(limits).unionByName(sources)
