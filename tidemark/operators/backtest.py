"""Replay of a ranking through time, without a loop: all steps are rows.

Decisions use the session's ranking, trades happen ``delay`` sessions later, dividends count from entry up to
exit, costs follow the share of names that changed since the last kept step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import change
from tidemark.operators.dividends import accrual
from tidemark.operators.features import rolling_features
from tidemark.operators.panel import dense, session_numbers
from tidemark.operators.quality import with_other_source
from tidemark.operators.ranking import ranking
from tidemark.operators.settle import settled
from tidemark.operators.stats import annualised, max_drawdown
from tidemark.settings import BacktestSettings, FeatureSettings, RankingSettings


def schedule(numbers: DataFrame, needed: int, settings: BacktestSettings) -> DataFrame:
    """(step, date, entry, exit, exit_n, entry_n): every ``step`` sessions from the first that has enough history.

    ``numbers`` is (date, n). Empty when the history does not hold one whole step.
    """
    last = numbers.agg(F.max("n").alias("last"))
    first = needed - 1
    rows = numbers.crossJoin(F.broadcast(last)).filter((F.col("n") >= first) & (F.col("n") < F.col("last") - settings.delay) & ((F.col("n") - first) % settings.step == 0))
    rows = rows.filter(F.col("last") + 1 >= needed + settings.delay + settings.step)
    rows = rows.select("date", "n", (F.col("n") + settings.delay).alias("entry_n"), F.least(F.col("n") + settings.delay + settings.step, "last").alias("exit_n"))
    at = lambda x: numbers.select(F.col("n").alias(f"{x}_n"), F.col("date").alias(x))
    rows = rows.filter("exit_n > entry_n").join(F.broadcast(at("entry")), "entry_n").join(F.broadcast(at("exit")), "exit_n")
    return rows.withColumn("step", F.row_number().over(Window.orderBy("date")))


def journal(
    quotes: DataFrame, reference: DataFrame, settings: BacktestSettings = BacktestSettings(), features: FeatureSettings = FeatureSettings(),
    ranks: RankingSettings = RankingSettings(), dividends: DataFrame | None = None, fundamentals: DataFrame | None = None, scenario: str | None = None,
) -> DataFrame:
    """One row for each kept step.

    Entry and exit prices come from the ticker's own window over the panel, and a session belongs to the step
    that its number gives, so neither needs a join by interval. ``quotes`` and ``dividends`` are read once.
    With ``scenario``, a column of ``dividends`` that names a few sources, each of them has its own journal over one ranking.
    """
    by = [] if scenario is None else [scenario]
    quotes = settled(quotes, "quotes")
    panel = dense(quotes)
    numbers = session_numbers(quotes.filter("close is not null"))
    last = numbers.agg(F.max("n").alias("last"))
    steps = schedule(numbers, features.needed, settings)
    own = Window.partitionBy("ticker").orderBy("date")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at_exit = F.coalesce(F.when(F.row_number().over(own) + settings.delay + settings.step > F.count("*").over(whole), F.last("close").over(whole)), F.lead("close", settings.delay + settings.step).over(own))
    priced = rolling_features(panel, features).withColumns({"entry_close": F.lead("close", settings.delay).over(own), "exit_close": at_exit})
    ranked = ranking(priced.join(F.broadcast(steps.select("date")), "date", "left_semi"), reference, ranks)
    rows = ranked.select("date", "ticker", (F.col("place") <= settings.positions).alias("chosen"), "place", "entry_close", "exit_close").join(F.broadcast(steps), "date")
    rows = rows.withColumn("gain", change(F.col("exit_close"), F.col("entry_close")))
    if dividends is not None:
        published = None if fundamentals is None else settled(fundamentals, "fundamentals")
        dividends = settled(dividends, "dividends")
        credits = accrual(quotes, dividends, published, by).join(F.broadcast(numbers), "date").crossJoin(F.broadcast(last))
        # sessions in [entry, exit) belong to exactly one step: holdings do not overlap
        place = F.col("n") - (features.needed - 1) - settings.delay
        held = credits.filter((place >= 0) & (F.col("n") < F.col("last"))).select(*by, "ticker", (F.floor(place / settings.step) + 1).cast("int").alias("step"), "accrued")
        if by:
            rows = rows.crossJoin(F.broadcast(dividends.select(*by).distinct()))  # the sources' names
        rows = rows.join(held.groupBy(*by, "step", "ticker").agg(F.sum("accrued").alias("paid")), [*by, "step", "ticker"], "left").fillna(0.0, ["paid"])
    else:
        rows = rows.withColumn("paid", F.lit(0.0))
    mine = F.col("chosen")
    each = rows.groupBy(*by, "step", "date", "entry", "exit").agg(
        F.avg(F.when(mine, F.col("gain"))).alias("gain"), F.avg(F.when(mine, F.col("paid"))).alias("dividend"),
        (F.avg("gain") + F.avg("paid")).alias("reference_gain"),
        F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("place", "ticker")))), lambda x: x["ticker"]).alias("held"),
    ).filter("gain is not null")
    over = Window.partitionBy(*by).orderBy("step")
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.coalesce(F.lag("held").over(over), F.array().cast("array<string>"))
    each = each.withColumn("turnover", F.size(F.array_except("held", previous)) / F.size("held"))
    each = each.withColumn("cost", F.col("turnover") * settings.unit_cost * 2)
    return each.withColumns({
        "value": F.product(1 + F.col("gain") + F.col("dividend") - F.col("cost")).over(so_far),
        "price_value": F.product(1 + F.col("gain") - F.col("cost")).over(so_far),
        "reference_value": F.product(1 + F.coalesce("reference_gain", F.lit(0.0))).over(so_far),
    })


def summary(steps: DataFrame, sessions: int, needed: int) -> DataFrame:
    """One row: totals, annual figures, drawdowns, turnover and cost; empty without steps."""
    n = sessions - (needed - 1)
    last = lambda c: F.max_by(c, "step").alias(c)
    out = steps.agg(F.count("*").alias("steps"), last("value"), last("price_value"), last("reference_value"), F.avg("turnover").alias("mean_turnover"), F.sum("cost").alias("total_cost")).filter("steps > 0")
    out = out.crossJoin(max_drawdown(steps)).crossJoin(max_drawdown(steps, "reference_value").withColumnRenamed("max_drawdown", "reference_drawdown"))
    return out.select(
        "steps", (F.col("value") - 1).alias("total"), annualised(F.col("value"), n).alias("yearly"), (F.col("price_value") - 1).alias("price_total"),
        annualised(F.col("price_value"), n).alias("price_yearly"), (F.col("value") - F.col("price_value")).alias("dividend_part"),
        (F.col("reference_value") - 1).alias("reference_total"), annualised(F.col("reference_value"), n).alias("reference_yearly"),
        "max_drawdown", "reference_drawdown", "mean_turnover", "total_cost",
        (F.col("value") - F.col("reference_value")).alias("gap_total"), (annualised(F.col("value"), n) - annualised(F.col("reference_value"), n)).alias("gap_yearly"),
    )


def curves(steps: DataFrame) -> DataFrame:
    """The value curves one below the other: (date, curve, value)."""
    return steps.unpivot("date", ["value", "reference_value"], "curve", "value").filter("value is not null")


def source_interval(quotes: DataFrame, reference: DataFrame, dividends: DataFrame, fundamentals: DataFrame, **settings) -> DataFrame:
    """Lowest and highest total return over the two dividend sources, from one ranking."""
    dividends, fundamentals = settled(dividends, "dividends"), settled(fundamentals, "fundamentals")
    other = with_other_source(dividends, fundamentals).select(dividends.columns)
    both = dividends.withColumn("source", F.lit("dated")).unionByName(other.withColumn("source", F.lit("published")))
    totals = journal(quotes, reference, dividends=both, fundamentals=fundamentals, scenario="source", **settings).groupBy("source").agg((F.max_by("value", "step") - 1).alias("total"))
    return totals.agg(F.min("total").alias("low"), F.max("total").alias("high"))
