"""Information coefficients, multiple testing, mean reversion and journal statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import average_rank, correlation
from tidemark.functions.student import student_p

#: Critical value of the Dickey-Fuller test with a constant, at 5 %.
DICKEY_FULLER = -2.86


def information_coefficients(df: DataFrame, x: str, y: str, group: Sequence[str], least: int) -> DataFrame:
    """Spearman correlation of x and y within each group, on rows that have both; null when undefined."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*group, average_rank(F.col(x), *group).alias("_x"), average_rank(F.col(y), *group).alias("_y"))
    out = ranked.groupBy(*group).agg(F.count("*").alias("members"), correlation(F.col("_x"), F.col("_y")).alias("ic"))
    return out.withColumn("ic", F.when(F.col("members") >= least, F.col("ic")))


def mean_coefficient(ics: DataFrame, horizon: Column | int, group: Sequence[str] = (), least_periods: int = 2) -> DataFrame:
    """Mean of the sessions' coefficients, with the error of as many disjoint periods as they hold."""
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    out = ics.filter("ic is not null").groupBy(*group).agg(F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("_spread"), F.count("*").alias("sessions"))
    out = out.withColumn("periods", F.ceil(F.col("sessions") / h).cast("long"))
    error = F.when((F.col("periods") >= least_periods) & (F.col("_spread") > 0), F.col("_spread") / F.sqrt("periods"))
    return out.withColumn("error", error).withColumn("t", F.col("ic") / F.col("error")).withColumn("significant", F.coalesce(F.abs("t") > 2, F.lit(False))).drop("_spread")


def with_p_value(df: DataFrame, t: str = "t", freedom: Column | None = None) -> DataFrame:
    return df.withColumn("p", student_p(F.col(t), freedom if freedom is not None else F.col("periods") - 1))


def benjamini_hochberg(df: DataFrame, rate: float = 0.10, p: str = "p") -> DataFrame:
    """Adds ``discovered``: p up to the largest rank r with p <= rate * r / tests. Null p never counts.

    Equal p are counted first; ranks are counts cumulated within ranges of p, after the counts of all lower ranges.
    """
    counted = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    cuts = counted.agg(F.percentile_approx("_p", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(max(10_000, 10 * ranges))).alias("_cuts"))
    dealt = counted.crossJoin(F.broadcast(cuts)).select("_p", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_p"))).alias("_range"))
    sizes = dealt.groupBy("_range").agg(F.sum("_n").alias("n")).agg(F.collect_list(F.struct("_range", "n")).alias("_sizes"))  # a number for each range
    summed = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    own = F.sum("_n").over(Window.partitionBy("_range").orderBy("_p"))
    lower = summed(F.filter("_sizes", lambda s: s["_range"] < F.col("_range")))
    ranked = dealt.crossJoin(F.broadcast(sizes)).select("_p", (own + lower).alias("_r"), summed(F.col("_sizes")).alias("_m"))
    bound = ranked.filter(F.col("_p") <= rate * F.col("_r") / F.col("_m")).agg(F.max("_p").alias("_bound"))
    return df.crossJoin(F.broadcast(bound)).withColumn("discovered", F.coalesce((F.col(p) <= F.col("_bound")) & ~F.isnan(p), F.lit(False))).drop("_bound")


def mean_reversion(df: DataFrame, value: str, least_rows: int = 30, order: str = "date") -> DataFrame:
    """Ornstein-Uhlenbeck fit of each ticker's own rows: change regressed on the level before.

    theta and equilibrium are null unless there are rows and values enough, theta is positive and the
    Dickey-Fuller statistic rejects a random walk.
    """
    w = Window.partitionBy("ticker").orderBy(order)
    rows = df.filter(F.col(value).isNotNull()).select("ticker", order, F.col(value).alias("y")).withColumn("x", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("x"))
    fit = rows.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.countDistinct("y").alias("distinct"), F.max_by("y", order).alias("last"), F.stddev_samp("y").alias("spread"),
        F.regr_slope("d", "x").alias("slope"), F.regr_intercept("d", "x").alias("intercept"), F.regr_count("d", "x").alias("n"),
        F.regr_sxx("d", "x").alias("sxx"), F.regr_syy("d", "x").alias("syy"), F.regr_sxy("d", "x").alias("sxy"),
    )
    residual = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    error = F.sqrt(F.try_divide(residual / F.when(F.col("n") > 2, F.col("n") - 2), F.col("sxx")))
    fit = fit.withColumn("statistic", F.try_divide(F.col("slope"), error)).withColumn("theta", -F.col("slope"))
    good = (F.col("rows") >= least_rows) & (F.col("distinct") >= 5) & (F.col("theta") > 0) & (F.col("statistic") <= DICKEY_FULLER)
    return fit.select(
        "ticker", "rows", "last", "spread", "statistic", F.when(good, F.col("theta")).alias("theta"),
        F.when(good, F.try_divide(F.col("intercept"), F.col("theta"))).alias("equilibrium"),
    ).withColumn("half_life", half_life(F.col("theta")))


def half_life(theta: Column) -> Column:
    """ln 2 / theta; endless where there is no pull."""
    return F.when(theta > 0, F.ln(F.lit(2.0)) / theta).otherwise(F.lit(float("inf")))


def max_drawdown(journal: DataFrame, value: str = "value", order: str = "step") -> DataFrame:
    peak = F.max(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return journal.select((F.col(value) / peak - 1).alias("_d")).agg(F.min("_d").alias("max_drawdown"))


def annualised(value: Column, sessions: Column | int, sessions_a_year: int = 250) -> Column:
    n = F.lit(sessions) if isinstance(sessions, int) else sessions
    return F.when((value > 0) & (n > 0), F.pow(value, F.lit(float(sessions_a_year)) / n) - 1)
