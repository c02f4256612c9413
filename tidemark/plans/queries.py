"""One registered query for each relational operator, and the same result in DuckDB SQL.

Dates are returned as text and numbers rounded, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, dividends, exogenous, features, learn, merge, panel, quality, ranking, research, snapshot, stats
from tidemark.operators.dedupe import union_by_priority
from tidemark.operators.settle import settled
from tidemark.plans.fixtures import BACKTEST, EXTERNAL, FEATURES, LEARNING, RANKS, SWEEP, cte, load
from tidemark.sources import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits) + 0.0
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, digits: int = 6):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: shown(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- SQL pieces ---------------------------------------------------------------------------------------------------------
PANEL = f"""{cte("quotes")},
cal AS (SELECT DISTINCT date FROM quotes), tick AS (SELECT DISTINCT ticker FROM quotes),
panel AS (SELECT c.date, t.ticker, q.low, q.high, q.close, q.volume_shares, q.volume_value FROM cal c CROSS JOIN tick t LEFT JOIN quotes q ON q.date = c.date AND q.ticker = t.ticker)"""
LOGS = f"""{PANEL},
logs AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END - lag(CASE WHEN close > 0 THEN ln(close) END) OVER (PARTITION BY ticker ORDER BY date) AS r FROM panel)"""


def strict_sql(agg: str, x: str, n: int) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def lagged_sql(now: int, before: int) -> str:
    lag = lambda n: f"lag(close, {n}) OVER (PARTITION BY ticker ORDER BY date)"
    return f"CASE WHEN {lag(before)} > 0 THEN {lag(now) if now else 'close'} / {lag(before)} - 1 END"


FEATS = f"""{LOGS},
feats AS (SELECT date, ticker, close, volume_value, {lagged_sql(2, 26)} AS momentum,
  {strict_sql("avg", "close", 4)} / {strict_sql("avg", "close", 12)} - 1 AS trend,
  {strict_sql("stddev_samp", "r", 12)} * sqrt(52.0) AS volatility,
  quantile_cont(coalesce(volume_value, 0), 0.5) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS liquidity FROM logs)"""


def rank_sql(x: str, part: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}) END"


PREDICTOR_SQL = {
    "momentum_long": lagged_sql(2, 26), "momentum_half": lagged_sql(2, 13), "reversal": f"-({lagged_sql(0, 2)})",
    "trend": f"{strict_sql('avg', 'close', 4)} / {strict_sql('avg', 'close', 12)} - 1", "volatility": f"{strict_sql('stddev_samp', 'r', 12)} * sqrt(52.0)",
    "liquidity": "quantile_cont(coalesce(volume_value, 0), 0.5) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
    "amplitude": strict_sql("avg", "CASE WHEN close > 0 THEN (high - low) / close END", 12), "gap_to_mean": f"close / {strict_sql('avg', 'close', 26)} - 1",
}
FORWARD = "CASE WHEN close > 0 THEN lead(close, {}) OVER (PARTITION BY ticker ORDER BY date) / close - 1 END"
PREDICTORS = f"{LOGS}, pd AS (SELECT date, ticker, {', '.join(f'{x} AS {p}' for p, x in PREDICTOR_SQL.items())}, {FORWARD.format(4)} AS h4, {FORWARD.format(8)} AS h8 FROM logs)"
RANKED = f"""{FEATS},
{cte("reference")},
gated AS (SELECT * FROM feats WHERE coalesce(liquidity, 0) >= 1000 AND momentum IS NOT NULL AND trend IS NOT NULL AND volatility IS NOT NULL),
rk AS (SELECT *, {rank_sql("momentum", "date")} AS a, {rank_sql("trend", "date")} AS b, {rank_sql("volatility", "date")} AS c FROM gated),
sc AS (SELECT rk.*, name, sector, 100 * ((0.5 * a + 0.3 * b - 0.2 * c) / 1.0 + 0.5) AS s FROM rk LEFT JOIN reference USING (ticker)),
nt AS (SELECT *, CASE WHEN sector IS NOT NULL AND count(*) OVER (PARTITION BY date, sector) >= 5 THEN s - avg(s) OVER (PARTITION BY date, sector) + avg(s) OVER (PARTITION BY date) ELSE s END AS z FROM sc),
ranking AS (SELECT *, round(z, 9) AS score, row_number() OVER (PARTITION BY date ORDER BY round(z, 9) DESC, ticker) AS place FROM nt)"""
YIELDS = f"""{cte("quotes", "dividends")},
ev AS (SELECT d.*, (SELECT max(q.date) FROM quotes q WHERE q.date <= d.ex_date) AS session FROM dividends d WHERE amount > 0),
pr AS (SELECT ev.*, amount / q.close AS y FROM ev JOIN quotes q ON q.date = ev.session AND q.ticker = ev.ticker WHERE q.close > 0),
fr AS (SELECT *, max(CASE WHEN y > 0.4 THEN session END) OVER (PARTITION BY ticker) AS frontier FROM pr),
yields AS (SELECT session, ticker, fiscal_year, ex_date, amount, y FROM fr WHERE frontier IS NULL OR session > frontier)"""
ACCRUAL = f"""{YIELDS},
{cte("fundamentals")},
dated AS (SELECT session AS date, ticker, sum(y) AS accrued FROM yields GROUP BY 1, 2),
cov AS (SELECT DISTINCT ticker, fiscal_year AS year FROM yields WHERE fiscal_year IS NOT NULL),
pub AS (SELECT ticker, year(date) AS year, max(value) AS value FROM fundamentals WHERE indicator = 'yield' GROUP BY 1, 2),
ses AS (SELECT date, year(date) AS year, count(*) OVER (PARTITION BY year(date)) AS n FROM (SELECT DISTINCT date FROM quotes)),
spread AS (SELECT ses.date, pub.ticker, value / 100 / n AS spread FROM pub JOIN ses ON ses.year = pub.year
  WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.ticker = pub.ticker AND cov.year = pub.year) AND pub.ticker IN (SELECT ticker FROM quotes)),
accrual AS (SELECT coalesce(d.date, s.date) AS date, coalesce(d.ticker, s.ticker) AS ticker, coalesce(s.spread, d.accrued) AS accrued FROM dated d FULL OUTER JOIN spread s ON s.date = d.date AND s.ticker = d.ticker)"""
JOURNAL = f"""{RANKED},
{cte("dividends")},
{ACCRUAL.removeprefix(cte("quotes", "dividends") + ",").strip()},
num AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM cal),
st0 AS (SELECT date, n, n + 1 AS entry_n, least(n + 9, (SELECT max(n) FROM num)) AS exit_n FROM num WHERE n >= 26 AND n < (SELECT max(n) FROM num) - 1 AND (n - 26) % 8 = 0 AND (SELECT max(n) FROM num) + 1 >= 36),
steps AS (SELECT row_number() OVER (ORDER BY s.date) AS step, s.date, e.date AS entry, x.date AS exit, entry_n, exit_n FROM st0 s JOIN num e ON e.n = entry_n JOIN num x ON x.n = exit_n WHERE exit_n > entry_n),
held AS (SELECT s.step, s.date, s.entry, s.exit, r.ticker, r.place, r.place <= 5 AS chosen, CASE WHEN e.close > 0 THEN x.close / e.close - 1 END AS gain,
  coalesce((SELECT sum(a.accrued) FROM accrual a JOIN num ON num.date = a.date WHERE a.ticker = r.ticker AND num.n >= s.entry_n AND num.n < s.exit_n), 0) AS paid
  FROM steps s JOIN ranking r ON r.date = s.date LEFT JOIN panel e ON e.date = s.entry AND e.ticker = r.ticker LEFT JOIN panel x ON x.date = s.exit AND x.ticker = r.ticker),
each0 AS (SELECT step, date, entry, exit, avg(gain) FILTER (chosen) AS gain, avg(paid) FILTER (chosen) AS dividend, avg(gain) + avg(paid) AS reference_gain, list(ticker ORDER BY place) FILTER (chosen) AS held FROM held GROUP BY ALL HAVING avg(gain) FILTER (chosen) IS NOT NULL),
each1 AS (SELECT *, len([x FOR x IN held IF NOT list_contains(coalesce(lag(held) OVER (ORDER BY step), CAST([] AS VARCHAR[])), x)]) / CAST(len(held) AS DOUBLE) AS turnover FROM each0),
each2 AS (SELECT *, turnover * 0.015 * 2 AS cost FROM each1),
journal AS (SELECT *, exp(sum(ln(1 + gain + dividend - cost)) OVER w) AS value, exp(sum(ln(1 + gain - cost)) OVER w) AS price_value, exp(sum(ln(1 + coalesce(reference_gain, 0))) OVER w) AS reference_value FROM each2 WINDOW w AS (ORDER BY step))"""


def quotes_of(spark, d):
    return load(spark, d, "quotes")


def panel_of(spark, d):
    return panel.dense(quotes_of(spark, d))


def features_of(spark, d):
    return features.rolling_features(panel_of(spark, d), FEATURES)


def ranking_of(spark, d):
    return ranking.ranking(features_of(spark, d), load(spark, d, "reference"), RANKS)


# -- panel, features, ranking --------------------------------------------------------------------------------------------
@query(f"WITH {PANEL} SELECT CAST(date AS VARCHAR) AS date, ticker, round(low, 6) AS low, round(high, 6) AS high, round(close, 6) AS close, round(volume_shares, 6) AS volume_shares, round(volume_value, 6) AS volume_value FROM panel")
def dense_panel(spark, d):
    return panel_of(spark, d).select("date", "ticker", "low", "high", "close", "volume_shares", "volume_value")


@query(f"WITH {FEATS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(momentum, 6) AS momentum, round(trend, 6) AS trend, round(volatility, 6) AS volatility, round(liquidity, 6) AS liquidity FROM feats")
def rolling_features(spark, d):
    return features_of(spark, d).select("date", "ticker", "momentum", "trend", "volatility", "liquidity")


@query(f"WITH {LOGS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(quantile_cont(coalesce(volume_value, 0), 0.5) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS liquidity FROM logs")
def sliding_liquidity(spark, d):
    """Median traded value of up to sixty sessions, from order statistics kept over the sliding window."""
    return features.sliding_median(panel_of(spark, d), F.coalesce("volume_value", F.lit(0.0)), 60, "liquidity").select("date", "ticker", "liquidity")


@query(f"WITH {FEATS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(momentum, 6) AS momentum, round(trend, 6) AS trend, round(volatility, 6) AS volatility, round(liquidity, 6) AS liquidity FROM feats WHERE date = (SELECT max(date) FROM feats)")
def latest_features(spark, d):
    return features.latest(features_of(spark, d)).select("date", "ticker", "momentum", "trend", "volatility", "liquidity")


@query(f"WITH {PREDICTORS} SELECT CAST(date AS VARCHAR) AS date, ticker, {', '.join(f'round({p}, 6) AS {p}' for p in PREDICTOR_SQL)}, round(h8, 6) AS forward FROM pd")
def sweep_predictors(spark, d):
    rows = features.with_log_return(panel_of(spark, d))
    return rows.select("date", "ticker", *[column().alias(name) for name, column in features.predictors(FEATURES).items()], features.forward_return(8).alias("forward"))


@query(f"WITH {RANKED} SELECT CAST(date AS VARCHAR) AS date, ticker, name, sector, round(score, 6) AS score, place FROM ranking")
def session_ranking(spark, d):
    return ranking_of(spark, d).select("date", "ticker", "name", "sector", "score", "place")


@query(f"WITH {RANKED} SELECT CAST(date AS VARCHAR) AS date, ticker, round(score, 6) AS score, place FROM ranking WHERE place <= 5")
def top_of_each_session(spark, d):
    return ranking_of(spark, d).filter("place <= 5").select("date", "ticker", "score", "place")


@query(f"WITH {FEATS} SELECT CAST(date AS VARCHAR) AS date, ticker, round({rank_sql('momentum', 'date')}, 6) AS rank FROM feats")
def percentile_ranks(spark, d):
    from tidemark.functions.panel import average_rank

    return features_of(spark, d).select("date", "ticker", average_rank(F.col("momentum"), "date").alias("rank"))


# -- as-of joins and external series ---------------------------------------------------------------------------------------
@query(f"WITH {cte('quotes', 'dividends')} SELECT ticker, CAST(ex_date AS VARCHAR) AS ex_date, round(amount, 6) AS amount, CAST((SELECT max(q.date) FROM quotes q WHERE q.date <= d.ex_date) AS VARCHAR) AS session FROM dividends d")
def as_of_sessions(spark, d):
    return panel.as_of_calendar(load(spark, d, "dividends"), panel.calendar(quotes_of(spark, d)), "ex_date").select("ticker", "ex_date", "amount", "session")


FILLED = f"""{cte("quotes", "external")}, cal AS (SELECT DISTINCT date FROM quotes), ser AS (SELECT DISTINCT series FROM external),
filled AS (SELECT c.date, s.series, (SELECT arg_max(e.value, e.date) FROM external e WHERE e.series = s.series AND e.date <= c.date) AS value FROM cal c CROSS JOIN ser s),
varied AS (SELECT date, series, CASE WHEN lag(value, 20) OVER w > 0 THEN lag(value, 8) OVER w / lag(value, 20) OVER w - 1 END AS variation FROM filled WINDOW w AS (PARTITION BY series ORDER BY date))"""


@query(f"WITH {FILLED} SELECT CAST(date AS VARCHAR) AS date, series, round(value, 6) AS value FROM filled")
def forward_filled_series(spark, d):
    return panel.forward_filled(load(spark, d, "external"), panel.calendar(quotes_of(spark, d)))


@query(f"WITH {FILLED} SELECT CAST(date AS VARCHAR) AS date, series, round(variation, 6) AS variation FROM varied")
def series_variations(spark, d):
    return exogenous.variations(panel.forward_filled(load(spark, d, "external"), panel.calendar(quotes_of(spark, d))), 12, 8)


def mapping_of(spark):
    return spark.createDataFrame([("1-URGENT", "S1"), ("2-HIGH", "S2"), ("3-MEDIUM", "S3"), ("5-LOW", "none")], "series string, sector string")


@query(f"""WITH {FILLED}, {cte("reference")}, map AS (SELECT * FROM (VALUES ('1-URGENT', 'S1'), ('2-HIGH', 'S2'), ('3-MEDIUM', 'S3')) m(series, sector))
SELECT CAST(v.date AS VARCHAR) AS date, r.ticker, v.series, round(CASE WHEN r.sector = m.sector THEN coalesce(variation, 0) ELSE 0 END, 6) AS value FROM varied v JOIN map m ON m.series = v.series CROSS JOIN reference r""")
def sector_interactions(spark, d):
    dates, listed, mapping = panel.calendar(quotes_of(spark, d)), load(spark, d, "reference"), mapping_of(spark)
    return exogenous.with_noughts(exogenous.external_features(load(spark, d, "external"), dates, listed, mapping, EXTERNAL), dates, listed, mapping)


@query(f"WITH {cte('external')} SELECT series, count(*) AS points, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM external GROUP BY 1")
def external_coverage(spark, d):
    return exogenous.coverage(load(spark, d, "external"))


@query(f"WITH {cte('external')} SELECT series, CAST(max(date) AS VARCHAR) AS date, round(arg_max(value, date), 6) AS value FROM external GROUP BY 1")
def latest_series_points(spark, d):
    return snapshot.latest_points(load(spark, d, "external"))


# -- dividends ----------------------------------------------------------------------------------------------------------
@query(f"WITH {YIELDS} SELECT CAST(session AS VARCHAR) AS session, ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, round(amount, 6) AS amount, round(y, 6) AS yield FROM yields")
def dated_dividend_yields(spark, d):
    return dividends.dated_yields(quotes_of(spark, d), load(spark, d, "dividends")).select("session", "ticker", "fiscal_year", "amount", "yield")


@query(f"WITH {ACCRUAL} SELECT CAST(date AS VARCHAR) AS date, ticker, round(accrued, 9) AS accrued FROM accrual", digits=9)
def total_return_accrual(spark, d):
    return dividends.accrual(settled(quotes_of(spark, d), "quotes"), settled(load(spark, d, "dividends"), "dividends"), settled(load(spark, d, "fundamentals"), "fundamentals"))


@query(f"""WITH {ACCRUAL}, known AS (SELECT ticker, year FROM cov UNION SELECT ticker, year(date) FROM fundamentals WHERE indicator = 'yield')
SELECT count(*) AS pairs, count(k.ticker) AS known, round(count(k.ticker) / CAST(count(*) AS DOUBLE), 6) AS share, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(year AS VARCHAR) AS y FROM known)) AS years
FROM quotes q LEFT JOIN known k ON k.ticker = q.ticker AND k.year = year(q.date)""")
def dividend_coverage(spark, d):
    return dividends.coverage(quotes_of(spark, d), load(spark, d, "dividends"), load(spark, d, "fundamentals"))


TRAIL = f"""{cte("quotes", "dividends")},
trail AS (SELECT q.date, q.ticker, coalesce((SELECT sum(amount) FROM dividends v WHERE v.ticker = q.ticker AND v.ex_date > q.date - 365 AND v.ex_date <= q.date), 0) / q.close AS y FROM quotes q WHERE close > 0)"""


@query(f"WITH {TRAIL} SELECT CAST(date AS VARCHAR) AS date, ticker, round(y, 6) AS yield FROM trail")
def trailing_dividend_yield(spark, d):
    return dividends.trailing_yield(quotes_of(spark, d), load(spark, d, "dividends"))


def reversion_sql(rows: str, least: int) -> str:
    """CTEs that fit each ticker's own rows of ``rows`` (ticker, date, y)."""
    return f"""lv AS (SELECT ticker, date, y, lag(y) OVER (PARTITION BY ticker ORDER BY date) AS x FROM {rows}),
ft AS (SELECT ticker, count(*) AS rows, count(DISTINCT y) AS d, arg_max(y, date) AS last, stddev_samp(y) AS spread, regr_slope(y - x, x) AS b, regr_intercept(y - x, x) AS a, regr_count(y - x, x) AS n, regr_sxx(y - x, x) AS sxx, regr_syy(y - x, x) AS syy, regr_sxy(y - x, x) AS sxy FROM lv GROUP BY 1),
st AS (SELECT *, CASE WHEN n > 2 AND sxx > 0 AND syy - sxy * sxy / sxx > 0 THEN b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) END AS statistic FROM ft),
ou AS (SELECT *, CASE WHEN rows >= {least} AND d >= 5 AND b < 0 AND statistic <= -2.86 THEN -b END AS theta FROM st)"""


@query(f"""WITH {TRAIL}, {reversion_sql("trail", 30)}
SELECT ticker, round(last, 6) AS yield, round(a / theta, 6) AS equilibrium, round((last - a / theta) / spread, 6) AS gap, CASE WHEN theta > 0 THEN round(ln(2) / theta, 6) ELSE CAST('Infinity' AS DOUBLE) END AS half_life, coalesce(ln(2) / theta <= 8, false) AS usable FROM ou""")
def dividend_yield_signal(spark, d):
    return dividends.yield_signal(quotes_of(spark, d), load(spark, d, "dividends"), horizon=8)


@query(f"""WITH {cte("quotes")}, lg AS (SELECT ticker, date, ln(close) AS y FROM quotes WHERE close > 0), {reversion_sql("lg", 30)}
SELECT ticker, rows, round(exp(last), 6) AS close, round(exp(a / theta), 6) AS equilibrium, round(theta, 6) AS theta, CASE WHEN theta > 0 THEN round(ln(2) / theta, 6) ELSE CAST('Infinity' AS DOUBLE) END AS half_life, round(statistic, 6) AS statistic, coalesce(ln(2) / theta <= 120, false) AS usable, round(0.05 * count(*) OVER (), 6) AS by_chance FROM ou""")
def mean_reversion_by_ticker(spark, d):
    return research.return_to_mean(quotes_of(spark, d), least_rows=100)


def spearman_sql(rows: str, x: str, y: str, group: str, least: int) -> str:
    """CTEs xr, ic (group, members, ic) from rows that have both values."""
    return f"""xr AS (SELECT {group}, {rank_sql(x, group)} AS rx, {rank_sql(y, group)} AS ry FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
ic AS (SELECT {group}, count(*) AS members, CASE WHEN count(*) >= {least} AND stddev_samp(rx) * stddev_samp(ry) > 1e-15 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic FROM xr GROUP BY {group})"""


@query(f"""WITH {YIELDS},
sea AS (SELECT ticker, year(session) AS season, sum(y) AS y, max(session) AS start FROM yields GROUP BY 1, 2),
hd AS (SELECT s.ticker, s.season, s.y, count(*) AS n, arg_min(q.close, q.date) AS f, arg_max(q.close, q.date) AS l FROM sea s JOIN quotes q ON q.ticker = s.ticker AND q.date >= s.start AND q.date <= s.start + 365 GROUP BY 1, 2, 3),
eh AS (SELECT *, l / f - 1 AS fw FROM hd WHERE n >= 40 AND f > 0), {spearman_sql("eh", "y", "fw", "season", 8)}
SELECT season, members, round(ic, 6) AS ic FROM ic WHERE ic IS NOT NULL""")
def seasonal_dividend_coefficient(spark, d):
    return research.seasonal_yield(quotes_of(spark, d), load(spark, d, "dividends"), least_sessions=40).withColumn("season", F.col("season").cast("long"))


# -- quality ------------------------------------------------------------------------------------------------------------
GHOST = " ".join(f"WHEN abs(b - {m!r}) / {m!r} < 0.12 AND abs(a - {m!r}) / {m!r} < 0.12 THEN {m!r}" for m in reversed([m for k in range(2, 11) for m in (float(k), 1 / k)]))
GHOSTS = f"""{cte("quotes")}, nb AS (SELECT date, ticker, close, lag(close) OVER w AS p, lead(close) OVER w AS f FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY date)),
gr AS (SELECT *, close / p AS b, close / f AS a FROM nb), ghosts AS (SELECT * FROM (SELECT *, CASE {GHOST} END AS factor FROM gr) WHERE factor IS NOT NULL)"""


@query(f"WITH {GHOSTS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close, round(p, 6) AS previous, round(f, 6) AS following, round(factor, 6) AS factor FROM ghosts")
def ghost_rows(spark, d):
    return quality.ghost_rows(quotes_of(spark, d))


@query(f"WITH {GHOSTS} SELECT ticker, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(round(factor, 4) AS DOUBLE))), ',') AS factors, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM ghosts GROUP BY 1")
def ghost_summary(spark, d):
    out = quality.ghost_summary(quality.ghost_rows(quotes_of(spark, d)))
    return out.withColumn("factors", F.concat_ws(",", F.transform("factors", lambda x: x.cast("string"))))


LIMITS = f"""{cte("quotes")}, lm AS (SELECT date, ticker, close, lag(close) OVER w AS p, date - lag(date) OVER w AS days FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY date)),
limits AS (SELECT *, 100 * (close / p - 1) AS change, CASE WHEN days > 7 THEN 'gap' WHEN month(date) BETWEEN 5 AND 8 THEN 'dividend season' ELSE 'to examine' END AS cause FROM lm WHERE abs(100 * (close / p - 1)) > 7.6)"""


@query(f"WITH {LIMITS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close, round(p, 6) AS previous, round(change, 6) AS change, CAST(days AS BIGINT) AS days, cause FROM limits")
def limit_breaches(spark, d):
    return quality.limit_breaches(quotes_of(spark, d))


@query(f"WITH {LIMITS} SELECT cause, count(*) AS n FROM limits GROUP BY 1")
def limit_breaches_by_cause(spark, d):
    return quality.limit_breaches(quotes_of(spark, d)).groupBy("cause").agg(F.count("*").alias("n"))


DIS = f"""{cte("dividends", "fundamentals")}, dt AS (SELECT ticker, fiscal_year, sum(amount) AS dated FROM dividends GROUP BY 1, 2), pb AS (SELECT ticker, year(date) AS fiscal_year, sum(value) AS published FROM fundamentals WHERE indicator = 'dividend' AND value > 0 GROUP BY 1, 2),
dis AS (SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, dated, published, abs(dated / published - 1) AS gap FROM dt JOIN pb USING (ticker, fiscal_year) WHERE abs(dated / published - 1) > 0.1)"""


@query(f"WITH {DIS} SELECT ticker, fiscal_year, round(dated, 6) AS dated, round(published, 6) AS published, round(gap, 6) AS gap FROM dis")
def source_disagreements(spark, d):
    return quality.disagreements(load(spark, d, "dividends"), load(spark, d, "fundamentals")).select("ticker", "fiscal_year", "dated", "published", "gap")


@query(f"""WITH {DIS}, fr AS (SELECT v.*, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY ex_date, amount) AS rn FROM dividends v),
ot AS (SELECT f.ticker, f.ex_date, CAST(f.fiscal_year AS BIGINT) AS fiscal_year, CASE WHEN d.published IS NULL THEN f.amount WHEN rn = 1 THEN d.published ELSE 0 END AS amount FROM fr f LEFT JOIN dis d ON d.ticker = f.ticker AND d.fiscal_year = f.fiscal_year)
SELECT ticker, CAST(ex_date AS VARCHAR) AS ex_date, fiscal_year, round(amount, 6) AS amount FROM ot WHERE amount > 0""")
def dividends_of_other_source(spark, d):
    return quality.with_other_source(load(spark, d, "dividends"), load(spark, d, "fundamentals")).select("ticker", "ex_date", "fiscal_year", "amount")


@query(f"WITH {cte('quotes')}, rp AS (SELECT *, lag(volume_shares) OVER (PARTITION BY ticker ORDER BY date) AS p FROM quotes) SELECT CAST(date AS VARCHAR) AS date, ticker, round(volume_shares, 6) AS volume_shares FROM rp WHERE volume_shares > 0 AND volume_shares = p")
def repeated_sessions(spark, d):
    return quality.repeated_sessions(quotes_of(spark, d), ("volume_shares",)).select("date", "ticker", "volume_shares")


ANNOUNCED = f"""{cte("quotes")}, pv AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM quotes), an AS (SELECT *, round(100 * (close / previous - 1) + CASE WHEN day(date) % 5 = 0 THEN 0.5 ELSE 0 END, 4) AS announced FROM pv)"""


def announced_of(spark, d):
    rows = quotes_of(spark, d).withColumn("previous", F.lag("close").over(features.by_ticker()))
    return rows.withColumn("announced", F.round(100 * (F.col("close") / F.col("previous") - 1) + F.when(F.dayofmonth("date") % 5 == 0, 0.5).otherwise(0), 4))


@query(f"WITH {ANNOUNCED} SELECT CAST(date AS VARCHAR) AS date, ticker, round(announced, 3) AS announced FROM an WHERE abs(announced - 100 * (close / previous - 1)) > 0.02", digits=3)
def incoherent_changes(spark, d):
    return quality.incoherent_changes(announced_of(spark, d)).select("date", "ticker", "announced")


@query(f"WITH {ANNOUNCED} SELECT count(*) FILTER (announced IS NOT NULL) AS compared, count(*) FILTER (abs(announced - 100 * (close / previous - 1)) < 0.01) AS agreeing, round(count(*) FILTER (abs(announced - 100 * (close / previous - 1)) < 0.01) / CAST(count(*) FILTER (announced IS NOT NULL) AS DOUBLE), 6) AS share FROM an")
def change_coherence(spark, d):
    return quality.coherence_share(announced_of(spark, d))


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close FROM quotes WHERE NOT (low <= close - 1 AND close <= high)")
def inconsistent_ohlc(spark, d):
    return quality.inconsistent_ohlc(quotes_of(spark, d).withColumn("close", F.col("close") - 1)).select("date", "ticker", (F.col("close") + 1).alias("close"))


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, ticker, round(CASE WHEN month(date) = 3 THEN volume_shares * (low + high) / 2 ELSE volume_value END, 4) AS volume_value FROM quotes", digits=4)
def rebuilt_traded_value(spark, d):
    rows = quotes_of(spark, d).withColumn("volume_value", F.when(F.month("date") != 3, F.col("volume_value")))
    return quality.valued(rows).select("date", "ticker", "volume_value")


@query(f"WITH {cte('quotes')} SELECT CAST(max(date) AS VARCHAR) AS last, count(DISTINCT date) AS sessions, (SELECT count(*) FROM range(CAST(max(date) + 1 AS TIMESTAMP), TIMESTAMP '2001-12-02', INTERVAL 1 DAY) r(x) WHERE isodow(x) < 6) AS days, true AS stale FROM quotes")
def archive_freshness(spark, d):
    return quality.freshness(quotes_of(spark, d), F.lit("2001-12-01").cast("date"))


@query(f"WITH {cte('quotes')} SELECT count(*) AS n, round(sum(low), 2) AS sum_low, round(sum(high), 2) AS sum_high, round(sum(close), 2) AS sum_close, round(sum(volume_shares), 2) AS sum_volume_shares, round(sum(volume_value), 2) AS sum_volume_value FROM quotes", digits=2)
def table_fingerprint(spark, d):
    return quality.fingerprint(quotes_of(spark, d))


@query(f"""WITH {GHOSTS}, {LIMITS.removeprefix(cte("quotes") + ",").strip()}, {DIS}
SELECT 'ghost' AS "check", ticker, CAST(date AS VARCHAR) AS at, round(factor, 6) AS value FROM ghosts UNION ALL SELECT concat('limit: ', cause), ticker, CAST(date AS VARCHAR), round(change, 6) FROM limits UNION ALL SELECT 'disagreement', ticker, CAST(fiscal_year AS VARCHAR), round(gap, 6) FROM dis""")
def quality_report(spark, d):
    return quality.quality_report(quotes_of(spark, d), load(spark, d, "dividends"), load(spark, d, "fundamentals"))


@query(f"WITH {GHOSTS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM ghosts g WHERE g.date = q.date AND g.ticker = q.ticker)")
def cleaned_quotes(spark, d):
    rows = quotes_of(spark, d)
    return merge.remove_rows(rows, quality.ghost_rows(rows)).select("date", "ticker", "close")


# -- merging and tables ---------------------------------------------------------------------------------------------------
def halves(spark, d):
    rows = quotes_of(spark, d)
    known = rows.filter(F.year("date") <= 1999).withColumn("high", F.when(F.month("date") != 6, F.col("high")))
    fresh = rows.filter(F.year("date") >= 1998).withColumn("close", F.col("close") + 1)
    return known, fresh


@query(f"""WITH {cte("quotes")}, k AS (SELECT date, ticker, low, CASE WHEN month(date) <> 6 THEN high END AS high, close FROM quotes WHERE year(date) <= 1999), n AS (SELECT date, ticker, low, high, close + 1 AS close FROM quotes WHERE year(date) >= 1998)
SELECT CAST(coalesce(k.date, n.date) AS VARCHAR) AS date, coalesce(k.ticker, n.ticker) AS ticker, round(coalesce(k.high, n.high), 6) AS high, round(coalesce(k.close, n.close), 6) AS close, CAST(CASE WHEN k.date IS NOT NULL AND k.high IS NULL AND n.high IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS filled FROM k FULL OUTER JOIN n ON n.date = k.date AND n.ticker = k.ticker""")
def field_level_merge(spark, d):
    return merge.merge_fields(*halves(spark, d)).select("date", "ticker", "high", "close", "filled")


@query(f"""WITH {cte("quotes")}, k AS (SELECT date, ticker, low FROM quotes WHERE year(date) <= 1999), n AS (SELECT date, ticker, low + 1 AS low FROM quotes WHERE year(date) >= 1998)
SELECT CAST(date AS VARCHAR) AS date, ticker, round(low, 2) AS low FROM (SELECT * FROM n UNION ALL SELECT * FROM k WHERE year(date) < 1998)""", digits=2)
def keyed_upsert(spark, d):
    known, fresh = halves(spark, d)
    return archive.upsert(archive.conform(known, "quotes"), fresh.withColumn("low", F.col("low") + 1), "quotes", "date").select("date", "ticker", "low")


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close FROM quotes WHERE NOT (year(date) = 1997 AND ticker = 'Brand#1')")
def deleted_keys(spark, d):
    rows = quotes_of(spark, d)
    return archive.delete_keys(rows, rows.filter("year(date) = 1997 and ticker = 'Brand#1'"), ("date", "ticker")).select("date", "ticker", "close")


@query(f"""WITH {cte("reference")}, k AS (SELECT ticker, name, sector, DATE '1995-01-02' AS f, DATE '2000-01-03' AS l FROM reference WHERE ticker NOT IN ('Brand#3', 'Brand#4')),
n AS (SELECT ticker, name, CASE WHEN ticker = 'Brand#5' THEN 'S9' ELSE sector END AS sector FROM reference WHERE ticker <> 'Brand#7')
SELECT coalesce(k.ticker, n.ticker) AS ticker, coalesce(n.name, k.name) AS name, coalesce(n.sector, k.sector) AS sector,
  CAST(CASE WHEN n.ticker IS NOT NULL THEN coalesce(k.f, DATE '2001-11-05') ELSE k.f END AS VARCHAR) AS first_seen, CAST(CASE WHEN n.ticker IS NOT NULL THEN DATE '2001-11-05' ELSE k.l END AS VARCHAR) AS last_seen,
  CASE WHEN k.ticker IS NULL THEN 'entry' WHEN n.ticker IS NULL THEN 'absent' WHEN n.sector <> k.sector THEN 'sector change' END AS change FROM k FULL OUTER JOIN n ON n.ticker = k.ticker""")
def historised_reference(spark, d):
    rows = load(spark, d, "reference")
    known = rows.filter("ticker not in ('Brand#3', 'Brand#4')").withColumns({"first_seen": F.lit("1995-01-02").cast("date"), "last_seen": F.lit("2000-01-03").cast("date")})
    fresh = rows.filter("ticker <> 'Brand#7'").withColumn("sector", F.when(F.col("ticker") == "Brand#5", "S9").otherwise(F.col("sector")))
    return merge.merge_reference(known, fresh, "2001-11-05")


@query(f"WITH {cte('quotes', 'reference')} SELECT r.ticker, r.name, CAST(min(q.date) AS VARCHAR) AS first_seen, CAST(max(q.date) AS VARCHAR) AS last_seen FROM reference r LEFT JOIN quotes q ON q.ticker = r.ticker GROUP BY 1, 2")
def reference_dates(spark, d):
    rows = load(spark, d, "reference").withColumns({"first_seen": F.lit(None).cast("date"), "last_seen": F.lit(None).cast("date")})
    return merge.date_from_quotes(rows, quotes_of(spark, d)).select("ticker", "name", "first_seen", "last_seen")


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, ticker, round(CASE WHEN year(date) >= 1998 AND year(date) > 1999 THEN close + 1 ELSE close END, 6) AS close FROM quotes")
def union_first_source(spark, d):
    known, fresh = halves(spark, d)
    return union_by_priority([known, fresh], ("date", "ticker")).select("date", "ticker", "close")


@query(f"WITH {cte('quotes', 'dividends', 'reference')} SELECT 'dividends' AS name, count(*) AS n FROM dividends UNION ALL SELECT 'quotes', count(*) FROM quotes UNION ALL SELECT 'reference', count(*) FROM reference")
def table_row_counts(spark, d):
    return archive.row_counts({k: load(spark, d, k) for k in ("quotes", "dividends", "reference")})


@query(f"""WITH {DIS}, fr AS (SELECT v.*, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY ex_date, amount) AS rn FROM dividends v),
ot AS (SELECT f.ticker, f.ex_date, f.fiscal_year, CASE WHEN d.published IS NULL THEN f.amount WHEN rn = 1 THEN d.published ELSE 0 END AS amount FROM fr f LEFT JOIN dis d ON d.ticker = f.ticker AND d.fiscal_year = f.fiscal_year)
SELECT (SELECT count(*) FROM (SELECT ticker, ex_date, fiscal_year, amount FROM dividends EXCEPT ALL SELECT ticker, ex_date, fiscal_year, amount FROM ot WHERE amount > 0)) AS only_left,
(SELECT count(*) FROM (SELECT ticker, ex_date, fiscal_year, amount FROM ot WHERE amount > 0 EXCEPT ALL SELECT ticker, ex_date, fiscal_year, amount FROM dividends)) AS only_right, false AS same""")
def source_difference(spark, d):
    own = load(spark, d, "dividends").select("ticker", "ex_date", "fiscal_year", "amount")
    return merge.differ(own, quality.with_other_source(own, load(spark, d, "fundamentals")))


@query(f"""WITH {ANNOUNCED}, k AS (SELECT date, ticker, close FROM an WHERE year(date) <= 1998), r AS (SELECT * FROM an WHERE year(date) >= 1998),
c AS (SELECT *, 100 * (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) AS computed FROM r), b AS (SELECT DISTINCT ticker FROM c WHERE abs(announced - computed) > 0.02)
SELECT (SELECT count(*) FROM r WHERE ticker NOT IN (SELECT ticker FROM b) AND year(date) > 1998) AS added, CAST(0 AS BIGINT) AS filled, (SELECT count(*) FROM b) AS rejected""")
def backfill_summary(spark, d):
    rows = announced_of(spark, d)
    known = rows.filter("year(date) <= 1998").select("date", "ticker", "close")
    return merge.backfill(known, rows.filter("year(date) >= 1998").select("date", "ticker", "close", "announced"))[1]


# -- statistics, sweep, learning --------------------------------------------------------------------------------------------
SAMPLE = f"""{FEATS},
fwd AS (SELECT *, CASE WHEN close > 0 THEN lead(close, 8) OVER (PARTITION BY ticker ORDER BY date) / close - 1 END AS forward FROM feats),
ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM fwd WHERE momentum IS NOT NULL AND trend IS NOT NULL AND volatility IS NOT NULL AND forward IS NOT NULL) WHERE n >= 4),
md AS (SELECT date, median(forward) AS m FROM ok GROUP BY 1),
sample AS (SELECT ok.date, ticker, forward, CAST(forward > m AS DOUBLE) AS label, {rank_sql("momentum", "ok.date")} AS momentum, {rank_sql("trend", "ok.date")} AS trend, {rank_sql("volatility", "ok.date")} AS volatility, coalesce({rank_sql("liquidity", "ok.date")}, 0.5) AS liquidity FROM ok JOIN md ON md.date = ok.date)"""


def sample_of(spark, d):
    return learn.sample(panel_of(spark, d), 8, FEATURES)


@query(f"WITH {SAMPLE} SELECT CAST(date AS VARCHAR) AS date, ticker, round(forward, 6) AS forward, label, round(momentum, 6) AS momentum, round(trend, 6) AS trend, round(volatility, 6) AS volatility, round(liquidity, 6) AS liquidity FROM sample")
def learning_sample(spark, d):
    return sample_of(spark, d)


def mean_sql(group: str, horizon: str, least: int) -> str:
    """Final SELECT of mean coefficients from the CTE ic."""
    by = f"{group}, " if group else ""
    return f"""mc AS (SELECT {by}avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS sessions, CAST(ceil(count(*) / CAST({horizon} AS DOUBLE)) AS BIGINT) AS periods FROM ic WHERE ic IS NOT NULL {"GROUP BY " + group if group else ""}),
me AS (SELECT *, CASE WHEN periods >= {least} AND s > 0 THEN s / sqrt(periods) END AS e FROM mc)
SELECT {by}round(m, 6) AS ic, sessions, periods, round(e, 6) AS error, round(m / e, 5) AS t, coalesce(abs(m / e) > 2, false) AS significant FROM me"""


def shown_mean(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.round("t", 5))


@query(f"WITH {SAMPLE}, cs AS (SELECT *, (0.5 * momentum + 0.3 * trend - 0.2 * volatility) / 1.0 AS composite FROM sample), {spearman_sql('cs', 'composite', 'forward', 'date', 3)}, {mean_sql('', '8', 2)}")
def composite_coefficient(spark, d):
    return shown_mean(learn.composite_coefficient(sample_of(spark, d), RANKS.weights, 8))


@query(f"""WITH {SAMPLE}, lf AS (SELECT date, forward, unnest(['momentum', 'trend', 'volatility', 'liquidity']) AS feature, unnest([momentum, trend, volatility, liquidity]) AS value FROM sample),
{spearman_sql("lf", "value", "forward", "feature, date", 3)}, {mean_sql("feature", "8", 2)}""")
def feature_coefficients(spark, d):
    return shown_mean(learn.feature_coefficients(sample_of(spark, d), 8))


@query(f"""WITH {SAMPLE}, cs AS (SELECT *, (0.5 * momentum + 0.3 * trend - 0.2 * volatility) / 1.0 AS composite FROM sample), {spearman_sql("cs", "composite", "forward", "date", 3)} SELECT CAST(date AS VARCHAR) AS date, members, round(ic, 6) AS ic FROM ic""")
def session_coefficients(spark, d):
    return stats.information_coefficients(learn.composite(sample_of(spark, d), RANKS.weights), "composite", "forward", ["date"], 3)


@query(f"""WITH {SAMPLE}, dn AS (SELECT date, row_number() OVER (ORDER BY date) AS n, ntile(5) OVER (ORDER BY date) AS b FROM (SELECT DISTINCT date FROM sample)), sb AS (SELECT b - 1 AS fold, min(n) AS s FROM dn WHERE b > 1 GROUP BY 1)
SELECT fold, CAST(date AS VARCHAR) AS date, CASE WHEN b = fold + 1 THEN 'test' ELSE 'train' END AS part FROM dn CROSS JOIN sb WHERE b = fold + 1 OR n <= s - 1 - 8""")
def purged_folds(spark, d):
    return learn.folds(sample_of(spark, d), 4, 8)


SWEPT = f"""{PREDICTORS}, {cte("reference")},
lp AS (SELECT date, ticker, h4, h8, unnest([{", ".join(f"'{p}'" for p in PREDICTOR_SQL)}]) AS predictor, unnest([{", ".join(PREDICTOR_SQL)}]) AS value FROM pd),
hp AS (SELECT date, ticker, predictor, value, unnest([4, 8]) AS horizon, unnest([h4, h8]) AS forward FROM lp),
sg AS (SELECT 'market' AS segment, ticker FROM reference UNION ALL SELECT sector, ticker FROM reference WHERE sector IN (SELECT sector FROM reference GROUP BY 1 HAVING count(*) >= 4)),
cl AS (SELECT segment, predictor, CAST(horizon AS BIGINT) AS horizon, date, value, forward FROM hp JOIN sg USING (ticker)), {spearman_sql("cl", "value", "forward", "segment, predictor, horizon, date", 4)}"""


@query(f"WITH {SWEPT}, {mean_sql('segment, predictor, horizon', 'horizon', 3)}")
def predictor_sweep(spark, d):
    return shown_mean(research.sweep_cells(panel_of(spark, d), load(spark, d, "reference"), SWEEP, FEATURES))


@query(f"""WITH {cte("quotes")}, pv AS (SELECT ticker, date, round(1 / (1 + volume_shares), 6) AS p FROM quotes), rk AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pv), bd AS (SELECT max(p) AS b FROM rk WHERE p <= 0.6 * r / m)
SELECT ticker, CAST(date AS VARCHAR) AS date, p, coalesce(p <= (SELECT b FROM bd), false) AS discovered FROM pv""")
def false_discovery_control(spark, d):
    rows = quotes_of(spark, d).select("ticker", "date", F.round(1 / (1 + F.col("volume_shares")), 6).alias("p"))
    return stats.benjamini_hochberg(rows, 0.6)


@query(f"WITH {cte('reference')} SELECT 'market' AS segment, ticker FROM reference UNION ALL SELECT sector, ticker FROM reference WHERE sector IN (SELECT sector FROM reference GROUP BY 1 HAVING count(*) >= 4)")
def market_segments(spark, d):
    return research.segments(load(spark, d, "reference"))


# -- backtest -----------------------------------------------------------------------------------------------------------
def journal_of(spark, d):
    return backtest.journal(quotes_of(spark, d), load(spark, d, "reference"), BACKTEST, FEATURES, RANKS, load(spark, d, "dividends"), load(spark, d, "fundamentals"))


@query(f"WITH {JOURNAL} SELECT step, CAST(date AS VARCHAR) AS date, CAST(entry AS VARCHAR) AS entry, CAST(exit AS VARCHAR) AS exit, round(gain, 6) AS gain, round(dividend, 6) AS dividend, array_to_string(held, ', ') AS held, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(value, 6) AS value, round(reference_value, 6) AS reference_value FROM journal")
def backtest_journal(spark, d):
    return journal_of(spark, d).select("step", "date", "entry", "exit", "gain", "dividend", F.concat_ws(", ", "held").alias("held"), "turnover", "cost", "value", "reference_value")


DRAW = "min(%s / mx - 1) FROM (SELECT %s, max(%s) OVER (ORDER BY step) AS mx FROM journal)"


@query(f"""WITH {JOURNAL}, z AS (SELECT count(*) AS steps, arg_max(value, step) AS v, arg_max(price_value, step) AS p, arg_max(reference_value, step) AS r, avg(turnover) AS mt, sum(cost) AS tc FROM journal), k AS (SELECT count(*) - 26 AS n FROM cal)
SELECT steps, round(v - 1, 6) AS total, round(pow(v, 250.0 / n) - 1, 6) AS yearly, round(p - 1, 6) AS price_total, round(pow(p, 250.0 / n) - 1, 6) AS price_yearly, round(v - p, 6) AS dividend_part, round(r - 1, 6) AS reference_total, round(pow(r, 250.0 / n) - 1, 6) AS reference_yearly,
round((SELECT {DRAW % (("value",) * 3)}), 6) AS max_drawdown, round((SELECT {DRAW % (("reference_value",) * 3)}), 6) AS reference_drawdown, round(mt, 6) AS mean_turnover, round(tc, 6) AS total_cost, round(v - r, 6) AS gap_total, round(pow(v, 250.0 / n) - pow(r, 250.0 / n), 6) AS gap_yearly FROM z, k""")
def backtest_summary(spark, d):
    sessions = panel.calendar(quotes_of(spark, d)).count()
    return backtest.summary(journal_of(spark, d), sessions, FEATURES.needed)


OTHER_JOURNAL = JOURNAL.replace(cte("dividends"), f"""{cte("dividends").replace("dividends AS (", "o_dated AS (", 1)}, {cte("fundamentals").replace("fundamentals AS (", "o_fund AS (", 1)},
o_year AS (SELECT ticker, fiscal_year, sum(amount) AS dated_sum FROM o_dated GROUP BY 1, 2), o_pub AS (SELECT ticker, year(date) AS fiscal_year, sum(value) AS published FROM o_fund WHERE indicator = 'dividend' AND value > 0 GROUP BY 1, 2),
o_dis AS (SELECT y.ticker, y.fiscal_year, published FROM o_year y JOIN o_pub p ON p.ticker = y.ticker AND p.fiscal_year = y.fiscal_year WHERE abs(dated_sum / published - 1) > 0.10),
o_rows AS (SELECT v.*, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY ex_date, amount) AS rn FROM o_dated v),
dividends AS (SELECT * FROM (SELECT r.ticker, r.ex_date, CASE WHEN o.published IS NULL THEN r.amount WHEN rn = 1 THEN o.published ELSE 0 END AS amount, r.fiscal_year FROM o_rows r LEFT JOIN o_dis o ON o.ticker = r.ticker AND o.fiscal_year = r.fiscal_year) WHERE amount > 0)""")


@query(f"SELECT round(min(total), 6) AS low, round(max(total), 6) AS high FROM (SELECT (WITH {JOURNAL} SELECT arg_max(value, step) - 1 FROM journal) AS total UNION ALL SELECT (WITH {OTHER_JOURNAL} SELECT arg_max(value, step) - 1 FROM journal))")
def backtest_source_interval(spark, d):
    return backtest.source_interval(quotes_of(spark, d), load(spark, d, "reference"), load(spark, d, "dividends"), load(spark, d, "fundamentals"), settings=BACKTEST, features=FEATURES, ranks=RANKS)


# -- snapshot -----------------------------------------------------------------------------------------------------------
MOVES = f"""{PANEL}, {cte("reference")},
mv AS (SELECT *, CASE WHEN lag(close) OVER (PARTITION BY ticker ORDER BY date) > 0 THEN close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 END AS change FROM panel),
moves AS (SELECT mv.date, mv.ticker, close, change, volume_shares, volume_value, name, sector FROM mv LEFT JOIN reference USING (ticker) WHERE date = (SELECT max(date) FROM panel) AND close IS NOT NULL)"""


def moves_of(spark, d):
    return snapshot.changes(panel_of(spark, d), load(spark, d, "reference"))


@query(f"WITH {MOVES} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close, round(change, 6) AS change, round(volume_shares, 6) AS volume_shares, round(volume_value, 6) AS volume_value, name, sector FROM moves")
def last_session_changes(spark, d):
    return moves_of(spark, d)


@query(f"WITH {MOVES} SELECT sector, round(median(change), 6) AS median_change, count(*) AS companies, round(avg(CASE WHEN change IS NOT NULL THEN CAST(change > 0 AS DOUBLE) END), 6) AS rising FROM moves GROUP BY 1")
def sector_summary(spark, d):
    return snapshot.by_sector(moves_of(spark, d))


@query(f"WITH {MOVES} SELECT count(*) FILTER (change > 0) AS up, count(*) FILTER (change = 0) AS flat, count(*) FILTER (change < 0) AS down, round(median(change), 6) AS median_change, round(sum(volume_value), 2) AS turnover, arg_max(ticker, volume_value) AS most_traded, round(max(volume_value) / sum(volume_value), 6) AS most_traded_share FROM moves")
def market_breadth(spark, d):
    return snapshot.breadth(moves_of(spark, d)).withColumn("turnover", F.round("turnover", 2))


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, round(sum(volume_value), 2) AS turnover, count(*) AS rows FROM quotes GROUP BY 1 ORDER BY 1 DESC LIMIT 12", digits=2)
def turnover_by_session(spark, d):
    return snapshot.turnover(quotes_of(spark, d))


@query(f"WITH {MOVES}, kn AS (SELECT ticker, change, row_number() OVER (ORDER BY change, ticker) AS a, row_number() OVER (ORDER BY change DESC, ticker) AS b FROM moves WHERE change IS NOT NULL) SELECT ticker, round(change, 6) AS change, 'worst' AS side FROM kn WHERE a <= 10 UNION ALL SELECT ticker, round(change, 6), 'best' FROM kn WHERE b <= 10")
def best_and_worst(spark, d):
    return snapshot.extremes(moves_of(spark, d))


@query(f"WITH {MOVES} SELECT ticker, name, sector, round(change, 6) AS change FROM moves WHERE sector IN ('S1', 'S2') AND (contains(lower(ticker), 'd#1') OR contains(lower(name), 'd#1'))")
def filtered_tickers(spark, d):
    return snapshot.select_tickers(moves_of(spark, d), ["S1", "S2"], "D#1").select("ticker", "name", "sector", "change")


@query(f"WITH {cte('quotes')}, bd AS (SELECT min(date) AS b FROM (SELECT DISTINCT date FROM quotes ORDER BY date DESC LIMIT 30)) SELECT ticker, array_to_string(list(CAST(CAST(round(close, 0) AS BIGINT) AS VARCHAR) ORDER BY date), ',') AS closes FROM quotes WHERE date > (SELECT b FROM bd) GROUP BY 1")
def sparklines(spark, d):
    return snapshot.sparklines(quotes_of(spark, d)).select("ticker", F.concat_ws(",", F.transform("closes", lambda x: F.round(x, 0).cast("long").cast("string"))).alias("closes"))


@query(f"WITH {cte('quotes')}, rb AS (SELECT *, lag(close, 4) OVER w AS a, lag(close, 12) OVER w AS b, lag(close, 52) OVER w AS c, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close, round(close / a - 1, 6) AS back_4, round(close / b - 1, 6) AS back_12, round(close / c - 1, 6) AS back_52 FROM rb WHERE r = 1")
def returns_back(spark, d):
    return snapshot.returns_back(quotes_of(spark, d), (4, 12, 52))


@query(f"""WITH {cte("dividends", "fundamentals")} SELECT ticker, CAST(date AS VARCHAR) AS date, round(max(value) FILTER (indicator = 'dividend'), 6) AS dividend, round(max(value) FILTER (indicator = 'yield'), 6) AS yield FROM (SELECT ticker, date, indicator, max(value) AS value FROM fundamentals GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def fundamentals_sheet(spark, d):
    rows = load(spark, d, "fundamentals").groupBy("ticker", "date", "indicator").agg(F.max("value").alias("value"))
    return snapshot.fundamentals_sheet(rows, ["dividend", "yield"])


@query(f"WITH {cte('dividends', 'fundamentals', 'reference')} SELECT f.ticker, name, round(value, 6) AS yield FROM fundamentals f JOIN reference r ON r.ticker = f.ticker WHERE indicator = 'yield' AND date = (SELECT max(date) FROM fundamentals WHERE indicator = 'yield')")
def latest_yields(spark, d):
    return snapshot.latest_yields(load(spark, d, "fundamentals"), load(spark, d, "reference"))


@query(f"WITH {cte('quotes', 'reference')} SELECT count(DISTINCT date) AS sessions, count(DISTINCT ticker) AS tickers, (SELECT count(*) FROM reference) AS companies, (SELECT count(DISTINCT sector) FROM reference) AS sectors FROM quotes")
def table_sizes(spark, d):
    return snapshot.table_sizes(quotes_of(spark, d), load(spark, d, "reference"))
