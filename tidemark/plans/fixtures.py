"""Market tables derived from the given star schema: the same SQL text runs in both engines.

A session is a week, a ticker a brand. Prices are rounded to six decimals, so both engines go on from equal
numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.settings import BacktestSettings, ExternalSettings, FeatureSettings, LearningSettings, RankingSettings, SweepSettings

FEATURES = FeatureSettings(momentum=26, skip=2, volatility=12, liquidity=12, short_mean=4, long_mean=12, sessions_a_year=52)
RANKS = RankingSettings(least_liquidity=1000.0, least_sector=5)
BACKTEST = BacktestSettings(positions=5, step=8, delay=1)
LEARNING = LearningSettings(horizon=8, folds=4, least_rows=400)
EXTERNAL = ExternalSettings(window=12, lag=8)
SWEEP = SweepSettings(horizons=(4, 8), least_members=4)

SQL = {
    "quotes": """
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS ticker,
       round(min(l_extendedprice), 6) AS low, round(max(l_extendedprice), 6) AS high, round(avg(l_extendedprice), 6) AS close,
       round(sum(l_quantity), 6) AS volume_shares, round(sum(l_extendedprice), 6) AS volume_value
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    "reference": """
SELECT DISTINCT p_brand AS ticker, concat('Company ', p_brand) AS name,
       concat('S', CAST(CAST(substr(p_brand, 7) AS INT) % 4 AS VARCHAR(2))) AS sector FROM {part}""",
    "dividends": """
SELECT ticker, ex_date, amount, fiscal_year FROM (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS ex_date, round(l_extendedprice * 0.2, 6) AS amount, year(l_shipdate) - 1 AS fiscal_year,
         row_number() OVER (PARTITION BY p_brand, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE month(l_shipdate) BETWEEN 5 AND 8) t WHERE rn = 1""",
    "external": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS series, round(sum(o_totalprice), 2) AS value
FROM {orders} GROUP BY 1, 2""",
}
SQL["fundamentals"] = f"""
SELECT ticker, make_date(CAST(fiscal_year AS INT), 12, 31) AS date, 'dividend' AS indicator, CASE WHEN fiscal_year % 3 = 0 THEN amount * 2 ELSE amount END AS value FROM ({SQL["dividends"]}) d1
UNION ALL
SELECT ticker, make_date(CAST(fiscal_year AS INT), 12, 31) AS date, 'yield' AS indicator, CAST(2 + fiscal_year % 5 AS DOUBLE) AS value FROM ({SQL["dividends"]}) d2 WHERE fiscal_year % 2 = 0
UNION ALL
SELECT ticker, make_date(CAST(fiscal_year + 1 AS INT), 12, 31) AS date, 'yield' AS indicator, CAST(1.5 AS DOUBLE) AS value FROM ({SQL["dividends"]}) d3 WHERE fiscal_year >= 2000"""
SOURCES = ("lineitem", "part", "orders", "supplier", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if "{" + t + "}" in text})


def cte(*names: str) -> str:
    """``WITH`` items for DuckDB, on the registered views."""
    return ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in SOURCES})})" for n in names)
