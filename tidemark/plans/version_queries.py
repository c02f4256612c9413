"""Queries over versioned tables: what readers see after upserts, deletes, removed suspects, appends, compaction and a stream; features kept beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import features, panel, quality
from tidemark.operators.settle import shared_folder
from tidemark.plans.fixtures import FEATURES, cte
from tidemark.plans.queries import FEATS, GHOSTS, panel_of, query, quotes_of
from tidemark.sources import archive, refresh, versions
from tidemark.streaming import ingest

#: Closes in whole numbers, as the archive rounds prices to two decimals.
STEPS = f"""{cte("quotes")}, first AS (SELECT date, ticker, floor(close) AS close FROM quotes WHERE year(date) <= 1999),
second AS (SELECT date, ticker, floor(close) + CASE WHEN year(date) >= 1998 THEN 1 ELSE 0 END AS close FROM quotes),
third AS (SELECT * FROM second WHERE NOT (year(date) = 1997 AND ticker = 'Brand#1')), {GHOSTS.removeprefix(cte("quotes") + ", ").replace("FROM quotes WINDOW", "FROM third WINDOW")},
fourth AS (SELECT date, ticker, close FROM third t WHERE NOT EXISTS (SELECT 1 FROM ghosts g WHERE g.date = t.date AND g.ticker = t.ticker))"""


def new_root(spark) -> str:
    return f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"


def written(spark, d) -> str:
    """The root of a table with four versions: first rows, corrections, deleted keys, suspects removed."""
    root, rows = new_root(spark), quotes_of(spark, d).select("date", "ticker", F.floor("close").cast("double").alias("close"))
    versions.upsert(root, "quotes", rows.filter(F.year("date") <= 1999), "date", "first")
    versions.upsert(root, "quotes", rows.filter(F.year("date") >= 1998).withColumn("close", F.col("close") + 1), "date", "corrections")
    versions.delete(root, "quotes", rows.filter("year(date) = 1997 and ticker = 'Brand#1'"), "deleted")
    versions.delete(root, "quotes", quality.ghost_rows(versions.read(spark, root, "quotes")), "suspects")
    return root


@query(f"WITH {STEPS} SELECT CAST(date AS VARCHAR) AS date, ticker, close FROM fourth")
def versioned_quotes(spark, d):
    return versions.read(spark, written(spark, d), "quotes").select("date", "ticker", "close")


@query(f"WITH {STEPS} SELECT CAST(date AS VARCHAR) AS date, ticker, close FROM second")
def quotes_as_of_version(spark, d):
    """An older version stays readable after later ones, and after all but the last three were dropped."""
    root = written(spark, d)
    versions.expire(spark, root, keep=3, least_age=0.0)
    return versions.read(spark, root, "quotes", 2).select("date", "ticker", "close")


@query(f"""WITH {STEPS}, n AS (SELECT 1 AS version, 'first' AS note, * FROM first UNION ALL SELECT 2, 'corrections', * FROM second UNION ALL SELECT 3, 'deleted', * FROM third UNION ALL SELECT 4, 'suspects', * FROM fourth)
SELECT CAST(version AS BIGINT) AS version, note, count(DISTINCT strftime(date, '%Y-%m')) AS parts, count(DISTINCT strftime(date, '%Y-%m')) AS folders, count(*) AS rows FROM n GROUP BY 1, 2""")
def version_history(spark, d):
    """Each part lies in one folder after upserts and deletes, however many there were."""
    return versions.history(spark, written(spark, d))


LOG_SQL = f"WITH {cte('quotes')} SELECT ticker AS source, year(date) AS year, count(*) AS rows FROM quotes GROUP BY 1, 2"


@query(f"SELECT source, rows, 'year ' || year AS message, CAST(1 AS BIGINT) AS folders FROM ({LOG_SQL}) l")
def compacted_log(spark, d):
    """A log that grew by one append a year, read after its small files were merged."""
    root, rows = new_root(spark), quotes_of(spark, d)
    for year in range(1995, 2002):  # the runs of the log
        versions.upsert(root, "ingest_log", archive.log_by_source(rows.filter(F.year("date") == year), "ticker", "2024-01-02 18:00:00", f"year {year}"), note=f"run {year}")
    versions.compact(spark, root, "ingest_log")
    folders = len(versions.manifest(spark, root)["parts"])
    return versions.read(spark, root, "ingest_log").select("source", "rows", "message").withColumn("folders", F.lit(folders).cast("long"))


@query(f"WITH {STEPS} SELECT CAST(date AS VARCHAR) AS date, ticker, close, strftime(date, '%Y-%m') AS month FROM second")
def streamed_quotes(spark, d):
    """Quotes that land as files in two runs, the second with corrections, merged batch by batch."""
    root, rows = new_root(spark), archive.conform(quotes_of(spark, d).select("date", "ticker", F.floor("close").cast("double").alias("close")), "quotes")
    for part in (rows.filter(F.year("date") <= 1999), rows.filter(F.year("date") >= 1998).withColumn("close", F.col("close") + 1)):
        part.write.mode("append").parquet(f"{root}/landed")
        ingest.merge_batches(ingest.quote_stream(spark, f"{root}/landed"), f"{root}/table", f"{root}/state").awaitTermination()
    return ingest.merged_quotes(spark, f"{root}/table").select("date", "ticker", "close", F.date_format("date", "yyyy-MM").alias("month"))

REVISED = FEATS.replace(
    cte("quotes"),
    cte("quotes").replace("quotes AS", "raw AS", 1)
    + """,
quotes AS (SELECT date, ticker, low, high, floor(close) + CASE WHEN strftime(date, '%Y-%m') = '1998-03' THEN 5 ELSE 0 END AS close, volume_shares, round(volume_value, 2) AS volume_value FROM raw WHERE NOT (strftime(date, '%Y-%m') = '2000-01' AND ticker < 'Brand#2'))""",
    1,
)


def refreshed(spark, d) -> tuple[str, set[str], set[str]]:
    """The root of features that were brought up to date after a corrected month and deleted keys; months written and read by the last refresh."""
    quotes, kept = new_root(spark), new_root(spark)
    rows = quotes_of(spark, d).withColumn("close", F.floor("close").cast("double"))
    versions.upsert(quotes, "quotes", rows, "date")
    refresh.refresh(spark, quotes, kept, FEATURES)
    month = F.date_format("date", "yyyy-MM")
    versions.upsert(quotes, "quotes", rows.filter(month == "1998-03").withColumn("close", F.col("close") + 5), "date")
    versions.delete(quotes, "quotes", rows.filter((month == "2000-01") & (F.col("ticker") < "Brand#2")))
    return kept, *refresh.refresh(spark, quotes, kept, FEATURES)


@query(f"WITH {REVISED} SELECT CAST(date AS VARCHAR) AS date, ticker, close, round(momentum, 6) AS momentum, round(trend, 6) AS trend, round(volatility, 6) AS volatility, round(liquidity, 6) AS liquidity FROM feats WHERE close IS NOT NULL")
def refreshed_features(spark, d):
    """Kept features after two commits to their quotes equal features computed anew."""
    return versions.read(spark, refreshed(spark, d)[0], "features")


@query(f"WITH {FEATS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(momentum, 6) AS momentum, round(trend, 6) AS trend, round(volatility, 6) AS volatility, round(liquidity, 6) AS liquidity FROM feats")
def rolling_features_in_blocks(spark, d):
    """The rolling features by blocks of 60 sessions with their look-back, equal to those over whole histories."""
    rows = panel_of(spark, d)
    return features.blocked_features(rows, panel.session_numbers(rows), FEATURES, 60).select("date", "ticker", "momentum", "trend", "volatility", "liquidity")
