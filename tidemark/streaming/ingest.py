"""Quotes that arrive as files: every micro-batch is a commit that merges its rows by key into the months they touch.

The table is a versioned one (see :mod:`tidemark.sources.versions`): a reader keeps the version it read, a batch that
dies before its commit leaves no trace in it, and one that runs again after its commit is passed over, as each
manifest holds the number of the last batch merged. Old versions are dropped as the stream goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import schema
from tidemark.sources import versions


def quote_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Landed Parquet files of quotes as a stream under the declared schema, with ``_landed``: the file's time and name."""
    rows = spark.readStream.schema(schema("quotes")).parquet(folder)
    return rows.select("*", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path")).alias("_landed"))


def merged_quotes(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The merged table as of a version, by default the last."""
    return versions.read(spark, root, "quotes", version)


def merge_batches(stream: DataFrame, root: str, checkpoint: str, keep: int = 20, least_age: float = 7 * 86400.0):
    """Starts a query that upserts every batch; of several rows of a key the one that landed last counts.

    Rows that lack a required column are rejected. ``root`` and ``checkpoint`` belong together: batch numbers come from the
    latter. Every ``keep`` batches the versions before the last ``keep`` are dropped, with data folders ``least_age`` seconds old.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = versions.manifest(spark, root)
        if base["batch"] is not None and base["batch"] >= number:
            return
        versions.upsert(root, "quotes", batch.filter("date is not null"), "_landed", f"batch {number}", number, base)
        if number % keep == keep - 1:
            versions.expire(spark, root, keep, least_age)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_turnover(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Traded value by week and ticker with a watermark for late rows."""
    timed = stream.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "7 days").alias("week"), "ticker").agg(F.sum("volume_value").alias("turnover"), F.count("*").alias("rows"))
