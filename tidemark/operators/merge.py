"""Merging tables without losing known values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_fields(known: DataFrame, new: DataFrame, key: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Known value per column where there is one, else the new one; ``filled`` counts known rows' filled cells."""
    values = [c for c in known.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"_{c}") for c in values if c in new.columns], F.lit(1).alias("_new"))
    both = known.withColumn("_old", F.lit(1)).join(fresh, list(key), "full_outer")
    got = {c: F.col(f"_{c}") if c in new.columns else F.lit(None) for c in values}
    filled = sum((F.when(F.col("_old").isNotNull() & F.col(c).isNull() & got[c].isNotNull(), 1).otherwise(0) for c in values), F.lit(0))
    return both.select(*key, *[F.coalesce(F.col(c), got[c]).alias(c) for c in values], filled.alias("filled"))


def merge_reference(known: DataFrame, new: DataFrame, session: str) -> DataFrame:
    """The historised company list after a session's list; rows are never deleted.

    ``change`` names what happened: entry, sector change, absent, or null.
    """
    today = F.lit(session).cast("date")
    fresh = new.groupBy("ticker").agg(F.max("name").alias("_name"), F.max("sector").alias("_sector")).withColumn("_new", F.lit(1))
    both = known.withColumn("_old", F.lit(1)).join(fresh, "ticker", "full_outer")
    seen, old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    change = F.when(~old, "entry").when(~seen, "absent").when(F.col("_sector") != F.col("sector"), "sector change")
    return both.select(
        "ticker", F.coalesce("_name", "name").alias("name"), F.coalesce("_sector", "sector").alias("sector"),
        F.when(seen, F.coalesce("first_seen", today)).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(seen, today).otherwise(F.col("last_seen")).alias("last_seen"), change.alias("change"),
    )


def date_from_quotes(reference: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fills missing first and last seen dates from the quotes."""
    seen = quotes.groupBy("ticker").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    out = reference.join(seen, "ticker", "left")
    return out.withColumns({"first_seen": F.coalesce("first_seen", "_first"), "last_seen": F.coalesce("last_seen", "_last")}).drop("_first", "_last")


def remove_rows(df: DataFrame, suspects: DataFrame, key: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    return df.join(suspects.select(*key).distinct(), list(key), "left_anti")


def differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether the tables differ as bags of rows, and how many rows each has alone."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def backfill(known: DataFrame, rescued: DataFrame, tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Merges a rescued history field by field, leaving out tickers whose announced changes disagree with closes.

    ``rescued`` has the column ``announced`` (percent). Returns the merged quotes and a one-row summary.
    """
    from tidemark.operators.quality import incoherent_changes

    bad = incoherent_changes(rescued, tolerance).select("ticker").distinct()
    good = rescued.join(bad, "ticker", "left_anti")
    merged = merge_fields(known, good.select([c for c in known.columns if c in good.columns]))
    added = good.select("date", "ticker").join(known.select("date", "ticker"), ["date", "ticker"], "left_anti").agg(F.count("*").alias("added"))
    summary = added.crossJoin(merged.agg(F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"))).crossJoin(bad.agg(F.count("*").alias("rejected")))
    return merged.drop("filled"), summary
