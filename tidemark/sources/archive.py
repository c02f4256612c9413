"""The declared tables: read, conform, upsert by key, delete, export, log. Written versions are in :mod:`tidemark.sources.versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import no_nan
from tidemark.schemas import KEYS, REQUIRED, ROUNDED, SCHEMAS, schema


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def read_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A CSV archive under its declared schema; an absent one is empty."""
    kind = schema(table)
    try:
        return spark.read.schema(kind).option("header", True).csv(path)
    except Exception as error:  # only a missing path counts as empty
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty(spark, table)


def read(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(schema(table)).parquet(path)


def read_text_csv(spark: SparkSession, path: str, required: tuple[str, ...], numeric: tuple[str, ...] = ()) -> DataFrame:
    """An external CSV as text; columns must be there, numeric ones are cast where they can be."""
    out = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in out.columns})


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order: absent ones null, others ignored, NaN null, prices rounded half even."""
    kind = schema(table)
    if not set(kind.names) & set(df.columns):
        raise ValueError(f"no column of {table} in the input")
    columns = []
    for f in kind:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.dataType.typeName() == "double":
            c = no_nan(c)
            c = F.bround(c, 2) if f.name in ROUNDED.get(table, ()) else c
        columns.append(c.alias(f.name))
    return df.select(*columns)


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others."""
    good = F.lit(True)
    for c in REQUIRED[table]:
        good = good & F.col(c).isNotNull()
    return df.filter(good), df.filter(~good)


def last_of_key(df: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, table: str, order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last by the column ``order`` counts.

    The log has no key: it is appended to. Nothing is written, so this is also the overlay of a live session.
    """
    key = KEYS[table]
    if not key:
        return old.unionByName(conform(new, table))
    if order is None:
        raise ValueError("name the column whose largest value wins within a key")
    rows = last_of_key(new.withColumn("_seq", F.col(order)), key, "_seq")
    fresh, _ = split_valid(conform(rows, table), table)
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)


def delete_keys(df: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.join(keys.select(*key).distinct(), list(key), "left_anti")


def import_csv(old: DataFrame, table: str, path: str) -> DataFrame:
    """The table after a CSV archive was merged into it by key; a key is in an archive once."""
    return upsert(old, read_csv(old.sparkSession, table, path), table, KEYS[table][0] if KEYS[table] else None)


def export_rows(df: DataFrame, path: str, *order: str) -> int:
    """Any result as CSV with a header, sorted where ``order`` is given; returns the number of rows written."""
    seen = Observation()
    rows = df.orderBy(*order) if order else df  # counted behind the sort, which reads its input twice
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["rows"]


def export_csv(df: DataFrame, table: str, path: str) -> int:
    """A declared table sorted by its key; returns the number of rows written."""
    return export_rows(conform(df, table), path, *KEYS.get(table, ()))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each of the declared tables given."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def log_rows(df: DataFrame, source: str, at, message) -> DataFrame:
    """One log row about ``df``; the message is cut at 500 characters."""
    one = df.agg(F.count("*").alias("rows"))
    return one.select(F.lit(at).cast("timestamp").alias("at"), F.lit(source).alias("source"), "rows", F.substring(F.lit(message), 1, 500).alias("message"))


def log_by_source(df: DataFrame, source: str, at, message: str) -> DataFrame:
    """One log row for each value of the column ``source``, from one aggregation; messages are cut at 500 characters."""
    counted = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    return counted.select(F.lit(at).cast("timestamp").alias("at"), "source", "rows", F.substring(F.lit(message), 1, 500).alias("message"))


DECLARED = tuple(SCHEMAS)
