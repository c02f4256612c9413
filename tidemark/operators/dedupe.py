"""One row for each key, chosen by an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: tuple[str, ...], order: str | None = None, keep: str = "last") -> DataFrame:
    """Keeps the last (or first) row of each key by ``order``; without an order, any one row."""
    if order is None:
        return df.dropDuplicates(list(key))
    by = F.desc_nulls_last(order) if keep == "last" else F.asc_nulls_last(order)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(by))).filter("_rank = 1").drop("_rank")


def union_by_priority(sources: list[DataFrame], key: tuple[str, ...], keep: str = "first") -> DataFrame:
    """Union of sources in order; of equal keys the first (or last) source's row stays."""
    out = None
    for i, df in enumerate(sources):
        one = df.withColumn("_source", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return one_per_key(out, key, "_source", keep).drop("_source")
