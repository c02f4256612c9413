"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows are numbered 0..N-1 in the order of their id. A keyed Feistel network over a grid of about
sqrt(N) x sqrt(N) cells permutes the numbers; a number that lands outside 0..N-1 walks on along its
cycle until it is inside again. The permuted number gives shard and slot directly, so a reader can
compute where any row lies, and no row moves with its text.

Cases: no rows give an empty result; null text has size 16 and crc32 0; null ids come first; rows
that agree in id, size and crc are numbered one after another; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64


def feistel(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1, fixed by ``n``, ``seed`` and ``rounds``."""
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if n < 2:
        return x.astype(np.int64)
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    walking = np.arange(len(x))
    while len(walking):
        left, right = np.divmod(x[walking], np.uint64(b))
        for r, key in enumerate(keys):
            if r % 2:
                right = (right + mix64(left ^ key)) % np.uint64(b)
            else:
                left = (left + mix64(right ^ key)) % np.uint64(a)
        y = left * np.uint64(b) + right
        x[walking] = y
        walking = walking[y >= np.uint64(n)]
    return x.astype(np.int64)


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Adds ``row_number`` 0..N-1 in the given order, without a global window, and returns N.

    One range shuffle sorts the rows; only the count of each partition is summed up. Rows equal in all of
    ``order`` are dealt out by the place they were read from, so that no run of them fills one task.
    """
    placed = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    sorted_rows = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    tagged = materialise(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = sorted(tagged.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, starts = 0, {}
    for p, c in counts:
        starts[p], before = before, before + c
    spark = df.sparkSession
    offsets = spark.createDataFrame(sorted(starts.items()), "_part long, _start long")
    out = tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at"), before


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of ``shards`` shards by the law ``rows``: counts differ by one at most.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves rows when
    a shard is added).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(base, "doc_id", "size", "text_crc32")

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, seed, rounds))

    at = numbered.withColumn("_to", permuted("row_number"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_to") % shards).cast("int").alias("shard"),
        F.floor(F.col("_to") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
