"""Pieces that the corpus operators share: reading, cutting lineage, text splitting and hashing.

Everything here works on Arrow batches inside Spark tasks or declares DataFrame plans; nothing
gathers rows on the driver except :func:`sum_vectors`, which brings back one vector of fixed length.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 2 << 20

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes of the rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased UTF-8.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240607)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Rows of one Arrow batch: texts are long, and a worker holds a batch in several forms at once.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the batches that Python workers receive small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


_POWERS = np.ones(1, dtype=np.uint64)


def utf8_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges [a, b) whose texts together stay within ``limit`` bytes where that is possible."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of several texts at once: where they start and end, their row and a 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = SPACE_WORD):
        offsets = offsets - offsets[0]
        data = LOWER[data]
        inside = word_byte[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.start, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.of_row = np.searchsorted(self.row, np.arange(len(offsets)))
        lengths = self.end - self.start
        if len(lengths):
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            spelled = _BYTE_CODE[data[inside]]
            spelled *= _powers(int(lengths.max()))[place]
            self.hash = mix64(np.add.reduceat(spelled, ends - lengths) + lengths.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``size`` words that lies in one row."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, chain(self.hash, at, size)


def chain(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive hashes from each position in ``at``; order and size matter."""
    out = np.full(len(at), size, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + j]
    return mix64(out)


def sum_chunks(df: DataFrame, dtype=np.float64, fan_in: int = 32) -> DataFrame:
    """Sum the vectors (bytes of ``dtype`` in the column ``vector``) of each ``chunk``, level by level."""

    def add(_, vectors: list[bytes]) -> bytes:
        total = np.frombuffer(vectors[0], dtype).copy()
        for v in vectors[1:]:
            total += np.frombuffer(v, dtype)
        return total.tobytes()

    level = materialise(df.select(F.spark_partition_id().cast("long").alias("part"), F.col("chunk").cast("long").alias("chunk"), "vector"), "vectors")
    parts = level.agg(F.max("part")).first()[0]
    return merge_chunks(level, add, (parts or 0) + 1, fan_in)


def merge_chunks(df: DataFrame, merge, parts: int, fan_in: int = 32) -> DataFrame:
    """One (chunk, vector) for each ``chunk`` of (part, chunk, vector): ``merge(chunk, vectors)``, at most ``fan_in`` at a time.

    ``parts`` is one more than the largest part. Vectors come in the order of their parts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, pdf = int(pdf["chunk"].iloc[0]), pdf.sort_values("part")  # in one order, however rows arrive
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // fan_in], "chunk": [chunk], "vector": [merge(chunk, pdf["vector"].tolist())]})

    while parts > 1:
        df = materialise(df.groupBy("chunk", F.floor(F.col("part") / fan_in)).applyInPandas(run, "part long, chunk long, vector binary"), "vectors")
        parts = -(-parts // fan_in)
    return df.select("chunk", "vector")


def sum_vectors(df: DataFrame) -> np.ndarray | None:
    """Sum of float64 vectors of one length in the column ``vector``; None where there are no rows."""
    rows = sum_chunks(df.select(F.lit(0).alias("chunk"), "vector")).collect()  # one row, or several of part 0
    return np.sum([np.frombuffer(r.vector, np.float64) for r in rows], axis=0) if rows else None
