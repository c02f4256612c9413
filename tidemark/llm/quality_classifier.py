"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

Each text becomes a vector of document statistics; random Fourier features of the standardised
vector approximate a Gaussian kernel. Every partition sums its share of the normal equations, the
sums are added up level by level, and one solve gives the ridge weights. A fold of the training rows
that took no part in the fit calibrates the raw values: they are counted in fixed bins, and pool-
adjacent-violators over the bins gives a monotone map to probabilities.

Fitting uses all labelled rows outside the held-out fold. Cases: null and empty texts have zero
statistics and a score like any other; labels that are null or whose document is absent are left out;
several labels of one document are several examples; without labels of both classes every score is
their share (0.5 without any); repeated rows each get their row; no rows give an empty result;
other columns are ignored, labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, id_crc, materialise, steps, sum_vectors, utf8_parts

STATISTICS = (
    "log_words", "word_bytes", "word_bytes_spread", "distinct_words", "top_word", "symbols", "capitals", "exclamations",
    "bars", "digits", "stops", "lines", "repeated_lines", "repeated_windows", "short_words", "lone_symbols", "other_bytes",
)

_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
_CLASSES = [np.isin(np.arange(256), list(c)) for c in (b"#*$%&|<>", range(0x41, 0x5B), b"!", b"|", range(0x30, 0x3A), b".,;:?", b"\n")]
_OTHER = np.arange(256) >= 0x80
_LETTER = np.isin(np.arange(256) | 0x20, list(range(0x61, 0x7B))) | _OTHER
#: Bytes of text that one step of the statistics handles: it holds some fifty times as much.
_STEP = 256 << 10


def _repeats(hashes: np.ndarray) -> tuple[int, int, int]:
    """Distinct values, the largest count, and how many values occur more than once (with copies)."""
    if not len(hashes):
        return 0, 0, 0
    counts = np.unique(hashes, return_counts=True)[1]
    return len(counts), int(counts.max()), int(counts[counts > 1].sum())


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for a, b in steps(offsets, _STEP):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, lines = Words(part, off), Words(part, off, _LINE)
        counts = lambda flags, at=off: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        size, n = np.maximum(np.diff(off), 1), np.maximum(np.diff(words.of_row), 1)
        lengths = (words.end - words.start).astype(float)
        first = lambda x, at=words.of_row: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
        mean = first(lengths) / n
        out[a:b, 0] = np.log1p(np.diff(words.of_row))
        out[a:b, 1] = mean
        out[a:b, 2] = np.sqrt(np.maximum(first(lengths**2) / n - mean**2, 0))
        classes = [counts(c[part]) / size for c in _CLASSES]
        out[a:b, 5:11] = np.sqrt(np.array(classes[:6]).T)
        out[a:b, 11] = np.log1p(classes[6] * size)
        out[a:b, 14] = first(lengths <= 3) / n
        letters = np.concatenate([[0], np.cumsum(_LETTER[part])])
        out[a:b, 15] = first(letters[words.end] == letters[words.start]) / n
        out[a:b, 16] = counts(_OTHER[part]) / size
        at, windows = words.windows(3)
        of_row = np.searchsorted(words.row[at], np.arange(b - a + 1)) if len(at) else np.zeros(b - a + 1, int)
        for i in range(b - a):
            own = words.hash[words.of_row[i] : words.of_row[i + 1]]
            distinct, top, _ = _repeats(own)
            out[a + i, 3], out[a + i, 4] = distinct / max(len(own), 1), top / max(len(own), 1)
            own = lines.hash[lines.of_row[i] : lines.of_row[i + 1]]
            out[a + i, 12] = _repeats(own)[2] / max(len(own), 1)
            own = windows[of_row[i] : of_row[i + 1]]
            out[a + i, 13] = _repeats(own)[2] / max(len(own), 1)
    return out


def _lists(texts):
    """An Arrow column of one array of STATISTICS for each text."""
    import pyarrow as pa

    flat = statistics(*utf8_parts(texts))
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) with one array of STATISTICS for each row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(batch.column(1))], ["doc_id", "stats"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def beside_statistics(docs: DataFrame, column: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and, as ``column``, one array of STATISTICS for each row."""
    at, names = docs.columns.index(text_col), [*docs.columns, column]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(batch.column(at))], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))


@dataclass
class Features:
    """Standardisation and random Fourier features; the frequencies follow from the seed."""

    mean: np.ndarray
    spread: np.ndarray
    count: int
    width: float
    seed: int

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(self.seed)
        w = draw.normal(0, 1 / self.width, (len(self.mean), self.count))
        phase = draw.uniform(0, 2 * np.pi, self.count)
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / self.count) * np.cos(x @ w + phase), np.ones((len(x), 1))])


@dataclass
class QualityModel:
    features: Features | None
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None or not len(stats):
            return np.full(len(stats), self.values[0])
        return np.clip(np.interp(self.features(stats) @ self.weights, self.knots, self.values), 0, 1)

    def of_stats(self, column: str = "stats") -> Column:
        model = self

        @F.pandas_udf("double")
        def run(stats: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.stack(stats.to_numpy()))) if len(stats) else pd.Series([], dtype=float)

        return run(column)


def isotonic(values: np.ndarray, ones: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing shares, in the order of ``values``."""
    blocks: list[list[float]] = []
    for i in range(len(values)):
        blocks.append([ones[i], totals[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), o / t) for o, t, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, count: int = 256, width: float = 5.0, ridge: float = 1e-4, seed: int = 11, label_col: str = "quality") -> QualityModel:
    """Fits on the labelled rows of ``stats`` outside the held-out fold (crc32 of the id mod 5 = 0).

    Rows with remainder 1 calibrate, the others fit. ``ridge`` is the penalty for each row.
    """
    marked = labels.select("doc_id", F.col(label_col).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    fold = F.pmod(id_crc(), F.lit(5))
    train = materialise(stats.join(marked, "doc_id").select("stats", "y", fold.alias("fold")).filter("fold != 0"), "training")
    n, positive = train.agg(F.count("*"), F.sum("y")).first()
    if not n or positive in (0, n):
        share = positive / n if n else 0.5
        return QualityModel(None, np.zeros(0), np.zeros(1), np.array([share]))
    d = len(STATISTICS)
    moments = train.select(*[f for j in range(d) for f in (F.avg(F.col("stats")[j]), F.stddev_pop(F.col("stats")[j]))]).first()
    features = Features(np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-3), count, width, seed)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                z, y = features(np.stack(frame["stats"].to_numpy())), frame["y"].to_numpy()
                own = np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"vector": [total.tobytes()]})

    # a training set of a single fold fits and calibrates on the same rows
    fits = train.filter("fold != 1")
    total = sum_vectors(fits.mapInPandas(partial, "vector binary"))
    if total is None:
        fits, total = train, sum_vectors(train.mapInPandas(partial, "vector binary"))
    k = count + 1
    gram, right, rows = total[: k * k].reshape(k, k), total[k * k : -1], total[-1]
    weights = np.linalg.solve(gram + ridge * rows * np.eye(k), right)

    raw = QualityModel(features, weights, np.linspace(-1, 2, 3001), np.linspace(-1, 2, 3001))

    @F.pandas_udf("double")
    def value(s: pd.Series) -> pd.Series:
        return pd.Series(features(np.stack(s.to_numpy())) @ weights) if len(s) else pd.Series([], dtype=float)

    held = train.filter("fold = 1")
    if held.isEmpty():
        held = train
    bins = held.select(F.round(F.least(F.greatest(value("stats"), F.lit(-1.0)), F.lit(2.0)), 3).alias("v"), "y").groupBy("v").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("v").toPandas()
    fitted = isotonic(bins["v"].to_numpy(), bins["ones"].to_numpy(float), bins["n"].to_numpy(float))
    return QualityModel(raw.features, weights, bins["v"].to_numpy(), fitted)


def quality_scores(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    stats = materialise(with_statistics(docs), "statistics")
    model = fit(stats, labels, **settings)
    scored = stats.select("doc_id", (F.pmod(id_crc(), F.lit(5)) == 0).alias("held_out"), model.of_stats().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
