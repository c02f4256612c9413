"""Periodic runs of words: an online sparse dynamic program over diagonals.

Words ``lag`` apart that are equal lie on the diagonal of that lag. A run of smallest period q and at least
max(12, 2q) words needs q or more matches in a row on the diagonal q, and six at least, so a text is
read once by its six-word grams: the earlier occurrences of the gram at each word carry on the diagonals of
their lags or open new ones, and a diagonal that finds no match at the word ends there. It is emitted at
once if its stretch is long enough; of the diagonals that end together over one stretch the smallest lag is the
period, the others are its multiples.

Where grams recur so often that the diagonals to carry on exceed ``DENSE`` a word (one word a thousand
times), each diagonal is looked up at every ``lag``-th word only, as a run covers one of those, and its
match is measured by codes of 1, 2, 4, ... words: n log n words of work and memory, the same runs.

Cases: a null text has no words and no runs; a text of any length is read whole; texts without two equal
grams are passed by at once, by hash; repeated rows each get a row; no rows give no rows; other columns
are ignored. Words are compared as they stand (case counts). Codes of words are exact, not hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, id_crc, mix64, steps, utf8_parts

#: Least words of a run, and words of a gram: every match that a run needs is as long as a gram.
LEAST, GRAM = 12, 6
#: Diagonals carried on, a word, beyond which each is looked up at every ``lag``-th word.
DENSE = 24
#: Pairs of words that one vectorised look-up handles.
STEP_PAIRS = 1 << 19

Run = tuple[int, int, int]


def diagonals(grams: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """At each word where diagonals end: (lag, first, last) of their matches, as places of grams."""
    seen: dict[int, list[int]] = {}
    active: dict[int, int] = {}
    for i, gram in enumerate(grams):
        earlier = seen.setdefault(gram, [])
        going = {i - j: active.pop(i - j, i) for j in earlier} if earlier else {}
        if active:
            yield [(lag, first, i - 1) for lag, first in active.items()]
        active = going
        earlier.append(i)
    if active:
        yield [(lag, first, len(grams) - 1) for lag, first in active.items()]


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of pairs: equal exactly where both parts are."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _sparse(grams: np.ndarray, least: int) -> Iterator[Run]:
    for ended in diagonals(grams.tolist()):
        stretches: dict[tuple[int, int], int] = {}
        for lag, first, last in ended:
            length = last + GRAM - first + lag
            if length >= least and length >= 2 * lag:
                stretches[first - lag, length] = min(lag, stretches.get((first - lag, length), lag))
        for (start, length), lag in stretches.items():
            yield start, length, lag


def _anchored(ids: np.ndarray, least: int) -> Iterator[Run]:
    n, levels = len(ids), [ids]
    while 2 << (len(levels) - 1) <= n:
        half = 1 << (len(levels) - 1)
        levels.append(_codes(levels[-1][:-half], levels[-1][half:]))

    def equal(low: np.ndarray, high: np.ndarray, back: bool) -> np.ndarray:
        """Words equal from ``low`` and ``high`` on, or up to and with them."""
        far = np.zeros(len(low), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            a, b = (low - far - (1 << k) + 1, high - far - (1 << k) + 1) if back else (low + far, high + far)
            inside = (a >= 0) & (b + (1 << k) <= n)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            far += same.astype(np.int64) << k
        return far

    found: dict[tuple[int, int], int] = {}
    lag, most = 1, n // 2
    while lag <= most:
        upto = lag
        pairs = 0
        while upto <= most and (pairs == 0 or pairs + n // upto <= STEP_PAIRS):
            pairs += n // upto
            upto += 1
        lags = np.arange(lag, upto)
        times = (n - 1) // lags
        lags = np.repeat(lags, times)
        high = (np.arange(len(lags)) - np.repeat(np.cumsum(times) - times, times) + 1) * lags
        match = ids[high] == ids[high - lags]
        lags, high = lags[match], high[match]
        ahead, behind = equal(high - lags, high, False), equal(high - lags, high, True) - 1
        length = ahead + behind + lags
        good = (length >= least) & (length >= 2 * lags)
        for start, size, own in zip((high - behind - lags)[good].tolist(), length[good].tolist(), lags[good].tolist(), strict=True):
            found.setdefault((start, size), own)  # lags come in ascending order
        lag = upto
    for (start, length), own in found.items():
        yield start, length, own


def runs_of(words: list, least: int = LEAST, dense: float = DENSE) -> list[Run]:
    """All runs of a text as (start, length, period), by start and then period."""
    if len(words) < least:
        return []
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    two = _codes(ids[:-1], ids[1:])
    four = _codes(two[:-2], two[2:])
    six = _codes(four[:-2], two[4:])
    counts = np.bincount(six)
    carried = int((counts * (counts - 1) // 2).sum())
    return sorted(_sparse(six, least) if carried <= dense * len(words) else _anchored(ids, least), key=lambda r: (r[0], r[2])) if carried else []


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _suspects(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows in which a gram may occur twice; rows left out have none."""
    words = Words(data, offsets)
    at, grams = words.windows(GRAM)
    if not len(at):
        return set()
    row = words.row[at]
    order = np.argsort(keys := grams ^ mix64(row.astype(np.uint64) + np.uint64(1)), kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    return set(row[order[1:][again]].tolist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, its runs by start and period, and ``collapsed``, the text without repeated periods.

    ``collapsed`` joins the kept words by one space.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        schema = pa.schema([("doc_id", id_type), ("runs", run_type), ("collapsed", pa.string())])
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for a, b in steps(offsets):
                part = data[offsets[a] : offsets[b]]
                suspects, runs, collapsed = _suspects(part, offsets[a : b + 1]), [], []
                for i in range(a, b):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    own = runs_of(words) if i - a in suspects else []
                    if own:
                        keep = kept_words(len(words), own)
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(runs, run_type), pa.array(collapsed, pa.string())], schema=schema)

    out = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return texts.mapInArrow(find, out)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    spaced = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth text by crc32 of the id becomes periodic from some word on."""
    h = id_crc(id_col)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words_of(F.col("text"))))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    placed = chosen.withColumn("_a", F.when(n > 0, (g % n).cast("int"))).withColumn("_p", F.when(n > 0, (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")))
    word = lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    return placed.select("doc_id", F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of :func:`periodic_runs`."""
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = found.withColumn("_best", best)
    exponent = F.floor(1000 * F.col("_best.length") / F.col("_best.period"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        exponent.cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
