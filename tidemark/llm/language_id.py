"""Language identification with bit-sliced Bloom filters over character n-grams.

Every slot of the filter table holds one bit for each language, so the conjunction of the few slots of
an n-gram gives at once all languages that contain it. A text is decided by the popcounts of these
masks for each language, less what chance hits give at that language's fill.

Training counts n-grams by language over all training texts. An n-gram belongs to a language when
its share of that language's n-grams is at least ``least_share`` and at least ``near_best`` times its
largest share in any language; the former bounds the n-grams of a language by 1 / least_share.

Cases: null texts and texts without letters are ``und`` with score 0; letters without any known
n-gram give the most frequent language with score 0; ties go to the more frequent language, then by
name; rows without language are scored, not learned from; an empty training set makes all ``und``;
repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, materialise, mix64

ORDERS = (2, 3, 4)
STEP_CHARS = 400_000
PLANE = 62  # languages of one table of slots

_alpha: np.ndarray | None = None


def alphabetic() -> np.ndarray:
    """Whether each code point is a letter; built once in a worker."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts [a, b): hashes of all n-grams, their text's index and letters of each text.

    N-grams are of lower-cased letters with at most a space at either end; other characters are spaces.
    """
    lower = [(t or "").lower() for t in texts]
    a = 0
    while a < len(lower):
        b, chars = a + 1, len(lower[a])
        while b < len(lower) and chars + len(lower[b]) <= STEP_CHARS:
            chars += len(lower[b])
            b += 1
        code = np.frombuffer((" " + " ".join(lower[a:b]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = alphabetic()[code]
        code = np.where(letter, code, np.uint64(32))
        starts = np.cumsum([0] + [len(t) + 1 for t in lower[a:b]])
        letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[starts])
        hashes, owners = [], []
        for n in ORDERS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            ok = letter[1 : m + 1].copy() if n > 2 else letter[:m] | letter[1 : m + 1]
            for j in range(2, n - 1):
                ok &= letter[j : m + j]
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x110001) + code[at + j]
            hashes.append(mix64(h))
            inner = at + 1 if n > 2 else np.where(letter[at], at, at + 1)  # a letter of the n-gram
            owners.append(np.searchsorted(starts, inner, "right") - 1)
        yield a, b, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, int), letters
        a = b


def _count(batches: Iterator, most_pairs: int = 1_500_000) -> Iterator:
    """(lang, gram, n) of one partition. At ``most_pairs`` pairs of all languages equal n-grams are added up; where that leaves more than
    half, they go to the shuffle and counting starts anew, so memory does not grow with the partition and each pair is sorted twice or so."""
    import pyarrow as pa

    held: dict[str, list] = {}
    size = 0

    def shrink(pairs: list) -> list:
        g, where = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
        return [(g, np.bincount(where, np.concatenate([p[1] for p in pairs]), len(g)).astype(np.int64))]

    def rows() -> Iterator:
        for name, pairs in held.items():
            for g, n in shrink(pairs):
                for a in range(0, len(g), 100_000):
                    some = g[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.view(np.int64)), pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for a, b, hashes, owner, _ in grams(batch.column(0).to_pylist()):
            names, number = np.unique(langs[a:b].astype(str), return_inverse=True)
            of = number[owner]
            for i, name in enumerate(names):
                own = np.unique(hashes[of == i], return_counts=True)
                held.setdefault(name, []).append(own)
                size += len(own[0])
            if size > most_pairs:
                held = {name: shrink(pairs) for name, pairs in held.items()}
                size = sum(len(pairs[0][0]) for pairs in held.values())
                if size > most_pairs // 2:
                    yield from rows()
                    held, size = {}, 0
    yield from rows()


@dataclass
class LanguageModel:
    languages: list[str]  # most frequent first
    slots: np.ndarray  # [planes, slots] masks
    chance: np.ndarray  # chance hits of each language
    hashes: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        bits = int(np.log2(self.slots.shape[1]))
        for a, b, h, owner, letters in grams(texts):
            counts = np.zeros((b - a, len(self.languages)))
            for p, table in enumerate(self.slots):
                mask = table[h & np.uint64(table.size - 1)]
                for k in range(1, self.hashes):
                    mask = mask & table[(h >> np.uint64(bits * k)) & np.uint64(table.size - 1)]
                for i in range(p * PLANE, min(len(self.languages), (p + 1) * PLANE)):
                    hit = (mask >> np.uint64(i - p * PLANE)) & np.uint64(1)
                    counts[:, i] = np.bincount(owner, hit, b - a)
            total = np.bincount(owner, minlength=b - a)[:, None]
            true = np.maximum((counts - total * self.chance) / (1 - self.chance), 0)
            best = true.argmax(axis=1)
            share = true.max(axis=1) / np.maximum(true.sum(axis=1), 1e-9)
            for i in np.flatnonzero(letters):
                names[a + i], scores[a + i] = self.languages[best[i]], min(share[i], 1.0)
        return names, scores


def fit(train: DataFrame, slots: int = 1 << 20, hashes: int = 3, least_share: float = 4e-6, near_best: float = 0.5, min_count: int = 2) -> LanguageModel:
    """Learns from the columns ``text`` and ``lang`` of ``train``; the table of slots has a fixed size."""
    pairs = train.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counted = pairs.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()  # a row for each language
    languages = [r.lang for r in totals]
    numbered = train.sparkSession.createDataFrame([(r.lang, i, r.total) for i, r in enumerate(totals)], "lang string, i int, total long")
    shares = counted.filter(F.col("n") >= min_count).join(F.broadcast(numbered), "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.withColumn("best", F.max("share").over(Window.partitionBy("gram")))
    own = shares.filter((F.col("share") >= least_share) & (F.col("share") >= near_best * F.col("best")))
    bits = slots.bit_length() - 1
    at = F.array(*[F.shiftrightunsigned("gram", bits * k).bitwiseAND(F.lit(slots - 1)) for k in range(hashes)])
    one = own.select(F.explode(at).alias("slot"), F.floor(F.col("i") / PLANE).cast("int").alias("plane"), F.expr(f"shiftleft(1L, i % {PLANE})").alias("bit"))
    rows = one.groupBy("plane", "slot").agg(F.bit_or("bit").alias("mask")).toPandas()  # at most slots rows for each plane
    table = np.zeros((max(1, -(-len(languages) // PLANE)), slots), np.uint64)
    table[rows["plane"], rows["slot"]] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((table[i // PLANE] >> np.uint64(i % PLANE)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageModel(languages, table, np.minimum(fill**hashes, 0.999), hashes)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.withColumn("_found", run(F.coalesce(F.col(text_col), F.lit(""))))
    return found.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn("score", F.col("_found.score")).drop("_found")


def language_ids(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from rows whose crc32(doc_id) mod 4 is not 2."""
    held = F.pmod(id_crc(), F.lit(4)) == 2
    model = fit(docs.filter(~held).select("text", "lang"), **settings)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
