"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of ``window`` consecutive words of each benchmark item; an item with
fewer words is one shorter window. Windows of one length form a pattern set with a block shift
table: a block is two neighbouring words (one, where windows have a single word), its hash names a cell of the
table, and the cell tells how far the search may move without passing an occurrence. A shift of nought leads
to the bucket of windows that could end there, found by hash, and each is compared directly, word by word
as bytes. Texts are searched in stretches of words side by side, each with a pointer of its own.

Pattern sets are flat arrays (41 bytes a window and the items' words once). They are broadcast in blocks
of items that together stay within ``block_bytes``; a larger benchmark is searched in several passes whose hits
are united for each document.

Cases: null, empty and word-free texts have no words and no hits; word-free items match nothing;
items with equal windows all count; windows of items without an id are searched too, and all such items
together count as one that adds nothing to the list of ids; a window crosses no document; repeated rows each
get their row; no documents or no items give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, Words, chain, materialise, steps, utf8_parts
from .sharding import number_rows


SHIFT_BITS = 21
#: Words of a text that one pointer searches.
STRETCH = 256
#: Bytes of arrays for each byte of an item's text: a window has 41, and a word with its space rarely less than five.
BYTES_A_BYTE = 9


class PatternSet:
    """Shift table and suffix buckets of windows with one length, over the words of all items."""

    def __init__(self, length: int, text: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, item: np.ndarray):
        self.length, self.block, self.text = length, min(2, length), text
        self.step = length - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, self.step, np.int16)
        for at in range(self.step):
            cell = chain(hashes, first + at, self.block) >> np.uint64(64 - SHIFT_BITS)
            np.minimum.at(self.shift, cell.astype(np.int64), self.step - 1 - at)
        whole = chain(hashes, first, length)
        order = np.argsort(whole, kind="stable")
        self.whole, first = whole[order], first[order]
        self.start, self.end, self.item = starts[first], ends[first + length - 1], item[order]


def pattern_sets(items: list[tuple], window: int) -> tuple[list[PatternSet], list]:
    """Pattern sets, and the ids that their numbers of items stand for."""
    data = [(text or "").encode() for _, text in items]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    found = Words(np.frombuffer(b"".join(data), np.uint8), offsets, ALNUM_WORD)
    # every word once, followed by a space: windows are slices of this text
    lengths = found.end - found.start
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[np.repeat(starts, lengths) + place] = found.data[np.repeat(found.start, lengths) + place]
    text = text.tobytes()
    size = np.minimum(np.diff(found.of_row), window)
    row, at = found.row, np.arange(len(found))
    valid = at + size[row] <= found.of_row[row + 1] if len(at) else np.zeros(0, bool)
    sets = []
    for length in np.unique(size[size > 0]).tolist():
        first = np.flatnonzero(valid & (size[row] == length))
        sets.append(PatternSet(length, text, starts, starts + lengths, found.hash, first, row[first].astype(np.int32)))
    return sets, [item for item, _ in items]


def occurrences(words: Words, patterns: PatternSet) -> Iterator[tuple[int, np.ndarray]]:
    """First word and item numbers of every occurrence in any of the texts of ``words``."""
    n, size, block = len(words), patterns.length, patterns.block
    if n < size:
        return
    cell = (chain(words.hash, np.arange(n - block + 1), block) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)
    at = np.arange(size - block, n - block + 1, STRETCH)
    stop, ends = np.minimum(at + STRETCH, n - block + 1), []
    while len(at):
        move = patterns.shift.take(cell.take(at))
        ends.append(at[move == 0])
        at = at + np.maximum(move, 1)
        inside = at < stop
        at, stop = at[inside], stop[inside]
    first = np.concatenate(ends) + block - size
    first = first[words.row[first] == words.row[first + size - 1]]
    whole = chain(words.hash, first, size)
    low, high = np.searchsorted(patterns.whole, whole, "left"), np.searchsorted(patterns.whole, whole, "right")
    for k in np.flatnonzero(high > low).tolist():
        f = int(first[k])
        spelled = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[f : f + size], words.end[f : f + size], strict=True))
        same = [j for j in range(low[k], high[k]) if patterns.text[patterns.start[j] : patterns.end[j]] == spelled]
        if same:
            yield f, patterns.item[same]


def _search(broadcast):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets, ids = broadcast.value
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            n_words, spans, items = [], [], []
            for a, b in steps(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1], ALNUM_WORD)
                hit_spans, hit_items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
                for patterns in sets:
                    for first, found in occurrences(words, patterns):
                        r = words.row[first]
                        hit_spans[r].append((int(first - words.of_row[r]), int(first - words.of_row[r]) + patterns.length))
                        hit_items[r].update(ids[i] for i in found.tolist())
                n_words += np.diff(words.of_row).tolist()
                spans += [merged(s) for s in hit_spans]
                items += [sorted(i - {None}) + [None] * (None in i) for i in hit_items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return run


def merged(spans: list) -> list[list[int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct test strings and the number of blocks that keep the arrays of each within ``block_bytes``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(BYTES_A_BYTE * F.octet_length("text") + 64), F.lit(0))).first()[0]
    return items, max(1, -(-total // block_bytes))


def _block(items: DataFrame, b: int, blocks: int, window: int):
    """The broadcast pattern sets of one block of items, and the ids of its items."""
    some = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
    return items.sparkSession.sparkContext.broadcast(pattern_sets([tuple(r) for r in some.collect()], window))


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 192 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows in whose text no window of the benchmark occurs; one pass a block, no join."""
    items, blocks = _items(benchmark, item_col, item_text_col, block_bytes)
    for b in range(blocks):
        if b:  # a worker holds one block at a time
            docs = materialise(docs, "clean")
        docs = docs.filter(~_hit(_block(items, b, blocks, window))(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _hit(patterns):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
        data, out = np.frombuffer(b"".join(data), np.uint8), np.zeros(len(texts), bool)
        for a, b in steps(offsets):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1], ALNUM_WORD)
            for own in patterns.value[0]:
                for first, _ in occurrences(words, own):
                    out[a + words.row[first]] = True
        return pd.Series(out)

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 192 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (disjoint [first, end) word ranges of hits) and items (ids as strings)."""
    items, blocks = _items(benchmark, item_col, item_text_col, block_bytes)
    key = F.col(id_col).alias("row")
    if blocks > 1:  # rows of several passes meet by a number of their own
        rows, _ = number_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id")
        docs, key, text_col = rows, F.col("row_number").alias("row"), "_text"
    texts = docs.select(key, F.col(text_col).alias("text"))
    schema = f"row {texts.schema['row'].dataType.simpleString()}, n_words long, spans array<array<long>>, items array<string>"
    out = None
    for b in range(blocks):
        found = texts.mapInArrow(_search(_block(items, b, blocks, window)), schema)
        found = materialise(found, "hits") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out.withColumnRenamed("row", "doc_id")
    joined = out.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    start, end = lambda x: x[0], lambda x: x[1]
    spans = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<array<long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (start(x) <= end(F.element_at(acc, -1))), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(start(F.element_at(acc, -1)), F.greatest(end(F.element_at(acc, -1)), end(x)))))).otherwise(F.concat(acc, F.array(x))),
    )
    joined = joined.withColumn("spans", spans)
    return docs.select("row_number", F.col("_id").alias("doc_id")).join(joined.withColumnRenamed("row", "row_number"), "row_number").drop("row_number")


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    hits = benchmark_hits(docs, benchmark, **settings)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
