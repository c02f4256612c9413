"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids come in pieces of at most one
window; a piece goes into the open window with the least room that still holds it (best fit). When
none does and all windows are open, the fullest is emitted; where its room exceeds ``slack`` ids, it
is first topped up with the head of the piece. Windows still open when a partition ends are merged:
their pieces are packed again, ``fan_in`` partitions to a task, level by level, and what the last
level leaves is poured into full windows, the rest cut into windows of power-of-two length.

Cases: null and empty texts have the closing id alone; a text of any length is cut at window
boundaries; repeated rows are packed each; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, steps, utf8_parts

_STATE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_COLUMNS = ["doc_id", *[c.split()[0] for c in _STATE.split(", ")]]


def _lowered(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), those with combining marks (U+0300 to U+036F: lead bytes CC and CD) unchanged."""
    if b"\xcc" in text or b"\xcd" in text:
        return [w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in text.split()]
    return text.lower().split()


class WordTokens:
    """Ids, as little-endian unsigned 32-bit, of a text whose tokenizer never joins across ASCII space.

    The tokenizer composes letters and marks, then ignores case, and takes letters and punctuation apart. So words are
    remembered in lower case, but those with combining marks as they stand, as a lowered letter may join a mark that the capital does not; and a
    word of letters without marks of their own with one closing mark as the word and the mark. ``remember`` bounds the words kept:
    beyond it, those that came last, the rarer ones, are forgotten. A worker keeps them from task to task.
    """

    known: dict[tuple, dict[bytes, bytes]] = {}

    def __init__(self, path: str, end_id: int, remember: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.ids = self.known.setdefault((path,), {})
        self.end = np.array([end_id], "<u4").tobytes()

    def encode(self, words: list[bytes]) -> None:
        """Words of Latin letters are single pre-tokens: the tokenizer's model takes them without the other steps."""
        tokenize, as_bytes, others = self.tokenizer.model.tokenize, self.as_bytes.pre_tokenize_str, []
        for word in words:
            if word.isalpha():
                ids = [t.id for t in tokenize(word.decode())]
            else:
                text = word.decode()
                if not (text.isalpha() and max(text) < "\u0250" and len(lower := text.lower()) == len(text)):
                    others.append(word)
                    continue
                ids = [t.id for t in tokenize(as_bytes(unicodedata.normalize("NFC", lower))[0][0])]
            self.ids[word] = struct.pack(f"<{len(ids)}I", *ids)
        for a in range(0, len(others), 8192):
            some = others[a : a + 8192]
            for word, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                ids = e.ids
                self.ids[word] = struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [_lowered(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self.ids]
        # a lowered letter may end in a combining mark, which would join the closing one
        marked = [w for w in new if w[-1:] in (b".", b",") and (w[:-1].isalpha() or w[:-1].decode().lower().isalpha() and unicodedata.normalize("NFD", w[:-1].decode().lower()) == w[:-1].decode().lower())]
        wanted = set(new) - set(marked) | {w[:-1] for w in marked} | ({b".", b","} if marked else set())
        self.encode([w for w in wanted if w not in self.ids])
        self.ids.update([(w, self.ids[w[:-1]] + self.ids[w[-1:]]) for w in marked])
        out = [b"".join(map(self.ids.__getitem__, words)) + self.end for words in split]
        for w in marked:
            del self.ids[w]
        for w in list(self.ids)[self.remember // 2 :] if len(self.ids) > self.remember else ():
            del self.ids[w]
        return out


class Packer:
    """The open windows of one task. ``closed`` gathers the pieces of emitted windows."""

    def __init__(self, first_id: int, size: int, windows: int, slack: int):
        self.next_id, self.size, self.windows, self.slack = first_id, size, windows, slack
        self.open: list[list] = []  # [ids used, [(doc_id, start, doc_tokens, ids bytes), ...]]
        self.closed: list[tuple] = []

    def emit(self, window: list) -> None:
        offset = 0
        for doc_id, start, total, ids in window[1]:
            self.closed.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, start: int, total: int, ids: bytes) -> None:
        at, n = 0, len(ids) // 4
        while n - at >= self.size:
            self.emit([self.size, [(doc_id, start + at, total, ids[4 * at : 4 * (at + self.size)])]])
            at += self.size
        while at < n:
            need = n - at
            room = [w for w in self.open if self.size - w[0] >= need]
            if room:
                best = max(room, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
                need = self.size - best[0] if self.size - best[0] > self.slack else 0
            if need:
                best[0] += need
                best[1].append((doc_id, start + at, total, ids[4 * at : 4 * (at + need)]))
                at += need
            if at < n or best[0] == self.size:  # full, or the fullest when nothing fits
                self.open.remove(best)
                self.emit(best)

    def pour(self) -> None:
        """Empties the open windows into full ones; the rest into windows of power-of-two length."""
        pieces = [p for w in self.open for p in w[1]]
        left, sizes = sum(len(p[3]) // 4 for p in pieces), []
        while left:
            sizes.append(self.size if left >= self.size else 1 << (left.bit_length() - 1))
            left -= sizes[-1]
        self.open = []
        for size in sizes:
            window, room = [size, []], size
            while room:
                doc_id, start, total, ids = pieces.pop(0)
                take = min(room, len(ids) // 4)
                window[1].append((doc_id, start, total, ids[: 4 * take]))
                if 4 * take < len(ids):
                    pieces.insert(0, (doc_id, start + take, total, ids[4 * take :]))
                room -= take
            self.emit(window)

    def rows(self, part: int, with_open: bool) -> pd.DataFrame:
        out = [(*row, None, None) for row in self.closed]
        self.closed = []
        if with_open:
            out += [(doc_id, start, len(ids) // 4, None, total, None, None, part, ids) for w in self.open for doc_id, start, total, ids in w[1]]
        frame = pd.DataFrame(out, columns=_COLUMNS, dtype=object)
        for c in _COLUMNS[1:-1]:
            frame[c] = frame[c].astype("Int64")
        return frame


def _merge(level: int, last: bool, size: int, windows: int, slack: int):
    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        packer = Packer(level << 56 | part << 28, size, windows, slack)
        for row in pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True]).itertuples():
            packer.add(None if pd.isna(row.doc_id) else row.doc_id, int(row.start), int(row.doc_tokens), row.ids)
        if last:
            packer.pour()
        return packer.rows(part, not last)

    return again


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, windows: int = 24, slack: int = 16, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    state = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_STATE}"
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens, packer = WordTokens(tokenizer_path, end_id), Packer(part << 28, size, windows, slack)
        schema = pa.schema([("doc_id", id_type)] + [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _STATE.split(", ")])
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in steps(offsets, 1 << 20):
                for doc_id, ids in zip(doc_ids[a:b], tokens([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]), strict=True):
                    packer.add(doc_id, 0, len(ids) // 4, ids)
            yield pa.RecordBatch.from_pandas(packer.rows(part, False), schema=schema, preserve_index=False)
        yield pa.RecordBatch.from_pandas(packer.rows(part, True), schema=schema, preserve_index=False)

    rows = materialise(texts.mapInArrow(first, state), "packed")
    done = rows.filter(F.col("part").isNull()).drop("part", "ids")
    left, level = rows.filter(F.col("part").isNotNull()), 0
    while True:
        level += 1
        parts = left.agg(F.countDistinct("part")).first()[0]
        last = parts <= fan_in

        left = left.withColumn("part", (F.lit(0) if last else F.floor(F.col("part") / fan_in)).cast("long"))
        merged = left.groupBy("part").applyInPandas(_merge(level, last, size, windows, slack), state)
        if last:
            return done.unionByName(merged.drop("part", "ids"))
        rows = materialise(merged, "packed")
        done, left = done.unionByName(rows.filter(F.col("part").isNull()).drop("part", "ids")), rows.filter(F.col("part").isNotNull())
