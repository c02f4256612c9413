"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is read word by word. A word of the alphabet (training words with a rate of at least
``least_rate``, twice at least) is one symbol of a prefix code made from the training counts; any other
word is the escape symbol and then its bytes up to a closing symbol, in a fixed code of 6 or 9 bits. Every
bit of every symbol has several predictors. Hashed ones hold counts of noughts and ones in a table slot
chosen by a context and the bits of the symbol so far: for words the language state and the last word
(where it is one of the ``HEADS`` most frequent); for bytes the last two bytes with the state, three
bytes, and the word so far with the state. A match predictor expects the word that
followed the same two words before, in this text or else in training, and predicts its bits while they agree.

The stretched probabilities are combined by weights chosen by a gate (kind of symbol, bit number, and
whether there is a match and how it fared so far in this text; for bytes the place in the word). An
adaptive map of the gate refines the result. So the mixture follows the text while it is read: the state is
the group of training texts (a column such as lang, where there is one) that fits the words so far
best, and the matches are its own repetitions. The score of a text is the sum over its bits and nothing else.

Training rows are dealt to learners by a hash of id and text; their number follows from the bytes of the corpus alone, and each
learner reads its rows once, online, in the order of that hash: a step of texts is predicted with the tables so far,
weights take a Newton step and the map is counted, then the step's bits enter the tables. Tables are summed
over learners in their order, weights averaged by the bits they saw, so partitions, files and cores do not change a score. Table sizes follow the number of training tokens up
to ``most_bits`` bits; above 2^31 the two counts of a slot are halved together. The followers of word
pairs keep, in each slot, a candidate and its lead over others (a majority vote, which can be merged).
Equal symbols in equal contexts of a step are computed once and weighed by their number.

Cases: null and empty texts are the end token alone; without training rows a hashed predictor says one
half; a missing or null group column gives one group; repeated rows each get their row; no rows give an empty
result; other columns are ignored. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, id_crc, materialise, merge_chunks, mix64, steps, utf8_parts

K, LEVELS, BUCKETS, APM_CELLS, CHUNK = 3, 40, 4, 33, 1 << 14
WEIGHTS = -1
END_HASH = int(mix64(np.array([0x656E64], np.uint64)).view(np.int64)[0])
LOG10_2 = float(np.log10(2.0))
HEADS, AGES = 63, 8
LEAST_STEP, MOST_STEP = 32 << 10, 2 << 20  # bytes of text in a step of training: a quarter of what was read
_P1, _P2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Tables by kind of symbol: words have two hashed predictors and the match, bytes three.
TABLES = ((0, 1), (2, 3, 4))


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 8 bits."""
    return np.round(8 * np.log2(counts.astype(np.float32) + np.float32(1))).astype(np.uint8)


def paired(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as 16-bit numbers."""
    q = quantised(counts).astype(np.uint16)
    return q[:, 0] << np.uint16(8) | q[:, 1]


def _inputs() -> np.ndarray:
    """Mixer input for each pair of quantised counts: stretched probability times confidence."""
    n = np.round(2 ** (np.arange(256) / 8) - 1)
    zero, one = n[:, None], n[None, :]
    total = zero + one
    return (np.log((one + 0.3) / (zero + 0.3)) * (total / (total + 0.6))).astype(np.float32).ravel()


INPUT = _inputs()


def prefix_lengths(counts: list[int]) -> np.ndarray:
    """Code lengths of an optimal prefix code for counts in ascending order (two queues)."""
    n = len(counts)
    if n == 1:
        return np.zeros(1, np.int64)
    weight, parent = list(counts), [0] * (2 * n - 1)
    leaf, inner = 0, n
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                child, leaf = leaf, leaf + 1
            else:
                child, inner = inner, inner + 1
            parent[child] = node
            total += weight[child]
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return np.array(depth[:n])


class Alphabet:
    """Words that are one symbol: hash, count, prefix code and how well each group of texts explains them."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, by_group: np.ndarray, tokens: int):
        order = np.lexsort([hashes, counts])
        self.hash, self.count, by_group = hashes[order], counts[order].astype(np.int64), by_group[order]
        escape = max(tokens - int(self.count.sum()), 1)
        at = int(np.searchsorted(self.count, escape))
        lengths = np.minimum(prefix_lengths(np.insert(self.count, at, escape).tolist()), LEVELS - 1)
        # canonical code: longer codes first, so that they count on from nought
        rank = np.argsort(-lengths, kind="stable")
        code, codes, last = 0, np.zeros(len(lengths), np.int64), int(lengths[rank[0]]) if len(rank) else 0
        sizes = lengths[rank].tolist()
        for i, size in zip(rank.tolist(), sizes, strict=True):
            code >>= last - size
            codes[i], last = code, size
            code += 1
        # the escape symbol comes last, so that an unknown word (-1) finds it
        self.length = np.append(np.delete(lengths, at), lengths[at]).astype(np.uint8)
        self.code = np.append(np.delete(codes, at), codes[at]).astype(np.uint32)
        share = np.log((by_group + 0.5) / (by_group.sum(axis=0, keepdims=True) + 0.5 * len(by_group))) if len(by_group) else np.zeros((0, by_group.shape[1]))
        self.fit = np.vstack([share - share.mean(axis=1, keepdims=True), np.zeros((1, by_group.shape[1]))]).astype(np.float32)
        self.index()

    def index(self) -> None:
        """Open addressing by the upper bits of the hash."""
        bits = max(4, int(2 * len(self.hash)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        at, todo = (self.hash.view(np.uint64) >> self.shift).astype(np.int64), np.arange(len(self.hash))
        while len(todo):
            empty = todo[self.place[at[todo]] < 0]
            self.place[at[empty]] = empty
            todo = todo[self.place[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.mask

    def __getstate__(self):
        return self.hash, self.count, self.length, self.code, self.fit

    def __setstate__(self, state):
        self.hash, self.count, self.length, self.code, self.fit = state
        self.index()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the alphabet, -1 for the others."""
        at = (hashes.view(np.uint64) >> self.shift).astype(np.int64)
        found = self.place.take(at)
        if not len(self.hash):
            return found
        other = np.flatnonzero((found >= 0) & (self.hash.take(found) != hashes))
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            found[other] = own = self.place[at[other]]
            other = other[(own >= 0) & (self.hash[own] != hashes[other])]
        return found


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each byte: common ones 6 bits that begin with 0 (0 closes a word), others 9."""
    code, length = np.arange(256) | 1 << 8, np.full(256, 9)
    for i, b in enumerate(b"\x20abcdefghijklmnopqrstuvwxyz.,-'0"):
        code[b], length[b] = i, 6
    return code.astype(np.uint32), length.astype(np.uint8)


BYTE_CODE, BYTE_LENGTH = _byte_codes()


def _hash64(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0xD6E8FEB86659FD93)
        out = out ^ out >> np.uint64(32)
    return out * np.uint64(0x9E3779B97F4A7C15)


def _hash32(*parts: np.ndarray) -> np.ndarray:
    return (_hash64(*parts) >> np.uint64(32)).astype(np.uint32)


def tokens_of(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each token of ``n`` texts, and where words and end tokens are; each text ends with its end token."""
    word_at, end_at = np.arange(len(w)) + w.row, w.of_row[1:] + np.arange(n)
    hashes, doc = np.full(len(w) + n, END_HASH), np.empty(len(w) + n, np.int64)
    hashes[word_at] = w.hash.view(np.int64)
    doc[word_at], doc[end_at] = w.row, np.arange(n)
    return hashes, doc, word_at, end_at


class Symbols:
    """The symbols of several texts: distinct ones of each kind, and which of them each token is made of."""

    def __init__(self, w: Words, offsets: np.ndarray, alphabet: Alphabet, follow: np.ndarray):
        n = len(offsets) - 1
        hashes, doc, word_at, end_at = tokens_of(w, n)
        size = len(hashes)
        first = np.append(0, end_at[:-1] + 1)
        place = np.arange(size) - first[doc]
        self.n, self.hash, self.doc, self.word = n, hashes, doc, alphabet.find(hashes)
        # language state: the group that fits the words before best; one more for a text's first word
        fit = np.cumsum(alphabet.fit.take(self.word, axis=0), axis=0, dtype=np.float64)
        before = np.vstack([np.zeros((1, fit.shape[1])), fit[:-1]])
        state = np.argmax(before - before[first][doc], axis=1).astype(np.uint64)
        state[place == 0] = fit.shape[1]
        last, last2 = np.where(place > 0, np.roll(self.word, 1), -2), np.where(place > 1, np.roll(self.word, 2), -2)
        head = np.where(last >= len(alphabet.hash) - HEADS, len(alphabet.hash) - last, np.where(last == -2, HEADS + 1, 0)).astype(np.uint64)
        # the word that followed the same two words before: in this text, else in training
        mixed = hashes.view(np.uint64)
        self.pair = _hash64(np.where(place > 0, np.roll(mixed, 1), np.uint64(1)), np.where(place > 1, np.roll(mixed, 2), np.uint64(2)))
        expected, lead = look_up(follow, self.pair)
        own = _hash64(self.pair, doc.astype(np.uint64))
        order = np.argsort(own >> np.uint64(24) << np.uint64(24) | np.arange(size, dtype=np.uint64))  # ties by place
        again = np.flatnonzero(own[order[1:]] == own[order[:-1]]) + 1
        earlier = np.full(size, -1)
        earlier[order[again]] = order[again - 1]
        inside = (earlier >= 0) & (place > 1)
        expected = np.where(inside, self.word[earlier], expected)
        age = np.where(inside, AGES - 1, np.minimum(lead, AGES - 2))
        age[(expected == -1) & ~inside | (last2 == -2)] = 0
        right = (age > 0) & (expected == self.word)
        fared = np.where(place > 0, np.roll(right, 1), False).astype(np.int64) + np.where(place > 1, np.roll(right, 2), False)
        bucket = np.where(age > 0, 1 + fared, 0)
        expected = np.where(age > 0, expected, -2)
        #: kind, then for each: number of bits, code, contexts, bucket, expected code and length, age, multiplicity
        symbol, self.of_token, many = distinct(state << np.uint64(40) | head << np.uint64(24) | bucket.astype(np.uint64) << np.uint64(8) | age.astype(np.uint64), self.word, expected)
        contexts = np.stack([_hash32(state[symbol] + np.uint64(11)), _hash32(head[symbol] + np.uint64(12))])
        word, wanted = self.word[symbol], expected[symbol]
        self.kinds = [self._ordered(alphabet.length.take(word), alphabet.code.take(word), contexts, bucket[symbol], many, alphabet.code.take(np.maximum(wanted, -1)), alphabet.length.take(np.maximum(wanted, -1)), age[symbol])]
        # bytes of the other words, each with its closing symbol
        self.rare = word_at[self.word[word_at] < 0]
        token, self.of_rare, many = distinct(state[self.rare], hashes[self.rare])
        of_word = self.rare[token] - doc[self.rare[token]]
        code, length, contexts, bucket, self.of_byte = self._bytes(w, of_word, state[self.rare[token]])
        none = np.zeros(len(code), np.uint32)
        self.kinds.append(self._ordered(length, code, contexts, bucket, many[self.of_byte], none, none, none))

    @staticmethod
    def _ordered(length, code, contexts, bucket, many, wanted, wanted_length, age) -> tuple:
        """Symbols by bucket, long codes first, and where each bucket begins."""
        order = np.argsort((bucket * 64 + 63 - length).astype(np.uint16), kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        columns = (length, code, many.astype(np.float32), wanted, wanted_length.astype(np.uint8), age.astype(np.int64))
        return order, cuts, contexts[:, order], *[c[order] for c in columns]

    @staticmethod
    def _bytes(w: Words, words: np.ndarray, state: np.ndarray) -> tuple:
        lengths = w.end[words] - w.start[words] + 1
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol = np.full(len(word), 32, np.uint8)
        inside = place < lengths[word] - 1
        symbol[inside] = w.data[(w.start[words][word] + place)[inside]]
        s, back = symbol.astype(np.uint64), []
        for k in (1, 2, 3):
            back.append(np.where(place >= k, np.roll(s, k), np.uint64(0)) << np.uint64(8 * (k - 1)))
        two, three = back[0] | back[1], back[0] | back[1] | back[2]
        # the word so far: a running sum of byte hashes by place, less what came before the word
        sums = np.cumsum(mix64(s + np.uint64(256) * place.astype(np.uint64)), dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]]) if len(sums) else sums
        so_far = before - before[np.arange(len(word)) - place]
        own = state[word]
        contexts = np.stack([_hash32(two, own + np.uint64(21)), _hash32(three + (np.uint64(22) << np.uint64(32))), _hash32(so_far, own + np.uint64(23))])
        return BYTE_CODE[symbol], BYTE_LENGTH[symbol], contexts, np.minimum((place + 1) // 2, BUCKETS - 1), word


def distinct(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each distinct row of ``parts``, which of them each row is, and how often each occurs."""
    key = _hash64(*[p.astype(np.int64).view(np.uint64) if p.dtype != np.uint64 else p for p in parts])
    order = np.argsort(key)
    ranked = key[order]
    cut = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(key) else order
    many = np.diff(np.append(cut, len(key)))
    where = np.empty(len(key), np.int64)
    where[order] = np.repeat(np.arange(len(cut)), many)
    return order[cut], where, many


# followers of word pairs: the upper 32 bits of a slot are a check and the candidate, the lower 32 its lead
def look_up(follow: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate (-1: none) and lead for each word pair."""
    slot = follow.take((pair >> np.uint64(65 - len(follow).bit_length())).astype(np.int64))
    hit = (slot >> np.uint64(56) == pair & np.uint64(255)) & (slot & np.uint64(0xFFFFFFFF) > 1)
    return np.where(hit, (slot >> np.uint64(32) & np.uint64(0xFFFFFF)).astype(np.int64), -1), np.where(hit, (slot & np.uint64(0xFFFFFFFF)).astype(np.int64), 0)


def outvote(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges two arrays of slots: equal candidates add their leads, others keep the difference of the stronger."""
    low, top = np.uint64(0xFFFFFFFF), np.uint64(32)
    x, y, same = a & low, b & low, a >> top == b >> top
    lead = np.where(same, np.minimum(x + y, low), np.where(x >= y, x - y, y - x))
    return np.where(same | (x >= y), a >> top, b >> top) << top | lead


def vote(follow: np.ndarray, pair: np.ndarray, word: np.ndarray) -> None:
    """Enters the words of a step as followers of their pairs."""
    known = word >= 0
    slot = (pair[known] >> np.uint64(65 - len(follow).bit_length())) << np.uint64(32) | (pair[known] & np.uint64(255)) << np.uint64(24) | word[known].astype(np.uint64)
    entries, many = np.unique(slot, return_counts=True)
    order = np.lexsort([many, entries >> np.uint64(32)])
    entries, many = entries[order], many[order]
    at = (entries >> np.uint64(32)).astype(np.int64)
    strongest = np.append(np.diff(at) != 0, True) if len(at) else np.zeros(0, bool)
    at, best = at[strongest], (entries[strongest] & np.uint64(0xFFFFFFFF)) << np.uint64(32) | many[strongest].astype(np.uint64)
    follow[at] = outvote(follow[at], best)


class Mixer:
    """Tables, weights and map. ``codes`` holds pairs of quantised counts as 16-bit numbers, a table for each hashed predictor."""

    def __init__(self, codes: list[np.ndarray], follow: np.ndarray):
        self.codes, self.follow = codes, follow
        self.weights = np.full((2, LEVELS, BUCKETS, K), 0.35, np.float32)
        cells = 1 / (1 + np.exp(-np.linspace(-8, 8, APM_CELLS)))
        self.apm = np.broadcast_to(cells.astype(np.float32), (2, LEVELS, BUCKETS, APM_CELLS)).copy()
        #: how often the match was wrong and right, by fare, age and bit number
        self.match = np.tile(np.array([1.0, 4.0]), (BUCKETS, AGES, LEVELS, 1))

    def run(self, symbols: Symbols, learner: Learner | None = None) -> np.ndarray | None:
        """log10 probability of each text; with a learner, which takes note of every bit, none."""
        costs = []
        for kind, (order, cuts, context, length, code, many, wanted, wanted_length, age) in enumerate(symbols.kinds):
            cost = np.zeros(len(order), np.float32)
            for bucket in range(BUCKETS):
                a, b = cuts[bucket], cuts[bucket + 1]
                trust = np.log(self.match[bucket, :, :, 1] / self.match[bucket, :, :, 0]).astype(np.float32)
                for level in range(int(length[a]) if b > a else 0):
                    m = a + int(np.searchsorted(-length[a:b].view(np.int8), -level, "left"))
                    own = length[a:m] - np.uint8(1 + level)
                    prefix = code[a:m] >> own
                    y, node = prefix & np.uint32(1), (prefix >> np.uint32(1) | np.uint32(1 << level)) * _P1
                    slots, x = [], np.zeros((K, m - a), np.float32)
                    for k, t in enumerate(TABLES[kind]):
                        shift = np.uint32(33 - len(self.codes[t]).bit_length())
                        slots.append((context[k, a:m] ^ node) * _P2 >> shift)
                        x[k] = INPUT.take(self.codes[t].take(slots[k]))
                    seen = None
                    if kind == 0 and bucket:
                        inner = np.maximum(wanted_length[a:m].astype(np.int8) - np.int8(1 + level), 0).astype(np.uint8)
                        guess = wanted[a:m] >> inner
                        agrees = (guess >> np.uint32(1) == prefix >> np.uint32(1)) & (wanted_length[a:m] > level)
                        says = (guess & np.uint32(1)).astype(np.float32) * 2 - 1
                        x[2] = np.where(agrees, says * trust[age[a:m], level], 0)
                        seen = np.flatnonzero(agrees), (guess & np.uint32(1)) == y
                    dot = np.clip(self.weights[kind, level, bucket] @ x, -12, 12)
                    p = 1 / (1 + np.exp(-dot))
                    at = np.clip(dot * 2 + 16, 0, APM_CELLS - 1.001)
                    cell = at.astype(np.int32)
                    if learner is not None:
                        learner.note(kind, level, bucket, slots, y, x, p, cell, at, many[a:m])
                        if seen is not None:
                            right = seen[1][seen[0]].astype(np.int64)
                            np.add.at(learner.matched[bucket, :, level], (age[a:m][seen[0]], right), many[a:m][seen[0]])
                        continue
                    row = self.apm[kind, level, bucket]
                    p = np.clip((p + row.take(cell) + (at - cell) * (row[1:] - row[:-1]).take(cell)) / 2, 2.0**-16, 1 - 2.0**-16)
                    cost[a:m] += np.log(np.abs(1 - y.astype(np.float32) - p))
            back = np.empty(len(order))
            back[order] = cost
            costs.append(back)
        if learner is not None:
            return None
        each = costs[0][symbols.of_token]
        spelled = np.bincount(symbols.of_byte, costs[1], int(symbols.of_rare.max()) + 1 if len(symbols.of_rare) else 0)
        each[symbols.rare] += spelled[symbols.of_rare]
        return np.bincount(symbols.doc, each, symbols.n) * np.log10(np.e)


class Learner:
    """What one partition learns online: counts in tables, followers, weights by Newton steps, cells of the map."""

    def __init__(self, sizes: list[int], follow: int):
        self.mixer = Mixer([np.zeros(s, np.uint16) for s in sizes], np.zeros(follow, np.uint64))
        self.counts = [np.zeros(2 * s, np.uint32) for s in sizes]
        self.noted: list[list] = [[] for _ in sizes]
        shape = (2, LEVELS, BUCKETS)
        self.slope, self.curve, self.bits = np.zeros((*shape, K)), np.zeros((*shape, K, K)), np.zeros(shape)
        self.cells, self.matched, self.read = np.zeros((*shape, APM_CELLS, 2)), np.zeros((BUCKETS, AGES, LEVELS, 2)), 0

    def note(self, kind, level, bucket, slots, y, x, p, cell, at, many) -> None:
        for k, t in enumerate(TABLES[kind]):
            self.noted[t].append((slots[k] << np.uint32(1) | y, many))
        gate = (kind, level, bucket)
        self.slope[gate] += x @ ((y - p) * many)
        self.curve[gate] += (x * (p * (1 - p) * many)) @ x.T
        self.bits[gate] += many.sum()
        self.cells[gate] += np.bincount(2 * (cell + (at - cell > 0.5)) + y, many, 2 * APM_CELLS).reshape(APM_CELLS, 2)

    def learn(self, symbols: Symbols, size: int) -> None:
        """One step: predict, move the weights, then enter the bits into the tables."""
        self.mixer.run(symbols, self)
        self.read += size
        self.mixer.weights += np.linalg.solve(self.curve + 4 * np.eye(K), self.slope[..., None])[..., 0].clip(-0.5, 0.5).astype(np.float32)
        self.mixer.match = self.matched + np.array([1.0, 4.0])
        self.slope[:] = 0
        self.curve *= 0.9
        vote(self.mixer.follow, symbols.pair, symbols.word)
        for t, parts in enumerate(self.noted):
            if parts:
                index = np.concatenate([p[0] for p in parts])
                np.add.at(self.counts[t], index, np.concatenate([p[1] for p in parts]).astype(np.uint32))
                slot, pairs = index >> np.uint32(1), self.counts[t].view(np.uint64)
                touched = np.zeros(len(pairs), bool)
                touched[slot] = True
                slot = np.flatnonzero(touched)
                own = pairs.take(slot).view(np.uint32).reshape(-1, 2)
                if (own >> np.uint32(31)).any():
                    own = halved(own)
                    pairs[slot] = own.view(np.uint64).ravel()
                self.mixer.codes[t][slot] = paired(own)
            self.noted[t] = []


    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """All that was learned: parts of the tables (numbered by table and place), of the followers (below nought), and the rest."""
        for t, counts in enumerate(self.counts):
            for c in range(0, len(counts), 2 * CHUNK):
                if counts[c : c + 2 * CHUNK].any():
                    yield t << 32 | c // (2 * CHUNK), packed(counts[c : c + 2 * CHUNK])
        for c in range(0, len(self.mixer.follow), CHUNK):
            if self.mixer.follow[c : c + CHUNK].any():
                yield -2 - c // CHUNK, packed(self.mixer.follow[c : c + CHUNK])
        if self.read:
            mixed = [self.mixer.weights * self.bits[..., None], self.bits, self.cells, self.matched]
            yield WEIGHTS, np.concatenate([m.ravel() for m in mixed]).tobytes()


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes, those of equal place together."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def merged(chunk: int, vectors: list[bytes]) -> bytes:
    """What several partitions learned, as one."""
    if chunk == WEIGHTS:
        return np.sum([np.frombuffer(v, np.float64) for v in vectors], axis=0).tobytes()
    total = unpacked(vectors[0], np.uint64 if chunk < 0 else np.uint32)
    for v in vectors[1:]:
        if chunk < 0:
            total = outvote(total, unpacked(v, np.uint64))
        else:
            total = halved((total.astype(np.uint64) + unpacked(v, np.uint32)).reshape(-1, 2)).ravel().astype(np.uint32)
    return packed(total)


def _quantise(batches: Iterator) -> Iterator:
    """Counts of the tables as 16-bit codes; the rest as it is."""
    import pyarrow as pa

    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        out = [packed(paired(unpacked(v, np.uint32).reshape(-1, 2))) if c >= 0 else v for c, v in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "vector"])


def halved(pairs: np.ndarray) -> np.ndarray:
    """Pairs of counts with those that reach 2^31 halved together."""
    large = pairs.max(axis=-1, keepdims=True) >> 31 > 0
    return np.where(large, pairs >> 1, pairs).astype(pairs.dtype)


def _count_words(batches: Iterator) -> Iterator:
    """(hash, g, n) of one partition's tokens by the group of their text, end tokens included; flushed when many."""
    import pyarrow as pa

    held: dict[int, list] = {}
    names = ["hash", "g", "n"]

    def shrink(parts: list) -> list:
        h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(h, np.bincount(where, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64))]

    def rows(g: int):
        for h, n in shrink(held.pop(g)):
            for a in range(0, len(h), 50_000):
                some = h[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(np.full(len(some), g, np.int32)), pa.array(n[a : a + 50_000])], names)

    for batch in batches:
        data, offsets = utf8_parts(batch.column(0))
        groups = np.asarray(batch.column(1))
        for a, b in steps(offsets):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
            own = groups[a:b]
            for g in np.unique(own):
                h, n = np.unique(w.hash[own[w.row] == g], return_counts=True)
                ends = np.array([END_HASH]).view(np.uint64), np.array([(own == g).sum()])
                held.setdefault(int(g), []).extend([(h, n), ends])
                if sum(len(p[0]) for p in held[int(g)]) > 800_000:
                    held[int(g)] = shrink(held[int(g)])
                    if len(held[int(g)][0][0]) > 600_000:
                        yield from rows(int(g))
    for g in list(held):
        yield from rows(g)


def dealt(texts: DataFrame, learners: int) -> DataFrame:
    """(_learner, text): each text with its learner, learners in tasks of their own as far as there are tasks, in a fixed order.

    Equal ids with equal texts share a learner; nothing else does by its key alone.
    """
    spark = texts.sparkSession
    order = F.xxhash64("doc_id", "text")
    # a number for each learner that Spark's partitioning deals to the partition of that learner
    place = F.pmod(F.hash("id"), F.lit(learners))
    found = {r.p: r.id for r in spark.range(64 * learners).groupBy(place.alias("p")).agg(F.min("id").alias("id")).collect()}
    places = F.array(*[F.lit(found.get(i, i)).cast("long") for i in range(learners)])
    rows = texts.select("text", F.col("doc_id").cast("string").alias("_id"), order.alias("_order"), F.pmod(order, F.lit(learners)).cast("int").alias("_learner"))
    rows = rows.withColumn("_place", F.get(places, F.col("_learner"))).repartition(learners, "_place")
    return rows.sortWithinPartitions("_learner", "_order", "_id", "text").select("_learner", "text")


def train(texts: DataFrame, alphabet: Alphabet, tokens: int, task_bytes: int, most_bits: int, learners: int, least_bytes: int) -> Mixer:
    """Reads every training text (columns doc_id and text) once and returns the model."""
    bits = lambda n: int(np.clip(int(n).bit_length(), 12, most_bits))
    sizes = [1 << bits(32 * len(alphabet.hash)), 1 << bits(4 * tokens), *[1 << bits(4 * tokens)] * 3]
    follow = 1 << bits(2 * tokens)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(alphabet)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        learner, alphabet, own = None, shared.value, None
        held, size = [], 0
        batch_of = lambda: (np.concatenate([d for d, _ in held]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in held]))]))

        def step() -> None:
            data, offsets = batch_of()
            learner.learn(Symbols(Words(data, offsets), offsets, alphabet, learner.mixer.follow), len(data))

        def close() -> Iterator:
            if held:
                step()
            for chunk, vector in learner.chunks():
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([chunk]), pa.array([vector], pa.binary())], ["part", "chunk", "vector"])

        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            numbers = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                if own != int(numbers[first]):
                    if learner is not None:
                        yield from close()
                    learner, own, held, size = Learner(sizes, follow), int(numbers[first]), [], 0
                for i in range(first, last):  # text by text, so steps do not depend on batches
                    held.append((data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])))
                    size += int(offsets[i + 1] - offsets[i])
                    if size >= min(max(LEAST_STEP, learner.read // 4), MOST_STEP):
                        step()
                        held, size = [], 0
        if learner is not None:
            yield from close()

    # a learner needs text enough to learn from, and its tables are as large for little text as for much: one for each ``least_bytes``
    # up to ``learners``, more only for each ``task_bytes``
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(min(learners, 1 + size // least_bytes), -(-size // task_bytes))
    learned = dealt(texts, tasks).mapInArrow(read, "part long, chunk long, vector binary")
    codes, followers, total = np.zeros(int(starts[-1]), np.uint16), np.zeros(follow, np.uint64), None
    # what comes to the driver, and is broadcast, has a fixed size: two bytes a slot, eight a follower
    for chunk, vector in merge_chunks(learned, merged, tasks).mapInArrow(_quantise, "chunk long, vector binary").collect():
        if chunk == WEIGHTS:
            total = np.frombuffer(vector, np.float64)
        elif chunk < 0:
            at, part = (-2 - chunk) * CHUNK, unpacked(vector, np.uint64)
            followers[at : at + len(part)] = part
        else:
            at, part = int(starts[chunk >> 32]) + (chunk & 0xFFFFFFFF) * CHUNK, unpacked(vector, np.uint16)
            codes[at : at + len(part)] = part
    model = Mixer([codes[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], followers)
    if total is not None:
        shape = (2, LEVELS, BUCKETS)
        parts = np.split(total, np.cumsum([2 * LEVELS * BUCKETS * n for n in (K, 1, 2 * APM_CELLS)]))
        bits = parts[1].reshape(*shape, 1)
        model.weights = np.where(bits > 0, parts[0].reshape(*shape, K) / np.maximum(bits, 1), model.weights).astype(np.float32)
        cells = parts[2].reshape(*shape, APM_CELLS, 2)
        model.apm = ((cells[..., 1] + 30 * model.apm) / (cells.sum(axis=-1) + 30)).astype(np.float32)
        model.match = parts[3].reshape(BUCKETS, AGES, LEVELS, 2) + model.match
    return model


def lm_scores(
    docs: DataFrame, least_rate: float = 2.0**-23, groups: int = 7, task_bytes: int = 256 << 20, most_bits: int = 21, learners: int = 8, least_bytes: int = 8 << 20, most_words: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang", with_model: bool = True,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``group_col`` parts the training texts only: its ``groups`` most frequent values, and the rest. The
    alphabet has ``most_words`` words at most, those of the highest counts, whatever the size of the corpus; it and the
    tables are what is broadcast. Counts of all other training words reach their documents by a join.
    Without ``with_model`` nothing is trained, and score and bits_per_byte are left out; the base needs counts only.
    """
    spark = docs.sparkSession
    group = F.col(group_col).cast("string") if group_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), (F.pmod(id_crc(id_col), F.lit(7)) == 2).alias("held_out"), F.col(text_col).alias("text"), group.alias("_g"))
    train_texts = texts.filter("not held_out")
    named = [r["_g"] for r in train_texts.filter("_g is not null").groupBy("_g").count().orderBy(F.desc("count"), "_g").limit(groups).collect()]
    number = F.coalesce(*[F.when(F.col("_g") == g, i) for i, g in enumerate(named, 1)], F.lit(0)).cast("int")
    counts = [f"n{i}" for i in range(len(named) + 1)]
    counted = train_texts.select("text", number.alias("g")).mapInArrow(_count_words, "hash long, g int, n long")
    each = [F.coalesce(F.sum(F.when(F.col("g") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(counts)]
    vocabulary = materialise(counted.groupBy("hash").agg(F.sum("n").alias("n"), *each), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(2, int(np.ceil(tokens * least_rate)))
    sixteenth = F.floor(16 * F.log2(F.col("n").cast("double")))  # counts by sixteenths of a power of two: under a thousand rows
    above = 0
    for r in vocabulary.filter(F.col("n") >= least).groupBy(sixteenth.alias("k")).agg(F.count("*").alias("words")).orderBy(F.desc("k")).collect():
        above += r.words
        if above > most_words:
            least = max(least, int(np.ceil(2.0 ** ((r.k + 1) / 16))))
            break
    frequent = vocabulary.filter((F.col("n") >= least) | (F.col("hash") == END_HASH)).toPandas()  # at most most_words rows and one
    if END_HASH not in set(frequent["hash"]):
        frequent.loc[len(frequent)] = [END_HASH, 1, *[0] * len(counts)]
    known_n = frequent["n"].to_numpy(np.int64)
    alphabet = Alphabet(frequent["hash"].to_numpy(np.int64), known_n, frequent[counts].to_numpy(np.float64), tokens)
    model = train(train_texts.select("doc_id", "text"), alphabet, tokens, task_bytes, most_bits, learners, least_bytes) if with_model else None
    shared = spark.sparkContext.broadcast((model, alphabet))
    floor = tokens + distinct + 1
    # the end token is in the alphabet even where training has none
    alphabet_count = lambda a: np.where((a.hash == END_HASH) & (tokens == 0), 0, a.count)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes", "hash", "m"]

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        model, alphabet = shared.value
        in_base = alphabet_count(alphabet)
        base_of = np.append(np.log10((in_base + 1) / floor), 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8_parts(batch.column(2))
            for a, b in steps(offsets):
                own = offsets[a : b + 1] - offsets[a]
                n, words = b - a, Words(data[offsets[a] : offsets[b]], own)
                if model is None:
                    hashes, of, *_ = tokens_of(words, n)
                    word, scores = alphabet.find(hashes), np.zeros(n)
                else:
                    symbols = Symbols(words, own, alphabet, model.follow)
                    hashes, of, word, scores = symbols.hash, symbols.doc, symbols.word, model.run(symbols)
                known = (word >= 0) & (np.append(in_base, 0).take(word) > 0)
                ids = np.arange(row, row + n)
                none = lambda kind, size: pa.nulls(size, kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(np.bincount(of, minlength=n)), pa.array(np.bincount(of[known], minlength=n)),
                    pa.array(np.bincount(of, base_of.take(word), n)), pa.array(scores), pa.array(np.diff(own)), none(pa.int64(), n), none(pa.int64(), n),
                ], names)
                rare = np.flatnonzero(word < 0)
                h, where = np.unique(hashes[rare], return_inverse=True)
                pairs, m = np.unique(of[rare] * max(len(h), 1) + where, return_counts=True)
                size = len(pairs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[pairs // max(len(h), 1)]), none(batch.column(0).type, size), none(pa.bool_(), size), *[none(pa.int64(), size)] * 2, *[none(pa.float64(), size)] * 2,
                    none(pa.int64(), size), pa.array(h[pairs % max(len(h), 1)]), pa.array(m),
                ], names)
                row += n

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long, hash long, m long"
    rows = materialise(texts.select("doc_id", "held_out", "text").mapInArrow(score, schema), "scored")
    others = vocabulary.filter(F.col("n") < least).select("hash", "n")
    rare = rows.filter("hash is not null").select("row", "hash", "m").join(others, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    added = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * F.log10((F.col("n") + 1) / F.lit(float(floor)))).alias("base_more")
    )
    out = rows.filter("hash is null").drop("hash", "m").join(added, "row", "left")
    total = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    of_model = ["score", (-F.col("score") / F.lit(LOG10_2) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte")] if with_model else []
    return out.select(
        "doc_id", "held_out", "n_tokens", total("n_known", "more").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), total("base", "base_more").alias("base_score"), *of_model
    )
