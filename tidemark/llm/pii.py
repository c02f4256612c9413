"""Personal data by patterns and a skip-chain conditional random field.

Four strict patterns give the base spans. Beside them lie loose mentions: numbers of seven digits or more that
no strict span covers (in other notations, or run together with a neighbour, so that the strict pattern
failed), and addresses spelled with "at" and "dot". A number is cut at spaces where its groups would exceed
15 digits together, or beside a group of 12 or more. All mentions of a document are nodes with the
labels none, email, ip, card and phone. Node potentials depend on the shape of a mention (digits, signs,
checksum), chain edges join neighbours, and skip edges join a mention with the next one of the same or similar
content (equal address, equal digits, equal last nine digits), however far away, and with the nearest base
span of such content. Base spans are evidence; damped loopy message passing over the other nodes, until
the messages rest or ``rounds`` are over, gives beliefs, and a loose mention with a label other than none
becomes a span when its belief reaches ``least_belief``. A text needs no base span for that.

The potentials are trained on the whole corpus by pseudo-likelihood: each node is predicted from its shape and its
neighbours' labels. The patterns label their own spans; other mentions count as none unless their content is that
of a base span (these are left out). Masked spans teach what the patterns cannot see: each base span is taken once
more in the notations of ``masks``, where its strict look is hidden, and its label must come from its neighbours and
its like (the one before it, or itself where there is none); without a like the same look counts as none, but
for cards, whose checksum holds in any notation. A prior that equal mentions agree (``agreement``) serves tables of a few spans.
``least_belief`` is the threshold of best F1 on the masked cases. Equal cases are counted in the tasks, so what
reaches the driver is a table of bounded size.

Cases: null and empty texts have no spans; spans of the method never overlap base spans or each other; equal
mentions are linked in a row and each with one base span, so many repetitions stay linear; repeated rows
each get their row; no rows give an empty result and prior potentials; other columns are ignored. Positions
are code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # label 0: none
SHAPES = 42
CARD = 3
ABSENT = LABELS  # no such neighbour
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER_RUN = re.compile(r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9])*(?![A-Za-z0-9])")
_GROUP = re.compile(r"[^\x20]+")
_AT = re.compile(r"\x20?[\[(]?(?:@|\bat\b)[\])]?\x20?", re.IGNORECASE)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]?\bdot\b[\])]?\x20?)[A-Za-z0-9-]{1,64}){1,4}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(d if (d := 2 * int(c)) < 10 else d - 9 for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _content(text: str, kind: int) -> str:
    if kind == 0:
        return re.sub(r"[\x20\[\]()]", "", re.sub(r"\bdot\b", ".", re.sub(r"\bat\b", "@", text, flags=re.IGNORECASE), flags=re.IGNORECASE)).lower()
    return re.sub(r"[^0-9]", "", text)


def loose_mentions(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind of content: 0 an address, 1 a number) of what may be personal data in another notation."""
    for run in _NUMBER_RUN.finditer(text) if _DIGIT.search(text) else ():
        if run.end() - run.start() < 7:
            continue
        held: list[tuple[int, int]] = []
        for g in _GROUP.finditer(run[0]):
            n = sum(c.isdigit() for c in g[0])
            digits = sum(d for _, d in held)
            if held and (n >= 12 or held[-1][1] >= 12 or digits + n > 15):
                yield from _number(text, run.start() + held[0][0], run.start() + end, digits)
                held = []
            held.append((g.start(), n))
            end = g.end()
        yield from _number(text, run.start() + held[0][0], run.start() + end, sum(d for _, d in held))
    if "@" in text or "dot" in text or "DOT" in text or "Dot" in text:
        for at in _AT.finditer(text):
            start = at.start()
            while start and text[start - 1] in _LOCAL and at.start() - start < 64:
                start -= 1
            domain = _SPELLED_DOMAIN.match(text, at.end()) if start < at.start() else None
            if domain:
                yield start, domain.end(), 0


def _number(text: str, start: int, end: int, digits: int) -> Iterator[tuple[int, int, int]]:
    while end > start and not text[end - 1].isdigit():
        end -= 1
    if digits >= 7:
        yield start, end, 1


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int]]:
    """(start, end, label or -1 for loose, content, shape) in text order."""
    out = [(s, e, k + 1, _content(text[s:e], k)) for k, s, e in base]
    covered: list[list[int]] = []  # base spans as disjoint ranges
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    starts, free = [s for s, _ in covered], 0
    for s, e, numeric in sorted(loose_mentions(text)):
        i = bisect_right(starts, e - 1)  # ranges that begin before the mention ends
        if s >= free and (not i or covered[i - 1][1] <= s):
            out.append((s, e, -1, _content(text[s:e], numeric)))
            free = e
    out.sort()
    return [(s, e, label, content, shape(text[s:e], content)) for s, e, label, content in out]


def shape(text: str, content: str) -> int:
    """A bin of the look of a mention: how it writes an address; or number of digits, checksum and signs."""
    if not content.isdigit():
        return int("@" not in text)
    n = len(content)
    length = (0 if n < 7 else 1 if n < 8 else 2 if n < 10 else 3 if n < 12 else 4 if n < 16 else 7) if n < 16 or n > 19 else 5 + luhn(content)
    parts = text.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        signs = 0 if all(int(p[-9:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts) else 1
    else:
        signs = 2 if "+" in text else 3 if text.isdigit() else 4
    return 2 + 5 * length + signs


def skip_edges(nodes: list[tuple]) -> list[tuple[int, int]]:
    """Each mention with the next of equal content, and of equal last nine digits; loose ones also with the nearest strict one."""
    edges = set()
    for own in alike(nodes):
        edges.update(zip(own, own[1:], strict=False))
        strict = [i for i in own if nodes[i][2] > 0]
        at = 0
        for i in own if strict else ():
            if nodes[i][2] < 0:
                while at + 1 < len(strict) and abs(strict[at + 1] - i) < abs(strict[at] - i):
                    at += 1
                edges.add((min(i, strict[at]), max(i, strict[at])))
    return sorted(edges)


def alike(nodes: list[tuple]) -> list[list[int]]:
    """Groups of two or more mentions with the same or similar content, in order."""
    members: dict[str, list[int]] = {}
    for i, (_, _, _, content, _) in enumerate(nodes):
        members.setdefault(content, []).append(i)
        if content.isdigit() and len(content) >= 9:
            members.setdefault("~" + content[-9:], []).append(i)
    return [own for own in members.values() if len(own) > 1]


def masks(text: str, label: int) -> list[str]:
    """A base span in notations that its pattern refuses."""
    if label == 1:
        name, domain = text.split("@")
        return [f"{name} at {domain.replace('.', ' dot ')}"]
    digits = _content(text, label - 1)
    if label == 2:
        return [text.replace(".", "-")] if len(digits) >= 7 else []
    if label == 3:
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return [digits, " ".join(digits[i : i + 2] for i in range(0, len(digits), 2)), text.lstrip("+")]


def case(shape: int, near: tuple[int, int, int, int], label: int, masked: bool) -> int:
    """A case as a number: the shape, labels left, right, of the alike before and after, own label, and whether the span was masked."""
    for x in near:
        shape = shape * (ABSENT + 1) + x
    return (shape * LABELS + label) * 2 + masked


def cases(text: str) -> Iterator[int]:
    """What each labelled mention of a text teaches, and each base span in other notations (:func:`case`)."""
    nodes = mentions(text, base_spans(text))
    labels, before, after = [max(n[2], 0) for n in nodes], [ABSENT] * len(nodes), [ABSENT] * len(nodes)
    groups = alike(nodes)
    for own in groups:
        if any(nodes[i][2] > 0 for i in own):
            for i in own:
                if nodes[i][2] < 0:
                    labels[i] = ABSENT  # may be what its like is: teaches nothing
    for own in groups:
        for i, j in zip(own, own[1:], strict=False):
            before[j], after[i] = labels[i], labels[j]
    for i, n in enumerate(nodes):
        if labels[i] != ABSENT:
            left = labels[i - 1] if i else ABSENT
            right = labels[i + 1] if i + 1 < len(nodes) else ABSENT
            yield case(n[4], (left, right, before[i], after[i]), labels[i], False)
            for other in masks(text[n[0] : n[1]], n[2]) if n[2] > 0 else ():
                look = shape(other, _content(other, n[2] - 1))
                like = labels[i] if before[i] == after[i] == ABSENT else before[i]
                yield case(look, (left, right, like, after[i]), labels[i], True)
                if n[2] != CARD:
                    yield case(look, (left, right, ABSENT, ABSENT), 0, True)


def threshold(belief: np.ndarray, own: np.ndarray, n: np.ndarray) -> float:
    """The least belief (0.5 to 0.95, by 0.05) of best F1 on weighted cases with known labels; the smallest of equals, 0.8 without any."""
    best, said, top = (-1.0, 0.8), belief.argmax(axis=1), belief.max(axis=1)
    for least in np.arange(10, 20) / 20 if n[own > 0].sum() else ():
        named = (said > 0) & (top >= least)
        right = n[named & (said == own)].sum()
        f1 = 2 * right / (n[named].sum() + n[own > 0].sum())
        if f1 > best[0] + 1e-12:
            best = (float(f1), float(least))
    return best[1]


class SkipChainField:
    """Potentials (node by shape and label, chain and skip by two labels) and inference in one document."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray, least_belief: float = 0.8, rounds: int = 200, tolerance: float = 1e-4):
        self.node, self.chain, self.skip = node, chain, skip
        self.least_belief, self.rounds, self.tolerance = least_belief, rounds, tolerance

    @classmethod
    def trained(cls, counted: dict[int, int], agreement: float = 4.0, least_belief: float | None = None, strength: float = 1.0, steps: int = 3000) -> SkipChainField:
        """Most likely potentials for the counted cases, under a normal prior of precision ``strength``.

        Each step divides the slope by a bound of the curvature, so the likelihood never falls. Without ``least_belief``
        the threshold is the one of best F1 on the masked cases, and 0.8 where there are none.
        """
        prior = np.zeros((SHAPES + 2 * (ABSENT + 1), LABELS))
        prior[SHAPES + ABSENT + 1 + np.arange(1, LABELS), np.arange(1, LABELS)] = agreement
        theta = prior.copy()
        code = np.array(list(counted), np.int64)
        n = np.array(list(counted.values()), float)
        masked, code = code % 2 == 1, code // 2
        own, parts = code % LABELS, code // LABELS
        near = []
        for _ in range(4):
            near.append(parts % (ABSENT + 1))
            parts = parts // (ABSENT + 1)
        rows = [parts] + [SHAPES + x for x in near[2:]] + [SHAPES + ABSENT + 1 + x for x in near[:2]]
        absent = np.zeros(len(theta), bool)
        absent[[SHAPES + ABSENT, SHAPES + 2 * ABSENT + 1]] = True
        weight = sum(np.bincount(r, n, len(theta)) for r in rows)
        pace = 1 / (0.5 * len(rows) * weight + strength)
        for _ in range(steps if len(n) else 0):
            logits = sum(theta[r] for r in rows)
            error = -np.exp(logits - np.logaddexp.reduce(logits, axis=1)[:, None])
            error[np.arange(len(n)), own] += 1
            error *= n[:, None]
            slope = strength * (prior - theta)
            for r in rows:
                np.add.at(slope, r, error)
            slope[absent] = 0
            theta += pace[:, None] * slope
            if np.abs(pace[:, None] * slope).max() < 1e-6:
                break
        both = lambda m: (m[:LABELS] + m[:LABELS].T) / 2  # noqa: E731  one potential for an edge, whichever end asks
        if least_belief is None:
            logits = sum(theta[r[masked]] for r in rows)
            belief = np.exp(logits - np.logaddexp.reduce(logits, axis=1)[:, None])
            least_belief = threshold(belief, own[masked], n[masked])
        return cls(theta[:SHAPES], both(theta[SHAPES:]), both(theta[SHAPES + ABSENT + 1 :]), least_belief)

    def added(self, nodes: list[tuple]) -> list[tuple[int, int, int]]:
        """(kind number, start, end) of loose mentions that take a label."""
        if not any(n[2] < 0 for n in nodes):
            return []
        belief = self.beliefs(nodes)
        best = belief.argmax(axis=1)
        return [(int(best[i]) - 1, n[0], n[1]) for i, n in enumerate(nodes) if n[2] < 0 and best[i] and belief[i, best[i]] >= self.least_belief]

    def beliefs(self, nodes: list[tuple]) -> np.ndarray:
        """Label probabilities of each mention by loopy message passing."""
        skips = skip_edges(nodes)
        unary = np.array([self.node[n[4]] if n[2] < 0 else np.where(np.arange(LABELS) == n[2], 0.0, -50.0) for n in nodes])
        edges = [(i, i + 1, self.chain) for i in range(len(nodes) - 1)] + [(i, j, self.skip) for i, j in skips]
        source = np.array([e[0] for e in edges] + [e[1] for e in edges], np.int64)
        target = np.array([e[1] for e in edges] + [e[0] for e in edges], np.int64)
        factor = np.array([e[2] for e in edges] + [e[2].T for e in edges]).reshape(-1, LABELS, LABELS)
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), LABELS))
        for _ in range(self.rounds if edges else 0):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + factor, axis=1)
            change = 0.5 * (new - new.max(axis=1, keepdims=True) - message)
            message += change
            if np.abs(change).max() < self.tolerance:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])

    def spans(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """(kind number, start, end, of a strict pattern), by kind and start."""
        if not text:
            return []
        base = base_spans(text)
        more = self.added(mentions(text, base))
        return sorted([(*s, True) for s in base] + [(*s, False) for s in more])


def fit(docs: DataFrame, text_col: str = "text", **settings) -> SkipChainField:
    """Counts the cases of all texts and trains the potentials; at most SHAPES * 6^4 * 5 * 2 kinds of cases."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = Counter(c for t in batch.column(0).to_pylist() if t for c in cases(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["code", "n"])

    counted = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code")
    return SkipChainField.trained({r["code"]: r["n"] for r in counted.collect()}, **settings)


def find(docs: DataFrame, model: SkipChainField, text_col: str = "text", into: str = "spans") -> DataFrame:
    """Adds the spans of every text: kind, start, end and whether a strict pattern found it."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in model.spans(t)] for t in texts])

    return docs.withColumn(into, run(F.coalesce(F.col(text_col), F.lit(""))))


def redact(docs: DataFrame, model: SkipChainField, text_col: str = "text") -> DataFrame:
    """Replaces every span by its kind in capitals and brackets; overlapping spans by the first's."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = sorted((s, -e, k) for k, s, e, _ in model.spans(t))
            parts, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, -e)
            out.append("".join(parts) + t[at:] if spans else t)
        return pd.Series(out)

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), run(F.coalesce(F.col(text_col), F.lit("")))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans as text, for every document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find(texts, fit(texts)).select("doc_id", "spans")
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
