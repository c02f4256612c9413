"""Near-duplicate documents by HyperMinHash sketches, banding and confirmation on full sets.

1. One pass gives each text its set of word shingles, a fingerprint of the set and a HyperMinHash
   sketch: hashes fall into buckets, and each bucket keeps the leading-zero count and the first
   mantissa bits of its smallest hash. Empty buckets copy the first filled one of a fixed
   permutation, so small sets have full sketches too.
2. Texts with equal sets are one class; from here on only classes are compared.
3. Bands of registers put classes into buckets. Every bucket names a pivot; members whose Jaccard
   estimate with it, corrected for register collisions, comes near the threshold form a cluster with it.
   In buckets that hold several clusters still, all pairs across clusters are estimated in blocks of bounded size.
4. Full sets meet once in their cluster and are compared there, most similar first; pairs that are
   connected already need no comparison, as they cannot change a component. Clusters of more than
   ``BLOCK`` classes are compared within blocks, then, where they are not one component, between blocks. Tasks emit
   links that join components, fewer than their rows, never pairs of a group.
5. Components come from alternating large-star and small-star steps.

A link at the threshold is missed only if it shares none of the bands: (1 - 0.75^4)^32, 5 in a million,
and then only matters if no other link joins the two components.

Cases: ids may be of any type that can be ordered; null, empty and white-space texts have the empty set and stay alone; fewer words than a
shingle make one shingle of all; repeated rows of one id are one document; a row without an id is
linked with nothing (null component, not kept); no rows give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chain, materialise, mix64, steps, utf8_parts

#: Buckets of a sketch (a power of two), mantissa bits of a register, registers of a band.
BUCKETS, MANTISSA, BAND = 128, 10, 4
#: Constant of the published estimate of chance collisions between two HyperMinHash registers.
COLLISION = 0.169919487159739
#: Rows, and shingles in all, of a block whose members are compared with each other.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000

_EMPTY = np.uint16(0xFFFF)
_PREFERENCE = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1).astype(np.int64)
_BOUNDS = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for a text without words."""
    for a, b in steps(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
        at, hashes = words.windows(size)
        where = np.searchsorted(words.row[at], np.arange(b - a + 1)) if len(at) else np.zeros(b - a + 1, np.int64)
        for i in range(b - a):
            first, last = words.of_row[i], words.of_row[i + 1]
            if last - first >= size:
                yield np.unique(hashes[where[i] : where[i + 1]])
            elif last > first:
                yield chain(words.hash, np.array([first]), last - first)
            else:
                yield np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes."""
    at = np.append(np.searchsorted(hashes, _BOUNDS), len(hashes))
    filled = np.flatnonzero(at[1:] > at[:-1])
    value = (hashes[at[filled]] << np.uint64(BUCKETS.bit_length() - 1)) >> np.uint64(12)  # 52 bits
    bits = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    mantissa = np.where(bits > MANTISSA, value >> np.maximum(bits - MANTISSA - 1, 0).astype(np.uint64), value << np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64))
    registers = np.full(BUCKETS, _EMPTY)
    registers[filled] = ((52 - bits) << MANTISSA).astype(np.uint16) | (mantissa.astype(np.uint16) & np.uint16((1 << MANTISSA) - 1))
    if 0 < len(filled) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), filled)
        registers[empty] = registers[filled[np.argmin(_PREFERENCE[np.ix_(empty, filled)], axis=1)]]
    return registers


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (last axis), less the collisions expected by chance."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = COLLISION * BUCKETS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).sum(axis=-1) - chance) / BUCKETS


def _sketches(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            counts, one, two, registers = [], [], [], []
            for s in shingle_sets(data, offsets, size):
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                counts.append(len(s))
                one.append(int(digest[0]))
                two.append(int(digest[1]))
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "registers"])

    return run


def _bands(batches: Iterator) -> Iterator:
    """(key, node) for each band of a sketch."""
    import pyarrow as pa

    n_bands = BUCKETS // BAND
    salt = mix64(np.arange(1, n_bands + 1, dtype=np.uint64))
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, n_bands)
        keys = mix64(mix64(registers) ^ salt).view(np.int64)
        nodes = np.repeat(np.asarray(batch.column(0)), n_bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, BUCKETS)


@F.pandas_udf(T.DoubleType())
def _estimated(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(estimate(_matrix(a), _matrix(b), n.to_numpy(), m.to_numpy()))


class Union:
    """Smallest member of each set of joined rows, for one block."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_links(rows: pd.DataFrame, least: float, threshold: float | None) -> pd.DataFrame:
    """Links (a, b) that join components among the rows of one block pair, at most one less than rows.

    Pairs are those of side ``i`` with side ``j`` (all pairs where they are the same) in different
    components; their estimate must reach ``least`` and, given a ``threshold``, their full sets confirm it.
    """
    registers, n, comp, node = _matrix(rows["registers"]), rows["n_shingles"].to_numpy(), rows["comp"].to_numpy(), rows["node"].to_numpy()
    own = rows["i"].iloc[0] == rows["j"].iloc[0]
    blk = rows["blk"].to_numpy()
    left = np.arange(len(rows)) if own else np.flatnonzero(blk == rows["i"].iloc[0])
    right = left if own else np.flatnonzero(blk == rows["j"].iloc[0])
    union, found = Union(len(rows)), []
    for group in pd.Series(np.arange(len(rows))).groupby(comp).indices.values():
        for k in group[1:]:
            union.join(group[0], k)
    sets = None if threshold is None else [np.frombuffer(x, np.uint64) for x in rows["set"]]
    labels = np.array([union.root(k) for k in range(len(rows))])
    for x in left:
        y = right[right > x] if own else right
        y = y[labels[y] != labels[x]]
        if threshold is not None:
            y = y[100 * np.minimum(n[y], n[x]) >= 100 * threshold * np.maximum(n[y], n[x])]
        e = estimate(registers[y], registers[x], n[y], n[x])
        y = y[e >= least][np.argsort(-e[e >= least], kind="stable")]
        for k in y:
            if labels[k] == labels[x]:
                continue
            if sets is not None:
                both = np.count_nonzero(np.isin(sets[k], sets[x], assume_unique=True)) if len(sets[k]) < 64 else len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                if not 100 * both >= 100 * threshold * (n[x] + n[k] - both):
                    continue
            union.join(x, k)
            low, high = sorted((labels[x], labels[k]))
            labels[labels == high] = low
            found.append((min(node[x], node[k]), max(node[x], node[k])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _blocks(keys: list[str], least: float, threshold: float | None):
    """Runs :func:`block_links` on each run of rows with equal ``keys``; rows arrive sorted by them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            edges = np.append(np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()), len(frame))
            for s, e in zip(edges[:-2], edges[1:-1], strict=True):
                if e - s > 1:
                    yield block_links(frame.iloc[s:e], least, threshold)
            kept = frame.iloc[edges[-2] :]
        if kept is not None and len(kept) > 1:
            yield block_links(kept, least, threshold)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of the edges: the smallest node it is connected with."""

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    before, now = None, state(e)
    while now[0] and now != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = materialise(small, "edges")
        before, now = now, state(e)
    roots = e.groupBy("u").agg(F.min("v").alias("comp"))
    return roots.select(F.col("u").alias("node"), "comp").union(roots.select(F.col("comp").alias("node"), "comp").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.75, margin: float = 0.2, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row, see the module's text.

    ``margin`` below the threshold is where estimates end the search: 5 standard deviations of a
    sketch. Cluster numbers of candidates are broadcast while there are ``broadcast_rows`` at most.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return _by_number(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), size=size, threshold=threshold, margin=margin, broadcast_rows=broadcast_rows)
    least = threshold - margin
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(texts.mapInArrow(_sketches(size), "doc_id long, n_shingles long, fp1 long, fp2 long, registers binary"), "sketches")
    held = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialise(held.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.min_by("registers", "doc_id").alias("registers"), F.max("n_shingles").alias("n_shingles")), "classes")
    facts = classes.select("node", "registers", "n_shingles")

    # bands: buckets with more than one class, and each member with the bucket's pivot
    keyed = classes.select("node", "registers").mapInArrow(_bands, "key long, node long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("_p")).filter("members > 1")
    pivots = shared.select("key", "members", F.col("_p").bitwiseXOR(F.col("key")).alias("pivot"))
    members = materialise(keyed.join(pivots, "key"), "members")
    side = lambda x: facts.select(F.col("node").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    star = members.filter("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    likely = star.join(side("a"), "a").join(side("b"), "b").filter(_estimated("r_a", "r_b", "n_a", "n_b") >= least).select("a", "b")
    clusters = materialise(components(materialise(likely, "likely")), "clusters")

    # buckets that are not one cluster yet: all their pairs across clusters, by registers
    apart = members.filter("members > 2").join(clusters, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = apart.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).filter("low != high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    apart = _paired(apart.join(mixed, "key")).join(facts, "node").select("key", "i", "j", "blk", "node", "comp", "registers", "n_shingles")
    more = apart.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_blocks(["key", "i", "j"], least, None), "a long, b long")
    more = materialise(more, "likely")
    if not more.isEmpty():
        over = components(_across(more, clusters), "c_a", "c_b")
        clusters = materialise(_relabelled(clusters, over), "clusters")

    # full sets meet once in their cluster, or in the block pairs of a large one
    sized = clusters.join(classes.select("node", "n_shingles"), "node").withColumnRenamed("comp", "cluster")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sized = sized.join(sized.groupBy("cluster").agg(blocks.alias("blocks")), "cluster")
    sized = materialise(sized.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(F.col("node").alias("doc_id"), "cluster", "blocks", "blk"), "sized")
    count, largest = sized.agg(F.count("*"), F.max("blocks")).first()

    def with_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            sets = list(shingle_sets(data, offsets, size))
            filled = [i for i, s in enumerate(sets) if len(s)]
            columns = [batch.column(k).take(pa.array(filled, pa.int64())) for k in (0, 2, 3, 4, 5, 6)]
            own = [pa.array([sketch(sets[i]).tobytes() for i in filled], pa.binary()), pa.array([len(sets[i]) for i in filled], pa.int64()), pa.array([sets[i].tobytes() for i in filled], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + own, ["node", "cluster", "i", "j", "blk", "comp", "registers", "n_shingles", "set"])

    def confirmed(wanted: DataFrame, n: int) -> DataFrame:
        """Links among ``wanted``: (doc_id, cluster, i, j, blk, comp)."""
        wanted = F.broadcast(wanted) if n <= broadcast_rows else wanted
        sets = texts.join(wanted, "doc_id").select("doc_id", "text", "cluster", "i", "j", "blk", "comp")
        sets = sets.mapInArrow(with_sets, "node long, cluster long, i int, j int, blk int, comp long, registers binary, n_shingles long, set binary")
        key = ["cluster", "i", "j"]
        return materialise(sets.repartition(*key).sortWithinPartitions(*key).mapInPandas(_blocks(key, least, threshold), "a long, b long"), "links")

    inner = sized.select("doc_id", "cluster", F.col("blk").alias("i"), F.col("blk").alias("j"), "blk", F.col("doc_id").alias("comp"))
    comp = materialise(components(confirmed(inner, count)), "components")
    if largest and largest > 1:
        known = sized.filter("blocks > 1").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        open_ = known.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("cluster")
        crossed = materialise(_paired(known.join(open_, "cluster")).filter("i != j").select("doc_id", "cluster", "i", "j", "blk", "comp"), "crossed")
        links = confirmed(crossed, crossed.count())
        if not links.isEmpty():
            comp = materialise(_relabelled(comp, components(_across(links, comp), "c_a", "c_b")), "components")

    root = classes.select("fp1", "fp2", "node").join(comp, "node", "left").select("fp1", "fp2", F.coalesce("comp", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp1")).alias("fp1"), "fp2").join(root, ["fp1", "fp2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def _by_number(docs: DataFrame, **settings) -> DataFrame:
    """:func:`near_duplicates` for ids of other types: each id has a number meanwhile, and a group is named by its smallest id."""
    named = materialise(docs.filter("doc_id is not null").select("doc_id").distinct().withColumn("_number", F.monotonically_increasing_id()), "names")
    numbered = docs.join(named, "doc_id", "left").select(F.col("_number").alias("doc_id"), "text")
    found = materialise(near_duplicates(numbered, **settings), "found")
    group = lambda name: found.select(F.col("doc_id").alias("_number"), "component_id").distinct().join(named, "_number").groupBy("component_id").agg(F.min("doc_id").alias(name))
    out = found.withColumnRenamed("doc_id", "_number").join(named, "_number", "left").join(group("_name"), "component_id", "left")
    return out.select("doc_id", "n_shingles", F.col("_name").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("_name"), F.lit(False)).alias("kept"))


def _paired(rows: DataFrame) -> DataFrame:
    """Each row once for every block pair (i <= j) that its block ``blk`` of ``blocks`` belongs to."""
    if "blk" not in rows.columns:
        rows = rows.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("blk", "_other")).withColumn("j", F.greatest("blk", "_other")).drop("_other")


def _across(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links as pairs of the components of their ends."""
    c = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
    out = links.join(c("a"), "a", "left").join(c("b"), "b", "left")
    return out.select(F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))


def _relabelled(comp: DataFrame, over: DataFrame) -> DataFrame:
    """Components of nodes after the components themselves were joined by ``over`` (node, comp)."""
    to = over.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    old = comp.join(to, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    return old.unionByName(over.join(comp.select("node"), "node", "left_anti").select("node", "comp"))
