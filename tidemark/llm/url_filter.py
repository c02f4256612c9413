"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The list holds entries of a host and a path: *rules* with a verdict of their own and *listed* URLs, which
are blocked where no rule fits. An entry fits its host and all subdomains of it, if the path starts with
the entry's. Each URL asks for every suffix of its host joined with those prefixes of its path that are as
long as some entry's path; the Bloom filter drops nearly all of these questions, and an equi-join with the
list removes what it passed in error. Of the rules that fit, the one with the longest host and path decides
(ties: the longer host); a page without rule is blocked if a listed URL fits and else has ``default``.

The filter has blocks of eight 64-bit words (a cache line); a key sets one bit in each word of one block.
It takes 16 bits an entry and at most ``MAX_BLOCKS`` blocks (8 MB): beyond that it passes more in error, and
the join stays exact. The list is broadcast up to ``BROADCAST_ENTRIES`` entries and joined on salted keys
beyond, as an entry such as a whole zone may fit a third of all pages.

Cases: a null URL, or one without ``://``, has an empty host and path and fits nothing; an empty path counts as
``/`` for listed URLs only; a host of any depth and a URL of any length are read whole; repeated pages each
get a row; repeated entries count once, and of two verdicts for one rule ``block`` holds; an empty list gives
``default`` everywhere; no pages give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_WORDS = 8
MAX_BLOCKS = 1 << 17
BROADCAST_ENTRIES = 100_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def entries(spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[str] = ()) -> DataFrame:
    """The list from small literal lists: rules as (host, path, verdict) and listed URLs as ``host/path``."""
    rows = [("rule", *r) for r in rules] + [("listed", u.split("/", 1)[0], "/" + u.partition("/")[2], "block") for u in listed]
    names, none = ("kind", "host", "path", "verdict"), [F.lit(None).cast("string")] * 4
    structs = [F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    empty = F.struct(*[v.alias(n) for n, v in zip(names, none, strict=True)])
    return spark.range(1).select(F.inline(F.array(*structs, empty))).filter("kind IS NOT NULL")


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(BLOCK_WORDS)]


def bloom_filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with the words of the filter over the column ``key``, and the number of its blocks."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * BLOCK_WORDS * 64 < 16 * count:
        blocks *= 2
    held = keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(*[F.bit_or(b).alias(f"w{w}") for w, b in enumerate(_bits(F.col("key")))])
    every = keys.sparkSession.range(blocks).withColumnRenamed("id", "block").join(held, "block", "left")
    words = F.array(*[F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")) for w in range(BLOCK_WORDS)])
    rows = every.agg(F.sort_array(F.collect_list(F.struct("block", words.alias("words")))).alias("rows"))
    return rows.select(F.flatten(F.transform("rows", lambda r: r["words"])).alias("words")), blocks


def may_hold(words: Column, blocks: int, key: Column) -> Column:
    """Whether the filter passes a key; false only for keys that are not in it."""
    first = F.pmod(F.xxhash64(key), F.lit(blocks)) * BLOCK_WORDS
    out = F.lit(True)
    for w, bit in enumerate(_bits(key)):
        out = out & (F.get(words, (first + w).cast("int")).bitwiseAND(bit) == bit)
    return out


def _questions(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """One row for each (page, host suffix, path prefix, kind)."""
    labels = F.split("host", "\\.")
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    kinds = F.array(F.struct(F.lit("rule").alias("kind"), F.col("path").alias("path")), F.struct(F.lit("listed").alias("kind"), F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")).alias("path")))
    asked = pages.select("_row", "page_id", "host", "path", F.explode(suffixes).alias("_suffix"), kinds.alias("_kinds"))
    asked = asked.select("_row", "page_id", "host", "path", "_suffix", F.explode("_kinds").alias("_kind"))
    asked = asked.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.col("_length") <= F.length("_kind.path"))
    return asked.select("_row", "page_id", "host", "path", F.concat("_kind.kind", F.lit(" "), "_suffix", F.substr("_kind.path", F.lit(1), F.col("_length"))).alias("key"))


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and whether a listed URL fits.

    ``listed`` has the columns kind (``rule`` or ``listed``), host, path (must start with ``/``) and verdict.
    """
    own_host, own_path = F.translate(F.trim("host"), UPPER, LOWER), F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.coalesce("path", F.lit(""))))
    named = listed.filter(F.coalesce(F.trim("host"), F.lit("")) != "").select("kind", own_host.alias("_host"), own_path.alias("_path"), "verdict")
    named = named.groupBy("kind", "_host", "_path").agg(F.max("verdict").alias("_verdict")).withColumn("key", F.concat("kind", F.lit(" "), "_host", "_path"))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    # distinct lengths of paths: a few numbers, at most as many as the longest path has characters
    shape = named.agg(F.count("*").alias("n"), F.collect_set(F.length("_path")).alias("lengths")).first()
    if not shape.n:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(False).alias("is_listed"))
    words, blocks = bloom_filter(named.select("key"), shape.n)
    possible = _questions(rows, sorted(shape.lengths)).filter(may_hold(words.scalar(), blocks, F.col("key")))
    # a row of its own keeps each page; its key is no entry's, as those begin with their kind
    possible = possible.unionByName(rows.select("_row", "page_id", "host", "path", F.concat(F.lit("page "), F.col("_row").cast("string")).alias("key")))
    if shape.n <= broadcast_entries:
        found = possible.join(F.broadcast(named), "key", "left")
    else:
        salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = possible.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "_salt"], "left")
    rule = F.when(F.col("kind") == "rule", F.struct((F.length("_host") + F.length("_path")).alias("length"), F.length("_host").alias("hosts"), F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict")))
    judged = found.groupBy("_row").agg(*[F.any_value(c).alias(c) for c in ("page_id", "host", "path")], F.max(rule).alias("_rule"), F.coalesce(F.bool_or(F.col("kind") == "listed"), F.lit(False)).alias("is_listed"))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit(default)))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "is_listed")
