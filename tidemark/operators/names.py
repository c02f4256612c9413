"""Company names to tickers by ordered rules; an ambiguous name is refused, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalised, ticker, without_country

LEAST_PREFIX = 4


def _index(known: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): the least and greatest ticker under each key, equal where there is one. Aggregated before it moves, so no key is hot."""
    return known.groupBy(F.col(key).alias("_key")).agg(F.min("ticker").alias("lo"), F.max("ticker").alias("hi"))


def prefixes(name: str) -> Column:
    """All beginnings of at least ``LEAST_PREFIX`` letters, the whole name too."""
    n = F.length(name)
    return F.when(n >= LEAST_PREFIX, F.transform(F.sequence(F.lit(LEAST_PREFIX), n), lambda k: F.substring(F.col(name), F.lit(1), k)))


def reconcile(names: DataFrame, reference: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``ticker`` and ``rule`` to (name); returns the matched names and the rest.

    Rules in order: the alias table (alias, ticker), the name is itself a ticker, the full normalised name, the name
    without country, a prefix of at least four letters in either direction. The first rule with any candidate decides, and
    only if there is one. Every rule is an equi-join with an index that holds one row a key: prefixes are exploded on either side in turn, so
    companies that begin alike share a row of the index and not a task.
    """
    asked = names.select("name").distinct().withColumns({"_n": normalised(F.col("name")), "_s": without_country(F.col("name")), "_t": ticker(F.col("name"))})
    known = reference.select("ticker", normalised(F.col("name")).alias("_kn"), without_country(F.col("name")).alias("_ks")).filter("_kn is not null and _kn <> ''")
    listed = aliases.select(normalised(F.col("alias")).alias("_kn"), "ticker").join(reference.select("ticker"), "ticker", "left_semi")
    begun = _index(known.select("ticker", F.explode(prefixes("_ks")).alias("_p")), "_p")
    at = lambda key, index, rows=asked: rows.join(index, F.col(key) == F.col("_key")).select("name", "lo", "hi")
    rules = [
        at("_n", _index(listed, "_kn")),
        at("_t", _index(reference.select("ticker", F.col("ticker").alias("_kt")), "_kt")),
        at("_n", _index(known, "_kn")),
        at("_s", _index(known, "_ks")),
        at("_s", begun, asked.filter(F.length("_s") >= LEAST_PREFIX)).unionByName(at("_p", _index(known, "_ks"), asked.select("name", F.explode(prefixes("_s")).alias("_p")))),
    ]
    found = None
    for i, rule in enumerate(rules, 1):
        one = rule.withColumn("rule", F.lit(i))
        found = one if found is None else found.unionByName(one)
    each = found.groupBy("name", "rule").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = each.groupBy("name").agg(F.min(F.struct("rule", "lo", "hi")).alias("p"))
    matched = first.filter("p.lo = p.hi").select("name", F.col("p.lo").alias("ticker"), "p.rule")
    return matched, names.select("name").distinct().join(matched, "name", "left_anti")


def collect_dividends(sources: list[DataFrame], reference: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calendars (name or ticker, ex_date, amount) in priority order as one table of known companies.

    Of equal (ticker, ex_date) the first source stays; the second result lists the names that match no company.
    """
    from tidemark.operators.dedupe import union_by_priority

    named = [s.withColumn("name", F.coalesce("ticker", "name") if "ticker" in s.columns else F.col("name")).drop("ticker") for s in sources]
    every = named[0].select("name")
    for s in named[1:]:
        every = every.union(s.select("name"))
    matched, rest = reconcile(every, reference, aliases)
    pairs = matched.select("name", "ticker")
    return union_by_priority([s.join(pairs, "name").drop("name") for s in named], ("ticker", "ex_date")), rest
