"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Per text: word and symbol counts, repeated lines and repeated three-word windows. Two plain rules
fail a text outright (``base_failed``). For the rest, every (language, source) group gets a
minimum-covariance-determinant estimate of location and scatter of four transformed statistics:
two deterministic starts (scaled distance and largest scaled deviation from the median), C-steps
that keep the ``core`` share of rows with the smallest Mahalanobis distance, and the start with the
smaller determinant. A text is rejected when its distance, scaled down where the group's median exceeds
that of a chi-square variable, exceeds ``cutoff``.

Groups with fewer than ``min_rows`` texts are pooled by language, then altogether; the last pool is
judged from ten texts on, and those of a smaller one get no verdict and stay. Group parameters are broadcast while there are at
most ``broadcast_groups`` of them and joined on a salted key beyond that. Quartiles, core bounds and
medians are read from counts by bin (``WIDTH`` for statistics, ``LOG_WIDTH`` for the logarithm of a distance):
equal for every order and partition of the rows, and no task holds the values of a group.

Cases: null text counts as empty (0 words, fails the length rule); null language or source form
groups of their own; no rows give an empty result; repeated rows each get their row; other columns
are ignored. Statistics with no spread are held apart by ``FLOORS``: where nobody repeats, one short
repeated line stays inside the cutoff, and a third of repeated words passes it without other oddities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Least standard deviation of each transformed statistic.
FLOORS = (0.35, 0.06, 0.02, 0.048)
DIMS = tuple(f"x{i}" for i in range(len(FLOORS)))
#: Median of a chi-square variable with four degrees of freedom.
CHI2_MEDIAN = 3.3567
SALTS = 16
#: Bin widths of a statistic, a twentieth of the least deviation, and of ln(1 + distance).
WIDTH, LOG_WIDTH = 0.001, 0.001


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of the rules for each row, without shuffles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = text
    for space in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    out = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"), F.filter(F.split(spaced, " "), lambda w: w != "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n = F.size("_words")
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))))
    out = out.select(
        "doc_id", *keep, n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), windows.alias("_windows"),
    )
    same = lambda p, other: F.coalesce(p["h"] == other["h"], F.lit(False))
    again = F.filter("_windows", lambda p, j: same(p, F.get("_windows", j - 1)) | same(p, F.get("_windows", j + 1)))
    out = out.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda p: p["i"])).alias("_again"),
    )
    covered = F.aggregate(F.transform("_again", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_again", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _attach(rows: DataFrame, params: DataFrame, key: list[str], groups: int, limit: int) -> DataFrame:
    if groups <= limit:
        return rows.join(F.broadcast(params), key, "left")
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*key, "_salt"], "left").drop("_salt")


def _quantiles(rows: DataFrame, key: list[str], x: Column, width: float, shares: dict[str, float]) -> DataFrame:
    """For each group and name in ``shares`` the number of the first bin of ``x`` that reaches the share of its rows.

    Counts by bin are aggregated before they move; a group's bins are as many as its values spread, not its rows.
    """
    counted = rows.groupBy(*key, F.floor(x / width).alias("_bin")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*key)
    placed = counted.select(*key, "_bin", F.sum("_n").over(own.orderBy("_bin")).alias("_at"), F.sum("_n").over(own).alias("_all"))
    return placed.groupBy(*key).agg(*[F.min(F.when(F.col("_at") >= share * F.col("_all"), F.col("_bin"))).alias(name) for name, share in shares.items()])


def _scatter(subset: DataFrame, key: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group, and its log determinant."""
    p = len(DIMS)
    moments = [F.avg(F.col(a) * F.col(b)).alias(f"s{i}{j}") for i, a in enumerate(DIMS) for j, b in enumerate(DIMS[: i + 1])]
    out = subset.groupBy(*key).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(DIMS)], *moments)
    for i in range(p):
        for j in range(i + 1):
            cov = F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            least = F.lit(FLOORS[i] ** 2)
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(0.0)) + least) if i == j else cov / F.col(f"l{j}{j}"))
    logdet = 2 * sum((F.ln(f"l{i}{i}") for i in range(p)), F.lit(0.0))
    return out.select(*key, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def _distance() -> Column:
    z: list[Column] = []
    for i, x in enumerate(DIMS):
        z.append((F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def quality_rules(docs: DataFrame, core: float = 0.75, c_steps: int = 3, cutoff: float = 40.0, min_rows: int = 60, broadcast_groups: int = 20_000) -> DataFrame:
    """One row per text: the counts, ``base_failed``, ``kept`` and the scaled ``distance``."""
    counts = text_counts(docs, keep=("lang", "source"))
    n = F.col("n_words")
    rows = counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lang", "source",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.ln(1.0 + n).alias("x0"), F.ln((1.0 + F.col("word_chars")) / (1.0 + n)).alias("x1"),
        F.sqrt(F.col("n_symbols") / (1.0 + F.col("word_chars"))).alias("x2"), (F.col("n_repeat_words") / (1.0 + n)).alias("x3"),
    )
    rows = materialise(rows, "statistics")

    # groups: (lang, source), else the small sources of a language, else all small languages
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    sized = rows.filter(~F.col("base_failed")).groupBy(lang.alias("_lang"), source.alias("_source")).agg(F.count("*").alias("_n"))
    pooled = sized.filter(F.col("_n") < min_rows).groupBy("_lang").agg(F.sum("_n").alias("_pool"))
    named = sized.join(pooled, "_lang", "left").select(
        "_lang", "_source",
        F.when(F.col("_n") >= min_rows, F.to_json(F.array("_lang", "_source"))).when(F.col("_pool") >= min_rows, F.to_json(F.array("_lang"))).otherwise(F.lit("[]")).alias("g"),
    )
    named = materialise(named, "groups")
    groups = named.count()
    rows = _attach(rows.withColumn("_lang", lang).withColumn("_source", source), named, ["_lang", "_source"], groups, broadcast_groups).drop("_lang", "_source")
    judged = rows.filter(~F.col("base_failed")).select("doc_id", "g", *DIMS)

    # deterministic starts: distances from the median in units of the spread between quartiles
    values = judged.select("g", F.posexplode(F.array(*DIMS)).alias("dim", "_x"))
    bins = _quantiles(values, ["g", "dim"], F.col("_x"), WIDTH, {"low": 0.25, "mid": 0.5, "high": 0.75})
    quart = [F.max(F.when(F.col("dim") == i, F.struct(*[((F.col(q) + 0.5) * WIDTH).alias(q) for q in ("low", "mid", "high")]))).alias(f"q_{x}") for i, x in enumerate(DIMS)]
    spread = materialise(bins.groupBy("g").agg(*quart), "quartiles")
    z = lambda x, i: F.abs(F.col(x) - F.col(f"q_{x}.mid")) / (F.lit(FLOORS[i]) + (F.col(f"q_{x}.high") - F.col(f"q_{x}.low")) / 1.349)
    started = _attach(judged, spread, ["g"], groups, broadcast_groups)
    scaled = [z(x, i) for i, x in enumerate(DIMS)]
    starts = F.array(sum((v * v for v in scaled), F.lit(0.0)), F.greatest(*scaled))
    both = started.select("doc_id", "g", *DIMS, F.posexplode(starts).alias("start", "d2"))
    key = ["g", "start"]
    for _ in range(c_steps):
        bound = _quantiles(both, key, F.log1p("d2"), LOG_WIDTH, {"bound": core})
        inner = _attach(both, bound, key, groups, broadcast_groups).filter(F.floor(F.log1p("d2") / LOG_WIDTH) <= F.col("bound"))
        params = materialise(_scatter(inner, key), "scatter")
        two = judged.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
        both = _attach(two, params, key, groups, broadcast_groups).select("doc_id", *key, *DIMS, _distance().alias("d2"))
    best = params.groupBy("g").agg(F.min_by(F.struct(*[c for c in params.columns if c != "g"]), F.struct("logdet", "start")).alias("p")).select("g", "p.*").drop("start", "logdet")
    judged = _attach(judged, best, ["g"], groups, broadcast_groups).select("g", _distance().alias("d2"))
    typical = _quantiles(judged, ["g"], F.log1p("d2"), LOG_WIDTH, {"_mid": 0.5}).select("g", F.expm1((F.col("_mid") + 0.5) * LOG_WIDTH).alias("typical"))
    best = materialise(best.join(typical, "g").join(judged.groupBy("g").agg(F.count("*").alias("members")), "g"), "estimates")
    scale = F.greatest(F.col("typical") / CHI2_MEDIAN, F.lit(1.0))
    out = _attach(rows, best, ["g"], groups, broadcast_groups)
    distance = F.when(~F.col("base_failed"), _distance() / scale)
    bad = F.coalesce((F.col("members") >= 2 * len(DIMS) + 2) & (F.col("distance") > cutoff), F.lit(False))
    return out.withColumn("distance", distance).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "distance"
    )
