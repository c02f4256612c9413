"""Panel, features, ranking and their guards, on hand-made series."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.panel import average_rank
from tidemark.operators import backtest, dividends, features, learn, merge, panel, quality, ranking, research, stats
from tidemark.settings import BacktestSettings, FeatureSettings, RankingSettings, SweepSettings

SMALL = FeatureSettings(momentum=5, skip=1, volatility=3, liquidity=3, short_mean=2, long_mean=4)
OPEN = RankingSettings(least_liquidity=0.0, least_sector=5)
START = datetime.date(2020, 1, 6)


def market(spark, series: dict[str, list]):
    rows = [(START + datetime.timedelta(days=i), t, float(v), float(v) * 1.01, float(v) * 0.99, 100.0, 5e6) for t, values in series.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "date date, ticker string, close double, high double, low double, volume_shares double, volume_value double")


def listing(spark, tickers):
    return spark.createDataFrame([(t, f"Company {t}", f"S{i % 2}") for i, t in enumerate(tickers)], "ticker string, name string, sector string")


def walks(seed, n, tickers, sigma=0.012):
    draw = random.Random(seed)
    out = {}
    for t in tickers:
        v, values = 100.0, []
        for _ in range(n):
            v *= math.exp(draw.gauss(0, sigma))
            values.append(v)
        out[t] = values
    return out


def test_dense_panel_keeps_holes_and_strict_windows_are_null_over_them(spark):
    rows = features.rolling_features(panel.dense(market(spark, {"AA": [1, 2, 3, 4, 5, 6, 7, 8], "BB": [1, 2, None, 4, 5, 6, 7, 8]})), SMALL)
    got = {(r.ticker, (r.date - START).days): r for r in rows.collect()}
    assert len(got) == 16 and got["BB", 2].close is None
    assert got["AA", 5].momentum == pytest.approx(5 / 1 - 1) and got["AA", 4].momentum is None
    assert got["BB", 4].trend is None and got["BB", 6].trend is not None
    assert got["BB", 2].liquidity == pytest.approx(5e6)  # two trades and one nought


def test_features_by_blocks_equal_those_over_whole_histories(spark):
    rows = panel.dense(market(spark, {t: [v if (i * 7 + j) % 11 else None for i, v in enumerate(values)] for j, (t, values) in enumerate(walks(4, 90, ["AA", "BB", "CC"]).items())}))
    numbers = panel.session_numbers(rows)
    shown = lambda df: sorted(str((r.date, r.ticker, r.close, r.momentum, r.trend, r.volatility, r.liquidity)) for r in df.collect())
    whole = shown(features.rolling_features(rows, SMALL))
    for size in (1, 4, 17, 500):
        assert shown(features.blocked_features(rows, numbers, SMALL, size)) == whole
    ahead = lambda df: df.withColumn("forward", features.forward_return(6))
    both = [sorted(str((r.date, r.ticker, r.forward)) for r in df.collect()) for df in (ahead(rows), features.in_blocks(rows, numbers, ahead, 10, 0, 6))]
    assert both[0] == both[1]
    blocks = features.in_blocks(rows, numbers, lambda df: df.withColumn("_size", F.count("*").over(features.by_ticker().rowsBetween(-1000, 1000))), 10, 5).agg(F.max("_size")).first()[0]
    assert blocks == 15  # a window never sees more than a block and its look-back


def test_sliding_median_equals_the_definition_and_needs_no_shuffle_of_its_own(spark):
    import statistics

    draw, rows = random.Random(8), []
    for t in "ABC":
        for i in sorted(draw.sample(range(60), 40)):
            rows.append((START + datetime.timedelta(days=i), t, draw.choice([None, float(draw.randint(0, 6)), draw.random() * 9]), "kept"))
    df = spark.createDataFrame([*rows, (START, "none", None, "kept")], "date date, ticker string, v double, other string")
    for window in (1, 2, 7, 200):
        got = {(r.ticker, r.date): r for r in features.sliding_median(df, F.col("v"), window, "m").collect()}
        assert len(got) == len(rows) + 1 and got["none", START].m is None and {r.other for r in got.values()} == {"kept"}
        for t in "ABC":
            own = [r for r in rows if r[1] == t]
            for i, (date, _, v, _) in enumerate(own):
                known = [x[2] for x in own[max(0, i - window + 1) : i + 1] if x[2] is not None]
                assert got[t, date].v == v
                assert got[t, date].m == (pytest.approx(statistics.median(known)) if known else None), (t, i, window)
    assert features.sliding_median(df.limit(0), F.col("v"), 3, "m").collect() == []
    market_rows = market(spark, walks(4, 30, ["AA", "BB"]))
    plan = features.rolling_features(market_rows, SMALL, slide=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_average_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 1.0), (1, None)], "d int, x double")
    got = sorted((r.x is None, r.x or 0, r.r) for r in df.select("x", average_rank(F.col("x"), "d").alias("r")).collect())
    assert got == [(False, 1.0, 0.5), (False, 1.0, 0.5), (False, 3.0, 1.0), (True, 0, None)]


def test_features_do_not_change_with_later_data(spark):
    series = walks(3, 30, ["AA", "BB", "CC"])
    early = {t: v[:20] for t, v in series.items()}
    full = features.rolling_features(panel.dense(market(spark, series)), SMALL).filter(F.col("date") < START + datetime.timedelta(days=20))
    cut = features.rolling_features(panel.dense(market(spark, early)), SMALL)
    assert sorted(map(repr, full.select(cut.columns).collect())) == sorted(map(repr, cut.collect()))


def test_ranking_gates_before_ranks_and_breaks_ties_by_ticker(spark):
    rows = spark.createDataFrame([(START, t, 1.0, m, 0.0, 1.0, liq) for t, m, liq in [("AA", 1.0, 10.0), ("BB", 1.0, 10.0), ("CC", 5.0, 1.0)]], "date date, ticker string, close double, momentum double, trend double, volatility double, liquidity double")
    got = ranking.ranking(rows, listing(spark, ["AA", "BB", "CC"]), RankingSettings(least_liquidity=5.0)).orderBy("place").collect()
    assert [(r.ticker, r.place) for r in got] == [("AA", 1), ("BB", 2)]


def test_crash_after_entry_is_suffered(spark):
    rising = [100 * 1.02**i for i in range(12)]
    series = {"TRAP": rising + [rising[-1] / 2] * 20, **{f"T{i}": [100 + 0.01 * i * j for j in range(32)] for i in range(4)}}
    quotes = market(spark, series)
    got = backtest.journal(quotes, listing(spark, series), BacktestSettings(positions=1, step=6, delay=1), SMALL, OPEN).orderBy("step").collect()
    crash = next(r for r in got if r.entry <= START + datetime.timedelta(days=11) < r.exit)
    assert crash.held == ["TRAP"] and crash.gain < -0.3


def test_too_short_history_gives_no_steps(spark):
    quotes = market(spark, walks(1, 6, ["AA", "BB"]))
    assert backtest.journal(quotes, listing(spark, ["AA", "BB"]), BacktestSettings(positions=1, step=6), SMALL, OPEN).count() == 0


def test_dividend_is_priced_on_the_ex_date_session_and_frontier_refuses_the_past(spark):
    quotes = market(spark, {"AA": [90, 90, 100, 100, 100, 100]})
    day = lambda n: START + datetime.timedelta(days=n)
    paid = spark.createDataFrame([("AA", day(0), 9.0, 2019), ("AA", day(2), 50.0, 2019), ("AA", day(4), 10.0, 2020)], "ticker string, ex_date date, amount double, fiscal_year int")
    got = dividends.dated_yields(quotes, paid).collect()
    assert [(r.session, round(r["yield"], 6)) for r in got] == [(day(4), 0.1)]


def test_spread_year_replaces_what_was_dated_in_it(spark):
    quotes = market(spark, {"AA": [100.0] * 4})
    paid = spark.createDataFrame([("AA", START, 10.0, 2019)], "ticker string, ex_date date, amount double, fiscal_year int")
    published = spark.createDataFrame([("AA", datetime.date(2020, 12, 31), "yield", 8.0)], "ticker string, date date, indicator string, value double")
    assert {round(r.accrued, 9) for r in dividends.accrual(quotes, paid, published).collect()} == {0.02}


def test_noise_gives_few_discoveries_and_planted_signal_is_found(spark):
    tickers = [f"T{c}" for c in "ABCDEFGHIJKL"]
    small = SweepSettings(horizons=(5,), least_members=4)
    scale = FeatureSettings(momentum=20, skip=5, volatility=10, liquidity=10, short_mean=5, long_mean=15)
    noise = research.sweep(panel.dense(market(spark, walks(11, 160, tickers))), listing(spark, tickers), small, scale)
    assert noise.filter("discovered").count() <= 3
    drift = {t: [v * (1 + (i - 6) * 0.002) ** j for j, v in enumerate(values)] for i, (t, values) in enumerate(walks(12, 160, tickers, 0.004).items())}
    found = research.sweep(panel.dense(market(spark, drift)), listing(spark, tickers), small, scale)
    assert found.filter("discovered and segment = 'market' and predictor = 'momentum_long' and ic > 0.5").count() == 1


def test_random_walks_are_rarely_mean_reverting_and_ou_is_found(spark):
    draw, y, rows = random.Random(0), 0.06, []
    for i in range(1500):
        y += 0.05 * (0.06 - y) + draw.gauss(0, 0.002)
        rows.append(("OU", i, y))
    for w in range(30):
        v = 0.0
        for i in range(300):
            v += draw.gauss(0, 1)
            rows.append((f"W{w}", i, v))
    got = {r.ticker: r for r in stats.mean_reversion(spark.createDataFrame(rows, "ticker string, date int, y double"), "y").collect()}
    own = np.array([r[2] for r in rows if r[0] == "OU"])
    slope, intercept = np.polyfit(own[:-1], np.diff(own), 1)
    assert got["OU"].theta == pytest.approx(-slope) and got["OU"].equilibrium == pytest.approx(-intercept / slope) == pytest.approx(0.06, abs=0.01)
    assert sum(r.theta is not None for t, r in got.items() if t != "OU") <= 5


def plain_p(t, v):
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the angle."""
    h = math.atan(abs(t) / math.sqrt(v))
    c, s, term, total = math.cos(h), math.sin(h), 1.0, 0.0
    if v % 2:
        for k in range((v - 1) // 2):
            total += term * c ** (2 * k + 1)
            term *= (2 * k + 2) / (2 * k + 3)
        return 1 - 2 / math.pi * (h + s * total)
    for k in range(v // 2):
        total += term * c ** (2 * k)
        term *= (2 * k + 1) / (2 * k + 2)
    return 1 - s * total


def test_student_p_values(spark):
    tabled = [(2.0, 10, 0.07338803), (0.5, 3, 0.6514383), (12.706205, 1, 0.05), (1.959964, 10**6, 0.05)]
    cases = [(t, v) for t in (0.001, 0.3, -1.0, 1.96, -2.5, 4.0, 9.0, 40.0) for v in (1, 2, 3, 4, 7, 10, 33, 88, 365, 5000)] + [(t, v) for t, v, _ in tabled]
    odd = [(0.0, 5), (math.inf, 5), (math.nan, 5), (None, 5), (1.0, 0), (1.0, None)]
    df = spark.createDataFrame([(i, None if t is None else float(t), v) for i, (t, v) in enumerate([*cases, *odd])], "i int, t double, v int")
    from tidemark.functions.student import student_p

    got = [r.p for r in df.select("i", student_p(F.col("t"), F.col("v")).alias("p")).orderBy("i").collect()]
    for (t, v), p in zip(cases, got, strict=False):
        assert p == pytest.approx(plain_p(t, v), abs=1e-9), (t, v)
    for p, (_, _, want) in zip(got[len(cases) - len(tabled) :], tabled, strict=False):
        assert p == pytest.approx(want, rel=1e-4)
    assert got[-6:-4] == [1.0, 0.0] and math.isnan(got[-4]) and got[-3:] == [None] * 3


def test_p_values_need_no_python_worker(spark):
    df = spark.createDataFrame([(1.0, 5)], "t double, periods long")
    assert "Python" not in stats.with_p_value(df)._jdf.queryExecution().optimizedPlan().toString()


def test_benjamini_hochberg_keeps_up_to_the_largest_passing_rank(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5, None)], "p double")
    assert sorted(r.p for r in stats.benjamini_hochberg(df, 0.10).filter("discovered").collect()) == [0.01, 0.03, 0.04]


def test_benjamini_hochberg_ranks_in_many_tasks(spark):
    draw = random.Random(3)
    ps = [round(draw.random() ** 3, 3) for _ in range(3000)]
    got = stats.benjamini_hochberg(spark.createDataFrame([(p,) for p in [*ps, None, math.nan]], "p double"), 0.3)
    bound = max(p for r, p in enumerate(sorted(ps), 1) if p <= 0.3 * r / len(ps))
    assert 0 < bound < max(ps) and sorted(r.p for r in got.filter("discovered").collect()) == sorted(p for p in ps if p <= bound)
    windows = [x for x in got._jdf.queryExecution().analyzed().toString().split("\n") if re.search(r"\bWindow \[", x)]
    assert windows and all("windowspecdefinition(_range" in x for x in windows)


def test_folds_never_let_a_training_label_reach_the_test(spark):
    df = spark.createDataFrame([(START + datetime.timedelta(days=i),) for i in range(50)], "date date")
    rows = learn.folds(df, 4, 8).collect()
    for k in range(1, 5):
        train, test = ([r.date for r in rows if r.fold == k and r.part == part] for part in ("train", "test"))
        if train:
            assert (min(test) - max(train)).days > 8


def test_learning_finds_a_planted_signal(spark):
    draw, rows = random.Random(5), []
    for d in range(60):
        for t in range(10):
            x = (t + draw.random()) / 11
            rows.append((START + datetime.timedelta(days=d), f"T{t}", x + draw.gauss(0, 0.2), 1.0 if x > 0.5 else 0.0, x, draw.random(), draw.random(), draw.random()))
    df = spark.createDataFrame(rows, "date date, ticker string, forward double, label double, momentum double, trend double, volatility double, liquidity double")
    from tidemark.settings import LearningSettings

    out = learn.walk_forward(df, LearningSettings(horizon=2, folds=2, least_rows=100))
    pooled = [r for r in learn.validation(out, 2).collect() if r.fold is None][0]
    assert pooled.probability_ic > 0.7 and pooled.precision > 0.8
    assert learn.walk_forward(df.limit(50), LearningSettings(least_rows=100)) is None


def plain_fit(x, y, penalty):
    """Newton's method on one group in numpy: scales and coefficients."""
    mean, dev = x.mean(0), x.std(0)
    dev[dev == 0] = 1
    z, b = np.c_[np.ones(len(x)), (x - mean) / dev], np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0, *[1.0] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve(ridge + penalty * (z.T * (p * (1 - p))) @ z, penalty * z.T @ (p - y) + ridge @ b)
    return mean, dev, b


def test_grouped_fits_equal_one_fit_a_group(spark):
    from tidemark.operators import logistic

    draw, rows = np.random.default_rng(4), []
    for g, n in (("one", 300), ("two's", 40), ("flat", 50), ("single", 20)):
        x = draw.normal(size=(n, 3)) * [1.0, 50.0, 0.0 if g == "flat" else 0.1] + [0, 1000, 3]
        y = np.ones(n) if g == "single" else (draw.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
        rows += [(g, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, label double").repartition(5)
    for penalty in (0.1, 1000.0):  # the weak penalty needs shortened steps
        fitted = logistic.fits(df, "g", ["a", "b", "c"], penalty)
        got = {r.g: r for r in fitted.collect()}
        assert set(got) == {"one", "two's", "flat"}
        for g, r in got.items():
            own = np.array([row[1:] for row in rows if row[0] == g])
            mean, dev, b = plain_fit(own[:, :3], own[:, 3], penalty)
            assert [r[f"_b{i}"] for i in range(4)] == pytest.approx(list(b), abs=1e-7)
            p = {(x.a, x.b): x.probability for x in logistic.with_probability(df, fitted, "g", ["a", "b", "c"]).filter(F.col("g") == g).collect()}
            assert len(p) == len(own)
            for row in own:
                assert p[row[0], row[1]] == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1:] @ ((row[:3] - mean) / dev)))), abs=1e-7)
    assert logistic.fits(df.filter("g = 'single'"), "g", ["a"], 0.1) is None


def test_sample_does_not_change_with_later_data(spark):
    """A row whose label's session is known keeps ranks, label and return when the history is cut after that session."""
    series = walks(9, 60, [f"T{i}" for i in range(6)])
    rows = lambda n: {(r.date, r.ticker): r for r in learn.sample(panel.dense(market(spark, {t: v[:n] for t, v in series.items()})), 4, SMALL).collect()}
    full, early = rows(60), rows(40)
    last = START + datetime.timedelta(days=40 - 1 - 4)
    assert set(early) == {k for k in full if k[0] <= last} and len(early) > 100
    assert all(full[k] == r for k, r in early.items())


def test_external_variations_do_not_change_with_later_data(spark):
    from tidemark.operators import exogenous
    from tidemark.settings import ExternalSettings

    draw = random.Random(2)
    points = [(START + datetime.timedelta(days=7 * i), s, 100 + draw.random()) for i in range(12) for s in ("oil", "gold")]
    days = [START + datetime.timedelta(days=i) for i in range(80)]
    tickers = spark.createDataFrame([("AA", "S0"), ("BB", "S1")], "ticker string, sector string")
    mapping = spark.createDataFrame([("oil", "S0"), ("gold", "S1")], "series string, sector string")

    def features_until(n):
        known = spark.createDataFrame([p for p in points if p[0] <= days[n - 1]], "date date, series string, value double")
        dates = spark.createDataFrame([(d,) for d in days[:n]], "date date")
        return {(r.date, r.ticker, r.series): r.value for r in exogenous.external_features(known, dates, tickers, mapping, ExternalSettings(window=5, lag=3)).collect()}

    full, early = features_until(80), features_until(50)
    assert len(early) and any(early.values()) and all(full[k] == v for k, v in early.items())


def test_ghosts_need_both_neighbours(spark):
    got = quality.ghost_rows(market(spark, {"AA": [100, 100, 200, 100, 100], "BB": [100, 100, 200, 200, 200], "CC": [200, 100, 100, 100, 50]})).collect()
    assert [(r.ticker, r.factor) for r in got] == [("AA", 2.0)]


def test_merge_keeps_known_values_and_counts_fills(spark):
    kind = "date date, ticker string, close double, volume_shares double"
    known = spark.createDataFrame([(START, "AA", 1.0, None), (START, "BB", 2.0, 5.0)], kind)
    new = spark.createDataFrame([(START, "AA", 9.0, 7.0), (START, "CC", 3.0, None)], kind)
    got = {r.ticker: (r.close, r.volume_shares, r.filled) for r in merge.merge_fields(known, new).collect()}
    assert got == {"AA": (1.0, 7.0, 1), "BB": (2.0, 5.0, 0), "CC": (3.0, None, 0)}
