"""Queries of the learned ranking and of the sweep's discoveries, with SQL that fits and tests by itself."""

from __future__ import annotations

from tidemark.operators import learn, research
from tidemark.operators.features import FEATURES as NAMES
from tidemark.plans.fixtures import FEATURES, LEARNING, SWEEP, load
from tidemark.plans.queries import SAMPLE, SWEPT, mean_sql, panel_of, query, rank_sql, sample_of, shown_mean, spearman_sql

ORDER = len(NAMES) + 1


def linear_sql(x: str = "x") -> str:
    return "b0 + " + " + ".join(f"b{i} * {x}{i}" for i in range(1, ORDER))


def newton_sql(penalty: float, steps: int = 14) -> str:
    """CTEs sc and nw: scales and coefficients by fold from the rows tr0 (fold, y, features), by Newton steps in SQL.

    Each step sums gradient and Hessian by fold and solves by a Cholesky factor, written out entry by entry.
    """
    entry = [f"{penalty} * sum(p * (1 - p) * x{i} * x{j}) + {int(i == j and i > 0)} AS h{i}_{j}" for i in range(ORDER) for j in range(i + 1)]
    slope = [f"{penalty} * sum((p - y) * x{i}) + {int(i > 0)} * any_value(b{i}) AS g{i}" for i in range(ORDER)]
    factor, forward, back = [], [], []
    for i in range(ORDER):
        for j in range(i + 1):
            rest = f"h{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            factor.append(f"sqrt({rest}) AS l{i}_{j}" if i == j else f"({rest}) / l{j}_{j} AS l{i}_{j}")
        forward.append(f"(g{i}" + "".join(f" - l{i}_{k} * f{k}" for k in range(i)) + f") / l{i}_{i} AS f{i}")
    for i in reversed(range(ORDER)):
        back.append(f"(f{i}" + "".join(f" - l{k}_{i} * d{k}" for k in range(i + 1, ORDER)) + f") / l{i}_{i} AS d{i}")
    b = [f"b{i}" for i in range(ORDER)]
    return f"""sc AS (SELECT fold, {", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s{i}" for i, c in enumerate(NAMES, 1))} FROM tr0 GROUP BY 1 HAVING count(DISTINCT y) > 1),
tr AS MATERIALIZED (SELECT fold, y, CAST(1 AS DOUBLE) AS x0, {", ".join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(NAMES, 1))} FROM tr0 JOIN sc USING (fold)),
nw AS (SELECT fold, 0 AS step, {", ".join(f"CAST(0 AS DOUBLE) AS {x}" for x in b)} FROM sc UNION ALL
  SELECT fold, step + 1, {", ".join(f"{x} - d{i}" for i, x in enumerate(b))} FROM (
    SELECT *, {", ".join(factor + forward + back)} FROM (
      SELECT fold, step, {", ".join(f"any_value({x}) AS {x}" for x in b)}, {", ".join(entry + slope)} FROM (
        SELECT nw.*, tr.* EXCLUDE (fold), 1 / (1 + exp(-({linear_sql()}))) AS p FROM nw JOIN tr USING (fold) WHERE step < {steps}) r GROUP BY fold, step) s) t),
fit AS (SELECT * FROM nw JOIN sc USING (fold) WHERE step = {steps})"""


SCORE = f"1 / (1 + exp(-(b0 + {' + '.join(f'b{i} * ({c} - m{i}) / s{i}' for i, c in enumerate(NAMES, 1))})))"
COLUMNS = ", ".join(NAMES)


@query(f"""WITH RECURSIVE {SAMPLE},
dn AS (SELECT date, row_number() OVER (ORDER BY date) AS n, ntile(5) OVER (ORDER BY date) AS b FROM (SELECT DISTINCT date FROM sample)),
sb AS (SELECT b - 1 AS fold, min(n) AS s FROM dn WHERE b > 1 GROUP BY 1),
tr0 AS (SELECT fold, label AS y, {COLUMNS} FROM sample JOIN dn USING (date) JOIN sb ON n <= s - 1 - 8), {newton_sql(LEARNING.penalty)},
te AS MATERIALIZED (SELECT fold, date, forward, label, {SCORE} AS probability, (0.5 * momentum + 0.3 * trend - 0.2 * volatility) / 1.0 AS composite FROM sample JOIN dn USING (date) JOIN fit ON fold = b - 1),
lg AS (SELECT fold, date, forward, unnest(['probability', 'composite']) AS score, unnest([probability, composite]) AS value FROM te), {spearman_sql("lg", "value", "forward", "score, fold, date", 3)},
po AS (SELECT score, unnest([fold, NULL]) AS fold, ic FROM ic WHERE ic IS NOT NULL),
me AS (SELECT score, fold, avg(ic) AS m, count(*) AS sessions, CASE WHEN ceil(count(*) / 8.0) >= 2 AND stddev_samp(ic) > 0 THEN stddev_samp(ic) / sqrt(ceil(count(*) / 8.0)) END AS e FROM po GROUP BY 1, 2),
ca AS (SELECT fold, avg(ok) AS precision FROM (SELECT unnest([fold, NULL]) AS fold, CAST((probability >= 0.5) = (label = 1) AS INT) AS ok FROM te) GROUP BY 1)
SELECT CAST(p.fold AS BIGINT) AS fold, round(p.m, 6) AS probability_ic, round(p.e, 6) AS probability_error, p.sessions, round(c.m, 6) AS composite_ic, round(c.e, 6) AS composite_error, round(precision, 6) AS precision
FROM me p JOIN me c ON c.fold IS NOT DISTINCT FROM p.fold AND c.score = 'composite' JOIN ca ON ca.fold IS NOT DISTINCT FROM p.fold WHERE p.score = 'probability'""")
def walk_forward_validation(spark, d):
    return learn.validation(learn.walk_forward(sample_of(spark, d), LEARNING), LEARNING.horizon)


NOW = f"""{SAMPLE}, tr0 AS (SELECT 0 AS fold, label AS y, {COLUMNS} FROM sample), {newton_sql(LEARNING.penalty)},
la AS (SELECT * FROM feats WHERE date = (SELECT max(date) FROM feats) AND momentum IS NOT NULL AND trend IS NOT NULL AND volatility IS NOT NULL),
lr AS (SELECT date, ticker, {", ".join(f"coalesce({rank_sql(c, 'date')}, 0.5) AS {c}" for c in NAMES)} FROM la),
pb AS (SELECT date, ticker, {SCORE} AS probability FROM lr, fit)
SELECT CAST(date AS VARCHAR) AS date, ticker, round(probability, 6) AS probability FROM pb"""


@query(f"WITH RECURSIVE {NOW}")
def current_probabilities(spark, d):
    return learn.probabilities(sample_of(spark, d), panel_of(spark, d), FEATURES, LEARNING)


@query(f"WITH RECURSIVE {NOW} ORDER BY pb.probability DESC, ticker LIMIT 5")
def most_probable(spark, d):
    return learn.probabilities(sample_of(spark, d), panel_of(spark, d), FEATURES, LEARNING, first=5)


# the share of Student's t within |t| for whole degrees of freedom, as a finite series in the angle
WITHIN = """CASE WHEN v % 2 = 1 THEN 2 / pi() * (h + CASE WHEN v > 1 THEN sin(h) * list_sum([pow(cos(h), 2 * k + 1) * coalesce(list_product([2 * j / (2 * j + 1.0) FOR j IN range(1, k + 1)]), 1) FOR k IN range(0, (v - 1) // 2)]) ELSE 0 END)
ELSE sin(h) * list_sum([pow(cos(h), 2 * k) * coalesce(list_product([(2 * j - 1) / (2.0 * j) FOR j IN range(1, k + 1)]), 1) FOR k IN range(0, v // 2)]) END"""


@query(f"""WITH {SWEPT}, cells AS MATERIALIZED (WITH {mean_sql("segment, predictor, horizon", "horizon", 3).replace("round(m / e, 5) AS t", "round(m / e, 5) AS t, m / e AS exact")}),
pv AS (SELECT * EXCLUDE (exact, v, h), CASE WHEN v > 0 THEN 1 - ({WITHIN}) END AS p FROM (SELECT *, periods - 1 AS v, atan(abs(exact) / sqrt(periods - 1)) AS h FROM cells WHERE exact IS NOT NULL)
  UNION ALL SELECT * EXCLUDE (exact), NULL FROM cells WHERE exact IS NULL),
rk AS (SELECT p, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pv WHERE p IS NOT NULL), bd AS (SELECT max(p) AS b FROM rk WHERE p <= {SWEEP.discovery_rate} * r / m)
SELECT * REPLACE (round(p, 6) + 0.0 AS p), coalesce(p <= (SELECT b FROM bd), false) AS discovered FROM pv""")
def sweep_discoveries(spark, d):
    return shown_mean(research.sweep(panel_of(spark, d), load(spark, d, "reference"), SWEEP, FEATURES))
