"""Penalised logistic regression of many groups at once, by Newton steps over grouped normal equations.

Features are scaled by the mean and population deviation of their group (a constant one by 1). The objective is
half the squared norm of the weights plus ``penalty`` times the log loss; the intercept is not penalised. A step
is one aggregation for all groups: loss, gradient and the upper half of the Hessian, summed in columns. The
driver solves one small system a group (features plus one unknowns); a step that does not lower the loss is halved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scaled(name: str, i: int) -> str:
    return f"((`{name}` - _m{i}) / _s{i})"


def _linear(names: Sequence[str]) -> str:
    return "(_b0 + " + " + ".join(f"_b{i} * {_scaled(c, i)}" for i, c in enumerate(names, 1)) + ")"


def _frame(df: DataFrame, group: str, names: Sequence[str], scales: dict, weights: dict[object, np.ndarray]) -> DataFrame:
    """One row a group, written into the plan as literals; as many as there are groups, which callers bound."""
    p = len(names)
    columns = [*[f"_m{i}" for i in range(1, p + 1)], *[f"_s{i}" for i in range(1, p + 1)], *[f"_b{i}" for i in range(p + 1)]]
    rows = [F.struct(F.lit(g).cast(df.schema[group].dataType).alias(group), *[F.expr(f"{float(v)!r}D AS {c}") for c, v in zip(columns, (*scales[g][0], *scales[g][1], *b), strict=True)]) for g, b in weights.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def fits(train: DataFrame, group: str, names: Sequence[str], penalty: float, label: str = "label", most_steps: int = 30, tolerance: float = 1e-10) -> DataFrame | None:
    """Scales and coefficients by group; groups whose labels are of one class are left out, None if all are.

    ``train`` is read once for the scales and once a step, so callers settle it.
    """
    facts = train.groupBy(group).agg(F.countDistinct(label).alias("classes"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names, 1)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names, 1)]).collect()
    p = len(names)
    scales = {r[group]: ([r[f"m{i}"] for i in range(1, p + 1)], [r[f"s{i}"] or 1.0 for i in range(1, p + 1)]) for r in facts if r.classes > 1}
    if not scales:
        return None
    ridge = np.diag([0.0, *[1.0] * p])
    now = {g: np.zeros(p + 1) for g in scales}  # where the loss is measured
    best: dict[object, tuple[float, np.ndarray]] = {}  # loss and place of the last accepted step
    done: set = set()
    sums = ["sum(log1p(exp(-abs(_z))) + greatest(_z, 0D) - _y * _z) AS loss", *[f"sum((_p - _y) * _x{i}) AS g{i}" for i in range(p + 1)]]
    sums += [f"sum(_p * (1 - _p) * _x{i} * _x{j}) AS h{i}_{j}" for i in range(p + 1) for j in range(i + 1)]
    for _ in range(most_steps):
        rows = train.join(F.broadcast(_frame(train, group, names, scales, {g: b for g, b in now.items() if g not in done})), group)
        rows = rows.select(group, F.col(label).alias("_y"), F.expr(f"{_linear(names)} AS _z"), F.lit(1.0).alias("_x0"), *[F.expr(f"{_scaled(c, i)} AS _x{i}") for i, c in enumerate(names, 1)])
        rows = rows.withColumn("_p", F.expr("1 / (1 + exp(-_z))"))
        for r in rows.groupBy(group).agg(*[F.expr(x) for x in sums]).collect():
            g, b = r[group], now[r[group]]
            value = penalty * r.loss + 0.5 * float(b[1:] @ b[1:])
            if g in best and value > best[g][0] * (1 + 1e-12) + 1e-12:
                now[g] = (b + best[g][1]) / 2
                continue
            gradient = penalty * np.array([r[f"g{i}"] for i in range(p + 1)]) + ridge @ b
            hessian = ridge + penalty * np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
            best[g] = (value, b)
            move = np.linalg.solve(hessian, gradient)
            now[g] = b - move
            if np.abs(move).max() < tolerance:
                done.add(g)
        if len(done) == len(now):
            return _frame(train, group, names, scales, now)
    raise ValueError(f"no minimum of the loss within {most_steps} steps for {sorted(map(str, set(now) - done))}")


def with_probability(df: DataFrame, fitted: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """Adds ``probability`` of label 1 to the rows of fitted groups."""
    own = [c for c in fitted.columns if c != group]
    return df.join(F.broadcast(fitted), group).withColumn("probability", F.expr(f"1 / (1 + exp(-{_linear(names)}))")).drop(*own)
