"""Nested regressions against least squares with gaps, and rule grids against counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import control
from stratapanel.operators import evaluation as ev


def test_nested_residuals_against_least_squares(spark):
    rng = np.random.default_rng(7)
    styles = [f"s{k}" for k in range(11)]
    x = rng.standard_normal((5 * 60, 11))
    x[:, 4] = 2 * x[:, 3]  # says the same
    x[:60, 5] = 1.0  # constant on a date
    x[rng.random(x.shape) < 0.02] = np.nan
    f = np.where(rng.random(len(x)) < 0.05, np.nan, x[:, 0] + rng.standard_normal(len(x)))
    val = lambda v: None if np.isnan(v) else float(v)
    rows = [(i % 60, i // 60, val(f[i]), *map(val, x[i])) for i in range(len(x))]
    table = spark.createDataFrame(rows, "sym long, t long, f double, " + ", ".join(f"{s} double" for s in styles))
    models = {f"m{k}": styles[:k] for k in range(12)} | {"other": ["s7", "s2"], "few": ["s1"]}
    made = ev.nested_residuals(table, "f", models, least=25)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r["sym"], r["t"]): r for r in made.collect()}
    for name, held in models.items():
        cols = [styles.index(s) for s in held]
        for t in range(5):
            at = np.arange(60 * t, 60 * t + 60)
            full = at[~np.isnan(f[at]) & ~np.isnan(x[np.ix_(at, cols)]).any(1)]
            want = {}
            if len(full) >= 25:
                a = np.column_stack([np.ones(len(full)), x[np.ix_(full, cols)]])
                left = f[full] - a @ np.linalg.lstsq(a, f[full], rcond=None)[0]
                want = dict(zip((full % 60).tolist(), left, strict=True))
            for sym in range(60):
                v = got[sym, t][name]
                assert (v is None) == (sym not in want) and (v is None or abs(v - want[sym]) < 1e-7), (name, t, sym)


@pytest.mark.parametrize("both", [True, False])
def test_rule_grid_against_counting(spark, both):
    rng = np.random.default_rng(8)
    a, b = (np.round(rng.random(500), 2) for _ in "ab")
    a[::17], b[::13] = np.nan, np.nan
    truth = rng.random(500) < 0.3
    rows = [(None if np.isnan(x) else float(x), None if np.isnan(y) else float(y), bool(t)) for x, y, t in zip(a, b, truth, strict=True)]
    table = spark.createDataFrame(rows, "a double, b double, t boolean")
    xs, ys = np.linspace(0, 1, 201).round(3).tolist(), np.linspace(-0.1, 1.1, 200).round(3).tolist()
    found = control.rule_grid(table, ["a", "b"], [xs, ys], F.col("t"), both).collect()
    assert len(found) == len(xs) * len(ys)
    with np.errstate(invalid="ignore"):
        hit_a, hit_b = a[:, None] >= np.array(xs), b[:, None] >= np.array(ys)
    for r in found:
        i, j = xs.index(r["x"]), ys.index(r["y"])
        p = hit_a[:, i] & hit_b[:, j] if both else hit_a[:, i] | hit_b[:, j]
        assert r["n_pred"] == p.sum() and r["recall"] == (p & truth).sum() / truth.sum()
        assert r["precision"] == ((p & truth).sum() / p.sum() if p.any() else None)
    [best] = control.best_thresholds(control.rule_grid(table, ["a", "b"], [xs, ys], F.col("t"), both), 0.3).collect()
    fine = [r for r in found if r["precision"] is not None and r["precision"] >= 0.3]
    assert best["recall"] == max(r["recall"] for r in fine)


def test_rule_grid_of_nothing(spark):
    table = spark.createDataFrame([], "a double, b double, t boolean")
    assert {r["n_pred"] for r in control.rule_grid(table, ["a", "b"], [[1.0, 2.0], [3.0]], F.col("t")).collect()} == {0}
