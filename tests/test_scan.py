"""The scan along time against loops: runs that end within a symbol, gaps, ties, flat stretches, symbols shorter than a window."""

import numpy as np
import pandas as pd
import pytest

from stratapanel.functions import scan as sc

WIDTHS = (2, 5, 60)
KINDS = ("mean", "std", "std_samp", "sum", "max", "min", "rank", "rank_or_0", "pct_rank", "skew", "kurt", "ema")


@pytest.fixture(scope="module")
def series():
    rng, rows = np.random.default_rng(0), []
    for s, n in enumerate((300, 1, 57, 300, 450, 20)):
        x = np.round(rng.standard_normal(n), 1) + (1e6 if s == 3 else 0)
        x[rng.random(n) < 0.15] = np.nan
        if s == 2:
            x = np.where(np.isnan(x), np.nan, 7.0)
        rows += [(f"s{s}", 2 * t, None if np.isnan(v) else float(v)) for t, v in enumerate(x)]
    return rows


def at(v, w, kind):
    """One window, its current value last."""
    held, x = v[~np.isnan(v)], v[-1]
    if kind in ("skew", "kurt"):
        off = held - held.mean() if len(held) else held
        if len(held) < w or not (off**2).mean() > 1e-12:
            return np.nan
        return (off**3).mean() / (off**2).mean() ** 1.5 if kind == "skew" else (off**4).mean() / (off**2).mean() ** 2 - 3
    if len(held) < max(2, w // 2):
        return np.nan
    plain = {"mean": np.mean, "std": np.std, "std_samp": lambda y: np.std(y, ddof=1), "sum": np.sum, "max": np.max, "min": np.min}
    if kind in plain:
        return plain[kind](held)
    if np.isnan(x):
        return 0.0 if kind == "rank_or_0" else np.nan
    if kind == "pct_rank":
        return ((held < x).sum() + ((held == x).sum() + 1) / 2) / len(held)
    return (held < x).sum() / max(len(held) - 1, 1)


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_scans_against_loops(spark, series, monkeypatch, rows):
    monkeypatch.setattr(sc, "ROWS", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    wanted = {f"{k}_{w}": sc.scan(k, "x", w) for w in WIDTHS for k in KINDS} | {"near": sc.scan("pct_rank", "x", 21, 3, span=True)}
    found = sc.scans(spark.createDataFrame(series, "sym string, t long, x double"), wanted).toPandas().sort_values(["sym", "t"])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(series)
    for _, part in found.groupby("sym"):
        x, t = part["x"].to_numpy(float), part["t"].to_numpy()
        for w in WIDTHS:
            for k in KINDS[:-1]:
                want = [at(x[max(0, i - w + 1):i + 1], w, k) for i in range(len(x))]
                np.testing.assert_allclose(part[f"{k}_{w}"].to_numpy(float), want, rtol=1e-8, atol=1e-8, err_msg=f"{k} {w}")
            state = part["x"].ewm(alpha=2 / (w + 1), adjust=False, ignore_na=True).mean().ffill()
            np.testing.assert_allclose(part[f"ema_{w}"].to_numpy(float), state.where(part["x"].notna().cumsum() >= w), rtol=1e-9)
        spans = [x[(t > t[i] - 21) & (t <= t[i])] for i in range(len(x))]
        want = [at(v, 2, "pct_rank") if (~np.isnan(v)).sum() >= 3 else np.nan for v in spans]
        np.testing.assert_allclose(part["near"].to_numpy(float), want, rtol=1e-12)


def test_compose_is_the_recursion():
    rng = np.random.default_rng(2)
    a, b = rng.random(1000), rng.standard_normal(1000)
    a[::97] = 0.0
    x, want = 3.0, []
    for i in range(1000):
        x = a[i] * x + b[i]
        want.append(x)
    c, d = sc.compose(a, b)
    np.testing.assert_allclose(c * 3.0 + d, want, rtol=1e-12, atol=1e-12)


def test_scan_of_nothing_and_one_exchange(spark):
    empty = spark.createDataFrame([], "sym string, t long, x double")
    assert sc.scans(empty, {"y": sc.scan("mean", "x", 5)}).count() == 0
    plan = sc.scans(spark.range(100).selectExpr("id % 7 as sym", "id as t", "rand() as x"), {"y": sc.scan("rank", "x", 5), "z": sc.scan("ema", "x", 5)})
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_cost_does_not_follow_the_window():
    x = np.random.default_rng(1).standard_normal(1 << 16)
    code, place = np.zeros(len(x), np.int64), np.arange(len(x))

    def seconds(w):
        import time

        run, best = sc.Run(code, place, place), np.inf
        for _ in range(3):
            began = time.perf_counter()
            run.computed(sc.scan("rank", "x", w), x)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(2430) < 6 * seconds(20)


def test_pandas_is_not_called_by_symbol(spark):
    from stratapanel.plans.compiler import evaluate
    from stratapanel.plans.expr import parse

    frame = spark.createDataFrame(pd.DataFrame({"sym": [1, 1], "t": [0, 1], "close": [1.0, 2.0]}))
    plan = evaluate(frame, {"a": parse("ema5(close)"), "b": parse("ts_rank10(close)")})._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1
