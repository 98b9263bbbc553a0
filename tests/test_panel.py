"""Operators against independent numpy and pandas loops, analytic cases, identities and causality."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.functions import cs, scalar, ts
from stratapanel.functions.scan import scan, scans
from stratapanel.operators import backtest as bt
from stratapanel.operators import combination as cb
from stratapanel.operators import control
from stratapanel.operators import evaluation as ev
from stratapanel.operators import portfolios as pf
from stratapanel.operators import reports as rp
from stratapanel.plans import registry
from stratapanel.plans.compiler import evaluate
from stratapanel.plans.expr import ExpressionError, Node, from_json, is_style_combination, parse, review, skeleton, to_json
from stratapanel.sources import leaves, store
from stratapanel.streaming import bars


def panel(spark, values: np.ndarray, name="x"):
    rows = [
        (s, t, None if math.isnan(values[t, s]) else float(values[t, s])) for t in range(values.shape[0]) for s in range(values.shape[1])
    ]
    return spark.createDataFrame(rows, f"sym long, t long, {name} double")


def back(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["t"], r["sym"]] = np.nan if r[col] is None else r[col]
    return out


def walk(seed, rows=50, cols=13, missing=0.08):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, cols)).cumsum(axis=0)
    x[rng.random(x.shape) < missing] = np.nan
    return x


def rolling(x, w, fn, least):
    out = np.full(x.shape, np.nan)
    for t in range(x.shape[0]):
        for s in range(x.shape[1]):
            v = x[max(0, t - w + 1) : t + 1, s]
            v = v[~np.isnan(v)]
            if len(v) >= least:
                out[t, s] = fn(v)
    return out


@pytest.mark.parametrize(
    ("op", "fn"),
    [(ts.ts_mean, np.mean), (ts.ts_std, np.std), (ts.ts_sum, np.sum), (ts.ts_max, np.max), (ts.ts_min, np.min)],
)
def test_windows_against_loops(spark, op, fn):
    x = walk(1)
    got = back(panel(spark, x).withColumn("y", op(F.col("x"), 10)), "y", x.shape)
    np.testing.assert_allclose(got, rolling(x, 10, fn, 5), atol=1e-10)


def test_rank_and_correlation_against_loops(spark):
    x, y = walk(2), walk(3)
    frame = panel(spark, x).join(panel(spark, y, "y"), ["sym", "t"])
    got = back(scans(frame, {"r": scan("rank", "x", 10)}), "r", x.shape)
    want = np.full(x.shape, np.nan)
    corr = np.full(x.shape, np.nan)
    for t in range(x.shape[0]):
        for s in range(x.shape[1]):
            v, u = x[max(0, t - 9) : t + 1, s], y[max(0, t - 9) : t + 1, s]
            seen = v[~np.isnan(v)]
            if not np.isnan(x[t, s]) and len(seen) >= 5:
                want[t, s] = (seen < x[t, s]).sum() / max(len(seen) - 1, 1)
            ok = ~np.isnan(v) & ~np.isnan(u)
            if ok.sum() >= 5:
                corr[t, s] = np.corrcoef(v[ok], u[ok])[0, 1]
    np.testing.assert_allclose(got, want, atol=1e-12)
    np.testing.assert_allclose(back(ts.correlations(frame, "x", "y", 10, "c"), "c", x.shape), corr, atol=1e-9)


def test_long_windows_against_loops(spark):
    x, y = walk(21, 260, 2, 0.03) + 100, walk(22, 260, 2, 0.03)
    frame = panel(spark, x, "close").join(panel(spark, y, "open"), ["sym", "t"])
    texts = {
        k: parse(f"{k}(close)") for k in (
            "ts_mean200", "ts_std200", "ts_rank200", "ts_delta120", "ts_mean150", "ts_std100", "ts_max100", "ts_slope60", "ts_rsqr60",
            "ts_resi60",
        )
    }
    got = evaluate(frame, texts | {f"corr{w}": parse(f"corr{w}(close, open)") for w in (100, 200)}).cache()
    np.testing.assert_allclose(back(got, "ts_mean200", x.shape), rolling(x, 200, np.mean, 100), atol=1e-9)
    np.testing.assert_allclose(back(got, "ts_mean150", x.shape), rolling(x, 150, np.mean, 75), atol=1e-9)
    np.testing.assert_allclose(back(got, "ts_std200", x.shape), rolling(x, 200, np.std, 100), atol=1e-9)
    np.testing.assert_allclose(back(got, "ts_std100", x.shape), rolling(x, 100, np.std, 50), atol=1e-9)
    np.testing.assert_allclose(back(got, "ts_max100", x.shape), rolling(x, 100, np.max, 50), atol=1e-9)
    delta = np.full(x.shape, np.nan)
    delta[120:] = x[120:] - x[:-120]
    np.testing.assert_allclose(back(got, "ts_delta120", x.shape), delta, atol=1e-9)
    rank, fits = np.full(x.shape, np.nan), {k: np.full(x.shape, np.nan) for k in ("slope", "rsqr", "resi")}
    corr = {w: np.full(x.shape, np.nan) for w in (100, 200)}
    for s in range(2):
        for t in range(260):
            seen = x[max(0, t - 199) : t + 1, s]
            seen = seen[~np.isnan(seen)]
            if not np.isnan(x[t, s]) and len(seen) >= 100:
                rank[t, s] = (seen < x[t, s]).sum() / (len(seen) - 1)
            v = x[max(0, t - 59) : t + 1, s]
            if len(v) == 60 and not np.isnan(v).any():
                slope, level = np.polyfit(np.arange(60), v, 1)
                left = v - (level + slope * np.arange(60))
                fits["slope"][t, s], fits["resi"][t, s], fits["rsqr"][t, s] = slope, left[-1], 1 - (left**2).sum() / ((v - v.mean()) ** 2).sum()
            for w in corr:
                a, b = x[max(0, t - w + 1) : t + 1, s], y[max(0, t - w + 1) : t + 1, s]
                ok = ~np.isnan(a) & ~np.isnan(b)
                if ok.sum() >= w // 2:
                    corr[w][t, s] = np.corrcoef(a[ok], b[ok])[0, 1]
    np.testing.assert_allclose(back(got, "ts_rank200", x.shape), rank, atol=1e-12)
    for k, want in fits.items():
        np.testing.assert_allclose(back(got, f"ts_{k}60", x.shape), want, atol=1e-8)
    for w, want in corr.items():
        np.testing.assert_allclose(back(got, f"corr{w}", x.shape), want, atol=1e-9)


def test_line_has_slope_and_flat_has_no_r2(spark):
    x = np.column_stack([50 + 0.7 * np.arange(80), np.full(80, 7.0), -0.7 * np.arange(80)])
    frame = ts.regressions(panel(spark, x), "x", 20, {"slope": "a", "rsqr": "b", "resi": "c"})
    a, b, c = (back(frame, k, x.shape) for k in "abc")
    assert np.isnan(a[:19]).all()
    np.testing.assert_allclose(a[19:, 0], 0.7, atol=1e-9)
    np.testing.assert_allclose(a[19:, 2], -0.7, atol=1e-9)
    np.testing.assert_allclose(b[19:, [0, 2]], 1.0, atol=1e-9)
    np.testing.assert_allclose(c[19:, [0, 2]], 0.0, atol=1e-8)
    assert np.isnan(b[:, 1]).all()


def test_ema_and_moments(spark):
    x = walk(4, 80, 3)
    frame = evaluate(panel(spark, x, "close"), {"e": parse("ema5(close)"), "s": parse("ts_skew20(close)"), "k": parse("ts_kurt20(close)")})
    want = np.full(x.shape, np.nan)
    for s in range(3):
        e, n = None, 0
        for t in range(80):
            if not np.isnan(x[t, s]):
                e, n = (x[t, s] if e is None else e + (x[t, s] - e) * 2 / 6), n + 1
            if n >= 5:
                want[t, s] = e
    np.testing.assert_allclose(back(frame, "e", x.shape), want, atol=1e-10)
    skew, kurt = back(frame, "s", x.shape), back(frame, "k", x.shape)
    for t in range(19, 80):
        for s in range(3):
            v = x[t - 19 : t + 1, s]
            if np.isnan(v).any():
                assert np.isnan(skew[t, s]) and np.isnan(kurt[t, s])
            else:
                z = (v - v.mean()) / v.std()
                assert abs(skew[t, s] - (z**3).mean()) < 1e-9 and abs(kurt[t, s] - (z**4).mean() + 3) < 1e-9


def test_one_gap_and_causality(spark):
    x = walk(5, 200, 2, 0.0)
    gap = x.copy()
    gap[100, 0] = np.nan
    slope = back(ts.regressions(panel(spark, gap), "x", 20, {"slope": "y"}), "y", x.shape)[:, 0]
    assert np.isnan(slope[100:120]).all() and not np.isnan(slope[120:]).any()
    later = x.copy()
    later[120:] += 5
    texts = {
        "a": parse("ts_rank20(close)"), "b": parse("ema12(close)"), "c": parse("ts_resi20(close)"),
        "d": parse("corr20(close, ts_delay1(close))"),
    }
    one, two = (evaluate(panel(spark, v, "close"), texts) for v in (x, later))
    for k in texts:
        np.testing.assert_allclose(back(one, k, x.shape)[:120], back(two, k, x.shape)[:120], atol=1e-10)


def test_sections(spark):
    x = np.round(walk(6), 0)
    frame = panel(spark, x).withColumns({"p": cs.cs_rank(F.col("x")), "d": cs.cs_demean(F.col("x")), "o": cs.ordinal_rank(F.col("x"))})
    np.testing.assert_allclose(back(frame, "p", x.shape), pd.DataFrame(x).rank(axis=1, pct=True).to_numpy(), atol=1e-12)
    np.testing.assert_allclose(back(frame, "d", x.shape), x - np.nanmean(x, axis=1, keepdims=True), atol=1e-12)
    o = back(frame, "o", x.shape)
    assert np.nanmin(o) == 0 and np.nanmax(o) == 1


@pytest.mark.parametrize("n", [50, 64, 103, 200])
def test_equal_count_buckets_match_pandas(spark, n):
    x = np.random.default_rng(n).normal(size=(1, n))
    got = back(panel(spark, x).withColumn("b", cs.bucket_qcut(F.col("x"))), "b", x.shape)[0]
    assert (got == pd.qcut(pd.Series(x[0]).rank(method="first"), 10, labels=False).to_numpy()).all()


def test_neutralisation_leaves_no_correlation(spark):
    rng = np.random.default_rng(7)
    z1, z2 = rng.normal(size=(4, 120)), rng.normal(size=(4, 120))
    y = 2 * z1 - z2 + rng.normal(size=(4, 120))
    frame = panel(spark, y, "f").join(panel(spark, z1, "z1"), ["sym", "t"]).join(panel(spark, z2, "z2"), ["sym", "t"])
    two = frame.withColumn("e", cs.residual_two(F.col("f"), F.col("z1"), F.col("z2")))
    many = ev.many_regressor_residual(frame, "f", ["z1", "z2"], least=100)
    a, b = back(two, "e", y.shape), back(many, "residual", y.shape)
    np.testing.assert_allclose(a, b, atol=1e-8)
    for t in range(4):
        design = np.column_stack([np.ones(120), z1[t], z2[t]])
        np.testing.assert_allclose(a[t], y[t] - design @ np.linalg.lstsq(design, y[t], rcond=None)[0], atol=1e-8)


def rows_of(spark, seed=8, rows=80, cols=130):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=(rows, cols))
    close = np.exp(np.cumsum(rng.normal(0.0, 0.02, size=(rows, cols)) + np.vstack([np.zeros((2, cols)), 0.01 * f[:-2]]), axis=0))
    frame = panel(spark, f, "f").join(panel(spark, close, "close"), ["sym", "t"]).join(
        panel(spark, np.full(f.shape, 3.0), "mktcap"), ["sym", "t"],
    )
    return f, close, frame


def test_ic_of_a_factor_with_itself(spark):
    _, _, frame = rows_of(spark)
    for sign in (1, -1):
        s = ev.ic_summary(ev.daily_ic(frame.withColumn("r", F.col("f") * sign))).head()
        assert abs(s["ic"] - sign) < 1e-9 and s["ic_win"] == (sign > 0)
    assert ev.daily_ic(frame.withColumn("r", F.lit(1.0))).where("ic is not null").count() == 0


def test_backtest_identities(spark):
    f, close, frame = rows_of(spark)
    traded = bt.trades(frame, limit=0.9)
    per = bt.periods(traded, weight="cap").cache()
    got = {r["t"]: r for r in per.collect()}
    for t in range(0, 70, 5):
        ret = close[t + 6] / close[t + 1] - 1
        top = f[t] >= np.sort(f[t])[-13]
        assert abs(got[t]["top_ret"] - ret[top].mean()) < 1e-9
        assert abs(got[t]["pool_ret"] - ret.mean()) < 1e-9 and abs(got[t]["pool_ret_w"] - ret.mean()) < 1e-12
        if t:
            before = f[t - 5] >= np.sort(f[t - 5])[-13]
            assert abs(got[t]["turn"] - (1 - (top & before).sum() / 13)) < 1e-12
    marks = bt.daily_marks(frame, per, bt.chosen(traded)).toPandas()
    for t, g in marks.groupby("t"):
        assert abs(np.prod(1 + g["mark"]) - 1 - got[t]["excess"]) < 1e-9 and abs(np.prod(1 + g["own"]) - 1 - got[t]["net"]) < 1e-9
    m = bt.metrics(per).head()
    nav = np.cumprod([1 + got[t]["excess"] for t in sorted(got)])
    assert abs(m["dd"] - (nav / np.maximum.accumulate(nav) - 1).min()) < 1e-9
    assert abs(m["ann_ex"] - (nav[-1] ** (243 / (5 * len(nav))) - 1)) < 1e-9


def test_unsellable_rows_delay_the_sale(spark):
    close = np.array([[10.0, 10.0, 10.0, 8.0, 6.4, 6.4, 7.0, 7.0]]).T
    r = {x["t"]: x for x in bt.with_tradability(panel(spark, close, "close")).collect()}
    assert r[3]["next_sell"] == 5 and r[5]["next_sell"] == 5 and not r[6]["never_sold"]


def test_streams(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=300)
    data = {1: a, 2: -a, 3: rng.normal(size=300), 4: 0.7 * a + 0.3 * rng.normal(size=300)}
    rows = [(k, t, float(v[t])) for k, v in data.items() for t in range(300)] + [(5, t, float(a[t])) for t in range(10)] + [(6, t, 1.0) for t in range(400, 500)]
    got = {(r["a"], r["b"]): r["corr"] for r in cb.stream_correlations(spark.createDataFrame(rows, "id long, t long, x double")).collect()}
    assert abs(got[1, 2] + 1) < 1e-9 and abs(got[1, 3]) < 0.2 and 0.4 < got[1, 4] < 1 and got[1, 5] is None and (1, 6) not in got


def test_as_of(spark):
    rng = random.Random(1)
    left = [(i, rng.randint(0, 3), rng.randint(0, 50)) for i in range(100)]
    right = [(k, t, float(100 * k + t)) for k in range(3) for t in rng.sample(range(50), 12)]
    l_, r_ = spark.createDataFrame(left, "i long, sym long, t long"), spark.createDataFrame(right, "sym long, t long, v double")
    for strict in (False, True):
        for r in cb.as_of(l_, r_, "sym", "t", ["v"], strict).collect():
            old = [(t, v) for k, t, v in right if k == r["sym"] and (t < r["t"] or (t == r["t"] and not strict))]
            assert r["v"] == (max(old)[1] if old else None)


def test_gates(spark):
    rows = [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)]
    both, either = (control.combined(F.lit(True), F.col("a"), F.col("b"), F.col("c"), either=e) for e in (False, True))
    for r in spark.createDataFrame(rows, "a boolean, b boolean, c boolean").select(
        "a", "b", "c", both.alias("g"), either.alias("e"),
    ).collect():
        whole, hard = r["a"] is True, r["c"] is True
        assert r["g"] == (hard and whole and r["b"] is not False) and r["e"] == (hard and (whole or r["b"] is True))
    grades = spark.createDataFrame(
        [
            (None, 0.1, None), (0.5, None, None), (0.5, -0.1, 0.0), (-0.1, 0.1, 0.0), (0.2, 0.1, -0.1), (0.3, 0.1, -0.2), (0.3, 0.1, -0.19),
            (0.3, 0.1, None),
        ],
        "c double, x double, d double",
    )
    assert [r[0] for r in grades.select(control.strip_grade(F.col("c"), F.col("x"), F.col("d"))).collect()] == list("DDCCBBAA")
    held = spark.createDataFrame(
        [(0, 119), (1, 120), (2, 120), (None, 500)], "p int, n int",
    ).select(control.segments_hold(F.col("p"), F.col("n")))
    assert [r[0] for r in held.collect()] == [True, False, True, False]
    got = spark.createDataFrame([(0.5, None), (0.1, 2.0)], "m double, k double").select(
        control.rule("m >= 0.3 and k < 5").alias("r"), control.pool_gate([F.col("k")], 1.0).alias("p"),
    ).collect()
    assert [tuple(r) for r in got] == [(False, None), (False, True)]
    with pytest.raises(ValueError):
        control.rule("m like 3")


def test_scalar_edges(spark):
    r = spark.createDataFrame([(0.0, None, "0000-00-00")], "x double, y double, d string").select(
        scalar.safe_log(F.col("x")).alias("l"), scalar.safe_log(F.col("y")).alias("ln"), scalar.safe_div(F.lit(1.0), F.col("x")).alias("q"), scalar.higher_of(F.col("x"), F.col("y")).alias("h"), scalar.date_key(F.col("d")).alias("d")
    ).head()
    assert abs(r["l"] - math.log(1e-9)) < 1e-12 and (r["ln"], r["q"], r["h"], r["d"]) == (None, None, None, None)


def test_expressions():
    n = parse("sub(ts_mean5(overnight), ts_mean20(overnight))")
    assert from_json(to_json(n)) == n == parse(str(n)) and skeleton(n) == "sub(ts_mean(.),ts_mean(.))"
    for bad in (
        "sub(close)", "close close", "nothing(close)", "ts_mean5(nowhere)", "add(close, open", "ts_mean5(" * 20 + "close" + ")" * 20,
        "close;",
    ):
        with pytest.raises(ExpressionError):
            parse(bad)
    assert review(parse("add(close, volume)")) and review(parse("sub(close, close)")) and review(parse("div(open, open)")) and not review(parse("add(close, open)"))
    assert is_style_combination(parse("div(barra_size, close)")) and not is_style_combination(
        parse("sub(ts_mean5(ret), div(ret, mul(amplitude, add(ret, barra_size))))")
    )
    assert len(registry.LEAVES) == 68 and len(registry.OPERATORS) == 68


def test_user_operators_and_shared_subtrees(spark):
    registry.register("half", 1, "row", lambda x: x / 2)
    try:
        frame = evaluate(panel(spark, walk(10), "close"), {"a": parse("half(ts_mean5(close))"), "b": parse("cs_rank(ts_mean5(close))")})
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(sym") <= 1
        assert frame.count() == 50 * 13
    finally:
        del registry.OPERATORS["half"]


def test_store(spark, tmp_path):
    x = walk(12)
    values = panel(spark, x, "value")
    for name in ("one", "two"):
        store.write_factor(values, f"{tmp_path}/f", name)
    store.write_factor(values.where("t < 10"), f"{tmp_path}/f", "two")
    assert {(r["factor_id"], r["rows"]) for r in store.list_factors(spark, f"{tmp_path}/f").collect()} == {("one", 650), ("two", 130)}
    codes = back(store.quantised(values), "code", x.shape)
    assert np.isnan(codes[np.isnan(x)]).all() and np.nanmax(codes) <= 255
    store.append(spark.createDataFrame([(1, 2)], "a long, b long"), f"{tmp_path}/t")
    store.append(spark.createDataFrame([(3, "c")], "a long, c string"), f"{tmp_path}/t")
    merged = store.read_merged(spark, f"{tmp_path}/t")
    assert set(merged.columns) == {"a", "b", "c"} and merged.count() == 2
    up = store.upserted(
        spark.createDataFrame([(1, 1), (2, 2)], "k long, v long"), spark.createDataFrame([(2, 5), (3, 6)], "k long, v long"), ["k"],
    )
    assert {tuple(r) for r in up.collect()} == {(1, 1), (2, 5), (3, 6)}
    last = store.latest(spark.createDataFrame([(1, 1, 7.0), (1, 2, 8.0)], "k long, at long, v double"), ["k"], ["at"])
    assert [r["v"] for r in last.collect()] == [8.0]


def test_raw_files_and_reports(spark, tmp_path):
    os.makedirs(f"{tmp_path}/csv")
    open(f"{tmp_path}/csv/a.csv", "w").write("code;date;buy\n600000.SH;20200131;1.5\n1;2020-02-03;2\nx;20200131;3\n600000;0000-00-00;9\n")
    assert store.sniff(spark, f"{tmp_path}/csv") == ("UTF-8", ";")
    flow = store.read_money_flow(spark, f"{tmp_path}/csv", sep=";")
    assert {tuple(r) for r in flow.collect()} == {("600000.XSHG", 20200131, 1.5), ("000001.XSHE", 20200203, 2.0)}
    prices = spark.createDataFrame(
        [("600000.XSHG", 20200131, 1.0), ("600000.XSHG", 20200201, 1.0), ("600000.XSHG", 20200202, None)],
        "sym string, date int, close double",
    )
    got = [r["buy"] for r in store.money_flow_leaves(flow, prices, ["buy"], []).orderBy("date").collect()]
    assert got == [15000.0, 0.0, None]
    reports = spark.createDataFrame(
        [(1, 8000, 10, 1.0), (1, 8001, 20, 3.0), (1, 8000, 30, 9.0), (1, 8001, 40, 4.0)],
        "sym long, quarter long, info_date long, np double",
    )
    dates = spark.createDataFrame([(1, d) for d in (5, 10, 11, 25, 35, 45)], "sym long, date long")
    known = [(r["date"], r["known_quarter"], r["np"]) for r in store.point_in_time(reports, dates, ["np"]).orderBy("date").collect()]
    assert known == [(5, None, None), (10, None, None), (11, 8000, 1.0), (25, 8001, 3.0), (35, 8001, 3.0), (45, 8001, 4.0)]
    ytd = spark.createDataFrame([(1, 8000 + i, float(10 + i)) for i in range(8)], "sym long, quarter long, rev double")
    ttm = {r["quarter"]: r["ttm"] for r in store.trailing_year(ytd, "rev").collect()}
    assert ttm[8003] is None and ttm[8007] == 17.0 and ttm[8004] == 14.0 + 13.0 - 10.0 and ttm[8000] is None


def test_streaming_bars_and_ema(spark, tmp_path):
    rows = [(i % 3, f"2024-01-0{1 + i // 20} 00:{i % 60:02d}:00", float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    for name, frame, mode in (("bars_out", bars.bars(stream), "complete"), ("ema_out", bars.running_ema(stream, 5), "append")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    batch = {tuple(r) for r in bars.bars(table).collect()}
    assert {tuple(r) for r in spark.table("bars_out").collect()} == batch and len(batch) == 9
    got = {(r["sym"], r["at"]): r["ema"] for r in spark.table("ema_out").collect()}
    for s in range(3):
        e = None
        mine = sorted((r for r in table.collect() if r["user_id"] == s), key=lambda r: r["ts"])
        for n, r in enumerate(mine, 1):
            e = r["value"] if e is None else e + (r["value"] - e) / 3
            x = got[s, r["ts"]]
            assert (x is None) == (n < 5) and (x is None or abs(x - e) < 1e-9)


def test_entry_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 60


def test_kept_panels_refuse_stale_reads(spark, tmp_path):
    frame = panel(spark, walk(13))
    store.keep_panel(frame, str(tmp_path), "v1")
    assert store.open_panel(spark, str(tmp_path), "v1", ["x"]).count() == 650
    for fingerprint, columns in (("v2", None), ("v1", ["y"])):
        with pytest.raises(store.StalePanel):
            store.open_panel(spark, str(tmp_path), fingerprint, columns)


def test_turnover_is_against_the_last_accepted_period(spark):
    rng = np.random.default_rng(31)
    f, close = rng.normal(size=(40, 60)), np.exp(rng.normal(0, 0.01, (40, 60)).cumsum(axis=0))
    f[5, 20:] = np.nan  # the second period has too few names
    frame = panel(spark, f, "f").join(panel(spark, close, "close"), ["sym", "t"]).withColumns(
        {"mktcap": F.lit(1.0), "turnover": F.when((F.col("t") != 11) | (F.col("sym") != 3), 1.0).otherwise(0.0)}
    )
    traded = bt.trades(frame, limit=0.9)
    got = {r["t"]: r for r in bt.periods(traded, least=50, least_top=2, least_pool=20, cost=0.01, cash=0.9).collect()}
    assert 5 not in got and got[0]["turn"] == 1.0
    top = lambda t: set(np.argsort(f[t])[-6:].tolist())
    assert abs(got[10]["turn"] - (1 - len(top(10) & top(0)) / 6)) < 1e-12
    ret = close[16] / close[11] - 1
    names = sorted(top(10) - {3})  # symbol 3 isn't traded on the buying row
    assert abs(got[10]["net"] - (0.9 * ret[names].mean() - 0.01 * got[10]["turn"])) < 1e-9
    assert got[10]["n_can"] == 59
    assert bt.record(traded.withColumn("date", F.lit(202001)), least=50, least_top=2, least_pool=20).count() == 0  # fewer than 30 periods


def test_unlike_weights_against_a_loop(spark):
    rng = np.random.default_rng(17)
    a = rng.normal(0.1, 1, 100)
    data = {"a": a, "b": a + rng.normal(0, 0.2, 100), "c": rng.normal(0.05, 1, 100), "d": rng.normal(-0.2, 1, 100)}
    rows = [(k, t, float(v[t])) for k, v in data.items() for t in range(100)]
    got = {}
    for r in pf.unlike_weights(spark.createDataFrame(rows, "id string, t long, x double"), 20, 40, 30, 0.5).collect():
        got.setdefault(r["t"], {})[r["id"]] = r["w"]
    want = {}
    for at in (40, 60, 80, 100):
        part = pd.DataFrame({k: v[max(0, at - 40) : at] for k, v in data.items()})
        score, corr, taken = part.mean() / part.std(), part.rank().corr(), []
        for k in score.sort_values(ascending=False).index:
            if all(abs(corr.loc[k, j]) < 0.5 for j in taken):
                taken.append(k)
        want[at] = dict.fromkeys(taken, 1 / len(taken))
    assert got == want and all(len({"a", "b"} & set(w)) == 1 for w in want.values())


def test_result_tables_and_readers(spark, tmp_path):
    left = spark.createDataFrame([("1 ", "x"), ("2", "y")], "gen string, expr string")
    right = spark.createDataFrame([(1, "x", 5.0), (3, "z", 6.0)], "gen int, expr string, v double")
    assert [r["v"] for r in store.joined_results(left, right, ["gen", "expr"]).orderBy("expr").collect()] == [5.0, None]
    merged = store.with_fallback(
        spark.createDataFrame([(1, None), (2, 2.0)], "k long, v double"),
        spark.createDataFrame([(1, 7.0), (2, 8.0), (3, 9.0)], "k long, v double"), ["k"],
    )
    assert sorted(map(tuple, merged.collect())) == [(1, 7.0), (2, 2.0), (3, 9.0)]
    flows = spark.createDataFrame([("a", 20200105, 1.0), ("b", 20200105, 2.0), ("a", 20210105, 3.0)], "sym string, date int, v double")
    leaves.write_flows(flows, f"{tmp_path}/flows")
    assert [r["v"] for r in leaves.read_flows(spark, f"{tmp_path}/flows", 20200101, 20201231, ["a"]).collect()] == [1.0]
    plan = leaves.read_flows(spark, f"{tmp_path}/flows", 20210101)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    for _ in range(2):
        store.write_entries(flows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    values = panel(spark, walk(3, 20, 4), "value")
    store.write_factor(values, f"{tmp_path}/f", "one")
    assert store.read_factor(
        spark, f"{tmp_path}/f", "one", 3, 5, [1, 2],
    ).count() == 6 and store.read_factor(spark, f"{tmp_path}/f", "one", on=[7]).count() == 4
    assert store.recent(values, 5, 3).count() == 20 and store.recent(values, 50, 30).count() == 80
    text = spark.createDataFrame([("so {\"a\": {\"b\": 1}} it is",), ("none {broken",), (None,)], "x string")
    assert [r[0] for r in text.select(scalar.json_object(F.col("x"))).collect()] == ['{"a": {"b": 1}}', None, None]
    curve = spark.createDataFrame([("k", i) for i in range(100)] + [("s", i) for i in range(4)], "key string, i long")
    kept = rp.thinned(curve, ["key"], "i", 10).collect()
    assert [r["i"] for r in kept if r["key"] == "k"] == [
        math.floor(j * 99 / 9) for j in range(10)
    ] and sum(r["key"] == "s" for r in kept) == 4
    assert [
        r[0] for r in spark.createDataFrame([(0.5,), (float("nan"),), (2.5,)], "x double").select(scalar.shown(F.col("x"), 0)).collect()
    ] == [0.0, None, 2.0]


def test_files_of_different_kinds_and_fingerprints(spark, tmp_path):
    os.makedirs(f"{tmp_path}/csv")
    open(f"{tmp_path}/csv/a.csv", "w").write("code;date;buy\n600000.SH;20200131;1.5\n")
    open(f"{tmp_path}/csv/b.csv", "w", encoding="GBK").write("code,date,buy,名\n1,2020-02-03,2,名\n600000,20200131,1,名\n")
    got = {(r["sym"], r["date"]): r["buy"] for r in store.read_money_flows(spark, f"{tmp_path}/csv").collect()}
    assert got == {("600000.XSHG", 20200131): 1.5, ("000001.XSHE", 20200203): 2.0}
    one = store.fingerprint(spark, [f"{tmp_path}/csv"], store.upserted)
    assert one == store.fingerprint(
        spark, [f"{tmp_path}/csv"], store.upserted,
    ) != store.fingerprint(spark, [f"{tmp_path}/csv"], store.latest)
    open(f"{tmp_path}/csv/a.csv", "a").write("600001.SH;20200131;1.5\n")
    assert one != store.fingerprint(spark, [f"{tmp_path}/csv"], store.upserted)


def test_expressions_run_on_leaves_of_any_store(spark):
    base = panel(spark, walk(41, 30, 5), "close").withColumns({"date": F.col("t"), "mktcap": F.lit(2.0), "fa_gm": F.col("close") * 2})
    whole = leaves.complete(base)
    assert set(registry.LEAVES) <= set(whole.columns)
    made = evaluate(whole, {"a": parse("cs_rank(fa_gm)"), "b": parse("add(barra_size, mg_bal_ratio)"), "c": parse("cs_rank(close)")}).toPandas()
    assert made["b"].isna().all() and made["a"].equals(made["c"]) and made["a"].notna().any()
