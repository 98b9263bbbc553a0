"""Admission against the loop, correlations by tiles against pandas, weights by equal dates against a loop over evaluations."""

import random

import numpy as np
import pandas as pd

from stratapanel.operators import combination as cb
from stratapanel.operators import portfolios as pf
from stratapanel.operators import selection

NODE = "id long, score double, skeleton string, held boolean, barred boolean"


def loop(nodes, conflicts, most):
    near = {}
    for a, b in conflicts:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, kinds, out = set(), {}, {}
    for i, score, kind, held, barred in sorted(nodes, key=lambda n: (not n[3], -n[1] if n[1] is not None else float("inf"), n[0])):
        why = None if held else "barred" if barred else "full" if most is not None and kinds.get(kind, 0) >= most else "like" if near.get(i, set()) & taken else None
        out[i] = (why is None, why)
        if why is None:
            taken.add(i)
            kinds[kind] = kinds.get(kind, 0) + 1
    return out


def test_admission_is_the_loop_on_random_graphs(spark):
    for seed, most in ((1, 3), (2, None), (3, 1)):
        rng = random.Random(seed)
        nodes = [(i, rng.choice([None, *range(8)]), rng.choice(["a", "b", "c", None]), rng.random() < 0.05, rng.random() < 0.1) for i in range(80)]
        nodes = [(i, None if s is None else float(s), k, h, b and not h) for i, s, k, h, b in nodes]
        pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(120)]
        found = selection.admit(spark.createDataFrame(nodes, NODE), spark.createDataFrame(pairs, "a long, b long"), most)
        assert {r["id"]: (r["admitted"], r["reason"]) for r in found.collect()} == loop(nodes, pairs, most)


def test_admission_by_streams_is_the_loop_and_makes_no_table_of_pairs(spark, monkeypatch):
    def no_pairs(*_, **__):
        raise AssertionError("all pairs")

    for seed, most, gaps in ((1, 3, 0.0), (2, None, 0.3), (3, 1, 0.1), (4, 0, 0.1)):
        rng = np.random.default_rng(seed)
        x = np.round(rng.standard_normal((40, 70)) + rng.standard_normal((40, 1)) * (rng.random(70) < 0.3), 1)
        x[rng.random(x.shape) < gaps] = np.nan
        x[:, 20:40] = x[:, :20]  # copies
        x[:, 5], x[:, 6], x[:, 7], x[5:, 8] = 1.0, 1.0, np.nan, np.nan  # flat, missing and short streams
        pick = random.Random(seed)
        nodes = [(i, pick.choice([None, *range(8)]), pick.choice(["a", "b", "c", None]), pick.random() < 0.05, pick.random() < 0.1) for i in range(70)]
        nodes = [(i, None if s is None else float(s), k, h, b and not h) for i, s, k, h, b in nodes]
        corr = pd.DataFrame(x).corr(method="spearman", min_periods=12)
        pairs = [(a, b) for a in range(70) for b in range(a) if abs(corr.loc[a, b]) > 0.3]
        rows = [(i, t, None if np.isnan(x[t, i]) else float(x[t, i])) for t in range(40) for i in range(70)]
        monkeypatch.setattr(cb, "stream_correlations", no_pairs)
        for head in (4, 256):
            found = selection.admit_streams(spark.createDataFrame(nodes, NODE), spark.createDataFrame(rows, "id long, t long, x double"), 0.3, 12, most, head)
            assert {r["id"]: (r["admitted"], r["reason"]) for r in found.collect()} == loop(nodes, pairs, most)


def test_admission_of_nothing(spark):
    assert selection.admit(spark.createDataFrame([], NODE), spark.createDataFrame([], "a long, b long"), 3).count() == 0


def test_tiles_against_pandas_with_and_without_gaps(spark):
    rng = np.random.default_rng(5)
    for gaps in (0.0, 0.3):
        x = np.round(rng.standard_normal((120, 30)) + rng.standard_normal((120, 1)), 1)
        x[:, 3] = 1.0
        x[rng.random(x.shape) < gaps] = np.nan
        rows = [(int(i), int(t), None if np.isnan(x[t, i]) else float(x[t, i])) for t in range(120) for i in range(30)]
        table = spark.createDataFrame(rows, "id long, t long, x double")
        found = cb.stream_correlations(table, least=40, tile=7)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in found.collect()}
        frame = pd.DataFrame(x)
        want = frame.corr(method="spearman", min_periods=40)
        assert len(got) == 30 * 29 // 2
        for (a, b), (n, c) in got.items():
            assert a < b and n == (frame[a].notna() & frame[b].notna()).sum()
            assert (c is None) == bool(np.isnan(want.loc[a, b])) and (c is None or abs(c - want.loc[a, b]) < 1e-12)


def test_many_streams_make_no_row_per_pair_and_date(spark):
    streams = spark.range(200 * 60).selectExpr("id % 200 as id", "id div 200 as t", "rand(1) as x")
    assert cb.stream_correlations(streams).where("corr is not null").count() == 199 * 100


def test_weights_meet_dates_by_equality(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{i}", int(t), float(rng.standard_normal())) for t in sorted(rng.choice(200, 120, replace=False)) for i in range(4)]
    made = pf.unlike_weights(spark.createDataFrame(rows, "id string, t long, x double"), 20, 40, 30, 0.5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    by = {}
    for r in made.collect():
        by.setdefault(r["t"], {})[r["id"]] = r["w"]
    dates = sorted({t for _, t, _ in rows})
    for at in range(0, 240, 20):
        past = [t for t in dates if t < at]
        assert (at in by) == (len(past) >= 30 and at <= (max(dates) // 20 + 1) * 20)
    ranks = spark.createDataFrame([(1, t, 0.2, 0.8, None, 0.5) for t in range(0, 240, 10)], "sym long, t long, s0 double, s1 double, s2 double, s3 double")
    for r in cb.combine_by_choice(ranks, made, ["s0", "s1", "s2", "s3"]).collect():
        w = by.get(max([a for a in by if a <= r["t"]], default=None), {})
        held = {"s0": 0.2, "s1": 0.8, "s3": 0.5}
        total = sum(w.get(k, 0.0) for k in held)
        assert (r["combo"] is None) == (total == 0) and (total == 0 or abs(r["combo"] - sum(held[k] * w.get(k, 0.0) for k in held) / total) < 1e-12)


def test_ic_weights_wait_for_thirty_dates(spark):
    ics = spark.createDataFrame([(t, 0.1, -0.2) for t in range(40)], "t long, f double, g double")
    ranks = spark.createDataFrame([(1, t, 0.3, 0.9) for t in range(40)], "sym long, t long, f double, g double")
    found = {r["t"]: r["combo"] for r in cb.combine_by_ic(ranks, ics, ["f", "g"]).collect()}
    assert all(abs(found[t] - (0.6 if t < 30 else 0.3)) < 1e-12 for t in range(40))
