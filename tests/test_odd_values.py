"""Queries against their SQL where prices are zero, means tie and figures are huge."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel import catalog
from stratapanel.functions.scalar import ieee_div, rounded
from stratapanel.functions.scan import scan, scans


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Few events a user, so that windows of 5 and 10 days often hold the same ones; some values are zero."""
    rng = np.random.default_rng(11)
    n = 1200
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 86_400, n), unit="s")
    value = np.where(rng.random(n) < 0.04, 0.0, np.round(rng.gamma(2.0, 30.0, n), 2))
    folder = tmp_path_factory.mktemp("events")
    pd.DataFrame({"event_id": np.arange(n), "ts": ts.astype("datetime64[us]"), "user_id": rng.integers(0, 150, n), "value": value}).to_parquet(folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["ic_daily", "leaves_daily"])
def test_daily_queries_equal_their_sql(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    plain = lambda rows: sorted((tuple(str(v) for v in r) for r in rows))
    got = [tuple(r[c] for c in names) for r in catalog.queries()[name](spark, events).collect()]
    assert plain(got) == plain(want)
    if name == "leaves_daily":
        assert any(v is not None and math.isinf(v) for r in got for v in r)


def test_division_as_sql_on_doubles_has_it(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 3.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in rows.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [1 / 3, None, None]


def test_rounding_of_what_a_long_does_not_hold(spark):
    held = [6480213935790317.0, 1e300, -1e20, math.inf, -math.inf, 0.1234567, -0.1, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in held], "x double").select(rounded(F.col("x"))).collect()]
    assert got[0] == pytest.approx(held[0], rel=1e-15) and got[1] == pytest.approx(1e300) and got[2] == pytest.approx(-1e20)
    assert got[3:5] == [math.inf, -math.inf] and got[5:] == [0.123457, -0.1, None]


def test_means_of_the_same_values_are_equal_whatever_the_window(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(np.round(rng.gamma(2.0, 30.0), 2)) if t >= 11 and rng.random() < 0.8 else None) for s in range(200) for t in range(16)]
    made = scans(spark.createDataFrame(rows, "sym long, t long, x double"), {f"m{w}": scan("mean", "x", w, least=2) for w in (5, 10)})
    last = made.where("t = 15 and m5 is not null")
    assert last.count() > 150 and last.where("m5 - m10 <> 0").count() == 0
