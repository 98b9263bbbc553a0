"""Backtests make the panel they start from once, however many figures and schemes are made of it."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratapanel.operators import backtest as bt
from stratapanel.operators import reports as rp
from stratapanel.registered import portfolios

LEAST = {"least": 30, "least_top": 2, "least_pool": 10, "least_periods": 2}
SYMS, DATES = 80, 40


def counted(spark):
    """A panel, and how many of its rows were made so far."""
    rng = np.random.default_rng(4)
    sym, t = (x.ravel() for x in np.meshgrid(np.arange(SYMS), np.arange(DATES), indexing="ij"))
    close = np.exp(rng.standard_normal((SYMS, DATES)).cumsum(1) * 0.05).ravel() * 10
    made = pd.DataFrame({"sym": sym, "t": t, "date": 202001 + t % 12 + t // 12 * 100, "pool": sym % 3, "close": close, "turnover": close, "mktcap": close, "f": rng.standard_normal(len(sym))})
    rows, seen = spark.createDataFrame(made), spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return rows.mapInPandas(passed, rows.schema), seen


def test_a_record_makes_the_panel_once(spark):
    rows, seen = counted(spark)
    assert bt.record(bt.trades(rows, limit=0.5), **LEAST).count() == 1
    assert seen.value == SYMS * DATES


def test_pools_share_their_trades(spark):
    rows, seen = counted(spark)
    pools = {"all": F.lit(True), "some": F.col("pool") < 2}
    assert rp.combo_check(rows, pools, 0.5, **LEAST).count() == 2
    assert seen.value == SYMS * DATES


def test_schemes_share_their_trades(spark, monkeypatch):
    calls, trades = [], bt.trades
    monkeypatch.setattr(bt, "trades", lambda *a, **k: calls.append(1) or trades(*a, **k))
    assert len(portfolios.combine_choice(spark, "/root/testdata/sf0.01").columns) == 6
    assert len(calls) == 1
