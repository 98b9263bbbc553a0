"""Values kept between batches: the second batch reads them, and gets what a fresh one would."""

import pytest
from pyspark.sql import functions as F

from stratapanel.plans import registry
from stratapanel.plans.compiler import evaluate
from stratapanel.plans.expr import dimension, parse, review
from stratapanel.plans.reuse import Values
from stratapanel.sources import store

FIRST = {"a": "ts_mean20(close)", "b": "sub(cs_rank(ts_mean20(close)), cs_rank(open))"}
SECOND = {"c": "cs_rank(sub(ts_mean20(close), ts_rank10(open)))", "d": "mul(cs_rank(open), ts_mean20(close))", "e": "close", "b": FIRST["b"]}


@pytest.fixture(scope="module")
def panel(spark):
    cells = spark.range(40 * 60).selectExpr("id % 40 as sym", "id div 40 as t")
    return cells.withColumns({c: F.when(F.pmod(F.xxhash64("sym", "t", F.lit(c)), F.lit(9)) > 0, F.pmod(F.xxhash64("sym", "t", F.lit(c + "x")), F.lit(1000)) / 10.0) for c in ("close", "open")})


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def plain(texts):
    return {k: parse(v) for k, v in texts.items()}


def test_second_batch_reads_what_the_first_one_left(spark, panel, tmp_path):
    store = Values(spark, f"file://{tmp_path}/v", 1 << 30)
    assert rows(store.evaluate(panel, "p1", plain(FIRST))) == rows(evaluate(panel, plain(FIRST)))
    [table] = store.tables()
    assert len(table["columns"]) == 4  # the mean, two ranks, and b
    assert rows(store.evaluate(panel, "p1", plain(SECOND))) == rows(evaluate(panel, plain(SECOND)))
    made = [t for t in store.tables() if t["table"] != table["table"]]
    assert len(made) == 1 and len(made[0]["columns"]) == 3  # the rank along time, c and d
    again = store.evaluate(panel, "p1", plain(SECOND))
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" not in plan
    assert {f.split("/")[-2] for f in again.inputFiles()} == {table["table"], made[0]["table"]}
    assert rows(again) == rows(evaluate(panel, plain(SECOND)))


def test_another_panel_shares_nothing_and_the_budget_holds(spark, panel, tmp_path):
    store = Values(spark, f"file://{tmp_path}/v", 1)
    store.evaluate(panel, "p1", plain(FIRST))
    [first] = store.tables()
    other = panel.withColumn("close", F.col("close") + 1)
    assert rows(store.evaluate(other, "p2", plain(FIRST))) == rows(evaluate(other, plain(FIRST)))
    [second] = store.tables()
    assert first["table"] != second["table"] and second["digest"] == "p2"
    assert not (tmp_path / "v" / first["table"]).exists()


def test_dimensions_that_go_together():
    bad = ("sub(ret, close)", "add(close, volume)", "max(ln_volume, ret)", "sub(turnover, mktcap)", "add(ts_mean5(close), ts_mean5(volume))", "min(add(close, open), ret)")
    good = ("sub(close, open)", "add(cs_rank(close), volume)", "sub(mul(close, volume), turnover)", "min(ret, overnight)", "sub(log(close), ln_volume)", "add(corr20(close, volume), ret)")
    assert all(review(parse(x)) for x in bad) and not any(review(parse(x)) for x in good)
    assert [dimension(parse(x)) for x in ("close", "div(close, volume)", "sub(cs_rank(ret), close)", "sub(ret, close)", "ts_std20(volume)")] == ["P", "C", "C", "X", "V"]


def test_registry_is_exported(spark, tmp_path):
    rows = spark.createDataFrame(registry.entries(), "kind string, name string, arity int, axis string, window int, dimension string")
    store.write_entries(rows, f"file://{tmp_path}/r")
    found = spark.read.json(f"file://{tmp_path}/r")
    assert found.count() == len(registry.OPERATORS) + len(registry.LEAVES) and found.where("name = 'ts_rank200' and window = 200").count() == 1
