"""Values that follow a growing panel equal a rebuild, and read no older rows than the look-back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.plans.compiler import evaluate
from stratapanel.plans.expr import parse
from stratapanel.sources.incremental import Factors, keep_parts, look_back

TEXTS = {"a": "ts_mean20(close)", "b": "cs_rank(ts_delta5(ts_rank10(close)))", "c": "sub(close, open)"}
AVERAGE = {"d": "sub(ema5(close), ema12(ts_delta5(close)))", "e": "cs_rank(ema5(close))"}
SPAN = 10


def cells(spark, first, last, salt=""):
    rows = spark.range(first * 30, last * 30).selectExpr("id % 30 as sym", "id div 30 as t")
    value = lambda c: F.pmod(F.xxhash64("sym", "t", F.lit(c)), F.lit(1000)) / 10.0
    return rows.withColumns({c: F.when(F.pmod(F.xxhash64("sym", "t", F.lit(c)), F.lit(7)) > 0, value(c + salt)) for c in ("close", "open")})


def plain(texts):
    return {k: parse(v) for k, v in texts.items()}


def same(found, want, names):
    a, b = (f.select("sym", "t", *names).toPandas().sort_values(["sym", "t"]).reset_index(drop=True) for f in (found, want))
    assert len(a) == len(b)
    for c in names:
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-10, atol=1e-10, err_msg=c)


def test_look_back():
    assert [look_back(parse(x)) for x in ("close", "ts_mean20(close)", "ts_delta5(ts_rank10(close))", "add(ts_mean5(close), ts_delay1(open))", "ema60(close)")] == [0, 19, 14, 4, 0]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS | AVERAGE])
def test_a_new_month_equals_a_rebuild_and_reads_its_look_back_only(spark, tmp_path, texts):
    panel, made = f"file://{tmp_path}/panel", f"file://{tmp_path}/made"
    keep_parts(cells(spark, 0, 65), panel, SPAN)
    factors = Factors(spark, panel, made, plain(texts), SPAN)
    assert factors.update() == [(0, 6)]
    same(factors.read(), evaluate(cells(spark, 0, 65), plain(texts)), texts)
    assert factors.update() == []
    keep_parts(cells(spark, 60, 80), panel, SPAN)  # the open part is filled and one is new
    for old in (tmp_path / "panel").glob("part=[0-3]"):
        old.rename(tmp_path / f"away-{old.name}")  # rows before 60 - 19 can't be read any more
    assert factors.update() == [(6, 7)]
    same(factors.read(), evaluate(cells(spark, 0, 80), plain(texts)), texts)


def test_a_changed_part_makes_what_it_reaches_anew(spark, tmp_path):
    panel, made = f"file://{tmp_path}/panel", f"file://{tmp_path}/made"
    keep_parts(cells(spark, 0, 100), panel, SPAN)
    plain_, averaged = Factors(spark, panel, made, plain(TEXTS), SPAN), Factors(spark, panel, made + "-e", plain(AVERAGE), SPAN)
    assert plain_.update() == averaged.update() == [(0, 9)]
    keep_parts(cells(spark, 30, 40, "changed"), panel, SPAN)
    whole = cells(spark, 0, 30).unionByName(cells(spark, 30, 40, "changed")).unionByName(cells(spark, 40, 100))
    assert plain_.update() == [(3, 5)]
    assert averaged.update() == [(3, 9)]
    same(plain_.read(), evaluate(whole, plain(TEXTS)), TEXTS)
    same(averaged.read(), evaluate(whole, plain(AVERAGE)), AVERAGE)


def test_averages_of_averages_are_refused(spark):
    with pytest.raises(ValueError):
        Factors(spark, "a", "b", plain({"x": "ema5(ema12(close))"}), SPAN)
