"""Factors replaced under a reader, upserts that rewrite few folders, and small files of many kinds."""

import os

from pyspark.sql import functions as F

from stratapanel.sources import store
from stratapanel.sources.versions import KeyedTable, swept


def test_a_reader_sees_one_version_of_a_factor(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    rows = lambda n, v: spark.range(n).selectExpr("id % 3 as sym", "id div 3 as t", f"cast({v} as double) as value")
    store.write_factor(rows(30, 1), path, "one", source="first")
    store.write_factor(rows(6, 5), path, "two")
    before = store.open_factors(spark, path)
    store.write_factor(rows(12, 2), path, "one", source="second")
    assert {(r["factor_id"], r["value"], r["n"]) for r in before.groupBy("factor_id", "value").agg(F.count("*").alias("n")).collect()} == {("one", 1.0, 30), ("two", 5.0, 6)}
    assert {r["value"] for r in store.read_factor(spark, path, "one").collect()} == {2.0} and store.read_factor(spark, path, "one", first=3).count() == 3
    told = {r["factor_id"]: (r["rows"], r["first"], r["last"], r["meta"]) for r in store.list_factors(spark, path).collect()}
    assert told == {"one": (12, 0, 3, '{"source": "second"}'), "two": (6, 0, 1, "{}")}
    assert len(swept(store.factor_log(spark, path))) == 1 and store.open_factors(spark, path).count() == 18


def test_upsert_rewrites_only_what_it_meets(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/k", "k")
    table.write(spark.range(1000).selectExpr("id as k", "'old' as v"), folders=10)
    assert len(table.log.held()) == 10
    before = table.read()
    folders = {r["folder"] for r in table.log.held()}
    new = spark.createDataFrame([(5, "new"), (7, "new"), (-3, "new"), (2000, "new")], "k long, v string")
    assert table.upsert(new) == 2
    assert len(folders & {r["folder"] for r in table.log.held()}) == 8
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {k: "old" for k in range(1000)} | {5: "new", 7: "new", -3: "new", 2000: "new"}
    assert before.where("v = 'new'").count() == 0 and before.count() == 1000
    assert len(swept(table.log)) == 2 and table.read().count() == 1002
    words = KeyedTable(spark, f"file://{tmp_path}/w", "k")
    assert words.upsert(spark.createDataFrame([("a", 1), ("m", 2), ("z", 3)], "k string, v int")) >= 1
    words.upsert(spark.createDataFrame([("m", 9)], "k string, v int"))
    assert {r["k"]: r["v"] for r in words.read().collect()} == {"a": 1, "m": 9, "z": 3}


def test_many_small_files_of_many_kinds_are_two_jobs(spark, tmp_path):
    os.makedirs(f"{tmp_path}/csv")
    want = {}
    for i in range(40):
        sep, encoding = ",;\t|"[i % 4], ("UTF-8", "GBK")[i % 2]
        names = ["code", "date", "buy", "sell"] if i % 3 else ["date", "sell", "code", "名"]
        value = {"code": f"{600000 + i}.SH", "date": "2020-02-03", "buy": str(i), "sell": f"{i}.5", "名": "中文" if i % 2 else "x"}
        cell = lambda v, sep=sep: f'"{v}{sep}"' if v == "中文" else v
        body = sep.join(names) + "\r\n" * (i % 2) + "\n" * (1 - i % 2) + sep.join(cell(value[n]) for n in names) + "\n"
        with open(f"{tmp_path}/csv/{i}.csv", "w", encoding=encoding, newline="") as f:
            f.write(body)
        want[f"{600000 + i}.XSHG"] = (20200203, float(i) if i % 3 else None, i + 0.5, None)
    open(f"{tmp_path}/csv/empty.csv", "w").close()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("flows", "flows")
    found = store.read_money_flows(spark, f"{tmp_path}/csv")
    assert len(tracker.getJobIdsForGroup("flows")) <= 2
    got = {r["sym"]: (r["date"], r["buy"], r["sell"], r["名"]) for r in found.collect()}
    spark.sparkContext.setJobGroup("", "")
    assert got == want
