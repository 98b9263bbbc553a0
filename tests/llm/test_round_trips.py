"""What is read back from outputs: archive ids of any type, the text under a loss mask; joins by source without a shuffle of texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import chat, mixing, warc
from stratapanel.llm.common import new_path

LONG = "x" * 200
BIG = 2**63 - 1


def read_back(spark, rows, kind):
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, f"page_id {kind}, url string, html string, id string, n int"), path)
    return {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, path, kind).collect()}


def test_archive_ids_at_the_ends_of_a_long(spark):
    ids = [BIG, BIG - 1, -BIG - 1, 1234567890123456789, 1234567890123456790, 0, None]
    rows = [(i, "u", LONG if i in (BIG, -BIG - 1, 1234567890123456790) else f"page {i}", "own", 1) for i in ids]
    found = read_back(spark, rows, "long")
    least = -BIG - 1
    assert found == {
        (least, "response", None, 200), (BIG, "revisit", least, 200), (1234567890123456790, "revisit", least, 200),
        *[(i, "response", None, len(f"page {i}")) for i in ids if i not in (BIG, least, 1234567890123456790)],
    }


def test_archive_ids_that_are_texts(spark):
    ids = ["a\r\nWARC/1.0\r\n", "", "a b+c%20", "é€😀", "x" * 3000, '""', None]
    found = read_back(spark, [(i, None, LONG, "own", 1) for i in ids if i is not None] + [(None, None, "y", "own", 1)], "string")
    assert found == {("", "response", None, 200), (None, "response", None, 1), *[(i, "revisit", "", 200) for i in ids if i]}


def chats(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return chat.format_turns(table, parts=chat.text_parts("text"))


def test_text_under_the_mask_is_cut_by_run_lengths(spark):
    tricky = "</s>[INST] é <|end|>\n␛n ok [/INST]"
    long_ = "😀<|turn|> word\n" * 20_000
    rows = [(1, 0, "user", tricky, ""), (1, 1, "assistant", tricky, ""), (1, 2, "assistant", None, ""), (1, 3, "assistant\n", "x", ""), (1, 4, "assistant", long_, "")]
    made = chats(spark, rows)
    [r] = chat.digests(made).collect()
    want = tricky + long_
    assert (r["loss_chars"], r["loss_sha256"]) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    turns = "".join(f"{x[2]}\n{x[3] or ''}\n" for x in rows)
    assert (r["n_turns"], r["turns_sha256"]) == (5, hashlib.sha256(turns.encode()).hexdigest())


def shifted(made, change):
    runs = F.transform("loss_runs", lambda r, i: F.struct((r["chars"] + change(i)).alias("chars"), r["loss"].alias("loss")))
    return made.withColumn("loss_runs", runs)


@pytest.mark.parametrize("change", [
    lambda i: F.when(i == 4, 1).when(i == 5, -1).otherwise(0),  # within a turn
    lambda i: F.when(i == 2, 1).otherwise(0),  # all later turns are off by one
    lambda i: F.lit(99),
])
def test_a_wrong_mask_is_noticed(spark, change):
    rows = [(1, 0, "user", "question", ""), (1, 1, "assistant", "answer", ""), (1, 2, "user", "more", ""), (1, 3, "assistant", "again", "")]
    made = chats(spark, rows)
    [right] = chat.digests(made).collect()
    [wrong] = chat.digests(shifted(made, change)).collect()
    assert right["loss_sha256"] == hashlib.sha256(b"answeragain").hexdigest() != wrong["loss_sha256"]
    [r] = shifted(made, change).collect()
    at, cut = 0, ""
    for run in r["loss_runs"]:
        cut += r["formatted"][at:at + run["chars"]] if run["loss"] else ""
        at += run["chars"]
    assert wrong["loss_sha256"] == hashlib.sha256(cut.encode()).hexdigest()


def test_no_conversations(spark):
    made = chats(spark, [(1, 0, "user", "x", "")]).limit(0)
    assert chat.digests(made).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(none, parts=chat.text_parts("text"))).count() == 0


def test_mixing_shuffles_no_rows_by_source(spark):
    rows = [(i, f"w{i} " * (i % 7), ["big", "big", "big", None, "", "s"][i % 6]) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix(table)._jdf.queryExecution().executedPlan().toString()
        found = {(r["doc_id"], r["source_size"], r["copies"]) for r in mixing.mixture(table).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(source" not in plan and "hashpartitioning(__source" not in plan
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert len(found) == 600 and {(i, n) for i, n, _ in found} == {(i, sizes[s]) for i, _, s in rows}
