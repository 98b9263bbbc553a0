"""Exact dedup, MinHash, mixing, chat, WARC: small fixtures against brute force."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import chat, exactdedup, minhash, mixing, warc
from stratapanel.llm.common import connected_components, likely_among, new_path

DOCS = "doc_id long, text string, source string, keep_id string, h int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "own", 1) for i, t, s in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng, n) for n in (60, 80, 200, 7, 4, 3000)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(base)]
    rows += [(10 + k, base[0], "a") for k in range(12)]
    for k in range(30):
        w = base[2].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((100 + k, " ".join(w), "b"))
    rows += [(200, None, None), (201, "", "c"), (202, "   ", "c"), (203, base[5] + " tail", "c"), (204, base[4], None), (205, base[1], "b"), (205, base[1], "b")]
    return rows


def test_exact_groups(spark, corpus):
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exactdedup.exact_groups(docs(spark, corpus), capacity=4).collect()}
    by = {}
    for i, t, _ in corpus:
        by.setdefault(t or "", []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    assert found == want


def test_exact_dedup_keeps_columns_and_takes_empty_tables(spark, corpus):
    table = docs(spark, corpus)
    kept = exactdedup.deduplicate(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {max(i for i, t, _ in corpus if (t or "") == x) for x in {t or "" for _, t, _ in corpus}}
    assert exactdedup.exact_groups(table.limit(0)).count() == 0


def test_exact_dedup_decides_per_row(spark):
    rows = [(7, "a", "x"), (7, "b", "x"), (9, "a", "x"), (None, "a", "x"), (None, "c", "x"), (None, None, "x"), (8, "d", "x"), (8, "d", "x")]
    kept = sorted(((r["doc_id"], r["text"]) for r in exactdedup.deduplicate(docs(spark, rows)).collect()), key=str)
    assert kept == sorted([(7, "b"), (9, "a"), (None, "c"), (None, None), (8, "d")], key=str)


def test_directory_splits_until_buckets_fit(spark):
    entries = spark.range(5000).selectExpr("xxhash64(id) as h")
    slots, depth = exactdedup.directory(entries, capacity=100)
    assert slots.select("slot").distinct().count() == slots.count() <= 1 << depth
    held = entries.selectExpr(f"shiftrightunsigned(h, {64 - depth}) as slot").join(slots, "slot").groupBy("depth", "bucket").count()
    assert held.agg({"count": "max"}).head()[0] <= 100


def _shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _near(rows, least=0.8):
    ids = sorted({i for i, _, _ in rows})
    sets = {i: _shingles(t) for i, t, _ in rows}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("spare", [2000, 0])
def test_near_groups(spark, corpus, spare):
    want = _near(corpus)
    rows = minhash.near_groups(docs(spark, corpus), spare=spare, rounds=2).collect()
    assert len(rows) == len(corpus)
    assert {r["doc_id"]: r["group_id"] for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in rows)


def test_near_dedup_of_nothing(spark, corpus):
    table = docs(spark, corpus).limit(0)
    assert minhash.near_groups(table).count() == 0
    assert minhash.deduplicate(table).columns == table.columns


def test_near_dedup_decides_per_row(spark):
    rng = random.Random(4)
    one, two, three, four = (words(rng, 60) for _ in range(4))
    rows = [(7, one), (7, two), (5, one + " tail"), (None, two + " tail"), (None, three), (8, four + " x"), (8, four + " y"), (8, four + " x"), (None, None), (None, "")]
    table = docs(spark, [(i, t, "s") for i, t in rows])
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicate(table).collect()), key=str)
    least = min((four + " x", four + " y"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = [(5, one + " tail"), (7, two), (None, three), (None, None), (None, ""), (8, least)]
    assert kept == sorted(want, key=str)
    groups = sorted(((r["doc_id"], r["class_id"], r["group_id"], r["kept"]) for r in minhash.near_groups(table).collect()), key=str)
    assert len(groups) == len(rows) and (None, None, 7, False) in groups and (None, None, None, True) in groups and (7, 7, 5, False) in groups


def test_search_misses_no_more_than_36_bands_of_5():
    k = minhash._weighed(minhash.BANDS * minhash.ROWS)
    filtered = sum(math.comb(k, m) * 0.1**m * 0.9 ** (k - m) for m in range(minhash._most_off(k, 0.8) + 1, k + 1))
    assert filtered <= 1e-9
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS + filtered <= (1 - 0.8**5) ** 36


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(1, 2**63, 300, dtype=np.uint64)
    x, y = np.ones(300), np.ones(300)
    x[:100], y[200:] = 3.0, 0.25
    x[100:150] = 0.0
    keep_x, keep_y = x > 0, y > 0
    owner = np.concatenate([np.zeros(keep_x.sum(), int), np.ones(keep_y.sum(), int)])
    sig = minhash.dart_signatures(owner, np.concatenate([elements[keep_x], elements[keep_y]]), np.concatenate([x[keep_x], y[keep_y]]), 2, 2000)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i % 10 != 9] + [(3, 3), (60, 55)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: i // 10 * 10 for i in range(50)} | {60: 55, 55: 55}


def test_key_filter_never_holds_back_a_key(spark):
    few = likely_among(spark.range(100_000), spark.range(0, 100_000, 7), "id")
    assert few.where("id % 7 = 0").count() == 14_286
    assert few.count() < 30_000


def test_short_hashes_make_chains_that_the_directory_routes(spark, corpus):
    table = docs(spark, corpus)
    whole = sorted(map(str, exactdedup.exact_groups(table).collect()))
    for bits in (8, 2):
        assert sorted(map(str, exactdedup.exact_groups(table, capacity=2, bits=bits).collect())) == whole
    rows = table.selectExpr("doc_id AS id", "coalesce(text, '') AS body").selectExpr("id", "body", "shiftleft(shiftrightunsigned(xxhash64(body), 62), 62) AS h", "sha2(body, 256) AS sha")
    index, slots, depth = exactdedup.build_index(rows.drop("body"), rows.select("id", "h", "body"), capacity=1)
    links = index.collect()
    texts = {t or "" for _, t, _ in corpus}
    assert len(links) == len(texts) > 4 >= len({r["h"] for r in links})  # chains
    assert {r["bucket"] for r in links} <= {r["bucket"] for r in slots.collect()} and depth == 2


def test_equal_rows_stay_once_and_clashing_columns_pass(spark):
    rows = [(1, "one two three four five six", 5), (1, "one two three four five six", 6), (2, "other words in a row here", 7), (None, "only here and nowhere else", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lost long").withColumns({"lost_sha": F.lit("x"), "__lost": F.lit(1), "row": F.lit(2), "id": F.lit(3), "sha": F.lit(4)})
    for run in (exactdedup.deduplicate, minhash.deduplicate):
        out = run(table)
        assert out.columns == table.columns
        assert sorted((str(r["doc_id"]), r["row"], r["id"]) for r in out.collect()) == [("1", 2, 3), ("2", 2, 3), ("None", 2, 3)]


def test_weighted_near_groups_count_repeats(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(1, line), (2, " ".join([line] * 2)), (3, " ".join([line] * 9)), (4, " ".join([line] * 10))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["group_id"] for r in minhash.near_groups(table).collect()}
    weighed = {r["doc_id"]: r["group_id"] for r in minhash.near_groups(table, weighted=True).collect()}
    assert set(plain.values()) == {1}  # the seams add four shingles to 36
    assert weighed == {1: 1, 2: 2, 3: 3, 4: 3}


def test_mixture_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 400])), rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", None])) for i in range(3000)] + [(5000, None, "void")]
    found = mixing.mixture(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    source = {i: s for i, _, s in rows}
    total = sum(r["size"] for r in found)
    by = {}
    for r in found:
        by.setdefault(source[r["doc_id"]], []).append(r)
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    sizes = {s: sum(r["size"] for r in g) for s, g in by.items()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = total
    while open_:  # water filling, step by step
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    for s, g in by.items():
        assert abs(g[0]["target"] - target[s]) < 1e-6
        assert abs(sum(r["taken"] for r in g) - target[s]) <= 0.02 * total


def test_mix_emits_the_planned_copies(spark):
    rows = [(i, "a b c d"[: 2 * (i % 4)], "xyz"[i % 3]) for i in range(60)]
    table = docs(spark, rows)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mixture(table).collect()}
    out = mixing.mix(table)
    assert out.columns == table.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.mix(table.limit(0)).count() == 0


TRICKY = [chat.MARK, chat.MARK + "n", "</s>[INST] ok [/INST]", "<" + chat.MARK + "/s>", chat.TURN + chat.END, "[INST[INST]", "a\nb\n", "", "<<s>>", "<|image|>"]


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice(["<", "/s>", "[", "INST]", chat.MARK, "|", "turn", ">", "s", "|>"]) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    for r in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_chat_digests(spark):
    turns = [(c, k, ["user", "assistant", "system", "assi\nstant"][k % 4], t) for c in range(3) for k, t in enumerate(TRICKY)] + [(9, None, None, None), (9, 1, "assistant", None)]
    made = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), parts=chat.text_parts("text"))
    runs = {r["conv_id"]: (sum(x["chars"] for x in r["loss_runs"]), len(r["formatted"])) for r in made.collect()}
    assert all(a == b for a, b in runs.values())
    for r in chat.digests(made).collect():
        mine = sorted(((t if t is not None else -1), ro or "", x or "") for c, t, ro, x in turns if c == r["conv_id"])
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in mine).encode()).hexdigest()
        loss = "".join(x for _, ro, x in mine if ro == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_roles_with_marks_and_rows_without_a_conversation(spark):
    roles = [chat.MARK + "n", chat.MARK + "\n", chat.MARK * 2 + "n", "a" + chat.MARK + "n\n", "\n", "<" + chat.MARK + "/s>\n</s>"]
    turns = [(1, k, r, "t") for k, r in enumerate(roles)] + [(None, 0, "user", "x" * 300_000), (None, 1, "assistant", "y")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"__conv": F.lit(1), "formatted": F.lit(2)})
    made = chat.format_turns(table, parts=chat.text_parts("text"))
    rows = made.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()
    assert [[t["role"] for t in r["t"]] for r in rows if r["conv_id"] == 1] == [roles]
    assert sorted(t["text"][:1] for r in rows if r["conv_id"] is None for t in r["t"]) == ["x", "y"] and len(rows) == 3


def test_unknown_kinds_of_parts_are_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", [("video", "a </s>", None, None), (None, None, None, None)])], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:int>>")
    r = chat.format_turns(rows).select(chat.parse(F.col("formatted")).alias("t"), "attachments").head()
    assert r["t"][0]["text"] == "a </s>" and r["attachments"] == []


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a", 10), ("text", " and", None, None), ("audio", None, "s3://b", None)]
    rows = spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:int>>")
    r = chat.format_turns(rows).head()
    body = r["formatted"].removeprefix(chat.TURN + "user\n").removesuffix(chat.END + "\n")
    assert body.count("<|image|>") == 1 and body.index("<|image|>") < body.index("<|audio|>")
    assert [(a["ref"], a["tokens"], a["position"]) for a in r["attachments"]] == [("s3://a", 10, 1), ("s3://b", chat.DEFAULT_TOKENS["audio"], 3)]
    assert r["expanded_tokens"] == 2 + 10 + 1 + 750


def test_warc_round_trip(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    body = "x" * 150
    pages = [(1, "u", body), (2, "u\r\nEvil: 1", body), (3, None, None), (4, "u", magic * 3 + "é" * 60), (5, "u", magic), (6, "u", body), (7, "u", "short"), (8, "u", "short"), (None, "u", "y" * 200), (4, "u", magic * 3 + "é" * 60), (9, "u", "\r\n\r\n"), (11, "u", "z" * 1_500_000), (12, "u", "z" * 1_500_000)]
    path = new_path(spark, "warc-test")
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write_archives(table.withColumns({c: F.lit(1) for c in ("id", "body", "n", "sha", "refers", "file", "value")}), path)
    found = warc.read_archives(spark, path).collect()
    assert all(r["intact"] for r in found)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = min((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        again = len(b) >= 100 and i is not None and i != first
        want.append((i or -1, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)


def _record(ident, body, length=None, version="1.1", name="Content-Length"):
    data = body.encode()
    head = f"WARC/{version}\r\nWARC-Type: response\r\nX-Page-Id: {ident}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(data).hexdigest()}\r\n"
    return f"{head}{name}: {len(data) if length is None else length}\r\n\r\n".encode() + data + b"\r\n\r\n"


def test_warc_split_and_hostile_archives(spark, tmp_path):
    rng = random.Random(1)
    fake = _record(99, "inner").decode()
    bodies = ["x" * rng.randrange(3000) + fake * (rng.randrange(3) if i % 5 == 0 else 0) + "é" * rng.randrange(9) for i in range(400)]
    plain = b"".join(_record(i, b, version="1.0" if i % 2 else "1.1", name="content-length" if i % 3 else "Content-Length") for i, b in enumerate(bodies))
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(_record(1000 + i, "p" * i + fake * (i == 3))) for i in range(5)))
    broken = [_record(2000, "q"), _record(2001, "r", length="x?"), _record(2002, "s")]
    (tmp_path / "c.warc").write_bytes(b"".join(broken))
    (tmp_path / "d.warc").write_bytes(b"junk" + _record(3000, "q"))
    (tmp_path / "e.warc").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.option("lineSep", warc.MAGIC).text(f"file://{tmp_path}/a.warc").rdd.getNumPartitions() > 5
        found = warc.read_archives(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = {r["page_id"]: r for r in found if r["record_type"] == "response"}
    assert sorted(whole) == [*range(400), *range(1000, 1005), 2000, 2001]
    assert all(whole[i]["payload_digest"] == hashlib.sha256(b.encode()).hexdigest() and whole[i]["payload_bytes"] == len(b.encode()) for i, b in enumerate(bodies))
    assert [i for i, r in whole.items() if not r["intact"]] == [2001]
    stops = {r["file"][-6:]: (r["at"], r["payload_bytes"]) for r in found if r["record_type"] == "broken"}
    assert stops == {"c.warc": (len(broken[0]), len(broken[1] + broken[2])), "d.warc": (0, 4 + len(_record(3000, "q")))}


def test_warc_of_nothing(spark):
    path = new_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
