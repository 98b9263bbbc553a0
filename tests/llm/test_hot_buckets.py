"""Near-duplicate search in buckets of many texts that are close to, but below, the threshold; rows that stay are not shuffled."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import exactdedup, minhash
from stratapanel.llm.common import likely_among, surely_not_among, surviving


def close_texts(n, seed, changed, words=120):
    """Texts that share a frame of words; each has its own words at ``changed`` places."""
    rng = random.Random(seed)
    frame = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(frame)
        for _ in range(changed):
            w[rng.randrange(words)] = f"own{k}"
        out.append(" ".join(w))
    return out


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("tile", [8, 256])
def test_hot_buckets_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = close_texts(60, 1, 2) + close_texts(60, 1, 3)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    found = {r["doc_id"]: r["group_id"] for r in minhash.near_groups(table, spare=10**9).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


def test_a_block_is_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 60)) for _ in range(30)]
    rows = pd.DataFrame({"id": np.arange(30), "comp": np.arange(30) % 17, "tile": np.arange(30) % 2, "s": sets})
    want = {
        (i, j) for i in range(30) for j in range(i + 1, 30)
        if i % 17 != j % 17 and len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))
    }
    got = set()
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        part = rows[rows["tile"].isin([lo, hi])].reset_index(drop=True)
        got |= set(minhash._block(0.6)((7, lo, hi), part).itertuples(index=False, name=None))
    assert got == want and len(want) > 20


def test_rows_that_stay_pass_by(spark):
    rows = spark.range(2000).selectExpr("id", "concat('text ', id % 1500) as text", "id as key")
    keys = spark.range(0, 2000, 7).selectExpr("id as key")
    some, none = likely_among(rows, keys, "key"), surely_not_among(rows, keys, "key")
    assert some.count() + none.count() == 2000 and none.where(F.col("key") % 7 == 0).count() == 0 and some.count() < 600
    decided = rows.selectExpr("id", "sha2(text, 256) as sha", "id % 3 > 0 as kept", "1L as copies")
    decided = decided.unionByName(decided.limit(0))
    found = surviving(rows.select("id", "text"), "id", "text", decided)
    assert sorted(r["id"] for r in found.collect()) == [i for i in range(2000) if i % 3]


def test_skewed_hashes_give_buckets_of_different_depths(spark):
    crowded = spark.range(4096).selectExpr("shiftleft(id, 44) as h")
    spread = spark.range(1, 64).selectExpr("shiftleft(id, 57) + 5 as h")
    slots, depth = exactdedup.directory(crowded.unionByName(spread), capacity=64)
    found = {(r["bucket"], r["depth"]) for r in slots.collect()}
    depths = {d for _, d in found}
    assert depth == 14 and max(depths) == 14 and min(depths) < 14
    # each bucket is within the capacity
    held = {}
    for h in [i << 44 for i in range(4096)] + [(i << 57) + 5 for i in range(1, 64)]:
        slot = h >> (64 - depth)
        bucket, d = max((b, d) for b, d in found if b <= slot)
        assert slot >> (depth - d) == bucket >> (depth - d)
        held[bucket] = held.get(bucket, 0) + 1
    assert max(held.values()) <= 64
