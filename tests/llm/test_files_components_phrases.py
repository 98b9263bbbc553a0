"""Token files, whitening and phrase mining: small fixtures against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratapanel.llm import collocations, tokenfiles, whitening
from stratapanel.llm.common import new_path

DOCS = "doc_id long, text string, lang string, id string, base int, f double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "own", 1, 0.5) for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.default_vocabulary())


def texts(seed, n):
    rng = random.Random(seed)
    parts = [
        " ", "  ", "\n", "\t", "a", "B", "é", "ß", "'s", " 's", "'ll", "12", "<|endoftext|>", "!", "\xa0", "　", "漢字", "\x85", "\x0b", "€", "\x1f",
        "\r\n", " \n", ",", " word", "word", ".", " (x)", "́",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_cuts_change_no_token(tokenizer):
    vocabulary, made = tokenfiles.load(tokenfiles.default_vocabulary()), texts(1, 3000)
    assert vocabulary["cut"]
    for at in range(0, len(made), 500):
        part = made[at:at + 500]
        ids, size = tokenfiles.encode_texts(vocabulary, pa.array(part, pa.string()), "<u2")
        found = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    vocabulary = tokenfiles.load(public_tokenizers.path("word_bpe_49k.json"))
    assert not vocabulary["cut"]
    part = texts(2, 200)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, size = tokenfiles.encode_texts(vocabulary, pa.array(part, pa.string()), "<u2")
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in part]


def expected(rows, tokenizer):
    """By id, null first; rows that share an id are told apart by their ids only."""
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_token_files_hold_all_documents_in_order(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, t) for i, t in zip(rng.sample(range(10**15), 300), texts(6, 300), strict=True)]
    rows += [(-5, None), (2, ""), (3, "long text, " * 60_000)]
    table, path = docs(spark, [(i, t, None) for i, t in rows]), new_path(spark, "tokens")
    tokenfiles.write_tokens(table, path, file_bytes=20_000)
    assert spark.read.parquet(f"{path}/parts").count() > 10
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in tokenfiles.read_tokens(spark, path, ids=True).collect())
    assert found == expected(rows, tokenizer)


def test_token_files_with_null_and_repeated_ids(spark, tokenizer):
    rows = [(None, "none"), (7, "a b"), (7, "c"), (7, "c"), (9, "d e f g"), (None, "more of it")]
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs(spark, [(i, t, None) for i, t in rows]), path)
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[1] for r in found] == np.cumsum([0, *[r[2] for r in found]])[:-1].tolist()
    assert [r[0] for r in found] == [None, None, 7, 7, 7, 9]
    assert Counter((r[0], r[2], r[3]) for r in found) == Counter((r[0], r[2], r[3]) for r in expected(rows, tokenizer))


def test_token_files_of_text_ids_and_of_no_rows(spark):
    path = new_path(spark, "tokens")
    named = spark.createDataFrame([("b", "x y"), ("a", "z")], "doc_id string, text string")
    tokenfiles.write_tokens(named, path)
    assert [(r["doc_id"], r["start"]) for r in tokenfiles.read_tokens(spark, path).orderBy("start").collect()] == [("a", 0), ("b", 2)]
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(named.limit(0), path)
    assert tokenfiles.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("kind", ["spread", "falling", "equal", "rank two", "single"])
def test_feast_finds_the_largest_eigenvalues(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "single" else 40
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    told = {"spread": rng.random(d) + 1, "falling": 10.0 ** -np.arange(d), "equal": np.repeat([5.0, 4.0], 20), "rank two": np.array([3.0, 2.0] + [0] * 38), "single": np.ones(1)}[kind]
    v = q @ np.diag(told) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.components(v, 4)
    want = np.sort(told)[::-1][:{"rank two": 2, "single": 1}.get(kind, 4)]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-9
    for at in (want[0] * 0.999, want[-1] * 1.001, -1.0):
        assert whitening.count_above(whitening.tridiagonal(v), at) == int((told > at).sum())


def whitened(rows):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    return x, n, s, v, e[::-1], u[:, ::-1]


def test_whitening_against_a_full_decomposition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a) for a in rng.standard_normal(12) * np.arange(1, 13)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)] + [(0, rows[0][1])]
    odd = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] + [0.0] * 11), (2003, [float("inf")] * 12), (2004, []), (2005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "own", 3) for i, v in rows + odd], "vec_id long, embedding array<float>, x string, n int")
    found = whitening.whiten(table).collect()
    x, n, s, v, e, u = whitened(rows)
    assert len(found) == 4 * len(rows)
    signs = {}
    for r in found:
        k, own = r["component"] - 1, x[r["vec_id"]]
        want = float((own - s / n) @ u[:, k] / np.sqrt(e[k]))
        if abs(want) > 0.1:
            signs.setdefault(k, np.sign(want * r["whitened"]))
        assert abs(abs(want) - abs(r["whitened"])) < 1e-9 and (abs(want) < 0.1 or np.sign(want * r["whitened"]) == signs[k])
        assert r["n"] == n == 200 and r["deviation"] == int(((n * own - s) ** 2).sum())
        assert abs(r["explained"] / (e[k] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_without_variance_and_exact_sums(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(table).count() == 0 and whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    x = np.array([[2**40, -3], [2**41 + 1, 5]])
    assert whitening._deviations(x, 3, [7, -1]) == [None, None]
    x = np.array([[2**20, -3], [5, 5]])
    assert whitening._deviations(x, 1000, [7, -1]) == [(1000 * 2**20 - 7) ** 2 + (-3000 + 1) ** 2, 4993**2 + 5001**2]


def test_whitening_adds_up_many_parts(spark):
    rows = spark.range(0, 300, 1, 150).selectExpr("cast(id % 2 as int) as i", "id div 2 as part", "array(cast(id as double), 1.0d) as v")
    found = {r["i"]: list(r["v"]) for r in whitening._added_up(rows).collect()}
    assert found == {0: [float(sum(range(0, 300, 2))), 150.0], 1: [float(sum(range(1, 300, 2))), 150.0]}


def grams(sequence, k):
    return Counter(tuple(sequence[i:i + k]) for i in range(len(sequence) - k + 1) if 0 not in sequence[i:i + k])


def test_bidirectional_extension_counts_every_phrase():
    rng = np.random.default_rng(8)
    for size, n in ((3, 40), (5, 400), (30, 2000)):
        sequence = np.append(rng.integers(0, size, n), 0)
        banned = {(1, 2)}
        allowed = lambda a, b: np.array([(x, y) not in banned for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)  # noqa: E731, B023
        for p in collocations.enumerate_phrases(sequence, size, 5, allowed):
            k = p.words.shape[1]
            want = {g: f for g, f in grams(sequence.tolist(), k).items() if not banned & set(zip(g, g[1:], strict=False))}
            assert {tuple(w): int(f) for w, f in zip(p.words.tolist(), p.count, strict=True)} == want


def mined(rows, least, top):
    """The contract, phrase by phrase."""
    import re

    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {k: f for k, f in counts.items() if f >= least}
    out = {}
    for (lang, w), a in often.items():
        if len(w) == 1 or any(
            g == lang and len(v) > len(w) and 100 * f >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v))) for (g, v), f in often.items()
        ):
            continue
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def test_collocations_against_brute_force(spark):
    rng = random.Random(9)
    words = ["a", "b", "C", "ça", "d d", "É", "<s>", "e'e", "x", "longer"]
    passage = "the Quick brown\tfox jumps, over the lazy dog"
    rows = []
    for i in range(400):
        body = " ".join(rng.choice(words[:3 + i % 8]) + rng.choice(["", "", "", ".", "\n", "\r\n", "  ", "\t"]) for _ in range(rng.randrange(0, 30)))
        rows.append((i, rng.choice(["", passage + " "]) + body, rng.choice(["en", "en", "en", None, "und", "fr"])))
    rows += [(900, None, "en"), (901, "", "de"), (902, " \t\n.,", None), (903, "a b " * 5000, "long"), (903, "a b " * 5000, "long")]
    found = collocations.collocations(docs(spark, rows), least=20, top=25, shard_words=700).collect()
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found} == mined(rows, 20, 25)
    assert len(found) > 60


def test_collocations_of_no_rows_and_of_rare_words(spark):
    assert collocations.collocations(docs(spark, []).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [(1, "no phrase is here often", "en")])).count() == 0
