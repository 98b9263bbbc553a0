"""Language, toxicity, pieces, embeddings, personal data and the pipeline: small fixtures against brute force or held-out truth."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratapanel.llm import embjoin, langid, pieces, pii, queries, toxicity

SYLLABLES = {"aa": ["ba", "na", "lo", "ti"], "bb": ["schr", "ung", "ein", "kt"], "cc": ["éa", "ou", "çi", "tr"]}
INSULTS = ["zonk", "blarg"]


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    rows = []
    for i in range(400):
        lang = ["aa", "bb", "cc"][i % 3]
        said = [sentence(rng, lang, rng.randint(4, 12)) for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            k = rng.randrange(len(said))
            said[k] = said[k][:-1] + " " + rng.choice(INSULTS) + "."
        rows.append((i, " ".join(said), lang if i % 7 else None, int(toxic)))
    return rows


def test_languages(spark, texts):
    more = [(1000, None, None, 0), (1001, "123 !!", "aa", 0), (1002, "", None, 0), (1003, "ung " * 60_000, None, 0)]
    table = spark.createDataFrame([(*r, "x") for r in texts + more], "doc_id long, text string, lang string, toxic int, score string")
    found = {r["doc_id"]: r for r in langid.identify(table).collect()}
    assert len(found) == len(texts) + len(more)
    held = [i for i, *_ in texts if found[i]["held_out"]]
    truth = {i: ["aa", "bb", "cc"][i % 3] for i, *_ in texts}
    assert held and np.mean([found[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert langid.identify(table.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(3)
    dims, langs = 5, 3
    model = langid.Ftrl(np.zeros((dims + 1, langs)), np.zeros((dims + 1, langs)))
    z, n = [[0.0] * langs for _ in range(dims + 1)], [[0.0] * langs for _ in range(dims + 1)]

    def weight(i, k):
        l1 = 0.0 if i == dims else model.l1
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((model.beta + math.sqrt(n[i][k])) / model.alpha + model.l2)

    for _ in range(60):
        at = np.sort(rng.choice(dims, 3, replace=False))
        x, label = rng.random(3), int(rng.integers(langs))
        places, values = [*at.tolist(), dims], [*x.tolist(), 1.0]
        w = {(i, k): weight(i, k) for i in places for k in range(langs)}
        logits = [sum(v * w[i, k] for i, v in zip(places, values)) for k in range(langs)]
        top = [math.exp(v - max(logits)) for v in logits]
        for k in range(langs):
            p = top[k] / sum(top) - (k == label)
            for i, v in zip(places, values):
                g = v * p
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / model.alpha * w[i, k]
                n[i][k] += g * g
        model.learn(np.append(at, dims), np.append(x, 1.0), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_temperature_against_a_grid():
    rng = np.random.default_rng(4)
    y = rng.integers(3, size=400)
    z = rng.normal(size=(400, 3)) + 2.0 * (np.arange(3) == y[:, None])
    z *= 4.0  # four times too sure of itself
    eps = 1 / (len(y) + 2)

    def loss(t):
        p = np.exp(z / t - np.max(z / t, axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        target = np.where(np.arange(3) == y[:, None], 1 - eps, eps / 2)
        return -(target * np.log(np.maximum(p, 1e-300))).sum(axis=1).mean()

    grid = np.exp(np.linspace(math.log(0.1), math.log(19), 3000))
    found = langid._temperature(z, y)
    assert abs(found - grid[np.argmin([loss(t) for t in grid])]) < 0.02 and found > 2


def test_grams_and_logits_against_plain_counts(spark):
    said = ["ab c", "Ba na! na", "", "123", "éa ou çi", "x" * 50 + " y"]

    def plain(text):
        parts = re.findall(r"[^\W\d_]+", text.lower())
        line = " " * (not text[:1].isalpha()) + " ".join(parts) + " "
        one = [c for c in line if c != " "]
        return len(one) + max(0, len(line) - 1) + max(0, len(line) - 2) if parts else None

    found, has, total = langid.grams(said)
    assert has.tolist() == [True, True, False, False, True, True]
    assert all(total[i] == plain(t) for i, t in enumerate(said) if plain(t) is not None)
    df = np.zeros(langid.DIMS)
    for r in spark.createDataFrame([(t,) for t in said], "text string").mapInPandas(langid._frequencies, "at long, n long").collect():
        if r["at"] >= 0:
            df[r["at"]] += r["n"]
    alone = [np.unique(np.concatenate([g for g, _ in langid.grams([t])[0]])) for t in said]
    want = np.zeros(langid.DIMS)
    for g in alone:
        want[g] += 1
    assert (df == want).all()
    rng = np.random.default_rng(0)
    idf = rng.random(langid.DIMS)
    model = langid.Model(["a", "b"], idf, rng.normal(size=(langid.DIMS, 2)), np.array([0.1, -0.2]))
    z, _ = langid._logits(model, said)
    for i, (at, x) in enumerate(langid._vectors(said, idf)):
        assert np.allclose(z[i], (x[:, None] * 30.0 * model.weights[at]).sum(axis=0) + model.bias, atol=1e-4)


def test_label_of_equal_texts_is_the_majority(spark):
    rows = [(i, f"{w} {w}", lang) for i, (w, lang) in enumerate([("ba na", "aa"), ("ung schr", "bb")] * 30)]
    rows += [(1000 + i, "same text twice over", lang) for i, lang in enumerate(["bb", "aa", "aa", "bb", "aa"])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["aa", "bb"] and model.notes["sampled"] == 3


def test_toxicity(spark, texts):
    table = spark.createDataFrame([(i, t, "x") for i, t, *_ in texts] + [(1000, None, "x"), (1001, "", "x"), (1002, "ba na. " * 20_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, *_, y in texts] + [(7, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.assess(table, labels).collect()}
    assert len(found) == len(texts) + 3
    held = [(i, y) for i, *_, y in texts if found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == y for i, y in held]) > 0.95
    assert not any(found[i]["predicted"] for i in (1000, 1001, 1002))
    kept = toxicity.keep_clean(table, labels)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}
    model = toxicity.fit(table, labels, ~toxicity.held_out())
    hits = toxicity.sentences(table, model).collect()
    body = {i: t for i, t, *_ in texts}
    assert len(hits) > 50 and np.mean([any(w in body[r["doc_id"]][: r["end"]].rsplit(".", 1)[-1] for w in INSULTS) for r in hits]) > 0.95
    assert toxicity.assess(table, labels.limit(0)).agg(F.max("score")).head()[0] == 0
    assert toxicity.assess(table.limit(0), labels).count() == 0


def test_noisy_or_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    place, sentence = rng.integers(0, 6, 40), np.sort(rng.integers(0, 12, 40))
    owner, label, weight = np.repeat(np.arange(4), 3), np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    w, noise = rng.uniform(0.5, 1.5, 6), 0.07  # above the level without evidence, where the noisy-or has a slope

    def likelihood(w):
        z = np.bincount(sentence, w[place], minlength=12) + toxicity.BIAS
        level = 1 / (1 + math.exp(-toxicity.BIAS))
        p = np.maximum(0.0, (1 / (1 + np.exp(-z)) - level) / (1 - level))
        clean = np.array([np.prod(1 - p[owner == d]) for d in range(4)])
        marked = noise + (1 - 2 * noise) * (1 - clean)
        return (weight * np.where(label == 1, np.log(marked), np.log(1 - marked))).sum()

    found, clean, _ = toxicity.gradient(w, place, sentence, owner, label, weight, noise)
    steps = [(likelihood(w + 1e-6 * np.eye(6)[k]) - likelihood(w - 1e-6 * np.eye(6)[k])) / 2e-6 for k in range(6)]
    assert np.allclose(found, steps, rtol=1e-4, atol=1e-6)


def test_scores_are_the_noisy_or_of_plain_sentences():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(0, 2, 1 << toxicity.BITS), 0.1)
    said = ["one two. three! two two? four", "", "...", "a b\nc d", "five six seven"]
    word = {w: int(toxicity.sentence_words([w])[0][0]) for w in re.findall(r"[a-z]+", " ".join(said))}
    level = 1 / (1 + math.exp(-toxicity.BIAS))
    found = toxicity._scores(model, said)
    for text, r in zip(said, found.to_dict("records")):
        clean, best = 1.0, 0.0
        for part in re.split(r"[.!?\n]", text):
            z = toxicity.BIAS + sum(model.weights[word[w]] for w in set(re.findall(r"[a-z]+", part)))
            p = max(0.0, (1 / (1 + math.exp(-z)) - level) / (1 - level))
            clean, best = clean * (1 - p), max(best, p)
        assert abs(r["score"] - (1 - clean)) < 1e-9 and abs(r["worst_score"] - best) < 1e-9


def test_worst_sentence_is_where_the_insult_is(spark, texts):
    table = spark.createDataFrame([(i, t) for i, t, *_ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, *_, y in texts], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.assess(table, labels).collect()}
    bad = [(t, found[i]) for i, t, _, y in texts if y and found[i]["predicted"]]
    hits = [any(w in t[r["worst_start"] : r["worst_end"]] for w in INSULTS) for t, r in bad]
    assert len(bad) > 60 and np.mean(hits) > 0.97
    assert all("." not in t[r["worst_start"] : r["worst_end"]] for t, r in bad)


def test_clean_rows_stay_by_their_own_score(spark, texts):
    bad, good = texts[0][1], texts[1][1]
    rows = [(i, t, 1) for i, t, *_ in texts] + [(None, bad, 1), (None, good, 1), (5000, bad, 1), (5000, good, 1)]
    labels = spark.createDataFrame([(i, y) for i, *_, y in texts], "doc_id long, toxic int")
    kept = toxicity.keep_clean(spark.createDataFrame(rows, "doc_id long, text string, score int"), labels).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["doc_id"] in (None, 5000)), key=str) == sorted([(None, good), (5000, good)], key=str)


@pytest.fixture(scope="module")
def vocab():
    return pieces.load()


def _all_paths(vocab, text):
    """Every segmentation of a short text, by recursion."""
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((score, tuple(ids)))
            return
        single = False
        for j in range(at + 1, min(len(text), at + vocab["longest"]) + 1):
            hit = vocab["pieces"].get(text[at:j])
            if hit:
                single = single or j == at + 1
                go(j, [*ids, hit[0]], score + hit[1])
        if not single:
            raw = text[at].encode()
            go(at + 1, [*ids, *(vocab["bytes"][b] for b in raw)], score + vocab["spelled"] * len(raw))

    go(0, [], 0.0)
    return sorted(out, reverse=True)


def test_n_best_against_all_paths(vocab):
    for text in ("hello", "the cat", "a  bé", "x\ny z", "in on"):
        written = pieces.SPACE + text.replace(" ", pieces.SPACE)
        want = _all_paths(vocab, written)
        e = pieces.encode(vocab, pieces.new_memory(), text, 6)
        n = min(6, len(want))
        assert np.allclose(e.scores, [s for s, _ in want[:n]])
        paths = [tuple(e.nth(k)) for k in range(n)]
        assert len(set(paths)) == n and all(p in {q for _, q in want} for p in paths)
        assert all(pieces.decode(vocab, p) == text for p in paths)


def test_n_best_agrees_with_the_library(vocab):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # the library searches N-best lists for unigram models only
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("Hello world", "The quick brown  fox", "straße", "Thnt inea erere"):
        mine = pieces.encode(vocab, pieces.new_memory(), text, 5)
        theirs = library.nbest_encode_as_ids(text, 5)
        assert mine.scores == [sum(library.get_score(i) for i in ids) for ids in theirs]


def test_encode_and_decode(spark, vocab):
    odd = ["", None, " ", "  x  ", "a▁b", "😀\x00\n\n", "<s></s><0x41>", "é" * 3000 + " " * 70, "word " * 30_000]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, ids int")
    made = pieces.encode_texts(table, n=3, alternatives=True).withColumn("nbest_ids", pieces.nbest_ids())
    for r in pieces.decode_ids(made).collect():
        text = odd[r["doc_id"]] or ""
        assert r["round_trip"] and r["decoded"] == text and r["n_pieces"] == len(r["ids"])
        assert r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) and r["nbest_ids"][0] == r["ids"]
        assert all(pieces.decode(vocab, x) == text for x in r["nbest_ids"])
    assert pieces.encode_texts(table.limit(0)).count() == 0


def test_registered_encoding_builds_all_segmentations(spark, vocab, tmp_path):
    said = ["the cat in on", "hello  world", "", None]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for made in (queries.op4_pieces(spark, str(tmp_path)), corpus_pipeline.encoded(spark, docs, str(tmp_path))):
        for r in made.withColumn("nbest_ids", pieces.nbest_ids()).collect():
            text = said[r["doc_id"]] or ""
            paths = [tuple(x) for x in r["nbest_ids"]]
            assert r["round_trip"] and len(set(paths)) == len(paths) == len(r["nbest_scores"]) == (4 if text else 1)
            assert list(paths[0]) == r["ids"] and all(pieces.decode(vocab, x) == text for x in paths)


@pytest.mark.parametrize(("segment", "bands"), [(16, 5), (512, 1)])
def test_embedding_groups(spark, segment, bands):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    vectors = [centres[k % 12] + rng.normal(size=8) * [0.02, 0.25, 0.5][k % 3] for k in range(150)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(400, [2 * x for x in rows[5][1]])]
    bad = [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, None]), (505, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, kept string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embjoin.near_duplicates(table, segment=segment, bands=bands).collect()}
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = np.arange(len(rows))
    while True:
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(hit[k].sum()), rows[comp[k]][0], bool(comp[k] == k)) for k, (i, _) in enumerate(rows)} | {i: (0, i, True) for i, _ in bad}
    assert found == want
    assert embjoin.near_duplicates(table.where("vec_id >= 500")).count() == len(bad)
    assert embjoin.near_duplicates(table.limit(0)).count() == 0


def test_distant_bands_and_segments_are_not_sent(spark):
    # ten bands of ten segments along the first direction, 0.1 apart; eps reaches three segments
    rows = [(b, b * 10 + k, x, 0.0, x + 0.05, 0.0) for b in range(10) for k in range(10) for x in [b * 1.0 + k * 0.1]]
    boxes = spark.createDataFrame(rows, "band int, seg long, lo0 double, lo1 double, hi0 double, hi1 double")
    bands = boxes.groupBy("band").agg(*[F.min(c).alias(c) for c in ("lo0", "lo1")], *[F.max(c).alias(c) for c in ("hi0", "hi1")])
    pairs = embjoin.band_pairs(bands, 2, 0.3)
    assert sorted(map(tuple, pairs.collect())) == sorted([(b, b) for b in range(10)] + [(b, b + 1) for b in range(9)])
    need = embjoin.needed_segments(boxes, bands, pairs, 2, 0.3).collect()
    assert len([r for r in need if r["a"] == r["b"]]) == 100
    across = [r for r in need if r["a"] != r["b"]]
    assert len(across) == 9 * 6  # three segments of either side of each border, of 9 * 20
    assert {r["seg"] for r in across if (r["a"], r["b"]) == (0, 1)} == {7, 8, 9, 10, 11, 12}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and pii._luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(2)
    bits = ["a.b@c.de", "x@y", "@", "q@w.e@r.t.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (523) 555-1055", "+12", "é", " ", "\n", "token = \"" + "0b96a8c8d79c4a5085c919698889f59b72ab7bb6\"", "call 415-555-1234 now", "me [at] host [dot] org", "0" * 5000]
    rows = [(i, "".join(rng.choice(bits[:-1]) + rng.choice(["", " ", "1", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(900, None), (901, ""), (902, bits[-1] + " a@b.cd"), (903, "word " * 20_000 + "a@b.cd")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    for r in pii.report(table).collect():
        want = _base(dict(rows)[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(spans)
    added = [s for r in pii.report(table).collect() for s in r["spans"].split(",") if s.split(":")[0] == "secret"]
    assert added
    assert pii.report(table.limit(0)).count() == 0


def test_added_spans_precision_and_recall(spark):
    rng = random.Random(8)
    alphabet = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    code = lambda n: "".join(rng.choice(alphabet) for _ in range(n - 4)) + "7xQ2"
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    rows, truth = [], {}
    for i in range(600):
        kind = ["phone_local", "email_spelled", "secret", "ssn", None, None][i % 6]
        lead, span = {
            "phone_local": ("please call ", f"{digits(3)}-{digits(3)}-{digits(4)}"), "email_spelled": ("mail me at all times: ", f"user{i} [at] host [dot] org"),
            "secret": ("api_key = ", "sk-" + code(32)), "ssn": ("his ssn ", f"{rng.randint(100, 600)}-{digits(2)}-{digits(4)}"),
        }.get(kind, ("", ""))
        if kind is None:
            lead, span = rng.choice([("commit ", "".join(rng.choice("0123456789abcdef") for _ in range(40))), ("version ", f"9{digits(2)}-{digits(2)}-{digits(4)}"), ("isbn ", f"1{digits(2)}-{digits(3)}-{digits(4)}")])
        text = f"some words in front {lead}{span} and behind, a.b{i}@c.org"
        rows.append((i, text))
        if kind:
            at = text.index(span)
            truth[i] = f"{kind}:{at}:{at + len(span)}"
    found = {r["doc_id"]: {s for s in r["spans"].split(",") if s.split(":")[0] in pii.ADDED} for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(truth[i] in found[i] for i in truth)
    said = sum(map(len, found.values()))
    print("recall", hits / len(truth), "precision", hits / max(1, said), {k: np.mean([truth[i] in found[i] for i in truth if truth[i].startswith(k)]) for k in pii.ADDED})
    assert hits / len(truth) > 0.9 and hits / said > 0.9


def test_nothing_to_learn_from_adds_no_span(spark):
    one = spark.createDataFrame([(1, "999-12-1234 and a.b@c.de")], "doc_id long, text string")
    assert pii.fit(one.where("doc_id > 1")) is None and pii.fit(one.withColumn("text", F.lit("a.b@c.de"))) is None
    assert pii.find(one, None).head()["spans"][0]["kind"] == "email"


def test_overlaps_are_found_in_linear_time():
    import time

    text = "call 415-555-1234 or a.b@c.de; " * 20_000
    begun = time.time()
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert len(base) == len(found) == 20_000 and time.time() - begun < 5
    assert pii.candidates("415-555-1234", [(0, 3, "ip")]) == [] and pii.candidates("x 415-555-1234", [(0, 2, "ip")])


def test_reliabilities_favour_agreeing_labelers():
    import pandas as pd

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    said = np.column_stack([np.where(rng.random(4000) < a, truth, ~truth).astype(int) for a in (0.95, 0.8, 0.7)])
    counts = pd.DataFrame(said, columns=["v1", "v2", "v3"]).assign(kind="ssn", n=1, t=truth).groupby(["kind", "v1", "v2", "v3"], as_index=False).agg(n=("n", "sum"), t=("t", "mean"))
    out = pii.reliabilities(counts)
    assert np.average(np.abs(out["p"] - out["t"]), weights=out["n"]) < 0.1


def test_pipeline_stage_by_stage(spark, texts, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang, _ in texts]
    clean = [r for r in rows if r[0] % 5]
    rows += [(2000 + k, clean[3][1], "aa", "s1", 1) for k in range(5)]
    long = " ".join(sentence(rng, "aa", 30) for _ in range(10))
    rows += [(3000 + k, long + f" end{k}", "aa", "s2", 1) for k in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, *_, y in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    assert not set(ids[0]) & {i for i, *_, y in texts if y and i != 7} or len(set(ids[0]) & {i for i, *_, y in texts if y}) <= 4
    assert {2004} == set(ids[1]) & {2000, 2001, 2002, 2003, 2004, clean[3][0]}
    assert {3000} == set(ids[2]) & {3000, 3001, 3002, 3003}
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == ids[4]
    assert math.isfinite(seen[4].agg(F.sum("score")).head()[0])


def _odd_documents(spark, texts):
    rows = [(i, t, lang, "ab"[i % 2]) for i, t, lang, _ in texts[:120]] + [(None, texts[0][1], "aa", "a"), (None, None, None, None), (None, "", None, "b"), (7, "", "aa", None), (7, None, "bb", "a"), (7, "other words of id seven", "aa", "a")]
    rows += [(9, texts[9][1], "aa", "b")] * 3 + [(500, "ung " * 100_000, "bb", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return table.withColumns({c: F.lit(1) for c in ("id", "row", "sha", "h", "node", "score", "kept", "__source", "__u", "__n", "lost", "n_chars")}), rows


def test_stages_take_odd_rows(spark, texts, tmp_path):
    table, rows = _odd_documents(spark, texts)
    spark.createDataFrame([(i, y) for i, _, _, y in texts] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            found = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert set(found) <= {(i, t) for i, t, *_ in rows}
            if name == "exact_dedup" and docs is table:
                assert len(found) == len({t or "" for _, t, *_ in rows}) and {t or "" for _, t in found} == {t or "" for _, t, *_ in rows}
            if name == "minhash_near_dedup" and docs is table:
                assert (7, "other words of id seven") in found and found.count((9, texts[9][1])) == 1
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()


def test_null_and_repeated_ids_keep_their_rows(spark, texts):
    table, rows = _odd_documents(spark, texts)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in texts], "doc_id long, toxic int")
    from stratapanel.llm import exactdedup, minhash, mixing

    for made in (langid.identify(table), toxicity.assess(table, labels), pieces.encode_texts(table), mixing.mixture(table), pii.report(table), exactdedup.exact_groups(table), minhash.near_groups(table)):
        ids = [r["doc_id"] for r in made.select("doc_id").collect()]
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>").withColumns({"h": F.lit(1), "band": F.lit(2)})
    found = sorted(((r["vec_id"] or 0, r["n_links"]) for r in embjoin.near_duplicates(vectors).collect()))
    assert found == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 0)]
    words = spark.createDataFrame([("x", "one two three four five six"), ("y", "one two three four five six"), ("z", "seven words that are not the same")], "doc_id string, text string")
    assert {r["doc_id"]: r["group_id"] for r in minhash.near_groups(words).collect()} == {"x": "x", "y": "x", "z": "z"}
