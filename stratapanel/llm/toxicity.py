"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is the logistic of a bias and the weights of its distinct hashed words, over the level of a sentence
without such words: p = (s(z) - s(b)) / (1 - s(b)), and 0 below.  So sentences without evidence add nothing, however many a
document has.  A document's probability is the noisy-or 1 - prod(1 - p).  Only documents carry labels: the gradient of the
document's log likelihood is shared out among its sentences by their own probabilities, so the model learns which sentences
offend, and :func:`sentences` locates them.  A share of the labels, estimated along, is taken to be flipped, so that wrong
labels need no words that explain them.

The fit uses a bounded sample of labelled documents (all toxic ones up to half the bound) and full-batch AdaGrad with an L1 and
an L2 penalty.  Texts become word numbers in the tasks that read them; the one task that fits gets these, at most ``WORDS`` in
expectation.  Between steps that look at all words, steps look at words with a weight only.  The sample is reweighted to the
labelled proportions.  Scoring reads every whole text.

Cases: null and empty texts have no sentence with a word and score 0; documents without a label, or with several differing
labels, are scored but not learned from; with no usable label, or one class only, every score is the labelled rate (0 without
labels); repeated rows are scored alike, and rows of one id, or of none, by their own texts; an empty table gives an empty
result; other columns are not read, and pass through :func:`keep_clean` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, materialise, packed, small_batches
from .textvec import chunks, letters, run_hashes, runs

BITS = 18
#: At most about so many labelled documents are fitted.
SAMPLE = 16_000
#: ... with at most about so many distinct words, summed over their sentences.
WORDS = 12_000_000
THRESHOLD = 0.3
STEPS, FULL = 300, 10
#: Penalties in units of the log likelihood summed over the sample: a word needs that much evidence to get a weight.
RATE, L1, L2 = 0.3, 0.3, 0.02
#: Words in fewer documents of the sample than this have no weight.
LEAST_DOCS = 3
BIAS = -3.0
_CHARS = 500_000
_ENDS = np.array([ord(c) for c in ".!?\n。！？"], np.uint32)


@dataclass
class Model:
    weights: np.ndarray
    #: The labelled share of toxic documents, and whether there was anything to learn.
    rate: float
    fitted: bool = True


def sentence_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words per sentence over all texts: word bucket, its sentence, and per sentence its text, start and end in code points.

    Sentences without a word are left out; a text without any has one empty sentence.
    """
    units, is_letter, ends = letters(texts)
    start, stop = runs(is_letter)
    word = (run_hashes(units, start, stop) >> np.uint64(64 - BITS)).astype(np.int64)
    number = np.cumsum(np.isin(units, _ENDS))
    text_of = np.searchsorted(ends, start, side="right")
    span = number[start] + text_of  # a text's end is a line break, so numbers never run on into the next text
    new = np.diff(span, prepend=-1) != 0
    sentence = np.cumsum(new) - 1
    owner = text_of[new]
    last = np.append(stop[np.flatnonzero(new)[1:] - 1], stop[-1:]) if len(stop) else stop
    offset = np.concatenate([[0], ends])[:-1]
    first, last = start[new] - offset[owner], last - offset[owner]
    bare = np.setdiff1d(np.arange(len(texts)), owner)
    key = np.unique(sentence * (1 << BITS) + word)
    none = np.zeros(len(bare), np.int64)
    return key & ((1 << BITS) - 1), key >> BITS, np.concatenate([owner, bare]), np.concatenate([first, none]), np.concatenate([last, none])


def _sentence_sums(values: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(sentence, values, minlength=n)


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - p) of sentences with the sums z."""
    return np.minimum(0.0, np.log1p(np.exp(BIAS)) - np.log1p(np.exp(z)))


def gradient(
    w: np.ndarray, place: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, noise: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the log likelihood by word, and per document the probabilities of being clean and of the label 1.

    Entries (``place``: word, ``sentence``) are the distinct words of sentences; ``owner`` is the document of each sentence.
    """
    z = np.clip(_sentence_sums(w[place], sentence, len(owner)) + BIAS, -30, 30)
    p = 1.0 / (1.0 + np.exp(-z))
    clean = np.exp(np.bincount(owner, _log_clean(z), minlength=len(label)))
    marked = noise + (1 - 2 * noise) * (1 - clean)
    side = np.where(label == 1, 1.0 / marked, -1.0 / (1.0 - marked)) * weight
    g = p * ((1 - 2 * noise) * clean * side)[owner]
    g[(z < BIAS) & (g < 0)] = 0.0
    return np.bincount(place, g[sentence], minlength=len(w)), clean, marked


def _with_words(live: np.ndarray, place: np.ndarray, sentence: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of live words, with the sentences that have one numbered anew."""
    mine = np.flatnonzero(live[place])
    seen = np.zeros(len(owner), bool)
    seen[sentence[mine]] = True
    return place[mine], (np.cumsum(seen, dtype=np.int32) - 1)[sentence[mine]], owner[seen]


def _train(word: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    used, place = np.unique(word, return_inverse=True)
    pairs = np.unique(owner[sentence] * np.int64(len(used)) + place)
    fine = np.bincount(pairs % len(used), minlength=len(used)) >= LEAST_DOCS
    used, renamed = used[fine], (np.cumsum(fine) - 1).astype(np.int32)
    kept = fine[place]
    place, sentence = renamed[place[kept]], sentence[kept].astype(np.int32)
    w, acc = np.zeros(len(used)), np.full(len(used), 1e-8)
    noise, docs = 0.05, len(label)
    weight = weight * (docs / weight.sum())
    some, held = (place, sentence, owner), 0
    for number in range(STEPS):
        full = number % FULL == 0
        if full:
            gw, clean, marked = gradient(w, place, sentence, owner, label, weight, noise)
        else:
            gw, clean, marked = gradient(w, *some, label, weight, noise)
            gw[w == 0] = 0.0
        gw -= L2 * w
        gw = np.where(w != 0, gw - L1 * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - L1, 0.0))
        acc += gw * gw
        step = RATE * gw / np.sqrt(acc)
        w = np.where((w != 0) & (np.sign(w + step) == -np.sign(w)), 0.0, w + step)
        live = w != 0
        if full or live.sum() < 0.8 * held:
            # until the next full step: words with a weight, and the sentences that have one
            from_ = (place, sentence, owner) if full else some
            some, held = _with_words(live, *from_), live.sum()
        # one step of expectation-maximisation for the share of labels that are flipped
        flipped = np.where(label == 1, noise * clean / marked, noise * (1 - clean) / (1.0 - marked))
        noise = float(np.clip((flipped * weight).sum() / docs, 1e-4, 0.2))
    out = np.zeros(1 << BITS)
    out[used] = w
    return out


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text its distinct words sentence by sentence, and the number of them in each sentence."""
    for batch in batches:
        for at, texts in chunks(batch["text"], _CHARS):
            word, sentence, owner, _, _ = sentence_words(texts)
            per = np.bincount(sentence, minlength=len(owner)).astype(np.int32)
            order = np.argsort(owner, kind="stable")  # texts without a word come last in ``owner``
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]
            words = np.split(word.astype(np.int32), np.cumsum(np.bincount(owner, per, minlength=len(texts)).astype(int))[:-1])
            part = batch.iloc[at : at + len(texts)]
            yield pd.DataFrame({"id": part["id"].to_numpy(), "h": part["h"].to_numpy(), "words": words, "per": np.split(per[order], ends)})


def fit(
    docs: DataFrame, labels: DataFrame, learnable: Column, ident: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE, most_words: int = WORDS,
) -> Model:
    """A model from the labelled documents for which ``learnable`` (a column of ``ident``) holds."""
    small_batches(docs.sparkSession)
    marks = labels.where(learnable & F.col(label).isNotNull()).groupBy(F.col(ident).alias("id"))
    marks = materialise(
        marks.agg(
            F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("y2"),
        ).where("y = y2 and id is not null"),
        "toxic-labels",
    )
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(1 << BITS), pos / max(1, pos + neg), False)
    share = {1: min(1.0, sample / 2 / pos)}
    share[0] = min(1.0, (sample - share[1] * pos) / neg)
    chosen = marks.where(hash_share(F.when(F.col("y") == 1, share[1]).otherwise(share[0]), "id"))
    rows = docs.select(
        F.col(ident).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"),
    ).join(F.broadcast(chosen.select("id")), "id")
    kind = rows.schema["id"].dataType.simpleString()
    # an id with several texts is learned from one of them, by the hash of the text
    made = rows.mapInPandas(
        _features, f"id {kind}, h long, words array<int>, per array<int>",
    ).groupBy("id").agg(F.max(F.struct("h", "words", "per")).alias("x"))
    made = materialise(made.join(F.broadcast(chosen.select("id", "y")), "id").select("id", "y", "x.words", "x.per"), "toxic-sample")
    held = made.agg(F.sum(F.size("words"))).head()[0] or 0
    made = made.where(hash_share(min(1.0, most_words / max(1, held)), "id", F.lit(1)))
    made = made.withColumn("w", F.when(F.col("y") == 1, 1.0 / share[1]).otherwise(1.0 / share[0]))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [
            (
                np.concatenate(b["words"].tolist()), np.concatenate(b["per"].tolist()), b["per"].map(len).to_numpy(), b["y"].to_numpy(),
                b["w"].to_numpy(),
            ) for b in batches if len(b)
        ]
        if parts:
            word, per, sentences, y, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            owner = np.repeat(np.arange(len(y)), sentences)
            w = _train(word, np.repeat(np.arange(len(per)), per), owner, y, weight)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"at": at, "w": w[at]})

    found = made.repartition(1).sortWithinPartitions("id").mapInPandas(learn, "at long, w double").toPandas()
    w = np.zeros(1 << BITS)
    w[found["at"].to_numpy()] = found["w"].to_numpy()
    return Model(w, pos / (pos + neg))


def _sentence_logs(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    word, sentence, owner, first, last = sentence_words(texts)
    z = np.clip(_sentence_sums(model.weights[word], sentence, len(owner)) + BIAS, -30, 30)
    return _log_clean(z), owner, first, last


def _scores(model: Model, texts: list[str]) -> pd.DataFrame:
    """Per text its score, its number of sentences, and where its worst sentence is (none where no sentence has evidence)."""
    clean, owner, first, last = _sentence_logs(model, texts)
    n = len(texts)
    s = -np.expm1(np.bincount(owner, clean, minlength=n)) if model.fitted else np.full(n, model.rate)
    worst = np.lexsort((-first, -clean, owner))[np.cumsum(np.bincount(owner, minlength=n)) - 1]
    p = -np.expm1(clean[worst])
    out = pd.DataFrame(
        {"score": s, "sentences": np.bincount(owner, minlength=n), "worst_start": first[worst], "worst_end": last[worst], "worst_score": p}
    )
    return out.astype({"worst_start": "Int64", "worst_end": "Int64"}).mask(
        pd.DataFrame({c: p <= 0 for c in ("worst_start", "worst_end")}).reindex(columns=out.columns, fill_value=False)
    )


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``score``, the number of ``sentences`` of each whole text, and its worst sentence: ``worst_start``, ``worst_end``
    (code points, from its first to behind its last word; null where no sentence has evidence) and ``worst_score``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, texts in chunks(batch["text"], _CHARS):
                found = _scores(model, texts)
                found.insert(0, "id", batch["id"].iloc[at : at + len(texts)].to_numpy())
                yield found

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, sentences long, worst_start long, worst_end long, worst_score double"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", ident)


def sentences(docs: DataFrame, model: Model, least: float = THRESHOLD, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """All offending sentences: ``ident``, ``start`` and ``end`` (as in :func:`score`) and ``score``, for scores of at least ``least``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, texts in chunks(batch["text"], _CHARS):
                clean, owner, first, last = _sentence_logs(model, texts)
                p = -np.expm1(clean)
                hit = p >= least
                yield pd.DataFrame(
                    {"id": batch["id"].iloc[at + owner[hit]].to_numpy(), "start": first[hit], "end": last[hit], "score": p[hit]}
                )

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(
        run, f"id {rows.schema['id'].dataType.simpleString()}, start long, end long, score double",
    ).withColumnRenamed("id", ident)


def held_out(ident: str = "doc_id") -> Column:
    """Documents whose labels the learning must not see: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 4 == 2, F.lit(False))


def assess(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels that may be learned, then score all documents: ``ident, held_out, score, predicted`` and the worst sentence."""
    model = fit(docs, labels, ~held_out(ident), ident, text)
    rows = score(docs, model, ident, text)
    marks = [held_out(ident).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")]
    return rows.select(ident, *marks, "worst_start", "worst_end", "worst_score")


def keep_clean(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose own score reaches the threshold, whatever their ids."""
    model = fit(docs, labels, ~held_out(ident), ident, text)

    @F.pandas_udf("double")
    def own_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                np.concatenate([np.zeros(0), *(_scores(model, texts)["score"].to_numpy() for _, texts in chunks(batch, _CHARS))])
            )

    return packed(docs, score=own_score(F.col(text))).where(F.col("score") < threshold).select("row.*")
