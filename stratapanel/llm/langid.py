"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed n-grams of one to three characters of the lower-cased text, where everything but letters is one space; the
value is (count / number of n-grams) x idf.  Document frequencies count all learnable documents, each task folding its own
into one vector.  The regression is trained on a bounded sample by FTRL-proximal with elastic-net (L1 and L2) penalties: shards
learn on their own from the same state, and their states are averaged after each round.  A temperature fitted on documents
that the training left out calibrates the probabilities.

Cases: null texts and texts without a letter are ``und`` with score 0; with no learnable document at all every text is ``und``;
with one language that language is always predicted; repeated rows are scored alike; null ids are scored and count as learnable
only where their label is present; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, materialise, small_batches
from .textvec import chunks, letters

DIMS = 1 << 16
ORDERS = (1, 2, 3)
#: About so many documents, shared out evenly over the languages, are fitted; the rest is only counted.
SAMPLE = 6000
SHARDS, ROUNDS, EPOCHS = 8, 2, 2
UNKNOWN = "und"
_CHARS = 800_000
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    notes: dict = field(default_factory=dict)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the hashed n-gram at each kept position and the text of that position; and whether a text has a letter."""
    units, is_letter, ends = letters(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    has = np.zeros(len(texts), bool)
    has[owner[is_letter]] = True
    space = ~is_letter
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space behind each word
    keep[0] = True
    units, owner, space = np.where(space, 32, units)[keep].astype(np.uint64), owner[keep], space[keep]
    out = []
    for n in ORDERS:
        m = len(units) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += units[j : j + m] * _MULT[j]
        h *= _MULT[0] + np.uint64(2 * n)
        inside = owner[:m] == owner[n - 1 :]
        if n == 1:
            inside &= ~space
        out.append(((h[inside] >> np.uint64(48)).astype(np.int64), owner[:m][inside]))
    return out, has, np.bincount(np.concatenate([o for _, o in out]), minlength=len(texts))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, seen, docs = np.zeros(DIMS, np.int64), np.zeros(DIMS, bool), 0
    for batch in batches:
        for _, texts in chunks(batch["text"], _CHARS):
            found, _, _ = grams(texts)
            bounds = [np.searchsorted(o, np.arange(len(texts) + 1)) for _, o in found]
            for d in range(len(texts)):
                mine = [g[b[d] : b[d + 1]] for (g, _), b in zip(found, bounds, strict=True)]
                for g in mine:
                    seen[g] = True
                df += seen
                for g in mine:
                    seen[g] = False
            docs += len(texts)
    at = np.flatnonzero(df)
    yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(df[at], docs)})


def _vectors(texts: list[str], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and TF-IDF values of each text."""
    found, _, total = grams(texts)
    g, o = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    keys, n = np.unique(o * DIMS + g, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * DIMS)
    at = keys % DIMS
    value = n * idf[at] / total[keys // DIMS]
    for d in range(len(texts)):
        yield at[bounds[d] : bounds[d + 1]], value[bounds[d] : bounds[d + 1]]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """FTRL-proximal state of a multinomial regression; the last row is the bias, which has no penalty."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _shard(state: tuple[np.ndarray, np.ndarray], idf: np.ndarray, langs: list[str], epochs: int, seed: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "text"]).sample(frac=1.0, random_state=seed)
        model = Ftrl(state[0].copy(), state[1].copy())
        vectors, labels = list(_vectors(list(rows["text"]), idf)), [langs.index(x) for x in rows["label"]]
        for _ in range(epochs):
            for (at, x), label in zip(vectors, labels, strict=True):
                model.learn(np.append(at, DIMS), np.append(x * 30.0, 1.0), label)
        i, j = np.nonzero(model.n)
        return pd.DataFrame({"at": i * len(langs) + j, "z": model.z[i, j], "n": model.n[i, j]})

    return fit


def _logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    table = (model.weights * (30.0 * model.idf[:, None])).astype(np.float32)
    found, has, total = grams(texts)
    out = np.zeros((len(texts), len(model.langs)))
    for g, o in found:
        if not len(g):
            continue
        start = np.flatnonzero(np.diff(o, prepend=-1))
        for j in range(out.shape[1]):
            out[o[start], j] += np.add.reduceat(table[:, j][g], start, dtype=np.float64)
    return out / np.maximum(total, 1)[:, None] + model.bias, has


def _scorer(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for at, texts in chunks(batch["text"], _CHARS):
                part = batch.iloc[at : at + len(texts)].drop(columns=["text"])
                if model.langs:
                    z, has = _logits(model, texts)
                    p = _softmax(z / model.temperature)
                    best = np.where(has, p.argmax(axis=1), len(model.langs))
                    score = np.where(has, p.max(axis=1), 0.0)
                else:
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                yield part.assign(lang_pred=names[best], score=score)

    return run


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises the log loss, by golden-section search on its logarithm.

    The targets are smoothed by one case in len(y) + 2, else separable documents would drive the temperature to 0.
    """
    eps = 1.0 / (len(y) + 2)
    target = np.full(z.shape, eps / max(1, z.shape[1] - 1))
    target[np.arange(len(y)), y] = 1.0 - eps
    loss = lambda t: -(target * np.log(np.maximum(_softmax(z / math.exp(t)), 1e-300))).sum(axis=1).mean()
    lo, hi, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows where ``learnable`` holds and the label is present."""
    small_batches(docs.sparkSession)
    known = docs.where(
        learnable & F.col(lang).isNotNull() & F.col(text).isNotNull()
    ).select(F.col(text).alias("text"), F.col(lang).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(DIMS), np.zeros((DIMS, 0)), np.zeros(0))
    rows = known.select("text").mapInPandas(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df, docs_n = np.zeros(DIMS), 0
    for r in rows:
        if r["at"] < 0:
            docs_n = r["n"]
        else:
            df[r["at"]] = r["n"]
    idf = np.log((1.0 + docs_n) / (1.0 + df)) + 1.0
    share = {k: min(1.0, sample / len(langs) / n) for k, n in counts.items()}
    cut = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
    # of a text with several labels the most frequent one counts, of these the first
    chosen = known.where(hash_share(cut[F.col("label")], "text")).groupBy("text", "label").agg(F.count("*").alias("n"))
    chosen = chosen.groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
    chosen = materialise(chosen.withColumn("shard", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SHARDS + 1))), "lang-sample")
    z, n = np.zeros((DIMS + 1, len(langs))), np.zeros((DIMS + 1, len(langs)))
    train = chosen.where(F.col("shard") < SHARDS)
    for number in range(ROUNDS):
        parts = train.groupBy("shard").applyInPandas(_shard((z, n), idf, langs, EPOCHS, number), "at long, z double, n double")
        shards = max(1, train.select("shard").distinct().count())
        merged = parts.groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toPandas()
        at = merged["at"].to_numpy()
        z, n = np.zeros_like(z), np.zeros_like(n)
        z.flat[at], n.flat[at] = merged["z"].to_numpy(), merged["n"].to_numpy()
    w = Ftrl(z, n).weights(np.arange(DIMS + 1))
    model = Model(langs, idf, w[:-1], w[-1])
    left = chosen.where(F.col("shard") == SHARDS)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, texts in chunks(batch["text"], _CHARS):
                logits, has = _logits(model, texts)
                yield pd.DataFrame({"label": batch["label"].iloc[at : at + len(texts)].to_numpy()[has], "z": list(logits[has])})

    held = left.mapInPandas(raw, "label string, z array<double>").toPandas()
    if len(held):
        model.temperature = _temperature(np.stack(held["z"]), np.array([langs.index(x) for x in held["label"]]))
    model.notes = {"sampled": int(chosen.count()), "nonzero": int((model.weights != 0).any(axis=1).sum())}
    return model


def predict(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """Language and calibrated probability of each whole text; ``also`` adds columns computed from the row."""
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), *[c.alias(k) for k, c in (also or {}).items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items() if k != "text") + ", lang_pred string, score double"
    return rows.mapInPandas(_scorer(model), schema).withColumnRenamed("id", ident)


def held_out(ident: str = "doc_id") -> Column:
    """Documents that the learning must not see: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Fit on all documents but the held-out ones, then predict all: ``ident, held_out, lang_pred, score``."""
    model = fit(docs, ~held_out(ident), text, lang, sample)
    return predict(docs, model, ident, text, {"held_out": held_out(ident)}).select(ident, "held_out", "lang_pred", "score")
