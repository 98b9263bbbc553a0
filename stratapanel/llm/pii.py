"""Personal data by weak supervision.

Base spans (e-mail, IP, card and phone numbers) follow fixed patterns and always stay.  Wider patterns propose candidates:
local phone numbers, spelled-out e-mails, secrets and social security numbers.  Three labelers vote on every span, base spans
too: the regex labeler on its strict shape, the gazetteer labeler on lists (top-level domains, issuers, key prefixes, code
words), the context labeler on the words in front.  Each may abstain.  Counts of vote patterns over all documents are all that
expectation-maximisation needs to estimate the labelers' reliabilities and the prior of each kind.  The posteriors train a
logistic span classifier on the different spans (by make-up and words in front; copies count once) of a sample that is bounded
for each kind, and a candidate becomes a span where the classifier says so.  Without anything to learn from, no candidate
does.

Offsets are code points, ends exclusive.  Spans of a kind never overlap; a candidate that overlaps a base span, or an earlier
candidate, is dropped.

Cases: null texts count as empty and have no spans; repeated rows are searched alike; with no candidate anywhere only base spans
are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, materialise, small_batches
from .textvec import chunks

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "email_spelled", "secret", "ssn")
KINDS = BASE + ADDED
#: At most about so many different spans train the classifier, an even share of each kind.
SAMPLE = 20_000
#: Pseudo-votes behind the first guess at a labeler's rates; they wash out as votes come in.
PRIOR_VOTES = 20.0
ACCEPT = 0.5
BUCKETS = 64
_CHARS = 2_000_000
_BEFORE = 32

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MORE = {
    "phone_local": re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "email_spelled": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,24}"
    ),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}

# The gazetteers.
_DOMAINS = set(
    "com org net edu gov mil int info biz name io ai app dev cloud me tv co eu us uk de fr es it nl be at ch se no dk fi pl cz sk hu ro bg gr pt ie lt lv ee ru ua tr il ae in cn jp kr "
    "tw hk sg my th vn id ph au nz ca mx br ar cl pe za ng ke eg example test".split()
)
_KEYS = (
    "sk-", "sk_", "pk-", "pk_", "rk_", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xox", "eyJ", "AIza", "ya29.",
    "npm_", "pypi-", "SG.", "hf_",
)
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
_HINTS = {
    "email": {"mail", "email", "contact", "write", "reach"},
    "phone": {"tel", "phone", "call", "fax", "mobile", "dial"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "visa", "credit", "mastercard", "payment"},
    "secret": {"token", "key", "secret", "password", "api", "bearer"},
    "ssn": {"ssn", "social", "security"},
}
_AGAINST = {"sha", "commit", "md5", "version", "license", "isbn", "http", "https", "www"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds: leftmost, not overlapping within a kind, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the wider patterns propose, without those that overlap base spans or earlier candidates."""
    found = []
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _MORE.items():
        if digits if kind != "email_spelled" else (" dot " in text or "dot]" in text or "dot)" in text):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if not found:
        return []
    taken = sorted((a, b) for a, b, _ in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, last = [], -1
    for a, b, kind in sorted(found):
        before = bisect_left(starts, b)  # base spans that begin before b; one of them ends behind a if the farthest does
        if a >= last and not (before and reach[before - 1] > a):
            out.append((a, b, kind))
            last = b
    return out


def _kind_group(kind: str) -> str:
    return {"phone_local": "phone", "email_spelled": "email"}.get(kind, kind)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def votes(text: str, span: tuple[int, int, str]) -> tuple[int, int, int]:
    """The labelers' votes on a span: 1 for, 0 against, -1 abstains."""
    a, b, kind = span
    s = text[a:b]
    before = re.findall(r"[a-z0-9]+", text[max(0, a - _BEFORE) : a].lower())
    if kind in BASE:
        shape = 1
    elif kind == "phone_local":
        shape = int(s.lstrip("(")[0] not in "01")
    elif kind == "email_spelled":
        shape = int("[" in s or "(" in s) or -1
    elif kind == "secret":
        # a plain digest may be a key or a checksum: its shape doesn't tell
        shape = -1 if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", s) else int(_entropy(s) > 3.5)
    else:
        shape = int(s[:3] not in ("000", "666") and s[0] != "9")
    listed = -1
    if kind in ("email", "email_spelled"):
        listed = 1 if re.split(r"[^A-Za-z]+", s)[-1].lower() in _DOMAINS else -1
    elif kind == "card":
        listed = int(s.startswith(_ISSUERS))
    elif kind == "secret" and s.startswith(_KEYS):
        listed = 1
    elif kind == "ip":
        listed = int(not s.startswith(("0.", "127.", "255.")))
    hints = _HINTS[_kind_group(kind)]
    context = 1 if any(w in hints for w in before) else 0 if any(w in _AGAINST for w in before) else -1
    return shape, listed, context


def described(text: str, span: tuple[int, int, str]) -> tuple[list[float], list[int]]:
    """What the classifier sees of a span besides its kind: its make-up, in steps of 1/64, and the hashed words in front of it."""
    a, b, _ = span
    s = text[a:b]
    n = len(s)
    makeup = (
        sum(c.isdigit() for c in s) / n, sum(c.isupper() for c in s) / n, sum(not c.isalnum() for c in s) / n, math.log(n) / 5,
        _entropy(s) / 6,
    )
    words = {
        int.from_bytes(hashlib.md5(w.encode()).digest()[:2], "big") % BUCKETS for w in re.findall(
            r"[a-z]+", text[max(0, a - _BEFORE) : a].lower(),
        )
    }
    return [round(m * 64) / 64 for m in makeup], sorted(words)


_MAKEUP = 6


def _vector(kind: str, makeup: list[float], words: list[int]) -> np.ndarray:
    x = np.zeros(len(KINDS) + _MAKEUP + BUCKETS)
    x[KINDS.index(kind)] = 1.0
    x[len(KINDS) : len(KINDS) + _MAKEUP] = (*makeup, 1.0)
    x[[len(KINDS) + _MAKEUP + w for w in words]] = 1.0
    return x


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, texts in chunks(batch["text"], _CHARS):
            out = []
            for text in texts:
                base = base_spans(text)
                for span in base + candidates(text, base):
                    out.append((span[2], *votes(text, span), *described(text, span)))
            if out:
                yield pd.DataFrame(out, columns=["kind", "v1", "v2", "v3", "makeup", "words"])


def reliabilities(counts: pd.DataFrame, rounds: int = 200) -> pd.DataFrame:
    """EM over rows (kind, v1, v2, v3, n): adds the posterior ``p`` that spans with these votes are personal data.

    For each group of kinds (phone with local phone, and so on) each labeler has a hit rate and a false-alarm rate, each kind a
    prior; abstentions say nothing.  Base spans are certain, so they teach the hit rates of their group.  ``PRIOR_VOTES``
    pseudo-votes (labelers are better than chance) fix which class is which where a kind has few witnesses.
    """
    v = counts[["v1", "v2", "v3"]].to_numpy()
    n = counts["n"].to_numpy(dtype=float)
    kinds, of = np.unique(counts["kind"], return_inverse=True)
    groups, group = np.unique(counts["kind"].map(_kind_group), return_inverse=True)
    sure = counts["kind"].isin(BASE).to_numpy()
    # the first guess is the majority of the votes cast
    p = np.where(sure, 1.0, ((v == 1).sum(axis=1) + 0.5) / ((v >= 0).sum(axis=1) + 1.0))
    sums = lambda x: np.bincount(group, x, minlength=len(groups))
    for _ in range(rounds):
        prior = (np.bincount(of, n * p, minlength=len(kinds)) + 1) / (np.bincount(of, n, minlength=len(kinds)) + 2)
        odds = np.log(prior[of] / (1 - prior[of]))
        for j in range(3):
            yes, said = v[:, j] == 1, v[:, j] >= 0
            hit = ((sums(n * p * yes) + 0.8 * PRIOR_VOTES) / (sums(n * p * said) + PRIOR_VOTES))[group]
            alarm = ((sums(n * (1 - p) * yes) + 0.1 * PRIOR_VOTES) / (sums(n * (1 - p) * said) + PRIOR_VOTES))[group]
            odds += np.where(yes, np.log(hit / alarm), np.where(v[:, j] == 0, np.log((1 - hit) / (1 - alarm)), 0.0))
        p = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return counts.assign(p=p)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, l2: float = 1e-4) -> np.ndarray:
    w, acc = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    weight = weight / weight.sum()
    for _ in range(steps):
        g = x.T @ (weight * (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - l2 * w
        acc += g * g
        w += 0.5 * g / np.sqrt(acc)
    return w


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the span classifier; None where there is nothing to learn from."""
    small_batches(docs.sparkSession)
    votes_ = ["kind", "v1", "v2", "v3"]
    spans = docs.select(F.col(text).alias("text")).mapInPandas(
        _spans, "kind string, v1 int, v2 int, v3 int, makeup array<double>, words array<int>",
    )
    # spans that look alike fold in the map tasks, so that a footer in many copies is one row
    spans = materialise(spans.groupBy(*votes_, "makeup", "words").agg(F.count("*").alias("n")), "pii-spans")
    counts = spans.groupBy(*votes_).agg(F.sum("n").alias("n"), F.count("*").alias("looks")).toPandas()
    if not set(counts["kind"]) & set(ADDED):
        return None
    counts = reliabilities(counts.sort_values(votes_, ignore_index=True))
    shares = (sample / len(KINDS) / counts.groupby("kind")["looks"].sum()).clip(upper=1.0).to_dict()
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, float(v))])
    chosen = spans.where(hash_share(share[F.col("kind")], *votes_, "makeup", "words")).select(*votes_, "makeup", "words").toPandas()
    if not len(chosen):
        return None
    chosen = chosen.merge(counts.drop(columns=["n", "looks"]), on=votes_)
    chosen = chosen.assign(key=[(*m, *w) for m, w in zip(chosen["makeup"], chosen["words"], strict=True)]).sort_values([*votes_, "key"])
    x = np.stack([_vector(k, list(m), list(w)) for k, m, w in zip(chosen["kind"], chosen["makeup"], chosen["words"], strict=True)])
    return _logistic(x, chosen["p"].to_numpy(), 1.0 / chosen["kind"].map(shares).to_numpy(dtype=float))


def find(docs: DataFrame, weights: np.ndarray | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and ``spans``: an array of (kind, start, end, base) of each whole text, by start, then kind as listed."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, texts in chunks(batch["text"], _CHARS):
                rows = []
                for text_ in texts:
                    base = base_spans(text_)
                    spans = [(*s, True) for s in base]
                    for s in candidates(text_, base) if weights is not None else ():
                        if 1 / (1 + math.exp(-max(-30.0, min(30.0, float(_vector(s[2], *described(text_, s)) @ weights))))) >= ACCEPT:
                            spans.append((*s, False))
                    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                    rows.append([{"kind": k, "start": a, "end": b, "base": is_base} for a, b, k, is_base in spans])
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + len(texts)].to_numpy(), "spans": rows})

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", ident)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans per kind, a digest of the base spans, and all spans as text."""
    found = find(docs, fit(docs, text), ident, text)
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(ident, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
