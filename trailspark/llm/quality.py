"""Quality classifier by co-training two views.

The *text view* sees the text's content: shares of symbols, capitals and
digits, repetition, word and line shapes, hashed words.  The *metadata view*
sees source, language, length and nulls, never the text.  Each is a regularised
logistic regression, fitted by Newton steps.

*Co-training.*  Both start from the labelled sample.  In each of ``rounds``
rounds each view labels the unlabelled pool and hands its most confident
pseudo-labels, those surer than ``confident`` once calibrated and in the
classes' proportion, to the other view's training set.  Of the labelled rows kept
out of training, one half calibrates each view by Platt scaling and the other
half fits a logistic regression over the two calibrated scores, which combines
them.  The combined score of every document comes from its whole text.

The fit takes at most about ``labelled`` labelled and ``pool`` unlabelled
documents, chosen by a hash of the id and read in one pass; only their features
reach the driver.  The pool is the method's own: co-training draws a pool from the
unlabelled rows at random.  README has the accuracy with larger pools.

Defined cases: null text has the features of an empty one; null metadata is a
value of its own; labels with nulls are void, and repeated labels of a document
vote (ties are good); without labels of both classes, as from empty tables, every
document scores 1 and is kept; a score equal to the threshold is kept; null ids
are scored but not learned from; repeated rows are each scored alike; texts of any
length are read whole, one at a time.  Columns of the documents are kept, whatever
their names; ``into`` replaces one of that name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import short_batches, spare_name

LABELLED = 4000
POOL = 4000
ROUNDS = 4
PER_ROUND = 200
CONFIDENT = 0.95
THRESHOLD = 0.5
WORD_BUCKETS = 128
SOURCE_BUCKETS = 64
LANG_BUCKETS = 16
RIDGE = 1.0

_STATS = 18
_SYMBOLS = b"#$%&*+<=>@^_`{|}~\\"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_END = re.compile(rb"[.!?]")


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(_STATS + WORD_BUCKETS)
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        out[0] = 1
        return out
    n, size = len(words), len(data)
    kept = lambda drop: len(data.translate(None, drop))
    letters = max(1, kept(_NOT_LETTER))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    plain = sum(1 for w in words if w.isalpha() or not w.isascii())
    out[1:_STATS] = (
        math.log1p(n), math.log1p(size), size / n, kept(_NOT_SYMBOL) / size, kept(_NOT_UPPER) / letters, letters / size, kept(_NOT_DIGIT) / size,
        data.count(b"!") / n, data.count(b"|") / n, len(counts) / n, math.log1p(same / n * 100), max(counts.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), len(_END.findall(data)) / n, sum(w.isupper() for w in words) / n, plain / n,
    )
    for word, c in counts.items():
        out[_STATS + zlib.crc32(word.lower()) % WORD_BUCKETS] += c
    out[_STATS:] = np.sqrt(out[_STATS:] / n)
    return out


def metadata_features(source: str | None, lang: str | None, n_chars) -> np.ndarray:
    out = np.zeros(SOURCE_BUCKETS + LANG_BUCKETS + 4)
    hashed = lambda x, n: 0 if x is None else 1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (n - 1)
    out[hashed(source, SOURCE_BUCKETS)] = 1
    out[SOURCE_BUCKETS + hashed(lang, LANG_BUCKETS)] = 1
    known = n_chars is not None and not pd.isna(n_chars)
    size = math.log1p(max(0, n_chars)) if known else 0.0
    out[-4:] = (not known, size, size * size / 10, max(0.0, 4 - size))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(z @ w)
            gradient = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), gradient)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


@dataclass
class CoTrained:
    """Two views, their calibrations and the combination; ``views`` is empty if there was nothing to learn."""

    views: tuple = ()
    calibrations: tuple = ()
    combination: Logistic | None = None

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.views:
            one = np.ones(len(text))
            return one, one, one
        parts = [c.score(v.score(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta), strict=True)]
        return sigmoid(parts[0]), sigmoid(parts[1]), sigmoid(self.combination.score(np.c_[parts[0], parts[1]]))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, *, rounds: int = ROUNDS, per_round: int = PER_ROUND, confident: float = CONFIDENT) -> CoTrained:
    """``y`` is 0 or 1 for each labelled row; of every ten rows of a class one is kept to calibrate and one to combine.

    Classes too small for that are used for everything.
    """
    held, combine = np.zeros(len(y), bool), np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        held[own[::10]] = True
        combine[own[5::10] if len(own) > 5 else own[::10]] = True
    kept = held | combine
    train = ~kept if len({*y[~kept]}) == 2 else np.ones(len(y), bool)
    if len({*y[train]}) < 2:
        return CoTrained()
    x, pool = (text, meta), (pool_text, pool_meta)
    sets = [(v[train], y[train]) for v in x]
    free = [np.ones(len(pool_text), bool) for _ in x]  # what each view has not been taught
    share = float(y[train].mean())
    fits = lambda: [Logistic.fit(*s) for s in sets]
    calibrate = lambda views: [Logistic.fit(v.score(a[held])[:, None], y[held].astype(float), 1e-2) for v, a in zip(views, x, strict=True)]
    for _ in range(rounds):
        views = fits()
        scales = calibrate(views)
        new = []
        for teacher in (0, 1):
            pupil = 1 - teacher
            p = sigmoid(scales[teacher].score(views[teacher].score(pool[teacher])[:, None])) if len(pool_text) else np.empty(0)
            for label, sure, quota in ((1, p, share), (0, 1 - p, 1 - share)):
                rows = np.flatnonzero(free[pupil] & (sure >= confident))
                rows = rows[np.argsort(-sure[rows], kind="stable")[: max(1, round(per_round * quota))]]
                free[pupil][rows] = False
                new.append((pupil, rows, label))
        for pupil, rows, label in new:
            a, b = sets[pupil]
            sets[pupil] = np.concatenate([a, pool[pupil][rows]]), np.concatenate([b, np.full(len(rows), label)])
        if not any(len(rows) for _, rows, _ in new):
            break
    views = fits()
    scales = calibrate(views)
    both = np.c_[tuple(c.score(v.score(a[combine])[:, None]) for v, c, a in zip(views, scales, x, strict=True))]
    return CoTrained(tuple(views), tuple(scales), Logistic.fit(both, y[combine].astype(float), 1e-2))


def _features(docs: DataFrame, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    """``docs`` with array columns ``t`` and ``m``."""

    def compute(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = [(text_features(t), metadata_features(s, g, n)) for t, s, g, n in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=["t", "m"])

    return docs.withColumn("f", F.pandas_udf(compute, "t array<float>, m array<float>")(F.col(text), F.col(source), F.col(lang), F.col(n_chars)))


def _matrices(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = rows.select("i", "y", "f.t", "f.m").toPandas().sort_values(["i"], kind="stable")  # bounded by the samples
    wide = lambda c, n: np.stack(found[c].to_numpy()).astype(float) if len(found) else np.zeros((0, n))
    return wide("t", _STATS + WORD_BUCKETS), wide("m", SOURCE_BUCKETS + LANG_BUCKETS + 4), found["y"].to_numpy()


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
    quality: str = "quality", labelled: int = LABELLED, pool: int = POOL, **options,
) -> CoTrained:
    short_batches(docs.sparkSession)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    votes = labels.select(F.col(doc_id).alias("i"), F.col(quality).cast("double").alias("q")).dropna().groupBy("i").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    counts = {r.y: r.n for r in votes.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return CoTrained()
    bound = lambda n, most: F.lit(min(1.0, most / max(1, n)))
    rate = F.when(F.col("y") == 1, bound(counts[1], labelled / 2)).otherwise(bound(counts[0], labelled / 2))
    sample = votes.where(draw < rate)  # about ``labelled`` rows at most, so small enough to broadcast
    named = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("x"), F.col(source).cast("string").alias("s"), F.col(lang).cast("string").alias("g"), F.col(n_chars).cast("long").alias("n"))
    n_docs = docs.count()  # reads no column
    drawn = F.col("i").isNotNull() & (draw < bound(n_docs, pool))
    known = sample.select(F.col("i").alias("j"), "y")
    both = named.join(F.broadcast(known), F.col("i") == F.col("j"), "left").where(F.col("y").isNotNull() | drawn).withColumn("y", F.coalesce("y", F.lit(-1)))
    x_text, x_meta, y = _matrices(_features(both, "x", "s", "g", "n"))
    seen = y >= 0
    if len({*y[seen]}) < 2:
        return CoTrained()
    return co_train(x_text[seen], x_meta[seen], y[seen].astype(int), x_text[~seen], x_meta[~seen], **options)


def score(
    docs: DataFrame, model: CoTrained, *, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", threshold: float = THRESHOLD, into: str = "quality_score",
) -> DataFrame:
    """``docs`` with a struct column ``into``: text_score, meta_score, score, keep."""
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = [(text_features(t), metadata_features(s, g, n)) for t, s, g, n in zip(*columns, strict=True)]
            if rows:
                a, b, c = held.value.probabilities(np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows]))
            else:
                a = b = c = np.empty(0)
            yield pd.DataFrame({"text_score": a, "meta_score": b, "score": c, "keep": c >= threshold})

    kind = "text_score double, meta_score double, score double, keep boolean"
    apply = F.pandas_udf(run, kind).asNondeterministic()  # or a filter on its result would run it twice
    return docs.withColumn(into, apply(F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(n_chars).cast("long")))


def keep_good(docs: DataFrame, model: CoTrained, **options) -> DataFrame:
    name = spare_name(docs, "quality")
    return score(docs, model, into=name, **options).where(F.col(f"{name}.keep")).drop(name)
