"""A quality classifier learnt from positives and unlabelled text.

Trusted positives are documents labelled 1; the unlabelled side is web text without a label, documents that `labels` doesn't mention. Labels
of 0 are not used. With class prior p, the risk of a scorer g is p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)]):
the unbiased risk with its negative part kept from falling below zero. A small network on a text's shape (shares of kinds of characters,
repetition, lengths) and content (hashed three-byte grams) minimises it with logistic loss.

The prior is estimated from the two sides alone. A first scorer tells positives from unlabelled text on one half of each; on the other
halves, the share of unlabelled text above a threshold is at least the prior times the share of positives there, so the least ratio
of the two over thresholds, each with its margin of error, bounds the prior from above and is its estimate.

Training rows have crc32(id) mod 4 other than 2; of these a bounded sample is used: the POSITIVES and UNLABELLED ids with the
smallest md5. Where an id has several texts, the least of them is taken. All documents are scored, whole, in one pass.

Defined cases: null and empty texts have zero features and get a score like any others. An id counts as positive if the largest of its labels is 1;
a null label is no label, but its id isn't unlabelled. Rows without an id are scored, never sampled. Without positives or without unlabelled text every
score is 0.5. Repeated rows and ties in text get equal scores. A very long text is read whole by one task, which holds it a few times. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, table, uniform

POSITIVES = 3000
UNLABELLED = 6000
HIDDEN = 10
STEPS = 400
#: Steps of the scorer that the prior is estimated with.
FIRST_STEPS = 150
RATE = 0.02
DECAY = 1e-3
PREDICT_AT = 0.7
SHAPE = ("words", "distinct", "adjacent", "top", "upper", "digits", "marks", "others", "high", "word_length", "lines", "repeated_lines", "repeated_pairs")
#: Hash buckets of three-byte grams.
GRAMS = 64
WIDTH = len(SHAPE) + GRAMS

_SPECIAL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and not _SPECIAL[b] for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def content(b: np.ndarray) -> np.ndarray:
    """Roots of the shares of a text's three-byte grams in GRAMS buckets; A-Z count as a-z."""
    low = (b | ((b >= 65) & (b <= 90)).astype(np.uint8) << 5).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(GRAMS)
    h = (low[:-2] * np.uint32(0x01000193) ^ low[1:-1]) * np.uint32(0x01000193) ^ low[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(26)
    return np.sqrt(np.bincount(h, minlength=GRAMS) / len(h))


def features(text: str) -> np.ndarray:
    """The shape of a whole text, in SHAPE's order, and its content; every value is 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(WIDTH)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(b, minlength=256)
    size = counts.sum()
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    shape = [
        np.log1p(n) / 10,
        len(set(words)) / n,
        sum(a == b for a, b in pairs) / n,
        Counter(words).most_common(1)[0][1] / n,
        counts[_UPPER].sum() / size,
        counts[_DIGIT].sum() / size,
        counts[_SPECIAL].sum() / n / 3,
        counts[_MARK].sum() / n / 3,
        counts[128:].sum() / size,
        min(size / n / 20, 3.0),
        min(len(lines) / n * 5, 3.0),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
    ]
    return np.concatenate([shape, content(b)])


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) if isinstance(t, str) else np.zeros(WIDTH) for t in texts]).reshape(len(texts), WIDTH)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]  # w1, b1, w2, b2

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(logits(self.params, self.scaled(x))[1])


def logits(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ params[0] + params[1])
    return h, h @ params[2] + params[3]


def parts_of_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part, and the negative part before it is kept from falling below zero."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def step_of(params: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The risk, and the direction to go against: its gradient, or, where the negative part is below zero, that part's gradient reversed."""
    (hp, zp), (hu, zu) = logits(params, p), logits(params, u)

    def back(x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dz, params[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]

    right, negative = parts_of_risk(zp, zu, prior)
    rise = back(u, hu, _sigmoid(zu) / len(u))
    if negative < 0:
        return right, [b - a for a, b in zip(rise, back(p, hp, prior * _sigmoid(zp) / len(p)), strict=True)]
    # loss(z) - loss(-z) = -z, so both terms of the positives make one
    return right + negative, [a + b for a, b in zip(rise, back(p, hp, np.full(len(p), -prior / len(p))), strict=True)]


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS, seed: int = 7) -> Scorer:
    """Minimises the non-negative risk by Adam over all rows."""
    rng = np.random.default_rng(seed)
    d = unl.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    out = Scorer(unl.mean(axis=0), unl.std(axis=0) + 1e-3, params)
    p, u = out.scaled(pos), out.scaled(unl)
    m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for step in range(1, steps + 1):
        for i, g in enumerate(step_of(params, p, u, prior)[1]):
            g = g + DECAY * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return out


def least_ratio(pos: np.ndarray, unl: np.ndarray) -> float:
    """The prior, from scores of held-back positives and unlabelled texts: the least ratio of the shares at or above a threshold, margins included."""
    at = np.unique(pos)
    above = lambda x: 1 - np.searchsorted(np.sort(x), at, "left") / len(x)
    p, u = above(pos), above(unl)
    margin = np.sqrt(np.log(40) / 2 / len(pos)) + np.sqrt(np.log(40) / 2 / len(unl))  # each share is this near with 95 %
    best = int(np.argmin((u + margin) / p))
    return float(min(0.99, max(0.01, u[best] / p[best])))


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unl, without negatives."""
    first = fit(pos[::2], unl[::2], 0.5, FIRST_STEPS)
    held = [x[1::2] if len(x) > 1 else x for x in (pos, unl)]
    return least_ratio(first.scores(held[0]), first.scores(held[1]))


def held_in(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) != 2, F.lit(True))


def smallest(ids: DataFrame, most: int, rows: int) -> DataFrame:
    """Of ids (doc_id), `rows` many with repeats, the `most` with the smallest md5. Few more than four times as many are put in order."""
    near = ids.where(F.col("doc_id").isNotNull() & (uniform(F.col("doc_id")) < min(1.0, 4 * most / max(1, rows)))).distinct()
    return near.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def samples(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sampled positives and unlabelled documents, ordered by the md5 of their ids."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ones = marks.where((F.col("quality") == 1) & held_in(F.col("doc_id"))).select("doc_id")
    known = docs.where(held_in(F.col("doc_id"))).select("doc_id")
    rows = known.count()
    near = known.where(uniform(F.col("doc_id")) < min(1.0, 16 * UNLABELLED / max(1, rows))).distinct()
    unlabelled = smallest(near.join(marks.select("doc_id"), "doc_id", "left_anti"), UNLABELLED, rows // 4)
    chosen = smallest(ones, POSITIVES, ones.count()).withColumn("positive", F.lit(1)).union(unlabelled.withColumn("positive", F.lit(0)))
    # at most POSITIVES + UNLABELLED rows
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = held.groupBy("doc_id", "positive").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    one = one.select("positive", F.md5(F.col("doc_id").cast("string")).alias("at"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "at": batch["at"], "x": list(matrix(batch["text"]).astype("<f4"))})

    found = one.mapInPandas(run, "positive int, at string, x array<float>").toPandas().sort_values("at")
    sides = [found.loc[found["positive"] == k, "x"].tolist() for k in (1, 0)]
    return tuple(np.array(x, np.float64).reshape(len(x), WIDTH) for x in sides)


def train(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """docs (doc_id, text); labels (doc_id, quality): a scorer, or nothing where nothing can be learnt."""
    pos, unl = samples(docs, labels)
    return fit(pos, unl, estimated_prior(pos, unl)) if len(pos) and len(unl) else None


def score(model: Scorer | None) -> Column:
    """The score of the column `text`."""

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(matrix(text)) if model else np.full(len(text), 0.5))

    return F.pandas_udf(run, "double")(F.col("text"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (~held_in(F.col("doc_id"))).alias("held_out"), score(model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0))
