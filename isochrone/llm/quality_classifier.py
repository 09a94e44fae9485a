"""Quality classifier by Bradley-Terry ranking of preference pairs.

The score of a document is linear in features of its text, and the probability that one document is
preferred over another is the logistic function of the difference of their scores. The weights minimise
that logistic loss, with an L2 term, over pairs of a better and a worse labelled document: no intercept,
because only differences count. The score is then cut at a quantile of the scores of all labelled documents
that are not held out, the share of low-quality ones, so about as many are rejected as the labels reject.

Features are DataFrame expressions of one row, so every text is measured whole, in its own task, and
scoring is one more expression: no shuffle of documents at all. Labelled documents are reduced to one row
per label, id and features, a few numbers each, and written once. The fit sees a bounded sample of those
(``SAMPLE`` per class, each class on its own, those with the smallest hash) and runs in the driver on at
most ``PAIRS`` pairs; its cost does not depend on the input. The quantile is taken over all of them.

Defined results: a NULL or empty text has no words and all its shares are 0; it gets a score like any
other. Repeated rows are scored alike and teach once, so an id with very many rows cannot push a class
out of the fit. Labels without a document or with a NULL label or ``doc_id`` teach nothing; a repeated
label counts once, contrary labels of an id count in both classes. Without labels of both kinds all weights are 0
and every document stands at the threshold. An empty table gives an empty result. Other columns, also
columns named like a feature, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, stored
from .quality_rules import measure

SAMPLE = 10_000
PAIRS = 200_000
#: The score of a document at the quantile.
CUT = 0.3
#: Relative precision of the rank of the quantile.
RANKS = 100_000

#: Feature name -> SQL over the measurements of ``quality_rules.measure``.
FEATURES = {
    "size": "ln(1D + n_words)",
    "tiny": "CASE WHEN n_words < 10 THEN 1D ELSE 0D END",
    "word_length": "coalesce(abs(word_chars / nullif(n_words, 0) - 5.5D), 5.5D)",
    "symbols": "coalesce(least(n_symbols / nullif(n_words, 0), 1D), 0D)",
    "any_symbols": "coalesce(least(20D * n_symbols / nullif(n_words, 0), 1D), 0D)",
    "repeats": "coalesce(n_repeat_words / nullif(n_words, 0), 0D)",
    "many_repeats": "coalesce(least(5D * n_repeat_words / nullif(n_words, 0), 1D), 0D)",
    "repeated_lines": "coalesce(n_dup_lines / nullif(n_lines, 0), 0D)",
    "capitals": "coalesce(n_capitals / nullif(word_chars, 0), 0D)",
    "many_capitals": "coalesce(least(3D * n_capitals / nullif(word_chars, 0), 1D), 0D)",
}


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    #: Raw score at the chosen quantile.
    threshold: float

    def raw(self) -> Column:
        """The raw score from the feature columns."""
        total = F.lit(0.0)
        for name, w in zip(FEATURES, self.weights, strict=True):
            total = total + F.col(name) * F.lit(w)
        return total

    def score(self) -> Column:
        """Score from 0 to 1: ``CUT`` at the threshold, logistic in the raw score around it."""
        shift = float(np.log(CUT / (1 - CUT)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.raw() - F.lit(self.threshold) + F.lit(shift))))


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    measured = measure(docs, keep)
    return measured.select(*[F.col(f"`{c}`") for c in keep], *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: a fifth of the ids, by checksum; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_pairs(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights from rows and 0/1 labels: Newton steps on the pairwise logistic loss."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    rng = np.random.default_rng(17)
    n = min(PAIRS, 20 * max(len(good), len(bad)))
    # every document is in about as many pairs as the others of its class
    a = np.resize(rng.permutation(len(good)), n)
    b = rng.permutation(np.resize(rng.permutation(len(bad)), n))
    scale = np.maximum(x.std(axis=0), 1e-9)
    d = (good[a] - bad[b]) / scale
    w = np.zeros(d.shape[1])

    def loss(w):
        return np.logaddexp(0, -d @ w).mean() + penalty / 2 * w @ w

    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        gradient = -(d * p[:, None]).mean(axis=0) + penalty * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w)), gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w / scale


def labelled_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """quality and features of every labelled document that is not held out, from the features of all: one row per
    id, label and features, combined map-side, so that the rows of a hot id are few when they leave their task."""
    require(labels, "doc_id", "quality")
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("label_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("label_id"))).distinct()
    return measured.join(usable, F.col("doc_id") == F.col("label_id")).select("doc_id", "quality", *FEATURES).distinct()


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``labelled_rows`` of documents. Texts are measured before the join: they never travel."""
    require(docs, "doc_id", "text")
    return labelled_rows(features(docs), labels)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents that are not held out."""
    return fit_rows(labelled_features(docs, labels), sample)


def fit_rows(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """``fit`` on labelled features."""
    rows = stored(labelled, "classifier-rows")
    order = [F.xxhash64("doc_id", *FEATURES), F.col("doc_id"), *[F.col(f) for f in FEATURES]]
    picked = [rows.where(F.col("quality") == q).orderBy(*order).limit(sample).toPandas() for q in (0, 1)]
    x = np.concatenate([p[list(FEATURES)].to_numpy("float64").reshape(-1, len(FEATURES)) for p in picked])
    weights = fit_pairs(x, np.repeat([0, 1], [len(p) for p in picked]))
    model = Model(tuple(weights.tolist()), 0.0)
    if not weights.any():
        return model
    raw = stored(rows.select("quality", model.raw().alias("raw")), "classifier-raw")
    low = raw.agg(F.avg(1 - F.col("quality"))).first()[0]
    below = raw.agg(F.percentile_approx("raw", low, RANKS)).first()[0]
    above = raw.where(F.col("raw") > below).agg(F.min("raw")).first()[0]
    return Model(model.weights, (below + (below if above is None else above)) / 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    return score_rows(features(docs), model)


def score_rows(measured: DataFrame, model: Model) -> DataFrame:
    """``score`` on features."""
    scored = measured.withColumn("score", model.score())
    return scored.select("doc_id", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn and score; texts are measured once for both."""
    require(docs, "doc_id", "text")
    measured = stored(features(docs), "classifier-features")
    return score_rows(measured, fit_rows(labelled_rows(measured, labels), sample))
