"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any other document is unlabelled,
and toxic with the class prior's probability.  A linear classifier over word
evidence is trained in numpy by the risk estimator

    prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])

whose second term is kept from turning negative.  Both samples are bounded.
Scoring needs the weights of the chosen words alone and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import by_bytes, crc_mod, packed
from vectide.llm.learning import labels_of, sample_texts, smallest

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words in lower case."""
    return set(_WORDS.findall(text.lower())) if text else set()


class Scorer:
    """What is broadcast: weights of the chosen words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        known = self.weights
        z = np.array([self.bias + sum(known[w] for w in sorted(words_of(t) & known.keys())) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the estimator before the second is kept from turning negative: prior * E_p[l(+)], and E_u[l(-)] - prior * E_p[l(-)]; logistic loss, l(+) = -log s, l(-) = -log(1 - s)."""
    s_p, s_u = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
    rest = -np.log1p(-np.clip(s_u, 0, 1 - 1e-12)).mean() + prior * np.log1p(-np.clip(s_p, 0, 1 - 1e-12)).mean()
    return float(-prior * np.log(np.maximum(s_p, 1e-300)).mean()), float(rest)


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk where its second term is positive; where it has gone below zero, the step back from it."""
    s_p, s_u = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
    of_rest = u.T @ s_u / len(u) - prior * (p.T @ s_p) / len(p)
    if risk(w, p, u, prior)[1] < 0:
        return -of_rest
    return prior * (p.T @ (s_p - 1)) / len(p) + of_rest


def train(positive: list[str | None], unlabelled: list[str | None], prior: float, words: int = 2000, clear: float = 4.0, rounds: int = 800, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
    """nnPU training by full-batch Adam.

    words, clear: the words used are those whose share among positives exceeds
    that among unlabelled documents by at least `clear` standard errors, the
    clearest `words` of them.
    """
    if not positive:
        return Scorer({}, -60.0)
    in_p = Counter(w for t in positive for w in words_of(t))
    in_p = Counter({w: c for w, c in in_p.items() if c >= 3})
    in_u = Counter(w for t in unlabelled for w in words_of(t) & in_p.keys())
    n_p, n_u = len(positive), max(1, len(unlabelled))
    margin = {}
    for w, c in in_p.items():
        share, rest = c / n_p, (in_u[w] + c) / (n_u + n_p)
        z = (share - rest) / np.sqrt(rest * (1 - rest) / n_p + 1e-12)
        if z >= clear:
            margin[w] = z
    chosen = {w: k for k, w in enumerate(sorted(margin, key=lambda w: (-margin[w], w))[:words])}

    def matrix(texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(chosen) + 1), dtype=np.float32)
        x[:, -1] = 1
        for k, t in enumerate(texts):
            x[k, [chosen[w] for w in words_of(t) & chosen.keys()]] = 1
        return x

    p, u = matrix(positive), matrix(unlabelled or [None])
    w = np.zeros(len(chosen) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        g = gradient(w, p, u, prior) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Scorer({x: float(w[k]) for x, k in chosen.items()}, float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, positives: int = 4000, unlabelled: int = 8000, prior: float | None = None) -> Scorer:
    """A scorer from documents whose crc32(doc_id) mod fold is not `held`.

    positives, unlabelled: bounds of the two samples, rows with the smallest
    hashes of their ids.  prior: share of toxic documents; by default their share
    among all labelled rows learned from.  An id with several labels has their
    rounded mean; labels without a document, null labels and null ids teach
    nothing; a repeated document counts as often as it is there.  Words count
    once a text, however long it is.  Empty tables give a scorer of 0.
    """
    own = labels_of(labels, "toxic", crc_mod("doc_id", fold) != held)
    if prior is None:
        prior = own.agg(F.avg("label")).first()[0] or 0.0
    toxic = smallest(own.where("label = 1").select("doc_id"), positives)
    others = smallest(docs.select("doc_id").where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", fold) != held)).distinct(), unlabelled)
    return train([r[0] for r in sample_texts(docs, toxic)], [r[0] for r in sample_texts(docs, others)], prior)


def toxicity(docs: DataFrame, scorer: Scorer, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """docs with score, the probability of being toxic; a column of that name is replaced.

    Null counts as empty, and a text without any chosen word, empty or not, has
    the score of the bias.  Whole texts are read, equal texts get equal scores,
    and rows repeated come back repeated.  Without a single toxic label every
    score is 0.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows, texts_of = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            for lo, hi in by_bytes(texts, batch_bytes):
                yield pa.record_batch([b["row"].slice(lo, hi - lo), pa.array(shared.value.score(texts.slice(lo, hi - lo).to_pylist()), pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")
