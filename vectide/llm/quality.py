"""Quality by nearest-neighbour voting among latent-semantic vectors.

A bounded sample of labelled documents gives two term spaces, one of words and
one of form (runs of signs, shapes, lengths, repetition), each reduced by a
truncated singular value decomposition.  The labelled vectors and projections
are broadcast; their size is bounded by the sample and the dimensions.  Every
document's cosines with all labelled vectors are computed exactly, block by
block, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectide.llm.common import by_bytes, crc_mod, packed, release
from vectide.llm.learning import Lexicon, labels_of, sample_texts, smallest, summed

WORDS, FORMS = 1 << 14, 1 << 12


#: Measures of a text, and the steps each is told apart by.
MEASURES, STEPS = 7, 32


def measures(text: str, rows: np.ndarray, n: np.ndarray) -> list[int]:
    """Length, share of letters, share of tokens with a word, their length, repetition of tokens and lines, length of lines; in steps."""
    tokens, worded = max(1.0, n.sum()), n[rows[:, 0] > 0]
    lines = [x for x in text.split("\n") if x.strip()]
    values = (
        np.log2(1 + len(text)) / 2,
        10 * float(rows[:, 2] @ n) / max(1, len(text)),
        10 * worded.sum() / tokens,
        float(rows[:, 3] @ n) / tokens,
        10 * len(n) / tokens,
        10 * len(set(lines)) / max(1, len(lines)),
        np.log2(1 + len(text) / max(1, len(lines))),
    )
    return [k * STEPS + min(STEPS - 1, round(float(v))) for k, v in enumerate(values)]


def terms(text: str | None, rows: np.ndarray, n: np.ndarray, words: tuple, forms: tuple) -> tuple[tuple, tuple]:
    """Buckets and counts of the word space and of the form space; a measure weighs as much as a form that takes an eighth of the text."""
    forms, sums = summed(*forms)
    own = measures(text or "", rows, n)
    form = (np.concatenate((forms + MEASURES * STEPS, own)), np.concatenate((sums, np.full(len(own), 1 + n.sum() / 8))))
    return summed(*words), form


class Space:
    """Hashed terms, their document frequencies and the leading singular vectors of a sample."""

    def __init__(self, buckets: int, dims: int, seed: int):
        self.buckets, self.dims, self.seed = buckets, dims, seed
        self.idf = np.zeros(buckets, dtype=np.float32)
        self.axes = np.zeros((buckets, dims), dtype=np.float32)

    def row(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[at]
        return (w / max(float(np.sqrt((w * w).sum())), 1e-9)).astype(np.float32)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not docs:
            return
        seen = np.zeros(self.buckets)
        for at, _ in docs:
            seen[at] += 1
        self.idf = np.log((1 + len(docs)) / (1 + seen)).astype(np.float32) + 0.1
        doc = np.repeat(np.arange(len(docs)), [len(a) for a, _ in docs])
        at = np.concatenate([a for a, _ in docs] or [np.zeros(0, np.int64)]).astype(np.int64)
        w = np.concatenate([self.row(a, n) for a, n in docs] or [np.zeros(0, np.float32)])

        def times(m: np.ndarray) -> np.ndarray:  # documents x columns
            return np.stack([np.bincount(doc, w * m[at, c], len(docs)) for c in range(m.shape[1])], 1)

        def back(m: np.ndarray) -> np.ndarray:  # terms x columns
            return np.stack([np.bincount(at, w * m[doc, c], self.buckets) for c in range(m.shape[1])], 1)

        wide = min(self.dims + 8, max(1, len(docs)))
        basis = np.random.default_rng(self.seed).standard_normal((self.buckets, wide))
        for _ in range(3):
            q, _ = np.linalg.qr(times(basis))
            basis = back(q)
        _, _, v = np.linalg.svd(basis.T, full_matrices=False)
        self.axes[:, : min(self.dims, len(v))] = v[: self.dims].T

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = self.row(at, n) @ self.axes[at]
        return v / max(float(np.sqrt(v @ v)), 1e-9)


class Voter:
    """What is broadcast: two spaces, the labelled vectors and their labels."""

    def __init__(self, rows: list[tuple], dims: int, neighbours: int, form_weight: float):
        self.words, self.forms = Space(WORDS, dims, 1), Space(FORMS + MEASURES * STEPS, dims, 2)
        self.neighbours, self.form_weight = neighbours, form_weight
        self.lexicon = Lexicon(WORDS, FORMS)
        self.labels = np.array([r[0] for r in rows], dtype=np.float32)
        texts = [r[1] for r in rows]
        found = [terms(t, *x) for t, x in zip(texts, self.lexicon.read(texts), strict=True)]
        self.words.fit([w for w, _ in found])
        self.forms.fit([f for _, f in found])
        self.vectors = self.embed(texts)

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), self.words.dims + self.forms.dims), dtype=np.float32)
        a, b = np.sqrt(1 - self.form_weight), np.sqrt(self.form_weight)
        for k, (t, x) in enumerate(zip(texts, self.lexicon.read(texts), strict=True)):
            word, form = terms(t, *x)
            out[k, : self.words.dims] = a * self.words.vector(*word)
            out[k, self.words.dims :] = b * self.forms.vector(*form)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        own = self.embed(texts)
        out, k = np.empty(len(texts)), min(self.neighbours, len(self.labels))
        for lo in range(0, len(own), 256):
            near = own[lo : lo + 256] @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.exp(12 * (np.take_along_axis(near, top, 1).astype(np.float64) - 1))
            out[lo : lo + 256] = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, most: int = 6000, dims: int = 32, neighbours: int = 24, form_weight: float = 0.7) -> Voter:
    """A voter from at most `most` labelled documents whose crc32(doc_id) mod fold is not `held`.

    They are those with the smallest hashes of their ids.  form_weight: the share
    of the form space in a cosine.  An id with several labels has their rounded
    mean; labels without a document, null labels and null ids teach nothing; a
    repeated document votes as often as it is there.  Null and empty texts vote
    by their form, long ones are read whole.  Empty tables give a voter of 0.5.
    """
    chosen = smallest(labels_of(labels, "quality", crc_mod("doc_id", fold) != held), most)
    return Voter(sample_texts(docs, chosen), dims, neighbours, form_weight)


def quality(docs: DataFrame, voter: Voter, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """docs with score, the weighted share of good neighbours; a column of that name is replaced.

    Null counts as empty, and an empty text is judged by its form.  Whole texts
    are read, equal texts get equal scores, and rows repeated come back repeated.
    Of neighbours that are equally near at the edge any may vote.  Without any
    labels every score is 0.5.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    rows, texts_of = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        try:
            for b in batches:
                texts = texts_of(b)
                for lo, hi in by_bytes(texts, batch_bytes):
                    yield pa.record_batch([b["row"].slice(lo, hi - lo), pa.array(own.score(texts.slice(lo, hi - lo).to_pylist()), pa.float64())], names=["row", "score"])
        finally:
            own.lexicon.forget()
            release()

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")
