"""Bounded labelled samples and hashed text terms for the classifiers."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[^\W\d_]+")
_SHAPE = re.compile(r"[^\W\d_]+|\d+")


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest hashes of doc_id: the same ones however the table is split."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def sample_texts(docs: DataFrame, chosen: DataFrame) -> list[tuple]:
    """(columns of chosen but doc_id ..., text) for the chosen rows; chosen is bounded by its maker, so it is broadcast."""
    names = [c for c in chosen.columns if c != "doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    return [tuple(r) for r in joined.select(*names, "text").toLocalIterator()]


def labels_of(labels: DataFrame, column: str, learned: Column) -> DataFrame:
    """doc_id and label (0 or 1) where `learned` holds; an id with several labels has their rounded mean, null labels and ids are left out."""
    rows = labels.where(learned & F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return rows.groupBy("doc_id").agg(F.when(F.avg(column) >= 0.5, 1).otherwise(0).alias("label"))


class Lexicon(dict):
    """White-space tokens to running numbers, with what each token is made of; remembered within bounds.

    bound, room: tokens, and bytes of tokens and their parts, beyond which all is forgotten before the next texts.
    """

    def __init__(self, words: int, forms: int, bound: int = 400_000, room: int = 64 << 20):
        self.words, self.forms, self.bound, self.room = words, forms, bound, room
        self.forget()

    def __reduce__(self):
        return Lexicon, (self.words, self.forms, self.bound, self.room)

    def forget(self) -> None:
        self.clear()
        self.bytes = 0
        self.columns: list[tuple[int, int, int, int]] = []
        self.parts: list[int] = []
        self.table = np.zeros((0, 4), dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        low = token.lower()
        letters = _LETTERS.findall(low)
        shape = _SHAPE.sub(lambda m: "w" if m[0][0].isalpha() else "n", low)
        forms = [shape[k : k + 12] for k in range(0, max(1, len(shape) - 6), 6)]
        self.parts += [zlib.crc32(w.encode()) % self.words for w in letters]
        self.parts += [zlib.crc32(f.encode()) % self.forms for f in forms]
        self.columns.append((len(letters), len(forms), sum(map(len, letters)), len(token)))
        self.bytes += 4 * len(token) + 12 * (len(letters) + len(forms))
        return n

    def read(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, tuple, tuple]]:
        """Of each text its distinct tokens, as rows (words, forms, letters, length), their counts, and buckets and counts of all their words and of all their forms."""
        if len(self) > self.bound or self.bytes > self.room:
            self.forget()
        number = self.__getitem__
        counted = [Counter(t.split()) if t else {} for t in texts]
        codes = [np.fromiter(map(number, c), np.int64, len(c)) for c in counted]
        if self.columns:
            self.table = np.concatenate((self.table, np.array(self.columns, dtype=np.int64)))
            self.flat = np.concatenate((self.flat, np.array(self.parts, dtype=np.int32)))
            size = self.table[:, 0] + self.table[:, 1]
            self.starts = np.cumsum(size) - size
            self.columns, self.parts = [], []
        out = []
        for x, c in zip(codes, counted, strict=True):
            rows, n, start = self.table[x], np.fromiter(c.values(), np.float64, len(c)), self.starts[x]
            out.append((rows, n, self._spread(start, rows[:, 0], n), self._spread(start + rows[:, 0], rows[:, 1], n)))
        return out

    def _spread(self, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts from start on, size of them, each with its token's count."""
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.flat[at].astype(np.int64), np.repeat(n, size)


def summed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets and the sums of their counts."""
    keys, inverse = np.unique(at, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys))
