"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The likelihood of a word, however long, sums over all its segmentations into pieces,
by the forward algorithm; a text's is the product over its words, times the language's
share of the learned documents.  Piece probabilities come from a few rounds of
expectation-maximisation over a bounded sample of labelled documents.  Scoring
needs the model alone (pieces x languages, broadcast) and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import by_bytes, crc_mod, packed, release

UNKNOWN = "und"
#: Words up to this length are scored many at once, longer ones one by one in logarithms.
SHORT = 32
#: Probability of a letter that no piece covers.
FLOOR = 1e-8
#: Bytes that the words a task remembers may take.
REMEMBERED = 32 << 20
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode's category L) in lower case."""
    if not text:
        return []
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else _LETTERS.findall(w))]  # numbers like a half are no letters


def _marked(word: str) -> str:
    """The word with its mark in front."""
    return "▁" + word


def read_pieces(path: str) -> list[str]:
    """The distinct pieces of a sentencepiece model in lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)))
    return sorted({x.lower() for x in own})


class Lattice:
    """A trie of pieces that walks many words at once."""

    def __init__(self, pieces: list[str]):
        edges: dict[tuple[int, int], int] = {}
        ends: list[int] = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in map(ord, piece):
                nxt = edges.get((node, c))
                if nxt is None:
                    nxt = edges[node, c] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = k
        keys = np.array([n << 21 | c for n, c in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.next = np.append(np.array(list(edges.values()), dtype=np.int64)[order], 0)
        self.ends = np.array(ends, dtype=np.int64)
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (a row each): start, stop, rows, piece ids (n: an uncovered letter), ordered by start."""
        rows, length = chars.shape
        for i in range(length):
            live, node = np.arange(rows), np.zeros(rows, dtype=np.int64)
            for j in range(i, length):
                key = node << 21 | chars[live, j]
                at = np.searchsorted(self.keys, key)
                on = self.keys[at] == key
                node = np.where(on, self.next[at], 0)
                piece = np.where(on, self.ends[node], -1)
                if j == i:  # a single letter always has a way on
                    piece = np.where(piece < 0, self.n, piece)
                    yield i, j + 1, live, piece
                else:
                    hit = piece >= 0
                    if hit.any():
                        yield i, j + 1, live[hit], piece[hit]
                live, node = live[on], node[on]
                if not live.size:
                    break


    def grid(self, word: str) -> np.ndarray:
        """For one long word: the piece of each length - 1 (a row each) and start; -1: none, n: an uncovered letter."""
        chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        out = np.full((min(self.longest, len(chars)), len(chars)), -1, dtype=np.int64)
        live, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        for k in range(len(out)):
            inside = live + k < len(chars)
            live, node = live[inside], node[inside]
            key = node << 21 | chars[live + k]
            at = np.searchsorted(self.keys, key)
            on = self.keys[at] == key
            live, node = live[on], self.next[at[on]]
            out[k, live] = self.ends[node]
        out[0, out[0] < 0] = self.n
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letters of the words of one length, of those up to SHORT."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(sizes[sizes <= SHORT]).tolist():
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), 20_000):
            own = at[k : k + 20_000]
            text = "".join(words[x] for x in own.tolist())
            yield own, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64).reshape(len(own), n)


def _log_sums(grid: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all ways from the word's start to each place; log_p: pieces x languages."""
    size, n = grid.shape
    out = np.empty((n + 1, log_p.shape[1]))
    out[0] = 0
    for j in range(1, n + 1):
        k = np.arange(min(size, j))
        piece = grid[k, j - 1 - k]
        ok = piece >= 0
        ways = out[j - 1 - k[ok]] + log_p[piece[ok]]
        top = ways.max(0)
        out[j] = top + np.log(np.exp(ways - top).sum(0))
    return out


def forward(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log likelihood of each word under each language; p: (pieces + 1) x languages."""
    out = np.zeros((len(words), p.shape[1]))
    for at, chars in _by_length(words):
        alpha = np.zeros((chars.shape[1] + 1, len(at), p.shape[1]))
        alpha[0] = 1
        for i, j, rows, piece in lattice.arcs(chars):
            alpha[j, rows] += alpha[i, rows] * p[piece]
        out[at] = np.log(alpha[-1])
    for k, w in enumerate(words):
        if len(w) > SHORT:
            out[k] = _log_sums(lattice.grid(w), np.log(p))[-1]
    return out


def _expected(lattice: Lattice, p: np.ndarray, word: str) -> np.ndarray:
    """Expected counts of the pieces in a long word."""
    grid, log_p = lattice.grid(word), np.log(p)[:, None]
    there = _log_sums(grid, log_p)[:, 0]
    turned = np.full_like(grid, -1)
    for k, row in enumerate(grid):  # the same arcs, from the word's end
        turned[k, : len(row) - k] = row[: len(row) - k][::-1]
    back = _log_sums(turned, log_p)[::-1, 0]
    size, start = np.nonzero(grid >= 0)
    piece = grid[size, start]
    return np.bincount(piece, np.exp(there[start] + log_p[piece, 0] + back[start + size + 1] - there[-1]), lattice.n + 1)


def fit(lattice: Lattice, counts: dict[str, Counter], rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities of each language, by expectation-maximisation over its counted words."""
    out = np.full((lattice.n + 1, len(counts)), FLOOR)
    for k, words in enumerate(counts.values()):
        names, weight = [_marked(w) for w in words], np.array(list(words.values()), dtype=float)
        long = [i for i, w in enumerate(names) if len(w) > SHORT]
        p = np.full(lattice.n + 1, 1 / lattice.n)
        p[-1] = FLOOR
        for _ in range(rounds):
            seen = np.zeros(lattice.n + 1)
            for at, chars in _by_length(names):
                arcs = list(lattice.arcs(chars))
                n = chars.shape[1]
                alpha, beta = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
                alpha[0] = beta[n] = 1
                for i, j, rows, piece in arcs:
                    alpha[j, rows] += alpha[i, rows] * p[piece]
                for i, j, rows, piece in sorted(arcs, key=lambda a: -a[0]):
                    beta[i, rows] += beta[j, rows] * p[piece]
                scale = weight[at] / alpha[n]
                for i, j, rows, piece in arcs:
                    seen += np.bincount(piece, alpha[i, rows] * p[piece] * beta[j, rows] * scale[rows], lattice.n + 1)
            for i in long:
                seen += weight[i] * _expected(lattice, p, names[i])
            p = (seen + smooth) / (seen[:-1].sum() + smooth * lattice.n)
            p[-1] = FLOOR
        out[:, k] = p
    return out


class Model:
    """What is broadcast: languages, log shares, piece probabilities and the vocabulary's place."""

    def __init__(self, langs: list[str], prior: np.ndarray, pieces: list[str], p: np.ndarray):
        self.langs, self.prior, self.pieces, self.p = langs, prior, pieces, p
        self.lattice = None
        self.forget()

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "prior": self.prior, "pieces": self.pieces, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def forget(self) -> None:
        """Drop the words met so far; the lattice stays."""
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)), dtype=np.float32)
        self.held = 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
        if self.held > REMEMBERED:
            self.forget()
        known, split, new = self.known, [], []
        for t in texts:
            words = words_of(t)
            codes = np.empty(len(words), dtype=np.int64)
            for k, w in enumerate(words):
                c = known.get(w)
                if c is None:
                    c = known[w] = len(known)
                    new.append(w)
                codes[k] = c
            split.append(codes)
        if new and self.langs:
            self.logs = np.concatenate((self.logs, forward(self.lattice, self.p, [_marked(w) for w in new]).astype(np.float32)))
            self.held += sum(map(len, new)) + (200 + 4 * len(self.langs)) * len(new)
        langs, scores = [], []
        for codes in split:
            if not len(codes) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.prior + self.logs[codes].sum(0, dtype=np.float64)
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def learn(docs: DataFrame, pieces_path: str, fold: int = 5, per_lang: int = 600) -> Model:
    """A model from text and lang of the documents whose crc32(doc_id) mod fold is not 0.

    per_lang bounds the documents a language is learned from: those with the
    smallest hashes of id and text, ties by text.  Its share of documents counts
    all of them.  Null langs and documents without letters are not learned from.
    Repeated rows are learned from as often as they are drawn.  An empty table
    gives a model that calls everything `und`.
    """
    from pyspark.sql import Window

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (crc_mod("doc_id", fold) != 0))
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # rows whose hash is below a threshold of their language: some more than per_lang of them, whatever the table's size
    rank = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    place = (F.col("hash") / 2.0**64) + 0.5
    limit = F.lit(1.0)
    for x, n in share.items():
        if n > 2 * per_lang:
            limit = F.when(F.col("lang") == x, (per_lang + 8 * per_lang**0.5 + 20) / n).otherwise(limit)
    order = Window.partitionBy("lang").orderBy("hash", "text")
    counts: dict[str, Counter] = {x: Counter() for x in sorted(share)}
    chosen = rank.where(place <= limit).select("lang", "text", F.row_number().over(order).alias("n")).where(F.col("n") <= per_lang)
    for r in chosen.select("lang", "text").toLocalIterator():
        counts[r["lang"]].update(words_of(r["text"]))
    counts = {k: c for k, c in counts.items() if c}
    pieces = read_pieces(pieces_path)
    prior = np.log(np.array([share[x] for x in counts], dtype=float) / max(1, sum(share[x] for x in counts)))
    return Model(list(counts), prior, pieces, fit(Lattice(pieces), counts))


def identify(docs: DataFrame, model: Model, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced.

    A text that is null or has no letter is `und` with score 0, as is every text
    if nothing was learned.  The score is the posterior probability of lang_pred;
    of equally likely languages the first in order of name is taken.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, texts_of = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        try:
            for b in batches:
                texts = texts_of(b)
                for lo, hi in by_bytes(texts, batch_bytes):
                    langs, scores = own.predict(texts.slice(lo, hi - lo).to_pylist())
                    yield pa.record_batch([b["row"].slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])
        finally:
            own.forget()
            release()

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def identified(docs: DataFrame, model: Model, certain: float, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, as they were, whose best language has a posterior probability of at least `certain`; texts without letters go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, texts_of = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        try:
            for b in batches:
                texts = texts_of(b)
                for lo, hi in by_bytes(texts, batch_bytes):
                    langs, scores = own.predict(texts.slice(lo, hi - lo).to_pylist())
                    sure = [x != UNKNOWN and p >= certain for x, p in zip(langs, scores, strict=True)]
                    yield pa.record_batch([b["row"].slice(lo, hi - lo).filter(pa.array(sure, pa.bool_()))], names=["row"])
        finally:
            own.forget()
            release()

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
