"""Language-model scoring with a hierarchical Pitman-Yor model.

The words that follow a word in training documents sit in that word's
restaurant; all of these share one parent restaurant over words, whose base is
uniform over all words and one unseen word.  The end of a text is a word, and
the one before its first.  Sweeps reseat all customers, and a text's score is
the sum of log10 P(word | word before).

All words and all pairs of neighbouring words of all documents are counted.
Tasks write their documents as blocks of word numbers.  A block sends its
distinct words and pairs, each once, to shards of the hash space, which number
what they got in the block's own order: answers need no names.  Restaurants of
preceding words are seated in shards of pairs, the parent in shards of words;
the two sides exchange the guests of the parent and the probabilities of words.
Nothing but a few sums goes through the driver.  Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import NO_ID, by_bytes, crc_mod, forget, ids, release, settle, table

#: Share of the tables' pull: discount and strength of the restaurants below and of the parent.
DISCOUNT, STRENGTH = 0.75, 2.0


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    return (text or "").encode().lower().split()


def by_sum(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs whose sums are about `most`, one item at least."""
    sums, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


#: Dishes up to this many customers are drawn from exact weights; larger ones by moves that redraw their tables.
EXACT = 512


@cache
def _partitions() -> np.ndarray:
    """log of the generalised Stirling numbers: the weight of n customers at t tables, for n and t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore"):
            s[n + 1, 1:] = np.logaddexp(s[n, :-1], s[n, 1:] + np.log(np.maximum(n - DISCOUNT * t, 0)))
    return s


class Tables:
    """Numbers of tables of many dishes; a sweep reseats every customer of every dish.

    A sweep draws a dish's whole seating again, given the tables of the other
    dishes of its restaurant at the sweep's start.  The weight of t tables is
    the product of the weights of new tables, base (STRENGTH + DISCOUNT (rest +
    i)) for i < t, times the weight of all seatings of n customers at t tables.
    Up to EXACT customers t is drawn from these weights.  The tables of a larger
    dish are, but for the largest one, a Poisson process of sizes conditioned on
    their sum: a Metropolis move takes a part of them away and draws new ones,
    and the largest table takes what is left.
    """

    def __init__(self, n: np.ndarray, rng: np.random.Generator):
        self.n, self.rng = n.astype(np.int64), rng
        self.tables = np.ones(len(n), dtype=np.int64)
        some = np.flatnonzero((self.n > 1) & (self.n <= EXACT))
        self.parts = [some[lo:hi] for lo, hi in by_sum(self.n[some], 1 << 21)]
        self.large = {k: np.zeros(0) for k in np.flatnonzero(self.n > EXACT).tolist()}

    def sweep(self, base: np.ndarray, rest: np.ndarray) -> None:
        """base: probability of each dish in the parent; rest: tables of the restaurant's other dishes."""
        now = self.tables.copy()
        for part in self.parts:
            n = self.n[part]
            start = np.cumsum(n) - n
            own = np.repeat(np.arange(len(part)), n)
            t = np.arange(len(own)) - start[own]
            fresh = np.cumsum(np.log(base[part][own] * (STRENGTH + DISCOUNT * (rest[part][own] + t))))
            fresh -= (fresh[start] - np.log(base[part] * (STRENGTH + DISCOUNT * rest[part])))[own]
            weight = fresh + _partitions()[n[own], t + 1] + self.rng.gumbel(size=len(own))
            at = np.flatnonzero(weight == np.maximum.reduceat(weight, start)[own])
            now[part[own[at]]] = t[at] + 1
        for k, others in self.large.items():
            others = self.large[k] = self._redraw(int(self.n[k]), others, float(base[k]), float(rest[k]))
            now[k] = len(others) + 1
        self.tables = now

    def _redraw(self, n: int, others: np.ndarray, base: float, rest: float) -> np.ndarray:
        rng, d = self.rng, DISCOUNT
        fresh = base * (STRENGTH + d * rest)
        # sizes are tilted so that they add up to a little less than n: the tilt cancels in the conditional weights
        keep, lo = 1 - 1 / n, 0.0
        calm = fresh * keep * (1 - keep) ** (d - 1) < n
        if not calm:
            for _ in range(50):
                mid = (lo + keep) / 2
                lo, keep = (mid, keep) if fresh * mid * (1 - mid) ** (d - 1) < 0.97 * n else (lo, mid)
        tilt = np.log(keep)

        def weight(x: np.ndarray) -> float:
            left = n - x.sum()
            if left < max(1.0, x.max(initial=0)):
                return -np.inf
            new = np.log(base * (STRENGTH + d * (rest + np.arange(len(x) + 1))) / fresh).sum()
            return float(new + lgamma(left - d) - lgamma(left + 1) + tilt * left)

        own = weight(others)
        for share in (1.0, 1.0) if calm else (1.0, 0.5, 0.5, 0.2, 0.2, 0.2, 0.05, 0.05, 0.05, 0.05, 0.02, 0.02, 0.02, 0.02):
            drawn = rng.poisson(share * fresh / d)
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                size = np.ceil(np.log(rng.random(drawn)) / np.log1p(-rng.beta(d, 1 - d, drawn)))
            size = np.where(size >= 1, size, 1.0)  # a geometric number of a beta chance
            size = size[np.log(rng.random(drawn)) < tilt * size]
            then = np.concatenate((others[rng.random(len(others)) >= share], size))
            got = weight(then)
            if np.log(rng.random()) < got - own:
                others, own = then, got
        every = np.sort(np.append(others, n - others.sum()))
        return every[:-1]


#: What steps write.  STATE: of a shard, to itself; GUESTS: from pairs to words; VALUES: from words to pairs;
#: WORDS and PAIRS: to a block.  A shard of words also gives its sums.
_SAID = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("shard", pa.int64()), ("body", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("guests", pa.int64()), ("held", pa.float64())])
_BLOCK = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("hashes", pa.binary())])
_BLOB = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
STATE, GUESTS, VALUES, WORDS, PAIRS = range(5)
#: Stands for the end of a text; no word holds a space.
END = b" "
#: Pairs are told apart, and words meet, by these bits of the words' hashes; counts of words by all 64.
SHORT = np.uint64((1 << 48) - 1)
#: Whole sweeps over the customers of a shard: to forget the start, and to average over.
BURN, SAMPLES = 2, 3


def _rows(out: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*out, strict=True) if out else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each compressed: bytes of equal weight lie together."""
    parts = [zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b"" for a in arrays]
    return np.array([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(parts)


def _unpack(body, *kinds) -> list[np.ndarray]:
    body = memoryview(body)
    sizes = np.frombuffer(body, dtype=np.int64, count=len(kinds)).tolist()
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        flat = np.frombuffer(zstandard.decompress(body[at : at + n]) if n else b"", dtype=np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel())
        at += n
    return out


def _said(kind: int, to: int, shard: int, *arrays: np.ndarray) -> tuple:
    return kind, to, shard, _pack(*arrays), None, None, None, None


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, stop) of the runs of equal values."""
    start = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    return list(zip(sorted_values[start].tolist(), start.tolist(), [*start[1:].tolist(), len(sorted_values)], strict=True)) if len(start) else []


def _steps_of(x: np.ndarray) -> np.ndarray:
    """Runs of ascending numbers as differences, modulo 2^32."""
    return np.diff(x.astype(np.int64), prepend=0).astype(np.uint32)


def _from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32).astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in order of appearance, the word of each token, tokens of each text."""
    numbers = _Numbers()
    get, parts = numbers.__getitem__, []
    for t in texts:
        w = t.lower().split()
        parts.append(np.fromiter(map(get, w), np.int32, len(w)))
    return list(numbers), np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], dtype=np.int64)


def predictive(both: np.ndarray, tables: np.ndarray, whole: np.ndarray, count: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """P(word | word before) from the pair's customers and mean tables, the restaurant's tables and customers, and the word's probability in the parent."""
    return (both - DISCOUNT * tables + (STRENGTH + DISCOUNT * whole) * parent) / (STRENGTH + count)


def _parent(value: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities of words in the parent; value: guests less the discounts of their tables."""
    return (value + (STRENGTH + DISCOUNT * model["held"]) / (model["distinct"] + 1)) / (STRENGTH + model["guests"])


class _Steps:
    """Steps over blocks of documents and shards of words and of pairs.

    split: pieces a word's restaurant is dealt into by the hash of the following
    word, so that no shard holds all that follows a frequent word.
    """

    def __init__(self, shards: int, split: int):
        self.shards, self.split = shards, split

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return ((h & SHORT) % np.uint64(self.shards)).astype(np.int64)

    def pair_shard(self, home: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (home + piece) % self.shards

    def blocks(self, block_bytes: int):
        """A task's documents as blocks: ids, whether learned from, tokens, the word of each token, and what deals out pairs; and the words' hashes.

        Words are numbered by shard and hash.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, made = [], 0, 0

            def block() -> pa.RecordBatch:
                ident, train, texts = (list(c) for c in zip(*held, strict=True))
                words, token, count = _coded(texts)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, [*words, END]), np.uint64, len(words) + 1)
                order = np.lexsort((h, h & SHORT, self.word_shard(h)))
                rank = np.empty(len(h), dtype=np.int32)
                rank[order] = np.arange(len(h), dtype=np.int32)
                now = np.full(len(token) + len(count), rank[-1], dtype=np.int32)
                inside = np.ones(len(now), dtype=bool)
                inside[np.cumsum(count + 1) - 1] = False
                now[inside] = rank[token]
                h = h[order]
                home = ((h >> np.uint64(20)) % np.uint64(self.shards)).astype(np.uint32)
                piece = ((h >> np.uint64(40)) % np.uint64(self.split)).astype(np.uint32)
                number = TaskContext.get().partitionId() << 32 | made
                body = _pack(np.array(ident, dtype=np.int64), np.array(train, dtype=np.uint8), (count + 1).astype(np.uint32), now, home, piece, np.array([rank[len(words)]], dtype=np.int32))
                return pa.record_batch([pa.array([number], pa.int64()), pa.array([body], pa.binary()), pa.array([h.tobytes()], pa.binary())], schema=_BLOCK)

            try:
                for b in batches:
                    for lo, hi in by_bytes(b["body"], block_bytes // 4):
                        part = b.slice(lo, hi - lo)
                        held += zip(part["id"].to_pylist(), part["train"].to_pylist(), part["body"].to_pylist(), strict=True)
                        size += sum(len(r[2]) for r in held[lo - hi :])
                        if size >= block_bytes:
                            yield block()
                            held, size, made = [], 0, made + 1
                if held:
                    yield block()
            finally:
                held = []
                release()

        return run

    @staticmethod
    def read(body: bytes) -> tuple:
        """ids, train, ends (exclusive) of texts, words, the words before them, home and piece of each distinct word."""
        ident, train, size, now, home, piece, end = _unpack(body, np.int64, np.uint8, np.uint32, np.int32, np.uint32, np.uint32, np.int32)
        return ident, train.astype(bool), np.cumsum(size.astype(np.int64)), now, np.concatenate((end, now[:-1])), home.astype(np.int64), piece.astype(np.int64)

    def pairs(self, now: np.ndarray, before: np.ndarray, home: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in order of shard, word before and word: shard, both words; and the pair of each place."""
        key = before.astype(np.int64) << 32 | now
        place = np.argsort(key, kind="stable").astype(np.int32)
        key = key[place]
        new = np.diff(key, prepend=-1) != 0
        key, which = key[new], np.cumsum(new, dtype=np.int32) - 1
        a, b = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        shard = self.pair_shard(home[a], piece[b])
        order = np.argsort(shard, kind="stable").astype(np.int32)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        back = np.empty(len(place), dtype=np.int32)
        back[place] = rank[which]
        return shard[order], a[order], b[order], back

    def blobs(self, batches: Iterator[pa.RecordBatch], turn: int = 0, turns: int = 1) -> Iterator[pa.RecordBatch]:
        """A block's distinct words and pairs with their counts in training documents, by shard; pairs' shards are numbered behind words'.

        Only the shards of a turn are sent.
        """
        try:
            for batch in batches:
                for number, body, hashes in zip(batch["block"].to_pylist(), batch["body"], batch["hashes"], strict=True):
                    _, train, ends, now, before, home, piece = self.read(body.as_buffer())
                    h = np.frombuffer(hashes.as_buffer(), dtype=np.uint64)
                    learned = np.repeat(train, np.diff(ends, prepend=0))
                    count = np.bincount(now[learned], minlength=len(h)).astype(np.uint32)
                    out = [(s, number, _pack(h[lo:hi], count[lo:hi])) for s, lo, hi in _runs(self.word_shard(h)) if s % turns == turn]
                    shard, a, b, which = self.pairs(now, before, home, piece)
                    count = np.bincount(which[learned], minlength=len(a)).astype(np.uint32)
                    short = h & SHORT
                    for s, lo, hi in _runs(shard):
                        if s % turns != turn:
                            continue
                        start = np.flatnonzero(np.diff(a[lo:hi], prepend=-1))
                        size = np.diff(start, append=hi - lo).astype(np.uint32)
                        out.append((self.shards + s, number, _pack(short[a[lo:hi][start]], size, short[b[lo:hi]], count[lo:hi])))
                    for at in range(0, len(out), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 64], strict=True), _BLOB, strict=True)], schema=_BLOB)
        finally:
            release()

    def sums(self, key: tuple, blobs: pa.Table) -> pa.Table:
        """What blocks sent to a shard, summed, with the places of each block's words or pairs among all; and the first guests."""
        release()
        s, blobs = key[0].as_py(), blobs.sort_by("block")
        sent = blobs["block"].to_numpy()
        if s < self.shards:
            parts = [_unpack(x.as_buffer(), np.uint64, np.uint32) for x in blobs["body"]]
            x, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            order = np.argsort(x & SHORT, kind="stable")  # the order of the blocks
            rank = np.empty(len(x), dtype=np.int64)
            rank[order] = np.arange(len(x))
            x, at = x[order], rank[at]
            count = np.bincount(at, np.concatenate([p[1] for p in parts]), len(x)).astype(np.int64)
            size = np.array([len(p[0]) for p in parts], dtype=np.uint32)
            body = _pack(x, count, sent, size, _steps_of(at))
            return _rows([(STATE, s, s, body, int(count.sum()), int((count > 0).sum()), None, None)], _SAID)
        parts = [_unpack(x.as_buffer(), np.uint64, np.uint32, np.uint64, np.uint32) for x in blobs["body"]]
        # words in order of their own shards
        x = np.unique(np.concatenate([p[k] for p in parts for k in (0, 2)]))
        order = np.argsort(self.word_shard(x), kind="stable")
        rank = np.empty(len(x), dtype=np.int64)
        rank[order] = np.arange(len(x))
        code = lambda h: rank[np.searchsorted(x, h)]
        every = np.concatenate([np.repeat(code(p[0]), p[1]) << 32 | code(p[2]) for p in parts])
        every, at = np.unique(every, return_inverse=True)
        count = np.bincount(at, np.concatenate([p[3] for p in parts]), len(every)).astype(np.int64)
        size = np.array([len(p[2]) for p in parts], dtype=np.uint32)
        x = x[order]
        a, b, seen = every >> 32, every & 0xFFFFFFFF, count > 0
        out = [(STATE, s, s, _pack(x, _steps_of(a), _steps_of(b), count, sent, size, _steps_of(at)), None, None, None, None)]
        guests = np.bincount(b[seen], minlength=len(x)).astype(np.uint32)
        held = np.bincount(a[seen], minlength=len(x)).astype(np.float32)
        out += [_said(GUESTS, to, s, x[lo:hi], guests[lo:hi], held[lo:hi]) for to, lo, hi in _runs(self.word_shard(x))]
        return _rows(out, _SAID)

    def seat(self, key: tuple, state: pa.Table, replies: pa.Table, model: dict) -> pa.Table:
        """Seat the customers of a shard's restaurants, tell the parent's guests, and answer every block."""
        release()
        s = key[0].as_py()
        if not len(state):
            return _rows([], _SAID)
        x, steps, b, count, sent, size, at = _unpack(state["body"][0].as_buffer(), np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.uint32, np.uint32)
        a, b, at = _from_steps(steps), _from_steps(b), _from_steps(at)
        runs = _runs(self.word_shard(x))
        told = dict(zip(replies["shard"].to_pylist(), replies["body"], strict=True))
        value, whole = (np.concatenate(c) for c in zip(*(_unpack(told[to].as_buffer(), np.float32, np.float32) for to, _, _ in runs), strict=True))
        seen = np.flatnonzero(count)
        before, now = a[seen], b[seen]
        parent = _parent(value.astype(np.float64), model)[now]
        elsewhere = whole - np.bincount(before, minlength=len(x))  # tables in other shards
        seats, mean = Tables(count[seen], np.random.default_rng(s)), np.zeros(len(a))
        for k in range(BURN + SAMPLES):
            of_row = elsewhere + np.bincount(before, seats.tables, len(x))
            seats.sweep(parent, np.maximum(of_row[before] - seats.tables, 0))
            if k >= BURN:
                mean[seen] += seats.tables / SAMPLES
        guests = np.bincount(now, seats.tables, len(x)).astype(np.uint32)
        held = np.bincount(before, mean[seen], len(x)).astype(np.float32)
        out = [_said(GUESTS, to, s, x[lo:hi], guests[lo:hi], held[lo:hi]) for to, lo, hi in runs]
        count, mean = count.astype(np.uint32), mean.astype(np.float32)
        at = np.split(at, np.cumsum(size)[:-1])
        out += [_said(PAIRS, n, s, count[own], mean[own]) for n, own in zip(sent.tolist(), at, strict=True)]
        return _rows(out, _SAID)

    def parent(self, key: tuple, said: pa.Table, state: pa.Table | None, distinct: int) -> pa.Table:
        """Seat the parent's guests in a shard of words, and tell the words' values and tables to the shards of pairs or, with state, to the blocks."""
        release()
        s = key[0].as_py()
        told = [_unpack(x.as_buffer(), np.uint64, np.uint32, np.float32) for x in said["body"]]
        x, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in told)]), return_inverse=True)
        guests = np.bincount(at, np.concatenate([np.zeros(0), *(p[1] for p in told)]), len(x)).astype(np.int64)
        whole = np.bincount(at, np.concatenate([np.zeros(0), *(p[2] for p in told)]), len(x))
        some = np.flatnonzero(guests)
        seats, held = Tables(guests[some], np.random.default_rng(s)), np.zeros(len(x))
        for k in range(BURN + SAMPLES):
            # a shard's words are a random sample of all: their mean tables stand for all words'
            rest = seats.tables.mean() * distinct - seats.tables if len(some) else seats.tables
            seats.sweep(np.full(len(some), 1 / (distinct + 1)), np.maximum(rest, 0))
            if k >= BURN:
                held[some] += seats.tables / SAMPLES
        value, whole = (guests - DISCOUNT * held).astype(np.float32), whole.astype(np.float32)
        out = [(None, None, s, None, None, None, int(guests.sum()), float(held.sum()))]
        if state is None:
            own = np.split(at, np.cumsum([len(p[0]) for p in told])[:-1])
            out += [_said(VALUES, to, s, value[k], whole[k]) for to, k in zip(said["shard"].to_pylist(), own, strict=True)]
        elif len(state):
            y, count, sent, size, at = _unpack(state["body"][0].as_buffer(), np.uint64, np.int64, np.int64, np.uint32, np.uint32)
            place = np.minimum(np.searchsorted(x, y & SHORT), max(0, len(x) - 1))
            met = x[place] == y & SHORT if len(x) else np.zeros(len(y), dtype=bool)
            known = [np.where(met, c[place] if len(x) else 0, 0).astype(np.float32) for c in (value, whole)]
            count = count.astype(np.uint32)
            own = np.split(_from_steps(at), np.cumsum(size)[:-1])
            out += [_said(WORDS, n, s, count[k], known[0][k], known[1][k]) for n, k in zip(sent.tolist(), own, strict=True)]
        return _rows(out, _SAID)

    def scores(self, key: tuple, block: pa.Table, answers: pa.Table, model: dict) -> pa.Table:
        """Scores of a block's texts; answers in order of shards are in the order of its words and pairs."""
        release()
        if not len(block):
            return _rows([], _SCORES)
        ident, train, ends, now, before, home, piece = self.read(block["body"][0].as_buffer())
        told = sorted(zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["body"], strict=True), key=lambda r: r[:2])
        count, value, whole = (np.concatenate(c).astype(np.float64) for c in zip(*(_unpack(x.as_buffer(), np.uint32, np.float32, np.float32) for k, _, x in told if k == WORDS), strict=True))
        both, tables = (np.concatenate(c).astype(np.float64) for c in zip(*(_unpack(x.as_buffer(), np.uint32, np.float32) for k, _, x in told if k == PAIRS), strict=True))
        del told
        _, a, b, which = self.pairs(now, before, home, piece)
        # every word of a training document is followed by one, so a word's count is its restaurant's too
        own = np.log10(predictive(both, tables, whole[a], count[a], _parent(value, model)[b]))[which]
        n = model["tokens"]
        base = np.log10((count + 0.1) / (n + 0.1 * (model["distinct"] + 1)))[now]
        starts = np.concatenate(([0], ends[:-1]))
        score, base, known = (np.add.reduceat(x, starts) for x in (own, base, (count > 0).astype(np.int64)[now]))
        out = [
            pa.array([None if i == NO_ID else i for i in ident.tolist()], pa.int64()),
            pa.array(~train, pa.bool_()),
            pa.array(np.diff(ends, prepend=0), pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(np.full(len(ident), n), pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(score, pa.float64()),
        ]
        return pa.table(out, schema=_SCORES)


def score_texts(docs: DataFrame, fold: int = 10, block_bytes: int = 14 << 20, shard_bytes: int = 8 << 20, turns: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows whose crc32(doc_id) mod fold is not 0 (a null
    id counts as the empty text).  A text's tokens are its words and an end; a
    null or empty text has the end alone.  Unknown words have the probability of
    the unseen word.  Repeated rows are learned from and scored each by itself,
    so equal texts have equal scores; other columns don't matter, and an empty
    table gives an empty one.  block_bytes, shard_bytes: text in a block (a
    longer text is one by itself), and text whose words or pairs a shard counts;
    they bound a task's memory.  turns: words and pairs are sent to that many
    parts of the shards, one after another, which bounds the disk of the exchange.
    """
    spark = docs.sparkSession
    source = docs.select(ids().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"), (crc_mod("doc_id", fold) != 0).alias("train"))
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    steps = _Steps(shards, -(-shards // 256))
    blocks = table(source.mapInArrow(steps.blocks(block_bytes), _ddl(_BLOCK)), "blocks")
    said = _ddl(_SAID)
    sums = None
    for turn in range(turns):
        sent = blocks.mapInArrow(lambda batches, turn=turn: steps.blobs(batches, turn, turns), _ddl(_BLOB))
        part = table(sent.groupBy("shard").applyInArrow(lambda k, t: steps.sums(k, t), said), "sums")
        sums = part if sums is None else sums.unionAll(part)
        del sent
        settle(spark)

    def to(rows: DataFrame, kind: int) -> DataFrame:
        return rows.where(F.col("kind") == kind).select("to", "shard", "body")

    def sum_of(rows: DataFrame, *columns: str) -> dict:
        return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).first().asDict()

    counts = sum_of(sums, "tokens", "distinct")
    distinct = counts["distinct"]
    of_words, of_pairs = (to(sums, STATE).where(F.col("shard") < shards), to(sums, STATE).where(F.col("shard") >= shards))
    replies = table(to(sums, GUESTS).groupBy("to").applyInArrow(lambda k, t: steps.parent(k, t, None, distinct), said), "replies")
    model = counts | sum_of(replies, "guests", "held")
    settle(spark)
    seated = table(of_pairs.groupBy("to").cogroup(to(replies, VALUES).groupBy("to")).applyInArrow(lambda k, a, b: steps.seat(k, a, b, model), said), "seated")
    forget(replies)
    counted = table(to(seated, GUESTS).groupBy("to").cogroup(of_words.groupBy("to")).applyInArrow(lambda k, a, b: steps.parent(k, a, b, distinct), said), "counted")
    forget(sums)
    known = counts | sum_of(counted, "guests", "held")
    answers = counted.where(F.col("kind") == WORDS).unionAll(seated.where(F.col("kind") == PAIRS)).select("kind", "to", "shard", "body")
    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(lambda k, a, b: steps.scores(k, a, b, known), _ddl(_SCORES))
