"""Byte-level BPE encoding and decoding by merge replay.

The texts of a task are cut into words by the tokenizer's pattern, and the
distinct words not met before are encoded together: an inverted index leads
from each token pair, under the rank of its merge, to the places where it
stands, the pairs are taken in rank order, and a merge touches only its own
places and their neighbours.  A word's ids then serve every text of the task
that holds it.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import by_bytes, packed, release

#: Bytes that the words a task remembers may take, with their ids.
REMEMBERED = 48 << 20
#: The public pattern; for any other the whole text goes through the pattern.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - start, size)


#: No merge.
NONE = np.iinfo(np.int32).max
#: Bytes of a word up to which many are merged at once.
SHORT = 64


class MergeReplay:
    """Encodes many words at once, as merging each word's lowest-ranked pair, leftmost first, again and again would."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.byte = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.byte:
            raise ValueError("the vocabulary must hold every single byte")
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.byte_ids = np.array(self.byte, dtype=np.int32)
        found = sorted(((ranks[t[:k]] << 32) | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys = np.array([k for k, _ in found] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.merged = np.array([r for _, r in found] + [NONE], dtype=np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NONE where there is none or a side is the end of a word."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        get = self.ranks.get
        whole = np.array([get(w, -1) for w in words], dtype=np.int64)
        counts = np.ones(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts = []
        for group, encode in ((np.flatnonzero((whole < 0) & (sizes <= SHORT)), self._many), (np.flatnonzero((whole < 0) & (sizes > SHORT)), self._each)):
            if group.size:
                ids, counts[group] = encode([words[k] for k in group.tolist()])
                parts.append((group, ids))
        start = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        done = np.flatnonzero(whole >= 0)
        flat[start[done]] = whole[done]
        for group, ids in parts:
            flat[spread(start[group], counts[group])] = ids
        return flat, counts

    def _many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Short words: all places of a rank are merged by one array operation, one place a word at a time."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        first = np.concatenate(([1], np.cumsum(sizes + 1)[:-1] + 1))
        n = int(sizes.sum() + len(words) + 1)
        ids = np.full(n, -1, dtype=np.int32)
        word = np.zeros(n, dtype=np.int32)
        word[first - 1] = 1
        word = np.cumsum(word, dtype=np.int32)
        body = np.ones(n, dtype=bool)
        body[first - 1] = False
        body[n - 1] = False
        ids[body] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, NONE, dtype=np.int32)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, r: np.ndarray) -> None:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for value, lo, hi in zip(r[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                have = places.get(value)
                if have is None:
                    places[value] = [at[lo:hi]]
                    heappush(heap, value)
                else:
                    have.append(at[lo:hi])

        live = np.flatnonzero(rank != NONE).astype(np.int32)
        if live.size:
            add(live, rank[live])
        while heap:
            r = heappop(heap)
            where = places.pop(r)
            at = where[0] if len(where) == 1 else np.concatenate(where)
            at = at[rank[at] == r]
            if at.size > 1:
                at.sort()
                own = word[at]
                again = own[1:] == own[:-1]
                if again.any():  # the rest waits: a merge may give its word a lower pair
                    places[r] = [at[1:][again]]
                    heappush(heap, r)
                    at = at[np.concatenate(([True], ~again))]
            elif not at.size:
                continue
            gone = after[at]
            far = after[gone]
            ids[at] = r
            after[at] = far
            before[far] = at
            rank[gone] = NONE
            prev = before[at]
            both = self._ranks(np.concatenate((np.full(len(at), r, dtype=np.int32), ids[prev])), np.concatenate((ids[far], np.full(len(at), r, dtype=np.int32))))
            rank[at] = both[: len(at)]
            rank[prev] = both[len(at) :]
            new = np.flatnonzero(both != NONE)
            if new.size:
                add(np.concatenate((at, prev))[new], both[new])
        # a place is left if the one before it leads to it
        alive = np.ones(n, dtype=bool)
        alive[1:] = after[before[1:]] == np.arange(1, n)
        got = np.flatnonzero(alive & (ids >= 0))
        return ids[got], np.diff(np.searchsorted(got, [*first.tolist(), n]))

    def _rank(self, pair: tuple[int, int]) -> int | None:
        try:
            return self.pairs[pair]
        except KeyError:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            r = self.pairs[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]])
            return r

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Long words: place by place, so that a run of one letter takes no longer than another word."""
        rank, byte = self._rank, self.byte
        out: list = [None] * len(words)
        ids: list[int] = []
        start: list[tuple[int, int, int]] = []
        for k, w in enumerate(words):
            start.append((k, len(ids), len(ids) + len(w)))
            ids += [byte[x] for x in w]
            ids.append(-1)  # no pair crosses it
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        places: dict[tuple[int, int], list[int]] = {}
        heap: list[tuple[int, tuple[int, int]]] = []

        def add(a: int, at: int, b: int) -> int | None:
            pair = (a, b)
            r = rank(pair)
            if r is not None:
                have = places.get(pair)
                if have is None:
                    places[pair] = [at]
                    heappush(heap, (r, pair))
                else:
                    have.append(at)
            return r

        for at in range(len(ids) - 1):
            if ids[at] >= 0 and ids[at + 1] >= 0:
                add(ids[at], at, ids[at + 1])
        ends = None
        while heap:
            r, pair = heappop(heap)
            where = places.pop(pair, None)
            if where is None:
                continue
            where.sort()
            a, b = pair
            waiting: list[int] = []
            held = -1  # places before this one wait: their word has a lower pair now
            for at in where:
                if ids[at] != a:
                    continue
                nxt = after[at]
                if ids[nxt] != b:
                    continue
                if at < held:
                    waiting.append(at)
                    continue
                ids[at] = r
                far = after[nxt]
                ids[nxt] = -2
                after[at] = far
                before[far] = at
                lower = False
                if ids[far] >= 0:
                    x = add(r, at, ids[far])
                    lower = x is not None and x <= r
                prev = before[at]
                if prev >= 0 and ids[prev] >= 0:
                    x = add(ids[prev], prev, r)
                    lower = lower or (x is not None and x <= r)
                if lower:
                    if ends is None:
                        ends = [e for _, _, e in start]
                    held = ends[_right(ends, at)]
            if waiting:
                have = places.get(pair)
                if have is None:
                    places[pair] = waiting
                    heappush(heap, (r, pair))
                else:
                    have += waiting
        for k, lo, hi in start:
            got, at = [], lo
            while at < hi:
                got.append(ids[at])
                at = after[at]
            out[k] = got
        return np.array([x for got in out for x in got], dtype=np.int32), np.array([len(x) for x in out])


def _right(ends: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(ends, at)


class _Numbers(dict):
    """Words to running numbers."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Store:
    """Runs of numbers, addressed by their place in the store."""

    def __init__(self) -> None:
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[at], self.size[at])]


class Decoder:
    """Ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        token = {v: k for k, v in ranks.items()}
        table = [token.get(k, b"") for k in range(max(token) + 1)]
        self.bytes = _Store()
        self.bytes.add(np.frombuffer(b"".join(table), dtype=np.uint8), np.array([len(x) for x in table]))

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.bytes.get(np.asarray(ids, dtype=np.int64)).astype(np.uint8).tobytes()


class _Chunks(_Numbers):
    """Chunks between spaces; loose[n]: white space stands at an end of chunk n, or nothing is in it."""

    def __init__(self) -> None:
        self.loose = bytearray()

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.loose.append(chunk[-2:-1].isspace() if chunk[-1:] == " " else not chunk or chunk[0].isspace() or chunk[-1].isspace())
        return n


class Codec:
    """Texts to ids and back; remembers words within a bound of bytes, for as long as a task runs.

    A text is cut at its spaces first, each space going with what follows, and
    the pattern is applied to the distinct chunks alone: a match holds a space
    at its start or lies in white space.  Texts where two white spaces meet at a
    space are cut by the pattern itself.
    """

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.replay = MergeReplay(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.at_spaces = pattern == SPACED
        self.decode = Decoder(self.replay.ranks)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.replay.pairs.clear()
        self.held = 0
        self.chunks = _Chunks()
        self.words = _Numbers()
        self.word_ids = _Store()
        self.chunk_ids = _Store()
        self.written: list[str] = []

    def _numbers(self, text: str | None) -> np.ndarray:
        """Chunk numbers of a text: "x" has a space in front, "x " has none, "x  " is a match of the pattern."""
        number = self.chunks.__getitem__
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.at_spaces:
            parts = text.split(" ")
            parts[0] += " "
            if parts[0] == " ":
                del parts[0]
            found = np.fromiter(map(number, parts), np.int32, len(parts))
            loose = np.frombuffer(self.chunks.loose, dtype=np.uint8)
            tight = not loose[found].any()
            del loose  # a bytearray that is looked at cannot grow
            if tight:
                return found
        parts = [w + "  " for w in self.split(text)]
        return np.fromiter(map(number, parts), np.int32, len(parts))

    def codes(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Chunk numbers of each text, all of them with known ids."""
        if self.held > self.remembered:
            self._forget()
        known, words = len(self.chunks), len(self.words)
        codes = [self._numbers(t) for t in texts]
        new = list(islice(self.chunks, known, None))
        if new:
            number, own, count = self.words.__getitem__, [], []
            for c in new:
                at = [number(c[:-2])] if c[-2:] == "  " else [number(w) for w in self.split(c[:-1] if c[-1:] == " " else " " + c)]
                own += at
                count.append(len(at))
            self.word_ids.add(*self.replay.encode([w.encode() for w in islice(self.words, words, None)]))
            own = np.array(own, dtype=np.int64)
            ids, sizes = self.word_ids.get(own), self.word_ids.size[own]
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(count)))]
            self.chunk_ids.add(ids, np.diff(ends))
            text = list(map(str, ids.tolist()))
            self.written += [",".join(text[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            # a chunk and a word each have a dictionary entry and an object, ids are held twice and written once
            self.held += 300 * len(new) + sum(map(len, new)) + 200 * (len(self.words) - words) + 20 * len(ids)
        return codes

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        return [self.chunk_ids.get(c) for c in self.codes(texts)]

    def write(self, code: np.ndarray) -> str:
        """A text's ids as decimals joined by commas."""
        return ",".join(map(self.written.__getitem__, code.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}
_DECODERS: dict[str, Decoder] = {}


@contextmanager
def codec(path: str, pattern: str) -> Iterator[Codec]:
    """For a task: the vocabulary stays with the worker process, what has been remembered goes."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    try:
        yield _CODECS[path, pattern]
    finally:
        _CODECS[path, pattern]._forget()
        release()


def decoder(path: str) -> Decoder:
    """One for each worker process; it holds the vocabulary's bytes alone."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(load_ranks(path))
    return _DECODERS[path]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", exact: str | None = None, keep: list[str] | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """docs, or its columns `keep`, with a column `out`, array<int>: the ids of the whole text, without special tokens.

    Null and empty texts give an empty array.  A column of that name is replaced.
    exact: name of a boolean column that tells whether the ids, decoded in the
    same pass, are the text's bytes.  path: a rank file every executor can open,
    as installed with the public tokenizers.
    """
    if keep is None:
        rows, texts_of = packed(docs.drop(out, *filter(None, [exact])), text_col)
    else:
        rows, texts_of = docs.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text")), lambda b: b["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as c:
            for b in batches:
                own = texts_of(b)
                for lo, hi in by_bytes(own, batch_bytes):
                    texts = own.slice(lo, hi - lo).to_pylist()
                    found = c.encode_batch(texts)
                    columns = {"row": b["row"].slice(lo, hi - lo), out: _lists(found)}
                    if exact:
                        columns[exact] = pa.array([c.decode(x) == (t or "").encode() for x, t in zip(found, texts, strict=True)], pa.bool_())
                    del found, texts
                    yield pa.record_batch(list(columns.values()), names=list(columns))
                    del columns
                    release()

    kind = rows.schema["row"].dataType.simpleString()
    more = f", `{exact}` boolean" if exact else ""
    return rows.mapInArrow(run, f"row {kind}, `{out}` array<int>{more}").select("row.*", out, *filter(None, [exact]))


def _lists(found: list[np.ndarray]) -> pa.Array:
    """Arrays of ids as one list array, without a Python object for each id."""
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a binary column `out`: the bytes of the ids.  Null ids count as none; an unknown id is an error."""
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for b in batches:
            yield pa.record_batch([b["row"], pa.array([back(x or []) for x in b["ids"].to_pylist()], pa.binary())], names=["row", out])

    packed = rows.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, `{out}` binary").select("row.*", out)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_digests(docs: DataFrame, path: str, pattern: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, decoded from the ids, and hashed in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as c:
            for b in batches:
                for lo, hi in by_bytes(b["text"], batch_bytes):
                    part = b.slice(lo, hi - lo)
                    codes = c.codes(part["text"].to_pylist())
                    found = [c.chunk_ids.get(x) for x in codes]
                    yield pa.record_batch(
                        [
                            part["doc_id"],
                            pa.array(map(len, found), pa.int64()),
                            pa.array([hashlib.sha256(c.write(x).encode()).hexdigest() for x in codes], pa.string()),
                            pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in found], pa.string()),
                        ],
                        schema=_DIGEST,
                    )
                    del part, codes, found
                    release()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
