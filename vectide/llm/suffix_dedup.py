"""Substring deduplication with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts in a
document with a smaller id.  Documents are dealt into blocks.  Every string of
`length` bytes belongs to one anchor, the place of its smallest hashed gram, so
equal strings have equal anchors at equal offsets, and one anchor stands for a
run of some fourteen strings.

1. Every block sends its anchors' hashes, four bytes each, to shards of the hash
   space, which tell it the ones that several documents hold.
2. For those the block sends the bytes of the run, once a block, with the
   smallest id that holds it.  A shard takes them as batches, one after another:
   a batch gets a suffix array, is merge-scanned against the levels that stand,
   and is then merged with those of about its size, so that a suffix is moved a
   logarithmic number of times.  The scan tells a batch the smallest ids that
   came before it, and notes which suffixes of earlier batches it has a smaller
   id for; these notes answer for the earlier batches in the end.  The arrays
   are ordered by 128-bit fingerprints of the suffixes' first `length` bytes, as
   longer matches are unions of such ones.
3. Blocks mark the bytes of strings whose first id is smaller than their own.

Texts cross the network once, in one exchange that all steps read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import NO_ID, ids

_U = np.uint64
_M1, _M2 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_B1, _B2 = _U(0x9E3779B97F4A7C15), _U(0xE7037ED1A0B428DB)
#: Bytes looked at together.
_PIECE = 1 << 21
_PLACE = _U((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _M1
    return h ^ (h >> _U(29))


def gram_hashes(b: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of `size` bytes, by doubling."""
    if len(b) < size:
        return np.zeros(0, dtype=_U)
    have = (b.astype(_U) + _U(1)) * _M2
    n, power, out, done, out_power = 1, base, None, 0, None
    with np.errstate(over="ignore"):
        while True:
            if size & n:  # the low parts go to the end of the gram
                if out is None:
                    out, done = have, n
                else:
                    k = len(b) - n - done + 1
                    out = have[:k] * out_power + out[n : n + k]
                    done += n
                out_power = power if out_power is None else out_power * power
            if 2 * n > size:
                return out
            have = have[:-n] * power + have[n:]
            power = power * power
            n *= 2


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    rest = width - n
    return np.minimum(v[:-rest], v[rest:]) if rest else v


class Runs:
    """Anchors of some texts: hash, text, first string (place in the text), strings, and a key of the run's bytes."""

    def __init__(self, texts: list[bytes], length: int, gram: int, keys: bool):
        parts = []
        group, held = [], 0
        for k, t in enumerate(texts):
            if len(t) < length:
                continue
            for at in range(0, len(t) - length + 1, _PIECE):  # long texts in pieces that share all but one byte of a string
                part = t[at : at + _PIECE + length - 1]
                group.append((k, at, part))
                held += len(part)
                if held >= _PIECE:
                    parts.append(self._piece(group, length, gram, keys))
                    group, held = [], 0
        if group:
            parts.append(self._piece(group, length, gram, keys))
        kinds = (_U, np.int64, np.int64, np.int64, _U)
        columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, dtype=kinds[c]) for c in range(5)]
        self.hash, self.text, self.start, self.count, self.key = columns

    @staticmethod
    def _piece(group: list[tuple[int, int, bytes]], length: int, gram: int, keys: bool) -> tuple:
        sizes = np.array([len(p) for _, _, p in group], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        b = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
        with np.errstate(over="ignore"):
            grams = _mix(gram_hashes(b, gram, _B1))
            least = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=_U), length - gram + 1)
            anchor = (least & _PLACE).astype(np.int64)  # of the string that starts here
            inside = np.ones(len(anchor), dtype=np.int8)  # strings may not cross texts
            for s in (begin[1:, None] - np.arange(1, length)).ravel() if len(begin) > 1 else ():
                inside[s] = 0
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])))
            new = np.flatnonzero(new)
            count = np.diff(np.append(new, len(anchor)))
            good = inside[new] == 1
            new, count = new[good], count[good]
            at = np.searchsorted(begin, new, "right") - 1
            key = np.zeros(len(new), dtype=_U)
            if keys:
                whole = gram_hashes(b, length, _B2)
                key = _mix(_mix(whole[new]) * _B1 + _mix(whole[new + count - 1]) + count.astype(_U))
        which = np.array([k for k, _, _ in group], dtype=np.int64)
        offset = np.array([a for _, a, _ in group], dtype=np.int64)
        return grams[anchor[new]], which[at], new - begin[at] + offset[at], count.astype(np.int64), key


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - start, size)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _array(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes in order with their smallest ids, and the place of each suffix among them."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # two suffixes share a fingerprint
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))[: len(k)]
    first, place = np.flatnonzero(new), np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first], c[first], np.minimum.reduceat(doc[order], first) if len(first) else doc, place


def _scan(key: np.ndarray, check: np.ndarray, level: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of a sorted array are in a level, and where: both are passed through in order."""
    k, c = level[:2]
    at = np.searchsorted(k, key)
    near = np.minimum(at, max(0, len(k) - 1))
    while len(k):  # past others with the same fingerprint
        move = (at < len(k)) & (k[near] == key) & (c[near] != check)
        if not move.any():
            hit = np.flatnonzero((at < len(k)) & (k[near] == key))
            return hit, near[hit]
        at = at + move
        near = np.minimum(at, len(k) - 1)
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


class Batch(NamedTuple):
    """A batch's distinct suffixes in order, their smallest ids, and the place among them of each suffix as it came."""

    key: np.ndarray
    check: np.ndarray
    first: np.ndarray
    place: np.ndarray


class SuffixFamily:
    """Levels: sorted arrays (fingerprint, second fingerprint, smallest id), each more than twice as large as the next."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.moved = self.matched = 0
        self.notes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def insert(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> Batch:
        """Scan a batch against the levels and add it; its distinct suffixes with the smallest ids so far."""
        k, c, own, place = _array(key, check, doc)
        first = own.copy()
        for level in self.levels:
            hit, at = _scan(k, c, level)
            self.matched += len(hit)
            held = level[2]
            then = held[at]
            first[hit] = np.minimum(first[hit], then)
            lower = own[hit] < then
            if lower.any():  # earlier batches hear of it in the end
                hit, at = hit[lower], at[lower]
                self.notes.append((k[hit], c[hit], own[hit]))
                held[at] = own[hit]
        if len(k):
            new = (k, c, own)
            while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
                old = self.levels.pop()
                self.moved += len(old[0]) + len(new[0])
                new = _array(*(np.concatenate(p) for p in zip(old, new, strict=True)))[:3]
            self.levels.append(new)
        return Batch(k, c, first, place.astype(np.int32))

    def close(self) -> None:
        """After the last batch: put the notes in order; the levels are done with."""
        self.levels = []
        self.notes = [_array(*(np.concatenate(p) for p in zip(*self.notes, strict=True)))[:3]] if self.notes else []

    def final(self, batch: Batch) -> np.ndarray:
        """The smallest id of each suffix of a batch, in all batches."""
        for notes in self.notes:
            hit, at = _scan(batch.key, batch.check, notes)
            batch.first[hit] = np.minimum(batch.first[hit], notes[2][at])
        return batch.first[batch.place]


_BLOB = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("body", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], dtype=np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(body, dtype=np.int64, count=len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, dtype=kind, count=n // np.dtype(kind).itemsize, offset=at))
        at += n
    return out


def _rows(block: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a block, in an order that doesn't depend on how they came."""
    pairs = sorted(zip(block["id"].to_pylist(), block["body"].to_pylist(), strict=True))
    return [p[0] for p in pairs], [p[1] for p in pairs]


class _Steps:
    def __init__(self, length: int, gram: int, shards: int, text: bool):
        self.length, self.gram, self.shards, self.text = length, gram, shards, text

    def _dealt(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and remaining bits of a hash."""
        return (hashes % _U(self.shards)).astype(np.int64), (hashes >> _U(32)).astype(np.uint32)

    def anchors(self, key: tuple, block: pa.Table) -> pa.Table:
        """A block's anchor hashes, by shard: all, and those that several of its documents hold."""
        own, texts = _rows(block)
        runs = Runs(texts, self.length, self.gram, keys=False)
        shard, low = self._dealt(runs.hash)
        doc = np.array(own, dtype=np.int64)[runs.text] if len(own) else runs.text
        order = np.lexsort((doc, low, shard))
        s, v, d = shard[order], low[order], doc[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (v[1:] != v[:-1]))) if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(s)) - 1 if len(at) else at
        several = d[at] != d[last] if len(at) else new
        s, v = s[at], v[at]
        out = []
        for k in np.unique(s).tolist():
            lo, hi = np.searchsorted(s, [k, k + 1])
            out.append((k, key[0].as_py(), _pack(v[lo:hi], v[lo:hi][several[lo:hi]])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, _BLOB, strict=True)], schema=_BLOB)

    def shared(self, key: tuple, blobs: pa.Table) -> pa.Table:
        """For each block those of its hashes that two documents hold, anywhere."""
        blocks = blobs["block"].to_pylist()
        parts = [_unpack(x.as_py(), np.uint32, np.uint32) for x in blobs["body"]]
        values = np.concatenate([p[0] for p in parts] + [p[1] for p in parts])
        values.sort()
        again = np.unique(values[1:][values[1:] == values[:-1]])
        out = [(b, _pack(np.array([key[0].as_py()], dtype=np.int64), p[0][_among(p[0], again)])) for b, p in zip(blocks, parts, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BACK, strict=True)], schema=_BACK)

    def runs(self, key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        """The bytes of a block's runs at shared anchors, each once, with the smallest and largest id."""
        own, texts = _rows(block)
        runs = Runs(texts, self.length, self.gram, keys=True)
        shard, low = self._dealt(runs.hash)
        wanted = [_unpack(x.as_py(), np.int64, np.uint32) for x in answers["body"]]
        known = np.sort(np.concatenate([(s.astype(np.uint64) << _U(32)) | v for s, v in wanted])) if wanted else np.zeros(0, _U)
        at = np.flatnonzero(_among((shard.astype(np.uint64) << _U(32)) | low, known))
        doc = np.array(own, dtype=np.int64)[runs.text[at]] if len(own) else at
        order = np.lexsort((doc, runs.key[at]))
        at, doc = at[order], doc[order]
        k = runs.key[at]
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(k)) - 1 if len(new) else new
        low_doc, high_doc, at = doc[new], doc[last], at[new]
        out = []
        to = shard[at]
        for s in np.unique(to).tolist():
            mine = np.flatnonzero(to == s)
            a = at[mine]
            text = b"".join(texts[t][b : b + n] for t, b, n in zip(runs.text[a].tolist(), runs.start[a].tolist(), (runs.count[a] + self.length - 1).tolist(), strict=True))
            out.append((s, key[0].as_py(), _pack(runs.key[a], low_doc[mine], high_doc[mine], runs.count[a].astype(np.uint32), np.frombuffer(zstandard.compress(text, 3), dtype=np.uint8))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, _BLOB, strict=True)], schema=_BLOB)

    def _suffixes(self, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both fingerprints of each suffix, run by run."""
        size = count.astype(np.int64) + self.length - 1
        at = _spread(np.cumsum(size) - size, count.astype(np.int64))
        return _mix(gram_hashes(text, self.length, _B1)[at]), gram_hashes(text, self.length, _B2)[at]

    @staticmethod
    def _run(body) -> list[np.ndarray]:
        *numbers, text = _unpack(body.as_py(), _U, np.int64, np.int64, np.uint32, np.uint8)
        return [*numbers, np.frombuffer(zstandard.decompress(text.tobytes()), dtype=np.uint8)]

    def first_ids(self, key: tuple, blobs: pa.Table) -> pa.Table:
        """For each block the strings that a smaller id than its largest holds: run key, first and last string, id."""
        family = SuffixFamily()
        blocks, bodies = blobs["block"].to_pylist(), blobs["body"]
        order = sorted(range(len(blocks)), key=lambda k: blocks[k])
        batches = []
        for k in order:
            run, low, high, count, text = self._run(bodies[k])
            batches.append((k, run, high, count, family.insert(*self._suffixes(count, text), np.repeat(low, count))))
        family.close()
        out = []
        for k, run, high, count, batch in batches:
            first = family.final(batch)
            n = count.astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            place = _spread(np.zeros(len(n), np.int64), n)
            cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (first[1:] != first[:-1]))))
            end = np.append(cut[1:], len(own)) - 1
            keep = first[cut] < high[own[cut]]
            cut, end = cut[keep], end[keep]
            if len(cut):
                out.append((blocks[k], _pack(run[own[cut]], place[cut].astype(np.uint32), place[end].astype(np.uint32), first[cut])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 2, _BACK, strict=True)], schema=_BACK)

    def cut(self, key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        """Mark and count a block's bytes, document by document."""
        own, texts = _rows(block)
        found = [_unpack(x.as_py(), _U, np.uint32, np.uint32, np.int64) for x in answers["body"]]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.cumsum(size) - size
        cover = np.zeros(int(size.sum()) + 1, dtype=np.int32)
        if found:
            run, a, z, first = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(run, kind="stable")
            run, a, z, first = run[order], a[order].astype(np.int64), z[order].astype(np.int64), first[order]
            runs = Runs(texts, self.length, self.gram, keys=True)
            lo, hi = np.searchsorted(run, runs.key, "left"), np.searchsorted(run, runs.key, "right")
            hit = np.flatnonzero(hi > lo)
            which, at = np.repeat(hit, (hi - lo)[hit]), _spread(lo[hit], (hi - lo)[hit])
            earlier = first[at] < np.array(own, dtype=np.int64)[runs.text[which]]
            which, at = which[earlier], at[earlier]
            start = begin[runs.text[which]] + runs.start[which]
            np.add.at(cover, start + a[at], 1)
            np.add.at(cover, start + z[at] + self.length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        body = np.frombuffer(b"".join(texts), dtype=np.uint8)
        out = []
        for ident, b, n in zip(own, begin.tolist(), size.tolist(), strict=True):
            g = gone[b : b + n]
            removed = int(g.sum())
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
            kept = body[b : b + n][~g].tobytes() if removed else body[b : b + n].tobytes()
            out.append((None if ident == NO_ID else ident, n, removed, spans, kept if self.text else None, hashlib.sha256(kept).hexdigest()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, _OUT, strict=True)], schema=_OUT)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 24, block_bytes: int = 12 << 20, shard_bytes: int = 8 << 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, if with_text) and kept_sha256 of every row.

    Null texts count as empty; texts shorter than `length` keep all bytes.  A
    null id is larger than any other, and rows with equal ids take nothing from
    each other.  Other columns don't matter.  block_bytes, shard_bytes: text in
    a block, and text whose anchors a shard holds; they bound a task's memory.
    """
    spark = docs.sparkSession
    source = docs.select(ids(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    steps = _Steps(length, gram, shards, with_text)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(blocks, min(parts, max(1, total // (1 << 20))))
    # by id and text: rows that repeat an id take nothing from each other, in one block or in several
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)).cast("long")).repartition(max(blocks, parts), "block")
    blob, back = "shard long, block long, body binary", "block long, body binary"
    anchors = dealt.groupBy("block").applyInArrow(lambda k, t: steps.anchors(k, t), blob)
    shared = anchors.groupBy("shard").applyInArrow(lambda k, t: steps.shared(k, t), back)
    runs = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda k, a, b: steps.runs(k, a, b), blob)
    first = runs.groupBy("shard").applyInArrow(lambda k, t: steps.first_ids(k, t), back)
    done = dealt.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(lambda k, a, b: steps.cut(k, a, b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return done if with_text else done.drop("kept")


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 50) -> Iterator[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row, with a table of all strings; for tests."""
    texts = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, i), i)
    for i, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(np.int8))))
        yield None if i == NO_ID else i, len(t), int(gone.sum()), int((edges == 1).sum()), np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
