"""Near-duplicate detection: MinHash signatures and a multi-index Hamming join.

A text's set of word shingles gets a signature of 16-bit symbols, one for each
of `chunks * symbols` hash functions.  Signatures are split into chunks.  By the
pigeonhole principle two signatures that differ in at most
`chunks * (errors + 1) - 1` symbols have a chunk with at most `errors` different
ones, so every choice of `errors` symbols of every chunk is left out in turn and
the rest is a key: all pairs under that distance share one.  Pairs that a wider
signature puts 5.5 standard deviations below the similarity are passed over; the
others are confirmed on their full sets.

Texts with equal sets are one class from the start.  A key's classes are not
paired with each other: each is compared with the key's hub and its first member,
and links are joined into components.  Classes that a chain of keys joins, while
their components differ, are a family: all its pairs from different components
are compared, bin against bin.  What is shuffled are sets and the bins they meet,
and what comes out of two bins are the links that join components, fewer than
the bins have classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import by_bytes, ids, release, shown, table

_U = np.uint64
_M1, _M2, _M3 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)
#: Bytes of words whose hashes a task remembers.
REMEMBERED = 32 << 20
#: Classes in a bin, and bytes of their sets.
BIN, BIN_BYTES = 1024, 16 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _M1
    h = (h ^ (h >> _U(29))) * _M2
    return h ^ (h >> _U(32))


class _Words(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > REMEMBERED:
            self.forget()
        self.held += 200 + len(word)
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def forget(self) -> None:
        self.clear()
        self.held = 0


_WORDS = _Words()


def _done() -> None:
    """At the end of a task."""
    _WORDS.forget()
    release()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, of all words if there are fewer; empty without words.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case.
    """
    words = (text or "").encode().lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, dtype=_U)
        for k in range(n):
            out = _mix(out * _M3 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Signer:
    """Signatures of shingle sets, and the keys of signatures."""

    def __init__(self, chunks: int, symbols: int, errors: int, width: int):
        self.chunks, self.symbols, self.errors = chunks, symbols, errors
        self.n = chunks * symbols
        self.width = max(width, self.n)
        rng = np.random.default_rng(20_08)
        self.mul = rng.integers(1, 1 << 63, self.width, dtype=np.uint64) * _U(2) + _U(1)
        self.add = rng.integers(0, 1 << 63, self.width, dtype=np.uint64)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each set, none of them empty, the 16-bit symbols of its keys, and `width` 8-bit symbols for estimates."""
        out, wide = np.empty((len(sets), self.n), dtype=np.uint16), np.empty((len(sets), self.width), dtype=np.uint8)
        if not sets:
            return out, wide
        starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        flat = np.concatenate(sets)
        with np.errstate(over="ignore"):
            for k in range(self.width):
                least = _mix(np.minimum.reduceat(flat * self.mul[k] + self.add[k], starts))
                wide[:, k] = least & _U(0xFF)
                if k < self.n:
                    out[:, k] = least & _U(0xFFFF)
        return out, wide

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """signatures x keys."""
        left = list(combinations(range(self.symbols), self.symbols - self.errors))
        out = np.empty((len(signs), self.chunks * len(left)), dtype=np.int64)
        with np.errstate(over="ignore"):
            for c in range(self.chunks):
                part = signs[:, c * self.symbols : (c + 1) * self.symbols].astype(_U)
                for k, at in enumerate(left):
                    h = np.full(len(signs), c * len(left) + k, dtype=_U)
                    for x in at:
                        h = _mix(h * _M3 + part[:, x])
                    out[:, c * len(left) + k] = h.view(np.int64)
        return out


def _sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    return [shingles(t, size) for t in texts.to_pylist()]


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


_SIGNED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sign", pa.binary()), ("wide", pa.binary())])


def _signed(docs: DataFrame, signer: Signer, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for lo, hi in by_bytes(b["text"], 2 << 20):
                    sets = _sets_of(b["text"].slice(lo, hi - lo), size)
                    some = [s for s in sets if len(s)]
                    signs, wides = (iter(x) for x in signer.sign(some))
                    yield pa.record_batch(
                        [
                            b["id"].slice(lo, hi - lo),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                            pa.array([next(signs).tobytes() if len(s) else None for s in sets], pa.binary()),
                            pa.array([next(wides).tobytes() if len(s) else None for s in sets], pa.binary()),
                        ],
                        schema=_SIGNED,
                    )
        finally:
            _done()

    return docs.mapInArrow(run, "id long, n_shingles long, set_key binary, sign binary, wide binary")


def _numbered(classes: DataFrame, bits: int = 64) -> DataFrame:
    """classes, written, with cid, a number of `bits` bits that no other class has.

    It is a hash of the set's 128-bit key; of classes that share one all but the
    one with the smallest key get another, until none does.
    """
    number = lambda k: F.xxhash64("set_key", F.lit(k)).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
    classes = table(classes.withColumn("cid", number(0)), "classes")
    for k in count(1):
        shared = classes.groupBy("cid").agg(F.min("set_key").alias("stays"), F.count("*").alias("n")).where("n > 1").select("cid", "stays")
        if not shared.limit(1).count():
            return classes
        classes = table(classes.join(shared, "cid", "left").withColumn("cid", F.when(F.col("set_key") > F.col("stays"), number(k)).otherwise(F.col("cid"))).drop("stays"), "classes")


def _keyed(classes: DataFrame, signer: Signer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                signs = np.frombuffer(b"".join(part["sign"].to_pylist()), dtype=np.uint16).reshape(-1, signer.n)
                keys = signer.keys(signs)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part["cid"].to_numpy(), keys.shape[1]))], names=["key", "cid"])

    return classes.select("cid", "sign").mapInArrow(run, "key long, cid long")


def _near(pairs: DataFrame, classes: DataFrame, signer: Signer, distance: int) -> DataFrame:
    """Pairs (a, b) whose wide signatures differ in at most `distance` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), dtype=np.uint8).reshape(-1, signer.width) for c in ("x", "y"))
                ok = (x != y).sum(1) <= distance
                yield pa.record_batch([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], names=["a", "b"])

    signs = classes.select("cid", F.col("wide").alias("sign"))
    both = pairs.join(signs.select(F.col("cid").alias("a"), F.col("sign").alias("x")), "a").join(signs.select(F.col("cid").alias("b"), F.col("sign").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _binned(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (cid, label, family, bytes) with bin; and the pairs of bins (p, q), p <= q, that hold different labels of a family.

    A label with a share of a family's classes has bins of its own, which need
    not meet each other; the other labels are dealt out whole.
    """
    slots = F.ceil(F.greatest(F.col("n") / BIN, F.col("b") / BIN_BYTES))
    sums = members.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).withColumn("own", (F.col("n") >= BIN / 4) | (F.col("b") >= BIN_BYTES / 4))
    large = sums.where("own").select("family", "label", slots.alias("slots"))
    small = sums.where("not own").groupBy("family").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).select("family", slots.alias("others"))
    bin_ = F.when(F.col("slots").isNotNull(), F.xxhash64("family", "label", F.pmod(F.xxhash64("cid"), "slots"))).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("label"), "others")))
    bins = table(members.join(large, ["family", "label"], "left").join(small, "family", "left").select("cid", "label", "family", bin_.alias("bin")), "bins")
    kinds = bins.groupBy("family", "bin").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left, right = (kinds.select("family", *(F.col(c).alias(c + x) for c in ("bin", "lo", "hi"))) for x in "pq")
    met = left.join(right, "family").where("binp < binq and not (lop = hip and loq = hiq and lop = loq)")
    return bins, met.selectExpr("binp as p", "binq as q").unionByName(kinds.where("lo < hi").selectExpr("bin as p", "bin as q"))


_RUNS = ("p", "q", "cid", "label", "bin", "wide")


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(p, q), and the rows of a pair of bins: arrays of cid, label and bin, the signatures, and lists of further columns; rows come sorted."""
    now, held = None, []
    for b in batches:
        for p, q, *row in zip(*(b[c].to_pylist() for c in columns), strict=True):
            if (p, q) != now:
                if len(held) > 1:
                    yield now, held
                now, held = (p, q), []
            held.append(row)
    if len(held) > 1:
        yield now, held


def _close(rows: list[list], width: int, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the first bin, each with those of the second whose wide signatures are near and whose labels differ."""
    label, bin_ = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
    sign = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(-1, width)
    x, y = np.flatnonzero(bin_ == bin_.min()), np.flatnonzero(bin_ == bin_.max())
    theirs, labels = np.ascontiguousarray(sign[y]), label[y]
    for i in x.tolist():
        other = np.flatnonzero(labels != label[i])
        if len(other):
            near = other[(theirs[other] != sign[i]).sum(1) <= distance] if len(other) < len(y) else np.flatnonzero((theirs != sign[i]).sum(1) <= distance)
            if len(near):
                yield i, y[near]


def _apart(rows: DataFrame, width: int, distance: int) -> DataFrame:
    """Of the rows (p, q, cid, label, bin, wide) those (p, q, cid) that are near one of another label: no more than came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, q), held in _groups(batches, _RUNS):
            hit: set[int] = set()
            for i, near in _close(held, width, distance):
                hit.add(i)
                hit.update(near.tolist())
            if hit:
                cids = [held[k][0] for k in sorted(hit)]
                yield pa.record_batch([pa.array([p] * len(cids), pa.int64()), pa.array([q] * len(cids), pa.int64()), pa.array(cids, pa.int64())], names=["p", "q", "cid"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "p", "q").sortWithinPartitions("p", "q", "cid").mapInArrow(run, "p long, q long, cid long")


def _forest(rows: list[list], width: int, distance: int, percent: int) -> list[tuple[int, int]]:
    """Links, confirmed on the sets, that join the components of two bins: a spanning forest."""
    root = {r[1]: r[1] for r in rows}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sets = [np.frombuffer(r[4], dtype=_U) for r in rows]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    marked, out = np.zeros(len(every), dtype=bool), []
    for i, near in _close(rows, width, distance):
        near = np.array([j for j in near.tolist() if find(rows[j][1]) != find(rows[i][1])], dtype=np.int64)
        near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
        if not len(near):
            continue
        own = code[start[i] : start[i] + size[i]]
        marked[own] = True
        flat = np.concatenate([code[start[j] : start[j] + size[j]] for j in near.tolist()])
        both = np.add.reduceat(marked[flat].astype(np.int64), np.cumsum(size[near]) - size[near])
        marked[own] = False
        for j in near[100 * both >= percent * (size[i] + size[near] - both)].tolist():
            a, b = find(rows[i][1]), find(rows[j][1])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((rows[i][0], rows[j][0]))
    return out


def _met(members: DataFrame, docs: DataFrame, classes: DataFrame, signer: Signer, distance: int, size: int, percent: int) -> DataFrame | None:
    """Links (a, b) that join the labels of members (cid, label, family, bytes); None if none are even near.

    First signatures meet, bin against bin; then the sets of what is near.
    """
    bins, pairs = _binned(members)
    pairs = table(pairs.distinct(), "pairs")
    dealt = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("bin")).join(bins.select("bin", "cid", "label"), "bin")
    known = dealt.join(classes.select("cid", "wide"), "cid").select(*_RUNS)
    near = table(_apart(known, signer.width, distance), "meet")
    if not (met := near.count()):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, (*_RUNS, "body")):
            out = _forest(held, signer.width, distance, percent)
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    body = _sets(docs, classes, near.select("cid").distinct(), size).dropDuplicates(["cid"])
    rows = near.join(bins.select("cid", "label", "bin").join(classes.select("cid", "wide"), "cid"), "cid").join(body, "cid").select(*_RUNS, "body")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(rows.repartition(parts, "p", "q").sortWithinPartitions("p", "q", "cid").mapInArrow(run, "a long, b long").distinct(), "more", met)


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid and body, the set, of the wanted classes, made again from the texts of their first ids; rows that repeat an id repeat the set.

    A bitmap of hashed ids, of bounded size, spares most other texts; what it lets
    through is joined by id and set, so it decides nothing.
    """
    bits = 1 << 24
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    marked = classes.join(wanted, "cid", "left_semi").select("cid", "set_key", F.col("first_id").alias("id"))
    marks = marked.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    rows = docs.select("id", "text", place("id").alias("p"))
    rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number("p") == F.col("bucket"))
    rows = rows.where(F.expr("(shiftright(cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(p) % 8 as int)) & 1) = 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for lo, hi in by_bytes(b["text"], 2 << 20):
                    found = [(i, s) for i, s in zip(b["id"].slice(lo, hi - lo).to_pylist(), _sets_of(b["text"].slice(lo, hi - lo), size), strict=True) if len(s)]
                    yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([_set_key(s) for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["id", "set_key", "body"])
        finally:
            _done()

    return rows.select("id", "text").mapInArrow(run, "id long, set_key binary, body binary").join(marked, ["id", "set_key"]).select("cid", "body")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose sets have 100 * intersection >= percent * union.

    Sets travel to their pairs' first
    member, whose pairs are dealt out again by a salt if it has many.
    """
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).alias("salts")), "a")
    members = salted.select(F.col("b").alias("cid"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("member"))
    pivots = salted.select("a", "salts").distinct().select(F.col("a").alias("cid"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    need = members.unionByName(pivots)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, dtype=_U)
        for b in batches:
            a, z = [], []
            for pivot, member, cid, body in zip(b["pivot"].to_pylist(), b["member"].to_pylist(), b["cid"].to_pylist(), b["body"], strict=True):
                s = np.frombuffer(body.as_buffer(), dtype=_U)
                if not member:
                    now, own = pivot, s
                elif now == pivot:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(pivot)
                        z.append(cid)
                else:
                    raise ValueError("a pair's first set is missing")
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    made = _sets(docs, classes, need.select("cid").distinct(), size)
    held = need.join(made, "cid").select("pivot", "salt", "member", "cid", "body")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "member", "cid").mapInArrow(confirm, "a long, b long").distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(cid, label) of every linked cid; label is the smallest cid reachable.  rows: how many links there are at most, if that is known.

    Large-star and small-star in turn, each round written to the shared folder,
    until the links are stars about their labels.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last, rows = None, links.count() if rows is None else rows
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = table(small.where("u <> v").distinct(), "stars", rows)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())
        last, rows = state, state[0]


def _mixed(members: DataFrame) -> DataFrame:
    """members (key, cid, label) of the keys with several labels."""
    several = members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    return members.join(several, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, chunks: int = 10, symbols: int = 6, errors: int = 1, width: int = 192) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id, a row for each document.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their
    sets of `size`-word shingles; component_id is the smallest id reachable,
    kept marks the row that has it, class_id is the smallest id with the same
    set.  Texts without words (null, empty, white space) have no set and are
    linked with nothing.  A null id is larger than any and shown as null.  Rows
    that repeat an id with an equal set are one document and give one row; with
    another set they give one for each.
    """
    signer = Signer(chunks, symbols, errors, width)
    share = percent / 100
    distance = math.ceil(signer.width * (1 - share) + 5.5 * math.sqrt(signer.width * share * (1 - share)))
    texts = docs.select(ids(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = table(_signed(texts, signer, size), "signed")
    sets = signed.where("set_key is not null")
    classes = _numbered(sets.groupBy("set_key").agg(F.min("id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"), F.first("wide").alias("wide")))

    keyed = _keyed(classes, signer)
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = table(keyed.join(crowd, "key"), "buckets")
    degree = buckets.groupBy("cid").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degree, "cid")
    heads = table(ranked.groupBy("key").agg(F.max_by("cid", F.struct("degree", F.col("cid"))).alias("hub"), F.min("cid").alias("low")), "heads")
    led = buckets.join(heads, "key")
    best = lambda c: led.where(F.col("cid") != F.col(c)).groupBy("cid", c).agg(F.count("*").alias("k")).groupBy("cid").agg(F.max_by(c, F.struct("k", F.col(c))).alias("other"))
    # the key's hub or first member is the pivot, so that its set is sent to few tasks
    first = table(best("hub").unionByName(best("low")).select(F.col("other").alias("a"), F.col("cid").alias("b")).distinct(), "tried")
    first = table(_near(first, classes, signer, distance), "near")
    links = table(_confirmed(first, texts, classes, size, percent), "links", first.count())

    label = components(links)
    told = buckets.select("key", "cid").join(label, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    told = table(_mixed(told), "told")
    if n := told.count():
        family = components(told.join(heads, "key").select(F.col("cid").alias("a"), F.col("hub").alias("b")), n).withColumnRenamed("label", "family")
        members = told.select("cid", "label").distinct().join(family, "cid").join(classes.select("cid", (8 * F.col("n")).alias("bytes")), "cid")
        more = _met(members, texts, classes, signer, distance, size, percent)
        if more is not None and more.limit(1).count():
            label = components(links.unionByName(more))

    labelled = classes.select("set_key", "cid", "first_id").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component"))
    of_class = labelled.join(least, "label").select("set_key", F.col("first_id").alias("class"), "component")
    rows = signed.select("id", "set_key", "n_shingles").distinct()
    alone = rows.where("set_key is null").select("id", "n_shingles", F.col("id").alias("class"), F.col("id").alias("component"))
    found = rows.join(of_class, "set_key").select("id", "n_shingles", "class", "component").unionByName(alone)
    return found.select(
        shown("id").alias("doc_id"),
        "n_shingles",
        shown("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
        shown("class").alias("class_id"),
    )


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns as they were.

    Documents without words stay.  Rows that share the staying id stay with it.
    """
    found = near_duplicates(docs, size=size, percent=percent).where("kept").select(ids().alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), ids().alias("id"))
    return rows.join(found, "id", "left_semi").select("row.*")
