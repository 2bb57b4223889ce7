"""Benchmark decontamination by suffix arrays over the training documents.

The training documents are indexed shard by shard: the words of a shard become
one code array, and its suffixes are sorted by their first `window` words.  All
suffixes of the benchmark items are then binary-searched in the shard at once,
which gives the verbatim matches and where they lie.  Words that no item uses
end a match, so only suffixes that can still reach the shortest window are
sorted.  Matches of consecutive suffixes of one item at consecutive words are one
longer match: chained, they give every maximal verbatim match and where it lies.
A shard is some megabytes of whole documents, so nothing is shuffled.  The
benchmark is broadcast in blocks of a bounded size, one pass for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import by_bytes, packed, release

#: Bytes to themselves in lower case if they belong to a word, to a space if not.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The distinct windows of a block of items, as padded code rows, and where they stand in the items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.name_of = np.array([number[name] for name, _ in items], dtype=np.int64)
        for k, (_, text) in enumerate(items):
            words = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1)) if words else ():
                found.setdefault(tuple(words[at : at + window]), []).append((k, at))
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        self.rows = np.zeros((len(found), window), dtype=np.int32)
        for row, w in zip(self.rows, found, strict=True):
            row[: len(w)] = w
        places = np.array([x for own in found.values() for x in own], dtype=np.int32).reshape(-1, 2)
        self.text, self.offset = places[:, 0].copy(), places[:, 1].copy()
        self.starts = np.concatenate(([0], np.cumsum([len(own) for own in found.values()]))).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0


def suffix_array(codes: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """positions, ordered by the words that follow, by prefix doubling until depth words are told apart."""
    rank = codes.astype(np.int64)
    known = 1
    while known < depth:
        ahead = np.zeros_like(rank)
        ahead[:-known] = rank[known:]
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(pair, kind="stable")
        step = np.empty(len(pair), dtype=np.int64)
        step[order] = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        rank, known = step, 2 * known
    return positions[np.argsort(rank[positions], kind="stable")]


def search(windows: Windows, codes: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window, the range of the suffix array that starts with it."""
    n, q = len(suffixes), len(windows.lengths)
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(q, dtype=np.int64), np.full(q, n, dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at, sign = suffixes[mid], np.zeros(len(open_), dtype=np.int8)
            tied = np.arange(len(open_))
            for k in range(windows.window):
                tied = tied[windows.lengths[open_[tied]] > k]
                if not tied.size:
                    break
                own, other = windows.rows[open_[tied], k], codes[at[tied] + k]
                sign[tied] = np.sign(other - own)
                tied = tied[own == other]
            right = (sign < 0) | (upper & (sign == 0))
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each run."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def match_shard(windows: Windows, texts: list[str | None], matches: bool = False) -> list[tuple[int, list[tuple[int, int]], list[str], list[tuple]]]:
    """Of each document: words, runs of hit words as (start, stop), items, and, if asked for, maximal matches as (item, place in the item, place, words)."""
    words, sizes = [], []
    for t in texts:
        own = words_of(t)
        words += map(windows.codes.get, own, repeat(0))
        words.append(0)
        sizes.append(len(own))
    codes = np.concatenate((np.fromiter(words, np.int32, len(words)), np.zeros(windows.window + 1, dtype=np.int32)))
    out: list = [(n, [], [], []) for n in sizes]
    if not windows.shortest:
        return out
    starts = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)))
    gap = np.flatnonzero(codes == 0)
    run = gap[np.searchsorted(gap, np.arange(len(codes) - windows.window - 1))] - np.arange(len(codes) - windows.window - 1)
    at = np.flatnonzero(run >= windows.shortest)
    if not at.size:
        return out
    # only stretches that hold such a suffix are sorted
    keep = np.zeros(len(codes), dtype=bool)
    keep[at] = True
    inside = np.flatnonzero(keep | (run_reach(run, windows.shortest, len(codes))))
    small = np.zeros(len(inside) + windows.window + 1, dtype=np.int32)
    small[: len(inside)] = codes[inside]
    suffixes = suffix_array(small, np.flatnonzero(keep[inside]), windows.window)
    low, high = search(windows, small, suffixes)
    hit = np.flatnonzero(high > low)
    if not hit.size:
        return out
    counts = high[hit] - low[hit]
    where = inside[suffixes[_expand(low[hit], counts)]]
    which = np.repeat(hit, counts)
    cover = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + windows.lengths[which], -1)
    edges = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for b, e, d in zip(begins.tolist(), ends.tolist(), (np.searchsorted(starts, begins, "right") - 1).tolist(), strict=True):
        out[d][1].append((b - int(starts[d]), e - int(starts[d])))
    docs = np.searchsorted(starts, where, "right") - 1
    pairs = np.unique(docs * len(windows.lengths) + which)
    own, window = pairs // len(windows.lengths), pairs % len(windows.lengths)
    found: set[int] = set()
    for lo, hi in _chunks(windows.starts[window + 1] - windows.starts[window]):
        counts = (windows.starts[window + 1] - windows.starts[window])[lo:hi]
        items = windows.name_of[windows.text[_expand(windows.starts[window[lo:hi]], counts)]]
        found.update(np.unique(np.repeat(own[lo:hi], counts) * len(windows.names) + items).tolist())
    for p in sorted(found):
        out[p // len(windows.names)][2].append(windows.names[p % len(windows.names)])
    if matches:
        for doc, *match in _maximal(windows, docs, which, where - starts[docs]):
            out[doc][3].append(tuple(match))
    return out


def _chunks(counts: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs whose counts add up to about `most`, one at least."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _maximal(windows: Windows, docs: np.ndarray, which: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, str, int, int, int]]:
    """(document, item, place in the item, place in the document, words) of maximal matches, from the windows that occur at places.

    Windows of an item that follow each other there and in the document are one
    match.  Whole documents are taken at a time.
    """
    order = np.lexsort((place, docs))
    docs, which, place = docs[order], which[order], place[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    counts = windows.starts[which + 1] - windows.starts[which]
    for lo, hi in _chunks(np.add.reduceat(counts, first)):
        a, z = int(first[lo]), int(first[hi]) if hi < len(first) else len(docs)
        at = _expand(windows.starts[which[a:z]], counts[a:z])
        row = np.repeat(np.arange(a, z), counts[a:z])
        doc, text, where, offset, size = docs[row], windows.text[at].astype(np.int64), place[row], windows.offset[at].astype(np.int64), windows.lengths[which[row]]
        o = np.lexsort((where, where - offset, text, doc))
        doc, text, where, offset, size = doc[o], text[o], where[o], offset[o], size[o]
        follows = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (where[1:] == where[:-1] + 1) & (offset[1:] == offset[:-1] + 1)
        start = np.flatnonzero(np.concatenate(([True], ~follows)))
        stop = np.append(start[1:], len(doc))
        for d, t, f, w, n in zip(doc[start].tolist(), text[start].tolist(), offset[start].tolist(), where[start].tolist(), (stop - start - 1 + size[start]).tolist(), strict=True):
            yield d, windows.names[windows.name_of[t]], f, w, n


def run_reach(run: np.ndarray, shortest: int, n: int) -> np.ndarray:
    """Positions in, or just after, a stretch of known words at least `shortest` long."""
    begins = np.flatnonzero((run >= shortest) & (np.concatenate(([0], run[:-1])) == 0))
    cover = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + run[begins] + 1, -1)
    return np.cumsum(cover)[:n] > 0


_MATCH = "n_words long, hits array<struct<start:long,stop:long>>, items array<string>, matches array<struct<item:string,item_start:long,start:long,words:long>>"


def _matcher(blocks, shard_bytes: int, matches: bool):
    fields = ("item", "item_start", "start", "words")
    maximal = pa.list_(pa.struct([(n, pa.string() if n == "item" else pa.int64()) for n in fields]))
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = blocks.value
        for b in batches:
            texts = b["_text"]
            for lo, hi in by_bytes(texts, shard_bytes):
                found = match_shard(windows, texts.slice(lo, hi - lo).to_pylist(), matches)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b[k].slice(lo, hi - lo) for k in range(b.num_columns - 1)],
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"start": s, "stop": e} for s, e in x[1]] for x in found], pairs),
                        pa.array([x[2] for x in found], pa.list_(pa.string())),
                        pa.array([[dict(zip(fields, m, strict=True)) for m in x[3]] for x in found], maximal),
                    ],
                    names=[*b.schema.names[:-1], "n_words", "hits", "items", "matches"],
                )

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, window: int, block_bytes: int) -> tuple[int, Iterator[Windows]]:
    """The number of blocks of some `block_bytes` that the items are dealt into, and their windows, made one after another."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // block_bytes))
    dealt = (items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k) if passes > 1 else items for k in range(passes))
    return passes, (Windows([tuple(r) for r in block.toLocalIterator()], window) for block in dealt)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20, shard_bytes: int = 8 << 20, with_matches: bool = False) -> DataFrame:
    """The columns `keep` of docs, n_words, hits (runs of hit words), items (sorted as strings) and matches, a row for each document.

    matches, empty unless with_matches: every maximal verbatim match of an item,
    at least a window, as (item, item_start, start, words), places from 0.

    A window is `window` consecutive words of an item, or all words of a shorter
    one; items without words (null, empty) have none.  A null item_id shows as
    the string "".  Repeated items and texts count once.  Null documents have no
    words.  block_bytes bounds the item text that is broadcast in one pass; a
    larger benchmark takes more passes, whose rows are merged on a row number
    made of the kept columns' own rows.
    """
    passes, blocks = _blocks(benchmark, item_col, item_text, window, block_bytes)
    spark = docs.sparkSession
    if passes == 1:
        source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    else:  # a key of the row itself; equal rows have equal answers
        source = docs.select(*keep, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    parts = [source.mapInArrow(_matcher(spark.sparkContext.broadcast(windows), shard_bytes, with_matches), f"{schema + ', ' if schema else ''}{_MATCH}") for windows in blocks]
    if passes == 1:
        return parts[0]
    # every pass answers for the same texts, so the merge is on distinct texts
    merged = None
    for p in parts:
        own = p.select("_key", "n_words", "hits", "items", "matches")
        merged = own if merged is None else merged.unionByName(own)
    merged = merged.groupBy("_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_set("matches"))).alias("matches"),
    )
    return source.drop("_text").join(merged, "_key").select(*keep, "n_words", _union_runs("hits").alias("hits"), "items", "matches")


def _union_runs(column: str):
    """Overlapping or touching (start, stop) runs as maximal ones."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(column), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """docs without those in which a benchmark window occurs; columns and rows else as they were.

    One pass over the documents for each block of the benchmark, as in benchmark_matches.
    """
    for windows in _blocks(benchmark, "item_id", "text", window, block_bytes)[1]:
        rows, texts_of = packed(docs, "text")
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        docs = rows.mapInArrow(_clean(shared, texts_of, shard_bytes), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
    return docs


def _clean(shared, texts_of, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                texts = texts_of(b)
                for lo, hi in by_bytes(texts, shard_bytes):
                    free = [not x[1] for x in match_shard(shared.value, texts.slice(lo, hi - lo).to_pylist())]
                    yield pa.record_batch([b["row"].slice(lo, hi - lo).filter(pa.array(free, pa.bool_()))], names=["row"])
        finally:
            release()

    return run


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
