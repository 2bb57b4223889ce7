"""Exact deduplication with Patricia-trie owners.

Texts that are equal after each run of ASCII white space has become one space
form a group; its owner is the smallest doc_id.  The rows are dealt out by text
length and content hash.  Every partition inserts full byte strings into a
compressed radix trie, whose terminal nodes keep the smallest id and the number
of rows, so equality is decided on bytes and the hash only routes.  A trie over
its budget spills whole subtrees to a temporary file and finishes them later,
one by one.  Before the shuffle each task merges its own rows in a small trie,
so a text that makes up a third of all rows reaches its owner once a task.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import ids, shown

_HEAD = struct.Struct("<qqqqI")


class _Node:
    __slots__ = ("children", "digest", "label", "low", "low_rows", "rows", "spill")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.rows = 0
        self.low = self.low_rows = 0
        self.digest = b""
        self.spill = None


def _shared(a: bytes, at: int, b: bytes) -> int:
    """Length of the common prefix of a[at:] and b, by halving."""
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings to (smallest id, rows, rows with that id), in bounded memory.

    budget: label bytes held before subtrees go to disk; None never spills.
    """

    def __init__(self, budget: int | None = None):
        self.root = _Node(b"")
        self.budget = budget
        self.held = 0
        self.spilled = 0

    def insert(self, key: bytes, low: int, rows: int, low_rows: int, digest: bytes) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.children[key[at]] = child
                self.held += len(key) - at + 200
                node, at = child, len(key)
            elif child.spill is not None:
                self._append(child.spill, key[at:], low, rows, low_rows, digest)
                return
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = _shared(key, at, child.label)
                middle = _Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                self.held += 200
                node, at = middle, at + n
        if not node.rows:
            node.low, node.rows, node.low_rows, node.digest = low, rows, low_rows, digest
        else:
            node.low_rows = (low_rows if low <= node.low else 0) + (node.low_rows if node.low <= low else 0)
            node.low = min(node.low, low)
            node.rows += rows
        if self.budget is not None and self.held > self.budget:
            self._spill()

    @staticmethod
    def _append(file, key: bytes, low: int, rows: int, low_rows: int, digest: bytes) -> None:
        file.write(_HEAD.pack(low, rows, low_rows, len(key), len(digest)))
        file.write(digest)
        file.write(key)

    @staticmethod
    def _walk(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
        stack = [(prefix + top.label, top)]
        while stack:
            path, node = stack.pop()
            if node.rows:
                yield path, node
            stack += [(path + x.label, x) for x in node.children.values()]

    @staticmethod
    def _bytes(top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            stack += [x for x in node.children.values() if x.spill is None]
        return total

    def _spill(self) -> None:
        """Write the largest subtrees below the first fork, until half the budget is free."""
        fork = self.root
        while len(live := [x for x in fork.children.values() if x.spill is None]) == 1 and len(fork.children) == 1:
            fork = live[0]
        sizes = sorted(((self._bytes(x), x) for x in live), key=lambda p: -p[0])
        if not sizes or (len(fork.children) == 1 and not sizes[0][1].children):
            self.budget = max(self.budget, 2 * self.held)  # one long text: nothing to divide
            return
        for size, child in sizes:
            file = tempfile.TemporaryFile()  # noqa: SIM115  closed when its subtree is done
            for path, node in self._walk(child, b""):
                self._append(file, path, node.low, node.rows, node.low_rows, node.digest)
            first = child.label[:1]
            stub = _Node(first)
            stub.spill = file
            fork.children[first[0]] = stub
            self.held -= size
            self.spilled += 1
            if self.held <= self.budget // 2:
                break

    def owners(self) -> Iterator[_Node]:
        """Every terminal node; spilled subtrees are read back one at a time."""
        stack, files = [self.root], []
        while stack:
            node = stack.pop()
            if node.spill is not None:
                files.append(node.spill)
                continue
            if node.rows:
                yield node
            stack += node.children.values()
        self.root = _Node(b"")
        for file in files:
            part = PatriciaTrie(self.budget)
            file.seek(0)
            while head := file.read(_HEAD.size):
                low, rows, low_rows, n, d = _HEAD.unpack(head)
                digest = file.read(d)
                part.insert(file.read(n), low, rows, low_rows, digest)
            file.close()
            yield from part.owners()

    def texts(self) -> Iterator[tuple[bytes, _Node]]:
        yield from self._walk(self.root, b"")


_PARTIAL = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("low", pa.int64()), ("rows", pa.int64()), ("low_rows", pa.int64())])
_OWNERS = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("owner", pa.int64()), ("group_size", pa.int64()), ("owner_rows", pa.int64())])


def _partial(budget: int):
    """Merge a task's rows; the trie is handed on whenever it is full."""

    def drain(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for body, node in trie.texts():
            rows.append((len(body), node.digest, body, node.low, node.rows, node.low_rows))
            held += len(body)
            if held > 4 << 20:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTIAL, strict=True)], schema=_PARTIAL)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTIAL, strict=True)], schema=_PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for b in batches:
            for ident, digest, body in zip(b["id"].to_pylist(), b["digest"], b["body"], strict=True):
                trie.insert(body.as_py(), ident, 1, 1, digest.as_py())
                if trie.held > budget:
                    yield from drain(trie)
                    trie = PatriciaTrie()
        yield from drain(trie)

    return run


def _owners(budget: int):
    """The final tries of a partition of (length, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        length: dict[bytes, int] = {}
        for b in batches:
            columns = (b[c].to_pylist() for c in ("low", "rows", "low_rows", "n_bytes"))
            for digest, body, low, rows, low_rows, n in zip(b["digest"], b["body"], *columns, strict=True):
                digest = digest.as_py()
                length[digest] = n
                trie.insert(body.as_py(), low, rows, low_rows, digest)
        done: set[bytes] = set()
        rows = []
        for node in trie.owners():
            if node.digest in done:
                raise ValueError("two different texts share a content hash and a length")
            done.add(node.digest)
            rows.append((length[node.digest], node.digest, node.low, node.rows, node.low_rows))
            if len(rows) >= 20_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _OWNERS, strict=True)], schema=_OWNERS)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _OWNERS, strict=True)], schema=_OWNERS)

    return run


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", combine_bytes: int = 16 << 20, trie_bytes: int = 96 << 20) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept, text_sha256 and owner_rows.

    All columns of docs stay (except those five names).  Null texts count as
    empty, and empty texts form a group like any other.  A null id is larger
    than any id: it stays only where its group has no other, and keep_id is then
    null.  Rows repeated with the owner's id are all kept (owner_rows counts
    them); `exact_dedup` leaves one of them.  An empty table gives an empty one.
    combine_bytes, trie_bytes: memory of a task's tries before and after the shuffle.
    """
    ours = ("keep_id", "group_size", "kept", "text_sha256", "owner_rows")
    docs = docs.drop(*ours)
    rows = _with_digest(docs, id_col, text_col)
    return rows.join(_owners_of(docs, id_col, text_col, combine_bytes, trie_bytes), ["digest", "n_bytes"], "left").select(
        "row.*",
        shown("owner").alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("owner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "owner_rows",
    )


def _with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = normalised(F.col(text_col)).cast("binary")
    return docs.select(F.struct("*").alias("row"), ids(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))


def _owners_of(docs: DataFrame, id_col: str, text_col: str, combine_bytes: int, trie_bytes: int) -> DataFrame:
    """n_bytes, digest, owner, group_size and owner_rows of every distinct text."""
    keyed = docs.select(ids(id_col).alias("id"), normalised(F.col(text_col)).cast("binary").alias("body"))
    keyed = keyed.select("id", "body", F.unhex(F.sha2("body", 256)).alias("digest"))
    partial = keyed.mapInArrow(_partial(combine_bytes), "n_bytes long, digest binary, body binary, low long, rows long, low_rows long")
    return partial.repartition("n_bytes", "digest").mapInArrow(_owners(trie_bytes), "n_bytes long, digest binary, owner long, group_size long, owner_rows long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", combine_bytes: int = 16 << 20, trie_bytes: int = 96 << 20) -> DataFrame:
    """docs without exact copies: of each group one row with the smallest id stays, as it was.

    Rows meet the owners by id and content, so the copies of a popular text are
    spread over all tasks.  Of rows that repeat the owner's id any one stays.
    """
    owners = _owners_of(docs, id_col, text_col, combine_bytes, trie_bytes).withColumnRenamed("owner", "id")
    kept = _with_digest(docs, id_col, text_col).join(owners, ["id", "digest", "n_bytes"])
    again = kept.where("owner_rows > 1").dropDuplicates(["digest", "n_bytes"])
    return kept.where("owner_rows = 1").unionByName(again).select("row.*")
