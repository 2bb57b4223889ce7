"""A tree over cluster centroids: build, beam search, edits, and a table of its nodes.

A node holds either child nodes or clusters (leaves), never both.  The tree has
as many leaves as there are clusters, so it is built on the driver and broadcast;
queries stream past it in Arrow batches.  Distances are float64, ties go to the
smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import l2_sq, matrix
from vectide.operators.assign import nearest_within, parts_of
from vectide.operators.kmeans import lloyd, seed_centroids

# fixed values of the build
ITERS, SEED = 6, 0x51F15E
DEEPEST = 1024
#: Numbers of an array of the nodes below the beams of some queries, few enough for a processor's cache.
STEP = 1 << 18


@dataclass
class Node:
    centroid: np.ndarray
    children: list[int] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)


@dataclass
class Work:
    """Distances computed in float and on 8-bit copies."""

    floats: int = 0
    quantised: int = 0


def _nearest_first(d: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest, by distance and then id."""
    return np.lexsort((ids, d))[: max(n, 0)]


def _d2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((x - q) ** 2).sum(1)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - start, size)


def _pairs_l2(x: np.ndarray, row: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance of each pair of a row of x and a row of y, without cancellation."""
    out, step = np.empty(len(row)), max(1, (1 << 21) // max(1, x.shape[1]))
    for lo in range(0, len(row), step):
        d = x[row[lo : lo + step]] - y[at[lo : lo + step]]
        out[lo : lo + step] = np.einsum("ij,ij->i", d, d)
    return out


def _rows_l2(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x and the rows of y at its places, without cancellation; infinite at place -1."""
    d = y[at] - x[:, None, :]
    return np.where(at >= 0, np.einsum("ijk,ijk->ij", d, d), np.inf)


def _best(row: np.ndarray, d2: np.ndarray, ident: np.ndarray, n: int) -> np.ndarray:
    """Places of each row's n smallest, by distance and then id, in order of row."""
    order = np.lexsort((ident, d2, row))
    own = row[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < n]


class Tree:
    """A centroid tree; edits make a new one and leave the old as it is."""

    def __init__(self, nodes: list[Node], vectors: np.ndarray, fanout: int, coded: tuple | None = None):
        self.nodes, self.vectors, self.fanout, self.coded, self._arrays, self._rows, self._widest = nodes, vectors, fanout, coded, None, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_arrays": None, "_rows": None, "_widest": None}

    # shape

    @property
    def dims(self) -> int:
        return self.vectors.shape[1] if len(self.vectors) else 0

    def __len__(self) -> int:
        return len(self.vectors)

    @property
    def height(self) -> int:
        def deep(n: int) -> int:
            return 1 + max((deep(c) for c in self.nodes[n].children), default=0)

        return deep(0) if self.nodes else 0

    def leaf(self, k: int) -> np.ndarray:
        return self.vectors[k]

    # build

    @staticmethod
    def build(centroids: np.ndarray, fanout: int = 32) -> Tree:
        """k-means on k-means: a node of at most fanout clusters holds them, a larger one is divided."""
        x = np.asarray(centroids, dtype=np.float64)
        x = x.reshape(len(x), x.shape[1] if x.ndim == 2 else 0)
        if not np.isfinite(x).all() or (len(x) and (x * x).sum(1).max() > np.finfo(np.float32).max):
            raise ValueError("centroids have to be finite, with squared norms that float32 can hold")
        fanout = max(fanout, 2)
        nodes: list[Node] = []

        def grow(ids: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(Node(x[ids].mean(0)))
            if len(ids) <= fanout:
                nodes[at].leaves = ids.tolist()
                return at
            k = min(fanout, -(-len(ids) // fanout))
            own = x[ids]
            _, side = lloyd(own, seed_centroids(own, k, np.random.default_rng(SEED + depth)), ITERS, False)
            if len(np.unique(side)) < 2:  # identical points are divided in order
                side = np.arange(len(ids)) * k // len(ids)
            for g in np.unique(side):
                nodes[at].children.append(grow(ids[side == g], depth + 1))
            return at

        if len(x):
            grow(np.arange(len(x)), 0)
        return Tree(nodes, x, fanout)

    # search

    def _beam(self, q: np.ndarray, beam: int, work: Work) -> list[int]:
        """Nodes with leaves that a beam of nodes a level reaches; those met on the way are set aside and kept."""
        level, held = [0], []
        while level:
            held += [n for n in level if not self.nodes[n].children]
            nxt = np.array([c for n in level for c in self.nodes[n].children], dtype=np.int64)
            if not len(nxt):
                break
            d = _d2(q, np.stack([self.nodes[c].centroid for c in nxt]))
            work.floats += len(nxt)
            level = nxt[_nearest_first(d, nxt, max(beam, 1))].tolist()
        return held

    def search(self, q: np.ndarray, beam: int, probe: int, work: Work | None = None) -> list[int]:
        """The probe nearest clusters among those the beam reaches; empty for another width, no probe or no clusters."""
        work = work if work is not None else Work()
        q = np.asarray(q, dtype=np.float64)
        if not self.nodes or len(q) != self.dims or probe <= 0:
            return []
        leaves = np.array([k for n in self._beam(q, beam, work) for k in self.nodes[n].leaves], dtype=np.int64)
        return self._rank(q, leaves, probe, work)

    def _rank(self, q: np.ndarray, leaves: np.ndarray, probe: int, work: Work) -> list[int]:
        if not len(leaves):
            return []
        if self.coded is None:
            d = _d2(q, self.vectors[leaves])
            work.floats += len(leaves)
            return leaves[_nearest_first(d, leaves, probe)].tolist()
        work.quantised += len(leaves)
        low, high = (z[0] for z in self._span(q[None], leaves[None]))
        limit = np.partition(high, min(probe, len(high)) - 1)[min(probe, len(high)) - 1]
        open_ = leaves[low <= limit]
        work.floats += len(open_)
        d = _d2(q, self.vectors[open_])
        return open_[_nearest_first(d, open_, probe)].tolist()

    def _flat(self) -> tuple:
        """Children and leaves of every node as runs of one array each, and centroids as one matrix."""
        if self._arrays is None:
            kids = [np.array(sorted(n.children), dtype=np.int64) for n in self.nodes]
            leaves = [np.array(sorted(n.leaves), dtype=np.int64) for n in self.nodes]
            runs = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int64), np.cumsum([0, *map(len, x)]))
            self._arrays = (*runs(kids), *runs(leaves), np.stack([n.centroid for n in self.nodes]))
        return self._arrays

    def search_many(self, q: np.ndarray, beam: int, probe: int, work: Work | None = None) -> np.ndarray:
        """The same for many queries at once, queries x probe, -1 where there are no more.

        Only the pairs of a query and a node below its beam are measured.  With
        8-bit copies leaves are measured on integers first, and in float only
        where the copies' errors leave the order open.
        """
        work = work if work is not None else Work()
        out = np.full((len(q), max(probe, 0)), -1, dtype=np.int64)
        q = np.asarray(q, dtype=np.float64)
        if not self.nodes or probe <= 0 or q.shape[1] != self.dims:
            return out
        if self._widest is None:
            self._widest = max(max(len(n.children), len(n.leaves)) for n in self.nodes)
        if self._widest <= 8 * self.fanout:
            step = max(1, min(4096, STEP // (max(1, beam) * max(1, self._widest) * max(1, self.dims))))
            for lo in range(0, len(q), step):
                found = self._padded_search(q[lo : lo + step], beam, probe, work)
                out[lo : lo + step, : found.shape[1]] = found
            return out
        kids, kid_at, leaves, leaf_at, centroids = self._flat()  # a node has grown large: pair by pair
        for lo in range(0, len(q), 4096):
            x = q[lo : lo + 4096]
            row, node, held = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), []
            while len(row):
                size = kid_at[node + 1] - kid_at[node]
                held.append((row[size == 0], node[size == 0]))
                row, node = np.repeat(row, size), kids[_spread(kid_at[node], size)]
                if not len(row):
                    break
                work.floats += len(row)
                keep = _best(row, _pairs_l2(x, row, centroids, node), node, max(beam, 1))
                row, node = row[keep], node[keep]
            row, node = (np.concatenate(c) for c in zip(*held, strict=True))
            size = leaf_at[node + 1] - leaf_at[node]
            row, leaf = np.repeat(row, size), leaves[_spread(leaf_at[node], size)]
            order = np.argsort(row, kind="stable")
            row, leaf = row[order], leaf[order]
            if self.coded is not None and len(row):
                open_ = self._open(x, row, leaf, probe)
                work.quantised += len(row)
                row, leaf = row[open_], leaf[open_]
            work.floats += len(row)
            keep = _best(row, _pairs_l2(x, row, self.vectors, leaf), leaf, probe)
            row, leaf = row[keep], leaf[keep]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out[lo + row, place] = leaf
        return out

    def _padded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children and leaves of every node as rows filled up with -1, the last row being that of no node; and the centroids."""
        if self._rows is None:
            rows = []
            for lists in ([n.children for n in self.nodes], [n.leaves for n in self.nodes]):
                own = np.full((len(self.nodes) + 1, max(1, *map(len, lists))), -1, dtype=np.int64)
                for k, x in enumerate(lists):
                    own[k, : len(x)] = x
                rows.append(own)
            self._rows = (*rows, np.stack([n.centroid for n in self.nodes]))
        return self._rows

    def _padded_search(self, x: np.ndarray, beam: int, probe: int, work: Work) -> np.ndarray:
        """search_many for some rows: every level is one array of the nodes below a row's beam."""
        kids, leaves, centroids = self._padded()
        node, held = np.zeros((len(x), 1), dtype=np.int64), []
        while True:
            below = np.sort(kids[node].reshape(len(x), -1), axis=1)
            held.append(np.where(kids[node][:, :, 0] < 0, node, -1))
            if (below < 0).all():
                break
            work.floats += int((below >= 0).sum())
            d = _rows_l2(x, centroids, below)
            best = np.argsort(d, axis=1, kind="stable")[:, : max(beam, 1)]  # ids ascend, so ties go to the smaller one
            node = np.sort(np.where(np.isfinite(np.take_along_axis(d, best, 1)), np.take_along_axis(below, best, 1), -1), axis=1)
        leaf = np.sort(leaves[np.concatenate(held, axis=1)].reshape(len(x), -1), axis=1)
        leaf = leaf[:, (leaf >= 0).any(0)]
        if not leaf.shape[1]:
            return np.full((len(x), 0), -1, dtype=np.int64)
        there = leaf >= 0
        if self.coded is not None:
            work.quantised += int(there.sum())
            low, high = self._span(x, leaf)
            high[~there] = np.inf
            limit = np.partition(high, min(probe, leaf.shape[1]) - 1, axis=1)[:, min(probe, leaf.shape[1]) - 1]
            there &= low <= limit[:, None]
            row, at = np.nonzero(there)
            d = np.full(leaf.shape, np.inf)
            d[row, at] = _pairs_l2(x, row, self.vectors, leaf[row, at])
        else:
            d = _rows_l2(x, self.vectors, leaf)
        work.floats += int(there.sum())
        best = d.argmin(1)[:, None] if probe == 1 else np.argsort(d, axis=1, kind="stable")[:, :probe]
        return np.where(np.isfinite(np.take_along_axis(d, best, 1)), np.take_along_axis(leaf, best, 1), -1)

    def _span(self, x: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the squared distance of each row and the clusters beside it lies between, by products of 8-bit integers.

        The distance to a copy is off by no more than both copies' errors.
        """
        codes, scale, error, norm, size = self.coded
        step = np.abs(x).max(1, initial=0) / 127
        step[step == 0] = 1
        qc = np.round(x / step[:, None]).astype(np.int16)
        qe = np.sqrt(((x - qc * step[:, None]) ** 2).sum(1))
        product = np.einsum("ijk,ik->ij", codes[leaf].astype(np.int16), qc, dtype=np.int32)
        t, qn = scale[leaf], (qc.astype(np.int32) ** 2).sum(1) * step * step
        near = np.sqrt(np.maximum(qn[:, None] + norm[leaf] * t * t - 2.0 * step[:, None] * t * product, 0))
        slack = qe[:, None] + error[leaf]
        margin = 1e-5 * ((x * x).sum(1)[:, None] + size[leaf])
        return np.maximum(near - slack, 0) ** 2 - margin, (near + slack) ** 2 + margin

    def _open(self, x: np.ndarray, row: np.ndarray, leaf: np.ndarray, probe: int) -> np.ndarray:
        """Which pairs (in order of row) may be among their row's `probe` nearest."""
        low, high = np.empty(len(row)), np.empty(len(row))
        for k, lo, hi in zip(*np.unique(row, return_index=True), [*np.unique(row, return_index=True)[1][1:].tolist(), len(row)], strict=True):
            low[lo:hi], high[lo:hi] = (z[0] for z in self._span(x[k : k + 1], leaf[None, lo:hi]))
        start = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(start, append=len(row))
        limit = high[np.lexsort((high, row))[start + np.minimum(probe, size) - 1]]
        return np.flatnonzero(low <= np.repeat(limit, size))

    def nearest(self, q: np.ndarray, probe: int) -> list[int]:
        """The probe nearest clusters with a beam as wide."""
        return self.search(q, probe, probe)

    def assign(self, q: np.ndarray) -> int:
        """The nearest cluster, or -1."""
        return next(iter(self.nearest(q, 1)), -1)

    def two_stage(self, q: np.ndarray, top: int) -> int:
        """The nearest cluster under the root's `top` nearest children, or -1."""
        q = np.asarray(q, dtype=np.float64)
        if not self.nodes or len(q) != self.dims:
            return -1
        stack = np.array(self.nodes[0].children, dtype=np.int64)
        if len(stack):
            d = _d2(q, np.stack([self.nodes[c].centroid for c in stack]))
            stack = stack[_nearest_first(d, stack, max(top, 1))]
        found, stack = list(self.nodes[0].leaves), stack.tolist()
        while stack:
            n = self.nodes[stack.pop()]
            found += n.leaves
            stack += n.children
        return next(iter(self._rank(q, np.array(found, dtype=np.int64), 1, Work())), -1)

    def quantise(self) -> Tree:
        """With 8-bit copies of the clusters; answers stay the same, fewer float distances are computed."""
        scale = np.abs(self.vectors).max(1, initial=0) / 127
        scale[scale == 0] = 1
        codes = np.round(self.vectors / scale[:, None]).astype(np.int8)
        error = np.sqrt(((self.vectors - codes * scale[:, None]) ** 2).sum(1))
        norm, size = (codes.astype(np.int32) ** 2).sum(1), (self.vectors * self.vectors).sum(1)
        return Tree(self.nodes, self.vectors, self.fanout, (codes, scale, error, norm, size))

    # edits

    def _copy(self) -> Tree:
        return Tree([replace(n, children=list(n.children), leaves=list(n.leaves)) for n in self.nodes], self.vectors.copy(), self.fanout)

    def nearest_holder(self, q: np.ndarray) -> int:
        held = np.array(self._beam(np.asarray(q, dtype=np.float64), max(self.fanout, 2), Work()), dtype=np.int64)
        d = _d2(q, np.stack([self.nodes[n].centroid for n in held]))
        return int(held[_nearest_first(d, held, 1)[0]])

    def upsert(self, k: int, v: np.ndarray) -> Tree:
        """Replace cluster k, or append it if k is the next id; it moves to the nearest holder, which is re-meaned alone."""
        v = np.asarray(v, dtype=np.float64)
        if k < 0 or k > len(self) or (len(self) and len(v) != self.dims) or not np.isfinite(v).all():
            raise ValueError("upsert needs a cluster's id or the next one, and a finite vector of the tree's width")
        if not self.nodes:
            return Tree([Node(v.copy(), leaves=[0])], v[None, :].copy(), self.fanout)
        t = self._copy()
        touched = set()
        if k < len(self):
            old = next(n for n, x in enumerate(t.nodes) if k in x.leaves)
            t.nodes[old].leaves.remove(k)
            touched.add(old)
            t.vectors[k] = v
        else:
            t.vectors = np.concatenate((t.vectors, v[None, :]))
        new = t.nearest_holder(v)
        t.nodes[new].leaves.append(k)
        for n in touched | {new}:
            if t.nodes[n].leaves:
                t.nodes[n].centroid = t.vectors[t.nodes[n].leaves].mean(0)
        return t

    def truncate(self, n: int) -> Tree:
        """Without the clusters from n on; holders may be left empty."""
        t = self._copy()
        for node in t.nodes:
            gone = [k for k in node.leaves if k >= n]
            node.leaves = [k for k in node.leaves if k < n]
            if gone and node.leaves:
                node.centroid = t.vectors[node.leaves].mean(0)
        t.vectors = t.vectors[: max(n, 0)]
        return t

    # tables

    def table(self, spark: SparkSession) -> DataFrame:
        """node_id, parent_id, leaf_id, centroid: a row for each node and each leaf."""
        parent = {c: n for n, x in enumerate(self.nodes) for c in x.children}
        rows = [(n, parent.get(n), None, x.centroid.tolist()) for n, x in enumerate(self.nodes)]
        rows += [(None, n, k, self.vectors[k].tolist()) for n, x in enumerate(self.nodes) for k in x.leaves]
        return spark.createDataFrame(rows, "node_id long, parent_id long, leaf_id long, centroid array<double>")

    @staticmethod
    def from_table(nodes: DataFrame, fanout: int) -> Tree:
        """The tree of a table, whose structure is checked."""
        rows = nodes.collect()
        inner = sorted((r for r in rows if r["node_id"] is not None), key=lambda r: r["node_id"])
        made = [Node(np.array(r["centroid"])) for r in inner]
        for n, r in enumerate(inner):
            if r["node_id"] != n or (n == 0) != (r["parent_id"] is None) or (n and not r["parent_id"] < n):
                raise ValueError("nodes have to be numbered from the root on, children after parents")
            if n:
                made[r["parent_id"]].children.append(n)
        leaves = {r["leaf_id"]: r for r in rows if r["node_id"] is None}
        if sorted(leaves) != list(range(len(leaves))) or len(leaves) + len(inner) != len(rows):
            raise ValueError("every cluster needs one owner")
        for k in sorted(leaves):
            made[leaves[k]["parent_id"]].leaves.append(k)
        if any(n.children and n.leaves for n in made):
            raise ValueError("a node holds nodes or clusters, not both")
        t = Tree(made, np.array([leaves[k]["centroid"] for k in sorted(leaves)]), fanout)
        if t.height > DEEPEST:
            raise ValueError("the tree is too deep")
        return t


#: Bytes of a tree that are broadcast.
BROADCAST = 512 << 20


def route(queries: DataFrame, tree: Tree, probe: int, beam: int | None = None, v: str = "query") -> DataFrame:
    """query_id, place, cluster_id: the tree's clusters for each query, past a broadcast tree.

    A tree of more than BROADCAST bytes goes by joins on its table, level by level.
    """
    if 2 * tree.vectors.nbytes > BROADCAST:
        return beam_search(queries.select("query_id", F.col(v).alias("query")), tree.table(queries.sparkSession), beam or probe, probe, tree.height)
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        t = shared.value
        for b in batches:
            if b.num_rows:
                found = t.search_many(matrix(b[v]), beam or probe, probe)
                row, place = np.nonzero(found >= 0)
                yield pa.record_batch([pa.array(b["query_id"].to_numpy()[row], pa.int64()), pa.array(place + 1, pa.int64()), pa.array(found[row, place])], names=["query_id", "place", "cluster_id"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), v).mapInArrow(run, "query_id long, place long, cluster_id long")


def route_work(queries: DataFrame, tree: Tree, probe: int, beam: int | None = None, v: str = "query") -> DataFrame:
    """query_id, found (the clusters in order), floats and quantised: what routing each query computes, in float and on 8-bit copies."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in batches:
            out = []
            for ident, q in zip(b["query_id"].to_pylist(), matrix(b[v]), strict=True):
                work = Work()
                found = shared.value.search_many(q[None, :], beam or probe, probe, work)[0]
                out.append((ident, found[found >= 0].tolist(), work.floats, work.quantised))
            if out:
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "found", "floats", "quantised"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), v).mapInArrow(run, "query_id long, found array<long>, floats long, quantised long")


def beam_search(queries: DataFrame, nodes: DataFrame, beam: int, probe: int, depth: int) -> DataFrame:
    """query_id, place, cluster_id by joins, level by level; nodes as of Tree.table, depth levels of nodes at most."""
    n = F.broadcast(nodes) if parts_of(nodes, "centroid", BROADCAST) == 1 else nodes
    inner = n.where("node_id is not null").select(F.col("node_id").alias("child_id"), F.col("parent_id").alias("above"), F.col("centroid").alias("_c"))
    leaf = n.where("leaf_id is not null").select(F.col("parent_id").alias("above"), F.col("leaf_id").alias("cluster_id"), F.col("centroid").alias("_c"))
    level = queries.select("query_id", "query").crossJoin(F.broadcast(inner.where("above is null").select(F.col("child_id").alias("node_id"))))
    reached = level
    for _ in range(depth - 1):
        down = level.join(inner, F.col("node_id") == F.col("above")).select("query_id", "query", F.col("child_id").alias("node_id"), l2_sq("query", "_c").alias("d2"))
        w = Window.partitionBy("query_id").orderBy("d2", "node_id")
        level = down.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).select("query_id", "query", "node_id")
        reached = reached.unionByName(level)
    d = reached.join(leaf, F.col("node_id") == F.col("above")).select("query_id", "cluster_id", l2_sq("query", "_c").alias("d2"))
    w = Window.partitionBy("query_id").orderBy("d2", "cluster_id")
    return d.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= probe).select("query_id", "place", "cluster_id")


def two_stage_assign(queries: DataFrame, groups: DataFrame, centroids: DataFrame, top: int) -> DataFrame:
    """query_id, cluster_id, d2: nearest centroid in the `top` nearest groups; groups (group_id, centroid), centroids (cluster_id, group_id, centroid)."""
    return nearest_within(queries, groups, centroids, top, "query", "query_id")


class BlockTree:
    """A tree whose rows are kept in an encoder's form alone, scored by l2; immutable.

    encode: vectors to a block with `scores(query) -> array`, higher is better,
    and `len`.  A score that isn't finite is an error.
    """

    def __init__(self, centroids: np.ndarray, fanout: int, encode):
        plain = Tree.build(centroids, fanout)
        if len(plain) and not plain.dims:
            raise ValueError("vectors without a width")
        self.height, self.dims, self.leaves = plain.height, plain.dims, len(plain)
        self.nodes = []
        for n in plain.nodes:
            rows = plain.vectors[n.leaves] if n.leaves else np.stack([plain.nodes[c].centroid for c in n.children]) if n.children else np.zeros((0, plain.dims))
            block = encode(rows)
            if len(block) != len(rows):
                raise ValueError("the encoder returned another number of rows")
            self.nodes.append((n.children, n.leaves, block))

    def _scores(self, block, q: np.ndarray) -> np.ndarray:
        s = np.asarray(block.scores(q), dtype=np.float64)
        if not np.isfinite(s).all():
            raise ValueError("a score isn't finite")
        return s

    def search(self, q: np.ndarray, beam: int, probe: int) -> list[int]:
        q = np.asarray(q, dtype=np.float64)
        if self.nodes and len(q) != self.dims:
            raise ValueError("a query of another width")
        if not self.nodes or probe <= 0:
            return []
        level, ids, scores = [0], [], []
        while level:
            nodes, s = [], []
            for n in level:
                children, leaves, block = self.nodes[n]
                own = self._scores(block, q) if children or leaves else np.zeros(0)
                if children:
                    nodes += children
                    s += own.tolist()
                else:
                    ids += leaves
                    scores += own.tolist()
            nodes = np.array(nodes, dtype=np.int64)
            level = nodes[_nearest_first(-np.array(s), nodes, max(beam, 1))].tolist() if len(nodes) else []
        ids = np.array(ids, dtype=np.int64)
        return ids[_nearest_first(-np.array(scores), ids, probe)].tolist() if len(ids) else []


def route_blocks(queries: DataFrame, tree: BlockTree, probe: int, beam: int | None = None, v: str = "query") -> DataFrame:
    """query_id, place, cluster_id: as route, past a broadcast block tree; a query of another width is an error."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in batches:
            out = [(i, k + 1, c) for i, q in zip(b["query_id"].to_pylist(), b[v].to_pylist(), strict=True) for k, c in enumerate(shared.value.search(np.array(q), beam or probe, probe))]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "place", "cluster_id"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), v).mapInArrow(run, "query_id long, place long, cluster_id long")


class FloatBlock:
    """Rows as float32."""

    def __init__(self, rows: np.ndarray):
        self.rows = np.asarray(rows, dtype=np.float32)

    def __len__(self) -> int:
        return len(self.rows)

    def scores(self, q: np.ndarray) -> np.ndarray:
        return -_d2(q, self.rows.astype(np.float64))


class CodeBlock:
    """Rows as one-bit codes about their mean."""

    def __init__(self, rows: np.ndarray, seed: int = 1):
        from vectide.operators import rabitq

        self.seed, self.codes = seed, rabitq.encode(rows, seed, dims=rows.shape[1])

    def __len__(self) -> int:
        return len(self.codes)

    def scores(self, q: np.ndarray) -> np.ndarray:
        from vectide.operators import rabitq

        return rabitq.score(self.codes, rabitq.Query(q, "l2", self.seed))[0]
