"""Byte formats for centroid sets, their deltas and trees; readers check lengths before they allocate."""

from __future__ import annotations

import struct

import numpy as np

#: First bytes of a delta.
MAGIC = b"DCD\x01"
CUT = 1 << 31


def encode_centroids(c: np.ndarray) -> bytes:
    c = np.asarray(c, dtype="<f4")
    return struct.pack("<I", len(c)) + c.tobytes()


def decode_centroids(data: bytes, dims: int) -> np.ndarray:
    """Rows of a set; the width is the reader's to know."""
    if dims <= 0 or len(data) < 4:
        raise ValueError("no width or no header")
    (n,) = struct.unpack_from("<I", data)
    if len(data) != 4 + 4 * dims * n:
        raise ValueError(f"{len(data)} bytes for {n} rows of width {dims}")
    return np.frombuffer(data, dtype="<f4", offset=4).reshape(n, dims).copy()


def encode_delta(entries: list[tuple[int, np.ndarray | None]], dims: int) -> bytes:
    """Entries (slot, vector), or (size, None) to truncate."""
    out = [MAGIC, struct.pack("<II", dims, len(entries))]
    for slot, v in entries:
        if not 0 <= slot < CUT or (v is not None and len(v) != dims):
            raise ValueError("a slot out of range or a vector of another width")
        out.append(struct.pack("<I", slot if v is not None else slot | CUT))
        if v is not None:
            out.append(np.asarray(v, dtype="<f4").tobytes())
    return b"".join(out)


def decode_delta(data: bytes, dims: int) -> list[tuple[int, np.ndarray | None]]:
    if len(data) < 12 or data[:4] != MAGIC:
        raise ValueError("not a delta")
    width, n = struct.unpack_from("<II", data, 4)
    if width not in (0, dims) or (width == 0 and n):
        raise ValueError(f"a delta of width {width}, not {dims}")
    at, out = 12, []
    for _ in range(n):
        if at + 4 > len(data):
            raise ValueError("the delta ends early")
        (slot,) = struct.unpack_from("<I", data, at)
        at += 4
        if slot & CUT:
            out.append((slot ^ CUT, None))
            continue
        if at + 4 * dims > len(data):
            raise ValueError("the delta ends early")
        out.append((slot, np.frombuffer(data, dtype="<f4", count=dims, offset=at).copy()))
        at += 4 * dims
    if at != len(data):
        raise ValueError("bytes after the delta")
    return out


#: First bytes of a tree.
TREE = b"DVT\x01"


def encode_tree(t) -> bytes:
    """Width, fanout, root + 1, height, clusters and nodes; the clusters' vectors; each node's centroid, numbers of children and clusters, and their ids."""
    out = [TREE, struct.pack("<6I", t.dims, t.fanout, int(bool(t.nodes)), t.height, len(t), len(t.nodes)), np.asarray(t.vectors, dtype="<f4").tobytes()]
    for n in t.nodes:
        out += [np.asarray(n.centroid, dtype="<f4").tobytes(), struct.pack("<2I", len(n.children), len(n.leaves)), np.array([*n.children, *n.leaves], dtype="<u4").tobytes()]
    return b"".join(out)


def decode_tree(data: bytes):
    """The tree of these bytes.  Its root is node 0, children come after their parents and have one, every cluster has one owner, no node holds both kinds, and it isn't deeper than DEEPEST."""
    from vectide.operators.router import DEEPEST, Node, Tree

    if len(data) < 28 or data[:4] != TREE:
        raise ValueError("not a tree")
    dims, fanout, root, height, clusters, nodes = struct.unpack_from("<6I", data, 4)
    at = 28
    if root != int(nodes > 0) or (clusters and not dims) or len(data) < at + 4 * dims * clusters + (4 * dims + 8) * nodes:
        raise ValueError("a tree's header doesn't fit its bytes")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * n
        if at + size > len(data):
            raise ValueError("the tree ends early")
        at += size
        return np.frombuffer(data, dtype=kind, count=n, offset=at - size)

    vectors = take("<f4", dims * clusters).reshape(clusters, dims).astype(np.float64)
    made, parent, owner, depth = [], {}, {}, {}
    for n in range(nodes):
        centroid = take("<f4", dims).astype(np.float64)
        kids, own = (int(x) for x in take("<u4", 2))
        children, leaves = take("<u4", kids).tolist(), take("<u4", own).tolist()
        if children and leaves:
            raise ValueError("a node holds nodes or clusters, not both")
        if any(not n < c < nodes or c in parent for c in children) or len(set(children)) < kids or (n and n not in parent):
            raise ValueError("nodes have to be numbered from the root on, children after parents, with one parent each")
        if any(not 0 <= k < clusters or k in owner for k in leaves) or len(set(leaves)) < own:
            raise ValueError("every cluster needs one owner")
        parent |= dict.fromkeys(children, n)
        owner |= dict.fromkeys(leaves, n)
        depth[n] = depth.get(parent.get(n), 0) + 1
        made.append(Node(centroid, children, leaves))
    if len(owner) != clusters or at != len(data) or max(depth.values(), default=0) != height or height > DEEPEST:
        raise ValueError("a cluster without an owner, bytes after the tree, or another height than it says")
    if not (np.isfinite(vectors).all() and all(np.isfinite(n.centroid).all() for n in made)):
        raise ValueError("a vector isn't finite")
    return Tree(made, vectors, fanout)
