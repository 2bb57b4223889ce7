"""One-bit and extended codes of rotated residuals, with an error bound (arXiv:2405.12497, arXiv:2409.09913).

A row o of a cluster with mean c is coded as the signs of x = R(o - c)/|o - c|.
`norm` = |o - c| and `align` = <signs/sqrt(D), x> make inner products with any
query estimable; the estimate's spread bounds the score from above.  Codes are
made cluster by cluster and scored in Arrow batches; arithmetic is in float64.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import matrix

# fixed values of the codes
QUERY_LEVELS = 15  # of a query quantised for one cluster (4 bits)
GLOBAL_LEVELS = 255  # of one quantised for all (8 bits)
SIGMAS = 2.5
MAX_EX_BITS = 6
ROUNDS = 3
ZERO_ROW = -1.0  # align of a zero row in a cosine column
METRICS = ("l2", "cosine")


def seed_of(*parts: str) -> int:
    """FNV-1a-64 of the parts joined by "/", never 0."""
    h = 0xCBF29CE484222325
    for byte in "/".join(parts).encode():
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return h or 0x100000001B3


class Rotation:
    """A seeded orthogonal map: rounds of signs, a permutation and Walsh-Hadamard transforms of the blocks of the width's binary digits."""

    def __init__(self, seed: int, dims: int):
        self.seed, self.dims = seed, dims
        rng = np.random.default_rng(seed)
        self.blocks = []
        rest = dims
        while rest > 0:
            self.blocks.append(1 << (rest.bit_length() - 1))
            rest -= self.blocks[-1]
        self.rounds = [] if dims <= 1 else [(rng.permutation(dims), rng.choice([-1.0, 1.0], dims)) for _ in range(ROUNDS)]

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        at = 0
        for size in self.blocks:
            y = x[:, at : at + size]
            h = 1
            while h < size:
                y = y.reshape(len(x), size // (2 * h), 2, h)
                y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), size)
                h *= 2
            x[:, at : at + size] = y / np.sqrt(size)
            at += size
        return x

    def apply(self, v: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(v, dtype=np.float64))
        for order, sign in self.rounds:
            x = self._hadamard(x[:, order] * sign)
        return x.reshape(np.shape(v))

    def undo(self, v: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(v, dtype=np.float64)).copy()
        for order, sign in reversed(self.rounds):
            y = self._hadamard(x) * sign
            x = np.empty_like(y)
            x[:, order] = y
        return x.reshape(np.shape(v))


@lru_cache(maxsize=64)
def rotation(seed: int, dims: int) -> Rotation:
    return Rotation(seed, dims)


def check_frame(metric: str, dims: int, seed: int, ex_bits: int) -> None:
    """Codes are for l2 and cosine, have a seed and up to 6 extended bits."""
    if metric not in METRICS:
        raise ValueError(f"codes are for l2 and cosine, not {metric!r}")
    if dims <= 0 or seed == 0 or not 0 <= ex_bits <= MAX_EX_BITS:
        raise ValueError("codes need a width, a seed other than 0, and 0 to 6 extended bits")


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length, zero rows as they are, and which rows are zero."""
    x = np.asarray(x, dtype=np.float64)
    n = np.sqrt((x * x).sum(-1))
    return np.divide(x, n[..., None], out=np.zeros_like(x), where=n[..., None] > 0), n == 0


def _levels(x: np.ndarray, bits: int, t: float) -> np.ndarray:
    """floor(t |x| / |row|), at most 2^bits - 1."""
    n = np.sqrt((x * x).sum(1))
    return np.minimum(t * np.abs(x) / np.where(n == 0, 1, n)[:, None], (1 << bits) - 1).astype(np.int64)


@lru_cache(maxsize=64)
def ex_scale(dims: int, bits: int) -> float:
    """The scale, of 400 tried, whose codes lie closest to Gaussian rows."""
    x = np.random.default_rng((7, dims, bits)).standard_normal((64, dims))
    n = np.sqrt((x * x).sum(1))
    best, at = -1.0, 1.0
    for k in range(1, 401):
        t = k * (1 << bits) * np.sqrt(dims) / 400
        y = _levels(x, bits, t) + 0.5
        close = float(((np.abs(x) * y).sum(1) / (n * np.sqrt((y * y).sum(1)))).sum())
        if close > best:
            best, at = close, t
    return at


@dataclass
class Codes:
    """A cluster's code column: one frame and a row of each array for each vector."""

    centroid: np.ndarray
    seed: int
    metric: str
    ex_bits: int
    signs: np.ndarray  # rows x dims of 0/1
    norm: np.ndarray
    align: np.ndarray
    ex: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # rows x dims, signed half-levels
    ex_norm: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ex_align: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def dims(self) -> int:
        return len(self.centroid)

    def __len__(self) -> int:
        return len(self.norm)

    def select(self, rows) -> Codes:
        """The rows at these places, in this order, some perhaps again."""
        at = np.asarray(rows, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self)):
            raise IndexError("no such row")
        return Codes(self.centroid, self.seed, self.metric, self.ex_bits, self.signs[at], self.norm[at], self.align[at], *((self.ex[at], self.ex_norm[at], self.ex_align[at]) if self.ex_bits else (self.ex, self.ex_norm, self.ex_align)))

    def append(self, x: np.ndarray) -> Codes:
        """More rows, coded in this column's own frame."""
        new = encode_in(x, self.centroid, self.seed, self.metric, self.ex_bits)
        join = lambda a, b: np.concatenate((a, b)) if len(a) else b
        return Codes(self.centroid, self.seed, self.metric, self.ex_bits, join(self.signs, new.signs), join(self.norm, new.norm), join(self.align, new.align), join(self.ex, new.ex), join(self.ex_norm, new.ex_norm), join(self.ex_align, new.ex_align))

    def packed(self) -> np.ndarray:
        """Signs as 64-bit words, bit j % 64 of word j // 64."""
        wide = np.zeros((len(self), -(-self.dims // 64) * 64), dtype=np.uint8)
        wide[:, : self.dims] = self.signs
        return np.packbits(wide, axis=1, bitorder="little").view("<i8")


def encode_in(x: np.ndarray, centroid: np.ndarray, seed: int, metric: str = "l2", ex_bits: int = 0) -> Codes:
    """Codes of rows in a given frame; a cosine column's rows are taken at unit length."""
    dims = len(centroid)
    check_frame(metric, dims, seed, ex_bits)
    x = np.asarray(x, dtype=np.float64).reshape(-1, dims)
    zero = np.zeros(len(x), dtype=bool)
    if metric == "cosine":
        x, zero = unit_rows(x)
    r = x - centroid
    norm = np.sqrt((r * r).sum(1))
    u = rotation(seed, dims).apply(np.divide(r, norm[:, None], out=np.zeros_like(r), where=norm[:, None] > 0))
    live = (norm > 0) & ~zero
    signs = ((u >= 0) & live[:, None]).astype(np.uint8)
    align = np.where(live, np.abs(u).sum(1) / np.sqrt(dims), 0.0)
    align[zero] = ZERO_ROW
    out = Codes(np.asarray(centroid, dtype=np.float64), seed, metric, ex_bits, signs, np.where(zero, 0.0, norm), align)
    if ex_bits:
        y = np.where(u >= 0, 1.0, -1.0) * (_levels(u, ex_bits, ex_scale(dims, ex_bits)) + 0.5)
        y[~live] = 0
        n = np.sqrt((y * y).sum(1))
        out.ex, out.ex_norm = y, n
        out.ex_align = np.where(live, np.minimum(1, (y * u).sum(1) / np.where(n == 0, 1, n)), 0.0)
    return out


def encode(x: np.ndarray, seed: int, metric: str = "l2", ex_bits: int = 0, dims: int | None = None) -> Codes:
    """Codes of a cluster about its own mean; without rows an empty column of the given width."""
    x = np.asarray(x, dtype=np.float64)
    if not len(x):
        return encode_in(np.zeros((0, dims or 1)), np.zeros(dims or 1), seed, metric, ex_bits)
    if metric == "cosine":
        own, zero = unit_rows(x)
        mean = own[~zero].mean(0) if (~zero).any() else np.zeros(x.shape[1])
    else:
        mean = x.mean(0)
    return encode_in(x, mean, seed, metric, ex_bits)


@dataclass
class Query:
    """A prepared query.  exact: every bound is infinite, so nothing is pruned.  sigmas: width of the bound; 0 is the default.  sure: bounds that no score exceeds, instead of likely ones."""

    vector: np.ndarray
    metric: str = "l2"
    seed: int = 0
    exact: bool = False
    sigmas: float = 0.0
    shared: bool = False  # quantise once, with 8 bits, for all clusters
    sure: bool = False
    _turned: np.ndarray | None = None
    _global: tuple | None = None

    def turned(self) -> np.ndarray:
        """The rotated query, once: R(q - c) = Rq - Rc."""
        if self._turned is None:
            v = np.asarray(self.vector, dtype=np.float64)
            self._turned = rotation(self.seed, len(v)).apply(unit_rows(v)[0] if self.metric == "cosine" else v)
        return self._turned

    def quantised(self) -> tuple[np.ndarray, float]:
        if self._global is None:
            self._global = quantise(self.turned(), GLOBAL_LEVELS)
        return self._global


def quantise(u: np.ndarray, levels: int) -> tuple[np.ndarray, float]:
    """u on a uniform grid over its own range, nearest, ties up; and the squared rounding residual."""
    lo, hi = float(u.min()), float(u.max())
    step = (hi - lo) / levels
    q = lo + step * np.floor((u - lo) / step + 0.5) if step > 0 else np.full(len(u), lo)
    return q, float(((q - u) ** 2).sum())


def _next_up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


class Scoring:
    """Estimates of all rows of a column for a query; bounds only for the rows that are asked for.

    l2: the negated squared distance; cosine: the similarity.  Where query and
    column don't fit (metric, width, seed) scores are 0 and bounds infinite, so
    that nothing is pruned.  bounded counts the rows whose bounds were computed.
    """

    def __init__(self, codes: Codes, q: Query):
        n, self.codes, self.q, self.bounded = len(codes), codes, q, 0
        self.fits = q.metric == codes.metric and len(q.vector) == codes.dims and q.seed == codes.seed
        self.flat = self.fits and q.metric == "cosine" and not np.any(q.vector)
        if not self.fits or self.flat:
            self.estimate = np.zeros(n)
            return
        dims, self.eps = codes.dims, q.sigmas or SIGMAS
        center = rotation(codes.seed, dims).apply(codes.centroid)
        r = q.turned() - center
        self.turned, self.qn = r, (qn := float(np.sqrt((r * r).sum())))
        self.zero = codes.align == ZERO_ROW
        self.align = np.where(self.zero, 1, codes.ex_align if codes.ex_bits else codes.align)
        self.live = (codes.norm > 0) & ~self.zero & (qn > 0) & (self.align > 0)
        if qn > 0:
            if q.shared:
                g, resid = q.quantised()
                u, self.spread = (g - center) / qn, resid / (qn * qn * dims)
            else:
                u, resid = quantise(r / qn, QUERY_LEVELS)
                self.spread = resid / dims
        else:
            u, self.spread = np.zeros(dims), 0.0
        if codes.ex_bits:
            raw = np.divide(codes.ex @ u, codes.ex_norm, out=np.zeros(n), where=codes.ex_norm > 0)
        else:
            raw = (2 * (codes.signs @ u) - u.sum()) / np.sqrt(dims)
        self.ip = np.divide(raw, self.align, out=np.zeros(n), where=self.live)
        norm = codes.norm
        d2 = np.maximum(norm**2 + qn**2 - 2 * norm * qn * self.ip, (norm - qn) ** 2)
        d2[~self.live] = (norm**2 + qn**2)[~self.live]
        est = -d2 if codes.metric == "l2" else np.clip(1 - d2 / 2, -1, 1)
        self.estimate = np.where(self.zero, 0.0, est)

    def bound(self, rows=slice(None)) -> np.ndarray:
        """Upper bounds of the exact scores of these rows."""
        norm, n = self.codes.norm[rows], len(self.codes.norm[rows])
        if self.q.exact or not self.fits:
            return np.full(n, np.inf)
        if self.flat:
            return np.zeros(n)
        self.bounded += n
        if self.q.sure:
            low = self._least(rows)
            return np.where(self.zero[rows], 0.0, -low if self.codes.metric == "l2" else np.clip(1 - low / 2, -1, 1))
        align, live, ip, zero, qn = self.align[rows], self.live[rows], self.ip[rows], self.zero[rows], self.qn
        off = np.maximum(1 - align**2, 0) / max(self.codes.dims - 1, 1)
        sigma = np.divide(np.sqrt(off + self.spread), align, out=np.zeros(n), where=live)
        near = np.abs(ip) - self.eps * sigma
        tight = np.where(near > 0, np.maximum(1 - near**2, 0), 1)
        sigma = np.divide(np.sqrt(off * tight + self.spread), align, out=np.zeros(n), where=live)
        low = np.maximum(norm**2 + qn**2 - 2 * norm * qn * ip - 2 * norm * qn * self.eps * sigma, (norm - qn) ** 2)
        low[~live] = (norm**2 + qn**2)[~live]
        top = _next_up(-low) if self.codes.metric == "l2" else _next_up(np.clip(1 - low / 2, -1, 1))
        return np.where(zero, 0.0, top)

    def _least(self, rows) -> np.ndarray:
        """What no squared distance of these rows is below.

        The row's direction makes the angle arccos(align) with its code, and the
        query's (not its levels) arccos(p), so that they differ by the difference
        of the two at least.
        """
        codes, qn = self.codes, self.qn
        norm, align = codes.norm[rows], np.clip((codes.ex_align if codes.ex_bits else codes.align)[rows], 0, 1)
        t = self.turned / qn if qn > 0 else self.turned
        if codes.ex_bits:
            p = np.divide(codes.ex[rows] @ t, codes.ex_norm[rows], out=np.zeros(len(norm)), where=codes.ex_norm[rows] > 0)
        else:
            p = (2 * (codes.signs[rows] @ t) - t.sum()) / np.sqrt(codes.dims)
        near = align * p + np.sqrt((1 - align**2) * np.maximum(1 - p**2, 0))
        squares = norm**2 + qn**2
        return np.maximum(squares - 2 * norm * qn * near, (norm - qn) ** 2) - 1e-9 * squares

    def reach(self) -> np.ndarray | float:
        """What a bound exceeds its estimate by at most, from the column's largest norm and smallest align."""
        top, worst = bound_hint(self.codes)
        sigma = np.sqrt(max(1 - worst**2, 0) / max(self.codes.dims - 1, 1) + self.spread) / max(worst, 1e-9)
        wide = 2 * top * self.qn * self.eps * sigma
        return (wide if self.codes.metric == "l2" else wide / 2) * (1 + 1e-9) + 1e-9


def score(codes: Codes, q: Query) -> tuple[np.ndarray, np.ndarray]:
    """Estimated scores of all rows, higher is better, and upper bounds of their exact scores."""
    own = Scoring(codes, q)
    return own.estimate, own.bound()


def bound_hint(codes: Codes) -> tuple[float, float]:
    """Largest norm and smallest positive align of the rows that have a direction."""
    ok = (codes.norm > 0) & (codes.align > 0)
    return float(codes.norm.max(initial=0)), float((codes.ex_align if codes.ex_bits else codes.align)[ok].min(initial=1))


def may_reach(codes: Codes, q: Query, cutoff: float, work: Scoring | None = None) -> np.ndarray:
    """Rows whose bound is not below the cutoff: the column's envelope first, bounds only of the rows that it lets through."""
    own = work or Scoring(codes, q)
    if q.exact or not own.fits:
        return np.ones(len(codes), dtype=bool)
    if own.flat:
        return np.full(len(codes), cutoff <= 0)
    if q.sure:
        return own.bound() >= cutoff
    out = np.zeros(len(codes), dtype=bool)
    at = np.flatnonzero((own.estimate + own.reach() >= cutoff) | own.zero)
    if len(at):
        out[at] = own.bound(at) >= cutoff
    return out


def planes_of(asked: DataFrame, frames: DataFrame) -> DataFrame:
    """query_id, cluster_id, planes, low, step: each query (query_id, query, cluster_id) quantised in the frame of a cluster, as the bit planes of its levels.

    The query's rotated residual is low + step * level; plane p holds bit p of
    the levels, packed as the signs of codes are.
    """

    def run(batches):
        for b in batches:
            out = []
            for query, cluster, v, c, seed, metric in zip(*(b[n].to_pylist() for n in ("query_id", "cluster_id", "query", "centroid", "seed", "metric")), strict=True):
                q = Query(np.array(v), metric, seed % (1 << 64))
                u = q.turned() - rotation(q.seed, len(c)).apply(np.array(c))
                n = float(np.sqrt((u * u).sum()))
                u = u / n if n > 0 else u
                low, step = float(u.min()), (float(u.max()) - float(u.min())) / QUERY_LEVELS
                level = np.floor((u - low) / step + 0.5).astype(np.uint8) if step > 0 else np.zeros(len(u), dtype=np.uint8)
                wide = np.zeros((4, -(-len(u) // 64) * 64), dtype=np.uint8)
                wide[:, : len(u)] = (level >> np.arange(4, dtype=np.uint8)[:, None]) & 1
                out.append((query, cluster, np.packbits(wide, axis=1, bitorder="little").view("<i8").tolist(), low, step))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "cluster_id", "planes", "low", "step"])

    own = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("cluster_id").cast("long").alias("cluster_id"), "query").join(frames, "cluster_id")
    return own.select("query_id", "cluster_id", "query", "centroid", "seed", "metric").mapInArrow(run, "query_id long, cluster_id long, planes array<array<long>>, low double, step double")


def bit_product(bits: Column | str = "bits", planes: Column | str = "planes") -> Column:
    """The sum of the levels where a code's signs are 1, by counting bits: 2^p * bit_count(word & plane) over words and planes."""
    bits, planes = (F.col(c) if isinstance(c, str) else c for c in (bits, planes))
    ones = lambda plane: F.aggregate(F.zip_with(bits, plane, lambda w, x: F.bit_count(w.bitwiseAND(x))), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    weighted = F.transform(planes, lambda plane, p: ones(plane) * F.pow(F.lit(2), p).cast("long"))
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, n: a + n)


CODES = "cluster_id long, vec_id long, bits array<long>, norm double, align double, ex array<byte>, ex_norm double, ex_align double"
FRAMES = "cluster_id long, centroid array<double>, seed long, metric string, ex_bits int"


def signed(seed: int) -> int:
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def frames_of(rows: DataFrame, seed: int, metric: str = "l2", ex_bits: int = 0, by: str = "cluster_id", v: str = "embedding") -> DataFrame:
    """A frame for each cluster about its mean (of unit rows for cosine), by partial sums: no cluster is gathered."""
    from vectide.functions.vectors import norm, normalize
    from vectide.operators.assign import centroids_of

    own = rows.where(norm(v) > 0).withColumn(v, normalize(v)) if metric == "cosine" else rows
    return centroids_of(own, by, v).select(F.col(by).alias("cluster_id"), "centroid", F.lit(signed(seed)).alias("seed"), F.lit(metric).alias("metric"), F.lit(ex_bits).alias("ex_bits"))


def codes_of(rows: DataFrame, frames: DataFrame, by: str = "cluster_id", v: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """A code for each row in its cluster's frame: a join with the frames and one Arrow pass, no gathering by cluster."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, c = matrix(b["x"]), matrix64(b["centroid"])
            cluster, parts = b["cluster_id"].to_numpy(), []
            order = np.argsort(cluster, kind="stable")
            cuts = np.flatnonzero(np.diff(cluster[order])) + 1
            for at in np.split(order, cuts):
                seed = b["seed"][int(at[0])].as_py() % (1 << 64)
                parts.append((at, encode_in(x[at], c[at[0]], seed, b["metric"][int(at[0])].as_py(), b["ex_bits"][int(at[0])].as_py())))
            back = np.argsort(np.concatenate([at for at, _ in parts]), kind="stable")
            put = lambda f: [y for _, k in parts for y in f(k)]
            pick = lambda items: [items[k] for k in back]
            yield pa.record_batch(
                [
                    b["cluster_id"],
                    b["vec_id"],
                    pa.array(pick(put(lambda k: k.packed().tolist())), pa.list_(pa.int64())),
                    pa.array(pick(put(lambda k: k.norm.tolist())), pa.float64()),
                    pa.array(pick(put(lambda k: k.align.tolist())), pa.float64()),
                    pa.array(pick(put(lambda k: np.floor(k.ex).astype(np.int8).tolist() if k.ex_bits else [[]] * len(k))), pa.list_(pa.int8())),
                    pa.array(pick(put(lambda k: k.ex_norm.tolist() if k.ex_bits else [0.0] * len(k))), pa.float64()),
                    pa.array(pick(put(lambda k: k.ex_align.tolist() if k.ex_bits else [0.0] * len(k))), pa.float64()),
                ],
                names=["cluster_id", "vec_id", "bits", "norm", "align", "ex", "ex_norm", "ex_align"],
            )

    own = rows.select(F.col(by).cast("long").alias("cluster_id"), F.col(row_id).cast("long").alias("vec_id"), F.col(v).alias("x"))
    return own.join(frames, "cluster_id").select("cluster_id", "vec_id", "x", "centroid", "seed", "metric", "ex_bits").mapInArrow(run, CODES)


def append_codes(codes: DataFrame, rows: DataFrame, frames: DataFrame, by: str = "cluster_id", v: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """codes and those of more rows, in the frames that are there: no row of theirs is coded again.  Rows of a cluster without a frame are left out."""
    return codes.unionByName(codes_of(rows, frames, by, v, row_id))


def check(c: Codes) -> Codes:
    """The codes, if an encoder can have made them.

    Norms are finite and not negative; align is -1 (a zero row of a cosine
    column), 0 just where the norm is 0, or from 0.999/sqrt(dims) to 1; extended
    levels are of ex_bits bits and have the signs, their norm is theirs, and
    their align is from 0 to 1.
    """
    zero = (c.norm == 0) & ((c.align == 0) | ((c.align == ZERO_ROW) & (c.metric == "cosine")))
    live = (c.norm > 0) & (c.align >= 0.999 / np.sqrt(c.dims)) & (c.align <= 1 + 1e-9)
    ok = np.isfinite(c.centroid).all() and bool((np.isfinite(c.norm) & (zero | live)).all()) and not c.signs[c.norm == 0].any()
    if ok and c.ex_bits and len(c):
        y, some = c.ex, c.norm > 0
        n = np.sqrt((y * y).sum(1))
        ok = c.ex.shape == c.signs.shape and bool((np.abs(y) <= (1 << c.ex_bits) - 0.5).all() and ((y > 0) == (c.signs > 0))[some].all())
        ok = ok and bool((np.abs(c.ex_norm - np.where(some, n, 0)) <= 1e-6 * (1 + n)).all() and (c.ex_align >= 0).all() and (c.ex_align <= 1 + 1e-9).all())
    if not ok:
        raise ValueError("a code that no encoder makes")
    return c


#: First bytes of a code column.
COLUMN = b"VQC\x01"


def encode_column(c: Codes) -> bytes:
    """Metric, extended bits, width, rows and seed; centroid, norms, aligns, words of signs; with extended bits levels, their norms and aligns."""
    out = [COLUMN, struct.pack("<BBIIQ", METRICS.index(c.metric), c.ex_bits, c.dims, len(c), c.seed), *(np.asarray(x, dtype="<f8").tobytes() for x in (c.centroid, c.norm, c.align)), c.packed().tobytes()]
    if c.ex_bits:
        out += [np.floor(c.ex).astype(np.int8).tobytes(), *(np.asarray(x, dtype="<f8").tobytes() for x in (c.ex_norm, c.ex_align))]
    return b"".join(out)


def decode_column(data: bytes) -> Codes:
    """The codes of these bytes; what no encoder writes is an error."""
    if len(data) < 22 or data[:4] != COLUMN:
        raise ValueError("not a code column")
    metric, ex_bits, dims, rows, seed = struct.unpack_from("<BBIIQ", data, 4)
    if metric >= len(METRICS):
        raise ValueError("no such metric")
    check_frame(METRICS[metric], dims, seed, ex_bits)
    words = -(-dims // 64)
    if len(data) != 22 + 8 * dims + rows * (16 + 8 * words) + (rows * (dims + 16) if ex_bits else 0):
        raise ValueError(f"{len(data)} bytes for {rows} rows of width {dims}")
    at = 22

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        at += np.dtype(kind).itemsize * n
        return np.frombuffer(data, dtype=kind, count=n, offset=at - np.dtype(kind).itemsize * n)

    centroid, norm, align = take("<f8", dims), take("<f8", rows), take("<f8", rows)
    signs = _unpacked(take("<i8", rows * words).reshape(rows, words), dims)
    own = Codes(centroid, seed, METRICS[metric], ex_bits, signs, norm, align)
    if ex_bits:
        own.ex, own.ex_norm, own.ex_align = take("i1", rows * dims).reshape(rows, dims) + 0.5, take("<f8", rows), take("<f8", rows)
    return check(own)


def _unpacked(words: np.ndarray, dims: int) -> np.ndarray:
    """Signs of rows of 64-bit words; bits beyond the last dimension have to be 0."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little") if words.size else np.zeros((len(words), dims), dtype=np.uint8)
    if bits[:, dims:].any():
        raise ValueError("bits beyond a code's last dimension")
    return bits[:, :dims]


def bytes_of(codes: DataFrame, frames: DataFrame) -> DataFrame:
    """cluster_id, ids and body: every cluster's codes, in order of id, as one column's bytes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        f = {n: t[n][0].as_py() for n in ("centroid", "seed", "metric", "ex_bits")}
        body = encode_column(read_codes(t, np.array(f["centroid"]), f["seed"] % (1 << 64), f["metric"], f["ex_bits"]))
        return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([t["vec_id"].to_pylist()], pa.list_(pa.int64())), "body": pa.array([body], pa.binary())})

    return codes.join(frames, "cluster_id").groupBy("cluster_id").applyInArrow(run, "cluster_id long, ids array<long>, body binary")


def codes_from_bytes(columns: DataFrame, frames: DataFrame) -> DataFrame:
    """The codes of columns as of bytes_of; bytes of another frame than the cluster's are an error."""

    def run(batches):
        for b in batches:
            for cluster, ids, body, centroid, seed in zip(*(b[c].to_pylist() for c in ("cluster_id", "ids", "body", "centroid", "seed")), strict=True):
                own = decode_column(body)
                if own.seed != seed % (1 << 64) or len(own) != len(ids) or not np.array_equal(own.centroid, np.array(centroid)):
                    raise ValueError("a column of another frame")
                n = len(ids)
                yield _batch([cluster] * n, ids, own)

    return columns.join(frames, "cluster_id").select("cluster_id", "ids", "body", "centroid", "seed").mapInArrow(run, CODES)


def _batch(clusters: list[int], ids: list[int], c: Codes) -> pa.RecordBatch:
    n = len(c)
    ex = np.floor(c.ex).astype(np.int8).tolist() if c.ex_bits else [[]] * n
    zero = np.zeros(n)
    return pa.record_batch(
        [pa.array(clusters, pa.int64()), pa.array(ids, pa.int64()), pa.array(c.packed().tolist(), pa.list_(pa.int64())), pa.array(c.norm), pa.array(c.align), pa.array(ex, pa.list_(pa.int8())), pa.array(c.ex_norm if c.ex_bits else zero), pa.array(c.ex_align if c.ex_bits else zero)],
        names=["cluster_id", "vec_id", "bits", "norm", "align", "ex", "ex_norm", "ex_align"],
    )


def matrix64(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def read_codes(batch, centroid: np.ndarray, seed: int, metric: str, ex_bits: int) -> Codes:
    """Codes of a batch with the columns of `codes_of`, all of one cluster; what no encoder makes is an error."""
    dims = len(centroid)
    words = np.array(batch["bits"].to_pylist(), dtype="<i8").reshape(batch.num_rows, -1)
    if words.shape[1] != -(-dims // 64):
        raise ValueError("a code of another width")
    num = lambda c: batch[c].to_numpy()
    ex = np.array(batch["ex"].to_pylist(), dtype=float).reshape(batch.num_rows, -1) + 0.5 if ex_bits else np.zeros((0, 0))
    return check(Codes(np.asarray(centroid, dtype=np.float64), seed, metric, ex_bits, _unpacked(words, dims), num("norm"), num("align"), ex, num("ex_norm"), num("ex_align")))


def checked_codes(codes: DataFrame, frames: DataFrame) -> DataFrame:
    """codes whose evaluation fails at the first one that no encoder makes.

    Norms are finite and not negative; align is -1 (a zero row of a cosine
    column), 0 just where the norm is 0, or from 0.999/sqrt(dims) to 1; there is a
    word for every 64 dimensions, and bits beyond the last dimension are 0.
    Extended levels are as many as dimensions, of ex_bits bits, and their align
    is from 0 to 1.
    """
    f = frames.select("cluster_id", F.size("centroid").alias("_dims"), F.col("metric").alias("_metric"), F.col("ex_bits").alias("_ex"))
    words = F.ceil(F.col("_dims") / 64).cast("int")
    tail = F.col("_dims") % 64
    spare = F.when(tail == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(element_at(bits, -1), cast(_dims % 64 as int))"))
    finite = (F.col("norm") >= 0) & (F.col("norm") < float("inf"))
    aligned = ((F.col("norm") == 0) & ((F.col("align") == 0) | ((F.col("align") == ZERO_ROW) & (F.col("_metric") == "cosine")))) | ((F.col("norm") > 0) & (F.col("align") >= 0.999 / F.sqrt("_dims")) & (F.col("align") <= 1 + 1e-9))
    top = F.pow(F.lit(2), F.col("_ex"))
    extended = (F.size("ex") == F.col("_dims")) & F.forall("ex", lambda y: (y >= -top) & (y < top)) & (F.col("ex_norm") >= 0) & (F.col("ex_norm") < float("inf")) & (F.col("ex_align") >= 0) & (F.col("ex_align") <= 1 + 1e-9)
    ok = F.coalesce((F.size("bits") == words) & (spare == 0) & finite & aligned & ((F.col("_ex") == 0) | extended), F.lit(False))
    tested = codes.join(f, "cluster_id").withColumn("norm", F.when(F.assert_true(ok, F.lit("a code that no encoder makes")).isNull(), F.col("norm")))
    return tested.select(codes.columns)


def retained_bytes(codes: DataFrame) -> DataFrame:
    """One row, `bytes`: what the codes hold."""
    return codes.agg(F.sum(8 * F.size("bits") + F.size("ex") + F.lit(16)).alias("bytes"))
