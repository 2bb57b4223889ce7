"""Vector functions as Column expressions, and their numpy twins for Arrow batches.

A table of vectors has `vec_id BIGINT, embedding ARRAY<FLOAT>`.  Arithmetic is in
DOUBLE.  Scores are higher-is-better: `l2` is the negated squared distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "ip")


def parse_metric(name: str) -> str:
    """The metric's canonical name; any other name is a ValueError."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known are {', '.join(METRICS)}")
    return name


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product.  Vectors of different widths give NULL."""
    a, b = _col(a), _col(b)
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; of vectors of different widths NULL."""

    def step(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _fold(F.zip_with(_col(a), _col(b), step))


def norm_sq(v: Column | str) -> Column:
    return _fold(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(norm_sq(v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    na, nb = norm_sq(a), norm_sq(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(na * nb))


def normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = _col(v)
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def add(a: Column | str, b: Column | str) -> Column:
    """Element-wise sum in DOUBLE."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") + y.cast("double"))


def scale(v: Column | str, by: Column | float) -> Column:
    factor = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(_col(v), lambda x: x.cast("double") * factor)


def score(metric: str, query: Column | str, v: Column | str) -> Column:
    """Score of v for a query, higher is better.  A vector of another width than the query's fails the evaluation."""
    found = {"l2": lambda a, b: -l2_sq(a, b), "cosine": cosine, "ip": dot}[parse_metric(metric)](query, v)
    return F.when(same_width(query, v).isNull(), found)


def same_width(a: Column | str, b: Column | str) -> Column:
    """NULL, or a failure if both vectors are there and differ in width."""
    a, b = _col(a), _col(b)
    return F.assert_true(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), F.lit("vectors of different widths"))


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))


def non_finite(v: Column | str) -> Column:
    """Position of the first NULL, NaN or infinite element, from 0; -1 without any."""
    marks = F.transform(_col(v), lambda x: _bad(x).cast("int"))
    return (F.array_position(marks, F.lit(1)) - 1).cast("long")


def all_finite(v: Column | str) -> Column:
    return ~F.exists(_col(v), _bad)


def usable(v: Column | str, dims: int) -> Column:
    """Right width, finite elements and a squared norm that float32 can hold."""
    return F.coalesce((F.size(_col(v)) == dims) & all_finite(v) & (norm_sq(v) <= float(np.finfo(np.float32).max)), F.lit(False))


def validated(df: DataFrame, dims: int, v: str = "embedding") -> DataFrame:
    """df whose evaluation fails at the first vector that isn't usable."""
    ok = F.assert_true(usable(v, dims), F.concat(F.lit("bad vector in row "), F.to_json(F.struct(*[c for c in df.columns if c != v]))))
    return df.withColumn(v, F.when(ok.isNull(), F.col(v)))


def float_rows(df: DataFrame, v: str = "embedding", dims: int | None = None) -> DataFrame:
    """Vectors of any scalar type as ARRAY<FLOAT>; with dims, of that width and finite or an error."""
    df = df.withColumn(v, F.transform(v, lambda x: x.cast("float")))
    return validated(df, dims, v) if dims else df


def row_count(df: DataFrame, dims: int, v: str = "embedding") -> int:
    """Number of rows, all of which must have the width; their values aren't read."""
    n, wide = df.agg(F.count("*"), F.sum((F.size(v) == dims).cast("long"))).first()
    if n != (wide or 0):
        raise ValueError(f"{n - (wide or 0)} of {n} rows have another width than {dims}")
    return n


def decode_row(df: DataFrame, row: int, v: str = "embedding", row_id: str = "vec_id") -> list[float]:
    """One row's vector as floats, finite or not; an id that isn't there, or is there twice, is an error."""
    found = df.where(F.col(row_id) == row).select(F.transform(v, lambda x: x.cast("float")).alias("x")).take(2)
    if len(found) != 1:
        raise IndexError(f"{len(found)} rows with the id {row}")
    return found[0]["x"]


def admitted(queries: DataFrame, dims: int, query: str = "query") -> DataFrame:
    """queries whose evaluation fails at one that isn't finite or not of the rows' width."""
    return validated(queries, dims, query)


# numpy twins


def np_scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of rows v for queries q, queries x rows, in float64."""
    q, v = np.atleast_2d(q).astype(np.float64), np.atleast_2d(v).astype(np.float64)
    if parse_metric(metric) == "ip":
        return q @ v.T
    if metric == "l2":
        return -np_l2(q, v)
    a, b = (q * q).sum(1), (v * v).sum(1)
    both = np.sqrt(np.outer(a, b))
    return np.divide(q @ v.T, both, out=np.zeros_like(both), where=both > 0)


def np_l2(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances without cancellation, a block of rows at a time."""
    out = np.empty((len(q), len(v)))
    step = max(1, (1 << 22) // max(1, v.size))
    for lo in range(0, len(q), step):
        d = q[lo : lo + step, None, :] - v[None, :, :]
        out[lo : lo + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def by_batches(f: Callable[[np.ndarray], dict[str, np.ndarray]], v: str) -> Callable:
    """A mapInArrow function that adds f's columns to every row; f gets a batch's vectors as a matrix."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index(v)))
            extra = f(x)
            yield pa.record_batch([*b.columns, *(pa.array(c) for c in extra.values())], names=[*b.schema.names, *extra])

    return run


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal widths as rows of float32; other widths are an error."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype=np.float32)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width, rest = divmod(len(flat), len(column))
    sizes = np.diff(column.offsets.to_numpy())
    if rest or (sizes != width).any() or column.null_count:
        raise ValueError("vectors of different widths")
    return flat.astype(np.float32, copy=False).reshape(len(column), width)
