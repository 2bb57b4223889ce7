"""Reduced precision: half floats, saturated bytes, and affine blocks.

Spark has no half float and no unsigned byte: halves are BINARY (two bytes an
element, little-endian), unsigned bytes are SMALLINT.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import all_finite, dot, norm_sq, parse_metric

HALF_LIMIT = 65520.0  # from here on a half rounds to infinity


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_i8(v: Column | str) -> Column:
    """Nearest bytes, halves away from zero, clamped; NaN becomes 0."""
    return F.transform(_col(v), lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(F.nanvl(x.cast("double"), F.lit(0.0))))).cast("tinyint"))


def decode_i8(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("float"))


def round_i8(v: Column | str) -> Column:
    """What decoding the encoding gives."""
    return decode_i8(encode_i8(v))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of a list column, where each list starts and ends in them, and which lists are null."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.flatten() if not column.null_count else pa.concat_arrays([column.values.slice(offsets[0], offsets[-1] - offsets[0])])
    return flat.to_numpy(zero_copy_only=False), offsets - offsets[0], np.asarray(column.is_null())


def with_f16(df: DataFrame, v: str = "embedding", out: str = "f16") -> DataFrame:
    """df with BINARY halves of v, rounded to nearest even; beyond the range they are infinite."""

    def run(batches):
        for b in batches:
            flat, offsets, null = _lists(b[v])
            with np.errstate(over="ignore"):
                body = flat.astype(np.float32).astype("<f2").tobytes()
            valid = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
            own = pa.Array.from_buffers(pa.binary(), b.num_rows, [valid, pa.py_buffer((2 * offsets).astype(np.int32).tobytes()), pa.py_buffer(body)])
            yield pa.record_batch([*b.columns, own], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` binary")


def from_f16(df: DataFrame, coded: str = "f16", out: str = "decoded") -> DataFrame:
    """df with ARRAY<FLOAT> of the halves."""

    def run(batches):
        for b in batches:
            column = b[coded]
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
            body = np.frombuffer(column.buffers()[2] or b"", dtype="<f2", count=int(offsets[-1] - offsets[0]) // 2, offset=int(offsets[0]))
            ends = ((offsets - offsets[0]) // 2).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(body.astype(np.float32)), mask=column.is_null() if column.null_count else None)
            yield pa.record_batch([*b.columns, own], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<float>")


def half_of(x: Column) -> Column:
    """A finite float32 rounded to the nearest half, ties to even, as an expression; beyond the range infinite."""
    x = x.cast("double")
    ulp = F.pow(F.lit(2.0), F.greatest(F.when(x == 0, -14.0).otherwise(F.floor(F.log2(F.abs(x)))), F.lit(-14.0)) - 10)
    return F.when(F.abs(x) >= HALF_LIMIT, F.signum(x) * float("inf")).otherwise(F.rint(x / ulp) * ulp)


def round_f16(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.asarray(x, dtype=np.float32).astype(np.float16).astype(np.float32)


#: Smallest and largest code of the affine types.
RANGES = {"i8": (-128, 127), "u8": (0, 255)}


def dense_blocks(df: DataFrame, block: str, scalar: str = "i8", v: str = "embedding") -> DataFrame:
    """Codes of one scale and offset for each block: df with scale, offset and codes.

    i8, u8: affine.  f32, f16: the elements themselves as floats, for f16 rounded
    to halves; scale is 1 and offset 0, and an element that a half can't hold
    fails the evaluation.  The block's smallest element is coded as the type's smallest value, the
    largest as the largest; codes are nearest, halves away from zero.  A flat
    block has scale 0 and decodes exactly.  Elements that aren't finite fail the
    evaluation, as do widths that differ within a block.
    """
    if scalar in ("f32", "f16"):
        return _float_blocks(df, block, scalar, v)
    low, high = RANGES[scalar]
    size, least, most = F.size(v), F.array_min(F.transform(v, lambda x: x.cast("double"))), F.array_max(F.transform(v, lambda x: x.cast("double")))
    spans = df.groupBy(block).agg(F.min(least).alias("_lo"), F.max(most).alias("_hi"), F.min(size).alias("_w0"), F.max(size).alias("_w1"), F.bool_and(all_finite(v)).alias("_ok"))
    spans = spans.withColumn("scale", (F.col("_hi") - F.col("_lo")) / float(high - low))
    spans = spans.withColumn("offset", F.when(F.col("scale") == 0, F.col("_lo")).otherwise(F.col("_lo") - F.col("scale") * float(low)))
    good = F.assert_true(F.col("_ok") & (F.col("_w0") == F.col("_w1")), F.lit("a block has elements that aren't finite, or rows of different widths"))
    spans = spans.withColumn("scale", F.when(good.isNull(), F.col("scale"))).drop("_lo", "_hi", "_w0", "_w1", "_ok")
    code = lambda x: F.when(F.col("scale") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round((x.cast("double") - F.col("offset")) / F.col("scale"))))).cast("smallint")
    return df.join(spans, block).withColumn("codes", F.transform(v, code))


def _float_blocks(df: DataFrame, block: str, scalar: str, v: str) -> DataFrame:
    spans = df.groupBy(block).agg(F.min(F.size(v)).alias("_w0"), F.max(F.size(v)).alias("_w1"), F.bool_and(all_finite(v)).alias("_ok"))
    if scalar == "f16":
        held = df.groupBy(block).agg(F.bool_and(~F.exists(v, lambda x: F.abs(x.cast("double")) >= HALF_LIMIT)).alias("_held"))
        spans = spans.join(held, block)
    else:
        spans = spans.withColumn("_held", F.lit(True))
    good = F.assert_true(F.col("_ok") & (F.col("_w0") == F.col("_w1")) & F.col("_held"), F.lit("a block has elements that aren't finite or that overflow, or rows of different widths"))
    spans = spans.select(block, F.when(good.isNull(), 1.0).alias("scale"), F.lit(0.0).alias("offset"))
    return df.join(spans, block).withColumn("codes", F.transform(v, lambda x: (half_of(x) if scalar == "f16" else x).cast("float")))


def dense_decode(codes: Column | str = "codes", scale: Column | str = "scale", offset: Column | str = "offset") -> Column:
    """offset + scale * code, in DOUBLE."""
    s, o = _col(scale), _col(offset)
    return F.transform(_col(codes), lambda c: o + s * c.cast("double"))


def dense_score(metric: str, query: Column | str, decoded: Column | str, row_norm_sq: Column | None = None) -> Column:
    """Score of decoded rows; l2 by |q|^2 + |r|^2 - 2qr, never above 0.  An infinite score fails the evaluation."""
    r = norm_sq(decoded) if row_norm_sq is None else row_norm_sq
    if parse_metric(metric) == "ip":
        s = dot(query, decoded)
    elif metric == "l2":
        s = -F.greatest(norm_sq(query) + r - 2 * dot(query, decoded), F.lit(0.0))
    else:
        q = norm_sq(query)
        s = F.when((q == 0) | (r == 0), F.lit(0.0)).otherwise(dot(query, decoded) / F.sqrt(q * r))
    return F.when(F.assert_true(F.abs(s) != float("inf"), F.lit("infinite score")).isNull(), s)
