"""Vector expressions and the codecs of narrow element types. Vectors are arrays of float or double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(v, lambda x: x * by)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double"))


def constant(value: float, dim: int) -> Column:
    return F.array_repeat(F.lit(float(value)), dim)


def half_up(x: Column) -> Column:
    """Round half away from zero, as a long."""
    return F.round(x, 0).cast("long")


def quantize_int8(v: Column) -> Column:
    """struct(q, scale): symmetric, scale = max|v| / 127; a zero vector has scale 0 and q 0."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    q = lambda s: F.transform(v, lambda x: F.when(s == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), half_up(x.cast("double") / s)))).cast("short"))
    return F.get(F.transform(F.array(top / 127.0), lambda s: F.struct(q(s).alias("q"), s.alias("scale"))), F.lit(0))


def quantize_uint8(v: Column) -> Column:
    """struct(q, scale, offset): affine, scale = (max - min) / 255, offset = min."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    one = lambda x, p: F.when(p["scale"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), half_up((x.cast("double") - p["offset"]) / p["scale"])))).cast("short")
    pair = F.struct(((hi - lo) / 255.0).alias("scale"), lo.alias("offset"))
    return F.get(F.transform(F.array(pair), lambda p: F.struct(F.transform(v, lambda x: one(x, p)).alias("q"), p["scale"].alias("scale"), p["offset"].alias("offset"))), F.lit(0))


def dequantize(row: Column, affine: bool) -> Column:
    return F.transform(row["q"], lambda x: x * row["scale"] + (row["offset"] if affine else F.lit(0.0)))


def _through(kind: str):
    """numpy round trips of the narrow float types: values rounded to nearest even."""
    if kind == "float16":
        return lambda x: x.astype(np.float16).astype(np.float32)
    if kind == "bfloat16":
        return lambda x: bfloat_decode(bfloat_encode(x))
    bits, bias = {"e4m3": (3, 7), "e5m2": (2, 15)}[kind]
    return lambda x: float8_round(x, bits, bias, kind == "e4m3")


def bfloat_encode(x: np.ndarray) -> np.ndarray:
    b = x.astype(np.float32).view(np.uint32)
    up = ((b >> np.uint32(16)) & np.uint32(1)) + np.uint32(0x7FFF)
    return np.where(np.isnan(x), 0x7FC0, (b + up) >> np.uint32(16)).astype(np.uint16)


def bfloat_decode(b: np.ndarray) -> np.ndarray:
    return (b.astype(np.uint32) << np.uint32(16)).view(np.float32)


def float8_round(x: np.ndarray, bits: int, bias: int, finite: bool) -> np.ndarray:
    """To the nearest value of an 8-bit float with so many fraction bits; too large values saturate if the type is finite."""
    x = x.astype(np.float64)
    exponent = np.maximum(np.floor(np.log2(np.maximum(np.abs(x), 1e-300))), 1 - bias)
    step = 2.0 ** (exponent - bits)
    out = np.rint(x / step) * step
    top = 448.0 if finite else 57344.0
    over = np.abs(out) > top
    return np.where(over, np.sign(x) * (top if finite else np.inf), out).astype(np.float32)


def through(v: Column, kind: str) -> Column:
    """A vector's values as a narrow float type (float16, bfloat16, e4m3, e5m2) holds them."""
    fn = _through(kind)

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()  # of all rows at once
        values = pa.array(fn(flat.fill_null(0).to_numpy(zero_copy_only=False)), pa.float32(), mask=flat.is_null().to_numpy(zero_copy_only=False))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())

    return run(v.cast("array<float>"))


def decode_float16(bits: Column) -> Column:
    """An IEEE half from its 16 bits (0..65535), by arithmetic; infinities and NaN as such."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    e, m = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    return F.when(e == 31, F.when(m == 0, sign * float("inf")).otherwise(float("nan"))).when(e == 0, sign * m * 2.0**-24).otherwise(sign * (1 + m / 1024.0) * F.pow(F.lit(2.0), e - 15))
