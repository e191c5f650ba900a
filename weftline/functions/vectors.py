"""Vector expressions and codecs."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    from weftline.functions.text import let

    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def half_bits(values: np.ndarray) -> np.ndarray:
    """IEEE half-precision bits with the mantissa cut off, not rounded.

    Overflow gives infinity, NaN keeps one mantissa bit, values below the denormal range give signed zero.
    """
    bits = np.ascontiguousarray(values, dtype="<f4").view("<u4").astype(np.int64)
    sign = (bits >> 31) << 15
    exponent = ((bits >> 23) & 0xFF) - 112
    mantissa = bits & 0x7FFFFF
    special = ((bits >> 23) & 0xFF) == 0xFF
    denormal = (mantissa | 0x800000) >> np.clip(14 - exponent, 0, 40)
    out = np.select(
        [special, exponent >= 31, exponent > 0, exponent >= -10],
        [0x7C00 | (mantissa != 0), np.full_like(bits, 0x7C00), (exponent << 10) | (mantissa >> 13), denormal], 0)
    zero = (bits & 0x7FFFFFFF) == 0
    return (sign | np.where(zero, 0, out)).astype("<u2")


def half_values(bits: np.ndarray) -> np.ndarray:
    """Half-precision bits as single precision, exactly."""
    return bits.astype("<u2").view("<f2").astype("<f4")


def _mapped(column: Column, kind: str, one) -> Column:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    return run(column)


def _to_bytes(column: Column, convert) -> Column:
    """Vectors to bytes, all of a batch converted at once."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        held = [v for v in values if v is not None]
        raw = convert(np.concatenate([np.zeros(0, "<f4"), *(np.asarray(v, "<f4") for v in held)]))
        size, raw = raw.itemsize, raw.tobytes()
        ends = np.cumsum([0, *(len(v) * size for v in held)])
        parts = iter([raw[a:b] for a, b in zip(ends[:-1], ends[1:])])
        return pd.Series([None if v is None else next(parts) for v in values], dtype=object)

    return run(column)


def _from_bytes(column: Column, size: int, convert) -> Column:
    """Bytes to vectors, all of a batch converted at once; a length that is no multiple of ``size`` gives null."""

    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        whole = [b is not None and len(b) % size == 0 for b in blobs]
        held = [b for b, ok in zip(blobs, whole) if ok]
        flat = convert(np.frombuffer(b"".join(held), f"<u{size}"))
        parts = iter(np.split(flat, np.cumsum([len(b) // size for b in held])[:-1]) if held else [])
        return pd.Series([next(parts) if ok else None for ok in whole], dtype=object)

    return run(column)


def to_half(vector: Column) -> Column:
    """Vector to little-endian half-precision bytes."""
    return _to_bytes(vector, half_bits)


def from_half(blob: Column) -> Column:
    """Half-precision bytes to a vector; an odd length is not a vector and gives null."""
    return _from_bytes(blob, 2, half_values)


def to_blob(vector: Column) -> Column:
    """Vector to little-endian single-precision bytes."""
    return _to_bytes(vector, lambda flat: flat)


def from_blob(blob: Column) -> Column:
    """Single-precision bytes to a vector; a length that is no multiple of four gives null."""
    return _from_bytes(blob, 4, lambda bits: bits.view("<f4"))


def hashed_embedding(text: str, dim: int) -> np.ndarray:
    """Signed feature hashing of the words, unit length: the offline stand-in for a model."""
    out = np.zeros(dim)
    for word in text.lower().split():
        code = zlib.crc32(word.encode("utf-8"))
        out[code % dim] += 1.0 if code & 0x80000000 else -1.0
    size = np.linalg.norm(out)
    return out / size if size else out


def embed(text: Column, dim: int = 64) -> Column:
    return _mapped(text, "array<float>", lambda t: hashed_embedding(t, dim).astype("<f4"))
