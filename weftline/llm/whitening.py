"""Whitening of vectors by the eigenvectors of their covariance, refined from single to double precision.

1. Entries become whole numbers, ``floor(1024 * c) + 100000``, so counts, sums and products of centred entries are exact and do
   not depend on how rows are dealt. One pass gives count and sums by dimension, the next the products of entries centred at
   the nearest whole number to the mean. A task sends one row for each dimension; only ``d * d`` sums reach the driver.
2. Eigenvectors are first found in single precision. Ogita and Aishima's iteration corrects all of them at once by matrix products:
   from ``R = I - X'X`` and ``S = X'AX`` it takes eigenvalues and a correction of X. The products are exact to about twice double
   precision: matrices are cut into slices of few bits whose products double precision holds without rounding.
3. Neighbouring eigenvalues nearer than what the residuals let tell apart form a cluster. Its columns span the right space but are
   mixed within it, so ``X'(A - mu I)X`` of these columns alone, with the cluster's own mean ``mu``, is solved in double precision
   and the columns are turned by its eigenvectors; the iteration goes on.
4. A third pass projects the centred rows. What it gives is written once; its own covariance, taken from the written rows, is
   compared with the identity.

The driver works on ``d * d`` numbers, which depend on the length of a vector and not on the number of rows.

Defined cases: rows whose vector is null, holds a null or a non-finite entry are dropped, and so are vectors of another length than
the commonest (the longer of equally common ones). Entries beyond ``2**62`` after scaling are held at that. ``vec_id`` is passed on
as it is: null and repeated ids are rows of their own. A component whose eigenvalue is zero to double precision explains 0 and
has a null ``whitened``; ``identity_error`` is over the others. ``deviation`` is null where it does not fit a long; ``exact_deviation``
(38 digits) has it. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.registry import llm_query
from weftline.session import cut_lineage
from weftline.sources.tables import table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
STEPS = 12
_MOST = 1 << 62
_LOW = (1 << 32) - 1
_EXACT = float(1 << 53)

# Products good to twice double precision


def _slices(a: np.ndarray, axis: int, inner: int) -> list[np.ndarray]:
    """``a`` as a sum of matrices with so few bits to a row (axis 1) or column (axis 0) that their products are exact."""
    bits = (53 - max(inner - 1, 1).bit_length()) // 2
    out = []
    for _ in range(-(-108 // bits)):
        top = np.abs(a).max(axis=axis, keepdims=True, initial=0)
        if not top.any():
            break
        step = np.ldexp(1.0, np.frexp(top)[1] - bits)
        part = np.rint(a / step) * step
        out.append(part)
        a = a - part
    return out


def product(a: np.ndarray, *b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a @ sum(b)`` as a sum of two matrices, the second far below the first."""
    left = _slices(a, 1, a.shape[1])
    high, low = np.zeros((a.shape[0], b[0].shape[1])), np.zeros((a.shape[0], b[0].shape[1]))
    for part in b:
        for k, x in enumerate(left):
            for y in _slices(part, 0, a.shape[1])[: len(left) + 1 - k]:
                term = x @ y
                total = high + term
                back = total - high
                low += (high - (total - back)) + (term - back)
                high = total
    total = high + low
    return total, low - (total - high)


# Eigenvectors


def _corrected(a: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the iteration: eigenvalues, corrected vectors, and how near eigenvalues are to be held clustered."""
    gram, gram_low = product(x.T, x)
    r = (np.eye(len(x)) - gram) - gram_low
    high, low = product(a[0], x)
    for more in a[1:]:
        extra, _ = product(more, x)
        low = low + extra
    s, s_low = product(x.T, high, low)
    values = (np.diag(s) + np.diag(s_low)) / (1 - np.diag(r))
    off = s - np.diag(values)
    scale = np.abs(values).max(initial=0)
    near = 2 * (np.linalg.norm(off + np.diag(values * np.diag(r)), 2) + scale * np.linalg.norm(r, 2))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > near
    e = np.where(far, (s + s_low + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return values, x + product(x, e)[0], max(near, scale * np.finfo(float).eps)


def _turned(a: tuple[np.ndarray, ...], x: np.ndarray, values: np.ndarray, near: float) -> np.ndarray:
    """Solves each cluster of eigenvalues within its own columns."""
    order = np.argsort(-values, kind="stable")
    edges = np.flatnonzero(np.r_[True, values[order][:-1] - values[order][1:] > near, True])
    x = x.copy()
    for begin, end in zip(edges[:-1], edges[1:]):
        if end - begin < 2:
            continue
        at = order[begin:end]
        own, mu = x[:, at], values[at].mean()
        # A - mu I before the product: what tells the cluster's values apart is then not lost in its common part
        diagonal = np.diag(a[0])
        less = diagonal - mu
        lost = (diagonal - (less - (less - diagonal))) - (mu + (less - diagonal))  # what that rounds off
        high, low = product(a[0] + np.diag(less - diagonal), own)
        for more in (*a[1:], np.diag(lost)):
            low = low + product(more, own)[0]
        inner, inner_low = product(own.T, high, low)
        inner = inner + inner_low
        _, turn = np.linalg.eigh((inner + inner.T) / 2)
        x[:, at] = product(own, turn[:, ::-1])[0]
    return x


def eigenvectors(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric ``high + low``, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    d = len(high)
    scale = np.abs(high).max(initial=0)
    if not d or not scale:
        return np.zeros(d), np.eye(d)
    exponent = int(np.frexp(scale)[1])
    a = np.ldexp(high, -exponent), np.ldexp(low, -exponent)
    _, x = np.linalg.eigh(a[0].astype(np.float32))
    x = x.astype(np.float64)
    values, before = np.zeros(d), np.inf
    for _ in range(STEPS):
        values, x, near = _corrected(a, x)
        turned = _turned(a, x, values, near)
        change, x = np.abs(turned - x).max() if near > 1e-12 else 0.0, turned
        if near <= 64 * d * np.finfo(float).eps or (near >= before / 2 and not change):
            break
        before = near
    values, x, _ = _corrected(a, x)
    order = np.argsort(-values, kind="stable")
    values, x = np.ldexp(values[order], exponent), x[:, order]
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


# Exact sums over tasks


def _vectors(column: pa.Array, length: int | None = None):
    """Rows with a usable vector, by length: row numbers and whole entries."""
    if not len(column):
        return
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    entries = column.flatten()
    values = entries.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.cumsum(np.r_[0, ~np.isfinite(values)])
    good = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    for size in np.unique(sizes[good]) if length is None else [length]:
        rows = np.flatnonzero(good & (sizes == size))
        scaled = np.floor(values[(ends[rows] - size)[:, None] + np.arange(size)] * SCALE)
        yield int(size), rows, np.clip(scaled, -float(_MOST), float(_MOST)).astype(np.int64) + SHIFT


class _Sum:
    """Exact sum of whole numbers, by digits to base 2**32, the first signed."""

    def __init__(self, shape):
        self.digits = [np.zeros(shape, np.int64) for _ in _DIGITS]

    def add(self, whole: np.ndarray) -> None:
        wide = whole.dtype == object
        for k, digit in enumerate(reversed(self.digits)):
            more = whole >> (32 * k if wide else min(32 * k, 63))
            digit += (more & _LOW if k + 1 < len(_DIGITS) else more).astype(np.int64)

    def parts(self) -> list[np.ndarray]:
        """Carried over, so that sums of many tasks' digits do not overflow."""
        out, carry = [], 0
        for digit in reversed(self.digits):
            out.append((digit + carry) & _LOW)
            carry = (digit + carry) >> 32
        out[-1] += carry << 32
        return out[::-1]


_DIGITS = "abcd"
_PARTS = "length int, row int, at int, n long, a long, b long, c long, d long"


def _parts(length: int, n: int, sums: _Sum) -> pa.RecordBatch:
    digits = sums.parts()
    shape = digits[0].shape
    row, at = np.indices(shape).reshape(2, -1)
    columns = [np.full(row.size, length), row, at]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int32()) for c in columns), pa.array(np.full(row.size, n)), *(pa.array(x.ravel()) for x in digits)], names=[x.split()[0] for x in _PARTS.split(", ")]
    )


def _sums(batches):
    held: dict[int, tuple[int, _Sum]] = {}
    for batch in batches:
        for size, rows, x in _vectors(batch.column(0)):
            n, sums = held.get(size, (0, None))
            sums = sums or _Sum((1, max(size, 1)))
            for part in np.array_split(x, max(1, len(x) >> 20)):
                whole = part if np.abs(part).max(initial=0) < 1 << 40 else part.astype(object)
                if size:
                    sums.add(np.asarray(whole.sum(axis=0))[None, :])
            held[size] = n + len(rows), sums
    for size, (n, sums) in held.items():
        yield _parts(size, n, sums)


def _products(length: int, middle: np.ndarray):
    def products(batches):
        sums, n = _Sum((length, length)), 0
        for batch in batches:
            for _, rows, x in _vectors(batch.column(0), length):
                n += len(rows)
                z = x - middle if np.abs(x).max(initial=0) < _MOST and np.abs(middle).max(initial=0) < _MOST else x.astype(object) - middle.astype(object)
                most = max(int(np.abs(z).max(initial=0)), 1)
                step = int(_EXACT // most**2)
                if not step:
                    for part in np.array_split(z.astype(object), max(1, len(z) >> 8)):
                        sums.add(part.T @ part)
                for a in range(0, len(z) if step else 0, step or 1):
                    part = z[a : a + step].astype(np.float64)
                    sums.add((part.T @ part).astype(np.int64))
        if n:
            yield _parts(length, n, sums)

    return products


def _collected(parts: DataFrame) -> tuple[dict[int, int], dict[tuple[int, int, int], int]]:
    """Count of vectors by length, and exact sums by length, row and column: ``d`` or ``d * d`` rows for a length."""
    total = parts.groupBy("length", "row", "at").agg(*(F.sum(c).alias(c) for c in "n" + _DIGITS)).collect()
    return {r.length: r.n for r in total}, {(r.length, r.row, r.at): (r.a << 96) + (r.b << 64) + (r.c << 32) + r.d for r in total}


# The operator


def _projected(length: int, n: int, total: list[int], base: np.ndarray):
    schema = pa.schema([("row", pa.int64()), ("exact_deviation", pa.decimal128(38, 0)), ("w", pa.list_(pa.float64()))])
    sums, small = np.array(total, object), max(map(abs, total), default=0) < _MOST

    def centred(x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        if small and np.abs(x).max(initial=0) * float(n) < 2.0**61:
            return x * n - sums.astype(np.int64)
        return x.astype(object) * n - sums

    def projected(batches):
        for batch in batches:
            for _, rows, x in _vectors(batch.column(1), length):
                off = centred(x)
                near = off.astype(np.float64)
                if (near**2).sum(axis=1).max(initial=0) < 2.0**62:
                    deviation = pa.array((off.astype(np.int64) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (sum(v * v for v in map(int, r)) for r in off)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                w = near / n @ base
                offsets = pa.array(np.arange(len(rows) + 1) * base.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], schema=schema)

    return projected


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, exact_deviation, whitened, explained, identity_error`` for every usable row of ``vectors``.

    ``deviation``: the sum over dimensions of ``(n * x - S) ** 2``. ``whitened``: the centred row projected on the component's unit
    eigenvector, over the root of its eigenvalue. ``explained``: that eigenvalue's share of the whole variance.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("row"), "embedding").filter("embedding IS NOT NULL")
    counts, sums = _collected(rows.select("embedding").mapInArrow(_sums, _PARTS))
    n, length = max(((n, size) for size, n in counts.items()), default=(0, 0))
    total = [sums[length, 0, k] for k in range(length)]
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    _, products = _collected(rows.select("embedding").mapInArrow(_products(length, middle), _PARTS)) if length else ({}, {})
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    # n * n times the covariance is a whole number; two doubles hold it to some hundred bits
    exact = [[n * products[length, j, k] - rest[j] * rest[k] for k in range(length)] for j in range(length)]
    high = np.array([[float(v) for v in r] for r in exact]).reshape(length, length)
    low = np.array([[float(v - int(h)) for v, h in zip(r, hs)] for r, hs in zip(exact, high.tolist())]).reshape(length, length)
    values, x = eigenvectors(high, low)
    trace = sum(exact[j][j] for j in range(length))
    count = min(components, length)
    real = values[:count] > values[:1].sum() * length * np.finfo(float).eps
    explained = [float(Fraction(float(v)) / trace) if ok else 0.0 for v, ok in zip(values, real)]
    deviations = np.sqrt(np.maximum(values[:count], 0)) / max(n, 1)
    base = x[:, :count] / np.where(real, deviations, 1)

    stored = cut_lineage(rows.mapInArrow(_projected(length, n, total, base), "row long, exact_deviation decimal(38,0), w array<double>"), "whitened")
    used = np.flatnonzero(real).tolist()
    pairs = [(i, j) for i in used for j in used if i <= j]
    error = 0.0
    if pairs:
        got = stored.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs))
    parts = [
        F.struct(F.lit(k + 1).alias("component"), F.col("w")[k].alias("whitened") if real[k] else F.lit(None).cast("double").alias("whitened"), F.lit(explained[k]).alias("explained")) for k in range(count)
    ]
    one = F.array(*parts) if parts else F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    fits = F.when(F.col("exact_deviation") <= F.lit((1 << 63) - 1), F.col("exact_deviation").cast("long"))
    return stored.select("row", fits.alias("deviation"), "exact_deviation", F.explode(one).alias("p")).select(
        F.col("row").alias("vec_id"), "p.component", F.lit(n).cast("long").alias("n"), "deviation", "exact_deviation", "p.whitened", "p.explained", F.lit(float(error)).alias("identity_error")
    )


@llm_query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).drop("exact_deviation")
