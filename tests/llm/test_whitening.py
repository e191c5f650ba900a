from fractions import Fraction

import numpy as np
import pytest

from weftline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def usable(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(lengths, key=lambda size: (lengths.count(size), size), default=0)
    return [(i, [int(np.floor(c * 1024)) + 100000 for c in v]) for i, v in kept if len(v) == d], d


def plain(rows):
    """Covariance and deviations in exact fractions."""
    kept, d = usable(rows)
    n, sums = len(kept), [sum(x[k] for _, x in kept) for k in range(d)]
    off = [[n * x[k] - sums[k] for k in range(d)] for _, x in kept]
    cov = [[Fraction(sum(o[j] * o[k] for o in off), n**3) for k in range(d)] for j in range(d)]
    return [(i, sum(v * v for v in o)) for (i, _), o in zip(kept, off)], cov, off


def check(spark, rows, components=8):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("w", whitening.F.lit("x")).withColumn("row", whitening.F.lit(1))
    got = whitening.whitened(df.repartition(3), components).collect()
    deviations, cov, off = plain(rows)
    d, n = len(cov), len(deviations)
    assert sorted((r.vec_id, r.component, r.n, r.exact_deviation) for r in got if r.vec_id is not None) == sorted((i, k + 1, n, s) for i, s in deviations if i is not None for k in range(min(components, d)))
    assert len(got) == n * min(components, d)
    assert all(r.deviation == (int(r.exact_deviation) if r.exact_deviation < 1 << 63 else None) for r in got)
    if not got:
        return got
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(cov[k][k] for k in range(d)))
    for k in range(min(components, d)):
        mine = [r for r in got if r.component == k + 1]
        if mine[0].whitened is None:
            assert values[k] <= 1e-12 * values[0] and mine[0].explained == 0
            continue
        assert abs(mine[0].explained * trace / values[k] - 1) < 1e-9
        if k + 1 < d and values[k] - values[k + 1] > 1e-3 * values[0] and (not k or values[k - 1] - values[k] > 1e-3 * values[0]):
            want = np.array([[float(Fraction(v, n)) for v in o] for o in off]) @ vectors[:, k] / np.sqrt(values[k])
            found = np.array([r.whitened for r in sorted(mine, key=lambda r: (r.vec_id, r.exact_deviation))])
            want = want[sorted(range(n), key=lambda j: (deviations[j][0], deviations[j][1]))]
            assert np.abs(found * np.sign(found @ want) - want).max() < 1e-9
    assert got[0].identity_error < 1e-9
    return got


def random_rows(n, d, seed=1, scale=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (np.linspace(1, 3, d) if scale is None else scale)
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, d", [(400, 12), (60, 3), (30, 40), (9, 1)])
def test_against_fractions(spark, n, d):
    check(spark, random_rows(n, d))


def test_rows_that_are_dropped(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, inf, 0.0]), (904, [nan, 0.0, 0.0]), (905, [1.0, 2.0]), (3, [0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5])]
    got = check(spark, random_rows(50, 3) + odd)
    assert {r.vec_id for r in got} == set(range(50))


def test_null_ids_are_rows(spark):
    rows = [(None, v) for _, v in random_rows(20, 2)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 40 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [2.0, 3.0])] * 4, [(k, [1.0, float(k % 2)]) for k in range(6)]])
def test_without_variance(spark, rows):
    check(spark, rows)


def test_large_entries_stay_exact(spark):
    check(spark, random_rows(40, 4, scale=[1e9, 1e8, 3e8, 1e7]))
    got = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], SCHEMA)).collect()
    assert len(got) == 6 and {r.vec_id for r in got if r.deviation is None} == {1, 2}


def test_offsets_do_not_cost_digits(spark):
    rows = [(i, [c + 4e7 for c in v]) for i, v in random_rows(200, 6)]
    check(spark, rows)


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 1e-9, 1e-12, 0])
def test_clustered_eigenvalues(gap):
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(40, 40)))
    a = (q * np.r_[3 + gap * np.arange(8), np.linspace(1, 2, 32)]) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigenvectors(a, np.zeros_like(a))
    wide = np.longdouble
    assert np.abs(a.astype(wide) @ x.astype(wide) - x.astype(wide) * values.astype(wide)).max() < 3e-16
    assert np.abs(x.T.astype(wide) @ x.astype(wide) - np.eye(40)).max() < 3e-15
    assert (np.diff(values) <= 0).all() and np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14


def test_low_part_of_the_matrix_counts():
    high, low = np.diag([1.0, 1.0]), np.array([[0.0, 1e-18], [1e-18, 0.0]])
    _, x = whitening.eigenvectors(high, low)
    assert np.abs(np.abs(x) - np.sqrt(0.5)).max() < 1e-9


def test_products_to_twice_double_precision():
    r = np.random.default_rng(6)
    a, b = r.normal(size=(7, 30)) * np.logspace(0, -9, 30), r.normal(size=(30, 5)) * np.logspace(-9, 0, 30)[:, None]
    high, low = whitening.product(a, b)
    for i in range(7):
        for j in range(5):
            exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a[i].tolist(), b[:, j].tolist()))
            top = np.abs(a[i]).max() * np.abs(b[:, j]).max()
            assert abs(float(exact - Fraction(float(high[i, j])) - Fraction(float(low[i, j])))) < 1e-27 * top


def test_the_query(spark, sf):
    got = whitening.op11_whitening(spark, sf)
    assert got.columns == "vec_id component n deviation whitened explained identity_error".split()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    deviations, _, _ = plain(rows)
    found = got.collect()
    assert sorted((r.vec_id, r.component, r.deviation) for r in found) == sorted((i, k, s) for i, s in deviations for k in range(1, 9))
    assert found[0].identity_error < 1e-9
    kinds = dict(got.dtypes)
    assert [kinds[c] for c in got.columns] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
