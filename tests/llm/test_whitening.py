"""Whitening against a dense eigensolver and exact arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from workweave.llm import feast, whitening
from workweave.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, vector string, whitened string"


def spectrum(matrix, most):
    parts = feast.intervals(matrix, most, 1e-10)
    solved = [feast.solve(matrix, *p) for p in parts]
    values = np.concatenate([np.zeros(0), *[v for v, _ in solved]])[:most]
    vectors = np.concatenate([np.zeros((len(matrix), 0)), *[u for _, u in solved]], axis=1)[:, :most]
    return values, vectors


def test_inertia_counts_signs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 12)
        a = rng.integers(-2, 3, (n, n))
        a = a + a.T
        w = np.linalg.eigvalsh(a)
        assert feast.inertia(a) == ((w < -1e-9).sum(), (abs(w) <= 1e-9).sum(), (w > 1e-9).sum())


@pytest.mark.parametrize("n,d", [(500, 64), (40, 64), (5, 8), (300, 33), (900, 3)])
def test_eigenpairs(n, d):
    x = np.random.default_rng(d).standard_normal((n, d)) * np.linspace(1, 6, d)
    x -= x.mean(0)
    matrix = x.T @ x / n
    values, vectors = spectrum(matrix, 32)
    want = np.linalg.eigvalsh(matrix)[::-1][: min(32, d, n - 1)]
    assert np.allclose(values, want, rtol=1e-12) and len(values) == len(want)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_equal_eigenvalues_and_no_variance():
    for diagonal in ([1.0] * 50, [1e9] + [1.0] * 40 + [1e-3] * 9, [4.0], [5.0, 5.0, 0.0]):
        values, vectors = spectrum(np.diag(diagonal), 32)
        want = [x for x in sorted(diagonal, reverse=True) if x > 1e-10 * max(diagonal)][:32]
        assert np.allclose(values, want, rtol=1e-6)
        assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-11
    assert feast.intervals(np.zeros((4, 4)), 32, 1e-10) == []
    with pytest.raises(ArithmeticError):
        feast.solve(np.diag([1.0, 2.0, 3.0]), 0.5, 2.5, 3)


def plain(rows, most=32):
    """Rows and identity error by exact sums and numpy's eigensolver."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centre = np.array(y, dtype=float) / n
    matrix = centre.T @ centre / n
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:most]
    keep = [k for k in order if values[k] > 1e-10 * values.max()]
    z = centre @ vectors[:, keep] / np.sqrt(values[keep])
    return {i: (n, sum(a * a for a in row), z[k]) for k, ((i, _), row) in enumerate(zip(good, y))}, (
        values[keep] / np.trace(matrix))


@pytest.mark.parametrize("n,d", [(400, 40), (12, 6), (20, 40)])
def test_query_matches_dense_version(spark, tmp_path, n, d):
    rng = np.random.default_rng(n)
    data = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) / 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(n, rows[0][1]), (-1, None), (-2, [None] * d), (-3, [float("nan")] * d),
             (-4, [1.0] * (d - 1) + [float("-inf")])]
    full = spark.createDataFrame([(i, v, 1, 2, "v", "w") for i, v in rows], SCHEMA)
    full.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_embedding_whitening(spark, str(tmp_path)).collect()
    want, share = plain(rows)
    assert len(got) == len(want) * len(share)
    sign = {}
    for r in got:
        number, deviation, z = want[r.vec_id]
        assert (r.n, r.deviation) == (number, deviation)
        assert abs(r.explained - share[r.component - 1]) <= 1e-9 * r.explained
        assert r.identity_error < 1e-9
        if abs(z[r.component - 1]) > 1e-6:
            sign.setdefault(r.component, np.sign(r.whitened / z[r.component - 1]))
            assert abs(r.whitened * sign[r.component] - z[r.component - 1]) < 1e-7
    assert len(sign) == len(share)


def test_odd_tables(spark):
    def rows(data):
        return spark.createDataFrame([(i, v, 1, 2, "v", "w") for i, v in data], SCHEMA)

    for data in ([], [(1, None)], [(1, [2.0, 3.0])], [(i, [1.0, 5.0]) for i in range(9)], [(1, [])]):
        few = rows(data)
        fitted = whitening.fit(few)
        assert fitted.explained == [] and fitted.identity_error(few) == 0.0
        assert fitted.transform(few).select(F.explode("whitened")).count() == 0
    # vectors of a length that fewer have are left out; null and repeated ids stay
    mixed = rows([(1, [1.0]), (1, [2.0]), (None, [4.0]), (2, [1.0, 1.0]), (3, [])])
    fitted = whitening.fit(mixed)
    assert fitted.n == 3 and fitted.explained == [1.0]
    found = sorted((r.vec_id or -1, r.deviation) for r in fitted.transform(mixed).collect())
    assert found == [(-1, (3 * 256 - 448) ** 2), (1, (3 * 128 - 448) ** 2), (1, (3 * 64 - 448) ** 2)]


def test_large_numbers_stay_exact(spark):
    # beyond 64 bits after multiplication, and a deviation that no long holds
    data = [(i, [float(x), 1.0]) for i, x in enumerate([2.0 ** 54, -(2.0 ** 54), 0.5, 0.25])]
    many = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    fitted = whitening.fit(many)
    assert fitted.sums == [48 + 4_000_000, 256 + 4_000_000]
    found = {r.vec_id: r.deviation for r in fitted.transform(many).collect()}
    assert found == {0: None, 1: None, 2: (4 * 32 - 48) ** 2, 3: (4 * 16 - 48) ** 2}
    assert whitening.deviations(np.array([[3 * 10 ** 9, 10 ** 8], [4 * 10 ** 9, 0]], dtype=object)) == [
        9 * 10 ** 18 + 10 ** 16, None]
