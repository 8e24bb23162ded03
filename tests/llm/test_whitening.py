"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from sqlcorpus.llm import queries, whitening as w


def dense(vectors):
    """Distinct whole vectors, their mean, eigenvalues (falling) and eigenvectors of their covariance."""
    x = np.unique(vectors, axis=0)
    away = x - x.mean(0)
    values, found = np.linalg.eigh(away.T @ away / len(x))
    return x, values[::-1], found[:, ::-1]


@pytest.mark.parametrize("dim, n, spread", [(1, 5, 1.0), (3, 2, 1.0), (8, 200, 1e-3), (32, 20, 1.0), (32, 500, 1e3)])
def test_rank_one_updates_keep_the_spectrum(dim, n, spread):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.normal(size=(n, dim)) * np.geomspace(1, spread, dim))
    x[: n // 3] = x[0]  # copies, and hence equal eigenvalues of zero
    s = w.Spectrum.empty(dim)
    for v in x:
        s.add(v)
    away = x - x.mean(0)
    assert np.allclose(s.mean, x.mean(0), rtol=1e-12)
    assert np.allclose(s.vectors.T @ s.vectors, np.eye(dim), atol=1e-12)
    assert np.allclose(s.vectors * s.values @ s.vectors.T, away.T @ away, atol=1e-11 * max(np.abs(away.T @ away).max(), 1))
    a, b = w.Spectrum.empty(dim), w.Spectrum.empty(dim)
    for k, v in enumerate(x):
        (a if k % 3 else b).add(v)
    a.merge(b)
    assert a.n == n and np.allclose(a.values, s.values, atol=1e-11 * max(s.values.max(), 1))


def test_deflation_of_equal_eigenvalues_and_untouched_directions():
    values, vectors = np.array([1.0, 1.0, 1.0, 5.0, 9.0]), np.eye(5)
    v = np.array([1.0, 2.0, 2.0, 0.0, 1e-30])
    found, turned = w.rank_one(values, vectors, v, 2.0)
    assert np.allclose(found, [1, 1, 5, 9, 19]) and found[2] == 5 and found[3] == 9
    assert np.allclose(turned * found @ turned.T, np.diag(values) + 2 * np.outer(v, v))


def test_query_on_given_vectors(spark, given):
    found = queries.op13_embedding_whitening(spark, given)
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                            ("explained", "double"), ("identity_error", "double")]
    rows = sorted(found.collect())
    table = queries.table(spark, given, "embeddings").select("vec_id", "embedding").collect()
    ids = sorted(r["vec_id"] for r in table)
    x = np.floor(256 * np.array([r["embedding"] for r in sorted(table, key=lambda r: r["vec_id"])])).astype(int)
    fit, values, vectors = dense(x)
    assert [r["vec_id"] for r in rows] == [i for i in ids for _ in range(4)]
    assert {r["n"] for r in rows} == {len(fit)} and [r["component"] for r in rows[:4]] == [1, 2, 3, 4]
    assert [r["deviation"] for r in rows[::4]] == ((len(fit) * x - fit.sum(0)) ** 2).sum(1).tolist()
    white = np.array([r["whitened"] for r in rows]).reshape(-1, 4)
    wanted = (x - fit.mean(0)) @ vectors[:, :4] / np.sqrt(values[:4])
    assert np.allclose(white, wanted * np.sign((white * wanted).sum(0)), atol=1e-10)
    assert np.allclose([r["explained"] for r in rows[:4]], values[:4] / values.sum(), rtol=1e-10)
    assert max(r["identity_error"] for r in rows) < 1e-10


def test_spectra_of_many_tasks_and_components_close_together(spark, monkeypatch):
    monkeypatch.setattr(w, "VECTORS", 20)
    monkeypatch.setattr(w, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)) * np.r_[2, 2, 2, 1, np.full(20, 0.999)]
    rows = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "vec_id long, embedding array<double>, n string")
    found = sorted(w.whiten(rows).collect())
    whole = np.floor(256 * x).astype(int)
    fit, values, vectors = dense(whole)
    white = np.array([r["whitened"] for r in found]).reshape(-1, 4)
    wanted = (whole - fit.mean(0)) @ vectors[:, :4] / np.sqrt(values[:4])
    assert np.allclose(white, wanted * np.sign((white * wanted).sum(0)), atol=1e-8)
    assert max(r["identity_error"] for r in found) < 1e-10


def test_the_spectrum_decides_and_the_refinement_mends(spark, monkeypatch):
    """Leading vectors that are a little off are led back; the space itself comes from the spectrum."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 30)) * np.geomspace(3, 0.1, 30)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rounds, scattered, spectrum = [], w._scattered, w.combined_spectrum
    monkeypatch.setattr(w, "_scattered", lambda *a: rounds.append(a[-1]) or scattered(*a))
    good = sorted(w.whiten(rows).collect())
    direct = sum(rounds)

    def with_vectors(change):
        def changed(fit, dim):
            s, total = spectrum(fit, dim)
            s.vectors = change(s.vectors)
            return s, total

        rounds.clear()
        monkeypatch.setattr(w, "combined_spectrum", changed)
        return sorted(w.whiten(rows).collect())

    off = with_vectors(lambda v: np.linalg.qr(v + 1e-3 * rng.normal(size=v.shape))[0])
    assert direct == 1 < sum(rounds)
    assert np.allclose(np.abs([r["whitened"] for r in off]), np.abs([r["whitened"] for r in good]), atol=1e-8)
    last = with_vectors(lambda v: v[:, ::-1])
    assert last[0]["explained"] < 0.1 * good[0]["explained"]


@pytest.mark.parametrize("vectors, kept", [
    ([], []), ([None], []), ([[1.0, 2.0], [1.0, 2.0]], []), ([[]], []), ([[float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0]], []),
    ([[0.0, 1.0], [0.0, 3.0], [0.5]], [0, 1, 2]),
])
def test_few_and_odd_vectors(spark, vectors, kept):
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, whitened string")
    found = w.whiten(rows).collect()
    assert sorted({r["vec_id"] for r in found}) == kept
    assert all(r["n"] == len(vectors) and r["identity_error"] < 1e-9 for r in found)


def test_sums_beyond_64_bits_are_null_not_wrong(spark):
    rows = spark.createDataFrame([(1, [7e9]), (2, [-7e9]), (2, [-7e9])], "vec_id long, embedding array<double>")
    found = w.whiten(rows).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 2, 2] and {r["deviation"] for r in found} == {None}
    assert np.allclose(sorted(r["whitened"] for r in found), [-1, -1, 1])
