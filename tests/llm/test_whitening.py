"""Eigenvectors against numpy's double solver, whitening against a plain computation."""

import numpy as np
import pytest

from finloom.llm import whitening

RNG = np.random.default_rng(5)


def rotated(values, seed=2):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


SPECTRA = {
    "spread": np.linspace(1, 2, 40),
    "clusters": np.r_[1 + 1e-8 * np.arange(10), np.linspace(2, 5, 20), 9 + 1e-6 * np.arange(4)],
    "closer": np.r_[1 + 1e-12 * np.arange(6), 3.0, 4.0],
    "equal": np.r_[np.ones(8), 2 * np.ones(5)],
    "wide": np.r_[1e12, 1e6 + 1e-3 * np.arange(3), np.ones(4)],
    "flat": np.r_[np.zeros(5), 1.0],
    "one": [3.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_refined_eigen(name):
    v = rotated(SPECTRA[name])
    e, x = whitening.refined_eigen(v)
    scale = np.abs(v).max()
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-13 * scale * len(v))
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-14
    assert np.abs(v @ x - x * e).max() < 1e-13 * scale


def test_refinement_beats_its_start():
    v = rotated(np.linspace(1, 2, 40))
    e, x = np.linalg.eigh(v.astype(np.float32))
    assert np.abs(v @ x - x * e).max() > 1e-8 > 1e-13 > np.abs(v @ whitening.refined_eigen(v)[1] - whitening.refined_eigen(v)[1] * whitening.refined_eigen(v)[0]).max()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain(vectors, components=4):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ w / np.sqrt(e), e / np.trace(v)


def test_whiten_equals_a_plain_computation(many_pieces):
    vectors = RNG.normal(size=(300, 7)) * [5, 3, 2, 1, 0.7, 0.5, 0.1] - 0.25
    vectors[100:200] = vectors[0]  # a group of equal vectors is fitted once
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    extra = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] * 7), (903, [float("inf")] + [0.0] * 6), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(frame(many_pieces, rows + extra).repartition(8)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = plain(vectors)
    assert got["vec_id"].tolist() == np.repeat(np.arange(300), 4).tolist()
    assert (got["n"] == n).all() and n == 200
    assert got["deviation"].tolist() == np.repeat(deviation, 4).tolist()
    own = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(own - whitened * np.sign((own * whitened).sum(0))).max() < 1e-10
    assert np.allclose(got["explained"][:4], explained, rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-12


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.25])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 and {r.n for r in got} == {3} and {r.component for r in got} == {1, 2}


def test_no_variance_and_no_rows(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, -0.0, 2.0]), (2, [0.5, 0.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(k, 1, 0, None, 0.0, None) for k in (1, 2, 3)] * 2
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(1, [3.0e6, 1.0]), (2, [-2.0e6, 2.0]), (3, [0.0, 5.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows), components=1).collect()}
    x = [[256 * int(a) for a in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert got == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
