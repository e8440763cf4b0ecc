"""Predictions along a path of sparse means against dense algebra."""

import numpy as np
import pytest

from velspar.operators import branches, linops, solvers, sparse
from velspar.sources.shared import written

from .test_algebra import M, N, back, dense, vec  # noqa: F401


def test_every_point_equals_dense_algebra(spark, dense):  # noqa: F811
    geno, st, comps, z, _, ks = dense
    n = N - 2  # the last two samples have no response
    z, ks = z[:n], [k[:n, :n] for k in ks]
    rng = np.random.default_rng(12)
    theta = np.array([0.3, 0.4, 0.5])
    products = [0]

    def hv(at, t):
        products[0] += 1
        own = spark.createDataFrame([(c, float(v)) for c, v in enumerate(at[:-1])], "comp int, theta double")
        return linops.h(geno, st, comps, own, float(at[-1]), t)

    h = 0.3 * ks[0] + 0.4 * ks[1] + 0.5 * np.eye(n)
    q = np.linalg.qr(np.c_[np.ones(n), rng.normal(size=n)])[0]
    y = rng.normal(size=n)
    b = np.zeros((3, M))  # point 0 has no effects
    b[1, 2], b[2, [0, 2, 9]] = 0.4, [0.1, 0.5, -0.2]
    assert (z[:, 2] == 0).any()  # a sample without the only call of point 1
    betas = spark.createDataFrame([(p, v, float(b[p, v])) for p in range(3) for v in range(M) if b[p, v]], "path long, v long, b double")
    points = spark.createDataFrame([(p,) for p in range(3)], "path long")
    response = spark.createDataFrame([(i, float(x)) for i, x in enumerate(y)], "s long, y double")
    own = sparse.columns(geno, st, spark.createDataFrame([(2,), (9,)], "v long"), response)
    assert own.count() == 2 * n
    assert np.allclose(back(own, (n, M))[:, [2, 9]], z[:, [2, 9]])
    solutions = solvers.Solutions(hv, tol=1e-10)
    got = branches.path_duals(solutions, theta, geno, st, points, betas, response, vec(spark, q))
    p = np.linalg.inv(h) - np.linalg.inv(h) @ q @ np.linalg.solve(q.T @ np.linalg.inv(h) @ q, q.T @ np.linalg.inv(h))
    rest = y[:, None] - z @ b.T
    alpha = back(got["alpha"], (n, 3))
    assert np.allclose(alpha, p @ rest, atol=1e-7)
    assert max(got["errors"].values()) < 1e-8
    fixed = np.linalg.solve(q.T @ np.linalg.inv(h) @ q, q.T @ np.linalg.inv(h) @ rest)
    assert {(r.path, r.r): r.b for r in got["fixed"].collect()} == pytest.approx({(k, j): fixed[j, k] for k in range(3) for j in range(2)}, abs=1e-7)
    effects = written(branches.background_effects(geno, st, comps, theta, got["alpha"]), "test-background")

    new = rng.integers(0, 3, (5, M)).astype(float)  # other samples, on the training statistics; sample 105 has no calls
    stats = {r.v: (r.mean, r.inv) for r in st.collect()}
    zn = np.array([[(new[i, j] - stats[j][0]) * stats[j][1] for j in range(M)] for i in range(5)] + [[0.0] * M])
    qn = rng.normal(size=(6, 2))
    others = spark.createDataFrame([(100 + i, j, int(new[i, j])) for i in range(5) for j in range(M)], "s long, v long, g int")
    covariates = spark.createDataFrame([(100 + i, j, float(qn[i, j])) for i in range(6) for j in range(2)], "s long, r long, x double")
    samples = spark.createDataFrame([(100 + i,) for i in range(6)], "s long")
    rows = branches.predicted_path(others, st, points, betas, effects, got["fixed"], covariates, samples).collect()
    assert len(rows) == 18
    m = [sum(1 for v in range(c, M, 2) if stats[v][1] > 0) for c in (0, 1)]
    weight = np.array([theta[v % 2] / m[v % 2] for v in range(M)])
    for r in rows:
        i = r.s - 100
        want = (zn[i] @ b[r.path], zn[i] * weight @ (z.T @ (p @ rest[:, r.path])), qn[i] @ fixed[:, r.path])
        assert (r.sparse, r.background, r.nuisance, r.total) == pytest.approx((*want, sum(want)), abs=1e-6)

    used, products[0] = products[0], 0
    again = branches.path_duals(solutions, theta, geno, st, points, betas, response, vec(spark, q))  # the same branch once more: nothing is solved anew
    assert products[0] < used / 3
    assert np.allclose(back(again["alpha"], (n, 3)), alpha, atol=1e-8)
