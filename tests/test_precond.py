"""Low-rank preconditioners against dense algebra."""

import numpy as np
import pytest

from tests.test_algebra import N, back, dense, vec  # noqa: F401
from velspar.operators import linops, precond, solvers


def test_low_rank(spark, dense):  # noqa: F811
    geno, st, comps, z, inv, _ = dense
    k = z @ z.T / (inv > 0).sum()
    samples = geno.select("s").distinct()
    u, values = precond.low_rank(lambda t: linops.k(geno, st, t), samples, 6, oversample=8)
    want = np.sort(np.linalg.eigvalsh(k))[::-1][:6]
    assert np.allclose(values, want, rtol=0.05)
    x = np.random.default_rng(1).normal(size=(N, 2))
    dense_u = back(u, (N, 6))
    m = 0.5 * np.eye(N) + dense_u @ np.diag(values) @ dense_u.T
    assert np.allclose(back(precond.inverse(u, values, 0.5)(vec(spark, x)), (N, 2)), np.linalg.solve(m, x))
    assert precond.log_determinant(values, 0.5, N) == pytest.approx(np.linalg.slogdet(m)[1])
    theta = spark.createDataFrame([(0, 1.0), (1, 1.0)], "comp int, theta double")
    product = lambda t: linops.h(geno, st, comps, theta, 0.5, t)
    b = vec(spark, x)
    got, error, steps = solvers.pcg(product, b, tol=1e-8, precond=precond.inverse(u, 2 * values, 0.5))
    assert max(error.values()) < 1e-6 and steps <= N
