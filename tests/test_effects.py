"""Effects, predictions and rules after a fit, against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_algebra import M, N, dense, vec  # noqa: F401
from velspar.operators import effects, gwas, linops


def test_estimates_and_predictions(spark, dense):  # noqa: F811
    geno, st, comps, z, inv, ks = dense
    y = np.random.default_rng(3).normal(size=N)
    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    theta = spark.createDataFrame([(0, 0.3), (1, 0.2)], "comp int, theta double")
    q = gwas.basis(resp, [])
    got = effects.estimate(lambda t: linops.h(geno, st, comps, theta, 0.5, t), geno, st, comps, theta, resp, q)
    h = 0.3 * ks[0] + 0.2 * ks[1] + 0.5 * np.eye(N)
    x = np.ones((N, 1)) / N**0.5
    hi = np.linalg.inv(h)
    b = np.linalg.solve(x.T @ hi @ x, x.T @ hi @ y)
    alpha = hi @ (y - x @ b)
    assert got["fixed"].first().b == pytest.approx(b[0], rel=1e-5)
    effect = {(r.v, r.comp): r.b for r in got["variants"].collect()}
    for j in range(M):
        m = (inv[j % 2 :: 2] > 0).sum()
        assert effect[j, j % 2] == pytest.approx((0.3, 0.2)[j % 2] * z[:, j] @ alpha / m, abs=1e-6)
    pred = {r.s: r.y_pred for r in effects.predicted(geno, st, got["variants"], got["fixed"], q, 10.0, 2.0).collect()}
    want = 10 + 2 * (x @ b + (0.3 * ks[0] + 0.2 * ks[1]) @ alpha)
    assert np.allclose([pred[i] for i in range(N)], want, atol=1e-4)


def test_rules(spark):
    g, r = np.array([[1.0], [2.0]]), np.array([[0.5], [-1.0]])
    assert effects.sparse_variance(vec(spark, g), vec(spark, r), 0.4, 2) == pytest.approx((5 + 2 * (0.5 - 2) - 0.4) / 2)
    assert effects.relative_change(vec(spark, g), vec(spark, r), vec(spark, g)) == pytest.approx((0.25 + 9) ** 0.5 / 5**0.5)
    assert effects.converged(0.05, 0.5, 0.505) and not effects.converged(0.06, 0.5, 0.5)
    with pytest.raises(ValueError, match="converged"):
        effects.accepted(np.array([0.1, 0.9]), [{"step": 0.1}])
    with pytest.raises(ValueError, match="bounds"):
        effects.accepted(np.array([-0.1, 0.9]), [{"step": 0.0}])
    zs = effects.z_scores(np.array([0.4, 0.6]), np.diag([2.0, 1.0]), 50)
    assert zs[0] == pytest.approx(0.4 * 10, rel=1e-6)
    values = spark.createDataFrame([(0, -1, 2.0), (0, 0, 3.0)], "s long, r long, x double")
    out = effects.residuals(values, values.withColumn("x", F.col("x") * 10), spark.createDataFrame([(7, 0, 0.5)], "path int, r long, b double")).first()
    assert (out.path, out.r, out.hr) == (7, 0.5, 5.0)
