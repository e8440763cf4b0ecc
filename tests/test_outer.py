"""Outer workflows against the same loops in dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_algebra import M, N, dense  # noqa: F401
from velspar.operators import effects, gwas, outer, solvers, spans
from velspar.operators.solvers import lasso_path

GRID = [(a, e) for a in (0.05, 0.2, 0.5) for e in (0.3, 0.6, 0.9)]


def beside_ones(h):
    hi, one = np.linalg.inv(h), np.ones((N, 1))
    return hi - hi @ one @ np.linalg.inv(one.T @ hi @ one) @ one.T @ hi


def test_alternating_equals_the_dense_loop(spark, dense):  # noqa: F811
    geno, st, _, z, inv, _ = dense
    rng = np.random.default_rng(21)
    y = 0.9 * z[:, 2] - 0.6 * z[:, 5] + rng.normal(size=N) * 0.5
    y = (y - y.mean()) / y.std()
    k, one = z @ z.T / (inv > 0).sum(), np.ones((N, 1))
    ratios, atoms, start = np.array([1.0, 0.6, 0.4]), np.array([np.trace(k) / N, 1.0]), np.array([0.2, 0.6])

    def best(rest):
        def loglik(t):
            h = t[0] * k + t[1] * np.eye(N)
            hi = np.linalg.inv(h)
            return -0.5 * (np.linalg.slogdet(h)[1] + np.linalg.slogdet(one.T @ hi @ one)[1] + rest @ beside_ones(h) @ rest)

        return np.array(max(GRID, key=loglik))

    def weighted(theta):
        p = beside_ones(theta[0] * k + theta[1] * np.eye(N))
        table = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(N) for j in range(N)], "s long, t long, p double")
        return lambda b: b.select(F.col("s").alias("t"), "r", "x").join(table, "t").groupBy("s", "r").agg(F.sum(F.col("p") * F.col("x")).alias("x"))

    def fit(rest, theta, basis, rank):
        got = np.zeros(N)
        for r in rest.collect():
            got[r.s] = r.y
        return best(got)

    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    comps = st.select("v", F.lit(0).alias("comp"))
    found = outer.alternating(geno, st, comps, resp, gwas.basis(resp, []), start, atoms, N, ratios, limit=3, weighted=weighted, fit=fit, tol=1e-6)

    theta, mean, h2, turns = start, np.zeros(N), None, 0
    while turns < 3:
        p = beside_ones(theta[0] * k + theta[1] * np.eye(N))
        b = lasso_path(z.T @ p @ z, z.T @ p @ y, np.abs(z.T @ p @ y).max() * ratios)[-1]
        g = z @ b
        theta, turns = best(y - g), turns + 1
        chosen = z[:, b != 0]
        u = np.linalg.svd(chosen, full_matrices=False)[0]
        inside = u.T @ beside_ones(theta[0] * k + theta[1] * np.eye(N)) @ u
        part = (g @ g + 2 * g @ (y - g) - np.trace(np.linalg.inv(inside))) / N
        now = (theta[0] * atoms[0] + part) / (theta[0] * atoms[0] + theta[1] + part)
        moved = np.linalg.norm(g - mean) / max(np.linalg.norm(g), np.linalg.norm(mean))
        still = h2 is not None and moved <= 0.05 and abs(now - h2) <= 0.01
        mean, h2 = g, now
        if still:
            break
    got = np.zeros(M)
    for r in found["betas"].collect():
        got[r.v] = r.b
    assert len(found["history"]) == turns and found["converged"] == still
    assert np.allclose(got, b, atol=1e-4) and np.allclose(found["theta"], theta) and found["h2"] == pytest.approx(h2, abs=1e-3)
    flat = outer.alternating(geno, st, comps, resp.withColumn("y", F.lit(0.0)), gwas.basis(resp, []), start, atoms, N, ratios, limit=2, weighted=weighted, fit=fit)
    assert flat["betas"].count() == 0 and flat["converged"] and len(flat["history"]) == 2


def test_a_selected_span_corrects_the_scores(spark, dense):  # noqa: F811
    geno, st, _, z, inv, _ = dense
    k, theta = z @ z.T / (inv > 0).sum(), np.array([0.2, 0.9])
    y = np.random.default_rng(22).normal(size=N)
    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    hv, parts = outer.system(geno, st, st.select("v", F.lit(0).alias("comp")))
    u = np.linalg.svd(z[:, [1, 4]], full_matrices=False)[0]
    basis = spark.createDataFrame([(i, j, float(u[i, j])) for i in range(N) for j in (0, 1)], "s long, r long, x double")
    q = gwas.basis(resp, [])
    probes = {}
    for r in solvers.probes(resp.select("s"), 2).collect():
        probes[r.s, r.r] = r.x
    us = np.array([[probes[i, j] for j in sorted({b for _, b in probes})] for i in range(N)])
    _, history = solvers.fit_reml(hv, parts, resp, q, resp.select("s"), theta, traces=2, rounds=1, correction=lambda project: spans.span_information(basis, 2, project, parts)["corrections"])
    p = beside_ones(theta[0] * k + theta[1] * np.eye(N))
    for c, kernel in enumerate((k, np.eye(N))):
        off = np.trace(np.linalg.inv(u.T @ p @ u) @ u.T @ p @ kernel @ p @ u)
        trace = np.mean(np.einsum("ij,ij->j", us, kernel @ p @ us))
        assert history[0]["score"][c] == pytest.approx(0.5 * (y @ p @ kernel @ p @ y - trace + off), abs=1e-3)
    assert np.array(history[0]["info"])[1, 1] == pytest.approx(0.5 * y @ p @ p @ p @ y, rel=1e-3)


def test_weak_components_are_merged_and_fitted_again(spark, dense, monkeypatch):  # noqa: F811
    number, start = outer.background(np.array([5.0, 0.1, 6.0, 0.2]), np.array([0.3, 0.01, 0.2, 0.02, 0.4]), 3.0)
    assert number == {0: 0, 2: 1, 1: 2, 3: 2} and np.allclose(start, [0.3, 0.2, 0.03, 0.4])
    assert outer.background(np.array([5.0, 0.1]), np.array([0.3, 0.01, 0.4]), 3.0)[0] == {0: 0, 1: 1}
    geno, st, *_ = dense
    seen = []

    def fit(hv, parts, response, q, samples, theta, **more):
        seen.append(theta)
        return theta, [{"step": 0.0, "info": np.diag([1e6, 1.0, 1.0, 1.0]).tolist()}]

    monkeypatch.setattr(outer, "fit_reml", fit)
    comps = st.select("v", (F.col("v") % 3).cast("int").alias("comp"))
    got = outer.merged_fit(geno, st, comps, None, None, None, np.array([0.3, 0.01, 0.02, 0.6]), 3.0)
    assert len(seen) == 2 and np.allclose(got["theta"], [0.3, 0.03, 0.6]) and got["number"] == {0: 0, 1: 1, 2: 1}
    assert {(r.v, r.comp) for r in got["components"].collect()} == {(v, min(v % 3, 1)) for v in range(M)}


def test_change_of_the_mean_is_by_its_own_length(spark):
    one = lambda *x: spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "s long, r long, x double")
    assert effects.relative_change(one(3, 4), one(0, 0), one(100, 0)) == pytest.approx(1.0)
    assert effects.relative_change(one(0, 0), one(0, 0), one(0, 0)) == 0.0
    assert effects.converged(0.05, 0.51, 0.5) and not effects.converged(0.0, float("nan"), 0.5)


def test_partition_grows_to_the_planted_cuts(spark):
    planted, starts = [20, 8], []

    def test(ranks, theta):
        edges = {r["first"] for r in ranks.groupBy("comp").agg(F.min("rank").alias("first")).collect()}
        open_ = [c for c in planted if c not in edges]
        return {"cut": open_[0], "p": 0.01} if open_ else {"cut": 5, "p": 0.5}

    def fit(components, start):
        starts.append(start)
        return start * 0.5

    ranks = spark.range(30).select(F.col("id").alias("v"), F.col("id").alias("rank"), F.lit(0).alias("comp"))
    parts, theta, history = outer.grown_partition(ranks, np.array([0.6, 0.4]), test, fit)
    sizes = {r.comp: (r.a, r.b) for r in parts.groupBy("comp").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).collect()}
    assert sizes == {0: (0, 7), 1: (8, 19), 2: (20, 29)}
    assert np.allclose(starts[0], [0.4, 0.2, 0.4]) and np.allclose(starts[1], [0.08, 0.12, 0.1, 0.2]) and len(theta) == 4
    assert [h["p"] for h in history] == [0.01, 0.01, 0.5]
    assert len(outer.grown_partition(ranks, np.array([0.6, 0.4]), test, fit, limit=1)[2]) == 2


def test_partition_test_refuses_variants_that_do_not_vary(spark, dense):  # noqa: F811
    geno, st, *_ = dense
    ranks = st.select("v", F.col("v").alias("rank"), F.lit(0).alias("comp"))
    with pytest.raises(ValueError, match="don't vary"):
        outer.tested(geno, st, 4, None, None)(ranks, np.array([0.5, 0.5]))
