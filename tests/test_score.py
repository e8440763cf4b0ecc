"""Projection, random draws, the score process and its law, selected spans, against dense algebra."""

import numpy as np
import pytest

from tests.test_algebra import M, N, dense, vec  # noqa: F401
from velspar.operators import linops, score, spans
from velspar.operators.solvers import pcg


def columns(table, sides):
    out = np.zeros((N, len(sides)))
    at = {r: k for k, r in enumerate(sides)}
    for r in table.collect():
        out[r.s, at[r.r]] = r.x
    return out


@pytest.fixture()
def fitted(spark, dense):  # noqa: F811
    geno, st, comps, z, inv, ks = dense
    theta = spark.createDataFrame([(0, 0.3), (1, 0.2)], "comp int, theta double")
    h = 0.3 * ks[0] + 0.2 * ks[1] + 0.5 * np.eye(N)
    c = np.stack([np.ones(N) / N**0.5, np.random.default_rng(4).normal(size=N)], 1)
    hi = np.linalg.inv(h)
    p = hi - hi @ c @ np.linalg.inv(c.T @ hi @ c) @ c.T @ hi
    return geno, st, comps, z, inv, ks, theta, h, c, p, lambda t: linops.h(geno, st, comps, theta, 0.5, t)


def test_projector_and_directions(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    x = np.random.default_rng(5).normal(size=(N, 4))
    project = score.projector(product, vec(spark, c), tol=1e-9)
    got = columns(project(vec(spark, x)), range(4))
    assert np.allclose(got, p @ x, atol=1e-6)
    with pytest.raises(ValueError, match="unsolved"):
        score.gated(product, vec(spark, x), 1e-9, 1)
    bins = comps.selectExpr("v", "cast(v div 4 as int) as bin", "comp")
    b = linops.zt(geno, st, vec(spark, x)).join(bins, "v")
    products = {}
    for r in score.cross_products(b, b).collect():
        products.setdefault((r.bin, r.comp), {})[r.p, r.q] = r.c
    forms, cuts, m = score.directions(bins, st, products, score.pairs(vec(spark, x), vec(spark, x)), [0, 1, 2, 3])
    live = inv > 0
    assert m == 3 and np.allclose(forms[2], x.T @ x)
    for k in (0, 1):
        assert np.allclose(forms[k], x.T @ ks[k] @ x)
    edges = [e for e in range(4, M, 4) if live[:e].sum() < live.sum()]
    assert cuts.tolist() == [int(live[:e].sum()) for e in edges]
    for k, e in enumerate(edges):
        d = z[:, :e] @ z[:, :e].T / live[:e].sum() - z[:, e:] @ z[:, e:].T / live[e:].sum()
        assert np.allclose(forms[3 + k], x.T @ d @ x)


def test_draws_have_the_covariance(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    samples = spark.range(N).withColumnRenamed("id", "s")
    x = columns(score.draws(geno, st, comps, theta, 0.5, samples, 3000), range(3000))
    assert np.abs(x @ x.T / 3000 - h).max() < 0.2 * np.abs(h).max()


def test_moments_and_law(spark):
    r = np.random.default_rng(415)
    n, c = 12, 4000
    a = r.normal(size=(4, n, n))
    a = (a + a.swapaxes(1, 2)) / 2
    b = r.normal(size=(2, n, c))
    pilot, own = (score.Sketch.of(np.einsum("ic,tij,jd->tcd", x[:, :400], a, x[:, :400])) for x in b)
    info = np.einsum("tij,uij->tu", a, a) / 2
    assert np.allclose(own.information(4), info, rtol=0.3, atol=3)
    coefficients = score.nuisance_coefficients(pilot, 1)
    y = r.normal(size=n)
    q = np.einsum("i,tij,j->t", y, a, y)
    for scale in (1.0, 1e-12, 1e12):
        sizes = np.array([1, scale, scale, scale])
        forms = np.einsum("ic,tij,jd->tcd", b[1][:, :60], a * sizes[:, None, None], b[1][:, :60])
        got = score.moments(q * sizes, score.Sketch.of(forms), coefficients * sizes[1:, None], np.array([1, 2, 3]))
        if scale == 1.0:
            z = got.z
            raw = 0.5 * (q - np.diagonal(forms, axis1=1, axis2=2).mean(1))
            assert np.allclose(got.scores, raw[1:] - coefficients[:, 0] * raw[0])
            # the forms' own law has unit variance: half the squared length of each is 1
            assert np.allclose((got.forms**2).sum((1, 2)) / 2, 1)
        assert np.allclose(got.z, z)
    nothing = np.concatenate((a[:1], a[:1], a[1:3]))
    forms = np.einsum("ic,tij,jd->tcd", b[1][:, :60], nothing, b[1][:, :60])
    same = score.moments(q[[0, 0, 1, 2]], score.Sketch.of(forms), np.array([[1.0], [0.0], [0.0]]), np.array([1, 2, 3]))
    assert same.information[0] == 0 and (same.information[1:] > 0).all()
    top = score.boundary_maxima(spark, got.forms, 2000, 3)
    again = score.boundary_maxima(spark, got.forms[:1], 2000, 3)
    assert len(top) == 2000 and (top >= again - 1e-12).all() and np.array_equal(top, score.boundary_maxima(spark, got.forms, 2000, 3))
    plain = np.random.default_rng(0).normal(size=(4000, 60))
    want = np.abs(0.5 * (np.einsum("bi,tij,bj->bt", plain, got.forms, plain) - np.trace(got.forms, axis1=1, axis2=2))).max(1)
    assert abs(np.quantile(top, 0.9) - np.quantile(want, 0.9)) < 0.25
    found = score.calibrated(spark, same, 500, 3)
    assert found["untestable"] == [1] and 0 < found["p"] <= 1 and found["cut"] in (2, 3)


def test_selected_span(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    x = np.random.default_rng(2617).normal(size=(N, 3))
    for active in (x, np.column_stack([x, x[:, 0], 2 * x[:, 1]])):
        basis, rank = spans.span(vec(spark, active), N)
        assert rank == 3
        project = score.projector(product, vec(spark, c), tol=1e-10)
        parts = lambda t: linops.k_by_component(geno, st, comps, t).select("s", "comp", "r", "x")
        got = spans.span_information(basis, rank, project, parts)
        u = np.linalg.svd(x, full_matrices=False)[0]
        inner = u.T @ p @ u
        assert got["logdet"] == pytest.approx(np.linalg.slogdet(inner)[1], abs=1e-4)
        assert got["trace"] == pytest.approx(np.trace(np.linalg.inv(inner)), abs=1e-4)
        for k, d in ((0, ks[0]), (1, ks[1]), (-1, np.eye(N))):
            assert got["corrections"][k] == pytest.approx(np.trace(np.linalg.inv(inner) @ u.T @ p @ d @ p @ u), abs=1e-4)
    assert spans.span_information(basis, 0, project)["trace"] == 0.0
    inside, rank = spans.span(vec(spark, np.column_stack([x, c[:, 0]])), N)
    with pytest.raises(ValueError, match="meets the covariates"):
        spans.span_information(inside, rank, project)


def test_lasso_beside_covariates(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    r = np.random.default_rng(81)
    y, hi = r.normal(size=N), np.linalg.inv(h)
    x = r.normal(size=(N, 5))
    every = vec(spark, np.column_stack([y, c, x])).withColumn("r", __import__("pyspark").sql.functions.expr("case when r = 0 then -1 else r end").cast("long"))
    solved = pcg(product, every, tol=1e-10, maxiter=200)[0]
    q = np.abs(x.T @ p @ y).max()
    lams = np.array([10 * q, q * 0.5, q * 0.1])
    betas, fixed = spans.lasso_with_covariates(every, solved, [1, 2], [3, 4, 5, 6, 7], lams, ridge=1e-10)
    assert (betas[0] == 0).all() and np.allclose(fixed[0], np.linalg.solve(c.T @ hi @ c, c.T @ hi @ y), atol=1e-5)
    for b, f, lam in zip(betas, fixed, lams, strict=True):
        assert np.allclose(f, np.linalg.solve(c.T @ hi @ c, c.T @ hi @ (y - x @ b)), atol=1e-5)
        g = x.T @ p @ (y - x @ b)
        assert (np.abs(g) <= lam + 1e-5).all() and np.allclose(g[b != 0], lam * np.sign(b[b != 0]), atol=1e-5)


def test_warm_start_and_restart(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    b = np.random.default_rng(237).normal(size=(N, 3)) * np.array([1e-20, 1.0, 1e20])
    b[:, 1] = 0
    x, error, used = pcg(product, vec(spark, b), tol=1e-9, maxiter=200)
    want = np.linalg.solve(h, b)
    got = columns(x, range(3))
    assert all(np.allclose(got[:, k], want[:, k], rtol=1e-6, atol=1e-7 * np.abs(want[:, k]).max()) for k in range(3)) and max(error.values()) <= 1e-9
    again, error, more = pcg(product, vec(spark, b), tol=1e-8, maxiter=200, x0=x)
    assert more == 0 and max(error.values()) <= 1e-8


def test_predictions_of_both_parts(spark, dense):  # noqa: F811
    geno, st, comps, z, inv, ks = dense
    some = spark.createDataFrame([(0, 0.5), (2, -1.0)], "v long, b double")
    rest = spark.createDataFrame([(j, 0.01 * j) for j in range(M)], "v long, b double")
    q, fixed = vec(spark, np.ones((N, 1))), spark.createDataFrame([(0, 2.0)], "r long, b double")
    got = {r.s: r for r in spans.predicted(geno, st, some, rest, fixed, q).collect()}
    sparse, back = z[:, 0] * 0.5 - z[:, 2], z @ (0.01 * np.arange(M))
    assert all(np.allclose([got[i].sparse, got[i].background, got[i].nuisance, got[i].total], [sparse[i], back[i], 2.0, 2 + sparse[i] + back[i]]) for i in range(N))


def test_whole_score_test(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    y = np.random.default_rng(7).normal(size=N)
    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    bins = comps.selectExpr("v", "cast(v div 4 as int) as bin", "comp")
    found, process = score.score_test(geno, st, comps, bins, theta, 0.5, resp, vec(spark, c), draw_count=6, most=6, tol=1e9, samples=999)
    assert found["cut"] in process.cuts.tolist() and 0 < found["p"] <= 1 and found["draws"] == 6
    py, edge = p @ y, int(np.searchsorted(np.cumsum(inv > 0), process.cuts[0])) + 1
    d = z[:, :edge] @ z[:, :edge].T / process.cuts[0] - z[:, edge:] @ z[:, edge:].T / ((inv > 0).sum() - process.cuts[0])
    # the trace is what the draws say; together with it the raw score gives the form of Py back
    assert abs(process.raw[0] - 0.5 * (py @ d @ py - np.trace(p @ d))) < 6 * process.trace_error[0] + 6 * (np.trace(p @ d @ p @ d) / 2 / 6) ** 0.5


def test_core_is_exact_and_draws_have_the_rest(spark, fitted):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    project = score.projector(product, vec(spark, c), tol=1e-10)
    w, core, mix = score.core_columns(geno, st, project, spark.range(N).withColumnRenamed("id", "s"), 5)
    w, e = columns(w, range(5)), columns(core, range(5))
    assert np.allclose(e @ e.T, p @ w @ np.linalg.inv(w.T @ p @ w) @ w.T @ p, atol=1e-5)
    rest = p - e @ e.T
    assert np.linalg.eigvalsh(rest)[0] > -1e-6 and np.trace(rest @ ks[0]) < np.trace(p @ ks[0])
    # dense sketches: what is exact is exact, and the same draws know the information better
    rng = np.random.default_rng(3)
    root = np.linalg.cholesky(p + 1e-12 * np.eye(N))
    d = np.stack([ks[0], ks[1], np.eye(N)])
    want = np.einsum("aij,jk,bkl,li->ab", d, p, d, p) / 2
    errors = {0: [], 5: []}
    for _ in range(200):
        x = root @ rng.normal(size=(N, 8))
        deflated = x - e @ (mix.T @ (w.T @ x))
        plain = score.Sketch.of(np.einsum("ic,tij,jd->tcd", x, d, x))
        both = np.concatenate((e, deflated), 1)
        cored = score.Sketch.of(np.einsum("ic,tij,jd->tcd", both, d, both), 5)
        errors[0].append(plain.information(3) - want)
        errors[5].append(cored.information(3) - want)
        assert np.allclose(cored.weights()[:5, :5], 1)
    assert np.abs(np.mean(errors[5], 0)).max() < 0.15 * np.abs(want).max()
    assert (np.std(errors[5], 0) < np.std(errors[0], 0)).all()


def test_score_test_with_a_core_keeps_its_draws(spark, fitted, monkeypatch):
    geno, st, comps, z, inv, ks, theta, h, c, p, product = fitted
    y = np.random.default_rng(7).normal(size=N)
    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    bins = comps.selectExpr("v", "cast(v div 8 as int) as bin", "comp")
    asked, said = [], iter([1.0, 0.0, 0.0])
    plain = score.draws
    monkeypatch.setattr(score, "draws", lambda *a, **k: asked.append((a[6], a[8])) or plain(*a, **k))
    monkeypatch.setattr(score.Process, "imprecision", property(lambda self: next(said)))
    found, process = score.score_test(geno, st, comps, bins, theta, 0.5, resp, vec(spark, c), draw_count=3, most=6, tol=0.5, samples=199, core=5)
    assert asked == [(6, 0), (6, 6)] and found["draws"] == 6 and found["core"] == 5
    py, edge = p @ y, int(np.searchsorted(np.cumsum(inv > 0), process.cuts[0])) + 1
    d = z[:, :edge] @ z[:, :edge].T / process.cuts[0] - z[:, edge:] @ z[:, edge:].T / ((inv > 0).sum() - process.cuts[0])
    assert abs(process.raw[0] - 0.5 * (py @ d @ py - np.trace(p @ d))) < 6 * process.trace_error[0] + 0.1 * abs(np.trace(p @ np.abs(d)))


def test_span_sees_short_directions(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(N, 4))
    short = np.column_stack([a[:, 0], a[:, 0] + 1e-9 * a[:, 1], 1e6 * a[:, 2], a[:, 2] * 3, np.zeros(N)])
    basis, rank = spans.span(vec(spark, short), N)
    got = columns(basis, range(rank))
    assert rank == 3 and np.allclose(got.T @ got, np.eye(3), atol=1e-12)
    assert np.allclose(got @ got.T, np.linalg.svd(a[:, :3], full_matrices=False)[0] @ np.linalg.svd(a[:, :3], full_matrices=False)[0].T, atol=1e-5)
    with pytest.raises(ValueError, match="ambiguous"):
        spans.span(vec(spark, np.column_stack([a[:, 0], a[:, 0] + 2e-11 * a[:, 1]])), N)
    assert spans.span(vec(spark, np.zeros((N, 2))), N)[1] == 0
