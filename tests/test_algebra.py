"""Products, solvers and selection against dense algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from velspar.functions.tails import incomplete_beta
from velspar.operators import gwas, ld, linops, selection, solvers, stats

N, M = 24, 15


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (N, M)).astype(float)
    g[rng.random((N, M)) < 0.1] = np.nan
    g[:, 7] = 1.0
    mean, sd = np.nanmean(g, 0), np.nanstd(g, 0)
    inv = np.where(sd > 0, 1 / np.maximum(sd, 1e-3), 0.0)
    z = np.nan_to_num((g - mean) * inv)
    rows = [(i, j, None if math.isnan(g[i, j]) else int(g[i, j])) for i in range(N) for j in range(M)]
    geno = spark.createDataFrame(rows, "s long, v long, g int").cache()
    comps = spark.createDataFrame([(j, j % 2) for j in range(M)], "v long, comp int").cache()
    ks = [z[:, c::2] @ z[:, c::2].T / (inv[c::2] > 0).sum() for c in (0, 1)]
    return geno, stats.variant_stats(geno).cache(), comps, z, inv, ks


def vec(spark, x):
    return spark.createDataFrame([(i, r, float(x[i, r])) for i in range(x.shape[0]) for r in range(x.shape[1])], "s long, r long, x double")


def back(df, shape, row="s", value="x"):
    out = np.zeros(shape)
    for t in df.collect():
        out[t[row], t["r"]] = t[value]
    return out


def test_products(spark, dense):
    geno, st, comps, z, inv, ks = dense
    x = np.random.default_rng(5).normal(size=(N, 2))
    v = vec(spark, x)
    assert np.allclose(back(linops.zt(geno, st, v), (M, 2), "v", "b"), z.T @ x)
    assert np.allclose(back(linops.k(geno, st, v), (N, 2)), z @ z.T @ x / (inv > 0).sum())
    theta = spark.createDataFrame([(0, 0.3), (1, 0.2)], "comp int, theta double")
    assert np.allclose(back(linops.h(geno, st, comps, theta, 0.5, v), (N, 2)), (0.3 * ks[0] + 0.2 * ks[1] + 0.5 * np.eye(N)) @ x)
    for c in (0, 1):
        assert np.allclose(back(linops.k_by_component(geno, st, comps, v).where(F.col("comp") == c), (N, 2)), ks[c] @ x)
    w = spark.createDataFrame([(j, float(j)) for j in range(M)], "v long, w double")
    assert np.allclose(back(linops.k_weighted(geno, st, w, 3.0, v), (N, 2)), z @ np.diag(np.arange(M)) @ z.T @ x / 3)
    blocks = spark.createDataFrame([(i, j, 1.0 if i == j else 0.5) for i in range(4) for j in range(4)], "i long, j long, w double")
    dense_w = np.full((4, 4), 0.5) + 0.5 * np.eye(4)
    assert np.allclose(back(linops.k_blocks(geno, st, blocks, 2.0, v), (N, 2)), z[:, :4] @ dense_w @ z[:, :4].T @ x / 2)
    assert linops.block_scale(geno, st, blocks, N) == pytest.approx(np.trace(z[:, :4] @ dense_w @ z[:, :4].T) / N)
    core = {(r.p, r.q): r.c for r in linops.projected_core(geno, st, v, True).collect()}
    want = x.T @ (z @ z.T / (inv > 0).sum()) @ x - np.eye(2)
    assert all(core[p, q] == pytest.approx(want[p, q]) for p in (0, 1) for q in (0, 1))
    d = {r.s: r.d for r in stats.relationship_diagonal(geno, st).collect()}
    assert np.allclose([d[i] for i in range(N)], np.diag(z @ z.T) / (inv > 0).sum())
    q = np.random.default_rng(6).dirichlet([1, 1], N)
    qs = spark.createDataFrame([(i, a, float(q[i, a])) for i in range(N) for a in (0, 1)], "s long, a int, q double")
    got = linops.admixed(v, qs, lambda t: linops.k(geno, st, t)).where("a = 1")
    root = np.diag(np.sqrt(q[:, 1]))
    assert np.allclose(back(got, (N, 2)), root @ (z @ z.T / (inv > 0).sum()) @ root @ x)


def test_products_of_entries_alone(spark, dense):
    geno, st, _, z, inv, _ = dense
    entries = geno.where("g is null or g > 0")
    own = stats.sparse_stats(entries, st.select("v"), N)
    assert sorted(own.collect()) == sorted(st.select(*own.columns).collect())
    x = np.random.default_rng(21).normal(size=(N, 2))
    v = vec(spark, x)
    assert np.allclose(back(linops.zt_sparse(entries, own, v), (M, 2), "v", "b"), z.T @ x)
    b = np.random.default_rng(22).normal(size=(M, 2))
    table = spark.createDataFrame([(j, r, float(b[j, r])) for j in range(M) for r in (0, 1)], "v long, r long, b double")
    assert np.allclose(back(linops.z_sparse(entries, own, table, geno.select("s").distinct()), (N, 2)), z @ b)
    assert linops.zt_sparse(entries.limit(0), own, v.limit(0)).count() == 0


def test_associations(spark, dense):
    geno, st, _, z, inv, _ = dense
    rng = np.random.default_rng(8)
    y, c = rng.normal(size=N), rng.normal(size=(N, 2))
    resp = stats.standardised_response(spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double"))
    cov = spark.createDataFrame([(i, float(c[i, 0]), float(c[i, 1]), float(2 * c[i, 0] + 3)) for i in range(N)], "s long, a double, b double, dup double")
    q = gwas.basis(cov, ["a", "b", "dup"])
    assert q.select("r").distinct().count() == 3
    ys = (y - y.mean()) / (y.std() + 1e-6)
    basis, _ = np.linalg.qr(np.column_stack([np.ones(N), c]))
    e = ys - basis @ (basis.T @ ys)
    got = {r.v: r for r in gwas.associations(geno, st, resp, q, N).collect()}
    cnt = {r.v: r.cnt for r in st.collect()}
    for j in range(M):
        if not inv[j]:
            assert math.isnan(got[j].beta) and math.isnan(got[j].p)
            continue
        var = cnt[j] - ((basis.T @ z[:, j]) ** 2).sum()
        b = z[:, j] @ e / var
        se = math.sqrt(max(e @ e - b * (z[:, j] @ e), 0) / (N - 4) / var)
        assert got[j].beta_std == pytest.approx(b) and got[j].t == pytest.approx(b / se) and 0 <= got[j].p <= 1


def test_t_tail():
    # Student's t has closed forms for 1 and 2 degrees of freedom
    t = np.array([0.0, 0.3, 1.0, 2.5, 12.0])
    assert np.allclose(incomplete_beta(np.full(5, 0.5), 0.5, 1 / (1 + t * t)), 1 - 2 * np.arctan(t) / np.pi, atol=1e-12)
    assert np.allclose(incomplete_beta(np.full(5, 1.0), 0.5, 2 / (2 + t * t)), 1 - t / np.sqrt(2 + t * t), atol=1e-12)


def test_solvers(spark, dense):
    geno, st, comps, z, inv, ks = dense
    theta = spark.createDataFrame([(0, 0.3), (1, 0.2)], "comp int, theta double")
    h = 0.3 * ks[0] + 0.2 * ks[1] + 0.5 * np.eye(N)
    product = lambda t: linops.h(geno, st, comps, theta, 0.5, t)
    b = np.zeros((N, 3))
    b[:, :2] = np.random.default_rng(9).normal(size=(N, 2)) * [1.0, 1e6]
    x, error, steps = solvers.pcg(product, vec(spark, b), tol=1e-8)
    assert np.allclose(back(x, (N, 3)), np.linalg.solve(h, b), rtol=1e-5) and max(error.values()) < 1e-6 and steps <= N + 2
    value, se = solvers.logdet(product, geno.select("s").distinct(), N, count=8, steps=10)
    assert abs(value - np.linalg.slogdet(h)[1]) < 5 * se + 0.5
    samples = geno.select("s").distinct()
    parts = lambda t: linops.k_by_component(geno, st, comps, t).select("s", "comp", "r", "x").unionByName(t.select("s", F.lit(2).alias("comp"), "r", "x"))
    same, slopes = solvers.logdet_slopes(product, parts, 3, samples, N, count=8, steps=10)
    assert same == pytest.approx(value)

    def at(coefficients):
        """The quadrature that logdet makes, on dense matrices."""
        dense_h = coefficients[0] * ks[0] + coefficients[1] * ks[1] + coefficients[2] * np.eye(N)
        signs = back(solvers.probes(samples, 8), (N, 8))
        total = 0.0
        for u in signs.T / N**0.5:
            q, before, beta, a, e = u, 0 * u, 0.0, [], []
            for _ in range(10):
                w = dense_h @ q
                a.append(q @ w)
                w = w - a[-1] * q - beta * before
                beta = np.linalg.norm(w)
                e.append(beta)
                q, before = w / beta, q
            total += N * solvers.quadrature(np.diag(a) + np.diag(e[:-1], 1) + np.diag(e[:-1], -1), np.zeros((0, 10, 10)))[0] / 8
        return total

    assert at([0.3, 0.2, 0.5]) == pytest.approx(value)
    for c in range(3):
        shift = 1e-5 * np.eye(3)[c]
        assert slopes[c] == pytest.approx((at([0.3, 0.2, 0.5] + shift) - at([0.3, 0.2, 0.5] - shift)) / 2e-5, rel=1e-4, abs=1e-4)
    with pytest.raises(ValueError, match="positive"):
        solvers.pcg(lambda t: t.select("s", "r", (-F.col("x")).alias("x")), vec(spark, b))


def test_affine_determinants(spark, dense):
    geno, st, comps, z, inv, ks = dense
    samples = geno.select("s").distinct()
    own = z @ z.T / (inv > 0).sum()
    line = solvers.lanczos(lambda t: linops.k(geno, st, t), samples, N, count=4, steps=16)  # K has 15 eigenvalues that differ, so the quadrature is exact
    signs = back(solvers.probes(samples, 4), (N, 4))
    values, vectors = np.linalg.eigh(own)
    for a, e in ((0.4, 0.5), (1.5, 0.1)):
        inside = (vectors.T @ signs) ** 2
        want = (inside * np.log(a * values + e)[:, None]).sum() / 4
        got = solvers.affine_logdet(line, N, a, e)
        slopes = [(inside * (w / (a * values + e))[:, None]).sum() / 4 for w in (values, np.ones(N))]
        assert np.allclose(got, [want, *slopes], rtol=1e-6)


def test_reml_reaches_a_stationary_point(spark, dense):
    geno, st, comps, z, inv, ks = dense
    rng = np.random.default_rng(10)
    y = z @ rng.normal(size=M) * 0.3 + rng.normal(size=N)
    y = (y - y.mean()) / y.std()
    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    q = gwas.basis(resp, [])
    one = stats.variant_stats(geno).select("v", F.lit(0).alias("comp"))
    k = z @ z.T / (inv > 0).sum()

    def hv(theta, t):
        return linops.h(geno, st, one, spark.createDataFrame([(0, float(theta[0]))], "comp int, theta double"), float(theta[1]), t)

    parts = lambda t: linops.k_by_component(geno, st, one, t).select("s", "comp", "r", "x")
    theta, history = solvers.fit_reml(hv, parts, resp, q, resp.select("s"), np.array([0.3, 0.7]), traces=12, rounds=2, quadrature_of=(12, 5), halvings=1)

    def loglik(t):
        h = t[0] * k + t[1] * np.eye(N)
        hi, x = np.linalg.inv(h), np.ones((N, 1))
        p = hi - hi @ x @ np.linalg.inv(x.T @ hi @ x) @ x.T @ hi
        return -0.5 * (np.linalg.slogdet(h)[1] + np.linalg.slogdet(x.T @ hi @ x)[1] + y @ p @ y)

    best = max(loglik((a, e)) for a in np.linspace(0, 2, 41) for e in np.linspace(0.05, 2, 40))
    assert loglik(theta) > best - 1.0 and history[0]["round"] == 0
    said = [h["objective"] for h in history]
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(said, said[1:], strict=False)) and all(0 <= h["kkt"] < np.inf for h in history)


def test_bounded_step_and_lasso():
    rng = np.random.default_rng(12)
    a = rng.normal(size=(4, 4))
    info = a @ a.T + np.eye(4)
    for _ in range(20):
        theta = np.append(rng.uniform(0, 0.2, 3), 0.5)
        d = solvers.bounded_step(rng.normal(size=4), info, theta, 0.01)
        assert (theta + d >= np.append(np.zeros(3), 0.01) - 1e-9).all()
    x = rng.normal(size=(60, 12))
    gram, q = x.T @ x, x.T @ rng.normal(size=60)
    lams = np.array([np.abs(q).max(), 5.0, 1.0, 0.0])
    path = solvers.lasso_path(gram, q, lams)
    assert not path[0].any() and np.allclose(path[3], np.linalg.solve(gram, q), atol=1e-6)
    for b, lam in zip(path, lams, strict=True):
        s = q - gram @ b
        assert np.all(np.abs(s[b == 0]) <= lam + 1e-5) and np.allclose(s[b != 0], lam * np.sign(b[b != 0]), atol=1e-5)


def test_ranks_and_cuts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 1.0, 1.0, 2.0, 4.0])], "v long, ld_score double")
    got = ld.ranked(df).orderBy("rank").collect()
    assert [r.v for r in got] == [1, 2, 3, 0, 4] and ld.boundaries(5, 4) == [1, 2, 3]
    assert [r.bin for r in ld.bins_of(ld.ranked(df), 5, 4).orderBy("rank").collect()] == [0, 1, 2, 3, 3]
    parts = spark.createDataFrame([(r, 0 if r < 4 else 1) for r in range(10)], "rank long, comp int")
    assert ld.interior_cuts(parts) == [4]
    odd = spark.createDataFrame([(r, 0 if r in (0, 1, 2, 3, 4, 8) else 1) for r in range(12)], "rank long, comp int")
    whole = sorted(ld.intervals(odd).collect())
    assert whole == [(0, 0, 8, 6, 2), (1, 5, 11, 6, 2)] and all(sorted(ld.intervals(odd, size).collect()) == whole for size in (1, 2, 3, 5))
    moved, theta = ld.split_component(parts, spark.createDataFrame([(0, 0.4), (1, 0.6)], "comp int, theta double"), 6)
    assert ld.interior_cuts(moved) == [4, 6]
    assert [round(r.theta, 6) for r in theta.orderBy("comp").collect()] == [0.4, 0.2, 0.4]
    with pytest.raises(ValueError, match="components"):
        ld.split_component(parts, theta, 4)
    with pytest.raises(ValueError, match="intervals"):
        ld.interior_cuts(spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "rank long, comp int"))


def test_ld_scores_of_any_blocks(spark, dense):
    geno = dense[0]
    at = [(j, None if j == 14 else j % 2, j * 30) for j in range(M)]
    variants = spark.createDataFrame(at, "v long, chrom int, bp long")
    g = np.full((N, M), np.nan)
    for r in geno.where("g is not null").collect():
        g[r.s, r.v] = r.g
    want = np.ones(M)
    for a in range(M - 1):
        for b in range(M - 1):
            both = ~np.isnan(g[:, a]) & ~np.isnan(g[:, b])
            if a != b and a % 2 == b % 2 and abs(a - b) * 30 <= 120 and g[both, a].std() > 0 and g[both, b].std() > 0:
                want[a] += np.corrcoef(g[both, a], g[both, b])[0, 1] ** 2
    for width, chunk in ((2, 5), (128, 4096)):
        got = {r.v: r.ld_score for r in ld.ld_scores(geno, variants, 120, width=width, chunk=chunk).collect()}
        assert np.allclose([got[j] for j in range(M)], want)
    assert [r.ld_score for r in ld.ld_scores(geno.limit(0), variants, 120).collect()] == [1.0] * M


def test_selection_rules(spark):
    rows = spark.createDataFrame([(0, 0.5, 3, 0.1, True), (1, 0.5, 2, 0.1, True), (2, 0.5, 2, 0.3, False), (3, None, 1, 1.0, True)], "path int, r2 double, k int, lam_ratio double, kkt boolean")
    assert selection.select_path(rows).first().path == 2 and selection.select_path(rows, certified=True).first().path == 1
    flat = spark.createDataFrame([(i, 0.5) for i in range(12)], "path int, r2 double")
    assert flat.count() == 12 and selection.early_stop(flat).where("stop").isEmpty()
    down = spark.createDataFrame([(i, -float(i)) for i in range(12)], "path int, r2 double")
    assert selection.early_stop(down).where("stop").agg(F.min("path")).first()[0] == 5
    assert [r.lam for r in selection.lambda_grid(spark, 0.0, 0.1, 5).collect()] == [0.0]
    pred = spark.createDataFrame([(0, i, 1.0, float(i)) for i in range(4)], "path int, s int, yhat double, y double")
    m = selection.path_metrics(pred).first()
    assert m.correlation is None and m.slope is None and m.r2 is not None
    single = spark.createDataFrame([(0, 3.0, [1]), (1, 0.5, [2])], "comp int, z double, variants array<int>")
    assert {r.name for r in selection.merge_weak(single).collect()} == {"component_0", "component_1"}
    h = spark.createDataFrame([(0.0, 1.0, "residual")], "theta double, atom double, kind string")
    assert math.isnan(selection.heritability(h).first().h2)
    assert [r.x for r in spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double").select(selection.finite_or_null(F.col("x")).alias("x")).collect()] == [1.0, None, None]
