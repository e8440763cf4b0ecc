"""Certified lasso paths against the whole design; output tables."""

import numpy as np

from tests.test_algebra import M, N, dense  # noqa: F401
from velspar.operators import sparse, stats
from velspar.operators.solvers import lasso_path
from velspar.sources import sinks


def test_certified_path_equals_the_whole_design(spark, dense):  # noqa: F811
    geno, st, _, z, _, _ = dense
    y = np.random.default_rng(13).normal(size=N)
    resp = spark.createDataFrame([(i, float(y[i])) for i in range(N)], "s long, y double")
    lams = np.abs(z.T @ y).max() * np.array([1.0, 0.7, 0.4, 0.2])
    want = lasso_path(z.T @ z, z.T @ y, lams)
    got, history = sparse.certified_path(geno, st, resp, lams, first=3, block=3)
    found = np.zeros((4, M))
    for r in got.collect():
        found[r.path, r.v] = r.b
    assert np.allclose(found, want, atol=1e-3) and len(history) > 2
    metrics = {r.path: r for r in sparse.validated(geno, st, got, resp).collect()}
    for p in metrics:
        assert abs(metrics[p].mse - ((y - z @ want[p]) ** 2).mean()) < 1e-2


def test_tables(spark, tmp_path):
    found = spark.createDataFrame([(1, 0.25, 3, float("nan"), 0.5, 0.5, 0.5, 1.0, 0.123456789012), (0, 0.5, 4, 1.0, 0.5, 0.5, 0.5, 1.0, 0.5)], "v int, af double, n_obs int, beta double, se double, beta_std double, se_std double, t double, p double")
    variants = spark.createDataFrame([(i, "1", f"v{i}", "0", "5", "A", "C") for i in (0, 1)], "variant_idx int, chrom string, variant_id string, cm string, bp string, a1 string, a2 string")
    comps = spark.createDataFrame([(0, "all", 0, 0), (0, "all", 1, 1)], "component_index int, component_name string, v int, variant_index_local int")
    sinks.written_tsv(sinks.gwas_table(found, variants, comps), str(tmp_path / "g"), ["variant_index_global"], about={"n": 2})
    back = spark.read.csv(str(tmp_path / "g.tsv"), sep="\t", header=True).collect()
    assert tuple(back[0].asDict()) == sinks.GWAS
    by = {r.variant_id: r for r in back}
    assert by["v1"].beta == "nan" and by["v1"].p == "0.12345679" and spark.read.text(str(tmp_path / "g.json")).first().value == '{"n": 2}'
    assert stats.rare_entries(spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, None)], "s int, v int, g int")).count() == 2
