"""Several block-weighted kernels against dense algebra."""

import numpy as np
import pytest

from velspar.operators import blocks, tiles
from velspar.sources.shared import written

from .test_algebra import M, N, back, dense, vec  # noqa: F401


@pytest.fixture(scope="module")
def kernels(spark, dense):  # noqa: F811
    """Kernel 0: blocks of 1, 4 and 10 variants; kernel 1: one of 6, other variants in none."""
    rng = np.random.default_rng(8)
    layout = {0: [range(0, 1), range(1, 5), range(5, 15)], 1: [range(2, 14, 2)]}
    w, rows = {k: np.zeros((M, M)) for k in layout}, []
    for k, parts in layout.items():
        for number, part in enumerate(parts):
            root = rng.normal(size=(len(part), len(part)))
            w[k][np.ix_(part, part)] = root @ root.T
            rows += [(k, number, i, j, float(w[k][i, j])) for i in part for j in part]
    return written(spark.createDataFrame(rows, "kernel int, block int, i long, j long, w double"), "test-blocks"), w


@pytest.mark.parametrize("packed", [False, True])
def test_products_diagonals_and_effects(spark, dense, kernels, packed):  # noqa: F811
    geno, st, _, z, _, _ = dense
    entries, w = kernels
    entries = blocks.checked(entries)
    geno = tiles.pack(geno, 4, 8) if packed else geno
    raw = [z @ w[k] @ z.T for k in (0, 1)]
    scales = blocks.trace_scales(geno, st, entries, N)
    assert {r.kernel: r.c for r in scales.collect()} == pytest.approx({k: np.trace(raw[k]) / N for k in (0, 1)})
    want = [k / (np.trace(k) / N) for k in raw]
    x = np.random.default_rng(3).normal(size=(N, 2))
    got = written(blocks.products(geno, st, entries, scales, vec(spark, x)), "test-products")
    for k in (0, 1):
        assert np.allclose(back(got.where(f"kernel = {k}"), (N, 2)), want[k] @ x)
        d = {r.s: r.d for r in blocks.diagonals(geno, st, entries, scales).where(f"kernel = {k}").collect()}
        assert np.allclose([d[i] for i in range(N)], np.diag(want[k]))
    theta = spark.createDataFrame([(0, 0.3), (1, 0.5)], "kernel int, theta double")
    assert np.allclose(back(blocks.h(geno, st, entries, scales, theta, 0.2, vec(spark, x)), (N, 2)), 0.2 * x + 0.3 * want[0] @ x + 0.5 * want[1] @ x)
    b = blocks.effects(geno, st, entries, scales, theta, vec(spark, x)).where("kernel = 1")
    assert np.allclose(z @ back(b, (M, 2), "v", "b"), 0.5 * want[1] @ x)


def test_effective_ranks_are_checked(spark, kernels):
    entries, _ = kernels
    right = [(0, 0, 1.0), (0, 1, 2.5), (0, 2, 10.0), (1, 0, 0.5)]
    table = lambda rows: spark.createDataFrame(rows, "kernel int, block int, rank double")
    assert {r.kernel: r.c for r in blocks.rank_scales(entries, table(right)).collect()} == {0: 13.5, 1: 0.5}
    for wrong in ([*right[:2], (0, 2, 10.5), right[3]], [*right[:3], (1, 0, 0.0)], right[:3], [*right, (1, 1, 1.0)], [*right, right[0]], [*right[:3], (1, 0, float("nan"))]):
        with pytest.raises(ValueError, match="effective ranks"):
            blocks.rank_scales(entries, table(wrong))


def test_wrong_entries_are_errors(spark, dense):  # noqa: F811
    table = lambda rows: spark.createDataFrame(rows, "kernel int, block int, i long, j long, w double")
    for rows, match in (
        ([(0, 0, 1, 1, float("nan"))], "finite"),
        ([(0, 0, 1, 1, 1.0), (0, 0, 1, 1, 1.0)], "twice"),
        ([(0, 0, 1, 1, 1.0), (0, 0, 1, 2, 0.5), (0, 0, 2, 2, 1.0)], "symmetric"),
        ([(0, 0, 1, 1, 1.0), (0, 1, 1, 1, 1.0)], "two blocks"),
    ):
        with pytest.raises(ValueError, match=match):
            blocks.checked(table(rows))
    geno, st, *_ = dense
    with pytest.raises(ValueError, match="positive trace"):  # variant 7 doesn't vary
        blocks.trace_scales(geno, st, table([(0, 0, 7, 7, 1.0)]), N)
