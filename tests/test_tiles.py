"""Packed tiles against the long table and dense algebra, and how little they move."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_algebra import M, N, back, dense, vec  # noqa: F401
from velspar.operators import linops, order, solvers, tiles
from velspar.sources.bed import MAGIC


@pytest.mark.parametrize(("block", "chunk", "limit"), [(512, 4096, 1 << 26), (4, 8, 1 << 26), (4, 8, 0)])
def test_products_on_tiles(spark, dense, monkeypatch, block, chunk, limit):  # noqa: F811
    geno, st, comps, z, inv, ks = dense
    monkeypatch.setattr(tiles, "BROADCAST", limit)
    t = tiles.pack(geno, block, chunk)
    assert sorted(map(tuple, t.calls().collect())) == sorted(map(tuple, linops.calls(geno).collect()))
    x = np.random.default_rng(5).normal(size=(N, 19))
    v = vec(spark, x)
    assert np.allclose(back(linops.zt(t, st, v), (M, 19), "v", "b"), z.T @ x)
    assert np.allclose(back(linops.k(t, st, v), (N, 19)), z @ z.T @ x / (inv > 0).sum())
    theta = spark.createDataFrame([(0, 0.3), (1, 0.2)], "comp int, theta double")
    h = 0.3 * ks[0] + 0.2 * ks[1] + 0.5 * np.eye(N)
    assert np.allclose(back(linops.h(t, st, comps, theta, 0.5, v), (N, 19)), h @ x)
    for c in (0, 1):
        assert np.allclose(back(linops.k_by_component(t, st, comps, v).where(F.col("comp") == c), (N, 19)), ks[c] @ x)
    none = spark.createDataFrame([(j, 0.5) for j in range(M)], "v long, b double")
    got = {r.s: r.x for r in linops.z(t, st, none, ()).collect()}
    assert np.allclose([got[i] for i in range(N)], z.sum(1) / 2)


def test_pcg_on_tiles(spark, dense):  # noqa: F811
    geno, st, comps, z, inv, ks = dense
    theta = spark.createDataFrame([(0, 0.3), (1, 0.2)], "comp int, theta double")
    t = tiles.pack(geno, 8, 8)
    b = np.random.default_rng(9).normal(size=(N, 2))
    x, error, _ = solvers.pcg(lambda y: linops.h(t, st, comps, theta, 0.5, y), vec(spark, b), tol=1e-9)
    assert np.allclose(back(x, (N, 2)), np.linalg.solve(0.3 * ks[0] + 0.2 * ks[1] + 0.5 * np.eye(N), b), rtol=1e-6) and max(error.values()) < 1e-8


def test_partial_sums_are_bounded(spark, dense, monkeypatch):  # noqa: F811
    geno, st, comps, z, inv, ks = dense
    t = tiles.pack(geno, 4, 8)
    rows = t.table.crossJoin(spark.createDataFrame([(0, [(i, 1.0, 0.0) for i in range(0, 8 * tiles.SIDES, tiles.SIDES)])], "rg int, sides array<struct<at:int,a:double,c:double>>"))
    batches = rows.toArrow().to_batches()
    whole = tiles._partial(iter(batches), "vb", tiles._zt)
    monkeypatch.setattr(tiles, "HELD", 1)
    parts = tiles._partial(iter(batches), "vb", tiles._zt)
    total = lambda found: sum(sum(b["p"].to_pylist()) for b in found)
    assert total(parts) == pytest.approx(total(whole))


@pytest.mark.parametrize("keep", [None, [0, 3, 4, 9]])
def test_tiles_of_bed(spark, tmp_path, keep):
    rng = np.random.default_rng(11)
    samples, variants = 10, 23
    codes = rng.integers(0, 4, (variants, samples))
    path = tmp_path / "x.bed"
    full = np.zeros((variants, 12), np.uint8)
    full[:, :samples] = codes
    four = full.reshape(variants, 3, 4)
    path.write_bytes(MAGIC + (four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6).astype(np.uint8).tobytes())
    t = tiles.from_bed(spark, str(path), samples, keep, block=5, chunk=4)
    want = {(s, v, {0: 2, 2: 1, 3: 0}[int(codes[v, s])]) for v in range(variants) for s in (keep or range(samples)) if codes[v, s] != 1}
    assert {tuple(r) for r in t.calls().collect()} == want and (t.m, t.n) == (variants, len(keep or range(samples)))
    with pytest.raises(ValueError, match="ascending"):
        tiles.from_bed(spark, str(path), samples, [3, 1])


def test_tiles_move_less(spark):
    """Bytes shuffled by one Z'x and Z b, tiles against the long table."""
    rng = np.random.default_rng(12)
    n, m, r = 400, 150, 4
    geno = spark.range(n).select(F.col("id").alias("s")).crossJoin(spark.range(m).select(F.col("id").alias("v"))).withColumn("g", F.pmod(F.xxhash64("s", "v"), F.lit(3)).cast("int")).cache()
    from velspar.operators import stats

    st = stats.variant_stats(geno).cache()
    x = vec(spark, rng.normal(size=(n, r))).cache()
    t = tiles.pack(geno, 64, 128)
    st.count(), x.count()

    gateway = spark.sparkContext._gateway
    status, none = spark.sparkContext._jsc.sc().statusStore(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        return status.stageList(None, False, False, none, None)

    def moved(frame) -> int:
        known = stages()
        before = {(known.apply(i).stageId(), known.apply(i).attemptId()) for i in range(known.size())}
        frame.write.format("noop").mode("overwrite").save()
        found = stages()
        after = [found.apply(i) for i in range(found.size())]
        return sum(x.shuffleWriteBytes() for x in after if (x.stageId(), x.attemptId()) not in before)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long_bytes, tile_bytes = moved(linops.k(geno, st, x)), moved(linops.k(t, st, x))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < tile_bytes < long_bytes / 4


def test_numbers_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.lit(1).alias("other"))
    got = order.numbered(rows, "a", size=64)
    assert sorted((r.a, r.number) for r in got.collect()) == [(i, i) for i in range(1000)]
    assert order.numbered(rows.limit(0), "a").count() == 0
