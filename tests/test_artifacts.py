"""Artifacts between runs: round trips, and an error of its own for each way in which one can't be used."""

import glob

import pytest
from pyspark.sql import functions as F

from velspar.sources import artifacts, text


def ranks_of(spark, m=500):
    return spark.range(m).select(F.col("id").alias("v"), F.pmod(F.col("id") * 7 + 3, F.lit(m)).alias("rank"))


def test_digest_is_that_of_the_rows(spark):
    rows = ranks_of(spark).withColumn("x", F.when(F.col("v") % 5 != 0, F.col("v") / 7))
    said = artifacts.digest(rows)
    assert said == artifacts.digest(rows.repartition(7, "rank").select("x", "rank", "v")) == artifacts.digest(rows.orderBy(F.desc("v")).coalesce(1))
    other = [rows.where("v < 499"), rows.unionByName(rows.limit(1)), rows.withColumn("x", F.coalesce("x", F.lit(0.0))), rows.withColumn("v", F.col("v").cast("int")), rows.withColumnRenamed("x", "y"), rows.withColumn("rank", F.when(F.col("rank") < 2, 1 - F.col("rank")).otherwise(F.col("rank")))]
    assert len({said, *map(artifacts.digest, other)}) == 7
    assert artifacts.digest(rows.limit(0)) == artifacts.digest(rows.where("v < 0")) != said


def test_ranks(spark, tmp_path):
    rows, at = ranks_of(spark), str(tmp_path / "ranks")
    source = artifacts.digest(rows.select("v"))
    with pytest.raises(artifacts.Unfinished):
        artifacts.load_ranks(spark, at, source)
    artifacts.save_ranks(rows, at, 8, source)
    for _ in range(2):  # written again in its place
        got, cuts = artifacts.load_ranks(spark, at, source)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) and cuts == [i * 500 // 8 for i in range(1, 8)]
        artifacts.save_ranks(rows.repartition(5), at, 8, source)
    with pytest.raises(artifacts.OtherSource):
        artifacts.load_ranks(spark, at, artifacts.digest(rows.select("v").where("v > 0")))
    with pytest.raises(artifacts.OtherKind):
        artifacts.load_warm(spark, at, source, ratio=0.5)
    for bad, bins in [(rows.withColumn("rank", F.col("rank") + 1), 8), (rows.withColumn("rank", F.least("rank", F.lit(498))), 8), (rows.unionByName(rows.limit(1)), 8), (rows, 1)]:
        artifacts.save_ranks(bad, str(tmp_path / "bad"), bins, source)
        with pytest.raises(artifacts.Invalid):
            artifacts.load_ranks(spark, str(tmp_path / "bad"), source)
    for folder in glob.glob(f"{at}/rows-*"):
        rows.limit(3).write.mode("append").parquet(folder)
    with pytest.raises(artifacts.Changed):
        artifacts.load_ranks(spark, at, source)


def test_warm_start_of_a_path(spark, tmp_path):
    at, source = str(tmp_path / "warm"), "s"
    candidates = spark.createDataFrame([(3,), (5,), (9,)], "v long")
    selected = spark.createDataFrame([(5, 0.5), (9, 0.0)], "v long, beta double")
    betas = spark.createDataFrame([(1, 5, 0.25), (2, 5, 0.5), (2, 3, -0.125)], "path int, v long, beta double")
    artifacts.save_warm(candidates, selected, betas, at, source, 0.3, [1.0, 0.6, 0.3])
    rows = lambda d: sorted(map(tuple, d.collect()))
    own, start, known = artifacts.load_warm(spark, at, source, ratio=0.3 * (1 + 1e-12))
    assert rows(own) == [(3,), (5,), (9,)] and rows(start) == [(0, 5, 0.5)] and known == 0
    with pytest.raises(artifacts.Invalid):
        artifacts.load_warm(spark, at, source, ratio=0.31)
    _, start, known = artifacts.load_warm(spark, at, source, ratios=[1.0, 0.6, 0.2, 0.1])  # two points agree, the others start at the second
    assert known == 2 and rows(start) == [(1, 5, 0.25), (2, 5, 0.25), (3, 5, 0.25)]
    _, start, known = artifacts.load_warm(spark, at, source, ratios=[0.9, 0.6])
    assert known == 0 and rows(start) == [(0, 5, 0.5), (1, 5, 0.5)]
    _, start, known = artifacts.load_warm(spark, at, source, ratios=[1.0, 0.6, 0.3])
    assert known == 3 and rows(start) == [(1, 5, 0.25), (2, 3, -0.125), (2, 5, 0.5)]
    stray = spark.createDataFrame([(1, 4, 0.25)], "path int, v long, beta double")
    for bad in [dict(betas=stray), dict(betas=betas.withColumn("path", F.lit(3))), dict(selected=selected.withColumn("beta", F.lit(float("nan")))), dict(ratios=[1.0, 0.6, 0.6]), dict(ratio=0.0)]:
        with pytest.raises(ValueError):
            artifacts.save_warm(**{**dict(candidates=candidates, selected=selected, betas=betas, path=str(tmp_path / "no"), source=source, ratio=0.3, ratios=[1.0, 0.6, 0.3]), **bad})


def test_variants_beside_a_source(spark, tmp_path):
    (tmp_path / "a.bim").write_text("1 rs1 0 100 A G\n1 rs2 0 200 C T\n")
    (tmp_path / "b.pvar").write_text("#CHROM POS ID REF ALT\n1 100 rs1 G A\n")
    assert [r.variant_id for r in text.read_variants(spark, str(tmp_path / "a.bed")).orderBy("variant_idx").collect()] == ["rs1", "rs2"]
    assert text.read_variants(spark, str(tmp_path / "b")).first().a1 == "A"
    with pytest.raises(ValueError, match="beside"):
        text.read_variants(spark, str(tmp_path / "c"))
