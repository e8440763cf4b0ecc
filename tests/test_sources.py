"""Text scans, BED files and alignment on small files written here."""

import json

import pytest
from pyspark.sql import functions as F

from velspar.operators import align
from velspar.sources import bed, text


def put(tmp_path, name, said):
    (tmp_path / name).write_text(said)
    return str(tmp_path / name)


def test_samples_and_keep(spark, tmp_path):
    fam = text.read_fam(spark, put(tmp_path, "a.fam", "f1 b 0 0 0 -9\n\nf2   a 0 0 0 -9\nlonely\nf3\td 0 0 0 1\n"))
    assert [tuple(r) for r in fam.orderBy("sample_idx").collect()] == [(0, "b"), (1, "a"), (2, "d")]
    with pytest.raises(ValueError, match="duplicate"):
        text.read_fam(spark, put(tmp_path, "b.fam", "f a 0\nf a 0\n"))
    psam = text.read_psam(spark, put(tmp_path, "a.psam", "#FID IID SEX\nf x 1\nf y 2\n"))
    assert [r.iid for r in psam.orderBy("sample_idx").collect()] == ["x", "y"]
    assert sorted(r.iid for r in text.read_keep(spark, put(tmp_path, "k", "f x\ny\n")).collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="empty"):
        text.read_keep(spark, put(tmp_path, "k2", "\n"), strict=True)


def test_phenotypes_and_covariates(spark, tmp_path):
    ph = text.read_pheno(spark, put(tmp_path, "p", "f a 1.5\nf b -9\nf c NA\nf d -9.0\nf e x\nf g inf\n"))
    assert {r.iid: r.pheno for r in ph.collect()} == {"a": 1.5, "g": float("inf")}
    cov = text.read_covar(spark, put(tmp_path, "c", "f a 1 2\nf b 3 nan\nf c 5 6\n"))
    assert {r.iid: r["cov"] for r in cov.collect()} == {"a": [1.0, 2.0], "c": [5.0, 6.0]}
    with pytest.raises(ValueError, match="without 2 values"):
        text.read_covar(spark, put(tmp_path, "c2", "f a 1 2\nf b 3 4\nf c 5\n"))


def test_variants_and_ld_tables(spark, tmp_path):
    bim = text.read_bim(spark, put(tmp_path, "v.bim", "1 v2 0 10 A C\n1 v1 0 20 G T\n2 v3 0 5 A G\n"))
    assert [r.variant_id for r in bim.orderBy("variant_idx").collect()] == ["v2", "v1", "v3"]
    pvar = text.read_pvar(spark, put(tmp_path, "v.pvar", "##x\n#CHROM POS ID REF ALT\n1 10 r1 C A,G\n")).collect()[0]
    assert (pvar.a1, pvar.a2, pvar.cm, pvar.bp) == ("A", "C", ".", "10")
    scores = text.read_ld_scores(spark, put(tmp_path, "ld", "ID\tx\tld_score\nv1\t0\t1.5\nv3\t0\t3.5\nv2\t0\t2.5\n"), bim)
    assert [r.ld_score for r in scores.orderBy("variant_idx").collect()] == [2.5, 1.5, 3.5]
    with pytest.raises(ValueError, match="absent from the genotypes"):
        text.read_ld_scores(spark, put(tmp_path, "ld2", "ID\tld_score\nv1\t1\nv2\t1\nv3\t1\nv9\t1\n"), bim)
    from velspar.operators import ld

    vcor = text.read_vcor(spark, put(tmp_path, "x.vcor", "#ID_A\tID_B\tUNPHASED_R2\nv1\tv2\t0.25\nv1\tv3\t0.5\nv2\tv2\t1\n"))
    assert [r.ld_score for r in ld.scores_of_vcor(bim, vcor).orderBy("variant_idx").collect()] == [1.25, 1.75, 1.5]
    with pytest.raises(ValueError, match="r2"):
        ld.scores_of_vcor(bim, vcor.withColumn("r2", F.lit(1.1)))


def test_components_admixture_weights(spark, tmp_path):
    spec = text.read_components(spark, put(tmp_path, "c.json", json.dumps({"components": [{"name": "x", "variant_indices": [2, 0]}, {"variant_indices": [1, 2, 9]}]})))
    assert [(r.name, r.variant_indices) for r in spec.orderBy("component_idx").collect()] == [("x", [2, 0]), ("component_001", [1, 2, 9])]
    found = {tuple(r) for r in align.partition_problems(spec, 4, full=True).collect()}
    assert found == {("out of range", 1, 9), ("repeated", 0, 2), ("left out", None, 3)}
    fam = text.read_fam(spark, put(tmp_path, "q.fam", "f a 0\nf b 0\n"))
    q = text.read_admixture(spark, put(tmp_path, "a.2.Q", "0.25 0.75\n-0.0000001 1\n"), fam).orderBy("sample_idx").collect()
    assert q[0].q == [0.25, 0.75] and q[1].q == [0.0, 1.0]
    with pytest.raises(ValueError, match="sum to 1"):
        text.read_admixture(spark, put(tmp_path, "b.2.Q", "0.25 0.5\n0 1\n"), fam)
    w = text.read_weights(spark, put(tmp_path, "w.csv", "1,0.5\n0.5,2\n"))
    assert {(r.i, r.j): r.w for r in w.collect()} == {(0, 0): 1.0, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 2.0}
    with pytest.raises(ValueError, match="square"):
        text.read_weights(spark, put(tmp_path, "w2.csv", "1,0.5\n"))


def test_bed(spark, tmp_path):
    import random

    r = random.Random(2)
    n, m = 7, 30
    calls = [[r.choice([0, 1, 2, None]) for _ in range(n)] for _ in range(m)]
    code = {2: 0, None: 1, 1: 2, 0: 3}
    raw = bytearray(bed.MAGIC)
    for v in calls:
        for a in range(0, n, 4):
            raw.append(sum(code[g] << (2 * k) for k, g in enumerate(v[a : a + 4])))
    path = tmp_path / "x.bed"
    path.write_bytes(bytes(raw))
    blocks = bed.read_bed(spark, str(path), n)
    got = {(x.v, x.s): x.g for x in bed.unpacked(blocks, n).collect()}
    assert got == {(v, s): calls[v][s] for v in range(m) for s in range(n)}
    one = blocks.select("variant_idx", bed.dosage(bed.code(F.col("packed"), F.lit(5))).alias("g")).collect()
    assert {x.variant_idx: x.g for x in one} == {v: calls[v][5] for v in range(m)}


def test_cohorts(spark):
    fam = spark.createDataFrame([(0, "b"), (1, "a"), (2, "d"), (3, "c")], "sample_idx int, iid string")
    train, val = (spark.createDataFrame(x, "iid string, pheno double") for x in ([("a", 1.0), ("c", 3.0)], [("b", 2.0), ("d", 4.0)]))
    got = align.combined_fit(fam, train, val).orderBy("sample_idx").collect()
    assert [(r.iid, r.pheno) for r in got] == [("b", 2.0), ("a", 1.0), ("d", 4.0), ("c", 3.0)]
    with pytest.raises(ValueError, match="overlap"):
        align.combined_fit(fam, train, train)
    with pytest.raises(ValueError, match="overlap"):
        align.combined_fit(fam, train, val, val)
    with pytest.raises(ValueError, match="lack"):
        align.combined_fit(fam, train, spark.createDataFrame([("z", 1.0)], "iid string, pheno double"))
    assert align.same_values(train, train).isEmpty() and align.same_values(train, val).count() == 4
    assert align.first_order_mismatch(fam, fam).isEmpty()
    assert align.first_order_mismatch(fam, fam.where("sample_idx < 3")).collect()[0].sample_idx == 3
    ph = spark.createDataFrame([("a", 1.0), ("d", 2.0), ("c", 3.0)], "iid string, pheno double")
    cov = spark.createDataFrame([("a", [1.0]), ("c", [2.0])], "iid string, cov array<double>")
    keep = spark.createDataFrame([("a",)], "iid string")
    assert {r.iid: r.status for r in align.aligned(fam, ph, cov, keep).collect()} == {"a": "kept", "b": "invalid", "c": "excluded", "d": "invalid"}
