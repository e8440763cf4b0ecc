"""The pipeline's stages, each on its predecessor's rows."""

import os

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        from velspar.llm.common import written

        out = written(stage(spark, docs, SF), name)
        assert out.columns == pipeline.COLUMNS
        assert out.select("doc_id").distinct().count() == out.count() <= before
        if name in ("line_dedup", "secret_scan"):
            assert out.count() == before and out.where(F.length("text") != F.col("n_chars")).isEmpty()
        docs, before = out, out.count()
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert pipeline.run(spark, SF).count() == packed.count()


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, extra columns and an empty table go through every stage."""
    rows = [(1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x\ny\ntoken=abcdefgh", "en", "s", 18), (4, "x\ny\nz z", "en", "s", 7), (4, "x\ny\nz z", "en", "s", 7), (5, "a b c", "de", "s", 5)]
    docs = spark.createDataFrame([(*r, "more", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part string, score string")
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == pipeline.COLUMNS, name
        packed = pipeline.STAGES[-1][1](spark, out, SF)
        kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        if given is docs:
            assert kept == sorted([(1, None), (None, "a b c"), (3, "x\ny\n[secret]"), (4, "z z"), (4, "z z")], key=repr), kept
            assert packed.count() == len(kept)
        else:
            assert not kept and packed.count() == 0
