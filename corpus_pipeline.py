"""A corpus pipeline: drop toxic documents, delete repeated lines, keep one of each near-duplicate group, blot out secrets, pack.

A stage takes documents (doc_id, text, lang, source, n_chars) and whatever columns come besides, which all but the last stage drop. Null and empty
texts pass each filter but the near-duplicates', where equal ones are one class; a null doc_id, lang or source stays null; rows that repeat a
doc_id are rows of their own, and copies of one row stay or go together; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.llm import lines, omh, packing, secrets, toxicity
from velspar.llm.common import written
from velspar.llm.queries import TOKENIZERS, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic, unchanged; it is fitted on labelled rows of docs, and without any predicts none as toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that stood before; one that loses all lines stays, empty."""
    return _shaped(lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id, a null one first; rows equal in doc_id and text stay together."""
    return omh.near_duplicates(docs).where("kept").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, a mark in place of each secret; a null text stays null."""
    found = secrets.scan_history(docs, secrets.new_ledger(spark))
    return _shaped(found.withColumn("text", secrets.redacted(F.col("text"), F.col("findings"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null or empty text is its end token alone."""
    return packing.pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL can't say what the classifier, the sketches and the tokenizer do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents of sf_dir, each written to the shared folder and read again; returns what packing returns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
