"""Secret scans over a ledger of blobs: each text is scanned once for each version of the rules, wherever it occurs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velspar.llm.common import shared_dir, written

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the rules.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names the rules by what they say, so that a changed rule scans anew.
RULE_VERSION = hashlib.sha256(repr([r.pattern for r in (ASSIGN, ACCESS, HEX)] + [6, 20, 24]).encode()).hexdigest()[:16]
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("findings", FINDINGS)])


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed. Leftmost matches of a kind don't overlap; those too short are dropped.

    Maximal runs of 24 or more hexadecimal digits are the same matches as all runs with the shorter ones dropped.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t or "")] for t in batch.column("__text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob").cast(pa.string()), pa.array([RULE_VERSION] * len(found), pa.string()), pa.array(found, kind)], names=["blob", "rule_version", "findings"])


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(LEDGER).parquet(path) if exists else spark.createDataFrame([], LEDGER)


def scan_history(history: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """All rows of history (any columns: paths, versions) with blob, the SHA-256 of the text, and findings.

    Texts of one content are one blob: only blobs that the ledger, a Parquet folder, lacks for RULE_VERSION are
    scanned; their findings are appended to it, those without any too. Then findings, one row for each blob however often a ledger
    names it (two runs may have appended at once), join back to every row.
    A third of all rows may hold one text: each map task sends one row of it to be scanned; where rows join back, adaptive execution splits it.
    Null texts count as empty; repeated rows stay; an empty table gives an empty result. Columns of history named
    blob or findings are replaced. Running it twice on one ledger scans nothing the second time.
    """
    spark = history.sparkSession
    named = history.drop("blob", "findings").withColumn("blob", F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
    blobs = named.groupBy("blob").agg(F.first(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("__text"))
    done = _ledger(spark, ledger).where(F.col("rule_version") == RULE_VERSION)
    blobs.join(done.select("blob"), "blob", "left_anti").mapInArrow(_scan, LEDGER).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION).groupBy("blob").agg(F.first("findings").alias("findings"))
    return named.join(written(known, "ledger-known"), "blob")  # written, since adaptive execution splits no join that shares its exchange with a grouping


def new_ledger(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def redacted(text, findings, mark: str = "[secret]"):
    """text with each found span replaced by mark: the pieces between the spans, which are sorted by start and may overlap."""
    n = F.size(findings)
    # reach[i]: the furthest end of the first i spans
    reach = F.aggregate(findings, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x["end"]))))
    parts = F.transform(
        F.arrays_zip(F.concat(findings, F.array(F.lit(None).cast(FINDINGS.elementType))).alias("f"), reach.alias("r")),
        lambda x, i: F.when(i == n, F.substring(text, (x["r"] + 1).cast("int"), F.length(text)))
        .when(x["f"]["start"] >= x["r"], F.concat(F.substring(text, (x["r"] + 1).cast("int"), (x["f"]["start"] - x["r"]).cast("int")), F.lit(mark)))
        .otherwise(F.lit("")),
    )
    return F.when(n > 0, F.array_join(parts, "")).otherwise(text)
