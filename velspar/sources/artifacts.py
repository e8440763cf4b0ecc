"""Results kept between runs: a table and a manifest that says what made it, so that it is refused on other data, unfinished or changed."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.operators.ld import boundaries
from velspar.sources.text import require

VERSION = 1
#: Ratios of penalties agree within this relative difference.
AGREE = 1e-10


class ArtifactError(ValueError):
    """An artifact that can't be used; its subclasses say why."""


class Unfinished(ArtifactError):
    """There is no manifest: nothing was written, or a job ended before it was done."""


class OtherKind(ArtifactError):
    """Another kind of artifact, or another version of it."""


class OtherSource(ArtifactError):
    """It was made from other data."""


class Changed(ArtifactError):
    """Its rows aren't those that were written."""


class Invalid(ArtifactError):
    """Its rows are those that were written, but not what this kind of artifact may hold."""


def digest(df: DataFrame) -> str:
    """A digest of a table's names, types and rows with their repeats, the same in any order, under any partitioning and for any order of columns.

    Each row's SHA-256 is cut into four whole numbers, which are summed up exactly, so the driver sees four sums and a count.
    """
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    number = lambda k: F.conv(F.substring("h", 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")  # noqa: E731  # 60 bits each
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.sum(number(k)).alias(f"s{k}") for k in range(4)]).first()
    types = dict(df.dtypes)
    said = json.dumps([[c, types[c]] for c in columns]) + "".join(f"|{got[c] or 0}" for c in ("n", "s0", "s1", "s2", "s3"))
    return df.sparkSession.range(1).select(F.sha2(F.lit(said), 256)).first()[0]


def save(df: DataFrame, path: str, kind: str, source: str, about: dict | None = None) -> None:
    """Writes df below path, then its manifest. source is the digest of the data it was made from. What path held before stays whole until the new manifest stands."""
    rows = f"{path.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(rows)
    spark = df.sparkSession
    manifest = {"kind": kind, "version": VERSION, "source": source, "rows": rows.rsplit("/", 1)[1], "digest": digest(spark.read.parquet(rows)), "about": about or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/manifest")


def load(spark: SparkSession, path: str, kind: str, source: str) -> tuple[DataFrame, dict]:
    """(rows, about) of an artifact that is whole, of this kind and made from this source; else one of the errors above."""
    try:
        lines = spark.read.text(f"{path.rstrip('/')}/manifest").collect()  # one row
    except AnalysisException:
        lines = []
    if len(lines) != 1:
        raise Unfinished(f"no manifest at {path}")
    manifest = json.loads(lines[0][0])
    if (manifest["kind"], manifest["version"]) != (kind, VERSION):
        raise OtherKind(f"{path} holds {manifest['kind']} {manifest['version']}, not {kind} {VERSION}")
    if manifest["source"] != source:
        raise OtherSource(f"{path} was made from {manifest['source']}, not {source}")
    try:
        rows = spark.read.parquet(f"{path.rstrip('/')}/{manifest['rows']}")
        same = digest(rows) == manifest["digest"]
    except AnalysisException:
        same = False
    if not same:
        raise Changed(f"the rows of {path} aren't those of its manifest")
    return rows, manifest["about"]


# LD ranks --------------------------------------------------------------------------------------------------------


def save_ranks(ranks: DataFrame, path: str, bins: int, source: str) -> None:
    """ranks (v, rank) with the balanced cuts between `bins` bins."""
    save(ranks.select(F.col("v").cast("long").alias("v"), F.col("rank").cast("long").alias("rank")), path, "ld_ranks", source, {"cuts": boundaries(ranks.count(), bins)})


def load_ranks(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, list[int]]:
    """((v, rank), cuts): ranks are 0 to m - 1, one for each variant; there is a cut, and cuts rise inside the ranks."""
    rows, about = load(spark, path, "ld_ranks", source)
    cuts, m = about["cuts"], rows.count()
    try:
        require(rows.where("v is null or rank is null"), "nulls")
        require(rows.where((F.col("rank") < 0) | (F.col("rank") >= m)), "ranks outside the table")
        require(rows.groupBy("rank").count().where("count > 1"), "ranks that repeat")
        require(rows.groupBy("v").count().where("count > 1"), "variants that repeat")
    except ValueError as e:
        raise Invalid(f"{path}: {e}") from e
    if not cuts or any(b <= a for a, b in zip([0, *cuts], [*cuts, m], strict=True)):
        raise Invalid(f"{path}: cuts {cuts} don't rise inside {m} ranks")
    return rows, cuts


# warm starts of a lasso path -------------------------------------------------------------------------------------


def _agree(a: float, b: float) -> bool:
    return abs(a - b) <= AGREE * max(abs(a), abs(b))


def save_warm(candidates: DataFrame, selected: DataFrame, betas: DataFrame, path: str, source: str, ratio: float, ratios: list[float]) -> None:
    """Where a lasso path ended: candidates (v), the chosen point's effects selected (v, beta) at `ratio` of the largest penalty, and betas (path, v, beta), path counting the falling `ratios`.

    Effects that aren't finite, outside the candidates or of no path point, and ratios that don't fall from 1 or less to above 0 are errors.
    """
    if not ratios or any(not 0 < b < a for a, b in zip([1 + 1e-12, *ratios], ratios, strict=False)) or not 0 < ratio <= 1:
        raise ValueError(f"ratios {ratios} and {ratio} aren't a falling path")
    own = candidates.select(F.col("v").cast("long").alias("v")).distinct()
    effects = selected.select(F.lit(-1).alias("path"), "v", "beta").unionByName(betas.select("path", "v", "beta")).select(F.col("path").cast("int").alias("path"), F.col("v").cast("long").alias("v"), F.col("beta").cast("double").alias("beta"))
    require(effects.where(f"beta is null or isnan(beta) or abs(beta) = double('inf') or path is null or path < -1 or path >= {len(ratios)}"), "effects that aren't finite or of no path point")
    require(effects.groupBy("path", "v").count().where("count > 1"), "effects that repeat")
    require(effects.join(own, "v", "left_anti"), "effects outside the candidates")
    rows = own.select(F.lit(None).cast("int").alias("path"), "v", F.lit(0.0).alias("beta")).unionByName(effects.where("beta <> 0"))
    save(rows, path, "lasso_warm", source, {"ratio": ratio, "ratios": ratios})


def load_warm(spark: SparkSession, path: str, source: str, ratio: float | None = None, ratios: list[float] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(candidates (v), start (path, v, beta), number of points with a solution of their own).

    With `ratio`, path 0 starts from the chosen point, whose ratio must be that one. With `ratios`, the leading points that agree with the stored path start from
    its solutions and the others from the last of these; where not even the first agrees, all start from the chosen point.
    """
    rows, about = load(spark, path, "lasso_warm", source)
    candidates = rows.where("path is null").select("v")
    chosen = rows.where("path = -1").select("v", "beta")
    if (ratio is None) == (ratios is None):
        raise ValueError("one of ratio and ratios says what to start")
    if ratio is not None:
        if not _agree(ratio, about["ratio"]):
            raise Invalid(f"{path} was chosen at ratio {about['ratio']}, not {ratio}")
        return candidates, chosen.select(F.lit(0).alias("path"), "v", "beta"), 0
    known = 0
    while known < min(len(ratios), len(about["ratios"])) and _agree(ratios[known], about["ratios"][known]):
        known += 1
    stored = rows.where(F.col("path").between(0, known - 1)).select("path", "v", "beta")
    last = stored.where(F.col("path") == known - 1).select("v", "beta") if known else chosen
    rest = spark.range(known, len(ratios)).select(F.col("id").cast("int").alias("path"))  # a row per path point
    return candidates, stored.unionByName(last.crossJoin(F.broadcast(rest)).select("path", "v", "beta")), known
