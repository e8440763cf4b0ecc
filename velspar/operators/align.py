"""Samples, phenotypes, covariates and cohorts: alignment, transforms and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velspar.sources.text import duplicates, require


def aligned(fam: DataFrame, pheno: DataFrame, covar: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """fam (sample_idx, iid) with pheno, cov and status: kept, invalid (no phenotype or covariates) or excluded (not in keep).

    Only samples that are valid in all tables stay; the keep list is applied after that. Order is sample_idx.
    """
    got = fam.join(pheno.select("iid", "pheno"), "iid", "left")
    valid = F.col("pheno").isNotNull()
    if covar is not None:
        got = got.join(covar.select("iid", "cov"), "iid", "left")
        valid = valid & F.col("cov").isNotNull()
    wanted: Column = F.lit(True)
    if keep is not None:
        got = got.join(keep.select("iid").distinct().withColumn("__keep", F.lit(True)), "iid", "left")
        wanted = F.col("__keep").isNotNull()
    status = F.when(~valid, "invalid").when(~wanted, "excluded").otherwise("kept")
    return got.withColumn("status", status).drop("__keep")


def fit_transform(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, sd, used): per covariate its mean and population standard deviation; constant ones aren't used."""
    tall = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("t")).select("t.*")
    return tall.groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).withColumn("used", F.col("sd") > 0)


def transformed(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """rows with z_<name> of each used covariate, by the statistics of the rows that were fitted."""
    stats = {r.name: r for r in fitted.collect()}  # one row per covariate
    return rows.select("*", *[((F.col(c) - stats[c].mean) / stats[c].sd).alias(f"z_{c}") for c in columns if stats[c].used])


def first_order_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """The first place at which two sample lists (sample_idx, iid) differ; no row if they agree."""
    both = left.alias("l").join(right.alias("r"), "sample_idx", "full")
    return both.where(~F.col("l.iid").eqNullSafe(F.col("r.iid"))).select("sample_idx", F.col("l.iid").alias("left_iid"), F.col("r.iid").alias("right_iid")).orderBy("sample_idx").limit(1)


def cohort_conflicts(train: DataFrame, validation: DataFrame, prediction: DataFrame | None = None) -> DataFrame:
    """(problem, iid): samples in two cohorts that must not share any, and phenotypes that differ between tables (iid, pheno)."""
    shared = train.select("iid").intersect(validation.select("iid")).select(F.lit("train and validation").alias("problem"), "iid")
    if prediction is not None:
        fit = train.select("iid").union(validation.select("iid")).distinct()
        shared = shared.union(prediction.select("iid").intersect(fit).select(F.lit("prediction and fit"), "iid"))
    return shared


def combined_fit(fam: DataFrame, train: DataFrame, validation: DataFrame, prediction: DataFrame | None = None) -> DataFrame:
    """(sample_idx, iid, pheno) of the union of both cohorts, in source order, after the checks."""
    require(cohort_conflicts(train, validation, prediction), "cohorts overlap")
    both = train.select("iid", "pheno").union(validation.select("iid", "pheno"))
    require(both.join(fam, "iid", "left_anti").select("iid"), "samples that the genotypes lack")
    require(both.where("pheno is null").select("iid"), "samples without a phenotype of their own")
    return fam.join(both, "iid").select("sample_idx", "iid", "pheno")


def same_values(left: DataFrame, right: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """(iid, left, right) where (iid, pheno) tables differ: an id in one only, or values apart by more than the tolerances."""
    both = left.select("iid", F.col("pheno").alias("left")).join(right.select("iid", F.col("pheno").alias("right")), "iid", "full")
    return both.where(F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > atol + rtol * F.abs("right")))


def partition_problems(components: DataFrame, n_variants: int, full: bool = False) -> DataFrame:
    """(problem, component_idx, v): indices out of range, repeated in one or several components and, if full, empty components and variants left out."""
    tall = components.select("component_idx", F.explode("variant_indices").alias("v"))
    out = tall.where((F.col("v") < 0) | (F.col("v") >= n_variants)).select(F.lit("out of range").alias("problem"), "component_idx", "v")
    twice = tall.groupBy("v").agg(F.count("*").alias("n"), F.min("component_idx").alias("component_idx")).where("n > 1")
    out = out.union(twice.select(F.lit("repeated"), "component_idx", "v"))
    if full:
        every = components.sparkSession.range(n_variants).select(F.col("id").alias("v"))
        out = out.union(every.join(tall, "v", "left_anti").select(F.lit("left out"), F.lit(None).cast("int"), "v"))
        out = out.union(components.where("size(variant_indices) = 0").select(F.lit("empty"), "component_idx", F.lit(None).cast("long")))
    return out


def variant_mismatch(train: DataFrame, test: DataFrame) -> DataFrame:
    """(variant_idx, train, test) of variants that two manifests hold differently, order included."""
    cols = [c for c in train.columns if c != "variant_idx"]
    a, b = (d.select("variant_idx", F.struct(*cols).alias(n)) for d, n in ((train, "train"), (test, "test")))
    return a.join(b, "variant_idx", "full").where(~F.col("train").eqNullSafe(F.col("test")))


def block_plan(variants: DataFrame, width: int) -> DataFrame:
    """variants (v, comp) with block and place: runs of at most `width` variants that never straddle a component."""
    place = F.row_number().over(Window.partitionBy("comp").orderBy("v")) - 1
    return variants.withColumn("__p", place).withColumn("block", F.floor(F.col("__p") / width).cast("int")).withColumn("place", (F.col("__p") % width).cast("int")).drop("__p")


__all__ = ["aligned", "block_plan", "cohort_conflicts", "combined_fit", "duplicates", "first_order_mismatch", "fit_transform", "partition_problems", "same_values", "transformed", "variant_mismatch"]
