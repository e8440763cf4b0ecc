"""Metrics of prediction paths, choice of a penalty, certificates of optimality, candidates, merging of components, heritability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_metrics(pred: DataFrame) -> DataFrame:
    """(path, correlation, correlation_squared, mse, slope, r2) of predictions (path, s, yhat, y): r2 = 1 - SSE / SST; null where a side is constant."""
    x, y = F.col("yhat"), F.col("y")
    got = pred.groupBy("path").agg(
        F.covar_pop("yhat", "y").alias("c"), F.avg((y - x) * (y - x)).alias("mse"), F.sum((y - x) * (y - x)).alias("sse"), F.var_pop("y").alias("vy"), F.var_pop("yhat").alias("vx"), F.count("*").alias("n")
    )
    corr = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return got.select(
        "path", corr.alias("correlation"), (corr * corr).alias("correlation_squared"), "mse",
        F.when(F.col("vx") > 0, F.col("c") / F.col("vx")).alias("slope"), F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("vy") * F.col("n"))).alias("r2"),
    )


def select_path(rows: DataFrame, certified: bool = False) -> DataFrame:
    """The row of (path, r2, k, lam_ratio[, kkt]) with the highest r2, ties to fewer effects, then the larger penalty."""
    return (rows.where("kkt") if certified else rows).where("r2 is not null").orderBy(F.desc("r2"), "k", F.desc("lam_ratio"), "path").limit(1)


def early_stop(rows: DataFrame, lag: int = 5) -> DataFrame:
    """(path, stop): whether the best r2 of the earlier points is strictly above the best of the last `lag`; a path has a few hundred rows at most."""
    order = Window.orderBy("path")
    recent, earlier = F.max("r2").over(order.rowsBetween(-(lag - 1), 0)), F.max("r2").over(order.rowsBetween(Window.unboundedPreceding, -lag))
    return rows.select("path", F.coalesce(earlier > recent, F.lit(False)).alias("stop"))


def lambda_grid(spark: SparkSession, lam_max: float, min_ratio: float, n: int) -> DataFrame:
    """(path, lam) falling from lam_max to lam_max * min_ratio in equal logarithmic steps, both ends exact; 0 alone if lam_max is 0."""
    if lam_max == 0 or n == 1:
        return spark.createDataFrame([(0, float(lam_max))], "path long, lam double")
    step = F.exp(F.log(F.lit(min_ratio)) * F.col("id") / (n - 1))
    lam = F.when(F.col("id") == 0, F.lit(1.0)).when(F.col("id") == n - 1, F.lit(min_ratio)).otherwise(step)
    return spark.range(n).select(F.col("id").alias("path"), (lam * lam_max).alias("lam"))


def kkt_tolerance(lam: Column, abs_tol: float, rel_tol: float) -> Column:
    return F.greatest(F.lit(abs_tol), F.lit(rel_tol) * F.greatest(F.lit(1.0), lam))


def kkt_certificate(scores: DataFrame, abs_tol: float = 1e-4, rel_tol: float = 1e-4) -> DataFrame:
    """(path, active_error, inactive_error, passed) of (path, v, score, beta, lam): |score - lam sign(beta)| of active, |score| - lam of other variants."""
    active = F.max(F.when(F.col("beta") != 0, F.abs(F.col("score") - F.col("lam") * F.signum("beta"))))
    other = F.max(F.when(F.col("beta") == 0, F.greatest(F.abs("score") - F.col("lam"), F.lit(0.0))))
    got = scores.groupBy("path").agg(F.coalesce(active, F.lit(0.0)).alias("active_error"), F.coalesce(other, F.lit(0.0)).alias("inactive_error"), F.max("lam").alias("lam"))
    return got.select("path", "active_error", "inactive_error", (F.greatest("active_error", "inactive_error") <= kkt_tolerance(F.col("lam"), abs_tol, rel_tol)).alias("passed"))


def kkt_violators(scores: DataFrame, candidates: DataFrame, lam: float, abs_tol: float = 1e-4, rel_tol: float = 1e-4) -> DataFrame:
    """(v, score) outside the candidates (v) whose |score| passes lam by more than the tolerance."""
    return scores.join(candidates, "v", "left_anti").where(F.abs("score") > lam + kkt_tolerance(F.lit(lam), abs_tol, rel_tol)).select("v", "score")


def screened(scores: DataFrame, top: int) -> DataFrame:
    """The `top` variants by |score|, ties to the smaller v: a top-k report, each task sends `top` rows."""
    return scores.orderBy(F.desc(F.abs("score")), "v").limit(top)


def candidates(support: DataFrame, screened_rows: DataFrame, target: int) -> DataFrame:
    """(v, place): the support first, then screened variants by |score| up to `target` in all, numbered by v."""
    old = support.select("v").distinct()
    size = old.count()
    new = screened_rows.join(old, "v", "left_anti").orderBy(F.desc(F.abs("score")), "v").limit(max(0, target - size)).select("v")
    both = old.union(new)  # at most target + support rows, a bounded set
    return both.select("v", (F.row_number().over(Window.orderBy("v")) - 1).alias("place"))


#: Fixed value: the one-sided 5 % point of the normal distribution.
Z_CUTOFF = 1.6448536269514722


def merge_weak(components: DataFrame, z_cutoff: float = Z_CUTOFF) -> DataFrame:
    """(name, members, variants) of (comp, z, variants): components from the cutoff on stay, all weaker ones become one background; a single weak one stays as it is."""
    weak = F.col("z") < z_cutoff
    n_weak = components.agg(F.sum(weak.cast("int")).alias("n")).first().n or 0
    name = F.when(weak & F.lit(n_weak > 1), "background").otherwise(F.concat(F.lit("component_"), F.col("comp").cast("string")))
    got = components.withColumn("name", name).groupBy("name").agg(F.sort_array(F.collect_list("comp")).alias("members"), F.sort_array(F.flatten(F.collect_list("variants"))).alias("variants"))
    return got


def heritability(theta: DataFrame, sparse: float = 0.0) -> DataFrame:
    """(h2) of (theta, atom, kind genetic or residual): the trace-weighted share of genetic variance, a sparse part on both sides; NaN if the whole isn't positive."""
    part = F.col("theta") * F.col("atom")
    got = theta.agg(F.coalesce(F.sum(F.when(F.col("kind") == "genetic", part)), F.lit(0.0)).alias("g"), F.coalesce(F.sum(F.when(F.col("kind") != "genetic", part)), F.lit(0.0)).alias("e"))
    top, whole = F.col("g") + sparse, F.col("g") + F.col("e") + sparse
    return got.select(F.when(whole > 0, top / whole).otherwise(F.lit(float("nan"))).alias("h2"))


def merged_diagnostics(path_rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Both tables by path; where they share a column, that of metrics wins."""
    own = [c for c in path_rows.columns if c == "path" or c not in metrics.columns]
    return path_rows.select(*own).join(metrics, "path", "left")


def finite_or_null(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def effect_table(background: DataFrame, sparse: DataFrame, variants: DataFrame) -> DataFrame:
    """(v, chrom, bp, comp, beta_sparse, beta_background, beta_total) over all variants, in source order when sorted by v."""
    got = variants.join(background.select("v", F.col("b").alias("beta_background")), "v", "left").join(sparse.select("v", F.col("b").alias("beta_sparse")), "v", "left")
    s, b = F.coalesce("beta_sparse", F.lit(0.0)), F.coalesce("beta_background", F.lit(0.0))
    return got.select("v", "chrom", "bp", "comp", s.alias("beta_sparse"), b.alias("beta_background"), (s + b).alias("beta_total"))


def prediction_table(parts: DataFrame, fixed: DataFrame, components: list[int], mu: float, scale: float) -> DataFrame:
    """(s, fixed_effect, random_effect, y_pred_std, y_pred, random_component_NNN ...) of parts (s, comp, x) and fixed (s, x)."""
    names = [f"random_component_{c:03d}" for c in components]
    wide = parts.groupBy("s").pivot("comp", components).agg(F.sum("x"))
    wide = wide.select("s", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(n) for c, n in zip(components, names, strict=True)])
    total = sum((F.col(n) for n in names), F.lit(0.0))
    got = fixed.select("s", F.col("x").alias("fixed_effect")).join(wide, "s", "left").fillna(0.0, subset=names)
    got = got.withColumn("random_effect", total).withColumn("y_pred_std", F.col("fixed_effect") + F.col("random_effect"))
    return got.select("s", "fixed_effect", "random_effect", "y_pred_std", (F.lit(mu) + F.lit(scale) * F.col("y_pred_std")).alias("y_pred"), *names)
