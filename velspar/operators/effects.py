"""What follows a fit: effects of variants and samples, predictions, z-scores of components, sparse parts, stopping rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import linops
from velspar.operators.score import gated
from velspar.operators.solvers import dots, solve_spd
from velspar.sources.shared import written


def estimate(product: Callable[[DataFrame], DataFrame], geno: DataFrame, stats: DataFrame, components: DataFrame, theta: DataFrame, response: DataFrame, q: DataFrame, tol: float = 1e-8) -> dict:
    """Generalised least squares and best linear unbiased prediction for H given as product.

    fixed (r, b): coefficients on the basis q; alpha (s, r, x): H⁻¹(y - Qb); random (s, comp, r, x): theta_comp K_comp alpha; variants (v, comp, b): theta_comp Z'alpha / m_eff,
    so that Z b of a component is its random effect. A solution whose residual is above 5 tol is an error.
    """
    rhs = response.select("s", F.lit(-1).cast("long").alias("r"), F.col("y").alias("x")).unionByName(q.select("s", F.col("r").cast("long").alias("r"), "x"))
    solved = gated(product, written(rhs, "effects-rhs"), tol, 200, floor=0.0)
    qs = q.select("s", F.col("r").cast("long").alias("i"), F.col("x").alias("q"))
    inner = {(r.i, r.r): r.d for r in qs.join(solved, "s").groupBy("i", "r").agg(F.sum(F.col("q") * F.col("x")).alias("d")).collect()}  # a few numbers per covariate
    ranks = sorted({i for i, _ in inner})
    b = solve_spd(np.array([[inner[i, j] for j in ranks] for i in ranks]), np.array([inner[i, -1] for i in ranks]))
    spark = response.sparkSession
    fixed = spark.createDataFrame([(int(i), float(x)) for i, x in zip(ranks, b, strict=True)], "r long, b double")
    weights = F.broadcast(spark.createDataFrame([(-1, 1.0), *((int(i), -float(x)) for i, x in zip(ranks, b, strict=True))], "r long, c double"))
    alpha = solved.join(weights, "r").groupBy("s").agg(F.sum(F.col("x") * F.col("c")).alias("x")).select("s", F.lit(0).cast("long").alias("r"), "x")
    alpha = written(alpha, "effects-alpha")
    scaled = linops.zt(geno, stats, alpha).join(components, "v").join(linops.effective(stats, components), "comp").join(theta, "comp")
    variants = scaled.select("v", "comp", (F.col("b") * F.col("theta") / F.col("m_eff")).alias("b"))
    random = linops.z(geno, stats, variants.withColumn("r", F.lit(0).cast("long")), ("comp", "r"))
    return {"fixed": fixed, "alpha": alpha, "random": random, "variants": variants}


def predicted(geno: DataFrame, training_stats: DataFrame, variants: DataFrame, fixed: DataFrame, q: DataFrame, mu: float, scale: float) -> DataFrame:
    """(s, y_pred) of new samples: their genotypes on the training statistics, their covariates on the training basis, back on the response's scale."""
    random = linops.z(geno, training_stats, variants.groupBy("v").agg(F.sum("b").alias("b")), ())
    mean = q.join(fixed, "r").groupBy("s").agg(F.sum(F.col("x") * F.col("b")).alias("f"))
    return mean.join(random, "s", "left").select("s", (F.lit(mu) + F.lit(scale) * (F.col("f") + F.coalesce("x", F.lit(0.0)))).alias("y_pred"))


def accepted(theta: np.ndarray, history: list[dict], tol: float = 1e-3) -> np.ndarray:
    """theta, if its last step was small and no variance is below zero nor the residual's at it; else an error."""
    if not history or history[-1]["step"] > tol * float(np.sum(theta)):
        raise ValueError("the fit hasn't converged")
    if (theta[:-1] < 0).any() or not theta[-1] > 0:
        raise ValueError("variance components are out of bounds")
    return theta


def z_scores(theta: np.ndarray, info: np.ndarray, n: int) -> np.ndarray:
    """z of the genetic components: standard errors from the inverse of all of n * info, the residual's rows included; 0 where there is none."""
    scaled = info * n
    scaled = scaled + 1e-8 * np.mean(np.abs(np.diag(scaled))) * np.eye(len(scaled))
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(scaled))[:-1], 0))
    return np.divide(theta[:-1], se, out=np.zeros(len(se)), where=se > 0)


def residuals(values: DataFrame, solved: DataFrame, betas: DataFrame) -> DataFrame:
    """(s, path, r, hr): for each path row y - sum of b x and H⁻¹ of it, for values and solved (s, r, x) with r = -1 the response, and betas (path, r, b)."""
    own = betas.select("path", "r", (-F.col("b")).alias("c")).unionByName(betas.select("path").distinct().select("path", F.lit(-1).cast("long").alias("r"), F.lit(1.0).alias("c")))
    both = values.join(solved.select("s", "r", F.col("x").alias("h")), ["s", "r"]).join(own, "r")
    return both.groupBy("s", "path").agg(F.sum(F.col("x") * F.col("c")).alias("r"), F.sum(F.col("h") * F.col("c")).alias("hr"))


def sparse_variance(mean: DataFrame, residual: DataFrame, trace: float, n: int) -> float:
    """Q = (g'g + 2 g'r - trace) / n of a fitted sparse mean g and residual r, both (s, r, x); it may be negative."""
    return (sum(dots(mean, mean).values()) + 2 * sum(dots(mean, residual).values()) - trace) / n


def relative_change(now: DataFrame, before: DataFrame, response: DataFrame) -> float:
    """|now - before| by the longer of both, or 1e-8 of the response where they are shorter than that; tables (s, r, x), a missing row is 0. No change of nothing is 0."""
    apart = now.join(before.select("s", "r", F.col("x").alias("o")), ["s", "r"], "full").select("s", "r", (F.coalesce("x", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))).alias("x"))
    length = lambda t: sum(dots(t, t).values()) ** 0.5
    whole = max(length(now), length(before), 1e-8 * length(response))
    return length(apart) / whole if whole else 0.0


def converged(mean_change: float, h2: float, h2_before: float, mean_tol: float = 0.05, h2_tol: float = 0.01) -> bool:
    """Whether mean and h2 stand still; a change of h2 at its tolerance counts as within it, one from or to NaN never does."""
    return mean_change <= mean_tol and abs(h2 - h2_before) <= h2_tol * (1 + 1e-9)
