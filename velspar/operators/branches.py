"""Predictions along a whole path of sparse means, each with the background that its residual leaves, from shared solves and one scan of the new genotypes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import linops
from velspar.operators.solvers import COVARIATE, KIND, OTHER, RESPONSE, Solutions, dots, residual_of, sided, solve_spd
from velspar.sources.shared import written


def path_duals(solutions: Solutions, theta: np.ndarray, geno: DataFrame, stats: DataFrame, points: DataFrame, betas: DataFrame, response: DataFrame, q: DataFrame) -> dict:
    """For every path point of points (path): fixed (path, r, b), the covariates' generalised least squares beside the sparse mean, alpha (s, r, x) with r the
    path, H⁻¹ of what mean and covariates leave of the response (s, y), and errors {path: true relative residual of alpha}.

    betas is (path, v, b), a point without rows having no effects; q is (s, r, x). Samples of geno without a response take no part. H⁻¹ of the response and the covariates is solved once for all
    points, H⁻¹ of a point's fitted mean beside them, all as sides of one solve that begins at what `solutions` knows from an earlier call. The duals are sums of
    these; each one's residual is made anew, and one that is above 1.05 of the tolerance, of its own length or of its sides' lengths added up, is an error.
    """
    spark = geno.sparkSession
    betas = betas.where("b != 0").select("v", F.col("path").cast("long").alias("r"), "b")
    sides = response.select("s").crossJoin(F.broadcast(betas.select("r").distinct()))  # path points, a few dozen: a sample without calls of a point's variants is a zero there, not absent
    fitted = sides.join(linops.z(geno, stats, betas), ["s", "r"], "left").select("s", "r", F.coalesce("x", F.lit(0.0)).alias("x"))
    y = response.select("s", F.lit(0).cast("long").alias("r"), F.col("y").cast("double").alias("x"))
    rhs = written(sided(y, RESPONSE).unionByName(sided(q, COVARIATE)).unionByName(sided(fitted, OTHER)), "path-rhs")
    solved = solutions.solve("path", theta, rhs)

    qs = q.select("s", F.col("r").cast("long").alias("i"), F.col("x").alias("q"))
    inner = {(r.i, r.r): r.d for r in qs.join(solved, "s").groupBy("i", "r").agg(F.sum(F.col("q") * F.col("x")).alias("d")).collect()}  # covariates times path points
    ranks = sorted({r.i for r in qs.select("i").distinct().collect()})
    paths = sorted(r.path for r in points.select(F.col("path").cast("long").alias("path")).distinct().collect())
    coefficients: dict[int, np.ndarray] = {}
    if ranks:
        at = lambda kind, r: np.array([inner.get((i, kind * KIND + r), 0.0) for i in ranks])
        gram = np.array([at(COVARIATE, j) for j in ranks]).T
        for p in paths:
            coefficients[p] = solve_spd((gram + gram.T) / 2, at(RESPONSE, 0) - at(OTHER, p))
    parts = [(RESPONSE * KIND, p, 1.0) for p in paths] + [(OTHER * KIND + p, p, -1.0) for p in paths]
    parts += [(COVARIATE * KIND + r, p, -float(coefficients[p][k])) for p in paths for k, r in enumerate(ranks)]
    mix = F.broadcast(spark.createDataFrame(parts, "r long, path long, c double"))  # (covariates + 2) times path points
    mixed = lambda t: t.join(mix, "r").groupBy("s", "path").agg(F.sum(F.col("x") * F.col("c")).alias("x")).select("s", F.col("path").alias("r"), "x")
    alpha, left = written(mixed(solved), "path-duals"), written(mixed(rhs), "path-residuals")
    apart = written(residual_of(lambda t: solutions.hv(theta, t), left, alpha), "path-unsolved")
    whole, rest, size = dots(left, left), dots(apart, apart), dots(rhs, rhs)
    errors = {p: (rest[p] / whole[p]) ** 0.5 if whole[p] else 0.0 for p in paths}
    bound = {p: 1.05 * solutions.tol * sum(abs(c) * size.get(r, 0.0) ** 0.5 for r, own, c in parts if own == p) for p in paths}
    bad = {p: errors[p] for p in paths if not rest[p] ** 0.5 <= max(bound[p], 1.05 * solutions.tol * whole[p] ** 0.5)}
    if bad:
        raise ValueError(f"unsolved path points: {bad}")
    fixed = spark.createDataFrame([(p, int(r), float(coefficients[p][k])) for p in paths for k, r in enumerate(ranks)], "path long, r long, b double")
    return {"fixed": fixed, "alpha": alpha, "errors": errors}


def background_effects(geno: DataFrame, stats: DataFrame, components: DataFrame, theta: np.ndarray, alpha: DataFrame) -> DataFrame:
    """(v, comp, path, b): theta_comp Z'alpha / m_eff for all points, so that Z b is a point's random effect."""
    own = F.broadcast(alpha.sparkSession.createDataFrame([(c, float(t)) for c, t in enumerate(theta[:-1])], "comp int, theta double"))  # a row per component
    b = linops.zt(geno, stats, alpha).join(components, "v").join(linops.effective(stats, components), "comp").join(own, "comp")
    return b.select("v", "comp", F.col("r").alias("path"), (F.col("b") * F.col("theta") / F.col("m_eff")).alias("b"))


def predicted_path(geno: DataFrame, training_stats: DataFrame, points: DataFrame, betas: DataFrame, background: DataFrame, fixed: DataFrame, q: DataFrame, samples: DataFrame) -> DataFrame:
    """(path, s, sparse, background, nuisance, total) of all samples (s) at all points, one scan of their genotypes for both parts of every point.

    Genotypes are put on the training statistics; q is the samples' covariates on the training basis. A sample without calls or covariates has zeros there.
    """
    part = lambda t, name: t.select("v", F.lit(name).alias("part"), F.col("path").cast("long").alias("path"), "b")
    both = part(betas.where("b != 0"), "sparse").unionByName(part(background.groupBy("v", "path").agg(F.sum("b").alias("b")), "background"))
    scores = linops.z(geno, training_stats, both, ("part", "path"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("part") == name, F.col("x"))), F.lit(0.0)).alias(name)
    wide = scores.groupBy("s", "path").agg(of("sparse"), of("background"))
    mean = q.join(F.broadcast(fixed), "r").groupBy("s", "path").agg(F.sum(F.col("x") * F.col("b")).alias("nuisance"))  # covariates times path points
    every = samples.select("s").crossJoin(F.broadcast(points.select(F.col("path").cast("long").alias("path")).distinct()))  # path points, a few dozen
    out = every.join(wide, ["s", "path"], "left").join(mean, ["s", "path"], "left")
    names = ("sparse", "background", "nuisance")
    out = out.select("path", "s", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    return out.withColumn("total", F.col("sparse") + F.col("background") + F.col("nuisance"))
