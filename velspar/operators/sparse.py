"""Weighted lasso paths over many variants: candidates are screened, solved on a small Gram matrix, and certified on all variants."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import linops, selection
from velspar.operators.solvers import lasso_path
from velspar.operators.stats import standardised
from velspar.sources.shared import written

#: A linear map of tables (s, r, x): the weight of the quadratic form, H⁻¹ or its projection beside covariates.
Weight = Callable[[DataFrame], DataFrame]


def columns(geno: DataFrame, stats: DataFrame, chosen: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(s, r, x): the standardised columns of a bounded set of variants (v), r the variant.

    With samples (s) a column has a row for each of them and no other, 0 where the call is missing, as solvers need it: to them a sample without a row is outside the system.
    """
    got = standardised(geno.join(chosen, "v", "left_semi"), stats).select("s", F.col("v").alias("r"), F.col("z").alias("x"))
    if samples is None:
        return got
    every = samples.select("s").crossJoin(F.broadcast(chosen.select(F.col("v").alias("r"))))  # the bounded set
    return every.join(got, ["s", "r"], "left").select("s", "r", F.coalesce("x", F.lit(0.0)).alias("x"))


def scores(geno: DataFrame, stats: DataFrame, response: DataFrame, betas: DataFrame, weight: Weight) -> DataFrame:
    """(v, path, score): Z' W (y - Z b) for every path point of betas (path, v, b) in one scan each way; points without effects are those of response (s, path, x)."""
    fitted = linops.z(geno, stats, betas.select("v", F.col("path").alias("r"), "b")).withColumn("x", -F.col("x"))
    left = response.select("s", F.col("path").alias("r"), "x").unionByName(fitted.select("s", "r", "x")).groupBy("s", "r").agg(F.sum("x").alias("x"))
    return linops.zt(geno, stats, weight(written(left, "sparse-residuals"))).select("v", F.col("r").alias("path"), F.col("b").alias("score"))


def certified_path(geno: DataFrame, stats: DataFrame, response: DataFrame, lams: np.ndarray, weight: Weight = lambda t: t, first: int = 50, block: int = 10, tol: float = 1e-4) -> tuple[DataFrame, list[dict]]:
    """((path, lam, v, b), history) of the lasso on all variants at falling penalties.

    A block of penalties is solved on the candidates; then all variants are scored at all its points. The longest run of points
    without a violator outside the candidates is accepted; the violators, or the next variants by score, join the candidates, and the rest
    is solved anew. response is (s, y). The driver holds the candidates' Gram matrix.
    """
    spark = geno.sparkSession
    y0 = response.select("s", F.lit(0).cast("long").alias("r"), F.col("y").alias("x"))
    q = written(linops.zt(geno, stats, weight(y0)).select("v", F.col("b").alias("score")), "sparse-scores")
    held = [r.v for r in selection.screened(q, first).collect()]
    linear = {r.v: r.score for r in q.where(F.col("v").isin(held)).collect()}
    done, rows, history, known = 0, [], [], {}
    while done < len(lams):
        new = [v for v in held if (v, v) not in known]
        if new:
            chosen = F.broadcast(spark.createDataFrame([(v,) for v in new], "v long"))  # the candidates, a bounded set
            got = linops.zt(geno, stats, weight(columns(geno, stats, chosen, response))).where(F.col("v").isin(held))
            for r in got.collect():
                known[r.v, r.r] = known[r.r, r.v] = r.b
        gram = np.array([[known.get((a, b), 0.0) for b in held] for a in held])
        span = lams[done : done + block]
        betas = lasso_path(gram, np.array([linear[v] for v in held]), span, tol=tol * 1e-3)
        found = [(done + i, int(v), float(betas[i, k])) for i in range(len(span)) for k, v in enumerate(held) if betas[i, k]]
        ys = y0.select("s", F.explode(F.sequence(F.lit(done).cast("long"), F.lit(done + len(span) - 1).cast("long"))).alias("path"), "x")
        s = scores(geno, stats, ys, spark.createDataFrame(found, "path long, v long, b double"), weight)
        at = F.broadcast(spark.createDataFrame([(done + i, float(x)) for i, x in enumerate(span)], "path long, lam double"))
        over = s.where(~F.col("v").isin(held)).join(at, "path").where(F.abs("score") > F.col("lam") + selection.kkt_tolerance(F.col("lam"), tol, tol))
        bad = over.groupBy("path").agg(F.max(F.abs("score")).alias("most")).orderBy("path").limit(1).collect()
        until = bad[0].path if bad else done + len(span)
        rows += [(p, float(lams[p]), v, b) for p, v, b in found if p < until]
        history.append({"from": done, "until": int(until), "candidates": len(held)})
        done = int(until)
        if bad:
            more = over.where(F.col("path") == until).orderBy(F.desc(F.abs("score")), "v").limit(first).collect()
            held += [r.v for r in more]
            linear |= {r.v: r.score for r in q.where(F.col("v").isin([r.v for r in more])).collect()}
    return spark.createDataFrame(rows, "path long, lam double, v long, b double"), history


def validated(geno: DataFrame, training_stats: DataFrame, path: DataFrame, outcome: DataFrame) -> DataFrame:
    """Metrics of each path point on other samples: their genotypes on the training statistics, outcome (s, y)."""
    yhat = linops.z(geno, training_stats, path.select("v", "path", "b"), ("path",))
    every = outcome.crossJoin(F.broadcast(path.select("path").distinct()))  # path points, a few dozen
    return selection.path_metrics(every.join(yhat, ["s", "path"], "left").select("path", "s", F.coalesce("x", F.lit(0.0)).alias("yhat"), "y"))
