"""Marginal association: each variant against the response, covariates projected out of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.functions.tails import two_sided_t
from velspar.operators import linops


def basis(covar: DataFrame, columns: list[str]) -> DataFrame:
    """(s, r, x): an orthonormal basis of the intercept and the columns, r counting from 0; dependent columns are left out.

    Modified Gram-Schmidt on the columns' Gram matrix: one aggregate over the samples gives all inner products, the factor of a few
    columns is made on the driver, and one projection applies it.
    """
    import numpy as np

    names = ["__one", *columns]
    rows = covar.select("s", F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in columns])
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first() if columns else {}
    rows = rows.select("s", "__one", *[(F.col(c) - F.lit(means[c])).alias(c) for c in columns])
    p = len(names)
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    factors: list[np.ndarray] = []  # coefficients of each basis vector
    for i in range(p):
        c = np.eye(p)[i]
        for _ in range(2):
            for f in factors:
                c = c - (f @ gram @ c) * f
        norm = float(c @ gram @ c)
        if norm > 1e-10 * max(gram[i, i], 1e-300):
            factors.append(c / norm**0.5)
    vectors = [sum((F.col(n) * float(w) for n, w in zip(names, f, strict=True)), F.lit(0.0)) for f in factors]
    return rows.select("s", F.posexplode(F.array(*vectors)).alias("r", "x"))


def associations(geno: DataFrame, stats: DataFrame, response: DataFrame, q: DataFrame, n: int, p_values: bool = True) -> DataFrame:
    """(v, af, n_obs, beta, se, beta_std, se_std, t[, p]) of the standardised response (s, y) on each variant, given the basis q.

    The sum of squares of a standardised variant is its number of calls; missing calls are 0. A variant without variation, or that the
    basis explains to 1e-8, has NaN throughout; one with no standard error keeps beta_std alone.
    """
    rank = q.select("r").distinct().count()
    dof = n - rank - 1
    if dof <= 0:
        raise ValueError(f"{n} samples leave no degrees of freedom beside {rank} covariates")
    on = q.join(response, "s").groupBy("r").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    fitted = q.join(on, "r").groupBy("s").agg(F.sum(F.col("x") * F.col("c")).alias("f"))
    left = response.join(fitted, "s", "left").select("s", F.lit(-1).alias("r"), (F.col("y") - F.coalesce("f", F.lit(0.0))).alias("x"))
    yy = left.agg(F.sum(F.col("x") * F.col("x")).alias("yy"))
    got = linops.zt(geno, stats, left.unionByName(q.select("s", "r", "x")))  # response and basis in one scan
    got = got.groupBy("v").agg(F.sum(F.when(F.col("r") == -1, F.col("b"))).alias("xy"), F.sum(F.when(F.col("r") >= 0, F.col("b") * F.col("b")).otherwise(0.0)).alias("qq"))
    got = stats.join(got, "v", "left").crossJoin(F.broadcast(yy))  # one row
    nan = F.lit(float("nan"))
    var = F.col("cnt") - F.coalesce("qq", F.lit(0.0))
    got = got.withColumn("x_var", var).withColumn("ok", (F.col("inv") > 0) & (var > 1e-8))
    got = got.withColumn("beta_std", F.when(F.col("ok"), F.col("xy") / F.col("x_var")).otherwise(nan))
    rss = F.greatest(F.col("yy") - F.col("beta_std") * F.col("xy"), F.lit(0.0))
    got = got.withColumn("se_std", F.when(F.col("ok"), F.sqrt(rss / dof / F.col("x_var"))).otherwise(nan))
    fine = F.col("ok") & (F.col("se_std") > 0)
    got = got.select(
        "v", (F.col("mean") / 2).alias("af"), F.col("cnt").alias("n_obs"),
        F.when(fine, F.col("beta_std") * F.col("inv")).otherwise(nan).alias("beta"), F.when(fine, F.col("se_std") * F.col("inv")).otherwise(nan).alias("se"),
        "beta_std", "se_std", F.when(fine, F.col("beta_std") / F.col("se_std")).otherwise(nan).alias("t"),
    )
    return got.withColumn("p", two_sided_t(F.col("t"), F.lit(dof))) if p_values else got
