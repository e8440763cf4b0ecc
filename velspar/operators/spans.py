"""Selected spans: what choosing variants for the mean takes from the covariance's information; a lasso beside covariates; predictions of both parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import linops
from velspar.operators.solvers import Operator, lasso_path
from velspar.sources.shared import written


def inner_products(a: DataFrame, b: DataFrame) -> dict[tuple[int, int], float]:
    """x_i'y_j of the columns of two tables (s, r, x) with a bounded number of columns."""
    other = b.select("s", F.col("r").alias("q"), F.col("x").alias("y"))
    return {(r.r, r.q): r.d for r in a.join(other, "s").groupBy("r", "q").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()}


def combined(x: DataFrame, names: list[int], weights: np.ndarray) -> DataFrame:
    """(s, r, x): the columns of x, names giving the order of the weights' rows, mixed by weights; its columns are numbered."""
    rows = [(int(n), k, float(weights[i, k])) for i, n in enumerate(names) for k in range(weights.shape[1])]
    small = F.broadcast(x.sparkSession.createDataFrame(rows, "r long, k long, w double"))  # columns times columns
    return x.join(small, "r").groupBy("s", "k").agg(F.sum(F.col("x") * F.col("w")).alias("x")).select("s", F.col("k").alias("r"), "x")


#: Of a column of length 1, what is left beside the span of others and shorter than this is rounding; up to the second it is neither one nor the other.
ROUNDING, CLEAR = 1e-12, 1e-10


def span(columns: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(orthonormal columns, rank) of the span of `columns` of any lengths; a rank that hangs on the cutoff is an error.

    Eigenvectors of a Gram matrix show directions down to a ten-thousandth of the longest. These become columns, all columns lose
    what lies in them, twice, and what is left is looked at anew: so short directions are seen as such and not as the square of their length.
    """
    lengths = {i: d**0.5 for (i, j), d in inner_products(columns, columns).items() if i == j and d > 0}
    names = sorted(lengths)
    if not names:
        return columns.limit(0).select("s", F.col("r").cast("long").alias("r"), "x"), 0
    left = written(combined(columns, names, np.diag([1 / lengths[i] for i in names])), "span-columns")
    basis, rank, every = None, 0, range(len(names))
    while rank < len(names):
        got = inner_products(left, left)
        values, vectors = np.linalg.eigh(np.array([[got.get((i, j), 0.0) for j in every] for i in every]))
        longest = max(values[-1], 0.0) ** 0.5
        if longest <= ROUNDING:
            break
        if longest < CLEAR:
            raise ValueError("the rank of the selected columns is ambiguous")
        good = values > 1e-8 * values[-1]
        new = combined(left, list(every), vectors[:, good] / np.sqrt(values[good]))
        new = _unit(_beside(new, basis, rank) if rank else written(new, "span"), int(good.sum()))
        new = written(new.withColumn("r", F.col("r") + rank), "span")
        basis, rank = new if basis is None else basis.unionByName(new), rank + int(good.sum())
        left = _beside(left, basis, rank)
    return basis, rank


def _beside(x: DataFrame, basis: DataFrame, rank: int) -> DataFrame:
    """x less its part in the span of orthonormal columns numbered from 0, taken twice."""
    for _ in range(2):
        got = inner_products(basis, x)
        sides = sorted({j for _, j in got})
        own = combined(basis, list(range(rank)), np.array([[got.get((i, j), 0.0) for j in sides] for i in range(rank)]))
        back = F.broadcast(x.sparkSession.createDataFrame([(k, int(j)) for k, j in enumerate(sides)], "r long, name long"))  # a row per column
        own = own.join(back, "r").select("s", F.col("name").alias("r"), F.col("x").alias("o"))
        x = written(x.join(own, ["s", "r"], "left").select("s", "r", (F.col("x") - F.coalesce("o", F.lit(0.0))).alias("x")), "span-left")
    return x


def _unit(x: DataFrame, count: int) -> DataFrame:
    """Nearly orthonormal columns made so."""
    got = inner_products(x, x)
    values, vectors = np.linalg.eigh(np.array([[got.get((i, j), 0.0) for j in range(count)] for i in range(count)]))
    return written(combined(x, list(range(count)), vectors / np.sqrt(values)), "span")


def span_information(basis: DataFrame, rank: int, project: Operator, parts: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """For orthonormal columns B: logdet of B'PB, trace of B (B'PB)⁻¹ B', and with parts(x) = all K_comp x as (s, comp, r, x) the corrections tr((B'PB)⁻¹ B'P K P B) of the scores' traces.

    The selected mean is an offset and not profiled; this is what the fit of its span takes from the likelihood. Without columns all are zero.
    """
    if not rank:
        return {"logdet": 0.0, "trace": 0.0, "corrections": {}}
    pb = project(basis)
    got = inner_products(basis, pb)
    inside = np.array([[(got[i, j] + got[j, i]) / 2 for j in range(rank)] for i in range(rank)])
    values = np.linalg.eigvalsh(inside)
    if values[0] <= 1e-10 * values[-1]:
        raise ValueError("the selected span meets the covariates'")
    inverse = np.linalg.inv(inside)
    corrections = {}
    if parts is not None:
        k = parts(pb).unionByName(pb.select("s", F.lit(-1).alias("comp"), "r", "x"))  # -1: the residual's identity
        rows = k.withColumnRenamed("r", "q").withColumnRenamed("x", "y").join(pb, "s").groupBy("comp", "r", "q").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()
        for r in rows:
            corrections[r.comp] = corrections.get(r.comp, 0.0) + float(inverse[r.r, r.q] * r.d)
    return {"logdet": float(np.log(values).sum()), "trace": float(np.trace(inverse)), "corrections": corrections}


def lasso_with_covariates(values: DataFrame, solved: DataFrame, covariates: list[int], chosen: list[int], lams: np.ndarray, ridge: float = 1e-6, response: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(effects by penalty and variant, coefficients by penalty and covariate) of the lasso weighted by H⁻¹ whose covariates aren't penalised.

    values and solved are (s, r, x): the response, the covariates and the chosen variants' columns, and H⁻¹ of them. The covariates leave the problem by
    a Schur complement, so the path is one of the variants alone; each point's coefficients follow from its effects.
    """
    got = inner_products(values, solved)
    take = lambda a, b: np.array([[got.get((i, j), 0.0) for j in b] for i in a]).reshape(len(a), len(b))
    gzz, gz = take(chosen, chosen), take(chosen, [response])[:, 0]
    gzz = (gzz + gzz.T) / 2
    if covariates:
        gcc = take(covariates, covariates) + ridge * np.eye(len(covariates))
        gcz, gc = take(covariates, chosen), take(covariates, [response])[:, 0]
        inverse = np.linalg.inv((gcc + gcc.T) / 2)
        gzz, gz = gzz - gcz.T @ inverse @ gcz, gz - gcz.T @ inverse @ gc
    betas = lasso_path(gzz, gz, lams)
    fixed = np.stack([inverse @ (gc - gcz @ b) for b in betas]) if covariates else np.zeros((len(lams), 0))
    return betas, fixed


def predicted(geno: DataFrame, training_stats: DataFrame, betas: DataFrame, background: DataFrame, fixed: DataFrame, q: DataFrame) -> DataFrame:
    """(s, sparse, background, nuisance, total) of new samples: selected effects (v, b), background effects (v, b) and covariates, all on the training statistics."""
    scores = linops.z(geno, training_stats, betas.select("v", F.lit("sparse").alias("part"), "b").unionByName(background.select("v", F.lit("background").alias("part"), "b")), ("part",))
    wide = scores.groupBy("s").pivot("part", ["sparse", "background"]).agg(F.first("x"))
    mean = q.join(fixed, "r").groupBy("s").agg(F.sum(F.col("x") * F.col("b")).alias("nuisance"))
    out = mean.join(wide, "s", "left").select("s", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sparse", "background")], "nuisance")
    return out.withColumn("total", F.col("sparse") + F.col("background") + F.col("nuisance"))
