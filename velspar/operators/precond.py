"""Low-rank preconditioners: H is near d I + U diag(l) U' for a few orthonormal columns U, a table (s, r, x), and numbers l on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators.solvers import Operator, probes
from velspar.sources.shared import written


def _inner(a: DataFrame, b: DataFrame) -> dict[tuple[int, int], float]:
    """Inner products of all columns of a with all of b: a number for each pair of columns."""
    other = b.select("s", F.col("r").alias("q"), F.col("x").alias("y"))
    rows = a.join(other, "s").groupBy("r", "q").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()
    return {(r.r, r.q): r.d for r in rows}


def _mixed(u: DataFrame, m: np.ndarray, names: list[int] | None = None) -> DataFrame:
    """(s, r, x) = U m for a small matrix m, whose columns are named 0, 1, ... or by names."""
    names = list(range(m.shape[1])) if names is None else names
    rows = [(p, int(q), float(m[p, k])) for p in range(m.shape[0]) for k, q in enumerate(names)]
    small = F.broadcast(u.sparkSession.createDataFrame(rows, "r long, q long, m double"))  # columns times columns
    return u.join(small, "r").groupBy("s", "q").agg(F.sum(F.col("x") * F.col("m")).alias("x")).select("s", F.col("q").alias("r"), "x")


def orthonormal(y: DataFrame, k: int) -> DataFrame:
    """The same span with orthonormal columns, by the eigenvectors of the Gram matrix; directions of no length are left out."""
    inner = _inner(y, y)
    values, vectors = np.linalg.eigh(np.array([[inner.get((i, j), 0.0) for j in range(k)] for i in range(k)]))
    good = values > 1e-12 * max(values.max(), 1e-300)
    return written(_mixed(y, vectors[:, good] / np.sqrt(values[good])), "precond")


def low_rank(product: Operator, samples: DataFrame, rank: int, oversample: int = 8, passes: int = 2, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(U, l): the leading part of a positive semidefinite product, from random vectors multiplied `passes` times."""
    k = rank + oversample
    u = written(probes(samples, k, seed), "precond")
    for _ in range(passes):
        u = orthonormal(written(product(u), "precond-product"), k)
        k = u.select("r").distinct().count()
    core = _inner(u, product(u))
    values, vectors = np.linalg.eigh(np.array([[(core[i, j] + core[j, i]) / 2 for j in range(k)] for i in range(k)]))
    top = np.argsort(-values)[:rank]
    return written(_mixed(u, vectors[:, top]), "precond"), np.maximum(values[top], 0.0)


def inverse(u: DataFrame, l: np.ndarray, d: float) -> Operator:
    """x -> (d I + U diag(l) U')⁻¹ x."""
    scale = l / (d * (d + l))

    def apply(x: DataFrame) -> DataFrame:
        inner = _inner(u, x)
        sides = sorted({q for _, q in inner})
        m = np.array([[scale[p] * inner.get((p, q), 0.0) for q in sides] for p in range(len(l))])
        off = _mixed(u, m, sides).select("s", "r", F.col("x").alias("o"))
        return x.join(off, ["s", "r"], "left").select("s", "r", (F.col("x") / d - F.coalesce("o", F.lit(0.0))).alias("x"))

    return apply


def log_determinant(l: np.ndarray, d: float, n: int) -> float:
    return n * math.log(d) + float(np.log1p(l / d).sum())
