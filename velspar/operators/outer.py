"""Workflows over fits: weak components merged and fitted again; a sparse mean and the covariance of the rest fitted in turn."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import effects, ld, linops, score, selection, sparse, spans
from velspar.operators.score import projector
from velspar.operators.solvers import Operator, fit_reml
from velspar.sources.shared import written

#: theta and a residual (s, y) with the selected span (basis, rank) to a new theta.
Fit = Callable[[DataFrame, np.ndarray, DataFrame, int], np.ndarray]


def system(geno: DataFrame, stats: DataFrame, components: DataFrame) -> tuple[Callable[[np.ndarray, DataFrame], DataFrame], Operator]:
    """(hv, parts) as fit_reml takes them, for components (v, comp) numbered from 0."""

    def hv(theta: np.ndarray, x: DataFrame) -> DataFrame:
        own = F.broadcast(x.sparkSession.createDataFrame([(c, float(t)) for c, t in enumerate(theta[:-1])], "comp int, theta double"))  # a row per component
        return linops.h(geno, stats, components, own, float(theta[-1]), x)

    return hv, lambda x: linops.k_by_component(geno, stats, components, x).select("s", "comp", "r", "x")


def background(z: np.ndarray, theta: np.ndarray, z_cutoff: float = selection.Z_CUTOFF) -> tuple[dict[int, int], np.ndarray]:
    """({component: its new number}, theta to start from) once all components below the cutoff are one, the last; with fewer than two of them nothing changes."""
    weak = [c for c in range(len(z)) if not z[c] >= z_cutoff]
    if len(weak) < 2:
        return {c: c for c in range(len(z))}, theta
    strong = [c for c in range(len(z)) if c not in weak]
    number = {c: k for k, c in enumerate(strong)} | {c: len(strong) for c in weak}
    return number, np.array([*(theta[c] for c in strong), sum(theta[c] for c in weak), theta[-1]])


def merged_fit(geno: DataFrame, stats: DataFrame, components: DataFrame, response: DataFrame, q: DataFrame, samples: DataFrame, theta: np.ndarray, z_cutoff: float = selection.Z_CUTOFF, **fit) -> dict:
    """Fits all components, merges those whose z is below the cutoff into one and, if there are two or more, fits once more.

    components is (v, comp), comp numbered from 0; fit holds further arguments of fit_reml. Gives theta, components (v, comp) of the last fit, z of
    the first, number {component: its new number} and rounds, a history per fit. A fit that hasn't converged is an error.
    """
    rounds = []

    def one(comps: DataFrame, start: np.ndarray) -> np.ndarray:
        hv, parts = system(geno, stats, comps)
        got, history = fit_reml(hv, parts, response, q, samples, start, **fit)
        rounds.append(history)
        return effects.accepted(got, history, fit.get("tol", 1e-3))

    got = one(components, theta)
    z = effects.z_scores(got, np.array(rounds[0][-1]["info"]), 1)
    number, start = background(z, got, z_cutoff)
    if len(set(number.values())) < len(number):
        table = F.broadcast(geno.sparkSession.createDataFrame(sorted(number.items()), "comp int, merged int"))  # a row per component
        components = written(components.join(table, "comp").select("v", F.col("merged").alias("comp")), "merged-components")
        got = one(components, start)
    return {"theta": got, "components": components, "z": z, "number": number, "rounds": rounds}


def chosen_point(path: DataFrame, metrics: DataFrame | None) -> int:
    """The path point with the best r2 on validation samples, ties to fewer effects and the larger penalty; the last one without metrics. A path is a few dozen rows."""
    points = path.groupBy("path").agg(F.sum((F.col("b") != 0).cast("int")).alias("k"), F.max("lam").alias("lam_ratio"))
    if metrics is None:
        return points.agg(F.max("path")).first()[0]
    best = selection.select_path(metrics.join(points, "path").select("path", "r2", "k", "lam_ratio")).first()
    return best.path if best else points.agg(F.max("path")).first()[0]


def alternating(
    geno: DataFrame, stats: DataFrame, components: DataFrame, response: DataFrame, q: DataFrame, theta: np.ndarray, atoms: np.ndarray, n: int, ratios: np.ndarray,
    validation: tuple[DataFrame, DataFrame] | None = None, limit: int = 20, weighted: Callable[[np.ndarray], Operator] | None = None, fit: Fit | None = None,
    mean_tol: float = 0.05, h2_tol: float = 0.01, **path,
) -> dict:
    """A sparse mean by a lasso under the present covariance, then the covariance of what it leaves, in turn until both stand still.

    response is (s, y), on its final scale; ratios are falling shares of the largest score, from 1 down, made new in each turn; validation is (geno, outcome (s, y)) of
    other samples and chooses the path's point, else the last one counts; atoms are tr(K_comp)/n and the residual's 1; path holds arguments of certified_path.
    Covariates q aren't penalised: the lasso's weight is the projection beside them, and the covariance is fitted with them profiled, its
    scores corrected for the selected span. weighted(theta) and fit replace the projection and the REML fit, for covariances of another kind.

    Gives theta, betas (v, b), mean (s, r, x), h2 with the sparse part on both sides, history and converged: the fitted mean moved by at most mean_tol of its length and h2 by
    at most h2_tol. A response without any score ends with no effects. The driver holds what certified_path does, and a row per component.
    """
    spark = geno.sparkSession
    hv, parts = system(geno, stats, components)
    weighted = weighted or (lambda at: projector(lambda t: hv(at, t), q))
    fit = fit or (lambda rest, at, basis, rank: covariance(hv, parts, rest, q, at, basis, rank))
    y = written(response.select("s", F.lit(0).cast("long").alias("r"), F.col("y").cast("double").alias("x")), "outer-response")
    history: list[dict] = []
    before = written(y.withColumn("x", F.lit(0.0)), "outer-mean")
    h2_before = float("nan")
    while len(history) < limit:
        project = weighted(theta)
        most = linops.zt(geno, stats, project(y)).agg(F.max(F.abs("b")).alias("m")).first().m or 0.0
        if most > 0:
            found, _ = sparse.certified_path(geno, stats, response, most * np.asarray(ratios), project, **path)
            found = written(found, "outer-path")
            seen = sparse.validated(validation[0], stats, found, validation[1]) if validation else None
            point = chosen_point(found, seen)
            betas = found.where(F.col("path") == F.lit(point)).where("b != 0").select("v", "b")
        else:
            point, betas = None, spark.createDataFrame([], "v long, b double")
        betas = written(betas, "outer-betas")
        fitted = linops.z(geno, stats, betas.withColumn("r", F.lit(0).cast("long"))).select("s", "r", F.col("x").alias("g"))
        both = written(y.join(fitted, ["s", "r"], "left").select("s", "r", "x", F.coalesce("g", F.lit(0.0)).alias("g")), "outer-fitted")
        mean, rest = both.select("s", "r", F.col("g").alias("x")), both.select("s", "r", (F.col("x") - F.col("g")).alias("x"))
        basis, rank = spans.span(written(sparse.columns(geno, stats, betas.select("v"), y), "outer-columns"), n)
        theta = np.asarray(fit(rest.select("s", F.col("x").alias("y")), theta, basis, rank), float)
        trace = spans.span_information(basis, rank, weighted(theta))["trace"]
        part = effects.sparse_variance(mean, rest, trace, n)
        whole = [(float(t), float(a), "genetic" if c < len(theta) - 1 else "residual") for c, (t, a) in enumerate(zip(theta, atoms, strict=True))]
        h2 = selection.heritability(spark.createDataFrame(whole, "theta double, atom double, kind string"), part).first().h2
        moved = effects.relative_change(mean, before, y)
        first = not history
        history.append({"turn": len(history), "point": point, "effects": rank, "theta": theta.tolist(), "sparse": part, "h2": h2, "moved": moved})
        if not first and effects.converged(moved, h2, h2_before, mean_tol, h2_tol):
            break
        before, h2_before = mean, h2
    last = len(history) > 1 and effects.converged(moved, h2, h2_before, mean_tol, h2_tol)
    return {"theta": theta, "betas": betas, "mean": mean, "h2": h2, "history": history, "converged": bool(last)}


def covariance(hv: Callable, parts: Operator, rest: DataFrame, q: DataFrame, theta: np.ndarray, basis: DataFrame, rank: int, **fit) -> np.ndarray:
    """theta of a residual (s, y) by REML with the covariates q profiled and no rescaling, its scores corrected for a selected span of orthonormal columns; an error if it doesn't converge."""
    correction = (lambda project: spans.span_information(basis, rank, project, parts)["corrections"]) if rank else None
    got, history = fit_reml(hv, parts, rest, q, rest.select("s"), theta, correction=correction, **fit)
    return effects.accepted(got, history, fit.get("tol", 1e-3))


def tested(geno: DataFrame, stats: DataFrame, bins: int, response: DataFrame, q: DataFrame, **test) -> Callable[[DataFrame, np.ndarray], dict]:
    """A test for grown_partition: the adaptive score test of all cuts between `bins` balanced bins of ranks, at the partition and its theta.

    A variant of the ranks that doesn't vary is an error, since cuts count those that do.
    """
    varying = written(stats.where("inv > 0").select("v"), "partition-varying")

    def run(ranks: DataFrame, theta: np.ndarray) -> dict:
        if not ranks.join(varying, "v", "left_anti").isEmpty():
            raise ValueError("ranks hold variants that don't vary")
        own = ld.bins_of(ranks, ranks.count(), bins).select("v", "bin", "comp")
        genetic = F.broadcast(ranks.sparkSession.createDataFrame([(c, float(t)) for c, t in enumerate(theta[:-1])], "comp int, theta double"))  # a row per component
        return score.score_test(geno, stats, ranks.select("v", "comp"), own, genetic, float(theta[-1]), response, q, **test)[0]

    return run


def refitted(geno: DataFrame, stats: DataFrame, response: DataFrame, q: DataFrame, **fit) -> Callable[[DataFrame, np.ndarray], np.ndarray]:
    """A fit for grown_partition: REML with the mean's coefficients profiled anew, from the split theta; one that doesn't converge is an error."""

    def run(components: DataFrame, theta: np.ndarray) -> np.ndarray:
        hv, parts = system(geno, stats, components)
        got, history = fit_reml(hv, parts, response, q, response.select("s"), theta, **fit)
        return effects.accepted(got, history, fit.get("tol", 1e-3))

    return run


def grown_partition(ranks: DataFrame, theta: np.ndarray, test: Callable[[DataFrame, np.ndarray], dict], fit: Callable[[DataFrame, np.ndarray], np.ndarray], alpha: float = 0.05, limit: int = 16) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """(ranks, theta, history): a partition of ranks (v, rank, comp) into intervals, cut where the test says so until no cut passes.

    Each turn tests all cuts; one with p <= alpha splits its component, whose children share its variance by their numbers of variants, and the
    covariance is fitted again from there. It ends with a test above alpha, or after `limit` cuts, which history shows by its last p. comp counts from 0 in the order
    of ranks; the driver holds a row per component and cut.
    """
    history: list[dict] = []
    while True:
        found = test(ranks, theta)
        history.append({"cut": found["cut"], "p": found["p"], "theta": np.asarray(theta).tolist()})
        if found["p"] > alpha or len(history) > limit:
            return ranks, theta, history
        spark = ranks.sparkSession
        genetic = spark.createDataFrame([(c, float(t)) for c, t in enumerate(theta[:-1])], "comp int, theta double")  # a row per component
        moved, split = ld.split_component(ranks, genetic, found["cut"])
        ranks = written(moved.withColumn("comp", F.col("comp").cast("int")), "partition-ranks")
        start = np.array([*(r.theta for r in split.orderBy("comp").collect()), theta[-1]])  # a row per component
        theta = fit(written(ranks.select("v", "comp"), "partition-components"), start)
