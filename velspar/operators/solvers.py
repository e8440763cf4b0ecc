"""Iterative solvers whose vectors are tables: conjugate gradients, log-determinants by Lanczos, REML. The driver holds a few numbers per right-hand side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.sources.shared import written

#: A linear operator on tables (s, r, x).
Operator = Callable[[DataFrame], DataFrame]


def dots(a: DataFrame, b: DataFrame) -> dict:
    """Inner products by right-hand side: one number for each."""
    rows = a.join(b.select("s", "r", F.col("x").alias("__y")), ["s", "r"]).groupBy("r").agg(F.sum(F.col("x") * F.col("__y")).alias("d")).collect()
    return {r.r: r.d for r in rows}


def _scalars(spark, **columns: dict) -> DataFrame:
    keys = sorted({k for c in columns.values() for k in c})
    return F.broadcast(spark.createDataFrame([(k, *[float(c.get(k, 0.0)) for c in columns.values()]) for k in keys], "r long, " + ", ".join(f"{n} double" for n in columns)))  # a row per right-hand side


def pcg(product: Operator, b: DataFrame, diagonal: DataFrame | None = None, tol: float = 1e-8, maxiter: int = 50, precond: Operator | None = None, x0: DataFrame | None = None, restarts: int = 2) -> tuple[DataFrame, dict, int]:
    """(x, true relative residuals, iterations) of product(x) = b for all right-hand sides of b (s, r, x) at once, from x0 (s, r, x) or zeros.

    Preconditioned by a diagonal (s, d) or a linear map if there is one. Sides that have converged stand still; a side of zeros gives zeros. The
    residual that is returned is computed anew from x; while it is above tol for some side and iterations are left, the solution starts again from there,
    `restarts` times at most. Curvature that isn't positive is an error.
    """
    x, done = x0, 0
    for _ in range(restarts + 1):
        rest = b if x is None else residual_of(product, b, x)
        step, error, used = _pcg(product, written(rest, "pcg-residual") if x is not None else b, b, diagonal, tol, maxiter - done, precond)
        x = step if x is None else written(step.unionByName(x).groupBy("s", "r").agg(F.sum("x").alias("x")), "pcg-solution")
        done += used
        if done >= maxiter or not used or all(e <= 1.05 * tol for e in error.values()):
            break
    return x, error, done


def residual_of(product: Operator, b: DataFrame, x: DataFrame) -> DataFrame:
    """b - product(x)."""
    own = product(x).select("s", "r", F.col("x").alias("hx"))
    return b.join(own, ["s", "r"], "left").select("s", "r", (F.col("x") - F.coalesce("hx", F.lit(0.0))).alias("x"))


def _pcg(product: Operator, b: DataFrame, whole: DataFrame, diagonal: DataFrame | None, tol: float, maxiter: int, precond: Operator | None) -> tuple[DataFrame, dict, int]:
    """pcg from zeros for the residuals b of right-hand sides `whole`, to whose norms tol refers."""
    norm = dots(whole, whole)
    x, done = (_by_map if precond else _by_diagonal)(product, b, norm, precond or diagonal, tol, maxiter)
    left = residual_of(product, b, x)
    error = dots(left, left)
    return x, {r: (error[r] / n) ** 0.5 if n else 0.0 for r, n in norm.items()}, done


def _curved(curve: dict) -> None:
    bad = {r: c for r, c in curve.items() if not c > 0}
    if bad:
        raise ValueError(f"curvature isn't positive: {bad}")


def _by_diagonal(product: Operator, b: DataFrame, norm: dict, diagonal: DataFrame | None, tol: float, maxiter: int) -> tuple[DataFrame, int]:
    """(x, iterations) with a diagonal or nothing: an iteration writes one table and sums over it twice; the new vectors are
    made only where they are read. Sides that have converged leave the table."""
    d = F.lit(1.0)
    state = b.select("s", "r", F.lit(0.0).alias("u"), F.col("x").alias("res"))
    if diagonal is not None:
        state, d = state.join(diagonal.select("s", "d"), "s"), F.col("d")
    state = written(state.withColumn("d", d).withColumn("p", F.col("res") / F.col("d")), "pcg")
    first = state.groupBy("r").agg(F.sum(F.col("res") * F.col("p")).alias("rho"), F.sum(F.col("res") * F.col("res")).alias("size")).collect()  # a row per side
    rho, size = {r.r: r.rho for r in first}, {r.r: r["size"] for r in first}
    ended = [state.where(~F.col("r").isin(*(live := {r for r in norm if norm[r] > 0 and size[r] > tol * tol * norm[r]}))).select("s", "r", F.col("u").alias("x"))]
    state = state.where(F.col("r").isin(*live))
    done = 0
    while live and done < maxiter:
        done += 1
        hp = product(state.select("s", "r", F.col("p").alias("x"))).select("s", "r", F.col("x").alias("hp"))
        both = written(state.join(hp, ["s", "r"], "left").withColumn("hp", F.coalesce("hp", F.lit(0.0))), "pcg")
        sums = both.groupBy("r").agg(F.sum(F.col("p") * F.col("hp")).alias("curve")).collect()  # a row per side
        _curved({r.r: r.curve for r in sums})
        a, before = {r.r: rho[r.r] / r.curve for r in sums}, dict(rho)
        res = both.join(_scalars(b.sparkSession, a=a), "r").withColumn("res", F.col("res") - F.col("a") * F.col("hp"))
        for r in res.groupBy("r").agg(F.sum(F.col("res") * F.col("res") / F.col("d")).alias("rho"), F.sum(F.col("res") * F.col("res")).alias("size")).collect():  # a row per side
            rho[r.r], size[r.r] = r.rho, r["size"]
        turn = {r: rho[r] / before[r] for r in live}
        moved = both.join(_scalars(b.sparkSession, a=a, c=turn), "r").select("s", "r", (F.col("u") + F.col("a") * F.col("p")).alias("u"), (F.col("res") - F.col("a") * F.col("hp")).alias("res"), "p", "c", "d")
        state = moved.withColumn("p", F.col("res") / F.col("d") + F.col("c") * F.col("p")).drop("c")
        now = {r for r in live if size[r] > tol * tol * norm[r] and rho[r] > 0}
        if live - now:
            ended.append(state.where(F.col("r").isin(*(live - now))).select("s", "r", F.col("u").alias("x")))
            state = state.where(F.col("r").isin(*now))
        live = now
    if live:
        ended.append(state.select("s", "r", F.col("u").alias("x")))
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return written(out, "pcg-solution"), done


def _by_map(product: Operator, b: DataFrame, norm: dict, inverse: Operator, tol: float, maxiter: int) -> tuple[DataFrame, int]:
    """(x, iterations) with any linear map as preconditioner."""
    start = b.select("s", "r", F.lit(0.0).alias("u"), F.col("x").alias("res"))
    state = written(start.join(inverse(b).select("s", "r", F.col("x").alias("p")), ["s", "r"]), "pcg")
    side = lambda t, c: t.select("s", "r", F.col(c).alias("x"))
    rho, first = dots(side(state, "res"), side(state, "p")), dots(b, b)
    live = {r for r, v in norm.items() if v > 0 and first[r] > tol * tol * v}
    ended = state.where(~F.col("r").isin(*live)).select("s", "r", F.col("u").alias("x"))
    state = state.where(F.col("r").isin(*live))
    done = 0
    while live and done < maxiter:
        done += 1
        both = written(state.join(product(side(state, "p")).select("s", "r", F.col("x").alias("hp")), ["s", "r"], "left").withColumn("hp", F.coalesce("hp", F.lit(0.0))), "pcg-product")
        curve = dots(side(both, "p"), side(both, "hp"))
        _curved(curve)
        moved = both.join(_scalars(b.sparkSession, a={r: rho[r] / curve[r] for r in live}), "r")
        moved = moved.select("s", "r", (F.col("u") + F.col("a") * F.col("p")).alias("u"), (F.col("res") - F.col("a") * F.col("hp")).alias("res"), "p")
        moved = written(moved.join(inverse(side(moved, "res")).select("s", "r", F.col("x").alias("z")), ["s", "r"]), "pcg")
        sums = moved.groupBy("r").agg(F.sum(F.col("res") * F.col("z")).alias("rho"), F.sum(F.col("res") * F.col("res")).alias("size")).collect()  # a row per side
        new, size = {r.r: r.rho for r in sums}, {r.r: r["size"] for r in sums}
        now = {r for r in live if size[r] > tol * tol * norm[r]}
        ended = ended.unionByName(moved.where(F.col("r").isin(*(live - now))).select("s", "r", F.col("u").alias("x")))
        turned = moved.where(F.col("r").isin(*now)).join(_scalars(b.sparkSession, c={r: new[r] / rho[r] for r in live}), "r")
        state = turned.select("s", "r", "u", "res", (F.col("z") + F.col("c") * F.col("p")).alias("p"))
        rho, live = {**rho, **new}, now
    return written(ended.unionByName(state.select("s", "r", F.col("u").alias("x"))), "pcg-solution"), done


def probes(samples: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(s, r, x): `count` vectors of ±1 from a hash of sample, number and seed, the same however the table is partitioned."""
    rows = samples.select("s", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("r"))
    return rows.select("s", F.col("r").cast("long").alias("r"), F.when(F.pmod(F.xxhash64("s", "r", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("x"))


def lanczos(product: Operator, samples: DataFrame, n: int, count: int = 8, steps: int = 10, seed: int = 1, parts: Callable[[DataFrame], DataFrame] | None = None, size: int = 0, start: DataFrame | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of `count` probes its tridiagonal matrix T (k, k) and dT (size, k, k), the exact derivatives of T by the coefficients of the product's components.

    parts(x) is (s, comp, r, x), all K_comp x for comp from 0 to size - 1. A row holds a probe's vector and its derivatives as one array, so that
    one scan serves all probes and components. A probe whose space is exhausted ends there. start (s, r, x) are the probes where they aren't made here, of squared length n and numbered from 0.
    """
    spark = samples.sparkSession
    q, wide = F.col("q"), range(size + 1)
    state = (probes(samples, count, seed) if start is None else start).select("s", F.col("r").alias("p"), F.array(F.col("x") / n**0.5, *[F.lit(0.0)] * size).alias("q"), F.array(*[F.lit(0.0)] * (size + 1)).alias("o"))
    state = written(state, "lanczos")
    alphas, betas = {p: [] for p in range(count)}, {p: [] for p in range(count)}
    none = [0.0] * (size + 1)
    for k in range(steps):
        flat = state.select("s", "p", F.posexplode("q").alias("d", "x")).select("s", (F.col("p") + count * F.col("d")).alias("r"), "x")
        got = product(flat if k else flat.where(F.col("r") < count)).select("s", "r", "x")
        if parts is not None:
            own = parts(state.select("s", F.col("p").alias("r"), q[0].alias("x")))
            got = got.unionByName(own.select("s", (F.col("r") + count * (F.col("comp") + 1)).alias("r"), "x"))
        at = F.floor(F.col("r") / count)
        w = got.groupBy("s", (F.col("r") % count).alias("p")).agg(F.array(*[F.coalesce(F.sum(F.when(at == i, F.col("x"))), F.lit(0.0)) for i in wide]).alias("w"))
        both = written(state.join(w, ["s", "p"]), "lanczos-product")
        cross = [F.sum(q[0] * F.col("w")[i] + (q[i] * F.col("w")[0] if i else 0.0)).alias(f"d{i}") for i in wide]
        for r in both.groupBy("p").agg(*cross).collect():  # a row per probe
            alphas[r.p].append([r[f"d{i}"] for i in wide])
        if k + 1 == steps:
            break
        scalars = F.broadcast(spark.createDataFrame([(p, alphas[p][-1], betas[p][-1] if betas[p] else none) for p in range(count)], "p long, a array<double>, b array<double>"))  # a row per probe
        a, b, o = F.col("a"), F.col("b"), F.col("o")
        u = [F.col("w")[i] - a[0] * q[i] - b[0] * o[i] - (a[i] * q[0] + b[i] * o[0] if i else 0.0) for i in wide]
        moved = written(both.join(scalars, "p").select("s", "p", F.array(*u).alias("u"), q), "lanczos")
        rows = moved.groupBy("p").agg(*[F.sum(F.col("u")[0] * F.col("u")[i]).alias(f"d{i}") for i in wide]).collect()  # a row per probe
        for r in rows:
            length = r.d0**0.5
            betas[r.p].append([length, *(r[f"d{i}"] / length for i in wide[1:])] if length >= 1e-10 else none)
        if all(not betas[p][-1][0] for p in betas):
            break
        scalars = F.broadcast(spark.createDataFrame([(p, 1 / v[-1][0] if v[-1][0] else 0.0, v[-1]) for p, v in betas.items()], "p long, c double, b array<double>"))  # a row per probe
        first = F.col("u")[0] * F.col("c")
        after = [first, *((F.col("u")[i] - F.col("b")[i] * first) * F.col("c") for i in wide[1:])]
        state = moved.join(scalars, "p").select("s", "p", F.array(*after).alias("q"), F.col("q").alias("o"))
    out = []
    for p in range(count):
        k = next((i + 1 for i, x in enumerate(betas[p]) if not x[0]), len(alphas[p]))
        d, e = np.array(alphas[p][:k]).T, np.array(betas[p][: k - 1]).reshape(k - 1, size + 1).T
        each = np.stack([np.diag(d[i]) + np.diag(e[i], 1) + np.diag(e[i], -1) for i in wide])
        out.append((each[0], each[1:]))
    return out


def quadrature(t: np.ndarray, slopes: np.ndarray) -> tuple[float, np.ndarray]:
    """e'log(T)e for the first unit vector e, and its derivatives along the matrices `slopes`, by divided differences of the logarithm."""
    values, vectors = np.linalg.eigh(t)
    values, first = np.maximum(values, 1e-300), vectors[0]
    gap, total = values[:, None] - values, values[:, None] + values
    near = np.abs(gap) <= 1e-7 * total
    divided = np.where(near, 2 / total, np.log(values[:, None] / values) / np.where(near, 1.0, gap))
    return float(first**2 @ np.log(values)), np.array([first @ (divided * (vectors.T @ s @ vectors)) @ first for s in slopes])


def logdet(product: Operator, samples: DataFrame, n: int, count: int = 8, steps: int = 10, seed: int = 1, start: DataFrame | None = None) -> tuple[float, float]:
    """(estimate, standard error) of log|H|: Lanczos on probes gives small tridiagonal matrices whose eigenvalues are a quadrature of the logarithm."""
    each = [n * quadrature(t, d)[0] for t, d in lanczos(product, samples, n, count, steps, seed, start=start)]
    return float(np.mean(each)), float(np.std(each, ddof=1) / len(each) ** 0.5) if len(each) > 1 else float("nan")


def logdet_slopes(product: Operator, parts: Callable[[DataFrame], DataFrame], size: int, samples: DataFrame, n: int, count: int = 8, steps: int = 10, seed: int = 1, start: DataFrame | None = None) -> tuple[float, np.ndarray]:
    """(log|H|, its gradient by the coefficients of the components): the exact gradient of the estimate that logdet makes from the same probes.

    parts(x) is (s, comp, r, x), all K_comp x for comp from 0 to size - 1, the identity included if the residual is one of them.
    """
    got = [quadrature(t, d) for t, d in lanczos(product, samples, n, count, steps, seed, parts, size, start)]
    return n * float(np.mean([v for v, _ in got])), n * np.mean([g for _, g in got], axis=0)


def affine_logdet(matrices: list[tuple[np.ndarray, np.ndarray]], n: int, genetic: float, residual: float) -> tuple[float, float, float]:
    """(log|genetic K + residual I|, its derivatives by both) for any coefficients from one run of lanczos on K."""
    got = [quadrature(genetic * t + residual * np.eye(len(t)), np.stack([t, np.eye(len(t))])) for t, _ in matrices]
    slopes = n * np.mean([g for _, g in got], axis=0)
    return n * float(np.mean([v for v, _ in got])), float(slopes[0]), float(slopes[1])


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A small positive definite system by Cholesky, with a growing jitter if it is nearly singular; an error if that doesn't help."""
    scale = max(float(np.mean(np.diag(a))), 1e-300)
    for k in range(9):
        try:
            f = np.linalg.cholesky(a + (0 if k == 0 else 1e-6 * scale * 10 ** (k - 1)) * np.eye(len(a)))
            return np.linalg.solve(f.T, np.linalg.solve(f, b))
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the system isn't positive definite")


def bounded_step(score: np.ndarray, info: np.ndarray, theta: np.ndarray, floor: float) -> np.ndarray:
    """The d that maximises score'd - d'(info + 1e-4)d/2 with genetic variances >= 0 and the residual's, the last, >= floor: active sets of a few components."""
    a = info + 1e-4 * np.eye(len(theta))
    low = np.append(np.zeros(len(theta) - 1), floor) - theta
    held = np.zeros(len(theta), bool)
    for _ in range(4 * len(theta) + 4):
        d = np.where(held, low, 0.0)
        free = ~held
        if free.any():
            d[free] = solve_spd(a[np.ix_(free, free)], score[free] - a[np.ix_(free, held)] @ d[held])
        below = free & (d < low - 1e-12)
        if below.any():
            held |= below
            continue
        pull = score - a @ d
        loose = held & (pull > 1e-10)
        if not loose.any():
            return np.maximum(d, low)
        held[np.argmax(np.where(loose, pull, -np.inf))] = False
    return np.maximum(d, low)


#: Kinds of right-hand sides: a side's number in a solve is its kind times this plus its own number, so kinds never meet.
KIND = 1 << 40
COVARIATE, RESPONSE, PROBE, PRODUCT, OTHER = range(5)


def sided(x: DataFrame, kind: int) -> DataFrame:
    return x.select("s", (F.col("r").cast("long") + kind * KIND).alias("r"), "x")


def of_kind(x: DataFrame, kind: int) -> DataFrame:
    """The sides of one kind under their own numbers."""
    return x.where(F.floor(F.col("r") / KIND) == kind).select("s", (F.col("r") - kind * KIND).alias("r"), "x")


class Solutions:
    """H⁻¹ of right-hand sides that come again at other coefficients: the last solution of each is kept as a table and is where the next solve begins.

    A side's residual at the new coefficients is made first; one within 1.05 of the tolerance isn't solved again.
    """

    def __init__(self, hv: Callable[[np.ndarray, DataFrame], DataFrame], tol: float = 1e-6, maxiter: int = 200):
        self.hv, self.tol, self.maxiter = hv, tol, maxiter
        self.known: dict[str, DataFrame] = {}
        self.iterations = 0

    def solve(self, name: str, at: np.ndarray, b: DataFrame) -> DataFrame:
        before = self.known.get(name)
        x, error, used = pcg(lambda t: self.hv(at, t), b, tol=self.tol, maxiter=self.maxiter, x0=before)
        self.iterations += used
        bad = {r: e for r, e in error.items() if not e <= max(5 * self.tol, 1e-5)}
        if bad:
            raise ValueError(f"unsolved right-hand sides at {at}: {bad}")
        self.known[name] = written(x, "reml-solved")
        return self.known[name]


def fit_reml(
    hv: Callable[[np.ndarray, DataFrame], DataFrame], parts: Callable[[DataFrame], DataFrame], response: DataFrame, q: DataFrame, samples: DataFrame, theta: np.ndarray, traces: int = 4, rounds: int = 20,
    tol: float = 1e-3, floor: float = 1e-2, correction: Callable[[Operator], dict] | None = None, quadrature_of: tuple[int, int] = (4, 8), halvings: int = 6,
    start: DataFrame | None = None, n: int | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """(theta, history): variance components, genetic ones first and the residual last, by average-information scoring guarded by the likelihood.

    hv(theta, x) is H x; parts(x) is (s, comp, r, x) with all K_comp x. Scores are (y'P K P y - tr(P K)) / 2 with traces from fixed ±1
    probes. The objective is -(log|H| + log|Q'H⁻¹Q| + y'Py) / 2, log|H| by Lanczos on fixed probes too (their number and steps: quadrature_of), so its changes are free
    of sampling; a step at which it falls is halved, `halvings` times at most, and given up if it still falls. Solutions are kept: a trial that is
    accepted is the next round's start, and each solve begins at the last one's result.

    It ends where no component would move by more than tol of the whole, or where no part of a step is accepted. history has for each round theta, score, information,
    the step proposed there, objective, halvings taken and kkt: the largest score of a free component, or of one at its bound that pulls inwards, in standard deviations.
    correction(project) is what tr(P K) is too large by, per component (-1: the residual), with project(b) = P b at the present theta; the objective
    doesn't know it, so the guard is off then.

    Tables may be in coordinates (narrow.Span): start (s, r, x) are then the first `traces` probes in them and n the samples' number, and both traces and likelihood take these.
    """
    g = len(theta) - 1
    if start is not None:
        quadrature_of = traces, quadrature_of[1]
    n = samples.count() if n is None else n
    qs = written(q.select("s", F.col("r").cast("long").alias("r"), "x"), "reml-covariates")
    ranks = sorted(r.r for r in qs.select("r").distinct().collect())
    u = written(probes(samples, traces) if start is None else start, "reml-probes")
    rhs = written(sided(response.select("s", F.lit(0).alias("r"), F.col("y").cast("double").alias("x")), RESPONSE).unionByName(sided(qs, COVARIATE)).unionByName(sided(u, PROBE)), "reml-rhs")
    solutions = Solutions(hv)

    def projected(name: str, at: np.ndarray, b: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """(P b, Q'H⁻¹Q) for b with sides of several kinds, the covariates among them: P b = H⁻¹b - H⁻¹Q (Q'H⁻¹Q)⁻¹ Q'H⁻¹b."""
        x = solutions.solve(name, at, b)
        cross = qs.select("s", F.col("r").alias("i"), F.col("x").alias("q")).join(x, "s").groupBy("i", "r").agg(F.sum(F.col("q") * F.col("x")).alias("d")).collect()  # a few numbers per side
        inner = {(r.i, r.r): r.d for r in cross}
        sides = sorted({r for _, r in inner if r >= KIND})
        gram = np.array([[inner[i, j] for j in ranks] for i in ranks]).reshape(len(ranks), len(ranks))
        if not ranks:
            return x, gram
        c = np.linalg.solve(gram, np.array([[inner[i, r] for r in sides] for i in ranks]))
        share = b.sparkSession.createDataFrame([(int(i), int(r), float(c[k, m])) for k, i in enumerate(ranks) for m, r in enumerate(sides)], "i long, r long, c double")
        own = x.where(F.col("r") < KIND).select("s", F.col("r").alias("i"), F.col("x").alias("h"))
        off = own.join(F.broadcast(share), "i").groupBy("s", "r").agg(F.sum(F.col("h") * F.col("c")).alias("o"))  # sides times covariates
        out = x.where(F.col("r") >= KIND).join(off, ["s", "r"], "left").select("s", "r", (F.col("x") - F.coalesce("o", F.lit(0.0))).alias("x"))
        return written(out, "reml-projected"), gram

    def evaluated(at: np.ndarray) -> tuple[float, DataFrame]:
        """(objective, P of response and probes)."""
        p, gram = projected("whole", at, rhs)
        fit = sum(dots(of_kind(p, RESPONSE), of_kind(rhs, RESPONSE)).values())
        inside = float(np.linalg.slogdet(gram)[1]) if ranks else 0.0
        whole = logdet(lambda t: hv(at, t), samples, n, *quadrature_of, start=start)[0] if correction is None else 0.0
        return -0.5 * (whole + inside + fit), p

    def beside(b: DataFrame) -> DataFrame:
        """P b at the present theta for b without the covariates."""
        own = written(sided(b, OTHER).unionByName(sided(qs, COVARIATE)), "reml-beside")
        solutions.known.pop("beside", None)  # other sides each time
        return of_kind(projected("beside", theta, own)[0], OTHER)

    history: list[dict] = []
    objective, p = evaluated(theta)
    for turn in range(rounds):
        k = written(parts(p).select("s", "comp", "r", "x").unionByName(p.select("s", F.lit(g).cast("int").alias("comp"), "r", "x")), "reml-parts")
        py = of_kind(p, RESPONSE).select("s", F.col("x").alias("y"))
        own = k.where(F.floor(F.col("r") / KIND) == RESPONSE)
        first = {r.comp: r.d for r in own.join(py, "s").groupBy("comp").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()}  # a row per component
        signs = sided(u, PROBE).withColumnRenamed("x", "u")
        trace = {r.comp: r.d / traces for r in k.join(signs, ["s", "r"]).groupBy("comp").agg(F.sum(F.col("x") * F.col("u")).alias("d")).collect()}  # a row per component
        off = correction(beside) if correction else {}
        score = np.array([0.5 * (first.get(c, 0.0) - trace.get(c, 0.0) + off.get(c if c < g else -1, 0.0)) for c in range(g + 1)])
        kpy = own.select("s", F.col("comp").cast("long").alias("r"), "x")
        again = of_kind(projected("information", theta, written(sided(kpy, PRODUCT).unionByName(sided(qs, COVARIATE)), "reml-information"))[0], PRODUCT)
        cross = kpy.select("s", F.col("r").alias("a"), "x").join(again.select("s", F.col("r").alias("b"), F.col("x").alias("y")), "s").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()
        info = np.zeros((g + 1, g + 1))
        for r in cross:
            info[r.a, r.b] = 0.5 * r.d
        info = (info + info.T) / 2
        step = bounded_step(score, info, theta, floor)
        held = theta - np.append(np.zeros(g), floor) <= 1e-12
        pull = np.where(held, np.maximum(score, 0.0), np.abs(score)) / np.sqrt(np.maximum(np.diag(info), 1e-300))
        history.append({"round": turn, "theta": theta.tolist(), "score": score.tolist(), "info": info.tolist(), "step": float(np.abs(step).max()), "objective": objective, "kkt": float(pull.max()), "halved": 0, "iterations": solutions.iterations})
        if np.abs(step).max() <= tol * theta.sum():
            break
        for halved in range(halvings + 1):
            trial = theta + step / 2**halved
            reached, p_trial = evaluated(trial)
            if correction is not None or reached >= objective - 1e-9 * abs(objective):
                theta, objective, p = trial, reached, p_trial
                history[-1]["halved"] = halved
                break
        else:
            history[-1]["halved"] = halvings + 1
            break
    return theta, history


def fit_from(starts: list[np.ndarray], fit: Callable[[np.ndarray], tuple[np.ndarray, list[dict]]]) -> tuple[np.ndarray, list[dict]]:
    """The fit of the highest objective among those from several starts, ties to the first."""
    found = [fit(np.asarray(s, float)) for s in starts]
    return max(found, key=lambda x: x[1][-1]["objective"])


def lasso_path(gram: np.ndarray, q: np.ndarray, lams: np.ndarray, tol: float = 1e-8, maxiter: int = 10_000) -> np.ndarray:
    """(len(lams), k) minimisers of b'Gb/2 - q'b + lam |b|, by coordinate descent with warm starts, on a bounded set of candidates; a point that doesn't converge is an error."""
    k = len(q)
    out, b = np.zeros((len(lams), k)), np.zeros(k)
    gb, d = np.zeros(k), np.maximum(np.diag(gram), 1e-8)
    for i, lam in enumerate(lams):
        for _ in range(maxiter):
            moved = 0.0
            for j in range(k):
                r = q[j] - gb[j] + gram[j, j] * b[j]
                new = np.sign(r) * max(abs(r) - lam, 0.0) / d[j]
                if new != b[j]:
                    gb += gram[:, j] * (new - b[j])
                    moved = max(moved, abs(new - b[j]) * d[j] ** 0.5)
                    b[j] = new
            if moved <= tol:
                break
        else:
            raise ValueError(f"no convergence at lambda {lam}")
        out[i] = b
    return out
