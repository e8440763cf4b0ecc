"""The adaptive score test: would splitting the variants at a rank cut explain more covariance?

For a cut after t of M variants the direction is D = Z_low Z_low' / t - Z_high Z_high' / (M - t). Its score is (y'P D P y - tr(P D)) / 2, less what
the components' and the residual's own scores explain. All cuts come from one scan by prefix sums over rank bins.

P is split into a core C C', exact in a few columns, and a rest, known by random draws of that covariance. A direction's form over the columns of
the core and the draws holds all that is needed of it: weighted pair by pair, forms are vectors whose inner products are the information, what nuisances
explain of a cut is a least-squares fit of its vector by theirs, and what is left of the form is the cut's part of the scores' joint law.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.operators import linops
from velspar.operators.solvers import Operator, pcg
from velspar.sources.shared import written

#: Draws of the joint law that one task makes at a time.
DRAWS = 512


def gated(product: Operator, b: DataFrame, tol: float, maxiter: int, factor: float = 5.0, floor: float = 5e-5, **more) -> DataFrame:
    """H⁻¹ b, written; an error where the residual, computed anew, is above max(factor * tol, floor)."""
    x, error, _ = pcg(product, b, tol=tol, maxiter=maxiter, **more)
    bad = {r: e for r, e in error.items() if not e <= max(factor * tol, floor)}
    if bad:
        raise ValueError(f"unsolved right-hand sides: {bad}")
    return written(x, "score-solved")


def projector(product: Operator, q: DataFrame, tol: float = 1e-6, maxiter: int = 200) -> Operator:
    """b -> P b = H⁻¹b - H⁻¹Q (Q'H⁻¹Q)⁺ Q'H⁻¹b for covariates q (s, r, x); H⁻¹Q is solved once."""
    q = q.select("s", F.col("r").cast("long").alias("r"), "x")
    hq = gated(product, q, tol, maxiter)
    qs = q.select("s", F.col("r").alias("i"), F.col("x").alias("q"))

    def inner(x: DataFrame) -> dict[tuple[int, int], float]:
        rows = qs.join(x, "s").groupBy("i", "r").agg(F.sum(F.col("q") * F.col("x")).alias("d")).collect()  # a few numbers per side
        return {(r.i, r.r): r.d for r in rows}

    gram = inner(hq)
    names = sorted({i for i, _ in gram})
    inverse = np.linalg.pinv(np.array([[gram[i, j] for j in names] for i in names]), rcond=1e-10)

    def apply(b: DataFrame) -> DataFrame:
        x = gated(product, b.select("s", F.col("r").cast("long").alias("r"), "x"), tol, maxiter)
        got = inner(x)
        sides = sorted({r for _, r in got})
        share = inverse @ np.array([[got.get((i, r), 0.0) for r in sides] for i in names])
        table = b.sparkSession.createDataFrame([(int(i), int(r), float(share[k, m])) for k, i in enumerate(names) for m, r in enumerate(sides)], "i long, r long, c double")
        off = hq.select("s", F.col("r").alias("i"), F.col("x").alias("h")).join(F.broadcast(table), "i").groupBy("s", "r").agg(F.sum(F.col("h") * F.col("c")).alias("o"))
        return written(x.join(off, ["s", "r"], "left").select("s", "r", (F.col("x") - F.coalesce("o", F.lit(0.0))).alias("x")), "score-projected")

    return apply


def normal(*keys: Column | str, seed: int) -> Column:
    """A standard normal number from a hash of keys and seed, the same under any partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))


def draws(geno: DataFrame, stats: DataFrame, components: DataFrame, theta: DataFrame, theta_e: float, samples: DataFrame, count: int, seed: int = 1, first: int = 0) -> DataFrame:
    """(s, r, x): `count` random vectors of covariance H, r from `first` on; P of one has covariance P."""
    sides = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))).alias("r")
    b = components.join(linops.effective(stats, components), "comp").join(theta, "comp").select("v", F.sqrt(F.col("theta") / F.col("m_eff")).alias("c"), sides)
    genetic = linops.z(geno, stats, b.select("v", "r", (F.col("c") * normal("v", "r", seed=seed)).alias("b")))
    own = samples.select("s", sides).select("s", "r", (normal("s", "r", seed=seed + 1) * theta_e**0.5).alias("x"))
    return written(genetic.unionByName(own).groupBy("s", "r").agg(F.sum("x").alias("x")), "score-draws")


def cross_products(b: DataFrame, new: DataFrame) -> DataFrame:
    """(bin, comp, p, q, c): sums over a bin's variants of (Z'x_p)(Z'x_q) for all columns of b and new, both (v, r, b, bin, comp), as Z'x joined with bins."""
    other = new.select("v", F.col("r").alias("q"), F.col("b").alias("y"))
    return b.withColumnRenamed("r", "p").join(other, "v").groupBy("bin", "comp", "p", "q").agg(F.sum(F.col("b") * F.col("y")).alias("c"))


def directions(bins: DataFrame, stats: DataFrame, products: dict, inner: dict, sides: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(forms, cuts, nuisances): x'D x for the components, the identity and then each cut, over the sides.

    products is {(bin, comp): {(p, q): sum}} of bin_products, inner {(p, q): x_p'x_q}; a few numbers per bin and pair of sides.
    """
    at = {r: k for k, r in enumerate(sides)}
    inside = bins.join(stats.where("inv > 0").select("v"), "v").groupBy("bin", "comp").agg(F.count("*").alias("n")).collect()
    order, comps = sorted({r.bin for r in inside}), sorted({r.comp for r in inside})
    cells = np.zeros((len(order), len(comps), len(sides), len(sides)))
    sizes = np.zeros((len(order), len(comps)))
    for r in inside:
        k, c = order.index(r.bin), comps.index(r.comp)
        sizes[k, c] = r.n
        for (p, q), value in products.get((r.bin, r.comp), {}).items():
            if p in at and q in at:
                cells[k, c, at[p], at[q]] = cells[k, c, at[q], at[p]] = value
    same = np.array([[[inner.get((p, q), inner.get((q, p), 0.0)) for q in sides] for p in sides]])
    kernels = cells.sum(0) / sizes.sum(0)[:, None, None]
    below, t = np.cumsum(cells.sum(1), 0)[:-1], np.cumsum(sizes.sum(1))[:-1]
    above = cells.sum((0, 1)) - below
    cuts = below / t[:, None, None] - above / (sizes.sum() - t)[:, None, None]
    return np.concatenate((kernels, same, cuts)), t.astype(int), len(comps) + 1


@dataclass(frozen=True)
class Sketch:
    """Forms (d, k, k) of d directions over k columns: the first `core` hold a part of P exactly, the others are draws of the rest's covariance."""

    forms: np.ndarray
    core: int = 0

    @staticmethod
    def of(forms: np.ndarray, core: int = 0) -> Sketch:
        d, k, other = (*forms.shape, 0, 0, 0)[:3]
        if forms.ndim != 3 or k != other or k - core < 3:
            raise ValueError("a sketch takes square forms over three draws or more")
        if not np.isfinite(forms).all():
            raise ValueError("forms must be finite")
        return Sketch(forms, core)

    @property
    def count(self) -> int:
        return self.forms.shape[1] - self.core

    def weights(self, without: int | None = None) -> np.ndarray:
        """What a product of two forms' entries counts in tr(P D P D'): an entry of the core as it is, one of core and draw as a mean over draws, one of
        two draws as a mean over their pairs; a draw with itself says nothing of it. A draw may be left out."""
        m = self.count - (without is not None)
        draw = (np.arange(self.forms.shape[1]) >= self.core).astype(int)
        share = np.array([1.0, 1.0 / m, 1.0 / (m * (m - 1))])[draw[:, None] + draw]
        share[np.diag_indices_from(share)] *= 1 - draw
        if without is not None:
            share[self.core + without] = share[:, self.core + without] = 0
        return share

    def vectors(self) -> np.ndarray:
        """A vector for each direction; their inner products are estimates of tr(P D P D') / 2."""
        return (self.forms * np.sqrt(self.weights() / 2)).reshape(len(self.forms), -1)

    def information(self, rows: int) -> np.ndarray:
        """The information between the first `rows` directions and all."""
        v = self.vectors()
        return v[:rows] @ v.T

    def traces(self) -> tuple[np.ndarray, np.ndarray]:
        """(tr(P D), the standard error of its part from draws)."""
        diagonal = np.diagonal(self.forms, axis1=1, axis2=2)
        drawn = diagonal[:, self.core :]
        return diagonal[:, : self.core].sum(1) + drawn.mean(1), drawn.std(1, ddof=1) / self.count**0.5

    def mixed(self, weights: np.ndarray) -> Sketch:
        """The sketch of directions that are sums of these."""
        return Sketch(np.tensordot(weights, self.forms, 1), self.core)


def nuisance_coefficients(pilot: Sketch, nuisances: int) -> np.ndarray:
    """(cuts, nuisances): what to take of the nuisances' scores from each cut's, the least-squares fit of its vector by theirs. It comes from draws of
    its own, so that the error of the fit and that of the scores are independent. Nuisances that can't be told apart share what they explain."""
    v = pilot.vectors().T
    length = np.linalg.norm(v[:, :nuisances], axis=0)
    length[length == 0] = 1.0
    fit = np.linalg.lstsq(v[:, :nuisances] / length, v[:, nuisances:], rcond=RCOND)[0]
    return (fit / length[:, None]).T


#: Fixed value: singular values of the nuisances' unit vectors below this share of the largest are none.
RCOND = 1e-10
#: Solutions are as exact as this; a cut of which the nuisances leave a smaller part isn't told from them.
SOLVED = 1e-6


@dataclass(frozen=True)
class Process:
    """Scores of cuts, raw and efficient, their information (0: not testable), the standard errors of both, and the forms of the joint law."""

    cuts: np.ndarray
    raw: np.ndarray
    scores: np.ndarray
    information: np.ndarray
    trace_error: np.ndarray
    information_error: np.ndarray
    forms: np.ndarray

    @property
    def z(self) -> np.ndarray:
        root = np.sqrt(self.information)
        return np.where(root > 0, self.scores / np.where(root > 0, root, 1.0), 0.0)

    @property
    def imprecision(self) -> float:
        """By how many of its standard deviations a testable score may be off in its centre, or by what share in its scale, at the worst cut."""
        own = self.information > 0
        centre = self.trace_error[own] / np.sqrt(self.information[own])
        scale = self.information_error[own] / (2 * self.information[own])
        return float(max([0.0, *centre, *scale]))


def moments(quadratics: np.ndarray, sketch: Sketch, coefficients: np.ndarray, cuts: np.ndarray) -> Process:
    """The process of cuts from the forms of Py (nuisances first) and a sketch of other draws than the coefficients'."""
    count, m = coefficients.shape
    if (len(quadratics), len(sketch.forms), len(cuts)) != (count + m, count + m, count):
        raise ValueError("the numbers of directions differ")
    if count > 1 and not (cuts[1:] > cuts[:-1]).all():
        raise ValueError("cuts must ascend")
    centred = (quadratics - sketch.traces()[0]) / 2
    contrast = np.concatenate((-coefficients, np.eye(count)), 1)
    left = sketch.mixed(contrast)
    squares = left.forms**2
    info = (squares * sketch.weights()).sum((1, 2)) / 2
    # the length of the cut's vector and of what is taken from it: a difference far below it is the solver's error
    length = np.linalg.norm(sketch.vectors(), axis=1)
    reach = length[m:] + np.abs(coefficients) @ length[:m]
    info = np.where(np.sqrt(info) > SOLVED * reach, info, 0.0)
    dropped = np.array([(squares * sketch.weights(k)).sum((1, 2)) / 2 for k in range(sketch.count)])
    error = np.sqrt((sketch.count - 1) * dropped.var(0))  # the jackknife over draws
    scaled = np.sqrt(sketch.weights() / np.where(info > 0, info, 1.0)[:, None, None]) * left.forms
    return Process(cuts, centred[m:], contrast @ centred, info, left.traces()[1] / 2, error, np.where((info > 0)[:, None, None], scaled, 0.0))


def boundary_maxima(spark: SparkSession, forms: np.ndarray, samples: int = 16_383, seed: int = 1) -> np.ndarray:
    """Draws of the largest |b'Ab - tr A| / 2 over all forms A, b standard normal and the same for all cuts; blocks of draws are tasks."""
    if forms.ndim != 3 or forms.shape[1] != forms.shape[2] or samples < 1:
        raise ValueError("the joint law needs square forms and draws")
    shared = spark.sparkContext.broadcast(forms)  # cuts x draws x draws, as bounded as the sketch
    blocks = -(-samples // DRAWS)

    def drawn(batches: Iterator) -> Iterator:
        import pandas as pd

        a = shared.value
        traces = np.trace(a, axis1=1, axis2=2)
        for batch in batches:
            for block in batch["id"].tolist():
                n = min(DRAWS, samples - block * DRAWS)
                b = np.random.default_rng([seed, block]).standard_normal((n, a.shape[1]))
                top = np.zeros(n)
                for k in range(len(a)):  # cuts one by one, on the same draws
                    top = np.maximum(top, 0.5 * np.abs(np.einsum("bi,bi->b", b @ a[k], b) - traces[k]))
                yield pd.DataFrame({"block": block, "top": top})

    rows = spark.range(blocks).mapInPandas(drawn, "block long, top double").orderBy("block").collect()  # one number per draw
    return np.array([r.top for r in rows])


def calibrated(spark: SparkSession, process: Process, samples: int = 16_383, seed: int = 1, alpha: float = 0.05) -> dict:
    """The cut of the largest |z|, ties to the first; p = (1 + draws at or above it) / (samples + 1); the critical value by its order statistic."""
    z = np.abs(process.z)
    good = np.flatnonzero(process.information > 0)
    if not len(good):
        raise ValueError("no cut can be tested")
    best = int(good[np.argmax(z[good])])
    top = np.sort(boundary_maxima(spark, process.forms[good], samples, seed))
    at = samples - int(np.floor(alpha * (samples + 1)))
    return {"cut": int(process.cuts[best]), "z": float(process.z[best]), "p": float((1 + (top >= z[best]).sum()) / (samples + 1)), "critical": float(top[min(at, samples - 1)]), "untestable": [int(c) for c in process.cuts[process.information == 0]]}


def core_columns(geno: DataFrame, stats: DataFrame, project: Operator, samples: DataFrame, size: int, seed: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(w, c, m): columns w (s, r, x) of a random range of K P, and c = P w m with m = (w'P w)^(-1/2), so that c c' is the part of P that they span."""
    sides = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("r")
    start = samples.select("s", sides).select("s", "r", normal("s", "r", seed=seed + 2).alias("x"))
    w = written(linops.k(geno, stats, project(written(start, "core-start"))), "core-range")
    pw = project(w)
    got = pairs(w, pw)
    gram = np.array([[(got.get((i, j), 0.0) + got.get((j, i), 0.0)) / 2 for j in range(size)] for i in range(size)])
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    values, vectors = np.linalg.eigh(gram / scale / scale[:, None])
    good = values > SOLVED * max(values[-1], 0.0)
    mix = vectors[:, good] / np.sqrt(values[good]) / scale[:, None]
    return w, written(mixture(pw, mix, list(range(size))), "core-columns"), mix


def pairs(a: DataFrame, b: DataFrame) -> dict[tuple[int, int], float]:
    """{(p, q): a_p'b_q}: a number for each two columns of tables (s, r, x)."""
    other = b.select("s", F.col("r").alias("q"), F.col("x").alias("y"))
    rows = a.join(other, "s").groupBy("r", "q").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()
    return {(r.r, r.q): r.d for r in rows}


def mixture(x: DataFrame, weights: np.ndarray, names: list[int], out: list[int] | None = None) -> DataFrame:
    """(s, r, x): sums of the columns of x, a row of weights for each of names, numbered by out."""
    out = list(range(weights.shape[1])) if out is None else out
    rows = [(int(n), int(k), float(weights[i, j])) for i, n in enumerate(names) for j, k in enumerate(out)]
    small = F.broadcast(x.sparkSession.createDataFrame(rows, "r long, k long, w double"))  # columns times columns
    return x.join(small, "r").groupBy("s", "k").agg(F.sum(F.col("x") * F.col("w")).alias("x")).select("s", F.col("k").alias("r"), "x")


#: Numbers of the core's columns start here; draws count from 0, the response is -1.
CORE = 1_000_000


def score_test(geno: DataFrame, stats: DataFrame, components: DataFrame, bins: DataFrame, theta: DataFrame, theta_e: float, response: DataFrame, q: DataFrame, draw_count: int = 16, most: int = 128, tol: float = 0.2, samples: int = 16_383, seed: int = 1, core: int = 0) -> tuple[dict, Process]:
    """(result, process) of testing all cuts between rank bins (v, bin, comp) at the fitted theta.

    A core of `core` columns is treated exactly, draws have the covariance of the rest. Draws double until the process is precise enough, those
    made before stay; if `most` draws aren't enough, that is an error. Components without variance aren't nuisances to be
    fitted, but stay directions. response is (s, y), q the covariates (s, r, x). Even draws fit the nuisances, odd ones give scores and law.
    """
    project = projector(lambda t: linops.h(geno, stats, components, theta, theta_e, t), q)
    samples_of = written(response.select("s"), "score-samples")
    x = project(response.select("s", F.lit(-1).cast("long").alias("r"), F.col("y").alias("x")))
    exact: list[int] = []
    if core:
        w, columns, mix = core_columns(geno, stats, project, samples_of, core, seed)
        exact = [CORE + k for k in range(mix.shape[1])]
        x = x.unionByName(columns.withColumn("r", F.col("r") + CORE))
    products, inner = {}, {}
    known: DataFrame | None = None  # all columns so far and their Z'x, written
    made, count = 0, draw_count

    def extended(new: DataFrame) -> None:
        nonlocal known
        b = written(linops.zt(geno, stats, new).join(bins, "v"), "score-zt")
        every = (new, b) if known is None else (known[0].unionByName(new), known[1].unionByName(b))
        for r in cross_products(every[1], b).collect():
            products.setdefault((r.bin, r.comp), {})[r.p, r.q] = r.c
        inner.update(pairs(every[0], new))
        known = every

    extended(written(x, "score-columns"))
    while True:
        new = project(draws(geno, stats, components, theta, theta_e, samples_of, 2 * count - made, seed, made))
        if core:
            own = pairs(w, new)
            fresh = sorted({r for _, r in own})
            share = mix.T @ np.array([[own[i, r] for r in fresh] for i in range(core)])
            off = mixture(columns, share, list(range(len(share))), fresh).select("s", "r", F.col("x").alias("o"))
            new = written(new.join(off, ["s", "r"], "left").select("s", "r", (F.col("x") - F.coalesce("o", F.lit(0.0))).alias("x")), "score-rest")
        extended(new)
        made = 2 * count
        sides = [-1, *exact, *range(made)]
        forms, cuts, m = directions(bins, stats, products, inner, sides)
        c = len(exact)
        half = lambda odd: [*range(1, c + 1), *range(c + 1 + odd, c + 1 + made, 2)]  # noqa: E731, B023
        pilot, own_sketch = (Sketch.of(forms[np.ix_(range(len(forms)), half(o), half(o))], c) for o in (0, 1))
        process = moments(forms[:, 0, 0], own_sketch, nuisance_coefficients(pilot, m), cuts)
        if process.imprecision <= tol:
            return calibrated(geno.sparkSession, process, samples, seed) | {"draws": count, "core": c, "imprecision": process.imprecision}, process
        if 2 * count > most:
            raise ValueError(f"{count} draws leave an imprecision of {process.imprecision:.3g}")
        count *= 2
