"""Matrix-free products with the standardised genotype matrix Z: a join on the sample or the variant, and a grouped sum.

Vectors are tables: over samples (s, r, x), over variants (v, r, b); r numbers the right-hand sides of one scan. Centring
needs no dense work: Z'x of a variant is inv (sum of g x - mean sum of x) over its calls, so statistics meet sums, not calls.
geno is the long table (s, v, g) or, for large ones, packed Tiles, which multiply without a row per call, or Rows where variants are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators.narrow import Rows
from velspar.operators.tiles import Tiles


def calls(geno: DataFrame | Tiles | Rows) -> DataFrame:
    if isinstance(geno, Tiles | Rows):
        return geno.calls()
    return geno.where("g is not null").select("s", "v", "g")


def zt(geno: DataFrame | Tiles | Rows, stats: DataFrame, x: DataFrame) -> DataFrame:
    """(v, r, b) = Z'x for x (s, r, x). Partial sums per variant and task come before the shuffle."""
    if isinstance(geno, Tiles | Rows):
        return geno.zt(stats, x)
    sums = calls(geno).join(x, "s").groupBy("v", "r").agg(F.sum(F.col("g") * F.col("x")).alias("gx"), F.sum("x").alias("sx"))
    return sums.join(stats.select("v", "mean", "inv"), "v").select("v", "r", (F.col("inv") * (F.col("gx") - F.col("mean") * F.col("sx"))).alias("b"))


def z(geno: DataFrame | Tiles | Rows, stats: DataFrame, b: DataFrame, keep: tuple[str, ...] = ("r",)) -> DataFrame:
    """(s, *keep, x) = Z b for b (v, *keep, b): scores of samples; keep may name a component or a path place beside r."""
    if isinstance(geno, Tiles | Rows):
        return geno.z(stats, b, keep)
    scaled = b.join(stats.select("v", "mean", "inv"), "v").select("v", *keep, (F.col("inv") * F.col("b")).alias("w"), (F.col("mean") * F.col("inv") * F.col("b")).alias("c"))
    return calls(geno).join(scaled, "v").groupBy("s", *keep).agg(F.sum(F.col("g") * F.col("w") - F.col("c")).alias("x"))


def zt_sparse(entries: DataFrame, stats: DataFrame, x: DataFrame) -> DataFrame:
    """(v, r, b) = Z'x for all variants of stats from entries (s, v, g) that list only calls above 0 and missing ones (null): the zeros enter by the sum of x alone.

    x has a row for every sample of the cohort whose value isn't 0. The entries are what is scanned and shuffled; the rest is a row per variant.
    """
    x = x.select("s", "r", "x")
    total = F.broadcast(x.groupBy("r").agg(F.sum("x").alias("t")))  # a row per right-hand side
    sums = entries.join(x, "s").groupBy("v", "r").agg(F.sum(F.col("g") * F.col("x")).alias("gx"), F.sum(F.when(F.col("g").isNull(), F.col("x"))).alias("mx"))
    every = stats.select("v", "mean", "inv").crossJoin(total).join(sums, ["v", "r"], "left")
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select("v", "r", (F.col("inv") * (some("gx") - F.col("mean") * (F.col("t") - some("mx")))).alias("b"))


def z_sparse(entries: DataFrame, stats: DataFrame, b: DataFrame, samples: DataFrame) -> DataFrame:
    """(s, r, x) = Z b for all samples (s) from entries as in zt_sparse: a sample of zeros alone scores minus the sum of mean inv b, which entries correct."""
    scaled = b.join(stats.select("v", "mean", "inv"), "v").select("v", "r", (F.col("inv") * F.col("b")).alias("w"), (F.col("mean") * F.col("inv") * F.col("b")).alias("c"))
    base = F.broadcast(scaled.groupBy("r").agg(F.sum("c").alias("c")))  # a row per right-hand side
    more = entries.join(scaled, "v").groupBy("s", "r").agg(F.sum(F.coalesce(F.col("g") * F.col("w"), F.col("c"))).alias("e"))
    return samples.select("s").crossJoin(base).join(more, ["s", "r"], "left").select("s", "r", (F.coalesce("e", F.lit(0.0)) - F.col("c")).alias("x"))


def effective(stats: DataFrame, components: DataFrame) -> DataFrame:
    """(comp, m_eff): variants that vary, 1 where there is none, so that dividing by it changes nothing."""
    return components.join(stats, "v").groupBy("comp").agg(F.greatest(F.count(F.when(F.col("inv") > 0, 1)), F.lit(1)).alias("m_eff"))


def k_by_component(geno: DataFrame, stats: DataFrame, components: DataFrame, x: DataFrame) -> DataFrame:
    """(s, comp, r, x) = K_comp x, K_comp = Z_comp Z_comp' / m_eff, for all components in one pass each way."""
    b = zt(geno, stats, x).join(components, "v").join(effective(stats, components), "comp").select("v", "comp", "r", (F.col("b") / F.col("m_eff")).alias("b"))
    return z(geno, stats, b, ("comp", "r"))


def k(geno: DataFrame, stats: DataFrame, x: DataFrame) -> DataFrame:
    """(s, r, x) = K x over all variants."""
    one = stats.select("v", F.lit(0).alias("comp"))
    return k_by_component(geno, stats, one, x).drop("comp")


def h(geno: DataFrame, stats: DataFrame, components: DataFrame, theta: DataFrame, theta_e: float, x: DataFrame) -> DataFrame:
    """(s, r, x) = theta_e x + sum of theta_comp K_comp x in one pass each way; theta is (comp, theta)."""
    b = zt(geno, stats, x).join(components, "v").join(effective(stats, components), "comp").join(theta, "comp")
    b = b.select("v", "r", (F.col("b") * F.col("theta") / F.col("m_eff")).alias("b"))
    both = z(geno, stats, b).unionByName(x.select("s", "r", (F.col("x") * theta_e).alias("x")))
    return both.groupBy("s", "r").agg(F.sum("x").alias("x"))


def k_weighted(geno: DataFrame, stats: DataFrame, weights: DataFrame, denom: float, x: DataFrame) -> DataFrame:
    """(s, r, x) = Z diag(w) Z' x / denom for weights (v, w)."""
    b = zt(geno, stats, x).join(weights, "v").select("v", "r", (F.col("b") * F.col("w") / denom).alias("b"))
    return z(geno, stats, b)


def k_blocks(geno: DataFrame, stats: DataFrame, blocks: DataFrame, scale: float, x: DataFrame) -> DataFrame:
    """(s, r, x) = sum over blocks of Z_b W_b Z_b' x / scale for W entries (i, j, w), i and j variants."""
    b = zt(geno, stats, x).withColumnRenamed("v", "j").join(blocks, "j").groupBy(F.col("i").alias("v"), "r").agg((F.sum(F.col("b") * F.col("w")) / scale).alias("b"))
    return z(geno, stats, b)


def block_effects(geno: DataFrame, stats: DataFrame, blocks: DataFrame, scale: float, theta: float, alpha: DataFrame) -> DataFrame:
    """(v, r, b) = theta W Z' alpha / scale, so that Z b = theta K alpha."""
    b = zt(geno, stats, alpha).withColumnRenamed("v", "j").join(blocks, "j")
    return b.groupBy(F.col("i").alias("v"), "r").agg((F.sum(F.col("b") * F.col("w")) * theta / scale).alias("b"))


def block_scale(geno: DataFrame, stats: DataFrame, blocks: DataFrame, n: int) -> float:
    """tr(sum of Z_b W_b Z_b') / n: the sum over W entries of w times the product of the two columns of Z."""
    gram = gram_matrix(geno, stats, blocks.select(F.col("i").alias("v")).union(blocks.select("j")).distinct())
    got = blocks.join(gram, ["i", "j"]).agg((F.sum(F.col("w") * F.col("q")) / n).alias("c")).first()
    return float(got.c or 0.0)


def gram_matrix(geno: DataFrame, stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """(i, j, q) = Z_chosen' Z_chosen for a bounded set of variants (v): a join on the sample, grouped by pair."""
    got = calls(geno).join(chosen, "v").join(stats.select("v", "mean", "inv"), "v").select("s", "v", ((F.col("g") - F.col("mean")) * F.col("inv")).alias("z"))
    a, b = got.select("s", F.col("v").alias("i"), F.col("z").alias("zi")), got.select("s", F.col("v").alias("j"), F.col("z").alias("zj"))
    return a.join(b, "s").groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("q"))


def projected_core(geno: DataFrame, stats: DataFrame, u: DataFrame, subtract_identity: bool = False) -> DataFrame:
    """(p, q, c) = U' K U for u (s, r, x): from Z'U alone, without K U."""
    t = zt(geno, stats, u)
    m = stats.agg(F.greatest(F.count(F.when(F.col("inv") > 0, 1)), F.lit(1)).alias("m_eff"))
    a, b = t.select("v", F.col("r").alias("p"), F.col("b").alias("x")), t.select("v", F.col("r").alias("q"), F.col("b").alias("y"))
    got = a.join(b, "v").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("c")).crossJoin(F.broadcast(m))  # one row
    out = F.col("c") / F.col("m_eff")
    return got.select("p", "q", (out - F.when(F.col("p") == F.col("q"), 1.0).otherwise(0.0) if subtract_identity else out).alias("c"))


def admixed(x: DataFrame, q: DataFrame, product) -> DataFrame:
    """(s, a, r, x) = D_a^1/2 K D_a^1/2 x for ancestry weights q (s, a, q) and product, a function of a table (s, r, x) such as K."""
    root = q.select("s", "a", F.sqrt("q").alias("d"))
    inner = x.join(root, "s").select("s", F.struct("a", "r").alias("r"), (F.col("x") * F.col("d")).alias("x"))
    got = product(inner).select("s", F.col("r.a").alias("a"), F.col("r.r").alias("r"), "x")
    return got.join(root, ["s", "a"]).select("s", "a", "r", (F.col("x") * F.col("d")).alias("x"))
