"""Several block-weighted kernels over one genotype table: K_k is the sum over its blocks of Z_b W_b Z_b' / c_k, all from one scan each way.

entries (kernel, block, i, j, w) are the entries of the W of every kernel, i and j variants of one block. An entry is a row, so blocks of any widths stand
beside each other, and a kernel costs what its entries are. A variant may be in one block of each kernel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.operators import linops
from velspar.operators.narrow import Rows
from velspar.operators.stats import standardised


def checked(entries: DataFrame) -> DataFrame:
    """entries, if each is finite and given once, every W is symmetric and no variant is in two blocks of a kernel; else an error."""
    bad = entries.agg(F.count(F.when(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")), 1)).alias("bad")).first().bad
    if bad:
        raise ValueError(f"{bad} weights aren't finite")
    if not entries.groupBy("kernel", "block", "i", "j").count().where("count > 1").isEmpty():
        raise ValueError("a weight is given twice")
    other = entries.select("kernel", "block", F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("o"))
    if not entries.join(other, ["kernel", "block", "i", "j"], "left").where(F.col("o").isNull() | (F.abs(F.col("w") - F.col("o")) > 1e-6 * F.greatest(F.abs("w"), F.lit(1.0)))).isEmpty():
        raise ValueError("a block isn't symmetric")
    if not entries.groupBy("kernel", "i").agg(F.count_distinct("block").alias("blocks")).where("blocks > 1").isEmpty():
        raise ValueError("a variant is in two blocks of a kernel")
    return entries


def widths(entries: DataFrame) -> DataFrame:
    """(kernel, block, width): variants in each block."""
    return entries.groupBy("kernel", "block").agg(F.count_distinct("i").alias("width"))


def rank_scales(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """(kernel, c): the sum of the stored effective ranks (kernel, block, rank) of a kernel's blocks; a block without one, one without a block, or one outside (0, width] is an error."""
    both = widths(entries).join(stored.select("kernel", "block", "rank"), ["kernel", "block"], "full")
    wrong = both.where(F.col("width").isNull() | F.col("rank").isNull() | ~((F.col("rank") > 0) & (F.col("rank") <= F.col("width")))).orderBy("kernel", "block").limit(3).collect()
    if wrong or not stored.groupBy("kernel", "block").count().where("count > 1").isEmpty():
        raise ValueError(f"effective ranks don't fit their blocks: {[tuple(r) for r in wrong]}")
    return both.groupBy("kernel").agg(F.sum("rank").cast("double").alias("c"))


def forms(geno: DataFrame | Rows, stats: DataFrame, entries: DataFrame) -> DataFrame:
    """(s, kernel, d): z_s' W_k z_s, the diagonals of the kernels before scaling. A call meets the entries of its own blocks only, and sums per sample and variant come before the second join."""
    if isinstance(geno, Rows):
        return geno.forms(stats, entries)
    z = standardised(linops.calls(geno), stats)
    own = z.withColumnRenamed("v", "j").join(entries, "j").groupBy("s", "kernel", F.col("i").alias("v")).agg(F.sum(F.col("w") * F.col("z")).alias("wz"))
    return own.join(z, ["s", "v"]).groupBy("s", "kernel").agg(F.sum(F.col("z") * F.col("wz")).alias("d"))


def trace_scales(geno: DataFrame, stats: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """(kernel, c): tr(sum of Z_b W_b Z_b') / n, with which a kernel's mean diagonal over n samples is 1; one that isn't positive is an error."""
    out = forms(geno, stats, entries).groupBy("kernel").agg((F.sum("d") / n).alias("c"))
    kernels, good = entries.select("kernel").distinct().count(), [r.c for r in out.collect()]  # a row per kernel
    if len(good) < kernels or not all(c > 0 for c in good):
        raise ValueError("a kernel has no positive trace")
    return out


def diagonals(geno: DataFrame, stats: DataFrame, entries: DataFrame, scales: DataFrame) -> DataFrame:
    """(s, kernel, d): the diagonals of the kernels; a sample without calls has no row."""
    return forms(geno, stats, entries).join(F.broadcast(scales), "kernel").select("s", "kernel", (F.col("d") / F.col("c")).alias("d"))  # a row per kernel


def _weighted(geno: DataFrame, stats: DataFrame, entries: DataFrame, scales: DataFrame, x: DataFrame) -> DataFrame:
    """(v, kernel, r, b): W_k Z'x / c_k from one Z'x for all kernels."""
    scaled = entries.join(F.broadcast(scales), "kernel").select("kernel", "i", F.col("j").alias("v"), (F.col("w") / F.col("c")).alias("w"))  # a row per kernel
    return linops.zt(geno, stats, x).join(scaled, "v").groupBy(F.col("i").alias("v"), "kernel", "r").agg(F.sum(F.col("w") * F.col("b")).alias("b"))


def products(geno: DataFrame, stats: DataFrame, entries: DataFrame, scales: DataFrame, x: DataFrame) -> DataFrame:
    """(s, kernel, r, x) = K_k x for all kernels and right-hand sides."""
    return linops.z(geno, stats, _weighted(geno, stats, entries, scales, x), ("kernel", "r"))


def effects(geno: DataFrame, stats: DataFrame, entries: DataFrame, scales: DataFrame, theta: DataFrame, alpha: DataFrame) -> DataFrame:
    """(v, kernel, r, b) for theta (kernel, theta), so that Z b of a kernel is theta_k K_k alpha."""
    own = _weighted(geno, stats, entries, scales, alpha).join(F.broadcast(theta), "kernel")  # a row per kernel
    return own.select("v", "kernel", "r", (F.col("b") * F.col("theta")).alias("b"))


def h(geno: DataFrame, stats: DataFrame, entries: DataFrame, scales: DataFrame, theta: DataFrame, theta_e: float, x: DataFrame) -> DataFrame:
    """(s, r, x) = theta_e x + sum of theta_k K_k x: the kernels meet on the variants, so the way back to the samples carries one number a side."""
    b = effects(geno, stats, entries, scales, theta, x).groupBy("v", "r").agg(F.sum("b").alias("b"))
    both = linops.z(geno, stats, b).unionByName(x.select("s", "r", (F.col("x") * theta_e).alias("x")))
    return both.groupBy("s", "r").agg(F.sum("x").alias("x"))
