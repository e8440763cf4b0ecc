"""Per-variant statistics and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the least variance under the root of a standard deviation.
FLOOR = 1e-6


def inverse_sd(cnt: Column, s1: Column, s2: Column) -> Column:
    """1 / sd of the calls, population variance floored; 0 for a variant without variation, decided on exact integers."""
    mean = s1.cast("double") / cnt
    return F.when((cnt > 0) & (cnt * s2 - s1 * s1 > 0), 1 / F.sqrt(F.greatest(s2.cast("double") / cnt - mean * mean, F.lit(FLOOR)))).otherwise(F.lit(0.0))


def variant_stats(geno: DataFrame) -> DataFrame:
    """(v, cnt, s1, s2, mean, inv): the calls of each variant; one shuffle of three integers per variant and task."""
    got = geno.groupBy("v").agg(F.count("g").alias("cnt"), F.coalesce(F.sum("g"), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0)).alias("s2"))
    return with_moments(got)


def with_moments(sums: DataFrame) -> DataFrame:
    """sums (v, cnt, s1, s2) with mean and inv."""
    mean = F.when(F.col("cnt") > 0, F.col("s1").cast("double") / F.col("cnt")).otherwise(F.lit(0.0))
    return sums.withColumn("mean", mean).withColumn("inv", inverse_sd(F.col("cnt"), F.col("s1"), F.col("s2")))


def sparse_stats(entries: DataFrame, variants: DataFrame, n: int | Column) -> DataFrame:
    """variant_stats of n samples for variants (v), from entries (s, v, g) that list only calls above 0 and missing ones (null)."""
    got = entries.groupBy("v").agg(F.sum(F.col("g").isNull().cast("long")).alias("m"), F.sum("g").cast("long").alias("s1"), F.sum(F.col("g") * F.col("g")).cast("long").alias("s2"))
    n = F.lit(n) if isinstance(n, int) else n
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return with_moments(variants.select("v").join(got, "v", "left").select("v", (n - zero("m")).alias("cnt"), zero("s1").alias("s1"), zero("s2").alias("s2")))


def trace_atoms(stats: DataFrame, components: DataFrame, n: int | Column) -> DataFrame:
    """(comp, m_eff, atom): variants that vary, and tr(K)/n = calls of those variants / (n m_eff); missing calls lower it below 1."""
    got = stats.join(components, "v").groupBy("comp")
    got = got.agg(F.count(F.when(F.col("inv") > 0, 1)).alias("m_eff"), F.coalesce(F.sum(F.when(F.col("inv") > 0, F.col("cnt"))), F.lit(0)).alias("calls"))
    n = F.lit(n) if isinstance(n, int) else n
    return got.select("comp", "m_eff", F.when(F.col("m_eff") > 0, F.col("calls").cast("double") / (n * F.col("m_eff"))).otherwise(F.lit(0.0)).alias("atom"))


def standardised(geno: DataFrame, stats: DataFrame) -> DataFrame:
    """(s, v, z): standardised calls; a missing one is 0 after centring and has no row. Also puts test genotypes on training statistics."""
    return geno.where("g is not null").join(stats.select("v", "mean", "inv"), "v").select("s", "v", ((F.col("g") - F.col("mean")) * F.col("inv")).alias("z"))


def relationship_diagonal(geno: DataFrame, stats: DataFrame) -> DataFrame:
    """(s, d): the diagonal of K = Z Z' / m_eff."""
    m = stats.where("inv > 0").agg(F.count("*").alias("m_eff"))
    got = standardised(geno, stats).groupBy("s").agg(F.sum(F.col("z") * F.col("z")).alias("ss"))
    return got.crossJoin(F.broadcast(m)).select("s", (F.col("ss") / F.when(F.col("m_eff") > 0, F.col("m_eff")).otherwise(1)).alias("d"))  # one row of one number


def standardised_response(pheno: DataFrame) -> DataFrame:
    """(s, y): centred and divided by the population standard deviation + 1e-6; empty, non-finite or constant responses are an error."""
    got = pheno.agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"), F.count("y").alias("n")).first()
    if not got.n or got.sd is None or not abs(got.mu) < float("inf") or not 0 < got.sd < float("inf"):
        raise ValueError("the response is empty, not finite or constant")
    return pheno.select("s", ((F.col("y") - got.mu) / (got.sd + 1e-6)).alias("y"))


def rare_entries(geno: DataFrame) -> DataFrame:
    """(s, v, kind): only heterozygous, homozygous and missing calls, for variants that are nearly always 0."""
    return geno.where("g is null or g > 0").select("s", "v", F.when(F.col("g").isNull(), "missing").when(F.col("g") == 1, "het").otherwise("hom").alias("kind"))
