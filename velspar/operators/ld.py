"""LD scores, their ranks and cuts, and what is computed between cuts."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velspar.sources.text import require


def ld_scores(geno: DataFrame, variants: DataFrame, window_bp: int = 1_000_000, samples: int | None = None, width: int = 128, chunk: int = 4096) -> DataFrame:
    """(v, ld_score): 1 + the sum of squared dosage correlations with the variants of its chromosome within window_bp, over the samples called in both.

    variants is (v, chrom, bp). Variants form blocks of about `width` inside a window's bucket, samples chunks of about `chunk`; a task multiplies
    the calls of two neighbouring blocks in one chunk, about a million at most, and gives the sums of each close pair there, which are added over
    the chunks. So a call moves once per neighbouring block, not once per neighbouring variant. samples is their number, counted if it isn't given.
    """
    samples = samples or geno.agg(F.approx_count_distinct("s").alias("n")).first().n
    at = variants.where("chrom is not null and bp is not null").select("v", "chrom", F.col("bp").cast("long").alias("bp")).withColumn("w", F.floor(F.col("bp") / window_bp))
    parts = at.groupBy("chrom", "w").agg(F.ceil(F.count("*") / width).alias("parts"))
    at = at.join(parts, ["chrom", "w"]).select("v", "bp", F.struct("chrom", "w", F.pmod(F.xxhash64("v"), F.col("parts")).alias("k")).alias("block"))
    blocks = parts.select("chrom", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k")).select("chrom", "w", F.struct("chrom", "w", "k").alias("block"))
    later = blocks.select("chrom", F.explode(F.array(F.col("w"), F.col("w") - 1)).alias("w"), F.col("block").alias("other"))
    pairs = blocks.join(later, ["chrom", "w"]).where("block <= other").select("block", "other")
    sides = pairs.select("block", F.xxhash64("block", "other").alias("pair"), F.lit(0).alias("side")).unionByName(pairs.where("block < other").select(F.col("other").alias("block"), F.xxhash64("block", "other").alias("pair"), F.lit(1).alias("side")))
    calls = geno.where("g is not null and s is not null").select("s", "v", F.col("g").cast("double").alias("g"), F.pmod(F.xxhash64("s"), F.lit(-(-samples // chunk) or 1)).alias("c"))
    long = calls.join(at, "v").join(sides, "block").select("pair", "c", "side", "s", "v", "bp", "g")
    kind = variants.schema["v"].dataType.simpleString()
    sums = long.groupBy("pair", "c").applyInPandas(lambda calls: _block_sums(calls, window_bp), f"a {kind}, b {kind}, n long, x long, y long, xx long, yy long, xy long")
    sums = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    r2 = squared_correlation(*[F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    return accumulated(variants.select("v"), sums.select("a", "b", r2.alias("r2")), "v", "a", "b").select("v", "ld_score")


def _block_sums(calls: pd.DataFrame, window_bp: int) -> pd.DataFrame:
    """Sums over the samples called in both, for each close pair of variants of two blocks, or of one block with itself if there is no side 1."""
    s = pd.factorize(calls["s"])[0]
    size = s.max() + 1

    def filled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = calls[rows]
        at, names = pd.factorize(own["v"])
        bp = np.zeros(len(names), np.int64)
        bp[at] = own["bp"]
        g, called = np.zeros((len(names), size)), np.zeros((len(names), size))
        g[at, s[rows]], called[at, s[rows]] = own["g"], 1.0
        return np.asarray(names), bp, g, called

    side = calls["side"].to_numpy()
    ia, pa, ga, ma = left = filled(side == 0)
    other = side == 1
    ib, pb, gb, mb = filled(other) if other.any() else left
    close = np.abs(pa[:, None] - pb) <= window_bp
    if not other.any():
        close &= ia[:, None] < ib
    i, j = np.nonzero(close)
    sums = {"n": ma @ mb.T, "x": ga @ mb.T, "y": ma @ gb.T, "xx": (ga * ga) @ mb.T, "yy": ma @ (gb * gb).T, "xy": ga @ gb.T}
    return pd.DataFrame({"a": ia[i], "b": ib[j], **{c: np.rint(v[i, j]).astype(np.int64) for c, v in sums.items()}})


def squared_correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """r² from integer sums; 0 if either side is constant."""
    c, u, w = n * xy - x * y, n * xx - x * x, n * yy - y * y
    return F.when((u > 0) & (w > 0), (c.cast("double") / u) * (c.cast("double") / w)).otherwise(F.lit(0.0))


def accumulated(every: DataFrame, pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """every with ld_score = 1 + the r2 of the pairs that it is part of; pairs of one variant with itself don't count."""
    good = pairs.where(F.col(a) != F.col(b))
    ends = good.select(F.col(a).alias(key), "r2").unionAll(good.select(F.col(b).alias(key), "r2"))
    return every.join(ends.groupBy(key).agg(F.sum("r2").alias("__r")), key, "left").select(*every.columns, (F.lit(1.0) + F.coalesce("__r", F.lit(0.0))).alias("ld_score"))


def scores_of_vcor(variants: DataFrame, vcor: DataFrame) -> DataFrame:
    """(variant_idx, variant_id, ld_score) of pairs (id_a, id_b, r2); unknown ids and r2 outside 0 to 1 + 1e-8 are errors."""
    require(vcor.where("r2 is null or isnan(r2) or r2 < 0 or r2 > 1 + 1e-8"), "r2 outside 0 to 1")
    ids = vcor.select(F.col("id_a").alias("variant_id")).union(vcor.select("id_b"))
    require(ids.join(variants, "variant_id", "left_anti").distinct(), "ids absent from the genotypes")
    return accumulated(variants.select("variant_idx", "variant_id"), vcor, "variant_id", "id_a", "id_b")


def ranked(scores: DataFrame, key: str = "v", score: str = "ld_score") -> DataFrame:
    """scores with rank from 0 by score, ties by key. Ranks come from a sort by ranges: each range counts its rows and is shifted by the ranges before it."""
    cuts = 64
    lows = scores.agg(F.percentile_approx(score, [i / cuts for i in range(1, cuts)], 10000)).first()[0] or []
    part = sum((F.when(F.col(score) > float(c), 1).otherwise(0) for c in sorted(set(lows))), F.lit(0)).alias("__p")
    tagged = scores.select("*", part)
    sizes = tagged.groupBy("__p").agg(F.count("*").alias("__n"))
    shift = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(score, key)) - 1
    return tagged.withColumn("__k", inside).join(F.broadcast(shift), "__p").withColumn("rank", (F.col("__k") + F.col("__s")).cast("long")).drop("__p", "__k", "__s")


def boundaries(m: int, bins: int) -> list[int]:
    """Balanced cuts floor(i m / B), B = min(bins, m), between the bins of m ranks."""
    b = min(bins, m)
    return [i * m // b for i in range(1, b)]


def bins_of(ranked_scores: DataFrame, m: int, bins: int) -> DataFrame:
    """ranked_scores with bin, the number of cuts at or below its rank."""
    b = min(bins, m)
    guess = F.floor((F.col("rank") + 1) * b / m).cast("int")
    # floor(i m / b) <= rank holds for i up to floor(((rank + 1) b - 1) / m)
    return ranked_scores.withColumn("bin", F.least(F.floor(((F.col("rank") + 1) * b - 1) / m).cast("int"), guess, F.lit(b - 1)))


def intervals(ranks: DataFrame, stretch: int = 100_000) -> DataFrame:
    """(comp, first, last, n, islands) of ranks (rank, comp): a component is a rank interval if it has one island.

    Islands are counted inside stretches of ranks and joined where a stretch goes on in the next, so a task sorts `stretch` ranks at most.
    """
    inside = Window.partitionBy("comp", "__at").orderBy("rank")
    new = F.when(F.lag("rank").over(inside).eqNullSafe(F.col("rank") - 1), 0).otherwise(1)
    tagged = ranks.withColumn("__at", F.floor(F.col("rank") / stretch))
    pieces = tagged.withColumn("__new", new).groupBy("comp", "__at").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n"), F.sum("__new").alias("islands"))
    along = Window.partitionBy("comp").orderBy("__at")  # a row per stretch
    goes_on = F.when(F.lag("last").over(along).eqNullSafe(F.col("first") - 1), 1).otherwise(0)
    return pieces.withColumn("__on", goes_on).groupBy("comp").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum(F.col("islands") - F.col("__on")).alias("islands"))


def interior_cuts(ranks: DataFrame) -> list[int]:
    """The cuts between components that are contiguous, ordered and exhaustive rank intervals; anything else is an error."""
    rows = intervals(ranks).orderBy("first").collect()  # one row per component
    if any(r.islands != 1 for r in rows) or [r.comp for r in rows] != sorted(r.comp for r in rows):
        raise ValueError("components are not ordered rank intervals")
    if rows and (rows[0]["first"] != 0 or any(a["last"] + 1 != b["first"] for a, b in zip(rows[:-1], rows[1:], strict=True))):
        raise ValueError("components leave ranks out")
    return [r["first"] for r in rows[1:]]


def split_component(parts: DataFrame, theta: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """(ranks, theta) after a cut inside one component: its children share its variance by their numbers of variants."""
    spans = {r.comp: r for r in intervals(parts).collect()}  # one row per component
    inside = [c for c, r in spans.items() if r["first"] < cut <= r["last"]]
    if len(inside) != 1:
        raise ValueError(f"cut {cut} lies in {len(inside)} components")
    (c,) = inside
    low = (cut - spans[c]["first"]) / spans[c]["n"]
    moved = parts.withColumn("comp", F.when((F.col("comp") > c) | ((F.col("comp") == c) & (F.col("rank") >= cut)), F.col("comp") + 1).otherwise(F.col("comp")))
    kids = theta.where(F.col("comp") == c)
    rest = theta.where(F.col("comp") != c).select(F.when(F.col("comp") > c, F.col("comp") + 1).otherwise(F.col("comp")).alias("comp"), "theta")
    return moved, rest.unionByName(kids.select("comp", (F.col("theta") * low).alias("theta"))).unionByName(kids.select((F.col("comp") + 1).alias("comp"), (F.col("theta") * (1 - low)).alias("theta")))


def cut_contrasts(quadratic: DataFrame, value: str = "q") -> DataFrame:
    """(cut, low, high, contrast) for each interior cut of bins (bin, n, q): prefix sums give low / t - high / (M - t) for all cuts in one pass.

    quadratic has a row per bin, a few hundred at most, so one window over it is small.
    """
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    t, low = F.sum("n").over(before), F.sum(value).over(before)
    m, total = F.sum("n").over(everything), F.sum(value).over(everything)
    got = quadratic.select("bin", t.alias("cut"), m.alias("m"), low.alias("low"), (total - low).alias("high"))
    return got.where("cut < m").select("cut", "low", "high", (F.col("low") / F.col("cut") - F.col("high") / (F.col("m") - F.col("cut"))).alias("contrast"))


def rank_artifact(ranked_scores: DataFrame, bins: int, path: str) -> None:
    """Writes the rank permutation as Parquet and the cuts as JSON text beside it."""
    m = ranked_scores.count()
    ranked_scores.write.mode("overwrite").parquet(f"{path}/order")
    ranked_scores.sparkSession.createDataFrame([(json.dumps({"boundary_positions": boundaries(m, bins), "requested_bins": bins, "effective_bins": min(bins, m), "marker_count": m}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cuts")
