"""Genotype tables derived from orders: a customer is a sample, a part number modulo VARIANTS a variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, v, g): the quantity that a customer ordered of a variant, modulo 3, null where the line numbers' sum divides by 11; no row is a missing call too."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("s"), (F.col("l_partkey") % VARIANTS).alias("v"))
    cells = cells.agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum("l_linenumber").alias("k"))
    return cells.select("s", "v", F.when(F.col("k") % 11 != 0, (F.col("q") % 3).cast("int")).alias("g"))


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, y): a customer's balance in thousands."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("s")).agg((F.avg("c_acctbal") / 1000).alias("y"))


def covar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, x1): a customer's mean order in ten thousands."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("s")).agg((F.avg("o_totalprice") / 10000).alias("x1"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, chrom, bp, comp)."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % VARIANTS).alias("v")).distinct()
    return v.select("v", (F.col("v") % 5).cast("int").alias("chrom"), (F.col("v") * 40000).alias("bp"), (F.col("v") % 3).cast("int").alias("comp"))


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, b)."""
    return variants(spark, sf_dir).select("v", ((F.pmod(F.col("v") * 37, F.lit(11)) - 5) / 10.0).alias("b"))


#: The same tables in DuckDB's SQL.
SQL = f"""
cells AS (SELECT o_custkey AS s, l_partkey % {VARIANTS} AS v, sum(CAST(l_quantity AS BIGINT)) AS q, sum(l_linenumber) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
geno AS (SELECT s, v, CASE WHEN k % 11 <> 0 THEN CAST(q % 3 AS INTEGER) END AS g FROM cells),
calls AS (SELECT s, v, g FROM geno WHERE g IS NOT NULL),
pheno AS (SELECT c_custkey AS s, avg(c_acctbal) / 1000 AS y FROM customer GROUP BY 1),
covar AS (SELECT o_custkey AS s, avg(o_totalprice) / 10000 AS x1 FROM orders GROUP BY 1),
variants AS (SELECT DISTINCT l_partkey % {VARIANTS} AS v, CAST(l_partkey % {VARIANTS} % 5 AS INTEGER) AS chrom, l_partkey % {VARIANTS} * 40000 AS bp,
  CAST(l_partkey % {VARIANTS} % 3 AS INTEGER) AS comp FROM lineitem),
effects AS (SELECT v, (v * 37 % 11 - 5) / 10.0::DOUBLE AS b FROM variants),
raw AS (SELECT v, count(g) AS cnt, CAST(coalesce(sum(g), 0) AS BIGINT) AS s1, CAST(coalesce(sum(g * g), 0) AS BIGINT) AS s2 FROM geno GROUP BY v),
stats AS (SELECT *, CASE WHEN cnt > 0 THEN s1 / cnt::DOUBLE ELSE 0 END AS mean,
  CASE WHEN cnt > 0 AND cnt * s2 - s1 * s1 > 0 THEN 1 / sqrt(greatest(s2 / cnt::DOUBLE - (s1 / cnt::DOUBLE) * (s1 / cnt::DOUBLE), 1e-6)) ELSE 0.0 END AS inv FROM raw),
zed AS (SELECT s, v, (g - mean) * inv AS z FROM calls JOIN stats USING (v)),
yy AS (SELECT s, (y - (SELECT avg(y) FROM pheno)) / ((SELECT stddev_pop(y) FROM pheno) + 1e-6) AS y FROM pheno),
meff AS (SELECT comp, greatest(count(*) FILTER (WHERE inv > 0), 1) AS m FROM variants JOIN stats USING (v) GROUP BY comp)"""


def sql(body: str, more: str = "") -> str:
    return f"WITH {SQL}{',' + more if more else ''}\n{body}"
