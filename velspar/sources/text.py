"""Scans of the text files of genetics: samples, phenotypes, covariates, keep lists, variants, LD tables, W blocks, component specs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as missing in phenotype and covariate files.
MISSING = ("-9", "NA", "NaN", "nan", "")


def fields(spark: SparkSession, path: str) -> DataFrame:
    """(f array<string>, row long): the white-space separated fields of each line that has any; row orders the lines of a file."""
    lines = spark.read.text(path, wholetext=False).withColumn("row", F.monotonically_increasing_id())
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"), "row").where("size(f) > 0 and f[0] <> ''")


def _ordered(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """row numbers become 0, 1, 2, ... : each scan task counts its rows, and the counts (one number a task) shift them."""
    tagged = df.withColumn("__p", F.shiftright("row", 33)).withColumn("__k", F.col("row").bitwiseAND((1 << 33) - 1))
    counts = {r["__p"]: r["n"] for r in tagged.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    spark = df.sparkSession
    shift = spark.createDataFrame(starts or [(0, 0)], "__p long, __s long")
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("__p").orderBy("__k")) - 1
    return tagged.withColumn("__k", within).join(F.broadcast(shift), "__p").withColumn(name, (F.col("__s") + F.col("__k")).cast("int")).drop("__p", "__k", "__s", "row")


def duplicates(df: DataFrame, key: str, examples: int = 10) -> DataFrame:
    """(key, n) of values that occur more than once, the first by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(examples)


def require(df: DataFrame, said: str, examples: int = 10) -> None:
    """Raises with some rows of df unless it is empty."""
    found = df.limit(examples).collect()
    if found:
        raise ValueError(f"{said}: {[tuple(r) for r in found]}")


def read_fam(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(sample_idx, iid): the second field of each line with two fields or more, in file order."""
    df = _ordered(fields(spark, path).where("size(f) >= 2 and f[1] <> ''").select(F.col("f")[1].alias("iid"), "row"), "sample_idx")
    if strict:
        require(duplicates(df, "iid"), "duplicate sample ids")
    return df.select("sample_idx", "iid")


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, iid): the IID column of a header that starts with #, else the second field, or the first of one."""
    rows = fields(spark, path)
    head = rows.where("startswith(f[0], '#') and not startswith(f[0], '##')").orderBy("row").limit(1).collect()
    names = [x.lstrip("#") for x in head[0].f] if head else []
    at = names.index("IID") if "IID" in names else None
    iid = F.col("f")[at] if at is not None else F.when(F.size("f") > 1, F.get("f", F.lit(1))).otherwise(F.col("f")[0])
    return _ordered(rows.where("not startswith(f[0], '#')").select(iid.alias("iid"), "row"), "sample_idx").select("sample_idx", "iid")


def _number(x: Column) -> Column:
    value = F.when(~x.isin(*MISSING), x.try_cast("double"))
    return F.when(value != -9.0, value)


def read_pheno(spark: SparkSession, path: str) -> DataFrame:
    """(iid, pheno) of FID IID PHENO: missing tokens, failed casts and -9 are dropped; infinities stay for later checks."""
    df = fields(spark, path).where("size(f) >= 3").select(F.col("f")[1].alias("iid"), _number(F.col("f")[2]).alias("pheno")).where("pheno is not null")
    require(duplicates(df, "iid"), "duplicate phenotype ids")
    return df


def modal_width(rows: DataFrame, values: str) -> DataFrame:
    """One row: the most frequent size of the array column values, the smaller of equally frequent ones."""
    return rows.groupBy(F.size(values).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1)


def read_covar(spark: SparkSession, path: str) -> DataFrame:
    """(iid, cov array<double>) of FID IID C1 C2 ...: a row with any missing field is dropped, any width but the most frequent is an error."""
    df = fields(spark, path).where("size(f) >= 3").select(F.col("f")[1].alias("iid"), F.transform(F.slice("f", 3, 1 << 20), _number).alias("cov"))
    df = df.where(~F.exists("cov", lambda x: x.isNull()))
    width = modal_width(df, "cov").collect()
    if width:
        require(df.where(F.size("cov") != width[0].width).select("iid", F.size("cov")), f"covariate rows without {width[0].width} values")
    require(duplicates(df, "iid"), "duplicate covariate ids")
    return df


def read_keep(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(iid): the second field if there are two, else the first."""
    df = fields(spark, path).select(F.when(F.size("f") > 1, F.get("f", F.lit(1))).otherwise(F.col("f")[0]).alias("iid"))
    if strict:
        require(duplicates(df, "iid"), "duplicate keep ids")
        if df.isEmpty():
            raise ValueError("the keep list is empty")
    return df


VARIANT = ("chrom", "variant_id", "cm", "bp", "a1", "a2")


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """(variant_idx, chrom, variant_id, cm, bp, a1, a2), all strings but the index."""
    rows = fields(spark, path)
    require(rows.where("size(f) < 6").select("row"), "variant lines under six fields")
    return _ordered(rows.select(*[F.col("f")[i].alias(c) for i, c in enumerate(VARIANT)], "row"), "variant_idx").select("variant_idx", *VARIANT)


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a plain .pvar file with a #CHROM header: a1 is the first ALT, a2 is REF, cm is '.'."""
    rows = fields(spark, path)
    head = rows.where("f[0] = '#CHROM'").orderBy("row").limit(1).collect()
    if not head:
        raise ValueError("no #CHROM header")
    at = {c: i for i, c in enumerate(head[0].f)}
    f = F.col("f")
    cols = [f[at["#CHROM"]].alias("chrom"), f[at["ID"]].alias("variant_id"), F.lit(".").alias("cm"), f[at["POS"]].alias("bp"), F.split(f[at["ALT"]], ",")[0].alias("a1"), f[at["REF"]].alias("a2")]
    return _ordered(rows.where("not startswith(f[0], '#')").select(*cols, "row"), "variant_idx").select("variant_idx", *VARIANT)


def read_variants(spark: SparkSession, source: str) -> DataFrame:
    """The variants of a genotype source, a path with or without its ending: of the .bim file beside it, else of the .pvar file; an error if there is neither."""
    prefix = re.sub(r"\.(bed|pgen|bim|pvar)$", "", source)
    for end, read in ((".bim", read_bim), (".pvar", read_pvar)):
        try:
            spark.read.text(prefix + end)
        except AnalysisException:
            continue
        return read(spark, prefix + end)
    raise ValueError(f"no .bim or .pvar file beside {source}")


def read_ld_scores(spark: SparkSession, path: str, variants: DataFrame) -> DataFrame:
    """(variant_idx, ld_score) of a tab-separated file with ID and ld_score, in the variants' order; ids must agree and scores be finite and not negative."""
    got = spark.read.csv(path, sep="\t", header=True).select(F.col("ID").alias("variant_id"), F.col("ld_score").try_cast("double").alias("ld_score"))
    require(duplicates(got, "variant_id"), "duplicate ids in the LD table")
    require(got.join(variants, "variant_id", "left_anti").select("variant_id"), "ids absent from the genotypes")
    require(variants.join(got, "variant_id", "left_anti").select("variant_id"), "variants without an LD score")
    require(got.where("ld_score is null or isnan(ld_score) or ld_score < 0 or ld_score = double('inf')"), "LD scores that aren't finite and positive")
    return variants.join(got, "variant_id").select("variant_idx", "ld_score")


def read_vcor(spark: SparkSession, path: str) -> DataFrame:
    """(id_a, id_b, r2) of a pairwise LD table, whose header has two columns with ID and one with R2 in their names."""
    got = spark.read.csv(path, sep="\t", header=True)
    ids, r2 = [c for c in got.columns if "ID" in c.upper()], [c for c in got.columns if "R2" in c.upper()]
    if len(ids) < 2 or not r2:
        raise ValueError(f"no two ID columns and an R2 column in {got.columns}")
    return got.select(F.col(f"`{ids[0]}`").alias("id_a"), F.col(f"`{ids[1]}`").alias("id_b"), F.col(f"`{r2[0]}`").try_cast("double").alias("r2"))


COMPONENTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("variant_indices", T.ArrayType(T.LongType())), T.StructField("annotation", T.StringType()), T.StructField("provenance", T.StringType())])


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(component_idx, name, variant_indices, annotation, provenance) of a JSON component spec, an object with components or a bare list."""
    one = spark.read.text(path, wholetext=True)
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", "$.components"))
    got = one.select(F.posexplode(F.from_json(listed, T.ArrayType(COMPONENTS))).alias("component_idx", "c")).select("component_idx", "c.*")
    return got.withColumn("name", F.coalesce("name", F.format_string("component_%03d", F.col("component_idx"))))


def read_admixture(spark: SparkSession, path: str, fam: DataFrame) -> DataFrame:
    """(sample_idx, iid, q array<double>): rows in FAM order; values below -1e-6 are an error, else clipped at 0; rows must sum to 1 within 5e-3."""
    rows = _ordered(fields(spark, path).select(F.transform("f", lambda x: x.cast("double")).alias("q"), "row"), "sample_idx")
    got = fam.join(rows, "sample_idx", "left")
    require(got.where("q is null").select("iid"), "samples without a Q row")
    require(got.where(F.exists("q", lambda x: x < -1e-6)).select("iid"), "negative ancestry")
    got = got.withColumn("q", F.transform("q", lambda x: F.greatest(x, F.lit(0.0))))
    require(got.where(F.abs(F.aggregate("q", F.lit(0.0), lambda a, x: a + x) - 1) > 5e-3).select("iid"), "ancestries that don't sum to 1")
    return got.select("sample_idx", "iid", "q")


def read_weights(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(i, j, w): a square numeric matrix from a delimited file."""
    lines = _ordered(spark.read.text(path).where("trim(value) <> ''").select(F.split("value", sep).alias("f"), F.monotonically_increasing_id().alias("row")), "i")
    got = lines.select("i", F.posexplode("f").alias("j", "w")).withColumn("w", F.trim("w").try_cast("double"))
    n = got.agg(F.max("i") + 1, F.max("j") + 1, F.count("*"), F.sum(F.when(F.col("w").isNull() | F.isnan("w"), 1).otherwise(0))).first()
    if not n[2] or n[0] != n[1] or n[2] != n[0] * n[1] or n[3]:
        raise ValueError("the matrix is not square, numeric, finite and filled")
    return got.withColumn("i", F.col("i").cast("int"))
