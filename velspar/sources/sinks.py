"""Output tables as tab-separated text in a fixed order, with their metadata as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the columns of an association table.
GWAS = ("component_index", "component_name", "variant_index_global", "variant_index_local", "chrom", "variant_id", "cm", "bp", "a1", "a2", "af", "n_obs", "beta", "se", "beta_std", "se_std", "t", "p")


def gwas_table(found: DataFrame, variants: DataFrame, components: DataFrame) -> DataFrame:
    """The association table of found (v, af, ...), variants (variant_idx, chrom, ...) and components (component_index, component_name, v, variant_index_local)."""
    got = found.join(components, "v").join(variants, F.col("v") == F.col("variant_idx")).withColumn("variant_index_global", F.col("v"))
    return got.select(*GWAS)


def written_tsv(df: DataFrame, path: str, order: list[str], digits: int = 8, about: dict | None = None) -> None:
    """df sorted by order, doubles to so many significant digits, NaN as nan; metadata beside it. Sorted by ranges: files in name order hold the rows in order."""
    shown = [F.when(F.isnan(c), "nan").otherwise(F.format_string(f"%.{digits}g", F.col(c))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.orderBy(*order).select(*shown).write.mode("overwrite").csv(f"{path}.tsv", sep="\t", header=True, emptyValue="")
    if about is not None:
        df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")
