"""Dense numbers in a total order, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velspar.sources.shared import written

#: Rows of a range at about.
RANGE = 200_000


def numbered(rows: DataFrame, *keys: str, name: str = "number", size: int = RANGE) -> DataFrame:
    """rows, written, with their place from 0 in the order of keys: ranges are sorted one by one and shifted by the number of rows before them.

    Rows equal in all keys share a range and get places in any order.
    """
    base = written(rows, "order-rows")
    ranges = max(1, -(-base.count() // size))
    dealt = written(base.repartitionByRange(ranges, *keys).withColumn("__p", F.spark_partition_id()), "order-ranges")
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    shift = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return dealt.withColumn("__k", inside).join(F.broadcast(shift), "__p").withColumn(name, (F.col("__k") + F.col("__s")).cast("long")).drop("__p", "__k", "__s")
