"""PLINK 1 BED files: a Spark data source of packed variants, and the 2-bit codec as expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: the first bytes of a variant-major file, and the dosage that each 2-bit code stands for.
MAGIC = b"\x6c\x1b\x01"
DOSAGE = (2, None, 1, 0)
#: Variants that one task reads.
SPAN = 2048


class _Span(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, samples: int):
        import os

        self.path, self.width = path, -(-samples // 4)
        size = os.path.getsize(path) - len(MAGIC)
        with open(path, "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{path} is no variant-major BED file")
        if size % self.width:
            raise ValueError(f"{path} doesn't hold whole variants of {samples} samples")
        self.variants = size // self.width

    def partitions(self) -> list[InputPartition]:
        return [_Span(a, min(SPAN, self.variants - a)) for a in range(0, self.variants, SPAN)] or [_Span(0, 0)]

    def read(self, span: _Span) -> Iterator:
        import pyarrow as pa

        with open(self.path, "rb") as f:
            f.seek(len(MAGIC) + span.start * self.width)
            raw = f.read(span.count * self.width)
        packed = [raw[i * self.width : (i + 1) * self.width] for i in range(span.count)]
        yield pa.RecordBatch.from_arrays([pa.array(range(span.start, span.start + span.count), pa.int32()), pa.array(packed, pa.binary())], names=["variant_idx", "packed"])


class BedSource(DataSource):
    """spark.read.format('bed').option('samples', n).load(path): (variant_idx, packed), a range of variants per task. The path must be one that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "variant_idx int, packed binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["samples"]))


def read_bed(spark: SparkSession, path: str, samples: int) -> DataFrame:
    spark.dataSource.register(BedSource)
    return spark.read.format("bed").option("samples", samples).load(path)


def code(packed: Column, sample: Column) -> Column:
    """The 2-bit code of a sample, four to a byte, the lowest bits first."""
    byte = F.conv(F.hex(F.substring(packed, (F.floor(sample / 4) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return _shifted(byte, sample % 4).bitwiseAND(F.lit(3))


def _shifted(byte: Column, quarter: Column) -> Column:
    return F.when(quarter == 0, byte).when(quarter == 1, F.shiftright(byte, 2)).when(quarter == 2, F.shiftright(byte, 4)).otherwise(F.shiftright(byte, 6))


def dosage(value: Column) -> Column:
    """0, 1, 2 or null of a code."""
    return F.when(value == 0, 2).when(value == 2, 1).when(value == 3, 0)


def _decoded(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    table = np.array([-1 if d is None else d for d in DOSAGE], np.int8)
    for batch in batches:
        codes = [np.frombuffer(p, np.uint8) for p in batch.column("packed").to_pylist()]
        found = [table[np.stack([(c >> k) & 3 for k in (0, 2, 4, 6)], 1).ravel()] for c in codes]
        yield pa.RecordBatch.from_arrays([batch.column("variant_idx"), pa.array(found, pa.list_(pa.int8()))], names=["v", "d"])


def unpacked(blocks: DataFrame, samples: int) -> DataFrame:
    """The long table (s, v, g) of (variant_idx, packed)."""
    rows = blocks.select("variant_idx", "packed").mapInArrow(_decoded, "v int, d array<tinyint>").select("v", F.posexplode("d").alias("s", "d"))
    return rows.where(F.col("s") < samples).select("s", "v", F.when(F.col("d") >= 0, F.col("d")).cast("int").alias("g"))
