"""Helpers that several operators share: the shared folder, written tables, hashing of words, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a fresh local one if driver and executors are one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-velspar-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Tasks for each core at least, and rows of a task at most, of a table whose number of rows is known beforehand.
FILES, ROWS = 3, 200_000


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors. Where `rows` bounds its rows, it gets no more
    tasks than these need."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(FILES * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that more than one in HOT of the rows hold are hot: there are no more than HOT of them. Fewer rows than FEW aren't hot.
HOT, FEW = 100_000, 1000


def met(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows, `total` at most, joined with what counted, a row per key with n, their number, says of their keys. The hot keys are broadcast and
    met where their rows lie; the others are shuffled."""
    hot = F.col("n") > max(FEW, total // HOT)
    few = F.broadcast(counted.where(hot).drop("n"))
    rest = rows.join(F.broadcast(counted.where(hot).select(*on)), on, "left_anti").join(counted.where(~hot).drop("n"), on)
    return rows.join(few, on).unionByName(rest)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every id of edges (a, b); component is the smallest id that links reach.

    Alternates large-star and small-star steps until every id points at its component's least one alone. Each step is a
    pre-aggregated minimum and a join, so no neighbourhood is gathered in one place. Null ends and self links count for nothing.
    """
    star = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    star = written(star.distinct(), label)
    rows = star.count()
    while not _flat(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = met(both, least, ["u"], 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label, rows)  # a step never adds links
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _flat(star: DataFrame) -> bool:
    """Whether no id has two targets or is both a source and a target."""
    ends = star.select(F.col("u").alias("i"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(star.select(F.col("v").alias("i"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    return ends.groupBy("i").agg(F.sum("s").alias("s"), F.max("t").alias("t")).where("s > 1 or (s = 1 and t = 1)").isEmpty()


# --- hashing of words, straight from Arrow's buffers -------------------------------------------------------------

#: Bytes hashed at a time; bounds the working arrays whatever the length of a text.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = np.uint64(1)
        _POWERS.clear()
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and each row's limits in them; a null row is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), limits


def words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each white-space separated word, ASCII letters folded to lower case, and per row the limits in these arrays."""
    data, limits = text_bytes(column)
    hashes, starts, ends = [], [], []
    at, last = int(limits[0]), int(limits[-1])
    edge = np.zeros(0, bool)
    while at < last:
        to = min(at + CHUNK, last)
        while to < last and not _SPACE[data[to]]:  # never inside a word, but at a row's edge if a word is very long
            gap = np.flatnonzero(_SPACE[data[to : to + CHUNK]])
            to = to + int(gap[0]) if gap.size else min(to + CHUNK, last)
        part = data[at:to]
        solid = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        inside = limits[np.searchsorted(limits, at) : np.searchsorted(limits, to, "right")] - at
        edge[inside] = True
        before = np.concatenate(([False], solid[:-1]))
        first = solid & (~before | edge[:-1])
        after = np.concatenate((solid[1:], [False]))
        final = solid & (~after | edge[1:])
        s, e = np.flatnonzero(first), np.flatnonzero(final) + 1
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_FOLD[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        hashes.append(mixed((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(limits), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, limits)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text has one, of all its words; an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : n - k + 1 + j]
    return mixed(out + np.uint64(k))
