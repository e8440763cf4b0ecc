"""Genotypes as packed tiles, a block of variants by a chunk of samples each, four calls to a byte; products multiply tiles as matrices.

A call takes two bits instead of a row. A product joins each tile with the matching part of a group of right-hand sides, one row each, multiplies them in
the task and adds up there what it can before the shuffle. Tiles stay where they are while the right-hand sides fit a checked broadcast; beyond it
Spark shuffles both by chunk or block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.operators.order import numbered
from velspar.sources.bed import DOSAGE, read_bed
from velspar.sources.shared import written

#: Variants and samples of a tile; right-hand sides that meet a tile at a time.
BLOCK, CHUNK, SIDES = 512, 4096, 16
#: Bytes of right-hand sides that are broadcast at most, and partial sums (doubles) that a task holds at most.
BROADCAST, HELD = 64 << 20, 1 << 23
#: The code of a missing call; 0, 1 and 2 stand for themselves.
MISSING = 3

_CODES = np.array([[b >> k & 3 for k in (0, 2, 4, 6)] for b in range(256)], np.uint8)
#: Bytes of a BED file's codes as bytes of ours.
_FROM_BED = np.array([sum((MISSING if DOSAGE[b >> k & 3] is None else DOSAGE[b >> k & 3]) << k for k in (0, 2, 4, 6)) for b in range(256)], np.uint8)
TABLE = "vb int, sb int, top int, width int, data binary"


def packed(codes: np.ndarray) -> np.ndarray:
    """Rows of 2-bit codes as bytes, the first of four in the lowest bits; rows are filled up with missing calls."""
    full = np.full((len(codes), -(-codes.shape[1] // 4) * 4), MISSING, np.uint8)
    full[:, : codes.shape[1]] = codes
    four = full.reshape(len(codes), -1, 4)
    return four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6


def codes_of(data: bytes, width: int) -> np.ndarray:
    return _CODES[np.frombuffer(data, np.uint8)].reshape(-1, width * 4)


@dataclass(frozen=True)
class Tiles:
    """table (vb, sb, top, width, data): calls of variants top, top + 1, ... of block vb in chunk sb, `width` bytes each; the places of variants (v, vb, vi)
    and samples (s, sb, si), and their numbers."""

    table: DataFrame
    variants: DataFrame
    samples: DataFrame
    m: int
    n: int

    def calls(self) -> DataFrame:
        """The long table (s, v, g) of all calls that aren't missing."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for vb, sb, top, width, data in zip(*(b[c].to_pylist() for c in ("vb", "sb", "top", "width", "data")), strict=True):
                    codes = codes_of(data, width)
                    i, j = np.nonzero(codes != MISSING)
                    one = lambda x: pa.array(np.full(len(i), x, np.int32))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([one(vb), one(sb), pa.array((i + top).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(codes[i, j].astype(np.int32))], names=["vb", "sb", "vi", "si", "g"])

        long = self.table.mapInArrow(run, "vb int, sb int, vi int, si int, g int")
        return long.join(self.variants, ["vb", "vi"]).join(self.samples, ["sb", "si"]).select("s", "v", "g")

    def _sides(self, x: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
        """(*keep, rg, k) for each right-hand side of x, and their number: k is its column in group rg of SIDES."""
        names = sorted(tuple(r) for r in x.select(*keep).distinct().collect()) if keep else [()]  # a row per right-hand side
        schema = ", ".join([*(f"{c} {x.schema[c].dataType.simpleString()}" for c in keep), "rg int", "k int"])
        rows = [(*name, i // SIDES, i % SIDES) for i, name in enumerate(names)]
        return F.broadcast(x.sparkSession.createDataFrame(rows, schema)), len(names)

    def _multiplied(self, chunks: DataFrame, on: str, size: int, out: str, product) -> DataFrame:
        """Partial sums (out, i, rg, k, *values) of product(codes, row's top, sides) over tiles and chunks (on, rg, sides), as many arrays as values."""
        if size <= BROADCAST:
            chunks = F.broadcast(chunks)
        joined = self.table.join(chunks, on).select("vb", "sb", "top", "width", "data", "rg", "sides")
        return joined.mapInArrow(lambda batches: _partial(batches, out, product), f"{out} int, i int, rg int, k int, p double, q double").groupBy(out, "i", "rg", "k").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))

    def zt(self, stats: DataFrame, x: DataFrame) -> DataFrame:
        """(v, r, b) = Z'x for x (s, r, x); variants without a call are absent."""
        names, count = self._sides(x, ("r",))
        at = x.join(names, "r").join(self.samples, "s")
        chunks = at.groupBy("sb", "rg").agg(F.collect_list(F.struct((F.col("si") * SIDES + F.col("k")).cast("int").alias("at"), F.col("x").cast("double").alias("a"), F.lit(0.0).alias("c"))).alias("sides"))
        sums = self._multiplied(chunks, "sb", self.n * count * 20, "vb", _zt)
        sums = sums.join(names, ["rg", "k"]).join(self.variants.withColumnRenamed("vi", "i"), ["vb", "i"]).join(stats.select("v", "mean", "inv"), "v")
        return sums.select("v", "r", (F.col("inv") * (F.col("p") - F.col("mean") * F.col("q"))).alias("b"))

    def z(self, stats: DataFrame, b: DataFrame, keep: tuple[str, ...] = ("r",)) -> DataFrame:
        """(s, *keep, x) = Z b for b (v, *keep, b)."""
        names, count = self._sides(b, keep)
        at = b.join(names, list(keep)) if keep else b.crossJoin(names)  # one row
        at = at.join(self.variants, "v").join(stats.select("v", "mean", "inv"), "v")
        w = F.col("inv") * F.col("b")
        chunks = at.groupBy("vb", "rg").agg(F.collect_list(F.struct((F.col("vi") * SIDES + F.col("k")).cast("int").alias("at"), w.alias("a"), (F.col("mean") * w).alias("c"))).alias("sides"))
        sums = self._multiplied(chunks, "vb", self.m * count * 20, "sb", _z)
        back = sums.join(self.samples.withColumnRenamed("si", "i"), ["sb", "i"]).join(names, ["rg", "k"])
        return back.select("s", *keep, (F.col("p") - F.col("q")).alias("x"))


def _zt(codes: np.ndarray, top: int, a: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Sums of g x and of x over the calls of each variant."""
    a = a[: codes.shape[1]]
    missing = codes == MISSING
    g = np.where(missing, 0, codes).astype(float)
    return top, g @ a, a.sum(0) - missing.astype(float) @ a


def _z(codes: np.ndarray, top: int, a: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Sums of g w and of mean w over the calls of each sample."""
    a, c = a[top : top + len(codes)], c[top : top + len(codes)]
    missing = codes == MISSING
    g = np.where(missing, 0, codes).astype(float)
    return 0, g.T @ a, c.sum(0) - missing.astype(float).T @ c


def _partial(batches: Iterator[pa.RecordBatch], out: str, product) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (own, rg), sums in held.items():
            live = np.flatnonzero(sums[2].any(0))  # sides that this group has
            i, k = np.meshgrid(np.arange(sums.shape[1]), live, indexing="ij")
            one = lambda x: pa.array(np.full(i.size, x, np.int32))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([one(own), pa.array(i.ravel().astype(np.int32)), one(rg), pa.array(k.ravel().astype(np.int32)), pa.array(sums[0][:, live].ravel()), pa.array(sums[1][:, live].ravel())], names=[out, "i", "rg", "k", "p", "q"])
        held.clear()

    def made(sides: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sides.values
        at = rows.field("at").to_numpy()
        size = int(at.max(initial=0)) // SIDES + 1
        a, c, live = np.zeros((size, SIDES)), np.zeros((size, SIDES)), np.zeros(SIDES, bool)
        a.ravel()[at], c.ravel()[at] = rows.field("a").to_numpy(), rows.field("c").to_numpy()
        live[at % SIDES] = True
        return a, c, live

    last, sides = None, None
    for b in batches:
        columns = [b[c].to_pylist() for c in ("vb", "sb", "top", "width", "data", "rg")]
        for row, (vb, sb, top, width, data, rg) in enumerate(zip(*columns, strict=True)):
            name = (sb if out == "vb" else vb, rg)
            if name != last:
                last, sides = name, made(b["sides"][row])
            a, c, live = sides
            codes = codes_of(data, width)
            far = codes.shape[1] if out == "vb" else top + len(codes)
            if len(a) < far:
                a, c = (np.concatenate((x, np.zeros((far - len(x), SIDES)))) for x in (a, c))
            first, p, q = product(codes, top, a, c)
            key = (vb if out == "vb" else sb, rg)
            if key not in held:
                held[key] = np.zeros((3, first + len(p), SIDES))
            elif held[key].shape[1] < first + len(p):
                held[key] = np.concatenate((held[key], np.zeros((3, first + len(p) - held[key].shape[1], SIDES))), 1)
            held[key][0, first : first + len(p)] += p
            held[key][1, first : first + len(p)] += q
            held[key][2, 0] += live
            if sum(x.size for x in held.values()) > HELD:
                yield from sent()
    yield from sent()


def pack(geno: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> Tiles:
    """Tiles of a long table (s, v, g), one row at most for a sample and a variant; a call that is null or absent is missing. Calls are shuffled once."""
    known = geno.where("g is not null and s is not null and v is not null").select("s", "v", "g")
    known = written(known, "tiles-calls")
    place = lambda name, size, a, b: written(numbered(known.select(name).distinct(), name).select(name, F.floor(F.col("number") / size).cast("int").alias(a), (F.col("number") % size).cast("int").alias(b)), "tiles-places")
    variants, samples = place("v", block, "vb", "vi"), place("s", chunk, "sb", "si")

    def one(rows: pa.Table) -> pa.Table:
        v, s, g = (rows[c].to_numpy() for c in ("vi", "si", "g"))
        codes = np.full((v.max() + 1, s.max() + 1), MISSING, np.uint8)
        codes[v, s] = g
        data = packed(codes)
        return pa.table({"vb": rows["vb"][:1].cast(pa.int32()), "sb": rows["sb"][:1].cast(pa.int32()), "top": pa.array([0], pa.int32()), "width": pa.array([data.shape[1]], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    cells = known.join(variants, "v").join(samples, "s").select("vb", "sb", "vi", "si", "g")
    table = cells.groupBy("vb", "sb").applyInArrow(one, TABLE)
    return Tiles(written(table.repartitionByRange("vb", "sb").sortWithinPartitions("vb", "sb"), "tiles"), variants, samples, variants.count(), samples.count())


def from_bed(spark: SparkSession, path: str, samples: int, keep: list[int] | None = None, block: int = BLOCK, chunk: int = CHUNK) -> Tiles:
    """Tiles of a BED file: bytes are translated, no call becomes a row. v is a variant's place in the file, s a sample's; with keep, places of
    samples in ascending order, only these are packed."""
    if keep is not None and (sorted(set(keep)) != list(keep) or (keep and not 0 <= keep[0] <= keep[-1] < samples)):
        raise ValueError("keep must be ascending places of samples")
    if chunk % 4:
        raise ValueError("a chunk must be a multiple of four samples")
    chosen = None if keep is None else np.array(keep, np.int64)
    n = samples if keep is None else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b["variant_idx"].to_numpy()
            rows = [_FROM_BED[np.frombuffer(p, np.uint8)] for p in b["packed"].to_pylist()]
            start = 0
            while start < len(at):
                end = start + 1  # neighbours of one block
                while end < len(at) and at[end] == at[end - 1] + 1 and at[end] // block == at[start] // block:
                    end += 1
                data = np.stack(rows[start:end])
                if chosen is not None:
                    data = packed(_CODES[data].reshape(len(data), -1)[:, chosen])
                for sb in range(-(-n // chunk)):
                    own = np.ascontiguousarray(data[:, sb * chunk // 4 : (sb + 1) * chunk // 4])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.int32()) for x in (at[start] // block, sb, at[start] % block, own.shape[1])] + [pa.array([own.tobytes()], pa.binary())],
                        names=["vb", "sb", "top", "width", "data"],
                    )
                start = end

    blocks = read_bed(spark, path, samples)
    table = written(blocks.mapInArrow(run, TABLE), "tiles")
    m = blocks.count()
    variants = spark.range(m).select(F.col("id").alias("v"), F.floor(F.col("id") / block).cast("int").alias("vb"), (F.col("id") % block).cast("int").alias("vi"))
    ids = spark.range(n).select(F.col("id").alias("i"))
    if keep is not None:
        ids = ids.join(F.broadcast(spark.createDataFrame(list(enumerate(keep)), "i long, s long")), "i")  # as many as the caller's list
    else:
        ids = ids.withColumn("s", F.col("i"))
    return Tiles(table, variants, ids.select("s", F.floor(F.col("i") / chunk).cast("int").alias("sb"), (F.col("i") % chunk).cast("int").alias("si")), m, n)
