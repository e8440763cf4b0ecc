"""Exact top-k inner products: shards of space, a KD-tree with tight boxes in each, best-first search, and a kth score that prunes shards before any row moves."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velspar.llm.common import written

#: Vectors that a shard holds about, and rows of its leaves.
SHARD, LEAF = 8192, 64
#: Rows on which the cuts between shards are fitted, at most, and rows for each shard that the fit wants: shards are SAMPLE / EACH at most. What of a shard is
#: more than SHARD rows, as when a third of all vectors are one, falls into parts by a hash of the id.
SAMPLE, EACH = 65_536, 16
#: Shards that a query visits in the first round, and how many times more in each next one.
FIRST, MORE = 1, 4
SCORES = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null for a vector that is null, empty or holds a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.when((F.size(vector) > 0) & ~F.exists(wide, bad), F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


class KDTree:
    """Median splits on the widest side down to LEAF rows; each node has its tight box. Rows of one vector stay as one row of the tree with its smallest ids."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        self.rows, group = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        counts = np.bincount(group.ravel(), minlength=len(self.rows))
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        # k + 1 ids of one vector are enough: the query's own row falls out
        self.ids = [ids[order[f : f + min(c, k + 1)]].tolist() for f, c in zip(first, counts, strict=True)]
        self.lo, self.hi, self.kids, self.members = [], [], [], []
        self._grow(np.arange(len(self.rows)))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _grow(self, members: np.ndarray) -> int:
        at, part = len(self.kids), self.rows[members]
        lo, hi = part.min(0), part.max(0)
        self.lo.append(lo), self.hi.append(hi), self.kids.append(None), self.members.append(members)
        if len(members) > LEAF and part.shape[1]:
            side = int(np.argmax(hi - lo))
            order = members[np.argsort(part[:, side], kind="stable")]
            half = len(order) // 2
            self.kids[at], self.members[at] = (self._grow(order[:half]), self._grow(order[half:])), None
        return at

    def search(self, queries: np.ndarray, own: list[int], k: int, least: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """(place of the query, vec_id, score) of the k best of each query; nothing below its bound in least is looked at."""
        above = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T  # the best inner product that a box allows
        for i, q in enumerate(queries):
            best: list[tuple[int, int]] = []  # (score, -vec_id), the worst first
            floor, bound = least[i], above[i]
            heap = [(-bound[0], 0)]
            while heap:
                b, at = heapq.heappop(heap)
                kth = best[0][0] if len(best) == k else floor
                if kth is not None and -b < kth:  # an equal score may still win by a smaller id
                    break
                if self.kids[at] is not None:
                    for kid in self.kids[at]:
                        heapq.heappush(heap, (-bound[kid], kid))
                    continue
                members = self.members[at]
                scores = self.rows[members] @ q
                if kth is not None:
                    keep = np.flatnonzero(scores >= kth)
                    members, scores = members[keep], scores[keep]
                for m, s in zip(members.tolist(), scores.tolist(), strict=True):
                    for v in self.ids[m]:
                        if v == own[i]:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (int(s), -v))
                        elif (int(s), -v) > best[0]:
                            heapq.heapreplace(best, (int(s), -v))
            yield from ((i, -v, s) for s, v in best)


class _Plain:
    """For components too large for exact floats: every row, in Python's integers; scores beyond a long are held at its limits."""

    def __init__(self, rows: np.ndarray, ids: list[int]):
        self.rows, self.ids = rows, ids

    def search(self, queries, own, k, least):
        top = (1 << 63) - 1
        for i, q in enumerate(queries):
            scores = [max(-top - 1, min(top, int(sum(a * b for a, b in zip(r, q, strict=True))))) for r in self.rows]
            best = heapq.nsmallest(k, ((-s, v) for s, v in zip(scores, self.ids, strict=True) if v != own[i]))
            yield from ((i, v, -s) for s, v in best)


def _exact(most: int, wide: int) -> bool:
    """Whether inner products of so wide vectors with components up to most stay exact in doubles."""
    return most * most * max(1, wide) < 2**53


def cuts_of(sample: np.ndarray, shards: int) -> list[tuple[int, float]]:
    """A complete binary tree of (side, value), by levels: the top of a KD-tree over the sample with at least `shards` leaves. Equal values go left."""
    depth = max(0, math.ceil(math.log2(max(1, shards))))
    groups, out = [np.arange(len(sample))], []
    for _ in range(depth):
        fresh = []
        for g in groups:
            part = sample[g]
            side = int(np.argmax(part.max(0) - part.min(0))) if len(g) else 0
            value = float(np.median(part[:, side])) if len(g) else 0.0
            left = part[:, side] <= value if len(g) else np.zeros(0, bool)
            out.append((side, value))
            fresh += [g[left], g[~left]]
        groups = fresh
    return out


def _leaves(x: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each row."""
    at, node = 0, np.zeros(len(x), np.int64)
    side, value = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts])
    while at < len(cuts):
        width = at + 1
        here = at + node
        node = 2 * node + (x[np.arange(len(x)), side[here]] > value[here])
        at += width
    return node


def _searched(k: int):
    """A function of sorted batches of one or more shards: first the vectors of a shard, for which it builds one tree, then the queries that visit it, however many."""

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard, tree, wide, most = None, None, 0, 0
        rows: list[list[int]] = []
        ids: list[int] = []

        def grown(largest: int):
            if _exact(max(most, largest), wide):
                return KDTree(np.array(rows, np.float64).reshape(len(rows), wide), np.array(ids), k), True
            return _Plain(np.array(rows, object).reshape(len(rows), wide), ids), False

        for batch in batches:
            names, query, vec, q, kth = (batch.column(c).to_pylist() for c in ("name", "query", "vec_id", "q", "kth"))
            out: list[tuple[int, int, int]] = []
            at = 0
            while at < len(names):
                if names[at] != shard:
                    shard, tree, rows, ids, wide, most = names[at], None, [], [], len(q[at]), 0
                to = at
                while to < len(names) and names[to] == shard and query[to] == query[at]:
                    to += 1
                if not query[at]:
                    rows += q[at:to]
                    ids += vec[at:to]
                    most = max(most, max((abs(x) for r in q[at:to] for x in r), default=0))
                elif rows:
                    largest = max((abs(x) for r in q[at:to] for x in r), default=0)
                    if tree is None or tree[1] and not _exact(max(most, largest), wide):
                        tree = grown(largest)
                    ask = np.array(q[at:to], np.float64 if tree[1] else object).reshape(to - at, wide)
                    found = tree[0].search(ask, vec[at:to], k, kth[at:to])
                    out += [(vec[at + i], v, s) for i, v, s in found]
                at = to
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, pruned: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row of queries among vectors.

    Both tables are (vec_id long, q array<long>); a row never finds its own id. Ties go to the smaller vec_id; fewer than k
    candidates give fewer rows; rows with a null vec_id or a null or empty q take no part; vectors of different lengths don't meet; an empty
    table gives no rows; other columns are ignored. Shards are the leaves of a KD-tree that a bounded sample sets; their boxes are
    those of all their rows. A query visits first the shard whose box allows the highest score, then, in rounds of falling bounds, those that may
    still hold a score as high as its kth; all others are dropped before any row moves. In each round a shard's vectors are read once,
    for one tree, and queries stream by, so neither is copied per block. pruned, if given, gets the numbers of pairs (query, shard) and of those visited.
    """
    spark = vectors.sparkSession
    good = "vec_id is not null and size(q) > 0"
    points = vectors.where(good).select("vec_id", "q", F.size("q").alias("dim"))
    asks = written(queries.where(good).select("vec_id", "q", F.size("q").alias("dim")).distinct(), "topk-queries")
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one number for each length of vectors
    fitted = {}
    for dim, n in sizes.items():
        wanted = min(math.ceil(n / shard), SAMPLE // EACH)
        if wanted > 1 and dim:
            step = max(1, math.ceil(n / min(SAMPLE, wanted * EACH * 4)))
            some = points.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0)).select("q").limit(SAMPLE)
            fitted[dim] = cuts_of(np.array([r.q for r in some.collect()], np.float64).reshape(-1, dim), wanted)

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            dims, leaf = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in fitted:
                    at = np.flatnonzero(dims == dim)
                    leaf[at] = _leaves(np.array(batch.column("q").take(pa.array(at)).to_pylist(), np.float64).reshape(len(at), dim), fitted[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "q", "dim", "leaf"])

    cells = written(points.mapInArrow(placed, "vec_id long, q array<long>, dim int, leaf long"), "topk-points")
    parts = cells.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / (2 * shard)).cast("long").alias("parts"))  # a row per shard
    parts = F.broadcast(parts)
    named = cells.join(parts, ["dim", "leaf"]).select("vec_id", "q", "dim", F.concat_ws(":", "dim", "leaf", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("parts"))).alias("name"))
    named = written(named, "topk-shards")
    sides = named.select("name", "dim", F.posexplode("q").alias("side", "x")).groupBy("name", "dim", "side").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    boxes = written(sides.groupBy("name", "dim").agg(F.array_sort(F.collect_list(F.struct("side", "lo", "hi"))).alias("box")).select("name", "dim", F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi")), "topk-boxes")
    # the best score that a box allows; doubles, with room for their rounding
    best = F.aggregate(
        F.zip_with("q", F.arrays_zip("lo", "hi"), lambda x, b: F.greatest(x.cast("double") * b["lo"], x.cast("double") * b["hi"])), F.lit(0.0), lambda a, x: a + x
    )
    bounds = asks.join(boxes, "dim").select("vec_id", "name", (best + F.abs(best) * 1e-12 + 1).alias("bound"))  # the stated queries against shards, not rows
    order = Window.partitionBy("vec_id").orderBy(F.desc("bound"), "name")
    bounds = written(bounds.withColumn("turn", F.row_number().over(order)), "topk-bounds")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = spark.createDataFrame([], SCORES)
    low, high, most = 0, FIRST, bounds.agg(F.max("turn")).first()[0] or 0
    visited = 0
    while low < most:
        kth = kept.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).withColumnRenamed("query_id", "vec_id")
        now = bounds.where((F.col("turn") > low) & (F.col("turn") <= high)).join(kth, "vec_id", "left").where("kth is null or bound >= kth")
        asked = written(now.join(asks, "vec_id").select("name", F.lit(True).alias("query"), "vec_id", "q", "kth"), "topk-asked")
        visited += asked.count()
        used = asked.select("name").distinct()
        rows = named.join(used, "name", "left_semi").select("name", F.lit(False).alias("query"), "vec_id", "q", F.lit(None).cast("long").alias("kth"))
        found = rows.unionByName(asked).repartition("name").sortWithinPartitions("name", "query").mapInArrow(_searched(k), SCORES)
        best_now = kept.unionByName(found).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).drop("rank")
        kept = written(best_now, "topk-best")
        low, high = high, high * (1 + MORE)
    if pruned is not None:
        pruned |= {"pairs": bounds.count(), "visited": visited}
    return kept.withColumn("rank", F.row_number().over(by_score)).select("query_id", "rank", "vec_id", "score")
