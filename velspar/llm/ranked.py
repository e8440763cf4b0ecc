"""Ranked lexical search by two trees: one over items, one over each group of documents; nodes hold the largest coordinate of what lies beneath.

A document's coordinate for a term is what one occurrence of the term in an item adds to its score, an item's is how often it has the term. The
product of two nodes' maxima bounds every score between them. A pair of nodes whose bound is below the weakest kth score of its items
is left with all that lies beneath it. kth scores of a first round, in which each group scores its best leaf for each item, travel to the second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velspar.llm.common import text_bytes, written

#: Items of a block; all documents are read once for each block.
ITEMS = 256
#: Coordinates (documents x terms) of a group of documents, and documents of it at most; documents and items of a leaf.
CELLS, GROUP, LEAF, FEW = 1 << 22, 1024, 16, 4
#: Bytes of texts that are cut into terms at a time, a longer text alone.
BYTES = 1 << 24
#: Fixed values of the score: its weight's factor, its scale, the term frequency's factor and the length's share in percent.
WEIGHT, SCALE, TF, NORM, SHARE = 1000, 1_000_000_000, 1000, 12, 25

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms(column) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The terms of all texts in order, and each text's limits in them: runs of letters, digits and all beyond ASCII, only A-Z in lower case."""
    data, limits = text_bytes(column)
    data, limits = data[limits[0] : limits[-1]], limits - limits[0]
    solid = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[limits] = True
    first = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1]))
    if not len(first):
        return pa.array([], pa.large_string()), np.zeros(len(limits), np.int64)
    held = np.cumsum(solid)
    offsets = np.append(held[first] - 1, held[-1]).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[solid]]))
    return out, np.searchsorted(first, limits)


def counted(documents: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs) of each row: its number of terms and those of the vocabulary with their counts."""
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n long, ids array<int>, tfs array<int>"

    def part(ids, texts) -> pa.RecordBatch:
        every, limits = terms(texts)
        place = pc.index_in(every, held.value)
        row = np.repeat(np.arange(len(texts)), np.diff(limits))
        known = pc.is_valid(place).to_numpy(zero_copy_only=False)
        v = len(held.value)
        key, tf = np.unique(row[known] * v + pc.fill_null(place, 0).to_numpy()[known], return_counts=True)
        cuts = pa.array(np.searchsorted(key // v, np.arange(len(texts) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(limits)), pa.ListArray.from_arrays(cuts, pa.array((key % v).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))],
            names=["doc_id", "n", "ids", "tfs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits, at = text_bytes(b["text"])[1], 0
            while at < b.num_rows:
                to = min(b.num_rows, max(at + 1, int(np.searchsorted(limits, limits[at] + BYTES))))
                yield part(b["doc_id"].slice(at, to - at), b["text"].slice(at, to - at))
                at = to

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of x by the leaves of a binary tree, -1 where a leaf has no more, and the nodes' largest coordinates, from the root to the leaves.

    A node is parted across a direction in which its rows differ much (steps of the power method), at the widest gap of its middle half.
    """
    nodes = [np.arange(len(x))]
    towards = np.random.default_rng(0).standard_normal(x.shape[1])
    for _ in range(max(0, math.ceil(math.log2(max(1, len(x)) / leaf)))):
        halves = []
        for rows in nodes:
            if len(rows) < 2:
                halves += [rows, rows[:0]]
                continue
            own = x[rows] - x[rows].mean(0)
            for _ in range(2):
                line = own @ towards
                towards = line @ own
                towards /= max(np.abs(towards).max(), 1e-300)
            line = own @ towards
            order = np.argsort(line, kind="stable")
            first = max(1, len(rows) // 4)
            gaps = np.diff(line[order])[first - 1 : max(first, len(rows) - first)]
            cut = first + int(gaps.argmax()) if gaps.max(initial=0) > 0 else len(rows) // 2
            halves += [rows[order[:cut]], rows[order[cut:]]]
            towards = np.random.default_rng(len(halves)).standard_normal(x.shape[1])
        nodes = halves
    at = np.full((len(nodes), max(1, max(map(len, nodes)))), -1)
    top = np.zeros((len(nodes), x.shape[1]))
    for i, rows in enumerate(nodes):
        at[i, : len(rows)] = rows
        if len(rows):
            top[i] = x[rows].max(0)
    levels = [top]
    while len(levels[0]) > 1:
        levels.insert(0, np.maximum(levels[0][::2], levels[0][1::2]))
    return at, levels


@dataclass
class Search:
    """A block of items against groups of documents; `floor` has scores that k documents are known to reach, for each item."""

    q: np.ndarray  # items x terms, how often
    weight: np.ndarray
    docs: int
    length: int
    k: int
    floor: np.ndarray

    def __post_init__(self) -> None:
        self.at, self.levels = tree(self.q, FEW)
        #: Doubles are exact below 2^53; a block with larger scores is summed in 64-bit integers.
        self.exact = float((self.q @ self.weight).max(initial=0)) * (SCALE / TF) < 2.0**53
        self.visited = self.possible = 0

    def contributions(self, n: list[int], ids: list[np.ndarray], tfs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(n), len(self.weight)))
        for i, (size, t, f) in enumerate(zip(n, ids, tfs, strict=True)):
            m = 100 - SHARE + SHARE * int(size) * self.docs // self.length
            x[i, t] = self.weight[t] * (SCALE * f.astype(np.int64) // (TF * f.astype(np.int64) + NORM * m))
        return x

    def group(self, x: np.ndarray, best: dict[str, np.ndarray], base: int, first: bool) -> None:
        """Scores of the group's documents that can be among an item's k best join `best` (item, score, row); with first, only those of each item's best leaf."""
        at, levels = tree(x, LEAF)
        floor = np.maximum(best["floor"], self.floor)
        items, docs = self.levels, levels
        deep = max(len(items), len(docs))
        low = np.where(self.at >= 0, floor[self.at], np.inf).min(1)  # the weakest kth score of each leaf of items
        lows = [low]
        while len(lows[0]) > 1:
            lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
        pairs = np.ones((1, 1), bool)
        bound = None
        for level in range(deep):
            i, d = items[min(level, len(items) - 1)], docs[min(level, len(docs) - 1)]
            if level:
                pairs = np.repeat(pairs, len(i) // pairs.shape[0], 0)
                pairs = np.repeat(pairs, len(d) // pairs.shape[1], 1)
            rows, columns = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
            bound = np.zeros(pairs.shape)
            bound[np.ix_(rows, columns)] = i[rows] @ d[columns].T
            # a bound is a rounded sum of whole numbers, exact below 2^53; beyond, the slack covers its error
            slack = 1.0 if self.exact else 1.0 + 1e-9
            pairs &= (bound > 0) & (bound * slack >= lows[min(level, len(lows) - 1)][:, None])
            if not pairs.any():
                self.possible += len(self.at) * len(at)
                return
        if first:
            keep = np.zeros_like(pairs)
            keep[np.arange(len(pairs)), np.where(pairs, bound, -1).argmax(1)] = True
            pairs &= keep
        self.possible += pairs.size
        leaves = np.flatnonzero(pairs.any(0))
        for leaf in leaves[np.argsort(-np.where(pairs, bound, 0).max(0)[leaves], kind="stable")]:
            open_ = pairs[:, leaf] & (bound[:, leaf] * slack >= np.where(self.at >= 0, best["floor"][self.at], np.inf).min(1))
            self.visited += int(open_.sum())
            own = self.at[open_].ravel()
            own, rows = own[own >= 0], at[leaf][at[leaf] >= 0]
            if not len(own):
                continue
            used = np.flatnonzero(levels[-1][leaf])
            a, b = self.q[np.ix_(own, used)], x[np.ix_(rows, used)]
            s = (a @ b.T).astype(np.int64) if self.exact else a.astype(np.int64) @ b.astype(np.int64).T
            i, d = np.nonzero((s > 0) & (s >= best["floor"][own][:, None]))
            if len(i):
                best["item"] = np.concatenate((best["item"], own[i]))
                best["score"] = np.concatenate((best["score"], s[i, d]))
                best["row"] = np.concatenate((best["row"], rows[d] + base))
                touched = np.unique(own[i])
                order = np.lexsort((-best["score"], best["item"]))
                item, score = best["item"][order], best["score"][order]
                last = np.searchsorted(item, touched) + self.k - 1
                full = last < np.searchsorted(item, touched, "right")
                best["floor"][touched[full]] = np.maximum(best["floor"][touched[full]], score[last[full]])

    def run(self, batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """(item, score, doc_id): a task's k best documents of each item, of equal scores those with the least doc_id."""
        size = max(1, min(GROUP, CELLS // max(1, len(self.weight))))
        # what the task has so far: floor, and candidates whose rows index `held`
        best = {"floor": self.floor.copy(), "item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "row": np.zeros(0, np.int64)}
        held, kind = pa.nulls(0), None
        for b in batches:
            kind = b["doc_id"].type
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                lists = lambda c: np.split(part[c].flatten().to_numpy(), np.cumsum(pc.list_value_length(part[c]).to_numpy())[:-1])
                x = self.contributions(part["n"].to_pylist(), lists("ids"), lists("tfs"))
                held = pa.concat_arrays([held.cast(kind), part["doc_id"]])
                self.group(x, best, len(held) - part.num_rows, first)
                held = self._cut(best, held)
        if kind is not None and len(best["item"]):
            yield pa.RecordBatch.from_arrays([pa.array(best["item"].astype(np.int32)), pa.array(best["score"]), held.take(pa.array(best["row"]))], names=["item", "score", "doc_id"])

    def _cut(self, best: dict[str, np.ndarray], held: pa.Array) -> pa.Array:
        """Leaves k candidates for each item, and their doc_ids."""
        ids = held.take(pa.array(best["row"]))
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((rank, -best["score"], best["item"]))
        item = best["item"][order]
        order = order[np.arange(len(order)) - np.searchsorted(item, item) < self.k]
        best["item"], best["score"] = best["item"][order], best["score"][order]
        best["row"] = np.arange(len(order))
        return ids.take(pa.array(order))


def _block(documents: DataFrame, ids: list, texts: list, k: int) -> DataFrame:
    """(item, score, doc_id), the k best documents of each item of a block."""
    spark = documents.sparkSession
    every, limits = terms(pa.array(texts, pa.string()))
    code = every.dictionary_encode()
    vocabulary, v = code.dictionary, len(code.dictionary)
    q = np.zeros((len(ids), v))
    np.add.at(q, (np.repeat(np.arange(len(ids)), np.diff(limits)), code.indices.to_numpy()), 1)
    found = written(counted(documents, vocabulary), "lexical-terms")
    n, length = found.select(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(v, np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v, np.int64)
        for b in batches:
            total += np.bincount(b["ids"].flatten().to_numpy(), minlength=v)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "df"])

    for row in found.select("ids").mapInArrow(tally, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
        df[row["id"]] = row["df"]
    weight = np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    schema = f"item int, score long, doc_id {documents.schema['doc_id'].dataType.simpleString()}"
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))

    def round_(floor: np.ndarray, first: bool) -> DataFrame:
        held = spark.sparkContext.broadcast((q, weight, n, length, k, floor))
        rows = found.where("size(ids) > 0").mapInArrow(lambda b: Search(*held.value).run(b, first), schema)
        return rows.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")

    floor = np.zeros(len(ids), np.int64)
    for row in round_(floor, True).where(f"rank = {k}").select("item", "score").collect():  # a row per item of the block
        floor[row["item"]] = row["score"]
    return round_(floor, False)


def search(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by ascending doc_id (null first).

    documents has doc_id and text, items item_id and text. Terms are runs of ASCII letters and digits and of all other characters beyond ASCII,
    A-Z in lower case; a null or empty text has none, and an item without any ranks nothing. N documents have a term, L is all their number, n one
    document's, df the documents with a term, tf its occurrences. Its weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is
    75 + (25 n N) div L, and each term of an item, repeats included, adds weight * ((10^9 tf) div (1000 tf + 12 m)).
    Each row counts as a document or an item of its own, repeated ids too; other columns play no part; an empty table gives an empty one.

    Items go in blocks of ITEMS at most, whose terms are broadcast; all documents are read once a block. A task holds a group of documents,
    k candidates an item, and one text's terms.
    """
    spark = documents.sparkSession
    numbered = written(items.select("item_id", "text").withColumn("__row", F.monotonically_increasing_id()), "lexical-items")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score long"
    block = F.floor(F.col("__row") / ITEMS)
    parts = []
    for (at,) in numbered.select(block.alias("b")).distinct().orderBy("b").collect():
        own = numbered.where(block == at).orderBy("__row").collect()
        if any(r["text"] for r in own):
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            found = _block(documents, [r["item_id"] for r in own], [r["text"] for r in own], k)
            parts.append(written(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-found"))
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def oracle(documents: str = "documents", items: str = "benchmark", k: int = 20) -> str:
    """DuckDB SQL for search, for unique item_ids: every document with a term of an item is scored."""
    upper = "".join(map(chr, range(65, 91)))
    cut = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {cut("text")} AS ts FROM {documents}),
n AS (SELECT doc_id, len(ts) AS n FROM d),
g AS (SELECT (count(*) FILTER (WHERE n > 0))::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
q AS (SELECT item_id, t, count(*) AS f FROM (SELECT item_id, unnest({cut("text")}) AS t FROM {items}) GROUP BY item_id, t),
p AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, floor({WEIGHT} * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nn),
m AS (SELECT doc_id, {100 - SHARE} + (({SHARE} * n.n * nn) // ll) AS m FROM n, g),
s AS (SELECT q.item_id, p.doc_id, sum(q.f * w.w * (({SCALE} * p.tf) // ({TF} * p.tf + {NORM} * m.m)))::BIGINT AS score
  FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t JOIN m ON m.doc_id = p.doc_id GROUP BY q.item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {k}"""
