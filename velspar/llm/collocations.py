"""Phrase collocations from count streams in prefix and suffix order, which are merged in lockstep.

Words, pairs and triples with their counts lie in one sorted stream. In prefix order a phrase stands behind all that it starts with, so one
pass hands the counts of its beginnings on and takes the largest count of what continues it; in suffix order, sorted by the
words from the last to the first, a second pass does so for its ends. The passes look nothing up: no table of counts is held in memory.
Streams are cut into ranges of keys; a phrase whose continuations reach over a cut is copied to each range it has any in.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velspar.llm.common import mixed, text_bytes, words, written

#: A candidate's least count, its longest phrase; it goes where a longer candidate around it has at least this percentage of its count.
LEAST, LONGEST, COVER = 10, 3, 50
#: Phrases of each language in the result.
TOP = 2000
#: Words that a task counts together before it sends their phrases on; bytes of texts that it holds at a time, a longer text alone.
WORDS, BYTES = 1 << 18, 1 << 21
#: Rows that a task sends on at a time.
SENT = 1 << 15
#: 64-bit slots of the filter of pairs, whatever the input: 8 MB.
SLOTS = 1 << 20
#: Keys sampled for each range of a stream; they place the cuts and change no result.
SAMPLED = 32

_CLASS = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_CLASS[[9, 32]] = 1
_CLASS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def runs(column) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts in order, A-Z in lower case, and whether each stands behind the one before in the same piece of the same text."""
    data, limits = text_bytes(column)
    data = data[limits[0] : limits[-1]]
    limits = limits - limits[0]
    kind = _CLASS[data]
    solid = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[limits] = True
    first = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1]))
    if not len(first):
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    narrow = np.int32 if len(data) < 1 << 31 else np.int64
    held = np.cumsum(solid, dtype=narrow)
    offsets = np.append(held[first] - 1, held[-1]).astype(np.int64)
    breaks = np.cumsum((kind == 2) | edge[:-1], dtype=narrow)  # a text's first byte is a break, too
    linked = np.concatenate(([False], breaks[first[1:]] == breaks[first[:-1]]))
    out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[solid]]))
    return out, linked


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.ChunkedArray]]:
    """(lang, texts of it) in groups of about BYTES."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang in pc.unique(batch["lang"]).to_pylist():
            some = batch["text"].filter(pc.equal(batch["lang"], lang))
            limits = text_bytes(some)[1]
            at = 0
            while at < len(some):  # a batch may hold very long texts
                to = max(at + 1, int(np.searchsorted(limits, limits[at] + BYTES)))
                held.setdefault(lang, []).append(some.slice(at, to - at))
                size[lang] = size.get(lang, 0) + int(limits[min(to, len(some))] - limits[at])
                at = to
                if size[lang] >= BYTES:
                    yield lang, pa.chunked_array(held.pop(lang))
                    size[lang] = 0
    for lang, parts in held.items():
        yield lang, pa.chunked_array(parts)


def _hashed(dictionary) -> np.ndarray:
    return words(dictionary)[0]


def _pairs_hashed(lang: str, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    own = words(pa.array([f"l{lang}"]))[0][0] if lang.strip() else np.uint64(1)
    return mixed(mixed(one + own) * np.uint64(3) + two)


def counter(n: tuple[int, ...], sieve: Callable[[], np.ndarray] | None = None) -> Callable:
    """A task's counts (lang, w1, w2, w3, f) of phrases of n words; with a filter, only of triples whose two pairs may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sieve() if sieve else None
        for lang, texts in _texts(batches):
            every, linked = runs(texts)
            for at in range(0, len(every), WORDS):
                part, own = every.slice(at, WORDS + 2).dictionary_encode(), min(WORDS, len(every) - at)
                order = pc.array_sort_indices(part.dictionary).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))  # in the order of words, so that equal beginnings lie together
                ids, names, v = place[part.indices.to_numpy()], part.dictionary.take(pa.array(order)), len(order)
                b = linked[at : at + WORDS + 2]
                two = np.flatnonzero(b[1:])
                for k in n:
                    if k == 1:
                        keys, f = np.unique(ids[:own], return_counts=True)
                    else:
                        start = two if k == 2 else two[np.isin(two + 1, two, assume_unique=True)]
                        start = start[start < own]
                        keys = ids[start] * v + ids[start + 1]
                        if k == 3:
                            if slots is not None:
                                h = _hashed(names)
                                known = np.zeros(len(ids), bool)
                                known[two] = found(slots, _pairs_hashed(lang, h[ids[two]], h[ids[two + 1]]))
                                start = start[known[start] & known[start + 1]]
                            keys = (ids[start] * v + ids[start + 1]) * v + ids[start + 2]
                        keys, f = np.unique(keys, return_counts=True)
                    if not len(keys):
                        continue
                    for out in range(0, len(keys), SENT):
                        some, own_f = keys[out : out + SENT], f[out : out + SENT].astype(np.int64)
                        columns = [names.take(pa.array(some // v ** (k - 1 - i) % v)).cast(pa.string()) if i < k else pa.nulls(len(some), pa.string()) for i in range(3)]
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), *columns, pa.array(own_f)], names=["lang", "w1", "w2", "w3", "f"])
            del every, linked
            pa.default_memory_pool().release_unused()

    return run


COUNTS = "lang string, w1 string, w2 string, w3 string, f long"


def found(slots: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter holds a hash: two bits of one slot."""
    mask = (np.uint64(1) << (h & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(6)) & np.uint64(63)))
    return (slots[((h >> np.uint64(12)) % np.uint64(len(slots))).astype(np.int64)] & mask) == mask


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A filter of SLOTS words that holds all pairs (lang, w1, w2): it may let others through, whose counts decide later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                some = batch.filter(pc.equal(batch["lang"], lang))
                h = _pairs_hashed(lang, _hashed(some["w1"]), _hashed(some["w2"]))
                mask = (np.uint64(1) << (h & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(6)) & np.uint64(63)))
                slot = ((h >> np.uint64(12)) % np.uint64(SLOTS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    slots = np.zeros(SLOTS, np.uint64)
    rows = pairs.select("lang", "w1", "w2").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask"))
    got = rows.toArrow()
    slots[got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return slots


def counted(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two tables of (lang, text): counts (lang, w1, w2, w3, f) of all phrases with f >= least, and (lang, n) of all words.

    Words and pairs are counted first. A triple is as rare as its rarer pair at most, so triples whose pairs can't both be frequent are left
    out before the shuffle: a filter of fixed size says which, and lets more through, but never fewer, when it fills up.
    """
    spark = texts.sparkSession
    key = ["lang", "w1", "w2", "w3"]
    low = written(texts.mapInArrow(counter((1, 2)), COUNTS).groupBy(*key).agg(F.sum("f").alias("f")).where(f"f >= {least} or w2 is null"), "phrase-low")
    sizes = low.where("w2 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    low = low.where(f"f >= {least}")
    slots = spark.sparkContext.broadcast(pair_filter(low.where("w2 is not null")))
    high = texts.mapInArrow(counter((3,), lambda: slots.value), COUNTS).groupBy(*key).agg(F.sum("f").alias("f")).where(f"f >= {least}")
    return written(low.unionByName(high), "phrase-counts"), sizes


# --- the passes --------------------------------------------------------------------------------------------------

STREAM = "lang string, w1 string, w2 string, w3 string, f long, l1 long, l2 long, r1 long, r2 long, around long"
#: Behind any word that starts with another.
_LAST = "\U0010ffff\U0010ffff"


def _key(lang: str, order: list) -> tuple:
    return (lang.encode(), *(b"" if w is None else w.encode() for w in order))


def dealt(stream: DataFrame, suffix: bool) -> DataFrame:
    """stream with k1, k2, k3, its words from the first on or, with suffix, from the last on, and part, the number of its range; sorted in each range.

    Words and pairs have a copy (own = false) in each further range that holds phrases with them.
    """
    spark = stream.sparkSession
    back = F.array_compact(F.reverse(F.array("w1", "w2", "w3")))
    keyed = stream.withColumns({f"k{i + 1}": F.get(back, i) if suffix else F.col(f"w{i + 1}") for i in range(3)})
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.count()
    size = SAMPLED * parts
    sample = keyed if rows <= size else keyed.where(F.pmod(F.xxhash64("lang", "k1", "k2", "k3"), F.lit(max(1, rows // size))) == 0)
    keys = sorted(_key(r[0], r[1:]) for r in sample.select("lang", "k1", "k2", "k3").limit(4 * size).collect())
    cuts = spark.sparkContext.broadcast(sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = cuts.value
        for b in batches:
            low, high = [], []
            for lang, *k in zip(b["lang"], b["k1"], b["k2"], b["k3"], strict=True):
                key = _key(lang, k)
                low.append(bisect_right(at, key))
                solid = sum(1 for w in k if w is not None)
                high.append(low[-1] if solid == 3 else bisect_right(at, (*key[: solid + 1], _LAST.encode()) if solid == 2 else (*key[:2], _LAST.encode(), b"")))
            b["part"] = low
            span = np.array(high) - np.array(low) + 1
            out = b.loc[b.index.repeat(span)].copy()
            step = np.concatenate([np.arange(s) for s in span]) if len(span) else np.zeros(0, int)
            out["part"] = out["part"].to_numpy() + step
            out["own"] = step == 0
            yield out

    placed = keyed.mapInPandas(run, f"{STREAM}, k1 string, k2 string, k3 string, part int, own boolean")
    return placed.repartition(F.col("part")).sortWithinPartitions("part", "lang", "k1", "k2", "k3", F.col("own").desc())


def passed(stream: DataFrame, suffix: bool) -> DataFrame:
    """stream with the counts of each phrase's shorter beginnings in l1 (one word) and l2 (two), or with suffix of its ends in r1 and r2, and in
    `around` of a pair the largest count of a triple that continues it in this order. What a copy of a pair has seen is a row of its own with f null."""
    one, two = ("r1", "r2") if suffix else ("l1", "l2")
    names = [c.split()[0] for c in STREAM.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None  # the last word and the last pair, whose phrases may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            if carried is not None:
                b = pd.concat([carried[carried["part"] == b["part"].iloc[0]], b], ignore_index=True)
            f = b["f"].to_numpy()
            solid = b["k2"].notna().to_numpy().astype(np.int8) + b["k3"].notna().to_numpy().astype(np.int8)
            at = np.arange(len(b))
            word, pair = np.maximum.accumulate(np.where(solid == 0, at, 0)), np.maximum.accumulate(np.where(solid == 1, at, 0))
            out = b.copy()
            out[one] = np.where(solid > 0, f[word], 0)
            out[two] = np.where(solid == 2, f[pair], 0)
            around = np.zeros(len(b), np.int64)
            np.maximum.at(around, pair[solid == 2], f[solid == 2])
            out["around"] = np.maximum(b["around"].to_numpy(), around)
            copy = ~b["own"].to_numpy()
            out.loc[copy, "f"] = 0
            keep = np.where(copy, (solid == 1) & (out["around"].to_numpy() > 0), True)
            last = [i for i in {int(word[-1]), int(pair[-1])} if solid[i] == (0 if i == word[-1] else 1)]
            carried = b.iloc[sorted(last)].copy()
            carried["own"], carried["around"] = False, 0
            yield out.loc[keep, names]

    return dealt(stream, suffix).mapInPandas(run, STREAM)


def _merged(stream: DataFrame) -> DataFrame:
    """One row for each phrase: what its copies have seen joins it."""
    return stream.groupBy("lang", "w1", "w2", "w3").agg(*[F.max(c).alias(c) for c in ("f", "l1", "l2", "r1", "r2", "around")])


def phrases(documents: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` best phrases of 2 to 3 words.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces and at blanks and tabs into words; a null text is empty, a null lang
    is `und`. a counts the phrase within pieces, overlaps included, n all words of lang; candidates have a >= least. A cut has l and r, the
    counts of both sides, and the score floor(1000000 a a / (l r)); the lowest counts, of equal ones the first. A candidate
    goes if a longer one around it has at least `cover` percent of its count. Equal scores go by a, then by the phrase's bytes. Repeated rows count
    each; columns besides lang and text play no part; an empty table gives an empty one. Very long texts are counted WORDS words at a time.
    """
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, sizes = counted(texts, least)
    none = {c: F.lit(0).cast("long") for c in ("l1", "l2", "r1", "r2", "around")}
    ahead = written(_merged(passed(counts.withColumns(none), False)), "phrase-prefix")
    both = _merged(passed(ahead, True)).where("w2 is not null")
    # decimals of 38 digits hold the products of counts below 10^15
    score = lambda a, b: F.expr(f"(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast({a} as decimal(18,0)) * cast({b} as decimal(18,0)))")
    # of a pair the one word on each side; of a triple the first cut has the word l1 and the pair r2, the second the pair l2 and the word r1
    cuts = both.where(f"f >= {least} and not (w3 is null and 100 * around >= {cover} * f)").withColumns({
        "s1": F.when(F.col("w3").isNull(), score("l1", "r1")).otherwise(score("l1", "r2")),
        "s2": F.when(F.col("w3").isNotNull(), score("l2", "r1")),
    })
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
        F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(F.col("w3").isNull() | second, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.when(second, F.col("s2")).otherwise(F.col("s1")).cast("long").alias("score"),
    )
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(f"rank <= {top}")
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(table: str = "documents", least: int = LEAST, cover: int = COVER, top: int = TOP) -> str:
    """DuckDB SQL for phrases: counts by grouping, sides and longer phrases by joins."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM {table}),
pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
numbered AS (SELECT lang, p, row_number() OVER () AS i FROM pieces),
cut AS (SELECT lang, i, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS ws FROM numbered),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS j FROM cut),
grams AS (
  SELECT lang, ws[j] AS g, 1 AS k FROM w UNION ALL SELECT lang, ws[j] || ' ' || ws[j + 1], 2 FROM w WHERE j + 1 <= len(ws)
  UNION ALL SELECT lang, ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2], 3 FROM w WHERE j + 2 <= len(ws)),
c AS (SELECT lang, g, k, count(*) AS f FROM grams GROUP BY lang, g, k),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, g, k, f AS a, string_split(g, ' ') AS x FROM c WHERE k > 1 AND f >= {least}),
sides AS (
  SELECT lang, g, k, a, 1 AS place, x[1] AS lg, array_to_string(x[2:], ' ') AS rg FROM cand
  UNION ALL SELECT lang, g, k, a, 2, x[1] || ' ' || x[2], x[3] FROM cand WHERE k = 3),
scored AS (
  SELECT s.lang, s.g, s.k, s.a, s.place, l.f AS l, r.f AS r, ((1000000::HUGEINT * s.a * s.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM sides s JOIN c l ON l.lang = s.lang AND l.g = s.lg JOIN c r ON r.lang = s.lang AND r.g = s.rg),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, place) AS o FROM scored),
longer AS (
  SELECT lang, x[1] || ' ' || x[2] AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, x[2] || ' ' || x[3], a FROM cand WHERE k = 3),
cover AS (SELECT lang, g, max(a) AS b FROM longer GROUP BY lang, g),
kept AS (SELECT o.* FROM low o LEFT JOIN cover v ON v.lang = o.lang AND v.g = o.g WHERE o.o = 1 AND NOT (v.b IS NOT NULL AND 100 * v.b >= {cover} * o.a AND o.k = 2)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT r.lang, r.rank, r.g AS phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= {top}"""
