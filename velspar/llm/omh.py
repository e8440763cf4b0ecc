"""Near-duplicates by Order MinHash, verified by banded alignment.

Each sketch of a text takes the few least of its occurrence-labelled word shingles and keeps them in text order, so two
texts share it if they have the same shingles in the same order: it follows edit similarity, not only the set of
shingles. Texts that share a sketch are candidates; the alignment of their shingle sequences decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velspar.llm.common import components, mixed, shingles, words, written

#: Words of a shingle, shingles of a sketch, sketches of a text. Two texts that share m of u shingles in order share a sketch with
#: probability C(m, 6) / C(u, 6) each: at similarity 0.8 they miss all 40 with 2e-5 at most beyond 40 shingles, 5e-6 if very long.
WORDS, TAKEN, SKETCHES = 5, 6, 40
SIMILARITY = 0.8
#: Pairs whose longer text has few shingles miss no key: (its least and most shingles, shingles of a key).
SHORT = ((1, 10, 4), (11, 20, 3), (21, 40, 2))
SALTS = 64
#: Nodes of a bucket that one group of the last join holds, twice.
BUCKET = 2048
RESULTS = ("class_id", "kept", "linked_doc", "similarity")
#: Shingles that are ordered at a time, over several sketches if a text is short.
TOGETHER = 1 << 20
#: 64-bit words of a text's parity bits.
PARITY = 8
_LABEL = np.uint64(0xA24BAED4963EE407)
_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes in text order, each mixed with how often it occurred before in the text."""
    sh = shingles(hashes, WORDS)
    order = np.argsort(sh, kind="stable")
    same = sh[order]
    new = np.concatenate(([True], same[1:] != same[:-1]))[: len(sh)]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
    seen = np.zeros(len(sh), np.uint64)
    seen[order] = np.arange(len(sh)) - begin
    return mixed(sh + seen * _LABEL)


def short_keys(own: np.ndarray) -> np.ndarray:
    """Keys of the pairs in SHORT that the text can belong to: all choices of a few of its least shingles, hashed in text order.

    At similarity 0.8 or more at most a fifth of either text's shingles is not shared, so the `taken` least shared ones are among
    the fifth + `taken` least of both, and each text makes a key of just these.
    """
    n, keys = len(own), [np.zeros(0, np.uint64)]
    order = np.argsort(own, kind="stable")
    for low, high, taken in SHORT:
        if n > high or 5 * n < 4 * low:  # no partner makes such a pair
            continue
        taken = min(taken, n)
        places = np.array(list(combinations(sorted(order[: n // 5 + taken].tolist()), taken)))
        key = np.full(len(places), mixed(np.array([low], np.uint64))[0])
        for j in range(taken):
            key = mixed(key * np.uint64(31) + own[places[:, j]])
        keys.append(key)
    return np.concatenate(keys)


def sketches(own: np.ndarray) -> np.ndarray:
    """short_keys, and for a text that may have a partner beyond them SKETCHES keys: of each order of the labelled shingles the TAKEN least, hashed in text order."""
    short = short_keys(own)
    if 5 * len(own) <= 4 * SHORT[-1][1]:
        return short
    taken = min(TAKEN, len(own))
    keys = np.empty(len(_SEEDS), np.uint64)
    step = max(1, min(8, TOGETHER // max(1, len(own))))
    for at in range(0, len(_SEEDS), step):
        seeds = _SEEDS[at : at + step]
        v = (own[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        places = np.sort(np.argpartition(v, taken - 1, axis=1)[:, :taken], axis=1)
        key = seeds.copy()
        for j in range(taken):
            key = mixed(key * np.uint64(31) + own[places[:, j]])
        keys[at : at + step] = key
    return np.concatenate((short, keys))


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared shingles in order / all shingles, by an alignment in the band that `least` allows; 0 if it is surely below `least`.

    m aligned shingles give m / (len(a) + len(b) - m), so `least` allows len(a) + len(b) - 2 m gaps, and no aligned pair
    lies further off the diagonal. Labelled shingles are unique in a text, so the longest common subsequence is the
    longest rising run of places.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    need = least * total / (1 + least)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    band = total - 2 * need + 1
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    tails: list[int] = []
    for x in j[np.argsort(i, kind="stable")].tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    m = len(tails)
    return m / (total - m)


def parity(own: np.ndarray) -> np.ndarray:
    """64 * PARITY bits, each the parity of the labelled shingles that fall on it: two texts differ in at least as many shingles as in bits."""
    odd = np.bincount((own % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCHED = "n1 long, n2 long, keys array<long>, n int, bits array<long>"


def _sketched(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            h, _, _, limits = words(part.column("text"))
            own = [labelled(h[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
            keys = [sketches(o).view(np.int64) if len(o) else None for o in own]
            yield pa.RecordBatch.from_arrays([part.column("n1"), part.column("n2"), pa.array(keys, kind), pa.array([len(o) for o in own], pa.int32()), pa.array([parity(o) for o in own], kind)], names=["n1", "n2", "keys", "n", "bits"])


def _possible(x: str, y: str) -> Column:
    """Whether two texts can be similar at all: m aligned shingles need at least 0.8 / 1.8 of both lengths together, so what is left over, and so
    the parity bits in which they differ, is at most 0.2 / 1.8 of them."""
    left = (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    differ = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(PARITY)), F.lit(0))
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= left) & (differ <= left)


def _sequences(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            h, _, _, limits = words(part.column("text"))
            found = [labelled(h[a:b]).astype("<u8").tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "seq"])


def _aligned(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        a, b = batch.column("seq_a"), batch.column("seq_b")
        found = [similarity(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _links(pairs: DataFrame, seq: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, with their similarity, written; seq holds the sequences of all nodes that share a key."""
    both = pairs.join(seq.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")), "b").join(seq.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")), "a")
    links = both.select("a", "b", "seq_a", "seq_b").mapInArrow(_aligned, "a long, b long, similarity double")
    return written(links.where(F.col("similarity") >= SIMILARITY), "omh-links")


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members (key, node) with their colour, of the buckets that hold more than one."""
    coloured = members.join(classes, members["node"] == classes["id"], "left").select("key", "node", F.coalesce("component", "node").alias("colour"))
    several = coloured.groupBy("key").agg(F.min("colour").alias("low"), F.max("colour").alias("high")).where("low < high").select("key")
    return coloured.join(several, "key", "left_semi")


def _grown(classes: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """classes (id, component), at most `rows`, after linked ones have joined: only the classes' representatives are linked anew."""
    if links.isEmpty():
        return classes
    more = links.select("a", "b")
    for end in ("a", "b"):
        own = classes.select(F.col("id").alias(end), F.col("component").alias("__c"))
        more = more.join(own, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    joined = components(more, "omh-joined").select(F.col("id").alias("component"), F.col("component").alias("last"))
    grown = classes.join(joined, "component", "left").select("id", F.coalesce("last", "component").alias("component"))
    return written(grown.unionByName(joined.select(F.col("component").alias("id"), F.col("last").alias("component"))).distinct(), "omh-classes", rows)


def _apart(left: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that share a key but no colour and may be similar, each once, for left (key, node, colour, n, bits, keys).

    A bucket is cut into blocks of about BUCKET nodes and each two blocks are one group of the join, so no task holds a bucket.
    """
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("long").alias("blocks"))
    dealt = left.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")))
    low = dealt.withColumn("i", F.col("mine")).withColumn("j", F.explode(F.sequence("mine", F.col("blocks") - 1)))
    high = dealt.withColumn("j", F.col("mine")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "mine")))
    x, y = low.alias("x"), high.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")]
    ordered = (F.col("x.mine") < F.col("y.mine")) | (F.col("x.node") < F.col("y.node"))
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # a pair that shares several sketches comes out of one bucket
    pairs = x.join(y, same[0] & same[1] & same[2] & ordered & (F.col("x.colour") != F.col("y.colour")) & _possible("x", "y") & once)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """documents with class_id, the least doc_id of the texts that links reach, kept, true on one row of each class, linked_doc and similarity.

    Links join texts whose similarity, the share of five-word shingles that align in order, is 0.8 or more. Equal texts are one node
    from the start, by 128 bits of their SHA-256. In each bucket of a sketch every node is aligned with the least one, with the
    one before it, and, if the bucket still holds several classes, with the one that has most links; then the pairs that are still in
    different classes are aligned too, unless their lengths or the parity bits of their shingles rule out that they are similar. So
    buckets of any size lose no link, and none is expanded into all its pairs. The row kept is that of the least doc_id; a null
    doc_id comes first and its class_id is null if alone. linked_doc is the document, the least of its text, that a row's text was aligned with and is
    most similar to, similarity says how much; both are null for a text without a link. Texts without words (null, empty, blank) are one class if equal,
    null counting as empty. Texts under five words are one shingle. Rows that repeat a doc_id and its text are kept or not
    together; an empty table gives an empty result. Columns of these four names are replaced, others stay.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    base = documents.drop(*RESULTS).withColumn("__n1", half(1)).withColumn("__n2", half(17))
    named = base.select("doc_id", "text", F.col("__n1").alias("n1"), F.col("__n2").alias("n2"))
    sketched = named.select("n1", "n2", "text").mapInArrow(_sketched, SKETCHED).where("keys is not null").groupBy("n1", "n2").agg(*[F.first(c).alias(c) for c in ("keys", "n", "bits")])
    keyed = written(sketched.withColumn("node", F.monotonically_increasing_id()), "omh-sketches")
    buckets = keyed.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("key", "least")
    members = written(buckets.join(shared, "key"), "omh-members")
    rows = members.count()
    bearers = written(named.groupBy("n1", "n2").agg(F.min("doc_id").alias("bearer")), "omh-bearers")
    # the sequences of all texts that share a key are made once
    needed = members.select("node").distinct().join(keyed.select("node", "n1", "n2"), "node").join(bearers, ["n1", "n2"])
    t, n = named.alias("t"), needed.alias("n")
    texts = t.join(n, (F.col("t.n1") == F.col("n.n1")) & (F.col("t.n2") == F.col("n.n2")) & F.col("t.doc_id").eqNullSafe(F.col("n.bearer"))).select("n.node", "t.text")
    seq = written(texts.mapInArrow(_sequences, "node long, seq binary").groupBy("node").agg(F.first("seq").alias("seq")), "omh-seq")
    before = F.lag("node").over(Window.partitionBy("key", F.pmod("node", F.lit(SALTS))).orderBy("node"))  # salted: a bucket may hold a third of all texts
    near = members.select(F.col("least").alias("a"), F.col("node").alias("b")).union(members.select(before.alias("a"), "node")).where("a < b").distinct()
    near = written(near, "omh-pairs", 2 * rows)
    links = _links(near, seq)
    classes = written(components(links, "omh-classes"), "omh-first", rows)
    # in buckets that still hold several classes all meet the node with most links: variants of one text are nearer to it than to each other
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    left = _mixed(members.select("key", "node"), classes).join(degree, "node", "left")
    hubs = left.groupBy("key").agg(F.max_by(F.struct("node", "colour"), F.struct(F.coalesce("degree", F.lit(0)), -F.col("node"))).alias("hub"))
    met = left.join(hubs, "key").where(F.col("colour") != F.col("hub.colour"))
    met = written(met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct().join(near, ["a", "b"], "left_anti"), "omh-hubs", rows)
    second = _links(met, seq)
    classes = _grown(classes, second, rows)
    # what is left: pairs of a bucket in different classes
    left = written(_mixed(members.select("key", "node"), classes).join(keyed.select("node", "n", "bits", "keys"), "node"), "omh-left", rows)
    rest = written(_apart(left).join(near.unionByName(met), ["a", "b"], "left_anti"), "omh-rest")
    third = _links(rest, seq)
    classes = _grown(classes, third, rows)
    links = links.unionByName(second).unionByName(third)
    partner = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))
    partner = partner.groupBy("node").agg(F.max_by("other", F.struct("similarity", -F.col("other"))).alias("other"), F.max("similarity").alias("similarity"))
    colours = keyed.select("n1", "n2", "node").join(bearers, ["n1", "n2"], "right").join(classes, F.col("node") == F.col("id"), "left").join(partner, "node", "left")
    lacks = named.where("doc_id is null").select("n1", "n2", F.lit(True).alias("lacks")).distinct()
    # a text without words is its own class
    wordless = F.struct(F.lit(True).alias("x"), F.col("n1").alias("p"), F.col("n2").alias("q"))
    colour = F.when(F.col("node").isNull(), wordless).otherwise(F.struct(F.lit(False).alias("x"), F.coalesce("component", "node").alias("p"), F.lit(0).cast("long").alias("q")))
    coloured = written(colours.join(lacks, ["n1", "n2"], "left").withColumn("colour", colour).select("n1", "n2", "node", "bearer", "other", "similarity", "colour", F.coalesce("lacks", F.lit(False)).alias("lacks")), "omh-colours")
    named_class = coloured.groupBy("colour").agg(F.min("bearer").alias("class_id"), F.max("lacks").alias("lacks"))
    of_partner = coloured.where("node is not null").select(F.col("node").alias("other"), F.col("bearer").alias("linked_doc"))
    lookup = coloured.drop("lacks").join(named_class, "colour").join(of_partner, "other", "left").select(F.col("n1").alias("__n1"), F.col("n2").alias("__n2"), "class_id", "lacks", "linked_doc", "similarity")
    out = base.join(written(lookup, "omh-lookup"), ["__n1", "__n2"])
    keeps = F.when(F.col("lacks"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("class_id"))
    return out.withColumn("kept", keeps).drop("__n1", "__n2", "lacks")
