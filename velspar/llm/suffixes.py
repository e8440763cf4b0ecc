"""Repeated passages by sparse suffix arrays.

Suffixes start only at minimisers: places whose word-run hash is the least of a window, so that every text that holds a passage
picks the same places in it. Sorted, suffixes with a long common prefix are neighbours. Around its place a suffix is extended to
the left by 0, 1, 2 ... words and to the right by as many as make up a passage; in the order of each such extension equal
passages are neighbours, and comparing these decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.llm.common import mixed, shingles, words, written

#: Passages of LEAST words or more are reported. Of any WINDOW places one is kept, so such a passage holds a kept place that has PREFIX words of it
#: to its right: WINDOW + PREFIX - 1 = LEAST. A place is chosen by the hash of RUN words.
LEAST, WINDOW, RUN = 50, 24, 8
PREFIX = LEAST - WINDOW + 1
#: Words on either side of a prefix that a passage around it can reach; they travel with the suffix, 8 bytes each.
SIDE = WINDOW - 1
#: Sorted suffixes that are compared together: at least BLOCK, unless the partition ends, and WHOLE at most. Where a limit falls
#: inside the suffixes of one prefix, these are compared by a shuffle.
BLOCK, WHOLE = 32_768, 131_072
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Kept places of a text, each with PREFIX words to its right: the last least run hash of each window of WINDOW places."""
    n = len(hashes)
    if n < PREFIX:
        return np.zeros(0, np.int64)
    runs = shingles(hashes, RUN)
    m = len(runs)
    window = min(WINDOW, m)
    views = np.lib.stride_tricks.sliding_window_view(runs, window)
    kept = []
    for at in range(0, len(views), 65536):
        part = views[at : at + 65536]
        kept.append(np.unique(at + np.arange(len(part)) + window - 1 - np.argmin(part[:, ::-1], 1)))
    places = np.unique(np.concatenate(kept))
    return places[places + PREFIX <= n]


def _prefixes(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return shingles(hashes, PREFIX)[places] if len(places) else np.zeros(0, np.uint64)


def _anchors(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            h, _, _, limits = words(part.column("text"))
            keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
                got = _prefixes(h[a:b], minimisers(h[a:b]))
                keys.append(got), rows.append(np.full(len(got), i))
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), part.column("n1").take(rows), part.column("n2").take(rows)], names=["prefix", "n1", "n2"])


def _suffixes(batches: Iterator) -> Iterator:
    """(prefix, right, left, node, place): the repeated suffixes of a text with the hashes of the words after the prefix and, reversed, before the place."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            h, _, _, limits = words(part.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
                own = h[a:b]
                places = minimisers(own)
                keys = _prefixes(own, places).view(np.int64)
                wanted = np.isin(keys, np.array(part.column("prefixes")[i].as_py(), np.int64))
                raw, back = own.astype("<u8").tobytes(), own[::-1].astype("<u8").tobytes()
                node = part.column("node")[i].as_py()
                for key, p in zip(keys[wanted].tolist(), places[wanted].tolist(), strict=True):
                    r, l = 8 * (p + PREFIX), 8 * (len(own) - p)
                    for column, x in zip(out, (key, raw[r : r + 8 * SIDE], back[l : l + 8 * SIDE], node, p), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["prefix", "right", "left", "node", "place"])


def _side(column) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as a matrix of SIDE words a row, and how many each row has."""
    import pyarrow as pa

    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    limits = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, "<u8", limits[-1] // 8) if data is not None and limits[-1] else np.zeros(0, np.uint64)
    first, count = limits[:-1] // 8, np.diff(limits) // 8
    place = np.minimum(first[:, None] + np.arange(SIDE), max(len(flat) - 1, 0))
    out = flat[place] if len(flat) else np.zeros((len(column), SIDE), np.uint64)
    out[np.arange(SIDE)[None, :] >= count[:, None]] = 0
    return out, count


def _reached(words_of: np.ndarray, step: np.uint64) -> np.ndarray:
    """Hashes of the first 0, 1, ... SIDE words of each row."""
    out, power = np.zeros((len(words_of), SIDE + 1), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(SIDE):
            power = power * step
            out[:, j + 1] = out[:, j] + mixed(words_of[:, j] + step) * power
    return out


def extensions(prefix: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(l, rows, 64 bits, 64 bits more): for each number l of words to the left the rows that hold a passage from there on, with its hashes."""
    lefts, rights = [_reached(left, s) for s in (_A, _B)], [_reached(right, s) for s in (_C, _D)]
    own = prefix.astype(np.int64).view(np.uint64)
    for l in range(SIDE + 1):
        rows = np.flatnonzero((n_left >= l) & (n_right >= SIDE - l))
        if len(rows):
            a, b = (mixed(mixed(own[rows] * s + np.uint64(l)) + x[rows, l] * t + y[rows, SIDE - l]) for s, t, x, y in zip((_A, _D), (_B, _C), lefts, rights, strict=True))
            yield l, rows, a, b


COMPARED = "node long, start long, end long, k1 long, k2 long, n long"


def _compared(batches: Iterator) -> Iterator:
    """Of suffixes sorted by prefix: the passages (node, start, end) that stand elsewhere in their block, and (node, start, end, k1, k2, n) of those
    that may stand in another one, because a block's limit falls inside their prefix: n is how often this block has them, node null where that settles it."""
    import pyarrow as pa

    held: list = []
    size = 0
    cut = True  # what came before the first block may go on in it

    def block(table, first_cut: bool, last_cut: bool):
        prefix, node, place = (table.column(c).to_numpy() for c in ("prefix", "node", "place"))
        (right, n_right), (left, n_left) = _side(table.column("right")), _side(table.column("left"))
        outer = np.zeros(len(prefix), bool)
        if first_cut:
            outer |= prefix == prefix[0]
        if last_cut:
            outer |= prefix == prefix[-1]
        low, high = np.full(len(prefix), -1), np.full(len(prefix), -1)
        open_rows: list[tuple] = []
        for l, rows, a, b in extensions(prefix, left, n_left, right, n_right):
            order = np.lexsort((b, a))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])  # neighbours with one passage
            found = np.zeros(len(rows), bool)
            found[order[1:]] |= same
            found[order[:-1]] |= same
            hit = rows[found]
            low[hit] = np.where(low[hit] < 0, l, low[hit])
            high[hit] = l
            begin = np.flatnonzero(np.concatenate(([True], ~same))[: len(order)])
            times = np.diff(np.append(begin, len(order)))
            lead = order[begin]
            some = outer[rows[lead]]
            lead, times = lead[some], times[some]
            if len(lead):
                at = rows[lead]
                open_rows.append((node[at], place[at] - l, a[lead].view(np.int64), b[lead].view(np.int64), times))
        hit = np.flatnonzero(low >= 0)
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(place[hit] - high[hit]), pa.array(place[hit] - low[hit] + LEAST), none, none, none], names=["node", "start", "end", "k1", "k2", "n"])
        for n, start, a, b, times in open_rows:
            settled = times > 1
            yield pa.RecordBatch.from_arrays([pa.array(n, mask=settled), pa.array(start), pa.array(start + LEAST), pa.array(a), pa.array(b), pa.array(times)], names=["node", "start", "end", "k1", "k2", "n"])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(c).to_numpy() for c in ("prefix", "node", "place")], 1)
        fresh = (own != np.concatenate((own[:1] - 1 if before is None else before, own[:-1]))).any(1)  # a repeated row of the table gives its suffixes again
        batch, before = batch.filter(pa.array(fresh)), own[-1:]
        held.append(batch)
        size += batch.num_rows
        while size >= BLOCK:
            table = pa.Table.from_batches(held)
            prefix = table.column("prefix").to_numpy()
            to = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
            inside = to == 0
            if inside and size < WHOLE:
                break
            to = size if inside else to
            yield from block(table.slice(0, to), cut, inside)
            cut = inside
            held, size = table.slice(to).to_batches(), size - to
    if size:
        yield from block(pa.Table.from_batches(held), cut, True)


def repeated_passages(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words): per document the passages, in words from start up to end, that stand elsewhere too.

    Words are split at white space, ASCII capitals folded. A passage is 50 words or more that occur at another place of the same or another
    document; overlapping ones of one document are merged, n_words counts the document's words. All such passages are found, however
    many texts hold one and however the table is partitioned. Equal texts, by 128 bits of their SHA-256, are one node from
    the start; those of 50 words or more that several rows hold are repeated as a whole. Documents without such a
    passage give no row, nor do null, empty and short texts; rows that repeat a doc_id count as documents of their own and
    their equal rows are merged; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    base = documents.select("doc_id", "text", half(1).alias("n1"), half(17).alias("n2"))
    named = base.groupBy("n1", "n2").agg(F.min("doc_id").alias("bearer"), F.count("*").alias("copies"))
    texts = written(named.withColumn("node", F.monotonically_increasing_id()), "suffix-texts")
    anchors = base.select("n1", "n2", "text").mapInArrow(_anchors, "prefix long, n1 long, n2 long")
    # equal texts repeat their places: one (prefix, node) is kept with the number of its places in one text
    places = anchors.groupBy("prefix", "n1", "n2").agg(F.count("*").alias("n")).join(texts.select("n1", "n2", "node", "copies"), ["n1", "n2"]).select("prefix", "node", (F.col("n") / F.col("copies")).alias("n"))
    places = written(places, "suffix-places")
    common = places.groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1").select("prefix")
    wanted = places.join(common, "prefix", "left_semi").groupBy("node").agg(F.collect_list("prefix").alias("prefixes")).join(texts.select("node", "n1", "n2", "bearer"), "node")
    b, w = base.alias("b"), wanted.alias("w")
    chosen = b.join(w, (F.col("b.n1") == F.col("w.n1")) & (F.col("b.n2") == F.col("w.n2")) & F.col("b.doc_id").eqNullSafe(F.col("w.bearer"))).select("w.node", "b.text", "w.prefixes")
    suffixes = written(chosen.mapInArrow(_suffixes, "prefix long, right binary, left binary, node long, place long"), "suffixes")
    # ranges by a few numbers, so that the sample that sets them is small; inside a range the whole suffix orders
    after = F.conv(F.hex(F.substring("right", 1, 8)), 16, -10).cast("long").alias("after")
    sorts = ("prefix", "right", "left", "node", "place")
    ordered = suffixes.select("*", after).repartitionByRange("prefix", "after", "node").sortWithinPartitions(*sorts).select(*sorts)
    compared = written(ordered.mapInArrow(_compared, COMPARED), "suffix-matches")
    crossing = compared.where("k1 is not null")
    again = crossing.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1")
    across = crossing.where("node is not null").join(again, ["k1", "k2"]).select("node", "start", "end")
    matches = compared.where("k1 is null").select("node", "start", "end").unionByName(across)
    whole = texts.where("copies > 1").select("node", F.lit(True).alias("whole"))
    spans = matches.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(a, F.array(x))),
    )
    found = written(spans.withColumn("spans", merged).join(whole, "node", "full").join(texts.select("node", "n1", "n2"), "node").drop("node"), "suffix-spans")
    per_row = base.select("doc_id", "n1", "n2", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).cast("long").alias("n_words"))
    out = per_row.join(found, ["n1", "n2"])
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    shown = F.when(F.col("whole"), F.when(F.col("n_words") >= LEAST, all_of_it)).otherwise(F.col("spans"))
    return out.select("doc_id", F.explode(shown).alias("s"), "n_words").select("doc_id", "s.start", "s.end", "n_words").distinct()
