"""SentencePiece encoding and decoding: the n best segmentations of a text, and back.

The file of the model is read as a lattice of scored pieces: a segmentation scores the sum of its pieces' scores. The
file is a BPE model, whose own scores say only which merge comes first; their sum prefers no sensible path. A piece scores here by the merges that make it: a
merge counts the more, the earlier it was learnt, so that a path that does the early merges beats one that does many late ones, as the model's own
encoding does. A forward Viterbi pass gives the best score of reaching each place; with it as an exact heuristic, a backward A* search
from the end finds complete segmentations in falling order. The mark of a blank stands only at the start of a piece, so
every segmentation is cut before it and a text falls into chunks; the n best of their combinations are the n best of
the text. A chunk's best and the loss of its second best come from Viterbi passes over many chunks at a time; the
search runs on the n - 1 chunks of a text that lose least, since no other can change among its n best.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

SPACE = "▁"
#: Chunks whose segmentations a Python worker remembers, and their greatest length in the vectorised pass.
REMEMBERED, WIDE = 500_000, 40
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Texts that are encoded together.
TOGETHER = 256
SCHEMA = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded_sha256 string"

Best = list[tuple[float, bytes]]  # (score, little-endian 32-bit ids), best first; ties by the ids from the last to the first, smaller ones first


def combine(slots: list[Best], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n best choices of one entry per slot, as (loss against all firsts, ((slot, entry), ...) of those that aren't first).

    A choice among the n best changes only slots among the n - 1 whose second entries lose least, so the search keeps those.
    """
    open_slots = heapq.nsmallest(n - 1, ((s[0][0] - s[1][0], i) for i, s in enumerate(slots) if len(s) > 1))
    found: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for _, i in open_slots:
        grown = [(loss + slots[i][0][0] - slots[i][e][0], (*chosen, (i, e)) if e else chosen) for loss, chosen in found for e in range(len(slots[i]))]
        found = heapq.nsmallest(n, grown)
    return found


def chained(ids: tuple | None) -> list[int]:
    """The ids of a chain (ids, rest of the chain)."""
    out: list[int] = []
    while ids is not None:
        out += ids[0]
        ids = ids[1]
    return out


def joined(parts: list[Best], n: int) -> Best:
    """The n best of the parts one after another, from the last part on: of equal scores the order of what follows decides, then the part's own."""
    best: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]  # score, order of the ids among these, chain of ids
    for part in reversed(parts):
        own = sorted(range(len(part)), key=lambda i: np.frombuffer(part[i][1], "<u4")[::-1].tolist())
        order = {i: place for place, i in enumerate(own)}
        grown = sorted((-score - part[i][0], place, order[i], i, ids) for score, place, ids in best for i in order)[:n] if len(part) > 1 else [(-score - part[0][0], place, 0, 0, ids) for score, place, ids in best]
        places = {x: k for k, x in enumerate(sorted((x[1], x[2]) for x in grown))}
        best = [(-loss, places[place, of], ((part[i][1],), ids)) for loss, place, of, i, ids in grown]
    return [(score, b"".join(chained(ids))) for score, _, ids in best]


#: Weight of the merge of rank r: (1 + r / EARLY) ** -FALL in units of 1 / UNIT, 1 at least: whole numbers, so that sums over a chunk are exact.
EARLY, FALL, UNIT = 3.0, 3.0, float(1 << 40)


def merge_scores(ranks: dict[str, int]) -> dict[str, float]:
    """The summed weights of the merges that make each piece out of characters; a character, or what no merges make, scores 0."""
    out = {}
    for piece in ranks:
        parts, total = list(piece), 0.0
        while len(parts) > 1:
            rank = i = None
            for j in range(len(parts) - 1):
                r = ranks.get(parts[j] + parts[j + 1])
                if r is not None and (rank is None or r < rank):
                    rank, i = r, j
            if rank is None:
                break
            total += max(1.0, UNIT * (1 + rank / EARLY) ** -FALL // 1)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out[piece] = total if len(parts) == 1 else 0.0
    return out


class Pieces:
    """The pieces of a SentencePiece file, their scores and bytes."""

    def __init__(self, path: str, n: int = 3):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.n, size = n, model.get_piece_size()
        self.bytes_of, self.byte_ids, self.vocabulary = [b""] * size, [0] * 256, {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i):
                self.vocabulary[piece] = (i, model.get_score(i))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        scores = merge_scores({p: int(-s) for p, (_, s) in self.vocabulary.items()})
        self.vocabulary = {p: (i, scores[p]) for p, (i, _) in self.vocabulary.items()}
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_counts = np.array([len(b) for b in self.bytes_of])
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        self.longest = max(map(len, self.vocabulary))
        self.unknown = -UNIT  # a character that no piece holds, as bytes
        self.vocabulary |= {chr(b): (self.byte_ids[b], self.unknown) for b in range(128) if chr(b) not in self.vocabulary}
        self.together = {p[i : i + 2] for p in self.vocabulary for i in range(len(p) - 1)}
        self.prefixes = {p[:i] for p in self.vocabulary for i in range(1, len(p))}
        self.searched: dict[str, Best] = {}
        self.known: dict[str, int] = {}  # chunk: its place in the lists of best score, its ids, loss of the second best
        self.best_score, self.best_ids, self.best_loss, self.best_size = array("d"), [], array("d"), array("q")
        hashes = np.zeros(len(self.vocabulary), np.uint64)
        for i, p in enumerate(self.vocabulary):
            h = 0
            for c in p:
                h = (h * int(_STEP) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        order = np.argsort(hashes)
        assert len(np.unique(hashes)) == len(hashes)
        own = list(self.vocabulary.values())
        self.sorted_hashes = hashes[order]
        self.sorted_ids = np.array([own[i][0] for i in order] + [0], "<u4")
        self.sorted_scores = np.array([own[i][1] for i in order] + [-np.inf])
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.sorted_hashes * _SPREAD) >> np.uint64(46)] = True

    def search(self, text: str) -> Best:
        """The n best segmentations of a text: Viterbi forward, A* backward."""
        size = len(text)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # arcs (start, score, ids) by their end
        reach = [0.0] + [-np.inf] * size
        vocabulary = self.vocabulary
        for start in range(size):
            known = False
            base = reach[start]
            for end in range(start + 1, min(size, start + self.longest) + 1):
                piece = text[start:end]
                got = vocabulary.get(piece)
                if got is None:
                    if piece not in self.prefixes:
                        break
                else:
                    known = known or end == start + 1
                    into[end].append((start, got[1], (got[0],)))
                    if base + got[1] > reach[end]:
                        reach[end] = base + got[1]
            if not known:
                ids = tuple(self.byte_ids[b] for b in text[start].encode())
                into[start + 1].append((start, self.unknown, ids))
                reach[start + 1] = max(reach[start + 1], base + self.unknown)
        out: Best = []
        # (place, what follows, ids that follow as a chain) by what Viterbi reaches there plus what follows; scores are whole numbers, so equal sums are equal
        open_at: dict[float, list[tuple[int, float, tuple | None]]] = {reach[size]: [(size, 0.0, None)]}
        heap = [-reach[size]]
        while heap:
            worth = -heapq.heappop(heap)
            # nothing joins this class from a better one any more; its least member's children of the same worth come before all others
            stack = open_at.pop(worth)
            if len(stack) > 1:
                stack.sort(key=lambda x: chained(x[2])[::-1], reverse=True)
            while stack:
                at, after, ids = stack.pop()
                if at == 0:
                    out.append((worth, np.array(chained(ids), "<u4").tobytes()))
                    if len(out) == self.n:
                        return out
                    continue
                same = []
                for start, score, own in into[at]:
                    reached = reach[start] + score + after
                    item = (start, score + after, (own, ids))
                    if reached == worth:
                        same.append(item)
                    elif reached in open_at:
                        open_at[reached].append(item)
                    else:
                        open_at[reached] = [item]
                        heapq.heappush(heap, -reached)
                if len(same) > 1:
                    same.sort(key=lambda x: x[2][0][::-1], reverse=True)
                stack += same
        return out

    def n_best(self, chunk: str) -> Best:
        """The n best of a chunk, by A*; long ones are cut where no piece reaches over, and their parts' n best combined."""
        got = self.searched.get(chunk)
        if got is None:
            cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.together), len(chunk)] if len(chunk) > WIDE else [0, len(chunk)]
            parts = [self.search(chunk[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            got = joined(parts, self.n)
            if len(self.searched) >= REMEMBERED:
                self.searched.clear()
            self.searched[chunk] = got
        return got

    def _remember(self, chunk: str, score: float, ids: bytes, loss: float) -> None:
        self.known[chunk] = len(self.best_ids)
        self.best_score.append(score), self.best_ids.append(ids), self.best_loss.append(loss), self.best_size.append(len(ids))

    def _forget(self) -> None:
        self.known, self.best_score, self.best_ids, self.best_loss, self.best_size = {}, array("d"), [], array("d"), array("q")

    def _learn(self, chunks: list[str]) -> None:
        """Remembers (best score, its ids, loss of the second best) of new chunks."""
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c) if len(c) <= WIDE else 0, []).append(c)
        slow = by_length.pop(0, [])
        for length, same in by_length.items():
            for at in range(0, len(same), 1024):  # arrays of this size stay in the processor's cache
                slow += self._viterbi(same[at : at + 1024], length)
        for c in slow:
            best = self.n_best(c)
            self._remember(c, best[0][0], best[0][1], best[0][0] - best[1][0] if len(best) > 1 else np.inf)

    def _viterbi(self, chunks: list[str], length: int) -> list[str]:
        """Forward and backward Viterbi for many chunks of one length at once; returns those with ties or unknown characters, which need the search.

        The second best takes some arc that the best doesn't, so it scores the most that any such arc allows.
        """
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(len(chunks), length).astype(np.uint64)
        reach = np.full((len(chunks), length + 1), -np.inf)
        reach[:, 0] = 0
        arcs, h = {}, np.zeros((len(chunks), length + 1), np.uint64)  # length of a piece: (scores, ids) by chunk and start, for lengths that occur
        for n in range(1, min(length, self.longest) + 1):
            h = h[:, : length - n + 1] * _STEP + code[:, n - 1 :]
            found = self._found(h)
            if found is not None:
                arcs[n] = found
        if 1 not in arcs:
            return chunks
        for end in range(1, length + 1):
            for n, (score, _) in arcs.items():
                if n <= end:
                    np.maximum(reach[:, end], reach[:, end - n] + score[:, end - n], out=reach[:, end])
        after = np.full((len(chunks), length + 1), -np.inf)
        after[:, length] = 0
        for start in range(length - 1, -1, -1):
            for n, (score, _) in arcs.items():
                if n <= length - start:
                    np.maximum(after[:, start], score[:, start] + after[:, start + n], out=after[:, start])
        best = reach[:, length]
        rows, at = np.arange(len(chunks)), np.full(len(chunks), length)
        found, count = np.zeros((len(chunks), length), "<u4"), np.zeros(len(chunks), np.int64)
        through = {n: reach[:, : length - n + 1] + score + after[:, n:] for n, (score, _) in arcs.items()}
        whole = (arcs[1][0] > -np.inf).all(1)
        live = rows[whole]
        while len(live):
            rest = live
            for size, (score, ids) in arcs.items():  # the arc that reaches this place with its best score
                if not len(rest):
                    break
                start = at[rest] - size
                fits = start >= 0
                fits[fits] = reach[rest[fits], start[fits]] + score[rest[fits], start[fits]] == reach[rest[fits], at[rest[fits]]]
                r, s = rest[fits], start[fits]
                found[r, length - 1 - count[r]] = ids[r, s]
                through[size][r, s] = -np.inf
                rest = rest[~fits]
                at[r] = -1 - s
            count[live] += 1
            at[live] = -1 - at[live]
            assert not len(rest)
            live = live[at[live] > 0]
        second = np.max([t.max(1) for t in through.values()], 0)
        with np.errstate(invalid="ignore"):
            loss = best - second
        good = whole & (loss > 0)
        kept, raw = np.flatnonzero(good), found.tobytes()
        self.known.update(zip([chunks[i] for i in kept.tolist()], range(len(self.best_ids), len(self.best_ids) + len(kept)), strict=True))
        ends = (4 * length * (kept + 1)).tolist()
        sizes = 4 * count[kept]
        self.best_ids += [raw[end - size : end] for end, size in zip(ends, sizes.tolist(), strict=True)]
        self.best_score.frombytes(best[kept].tobytes()), self.best_loss.frombytes(loss[kept].tobytes()), self.best_size.frombytes(sizes.tobytes())
        return [chunks[i] for i in np.flatnonzero(~good).tolist()]

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The scores (minus infinity where there is no piece) and ids of the pieces of these hashes; None if none is a piece's."""
        maybe = np.flatnonzero(self.filter[(h * _SPREAD) >> np.uint64(46)])
        some = h.ravel()[maybe]
        place = np.minimum(np.searchsorted(self.sorted_hashes, some), len(self.sorted_hashes) - 1)
        same = self.sorted_hashes[place] == some
        if not same.any():
            return None
        at, place = maybe[same], place[same]
        score, ids = np.full(h.shape, -np.inf), np.zeros(h.shape, "<u4")
        score.ravel()[at], ids.ravel()[at] = self.sorted_scores[place], self.sorted_ids[place]
        return score, ids

    def slots(self, text: str) -> list[str]:
        """The chunks of a text: line feeds, which no longer piece holds, and runs of blanks with what follows them; as the model's files do it, one blank goes before the text and blanks are written as a mark."""
        out: list[str] = []
        for i, line in enumerate((" " + text).split("\n")):
            if i:
                out.append("\n")
            first, *cut = line.split(" ")
            if first:
                out.append(first)
            if "" not in cut:
                out += [SPACE + c for c in cut]
                continue
            run = SPACE
            for c in cut[:-1]:
                if c:
                    out.append(run + c)
                    run = SPACE
                else:
                    run += SPACE
            out.append(run + cut[-1])
        return out

    def encode(self, texts: list[str | None]) -> list[Best]:
        """The n best segmentations of each text; ties by the ids from the last on within a chunk, else by the place of the chunk that changes."""
        cut = [self.slots(t) if t else [] for t in texts]
        new = [c for c in set(chain.from_iterable(cut)) if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(set(chain.from_iterable(cut)))
        self._learn(new)
        known = self.known
        scores, all_losses, ids_of = np.array(self.best_score), np.array(self.best_loss), self.best_ids
        sizes = np.array(self.best_size)  # bytes of the ids
        out = []
        for slots in cut:
            at = list(map(known.__getitem__, slots))
            total, losses = (float(scores[at].sum()), all_losses[at]) if at else (0.0, np.zeros(0))
            first = b"".join([ids_of[i] for i in at])
            few = range(len(slots)) if len(slots) < self.n else np.sort(np.argsort(losses, kind="stable")[: self.n - 1]).tolist()
            few = [i for i in few if losses[i] < np.inf]
            ends = np.cumsum(sizes[at]).tolist() if few else []
            mine: Best = []
            for loss, chosen in combine([self.n_best(slots[i]) for i in few], self.n):
                parts, done = [], 0
                for i, e in sorted(chosen):
                    begin = ends[few[i] - 1] if few[i] else 0
                    parts += [first[done:begin], self.n_best(slots[few[i]])[e][1]]
                    done = ends[few[i]]
                mine.append((total - loss, b"".join([*parts, first[done:]]) if chosen else first))
            out.append(mine)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank that encoding puts before it goes."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.byte_counts[found]
        place = np.arange(int(n.sum())) + np.repeat(self.byte_starts[found] - (np.cumsum(n) - n), n)
        found = self.all_bytes[place].tobytes()
        return found[found[:1] == b" " :].decode("utf-8", "replace")


_HELD: dict[tuple[str, int], Pieces] = {}


def _held(path: str, n: int) -> Pieces:
    if (path, n) not in _HELD:
        _HELD[path, n] = Pieces(path, n)
    return _HELD[path, n]


def encode(documents: DataFrame, path: str, n: int = 3, ids: bool = False) -> DataFrame:
    """Per document and rank (from 1, at most n): doc_id, score, n_pieces, ids_crc32, decoded_sha256 and, with ids=True, the ids.

    Whole texts are segmented; ties of scores within a chunk go by its ids from the last to the first, smaller ones first, those between chunks by the place of the chunk that changes. decoded_sha256 is that of the text that
    the ids give back. Null and empty texts have one segmentation of no pieces; texts with fewer than n
    segmentations have fewer rows; a null doc_id stays null; repeated rows give repeated results; an empty table gives
    none; other columns are ignored. Each row is worked on where it is read; nothing is shuffled.
    """
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int64()))] if ids else []

    def encoded(batches: Iterator) -> Iterator:
        gc.disable()  # this worker makes no cycles, and its many small lists are looked through again and again otherwise
        held = _held(path, n)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows: list[list] = [[] for _ in fields]
                found = held.encode(batch.column("text").slice(at, TOGETHER).to_pylist())
                for doc_id, best in zip(batch.column("doc_id").slice(at, TOGETHER).to_pylist(), found, strict=True):
                    for rank, (score, own) in enumerate(best, 1):
                        row = [doc_id, rank, score, len(own) // 4, zlib.crc32(own), hashlib.sha256(held.decode(own).encode()).hexdigest()]
                        for column, x in zip(rows, row + [np.frombuffer(own, "<u4").tolist()] * ids, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True)], names=[f for f, _ in fields])

    return documents.select("doc_id", "text").mapInArrow(encoded, SCHEMA + (", ids array<long>" if ids else ""))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with text, decoded from an array of ids; null ids give a null text, ids outside the vocabulary an error. A column text is replaced."""
    import pandas as pd
    from pyspark.sql import functions as F

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = _held(path, 1)
        for batch in batches:
            yield pd.Series([None if x is None else held.decode(np.array(x, "<u4").tobytes()) for x in batch], dtype=object)

    decoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("text", F.pandas_udf(decoded, "string")(F.col(ids)))
