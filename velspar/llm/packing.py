"""Packing: documents become sequences of a fixed length, in their order, by dynamic programming over cut places."""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame

LENGTH, END = 2048, 1
#: Cost in tokens of cutting a document at the end of a sentence, and elsewhere.
AT_SENTENCE, INSIDE = 1.0, 64.0
#: Full stops of scripts that put no blank after them.
WIDE_STOPS = "。！？｡।؟۔"
#: Tokens that are planned together; what the last sequence of a plan holds is planned anew with what follows.
PLAN = 1 << 17
#: The groups of texts from which a Python worker learns, and the chunks whose ids it remembers.
LEARNT = {1, 2, 3, 4, 6, 8, 12, 16}
REMEMBERED = 20_000
#: Documents that are encoded together.
TOGETHER = 128
#: Fixed value: the pre-token pattern of this kind of vocabulary.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(places: list[int], costs: list[float], most: int = LENGTH, inside: float = INSIDE) -> list[int]:
    """The places, from the first to the last, at which sequences end, with the least sum of padding and costs of cutting.

    places rise from 0; cutting at one has its cost, cutting anywhere between them costs `inside`, not less than at any place. A sequence from i to j costs
    best[i] + most - (places[j] - places[i]), so a queue that is monotone in best[i] + places[i] gives the best i of the window. A cut
    between places pays only where it fills its sequence: moved to the right, any other one leaves as much padding in all. So the queue needs such a
    cut only `most` after a place that stays in it until its window ends, since a place that a later one drops is no better a start for that either.
    Between two places a sequence whose length is a power of two needs no padding: besides the window's best there is one candidate for each power.
    """
    at = np.asarray(places)
    short: dict[int, list[int]] = {}
    for length in (1 << k for k in range(most.bit_length()) if 1 << k < most):
        i = np.searchsorted(at, at - length)
        for j in np.flatnonzero(at[i] == at - length).tolist():
            short.setdefault(j, []).append(int(i[j]))
    best, back, stops = [0.0] * len(places), [0] * len(places), list(places)  # of the places, then of the cuts between them
    queue: deque[tuple[float, int, int]] = deque([(float(places[0]), places[0], 0)])
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - most:
            _, q, i = queue.popleft()
            value, q = best[i] + inside, q + most
            best.append(value), back.append(i), stops.append(q)
            key = value + q
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, q, len(best) - 1))
        key, _, back[j] = queue[0]
        value = key + most - p
        for i in short.get(j, ()):
            if best[i] < value:
                value, back[j] = best[i], i
        best[j] = value = value + costs[j]
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(places) - 1
    while j:
        out.append(stops[j])
        j = back[j]
    return out[::-1]


class Encoder:
    """Ids of a byte-level BPE file of `tokenizers`, for many texts at a time.

    Between two characters that aren't white space a single blank begins a new pre-token, so the chunks between such
    blanks can be encoded apart. The ids of the most frequent chunks of the first texts are remembered in a table small
    enough for a processor's cache; all other chunks of a group of texts go to the encoder as one string, and both kinds are put
    together by position. The encoder is tiktoken with the file's own vocabulary, which is faster and gives the same ids (a probe at the
    start makes sure, else `tokenizers` does it). Texts with other runs of white space are encoded whole by `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.known: dict[str, int] = {}
        self.seen: Counter[str] = Counter()
        self.groups = 0
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = {bytes(chars[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special and all(c in chars for c in t)}
        size = self.tokenizer.get_vocab_size() + 1
        self.opens, self.closes = np.zeros(size, bool), np.zeros(size, bool)  # tokens that begin with white space or a blank, end a sentence
        self.blank, self.breaks = np.zeros(size, bool), np.zeros(size, bool)  # tokens that begin with a blank; after which a cut is a sentence's end whatever follows
        for t, i in vocabulary.items():
            last = t.rstrip(b"\"')]")[-1:]
            self.blank[i], self.opens[i], self.closes[i] = t[:1] == b" ", t[:1].isspace(), last != b"" and last in b".!?"
            self.breaks[i] = t.endswith((b"\n", *(x.encode() for x in WIDE_STOPS)))
        self.fast = self._fast(vocabulary)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _fast(self, vocabulary: dict[bytes, int]):
        import tiktoken

        probe = "It's a Probe, of 1234 words: naïve été größer\n\tdon't <|endoftext|> 你好 x_y!?"
        try:
            same = tiktoken.Encoding("same", pat_str=PRETOKENS, mergeable_ranks=vocabulary, special_tokens={})
            found = lambda text: np.array(same.encode_ordinary(text), "<u4")
            return found if np.array_equal(found(probe), self._whole(probe)) else self._whole
        except (KeyError, ValueError):
            return self._whole

    def _learn(self, chunks: list[str]) -> None:
        """Remembers the ids, after a blank, of the chunks that occur most in the groups so far."""
        self.seen.update(chunks)
        good = {c: n for c, n in self.seen.items() if n > 2 and c and not c[0].isspace() and not c[-1].isspace()}
        top = sorted(good, key=good.get, reverse=True)[:REMEMBERED]
        ids = [self.fast(" " + c) for c in top]
        self.known = dict(zip(top, range(len(top)), strict=True))
        self.sizes = np.array([len(i) for i in ids], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.concatenate(ids) if ids else np.zeros(0, "<u4")

    def _group(self, firsts: list[str], rests: list[list[str]]) -> list[np.ndarray] | None:
        """The ids of texts cut at blanks; None if a chunk is empty or has white space at an end."""
        chunks = list(chain.from_iterable(rests))
        self.groups += 1
        if self.groups in LEARNT:
            self._learn(chunks)
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        hit = at >= 0
        miss = np.flatnonzero(~hit)
        sizes = np.zeros(len(chunks), np.int64)
        sizes[hit] = self.sizes[at[hit]]
        fresh = np.zeros(0, "<u4")
        if len(miss):
            new = [chunks[i] for i in miss.tolist()]
            if any(not c or c[0].isspace() or c[-1].isspace() for c in new):
                return None
            fresh = self.fast(" " + " ".join(new))
            begins = np.flatnonzero(self.blank[fresh])  # each chunk begins with the only token that begins with a blank
            sizes[miss] = np.diff(np.append(begins, len(fresh)))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        for where, source, first in ((np.flatnonzero(hit), self.table, self.starts[at[hit]]), (miss, fresh, np.cumsum(sizes[miss]) - sizes[miss])):
            n = sizes[where]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(begins[where], n) + inner] = source[np.repeat(first, n) + inner]
        limits = np.concatenate(([0], np.cumsum([len(r) for r in rests])))
        edge = np.concatenate(([0], ends))[limits]
        return [np.concatenate((self.fast(f), ids[a:b])) for f, a, b in zip(firsts, edge[:-1], edge[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, places after which a sentence ends) of each text."""
        cut = [t.split(" ") for t in texts]
        firsts, rests = [c[0] for c in cut], [c[1:] for c in cut]
        plain = [bool(f) and not f[-1].isspace() for f in firsts]
        found = self._group(firsts, rests) if all(plain) else None
        out = []
        for i, text in enumerate(texts):
            if found:
                ids = found[i]
            else:  # some text of the group is odd: one by one
                own = self._group(firsts[i : i + 1], rests[i : i + 1]) if plain[i] else None
                ids = own[0] if own else self._whole(text)
            ends = self.closes[ids]
            ends[:-1] &= self.opens[ids[1:]]
            ends |= self.breaks[ids]
            out.append((ids, np.flatnonzero(ends) + 1))
        return out


def plan(documents: list[tuple[int, np.ndarray]], most: int = LENGTH) -> list[int]:
    """Where sequences end, in tokens from the first one, for documents (tokens, sentence ends): at ends of documents or sentences, elsewhere where a sequence is full."""
    ends = np.cumsum([n for n, _ in documents])
    inner = np.concatenate([s[(s > 0) & (s < n)] + e - n for (n, s), e in zip(documents, ends, strict=True)])
    places = np.union1d(inner, ends).astype(np.int64)
    costs = np.where(np.isin(places, ends), 0.0, AT_SENTENCE)
    return cuts([0, *places.tolist()], [0.0, *costs.tolist()], most)


def pack(documents: DataFrame, path: str, most: int = LENGTH, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset; with ids=True
    also the ids.

    A document's ids are those of the `tokenizers` file at path, without special tokens, then END; each lies in
    exactly one piece. Pieces of a sequence stand gapless from offset 0. Documents keep the order in which a task reads
    them, and each task packs its own rows as they come, so no text is shuffled and a task holds about PLAN
    tokens and one document. sequence_id is the task's partition and a count; a task that runs again gives the same rows.
    Null and empty texts have END alone; a null doc_id stays null; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if ids else []

    def packed(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encoder = _encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int, np.ndarray, np.ndarray]] = []  # (doc_id, ids, sentence ends)
        skip = tokens = 0  # ids of the first held document that are out already

        def out(last: bool) -> Iterator:
            nonlocal held, skip, tokens, sequence
            ends = plan([(len(i) - skip * (not k), s - skip * (not k)) for k, (_, i, s) in enumerate(held)], most)
            if not last:
                ends = ends[:-1]  # the last sequence may still grow
            rows: list[list] = [[] for _ in fields]
            begun = at = doc = 0
            start = skip
            for end in ends:
                while at < end:
                    doc_id, all_ids, _ = held[doc]
                    size = min(end - at, len(all_ids) - start)
                    piece = all_ids[start : start + size]
                    row = [doc_id, start, size, zlib.crc32(piece.tobytes()), len(all_ids), sequence, at - begun]
                    for column, x in zip(rows, row + [piece.astype(np.int64).tolist()] * ids, strict=True):
                        column.append(x)
                    at, start = at + size, start + size
                    if start == len(all_ids):
                        doc, start = doc + 1, 0
                begun, sequence = end, sequence + 1
            held, skip, tokens = held[doc:], start, tokens - at
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(doc_ids), TOGETHER):
                texts = [t or "" for t in batch.column("text").slice(at, TOGETHER).to_pylist()]
                for doc_id, (got, stops) in zip(doc_ids[at : at + TOGETHER], encoder.encode(texts), strict=True):
                    held.append((doc_id, np.append(got, np.uint32(END)).astype("<u4"), stops))
                    tokens += len(got) + 1
                    if tokens >= PLAN:
                        yield from out(False)
        if held:
            yield from out(True)

    return documents.select("doc_id", "text").mapInArrow(packed, SCHEMA + (", ids array<long>" if ids else ""))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
