"""Toxicity: words are bags of hashed character n-grams with embeddings, averaged, under a linear softmax; all trained jointly in numpy.

A text is read in segments of one and of three words, one of each length from each word on, each length with embeddings and a softmax of its own; a segment's vector is
the mean of its words' vectors, a word's the mean of its n-grams' vectors. A text's logit is the mean over the lengths of that of its most toxic segment: a few
insults in a long text count as in a short one, whatever stands beside them. Since the softmax is linear, a trained word is one number a length, so scoring a text is a lookup for each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on at most so many toxic and clean labelled rows, those with the smallest hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
BUCKETS, DIM = 1 << 17, 8
#: Lengths of segments in words, chosen by cross-validation within the training rows of sf0.1.
SEGMENTS = (1, 3)
GRAMS = (3, 4, 5)
#: Words whose numbers a Python worker remembers.
REMEMBERED = 300_000
THRESHOLD = 0.7
#: Weight of a toxic segment in training; they are few.
POSITIVE = 2.0
_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\s")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(text: str, size: int = 500_000) -> Iterator[str]:
    """A long text in parts, cut at white space, so that the words of one part fit in memory."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def word_grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of <word>, and per word the start of its own; each word has its whole as one gram too."""
    if not vocabulary:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in vocabulary).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in vocabulary])
    end = np.cumsum(length)
    owner = np.repeat(np.arange(len(vocabulary)), length)
    multiplier, grams, owners = np.uint64(0x100000001B3), [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, np.uint64(n))
        for j in range(n):
            h = (h ^ code[j : len(code) - n + 1 + j]) * multiplier
        fits = owner[: len(h)] == owner[n - 1 :]
        grams.append(h[fits]), owners.append(owner[: len(h)][fits])
    powers = np.cumsum(code * (np.arange(len(code), dtype=np.uint64) - np.repeat(end - length, length).astype(np.uint64) + np.uint64(1)) * multiplier)
    whole = np.diff(np.concatenate((np.zeros(1, np.uint64), powers[end - 1])))
    grams.append(whole), owners.append(np.arange(len(vocabulary)))
    g, o = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    g = g[order]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((g >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(o[order], np.arange(len(vocabulary) + 1))


class Model:
    """For each length of segments one number per bucket and a bias: embeddings times the difference of the softmax's two columns."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias  # (lengths, BUCKETS) and (lengths,)
        self.known: dict[str, int] = {}  # word: its place in scores
        self.scores = np.zeros((len(weights), REMEMBERED))

    def places(self, text_words: list[str]) -> np.ndarray:
        """The places of a text's words in self.scores."""
        known = self.known
        fresh = [w for w in set(text_words) if w not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set(text_words))
            if len(fresh) > self.scores.shape[1]:
                self.scores = np.zeros((len(self.weights), len(fresh)))
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            grams, limits = word_grams(part)
            first = len(known)
            self.scores[:, first : first + len(part)] = np.add.reduceat(self.weights[:, grams], limits[:-1], axis=1) / np.diff(limits)
            known.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, text_words), np.int64, len(text_words))

    def score(self, text: str | None) -> float:
        """The softmax of the mean, over the lengths of segments, of the worst one; a text without words has the bias alone."""
        widest, worst, held = max(SEGMENTS), np.full(len(self.weights), -np.inf), []
        for part in parts(text or ""):
            held += split_words(part)
            if len(held) >= widest:
                worst = np.maximum(worst, self._worst(held))
                held = held[len(held) - widest + 1 :]  # the next part's first segments begin here
        if held and worst[0] == -np.inf:  # fewer words than the longest segment
            worst = self._worst(held)
        logit = float(((worst if worst[0] > -np.inf else 0.0) + self.bias).mean())
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

    def _worst(self, text_words: list[str]) -> np.ndarray:
        places = self.places(text_words)
        return np.array([segment_means(places, own, size).max() for own, size in zip(self.scores, SEGMENTS, strict=True)])


def segments(n: int, size: int) -> np.ndarray:
    """Where the segments of n words start: at each word that `size` words follow from, so that a phrase scores alike wherever it begins; a shorter text is one segment."""
    return np.arange(max(n - size, 0) + 1)


def segment_means(places: np.ndarray, scores: np.ndarray, size: int, block: int = 1 << 16) -> np.ndarray:
    """The sum of scores over the distinct words of each segment, divided by its length: a word that repeats itself doesn't outweigh the rest. So many segments are held at a time."""
    if size == 1:
        return scores[places]
    starts, means = segments(len(places), size), []
    for at in range(0, len(starts), block):
        rows = np.sort(places[starts[at : at + block, None] + np.arange(min(size, len(places)))], 1)
        own = scores[rows]
        own[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0
        means.append(own.sum(1) / rows.shape[1])
    return np.concatenate(means)


def train(rows: Iterable[tuple[int, str | None, int]], seed: int = 7, rounds: int = 6) -> Model:
    """A model of rows (doc_id, text, label), which are read once and held as numbers of words.

    Fits embeddings and softmax of a length together (AdaGrad). In each round a toxic text teaches by the segment that scores worst so far, a clean one by its worst and by others drawn at random.
    """
    vocabulary: dict[str, int] = {}
    numbered = sorted(((i, int(y > 0), np.array([vocabulary.setdefault(x, len(vocabulary)) for x in split_words(t)], np.int32)) for i, t, y in rows), key=lambda r: (r[0], len(r[2])))
    share = sum(y for _, y, _ in numbered) / len(numbered) if numbered else 0.0
    docs, toxic = [d for _, _, d in numbered if len(d)], np.array([y for _, y, d in numbered if len(d)], np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros((len(SEGMENTS), BUCKETS)), np.full(len(SEGMENTS), np.log((share + 1e-3) / (1 - share + 1e-3))))
    names, parts, limits = list(vocabulary), [], [np.zeros(1, np.int64)]
    del vocabulary, numbered
    for at in range(0, len(names), 10_000):  # a few words at a time: this runs on the driver
        own, ends = word_grams(names[at : at + 10_000])
        parts.append(own.astype(np.int32))
        limits.append(ends[1:] + limits[-1][-1])
    grams, limits = np.concatenate(parts), np.concatenate(limits)
    del names, parts
    fitted = [_fitted(docs, toxic, grams, limits, size, np.random.default_rng(seed), rounds) for size in SEGMENTS]
    return Model(np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def _fitted(docs: list[np.ndarray], toxic: np.ndarray, grams: np.ndarray, limits: np.ndarray, size: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, float]:
    """(a number per bucket, bias) for segments of `size` words; docs hold numbers of words, a word's buckets are grams between its limits."""
    sizes = np.diff(limits)
    E = rng.normal(0, 0.1, (BUCKETS, DIM))
    U, b = np.zeros((DIM, 2)), np.zeros(2)
    U[:, 1] = rng.normal(0, 0.1, DIM)
    gE, gU, gb = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)

    def step(bags: list[np.ndarray], length: np.ndarray, y: np.ndarray, rate: float) -> None:
        nonlocal U, b
        count = np.array([len(x) for x in bags])
        flat = np.concatenate(bags)
        used, place = np.unique(flat, return_inverse=True)
        at = np.concatenate([np.arange(limits[u], limits[u + 1]) for u in used])
        g, s = grams[at], sizes[used]
        word = np.add.reduceat(E[g], np.concatenate(([0], np.cumsum(s)[:-1]))) / s[:, None]
        bag = np.repeat(np.arange(len(bags)), count)
        x = np.add.reduceat(word[place], np.concatenate(([0], np.cumsum(count)[:-1]))) / length[:, None]
        z = x @ U + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d[y == 1] *= POSITIVE
        dx = d @ U.T / length[:, None]
        dword = np.stack([np.bincount(place, dx[bag, j], len(used)) for j in range(DIM)], 1) / s[:, None]
        buckets, where = np.unique(g, return_inverse=True)
        dE = np.stack([np.bincount(where, np.repeat(dword[:, j], s), len(buckets)) for j in range(DIM)], 1)
        dU, db = x.T @ d, d.sum(0)
        gE[buckets] += (dE**2).mean(1)
        gU[:], gb[:] = gU + dU**2, gb + db**2
        E[buckets] -= rate * dE / np.sqrt(gE[buckets])[:, None]
        U = U - rate * dU / np.sqrt(gU)
        b = b - rate * db / np.sqrt(gb)

    def numbers() -> np.ndarray:
        flat = (E @ (U[:, 1] - U[:, 0])).astype(np.float32)
        cuts = range(0, len(sizes), 20_000)
        return np.concatenate([np.add.reduceat(flat[grams[limits[a] : limits[min(a + 20_000, len(sizes))]]], limits[a : min(a + 20_000, len(sizes))] - limits[a]) for a in cuts]) / sizes

    for turn in range(rounds + 1):
        bags, length, y = [], [], []
        now = numbers() if turn else None
        for doc, label in zip(docs, toxic.tolist(), strict=True):
            if turn == 0:  # words of the whole text first: their means say which words go with the label
                some = [doc if len(doc) <= 200 else rng.choice(doc, 200, replace=False)]
            else:
                worst = int(np.argmax(segment_means(doc, now, size)))
                chosen = {worst} if label else {worst, *rng.integers(0, len(segments(len(doc), size)), 2).tolist()}
                some = [doc[i : i + size] for i in sorted(chosen)]
            bags += [np.unique(x) for x in some]
            length += map(len, some)
            y += [label] * len(some)
        y, length = np.array(y), np.array(length)
        for _ in range(2):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 256):
                chosen = order[at : at + 256]
                step([bags[i] for i in chosen], length[chosen], y[chosen], 0.3)
    return E @ (U[:, 1] - U[:, 0]), float(b[1] - b[0])


def training_rows(documents: DataFrame, labels: DataFrame, toxic: int = MAX_TOXIC, clean: int = MAX_CLEAN) -> DataFrame:
    """(doc_id, text, toxic): labelled rows that aren't held out, at most so many toxic and clean ones, by a hash of doc_id; of rows with one doc_id the
    least text. Held out: crc32(doc_id as text) mod 3 is 1."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id")
    fit = known.where("toxic = 1").limit(toxic).unionByName(known.where("toxic = 0").limit(clean))
    found = documents.select("doc_id", "text").join(F.broadcast(fit), "doc_id")  # at most toxic + clean pairs of numbers
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the bounded sample of training_rows; without any usable label it scores by the labels' share alone."""
    return train((r.doc_id, r.text, r.toxic) for r in training_rows(documents, labels).toLocalIterator())


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 from threshold on); columns of these names are replaced.

    Only text decides. Null and empty texts get the score of no words; every row gives one row; whole texts count.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # a number for each of BUCKETS and each length

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(shared.value[0].astype(np.float64), shared.value[1])
        for texts in batches:
            yield pd.Series([held.score(t) for t in texts], dtype="float64")

    return documents.drop("score", "predicted").withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
