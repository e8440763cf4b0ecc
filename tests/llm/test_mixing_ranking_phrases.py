"""Ranked lexical search, collocations and source mixing against plain versions, and on odd tables."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from velspar.llm import collocations, mixing, ranked

# --- mixing ------------------------------------------------------------------------------------------------------


def _quotients(rows, seats):
    """Seats by a heap of exact quotients; equal ones by the order of rows."""
    heap = [(-Fraction(v), i, 1) for i, (v, most) in enumerate(rows) if most]
    heapq.heapify(heap)
    given = [0] * len(rows)
    while seats and heap:
        _, i, k = heapq.heappop(heap)
        given[i] += 1
        seats -= 1
        if given[i] < rows[i][1]:
            heapq.heappush(heap, (-Fraction(rows[i][0], 2 * k + 1), i, k + 1))
    return given


def test_highest_quotients(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g in range(60):
        n = int(rng.integers(1, 30))
        votes = rng.integers(1, 6, n) if g % 2 else rng.integers(1, 10**9, n)
        most = rng.integers(0, 40, n)
        seats = int(rng.integers(0, most.sum() + 5))
        rows += [(g, i, int(v), int(m), seats) for i, (v, m) in enumerate(zip(votes, most, strict=True))]
        want[g] = _quotients([(int(v), int(m)) for v, m in zip(votes, most, strict=True)], seats)
    got = mixing.highest_quotients(spark.createDataFrame(rows, "g int, i int, votes long, most long, seats long"), ["g"], ["i"])
    found = {(r["g"], r["i"]): r["given"] for r in got.collect()}
    assert found == {(g, i): x for g, w in want.items() for i, x in enumerate(w)}


def test_targets_are_water_levels(spark):
    sizes = {"a": 10, "b": 1000, "c": 3000, "d": 5, "e": 0, "f": 800}
    rows = [(n, False, s) for n, s in sizes.items()] + [("", True, 700)]
    got = {(r["__name"], r["__none"]): r["target"] for r in mixing.targets(spark.createDataFrame(rows, "__name string, __none boolean, source_size long")).collect()}
    order = [*((n, False) for n in "abcdef"), ("", True)]
    size = {**{(n, False): s for n, s in sizes.items()}, ("", True): 700}
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    total, full = Fraction(3, 2) * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[x] for x in full)
        share = {x: rest * weight[x] / sum(weight[y] for y in order if y not in full) for x in order if x not in full}
        above = {x for x, s in share.items() if s > 2 * size[x]}
        if not above:
            break
        full |= above
    for x in order:
        assert got[x] == pytest.approx(float(2 * size[x] if x in full else share[x]), rel=1e-12)


def _mix_rows(n=400):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        source = [None, "b", "hot", "hot", "hot", "ä", "zz"][int(rng.integers(0, 7))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 9 else None, source))
    return rows


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize(("leaf", "fan"), [(256, 8), (5, 8), (3, 2)])
def test_mix(spark, leaf, fan):
    docs = spark.createDataFrame(_mix_rows(), SCHEMA)
    one = mixing.mixed(docs.repartition(3), leaf=leaf, fan=fan).toPandas().sort_values("doc_id").reset_index(drop=True)
    two = mixing.mixed(docs.repartition(7, "source"), leaf=leaf, fan=fan).toPandas().sort_values("doc_id").reset_index(drop=True)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert one[names].equals(two[names])
    assert (one["taken"] <= 2 * one["size"]).all()
    assert one["taken"].sum() == round(1.5 * one["size"].sum() / mixing.BLOCK) * mixing.BLOCK
    shards = 2 ** math.ceil(math.log2(200 / leaf + 1) + 1)
    per = one.assign(source=one["source"].fillna("-")).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per["taken"] - per["target"]).abs() <= mixing.BLOCK * shards).all()
    for row in one.itertuples():
        ends = [(x["first"], x["end"]) for x in row.spans]
        assert all(0 <= a < b <= row.size for a, b in ends)
        seen = Counter(w for a, b in ends for w in range(a, b))
        assert max(seen.values(), default=0) <= 2
    if fan == 8:
        documents = docs.toPandas()  # noqa: F841
        want = duckdb.sql(mixing.oracle(leaf=leaf).replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, text, source FROM documents)")).df().sort_values("doc_id").reset_index(drop=True)
        assert (one[names] == want[names]).all().all()


def test_mix_of_odd_rows(spark):
    rows = [(None, "a b", None), (None, "c", None), (1, "a b c", "x"), (1, "a b c", "x"), (1, "other", "x"), (2, None, "x"), (3, "", "y"), (4, "w " * 50_000, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"taken": F.lit("old"), "target": F.lit("old"), "more": F.lit(1)})
    got = mixing.mixed(docs, leaf=2)
    assert got.count() == 8
    assert dict(got.dtypes)["taken"] == "bigint"
    assert got.where("more = 1 and taken <= 2 * size").count() == 8
    assert {r["size"] for r in got.where("doc_id is null").collect()} == {1, 2}
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, "x")], SCHEMA)).first()["taken"] == 0


# --- collocations ------------------------------------------------------------------------------------------------


def _plain_phrases(rows, least, cover, top):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            if len(g) == 2 and any(len(h) == 3 and f >= least and g in (h[:2], h[1:]) and 100 * f >= cover * a for h, f in c.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        n = sum(f for g, f in c.items() if len(g) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def _phrase_rows():
    rng = np.random.default_rng(2)
    words = ["a", "B", "c", "ä", "dd", "e-f", " x", "\U0001f600"]
    ends = [" ", " ", " ", "\t", ". ", "\n", "  "]
    rows = []
    for i in range(160):
        n = int(rng.integers(0, 40))
        text = "".join(words[min(int(rng.geometric(0.4)) - 1, 7)] + ends[int(rng.integers(0, 7))] for _ in range(n))
        rows.append((["de", "en", None, ""][int(rng.integers(0, 4))], None if i % 17 == 0 else text))
    return rows


@pytest.mark.parametrize(("words", "batch", "cover"), [(1 << 20, 10_000, 50), (5, 3, 50), (50, 1, 90)])
def test_phrases(spark, monkeypatch, words, batch, cover):
    rows = _phrase_rows()
    monkeypatch.setattr(collocations, "WORDS", words)
    monkeypatch.setattr(collocations, "SAMPLED", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collocations.phrases(spark.createDataFrame(rows, "lang string, text string"), least=3, cover=cover, top=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == _plain_phrases(rows, 3, cover, 40)


def test_phrases_of_odd_tables(spark):
    schema = "lang string, text string"
    assert collocations.phrases(spark.createDataFrame([], schema)).count() == 0
    assert collocations.phrases(spark.createDataFrame([("en", None), ("en", "... \n"), (None, "")], schema)).count() == 0
    long_ = [("en", "one two three. " * 100_000), *[("en", "one two three")] * 3]
    docs = spark.createDataFrame(long_, schema).withColumns({"phrase": F.lit(1), "score": F.lit(2), "f": F.lit(3)})
    assert [tuple(r) for r in collocations.phrases(docs).collect()] == [("en", 1, "one two three", 100_003, 100_003, 100_003, 300_009, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", "a", None, None, big), ("en", "b", None, None, big + 7), ("en", "a", "b", None, big - 1)], collocations.COUNTS)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "counted", lambda *_: (counts, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
        row = collocations.phrases(spark.createDataFrame([("en", "")], "lang string, text string")).first()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def test_pair_filter_holds_all(spark):
    pairs = spark.createDataFrame([(lang, f"w{i}", f"v{i % 7}") for i in range(500) for lang in ("en", "", " ", "de")], "lang string, w1 string, w2 string")
    slots = collocations.pair_filter(pairs)
    import pyarrow as pa

    h = lambda prefix, n: collocations._hashed(pa.array([f"{prefix}{i % n}" for i in range(500)]))
    assert all(collocations.found(slots, collocations._pairs_hashed(lang, h("w", 500), h("v", 7))).all() for lang in ("en", "", " ", "de"))


# --- ranked search -----------------------------------------------------------------------------------------------


def _terms(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _plain_search(docs, items, k):
    cut = [(d, Counter(_terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c in cut:
            m = 75 + 25 * sum(c.values()) * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _search_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Ähre", "ähre", "_x_y", "İ"]
    say = lambda n: " ".join(words[min(int(rng.geometric(0.06)) - 1, 63)] for _ in range(n))
    docs = [(i, say(int(rng.integers(0, 50)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(40)] + [(None, docs[6][1]), (7, docs[8][1]), (7, docs[8][1]), (400, None), (401, ""), (402, "..."), (403, say(20_000))]
    items = [(i, say(int(rng.integers(1, 12)))) for i in range(30)] + [(30, None), (31, "unheard"), (32, docs[5][1]), (33, "w1 w1 w1 W1")]
    return docs, items


@pytest.mark.parametrize(("block", "group"), [(256, 1024), (7, 50)])
def test_search(spark, monkeypatch, block, group):
    docs, items = _search_rows()
    monkeypatch.setattr(ranked, "ITEMS", block)
    monkeypatch.setattr(ranked, "GROUP", group)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(5)
    got = ranked.search(d, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), k=6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_search(docs, items, 6)


def test_search_of_odd_tables(spark):
    d, i = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (1, "a")], "item_id long, text string")
    assert sorted(tuple(r)[:3] for r in ranked.search(d, i, k=20).collect()) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)]
    assert ranked.search(d.limit(0), i).count() == 0
    assert ranked.search(d, i.limit(0)).count() == 0
    assert ranked.search(d, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    v, sets = 400, 8
    q = np.zeros((32, v))
    for i in range(32):
        q[i, rng.choice(50, 6, replace=False) + 50 * (i % sets)] = 1
    s = ranked.Search(q, np.full(v, 3000), 10_000, 10_000 * 40, 5, np.zeros(32, np.int64))
    best = {"floor": s.floor.copy(), "item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "row": np.zeros(0, np.int64)}
    ids = [np.sort(rng.choice(50, 20, replace=False) + 50 * (i % sets)) for i in range(512)]
    x = s.contributions([40] * 512, ids, [np.ones(20, np.int64)] * 512)
    s.group(x, best, 0, False)
    assert s.visited < s.possible / 3
    every = (q @ x.T).astype(np.int64)
    for i in range(32):
        own = np.sort(best["score"][best["item"] == i])[::-1][:5]
        assert own.tolist() == np.sort(every[i])[::-1][:5].tolist()


def test_sums_beyond_doubles():
    q = np.full((2, 3), 2.0**26)
    s = ranked.Search(q, np.array([20_000, 20_001, 19_999]), 10, 100, 2, np.zeros(2, np.int64))
    assert not s.exact
    x = s.contributions([5, 9], [np.array([0, 2]), np.array([1])], [np.array([1, 2]), np.array([3])])
    best = {"floor": s.floor.copy(), "item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "row": np.zeros(0, np.int64)}
    s.group(x, best, 0, False)
    assert sorted(best["score"][best["item"] == 0].tolist()) == sorted(2**26 * sum(map(int, r)) for r in x)
