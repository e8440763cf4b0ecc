"""Near-duplicate vectors: robust-pruned flat graphs on overlapping cluster shards, and range-expanding greedy search.

Vectors of one label split into clusters, recursively, until a shard is small. A shard holds its own vectors and a rim: all those that
can lie within the threshold of one of its own. So each vector meets all its partners in its home shard, and
the search there decides. A shard that clusters don't part, such as a large group of near copies, is compared in pairs of row blocks instead. Each shard builds a flat graph; a vector's lists from all its shards are united; greedy
search starts at the shard's medoid and, once inside the threshold, expands everything in range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velspar.llm.common import components, written

COSINE = 0.93
#: Shards larger than this are split into branches of about this size, by centres fitted on about SAMPLE of their rows, BRANCHES at most at a time.
SHARD, BRANCH, SAMPLE, BRANCHES, DEPTH = 8000, 2000, 8000, 256, 6
#: A split that makes more than SPREAD rows of each, or a branch of more than WIDEST of all rows, parts nothing; rows that one task assigns.
SPREAD, WIDEST, BLOCK = 3, 0.75, 20_000
#: Neighbours kept by pruning, its slack, and the nearest ones that link back to a vector besides, so that none is out of reach; the longest list, and the beam of insertion.
DEGREE, ALPHA, BACK, LONGEST, BUILD = 24, 1.2, 8, 64, 48
#: Queries that step together, and pairs that are verified together: they bound a task's memory whatever it finds.
QUERIES, PAIRS = 256, 16_384
#: The beams of a search, and the queries of a shard whose partners are found by brute force too. If the first beam misses any of
#: them the next is tried; a shard that all beams fail is compared in blocks.
BEAMS, AUDIT = (16, 32, 64), 64


def clean(vectors: DataFrame) -> DataFrame:
    """One row (node, label, unit, copies) per distinct direction-bearing vector of a label, named by its least vec_id; the others link with nothing."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("label is not null and vec_id is not null and embedding is not null").select("vec_id", "label", wide.alias("v"))
    rows = rows.where((F.size("v") > 0) & ~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def _unit(rows) -> np.ndarray:
    x = np.array(rows.tolist() if hasattr(rows, "tolist") else rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        home = np.argmax(x @ c.T - (c**2).sum(1) / 2, 1)
        c = np.array([x[home == j].mean(0) if (home == j).any() else c[j] for j in range(len(c))])
    return np.unique(c, axis=0)


def _fit(rows):
    import pandas as pd

    k = min(BRANCHES, max(2, -(-int(rows["n"].iloc[0]) // BRANCH)))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "centres": [_centres(_unit(rows["v"]), k).tolist()]})


def _assign(rows, fitted):
    """Home and rim rows of a split shard's branches. A partner of x is within r of it; if it lies nearest to centre c and x nearest to h, then
    x is at most r beyond the plane between them: (|x-c|² - |x-h|²) / (2 |c-h|) <= r. x joins all branches that this allows."""
    import pandas as pd

    if not len(rows):
        return pd.DataFrame(columns=["node", "label", "v", "copies", "home", "shard"])
    c = np.array([list(x) for x in fitted["centres"].iloc[0]])
    between = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(2), 1e-30))
    x = _unit(rows["v"])
    d = (c**2).sum(1)[None, :] - 2 * x @ c.T
    near = np.argmin(d, 1)
    beyond = (d - d[np.arange(len(x)), near][:, None]) / (2 * between[near])
    beyond[np.arange(len(x)), near] = -1
    at, branch = np.nonzero(beyond <= float(np.sqrt(2 - 2 * COSINE)) + 1e-9)
    out = rows.iloc[at][["node", "label", "v", "copies", "home", "shard"]].copy()
    out["home"] = out["home"].to_numpy() & (near[at] == branch)
    out["shard"] = [f"{s}.{b}" for s, b in zip(out["shard"], branch, strict=True)]
    return out


SHARDED = "node long, label string, v array<double>, copies long, home boolean, shard string"


def _widths(rows, fitted):
    """Rows that each branch would get from this block."""
    got = _assign(rows, fitted)
    return got.groupby("shard").size().rename("rows").reset_index().rename(columns={"shard": "branch"}).assign(shard=fitted["shard"].iloc[0])[["shard", "branch", "rows"]]


def shards(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """nodes in overlapping shards, and the rows, if any, of shards that are large and that no split parts; each node is at home in one shard."""
    split = nodes.withColumn("home", F.lit(True)).withColumn("shard", F.concat_ws(":", "label", F.size("v")))
    done = dense = None
    for depth in range(DEPTH + 1):
        split = written(split.select("node", F.col("label").cast("string").alias("label"), "v", "copies", "home", "shard"), "shards")
        large = split.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
        if large.isEmpty():
            break
        small = split.join(large.select("shard"), "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        big = split.join(large, "shard")
        if depth == DEPTH:
            dense = big if dense is None else dense.unionByName(big)
            return done, dense
        sample = big.where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE)).cast("long")) == 0)
        centres = sample.select("shard", "v", "n").groupBy("shard").applyInPandas(_fit, "shard string, centres array<array<double>>")
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        parts = centres.join(large, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        parts = written(parts.select("shard", "centres", "block"), "vector-centres")  # both passes need the same ones
        dealt = lambda df: df.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), blocks))
        widths = dealt(big).groupBy("shard", "block").cogroup(parts.groupBy("shard", "block")).applyInPandas(_widths, "shard string, branch string, rows long")
        widths = widths.groupBy("shard", "branch").agg(F.sum("rows").alias("rows")).groupBy("shard").agg(F.sum("rows").alias("all"), F.max("rows").alias("widest"))
        tight = widths.join(large, "shard").where((F.col("all") > SPREAD * F.col("n")) | (F.col("widest") > WIDEST * F.col("n"))).select("shard")
        tight = written(tight, "vector-tight")
        whole = big.join(tight, "shard", "left_semi")
        dense = whole if dense is None else dense.unionByName(whole)
        loose, parts = dealt(big.join(tight, "shard", "left_anti")), parts.join(tight, "shard", "left_anti")
        split = loose.groupBy("shard", "block").cogroup(parts.groupBy("shard", "block")).applyInPandas(_assign, SHARDED)
    return (split if done is None else done.unionByName(split)), dense


def prune(x: np.ndarray, around: int, candidates: np.ndarray, closeness: np.ndarray) -> list[int]:
    """Robust pruning: the nearest candidate stays and drops those that are ALPHA times nearer to it than to the vector itself."""
    order = candidates[np.argsort(-closeness, kind="stable")]
    between = 2 - 2 * (x[order] @ x[order].T)
    away = 2 - 2 * (x[order] @ x[around])
    kept: list[int] = []
    live = np.ones(len(order), bool)
    while len(kept) < DEGREE:
        p = int(np.argmax(live))
        if not live[p]:
            break
        kept.append(int(order[p]))
        live &= ALPHA * ALPHA * between[p] > away
        live[p] = False
    return kept


class Search:
    """Greedy searches of many queries at once over adjacency lists, padded with -1. A query is a place of x; it may start at itself if it is in the graph."""

    def __init__(self, x: np.ndarray, lists: np.ndarray, queries: np.ndarray, start: int, beam: int, inside: bool, least: float = COSINE):
        self.x, self.lists, self.q, self.least = x, lists, queries, least
        rows = np.arange(len(queries))
        self.seen, self.spent = np.zeros((len(queries), len(x)), bool), np.zeros((len(queries), len(x)), bool)
        place = np.stack([queries, np.full(len(queries), start)], 1)
        value = np.stack([np.full(len(queries), 1.0 if inside else -np.inf), np.where(inside & (queries == start), -np.inf, x[queries] @ x[start])], 1)
        self.seen[rows, queries] = self.seen[:, start] = True
        self.hits = [(rows, queries)] if inside else []
        near = np.flatnonzero((value[:, 1] >= least) & (queries != start))
        self.hits.append((near, np.full(len(near), start)))
        self.place, self.value = self._greedy(place, value, beam)

    def _greedy(self, place: np.ndarray, value: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query expands the best open place of its `beam` best until none is open; returns the best places and their closeness."""
        x, q = self.x, self.q
        live = np.arange(len(q))
        while len(live):
            still = np.where(self.spent[live[:, None], place[live]], -np.inf, value[live])
            best = np.argmax(still, 1)
            go = still[np.arange(len(live)), best] > -np.inf
            live, best = live[go], best[go]
            if not len(live):
                break
            chosen = place[live, best]
            self.spent[live, chosen] = True
            near = self.lists[chosen]
            fresh = (near >= 0) & ~self.seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            self.seen[live[r], near[r, c]] = True
            close = np.full(near.shape, -np.inf)
            close[r, c] = np.einsum("ij,ij->i", x[q[live[r]]], x[near[r, c]])
            r, c = np.nonzero(close >= self.least)
            self.hits.append((live[r], near[r, c]))
            both, values = np.concatenate((place[live], np.maximum(near, 0)), 1), np.concatenate((value[live], close), 1)
            top = np.argpartition(-values, beam - 1, axis=1)[:, :beam] if values.shape[1] > beam else np.argsort(-values, axis=1)
            if place.shape[1] != top.shape[1]:
                grown = np.full((len(q), top.shape[1]), -np.inf)
                grown[:, : place.shape[1]] = value
                place, value = np.pad(place, ((0, 0), (0, top.shape[1] - place.shape[1]))), grown
            place[live], value[live] = np.take_along_axis(both, top, 1), np.take_along_axis(values, top, 1)
        return place, value

    def in_range(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the query, place) of all that is in range: what the greedy search met, then what expanding every place in range finds, and so on, in parts."""
        new_q, new_n = (np.concatenate([h[k] for h in self.hits]) for k in (0, 1))
        while len(new_q):
            yield new_q, new_n
            todo = ~self.spent[new_q, new_n]
            new_q, new_n = new_q[todo], new_n[todo]
            self.spent[new_q, new_n] = True
            next_q, next_n = [new_q[:0]], [new_n[:0]]
            for a in range(0, len(new_q), PAIRS):
                near = self.lists[new_n[a : a + PAIRS]]
                owner = np.broadcast_to(new_q[a : a + PAIRS, None], near.shape)
                fresh = (near >= 0) & ~self.seen[owner, near]
                pair = np.unique(owner[fresh] * len(self.x) + near[fresh])
                o, n = pair // len(self.x), pair % len(self.x)
                self.seen[o, n] = True
                inside = np.concatenate([np.einsum("ij,ij->i", self.x[self.q[o[b : b + PAIRS]]], self.x[n[b : b + PAIRS]]) >= self.least for b in range(0, len(o), PAIRS)] or [np.zeros(0, bool)])
                next_q.append(o[inside]), next_n.append(n[inside])
            new_q, new_n = np.concatenate(next_q), np.concatenate(next_n)


def search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, medoid: int, beam: int, least: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the query, place in x) of all that greedy search with range expansion finds in range, in parts of a bounded number of queries."""
    for at in range(0, len(queries), QUERIES):
        q = queries[at : at + QUERIES]
        for rows, places in Search(x, lists, q, medoid, beam, True, least).in_range():
            yield q[rows], places


def padded(lists: list[list[int]]) -> np.ndarray:
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def built(x: np.ndarray, medoid: int) -> list[list[int]]:
    """Adjacency lists of a graph that grows by insertion: a vector is searched for in the graph so far, its neighbours are what the search met, pruned, and link
    back; a list that grows too long is pruned. Insertion goes in an order drawn once, in batches that double, and each batch searches the graph before it."""
    lists: list[list[int]] = [[] for _ in range(len(x))]
    order = np.random.default_rng(1).permutation(len(x))
    order = np.concatenate(([medoid], order[order != medoid]))
    flat = np.full((len(x), LONGEST), -1)
    at = 1
    while at < len(order):
        batch = order[at : at + min(at, QUERIES)]
        found = Search(x, flat, batch, medoid, BUILD, False, 2.0)  # no range: only what lies nearest
        changed = set()
        for i, places, values in zip(batch.tolist(), found.place, found.value, strict=True):
            good = values > -np.inf
            near, close = places[good], values[good]
            lists[i] = prune(x, i, near, close)
            for j in dict.fromkeys([*lists[i], *near[np.argsort(-close, kind="stable")[:BACK]].tolist()]):  # the nearest ones too, so that a vector can be reached
                lists[j].append(i)
                changed.add(j)
        for j in changed:
            if len(lists[j]) > LONGEST:
                own = np.array(list(dict.fromkeys(lists[j])))
                close = x[own] @ x[j]
                lists[j] = list(dict.fromkeys([*prune(x, j, own, close), *own[np.argsort(-close, kind="stable")[:BACK]].tolist()]))
        for j in (*changed, *batch.tolist()):
            flat[j] = -1
            flat[j, : len(lists[j])] = lists[j]
        at += len(batch)
    return lists


def _medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def _graph(rows):
    """Adjacency lists of a shard."""
    import pandas as pd

    rows = rows.sort_values("node")
    x, ids = _unit(rows["v"]), rows["node"].to_numpy()
    return pd.DataFrame({"node": ids, "near": [ids[sorted(set(o))].tolist() for o in built(x, _medoid(x))]})


def united(root: np.ndarray, q: np.ndarray, n: np.ndarray) -> None:
    """Joins the sets of q and n in root, which names each set's least place."""
    while True:
        u, w = root[q], root[n]
        apart = u != w
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(u, w)[apart], np.minimum(u, w)[apart])
        while not np.array_equal(root[root], root):
            root[:] = root[root]


def _found(rows):
    """Per home vector its links and, as stars, what holds the linked vectors together in this shard: what the search finds, then, by a
    product of a group of queries with the shard, what it left out."""
    import pandas as pd

    rows = rows.sort_values("node")
    x, ids, copies, home = _unit(rows["v"]), rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["home"].to_numpy()
    own = []
    for near in rows["near"]:  # of the united lists, what is in this shard
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        own.append(at[ids[at] == near] if len(near) else at)
    lists, medoid = padded(own), _medoid(x)
    asked = np.flatnonzero(home)
    audited = asked[np.unique(np.linspace(0, len(asked) - 1, AUDIT).astype(int))] if len(asked) else asked
    there = sum(int((x @ x[i] >= COSINE).sum()) for i in audited)
    beam = next((b for b in BEAMS if sum(len(q) for q, _ in search(x, lists, audited, medoid, b)) >= there), BEAMS[-1])
    links, root, told = copies - 1, np.arange(len(x)), home.copy()
    for at in range(0, len(asked), QUERIES):
        group = asked[at : at + QUERIES]
        seen = np.zeros((len(group), len(x)), bool)

        def pairs(group=group, seen=seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, n in search(x, lists, group, medoid, beam):
                seen[np.searchsorted(group, q), n] = True
                yield q, n
            missed, n = np.nonzero((x[group] @ x.T >= COSINE - 1e-9) & ~seen)  # what the search left out, so that no link hangs on its recall
            yield group[missed], n

        for qs, ns in pairs():
            for a in range(0, len(qs), PAIRS):
                q, n = qs[a : a + PAIRS], ns[a : a + PAIRS]
                exact = (q != n) & ((x[q] * x[n]).sum(1) >= COSINE)  # verified in doubles
                q, n = q[exact], n[exact]
                links = links + np.bincount(q, copies[n], len(x)).astype(np.int64)
                told[n] = True
                united(root, q, n)
    return pd.DataFrame({"node": ids[told], "n_links": np.where(home, links, 0)[told], "root": ids[root[told]], "home": home[told]})


def _block(rows):
    """_found of the home rows of one block (ask) with the rows of another: a node's links are the sum over the other blocks."""
    import pandas as pd

    asked, other = rows[rows["ask"]], rows[~rows["ask"]]
    if not len(asked) or not len(other):
        return pd.DataFrame({"node": [], "n_links": [], "root": [], "home": []}).astype({"node": "int64", "n_links": "int64", "root": "int64", "home": "bool"})
    x, y, copies = _unit(asked["v"]), _unit(other["v"]), other["copies"].to_numpy()
    ids = np.unique(np.concatenate((asked["node"].to_numpy(), other["node"].to_numpy())))
    at_x, at_y = np.searchsorted(ids, asked["node"].to_numpy()), np.searchsorted(ids, other["node"].to_numpy())
    root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for a in range(0, len(x), 256):
        close = x[a : a + 256] @ y.T
        hit = close >= COSINE
        q, n = np.nonzero(np.abs(close - COSINE) <= 1e-9)
        hit[q, n] = (x[a + q] * y[n]).sum(1) >= COSINE  # the same sum as elsewhere
        own = at_x[a : a + 256, None] == at_y[None, :]
        hit[own] = True
        links[at_x[a : a + 256]] += hit @ copies - own.any(1)
        q, n = np.nonzero(hit)
        united(root, at_x[a + q], at_y[n])
    home = np.isin(np.arange(len(ids)), at_x)
    told = home | (root != np.arange(len(ids)))
    return pd.DataFrame({"node": ids[told], "n_links": links[told], "root": ids[root[told]], "home": home[told]})


def _in_blocks(dense: DataFrame) -> DataFrame:
    """_found of shards of any size: each pair of row blocks is one task."""
    blocks = F.ceil(F.col("n") / SHARD).cast("long")
    rows = dense.select("node", "v", "copies", "home", "shard", F.pmod(F.xxhash64(F.lit(7), "node"), blocks).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("met"))
    asked = rows.where("home").select("shard", F.col("mine").alias("x"), F.col("met").alias("y"), "node", "v", "copies", F.lit(True).alias("ask"))
    other = rows.select("shard", F.col("met").alias("x"), F.col("mine").alias("y"), "node", "v", "copies", F.lit(False).alias("ask"))
    return asked.unionByName(other).groupBy("shard", "x", "y").applyInPandas(_block, FOUND)


FOUND = "node long, n_links long, root long, home boolean"


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) with n_links, component_id and kept.

    Vectors of one label that isn't null and of one length are linked from cosine 0.93 on, in doubles. Equal vectors are one node of the graph and
    count as linked. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows of a
    null label: n_links 0 and a component of their own. component_id is the least vec_id that links reach, kept tells
    whether it is the row's own. Rows with one vec_id count as one vector each for n_links; a null vec_id gets 0, null and
    true; an empty table gives an empty result; columns named n_links, component_id or kept are replaced, others stay.
    """
    base = vectors.drop("n_links", "component_id", "kept")
    nodes = written(clean(base), "vector-nodes")
    placed, dense = shards(nodes)
    placed = written(placed, "vector-shards")
    graph = placed.groupBy("shard").applyInPandas(_graph, "node long, near array<long>")
    lists = written(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")
    found = placed.join(lists, "node").groupBy("shard").applyInPandas(_found, FOUND)
    found = written(found if dense is None else found.unionByName(_in_blocks(dense)), "vector-links")
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    per_node = found.where("home").groupBy("node").agg(F.sum("n_links").alias("n_links")).join(reach, F.col("node") == F.col("id"), "left").select("node", "n_links", F.coalesce("component", "node").alias("component"))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    keyed = base.withColumn("__v", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), wide))
    by_vector = nodes.join(per_node, "node").select(F.col("label").alias("__label"), F.col("v").alias("__key"), F.col("n_links").alias("__n"), F.col("component").alias("__c"))
    out = keyed.join(by_vector, (keyed["label"] == by_vector["__label"]) & (keyed["__v"] == by_vector["__key"]), "left")
    return (
        out.withColumn("n_links", F.coalesce("__n", F.lit(0).cast("long"))).withColumn("component_id", F.coalesce("__c", "vec_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).drop("__v", "__label", "__key", "__n", "__c")
    )
