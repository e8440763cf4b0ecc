"""Mixing of sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

A mix is made of blocks of equally many words. Sources get blocks by highest quotients weight / (2 k - 1); those of a source go in the same way
to its shards, whose quotients come from their words. A shard lays its documents end to end in a seeded order, twice, and
cuts this line into blocks; as many as its quota says are selected, in a seeded order, those of the first round before those of the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velspar.llm.common import written

#: Words of a block; a shard of a source has about LEAF documents, and a node of the tree of shards 2^FAN children at most.
BLOCK, LEAF, FAN = 16, 256, 8
#: Bits of a document's place in the seeded order.
BITS = 60
#: Primes beyond any number of blocks of a shard; one of them is the step of its seeded order.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
#: Steps of the bisection and its relative width at the end, above the rounding of doubles.
STEPS, WIDTH = 100, 2.0**-42


def seeded(key: Column, seed: int) -> Column:
    """BITS bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, BITS // 4), 16, 10).cast("long")


def highest_quotients(rows: DataFrame, over: list[str], order: list[str]) -> DataFrame:
    """rows (*over, *order, votes, most, seats) with `given`: the seats of each group of `over` go to its rows by highest quotients votes / (2 k - 1).

    A row gets `most` seats at most; equal quotients go by `order`. votes are positive where most is. The threshold comes from a
    bisection over the group's rows, which lie in one array; the few seats whose quotients it can't part from each other are ranked.
    """
    child = F.struct(*order, "votes", "most")
    groups = rows.groupBy(*over).agg(F.sort_array(F.collect_list(child)).alias("c"), F.first("seats").alias("q"), F.sum("most").alias("room"), F.min(F.when(F.col("most") > 0, F.col("votes"))).alias("small"), F.sum(F.when(F.col("most") > 0, F.col("votes"))).alias("all"))
    held = lambda x, mu: F.least(x["most"], F.floor((x["votes"] * mu + 1) / 2))
    total = lambda mu: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + held(x, mu))
    start = F.struct(
        F.greatest(F.lit(0.0), (2 * F.col("q") - 2 * F.size("c")) / F.coalesce("all", F.lit(1)).cast("double")).alias("lo"),
        ((2 * F.col("q") + 3) / F.coalesce("small", F.lit(1)).cast("double")).alias("hi"),
    )
    mid = lambda s: (s["lo"] + s["hi"]) / 2
    halved = lambda s: F.when(total(mid(s)) > F.col("q"), F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))).otherwise(F.struct(mid(s).alias("lo"), s["hi"].alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: F.when(s["hi"] - s["lo"] <= s["hi"] * WIDTH, s).otherwise(halved(s)))
    full = F.col("q") >= F.col("room")
    each = groups.withColumn("m", F.when(~full, found)).select(*over, F.least("q", "room").alias("q"), "m", F.posexplode("c").alias("at", "x")).select(
        *over, "q", "at", *[F.col(f"x.{c}").alias(c) for c in order],
        F.when(F.col("m").isNull(), F.col("x.most")).otherwise(held(F.col("x"), F.col("m.lo"))).cast("long").alias("sure"),
        F.when(F.col("m").isNull(), F.col("x.most")).otherwise(held(F.col("x"), F.col("m.hi"))).cast("long").alias("upto"),
        F.col("x.votes").alias("votes"),
    )
    own = Window.partitionBy(*over)
    more = F.when(F.col("upto") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("upto")))
    open_ = each.withColumn("left", F.col("q") - F.sum("sure").over(own)).withColumn("k", F.explode_outer(more))
    ranked = open_.withColumn("r", F.row_number().over(own.orderBy((F.col("votes") / (2 * F.col("k") - 1)).desc_nulls_last(), "at", "k")))
    return ranked.groupBy(*over, "at", *order).agg((F.first("sure") + F.count_if(F.col("k").isNotNull() & (F.col("r") <= F.col("left")))).alias("given")).drop("at")


def targets(sources: DataFrame, percent: int = 150, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sources (__name, __none, source_size, ...) with weight and target, double: their share of `percent` of all words by weight, 2 times their own at most.

    Weights repeat in the order of names, null last. What a source can't take is shared again by weight: in the order of 2 size /
    weight those before the first that stays below its bound are full. One row per source passes one task here.
    """
    line = Window.orderBy("__none", "__name")
    w = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("weight", F.get(w, (F.row_number().over(line) - 1) % len(weights)).cast("long"))
    whole = Window.partitionBy(F.lit(0))
    level = whole.orderBy(2 * F.col("source_size") / F.col("weight"), "__none", "__name")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    seen = ranked.withColumns({
        "all": F.sum("source_size").over(whole),
        "spent": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * 200,
        "rest": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    share = (percent * F.col("all") - F.col("spent")).cast("double")  # of all words, times 100
    seen = seen.withColumn("fits", F.col("source_size") * 200.0 * F.col("rest") > share * F.col("weight"))
    first = F.first(F.when(F.col("fits"), F.struct("spent", "rest")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = seen.withColumn("l", first)
    target = (F.col("weight") * (percent * F.col("all") - F.col("l.spent"))).cast("double") / (F.col("l.rest") * 100).cast("double")
    return seen.withColumn("target", F.when(F.col("fits"), target).otherwise(2.0 * F.col("source_size"))).drop("spent", "rest", "fits", "l")


def mixed(documents: DataFrame, size: Column | None = None, percent: int = 150, weights: tuple[int, ...] = (5, 2, 1), block: int = BLOCK, leaf: int = LEAF, seed: int = 13, fan: int = FAN) -> DataFrame:
    """The columns of documents but text, with size, source_size, target, taken and spans: the words (first, end) that the mix takes from each row.

    size is the row's number of words; null texts have 0. A source's `taken` is within a block of its target, but for what less than a
    block at the end of a shard's line leaves; no document gives more than 2 times its words. Rows are told apart by doc_id, null ones by
    their text; rows equal in doc_id, source and size share what their place in the order gives. Columns named like the new ones are replaced, an empty
    table gives an empty one. The result is a function of rows, weights and seed: partitions and reruns don't change it.

    A source has 2^d shards of about `leaf` rows, by the first d bits of its rows' seeded places, so a hot one has more of them. A quota goes down
    a tree of 2^fan children a node: no group holds more than these. Quotas meet the rows by source and shard, in the shuffle that the running sums need.
    """
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) if size is None else size
    base = documents.withColumns({
        "size": F.coalesce(words, F.lit(0)).cast("long"),
        "__none": F.col("source").isNull(),
        "__name": F.coalesce("source", F.lit("")),
        "__u": seeded(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit("")))), seed),
    }).drop("text", "source_size", "target", "taken", "spans")
    base = written(base, "mix-rows")
    own = ["__none", "__name"]
    sources = base.groupBy(*own).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    depth = F.when(F.col("rows") <= leaf, 0).otherwise(F.length(F.bin(F.floor((F.col("rows") - 1) / leaf)))).alias("depth")
    sources = written(targets(sources, percent, weights).select(*own, "source_size", "weight", "target", "all", depth), "mix-sources")
    shard = F.expr(f"shiftright(__u, {BITS} - depth)").alias("shard")
    placed = base.join(sources.select(*own, "depth"), own)
    shards = placed.groupBy(*own, shard).agg(F.sum("size").alias("words")).join(sources, own)
    shards = written(shards.withColumn("most", F.floor(2 * F.col("words") / block).cast("long")), "mix-shards")
    deep = sources.agg(F.max("depth")).first()[0] or 0
    levels = [min(x, deep) for x in range(0, deep + fan, fan)]
    node = lambda x: F.expr(f"shiftright(shard, greatest(depth - {x}, 0))")
    # the root: sources by weight
    room = shards.groupBy(*own).agg(F.sum("most").alias("most"), F.first("weight").alias("votes"), F.first("all").alias("all"))
    seats = F.expr(f"({percent} * all + {50 * block}) div {100 * block}")
    quota = highest_quotients(room.select(F.lit(0).alias("root"), *own, "votes", "most", seats.alias("seats")), ["root"], own)
    quota = written(quota.select(*own, F.lit(0).cast("long").alias("node"), F.col("given").alias("seats")), "mix-quota")
    for above, here in zip(levels, levels[1:], strict=False):
        nodes = shards.groupBy(*own, node(above).alias("node"), node(here).alias("child")).agg(F.sum("words").alias("votes"), F.sum("most").alias("most"))
        quota = highest_quotients(nodes.join(quota, [*own, "node"]), [*own, "node"], ["child"])
        quota = written(quota.select(*own, F.col("child").alias("node"), F.col("given").alias("seats")), "mix-quota")
    quotas = shards.select(*own, "shard", "depth", "words", "most", "source_size", "target").join(quota.withColumnRenamed("node", "shard"), [*own, "shard"])
    # the seeded order of a shard's blocks: k -> (a k + b) mod n, a coprime to n
    salt = seeded(F.concat_ws(":", F.col("__none").cast("string"), "__name", "shard"), seed)
    ahead = F.least("most", F.expr(f"(words + {block - 1}) div {block}"))
    def drawn(n: Column, name: str) -> list[Column]:
        step = F.transform(F.array(*map(F.lit, PRIMES)), lambda p: F.when(n > 0, p % n).otherwise(0))
        wide = F.filter(step, lambda a: (a * 5 >= n) & (a * 5 <= 4 * n))
        wide = F.when(F.size(wide) > 0, wide).otherwise(step)
        return [F.get(wide, (F.col("salt") % F.size(wide)).cast("int")).cast("long").alias(f"a{name}"), F.when(n > 0, F.col("salt") % n).otherwise(0).cast("long").alias(f"b{name}")]
    quotas = quotas.withColumn("salt", salt).withColumn("n1", ahead).withColumn("n2", F.col("most") - F.col("n1"))
    quotas = quotas.select("*", *drawn(F.col("n1"), "1"), *drawn(F.col("n2"), "2"))
    line = Window.partitionBy(*own, "shard").orderBy("__u", "size", *[c for c in ("doc_id",) if c in base.columns]).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("shard", shard).drop("depth").join(quotas.drop("depth"), [*own, "shard"]).withColumn("p", F.coalesce(F.sum("size").over(line), F.lit(0)))
    picked = lambda k: F.when(k < F.col("n1"), (F.col("a1") * k + F.col("b1")) % F.col("n1") < F.col("seats")).otherwise(
        (k < F.col("most")) & ((F.col("a2") * (k - F.col("n1")) + F.col("b2")) % F.col("n2") < F.col("seats") - F.col("n1")))
    def overlap(at: Column, whole: Column) -> Column:
        """The selected parts of the row that lies at `at` of the line."""
        parts = F.transform(
            F.sequence(F.floor(at / block), F.floor((at + F.col("size") - 1) / block)),
            lambda k: F.struct(k.alias("k"), (F.greatest(at, k * block) - at).cast("long").alias("first"), (F.least(at + F.col("size"), (k + 1) * block) - at).cast("long").alias("end")),
        )
        some = F.transform(F.filter(parts, lambda x: picked(x["k"])), lambda x: F.struct(x["first"], x["end"]))
        none = some if whole is None else F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("end")))).otherwise(some)
        return F.when((F.col("size") > 0) & (F.col("seats") > 0), none).otherwise(F.array().cast("array<struct<first:bigint,end:bigint>>"))
    once, twice = overlap(F.col("p"), (F.col("seats") >= F.col("n1")) & (F.col("p") + F.col("size") <= F.col("n1") * block)), overlap(F.col("words") + F.col("p"), F.col("seats") <= F.lit(-1))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    kept = [c for c in base.columns if not c.startswith("__")]
    return rows.withColumn("spans", F.concat(once, twice)).select(*[F.col(f"`{c}`") for c in kept], "source_size", "target", length.alias("taken"), "spans")


def _order(n: str, i: int) -> str:
    """SQL for the step and the shift of a shard's seeded order."""
    step = f"list_transform({list(PRIMES)}, lambda p: p % {n})"
    wide = f"list_filter({step}, lambda a: a * 5 >= {n} AND a * 5 <= 4 * {n})"
    chosen = f"CASE WHEN len({wide}) > 0 THEN {wide} ELSE {step} END"
    return f"CASE WHEN {n} > 0 THEN ({chosen})[1 + salt % len({chosen})] END AS a{i}, CASE WHEN {n} > 0 THEN salt % {n} END AS b{i}"


def oracle(percent: int = 150, weights: tuple[int, ...] = (5, 2, 1), block: int = BLOCK, leaf: int = LEAF, seed: int = 13, fan: int = FAN) -> str:
    """DuckDB SQL for (doc_id, size, source_size, target, taken): quotients are written out and sorted; for sources of up to leaf * 2^fan rows."""
    bits = lambda x: f"('0x' || substr(md5('{seed}:' || {x}), 1, {BITS // 4}))::BIGINT"
    return f"""
WITH base AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    {bits("coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))")} AS u FROM documents),
src AS (SELECT none, name, sum(size)::BIGINT AS source_size, count(*) AS n, {list(weights)}[1 + (row_number() OVER (ORDER BY none, name) - 1) % {len(weights)}] AS w FROM base GROUP BY none, name),
lev AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, coalesce(sum(source_size) OVER b, 0)::BIGINT * 200 AS spent, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS rest
  FROM src WINDOW b AS (ORDER BY 2 * source_size / w, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT *, source_size * 200 * rest > ({percent} * total - spent) * w AS fits FROM lev),
lvl AS (SELECT spent AS s0, rest AS r0 FROM fit WHERE fits ORDER BY 2 * source_size / w, none, name LIMIT 1),
tgt AS (SELECT f.none, f.name, f.source_size, f.w, f.total, CASE WHEN n <= {leaf} THEN 0 ELSE length(bin((n - 1) // {leaf})) END AS depth,
    CASE WHEN fits THEN (w * ({percent} * total - s0))::DOUBLE / (r0 * 100)::DOUBLE ELSE 2.0 * source_size END AS target FROM fit f LEFT JOIN lvl ON true),
doc AS (SELECT b.*, t.source_size, t.w, t.total, t.target, b.u >> ({BITS} - t.depth) AS shard FROM base b JOIN tgt t USING (none, name)),
shd AS (SELECT none, name, shard, sum(size)::BIGINT AS words, (2 * sum(size))::BIGINT // {block} AS most FROM doc GROUP BY none, name, shard),
room AS (SELECT s.none, s.name, sum(most)::BIGINT AS most, any_value(w) AS w, any_value(total) AS total FROM shd s JOIN tgt USING (none, name) GROUP BY s.none, s.name),
bid AS (SELECT none, name, total, unnest(range(1, most + 1)) AS k, w FROM room),
won AS (SELECT *, row_number() OVER (ORDER BY w / (2 * k - 1) DESC, none, name, k) AS r FROM bid),
got AS (SELECT none, name, count(*) AS q FROM won WHERE r <= ({percent} * total + {50 * block}) // {100 * block} GROUP BY none, name),
bid2 AS (SELECT s.none, s.name, s.shard, s.words, g.q, unnest(range(1, s.most + 1)) AS k FROM shd s JOIN got g USING (none, name)),
won2 AS (SELECT *, row_number() OVER (PARTITION BY none, name ORDER BY words / (2 * k - 1) DESC, shard, k) AS r FROM bid2),
got2 AS (SELECT none, name, shard, count(*) AS seats FROM won2 WHERE r <= q GROUP BY none, name, shard),
quo AS (SELECT s.*, coalesce(g.seats, 0) AS seats, least(most, (words + {block - 1}) // {block}) AS n1, most - least(most, (words + {block - 1}) // {block}) AS n2,
    {bits("s.none::VARCHAR || ':' || s.name || ':' || s.shard")} AS salt FROM shd s LEFT JOIN got2 g USING (none, name, shard)),
ord AS (SELECT *, {_order("n1", 1)}, {_order("n2", 2)} FROM quo),
pos AS (SELECT d.doc_id, d.size, d.source_size, d.target, o.*, coalesce(sum(d.size) OVER (PARTITION BY d.none, d.name, d.shard ORDER BY d.u, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p
  FROM doc d JOIN ord o ON d.none = o.none AND d.name = o.name AND d.shard = o.shard),
twice AS (SELECT *, unnest([p, words + p]) AS x0 FROM pos),
part AS (SELECT *, unnest(range(x0 // {block}, (x0 + size - 1) // {block} + 1)) AS k FROM twice WHERE size > 0 AND seats > 0),
cut AS (SELECT doc_id, none, name, shard, p, least(x0 + size, (k + 1) * {block}) - greatest(x0, k * {block}) AS x FROM part
  WHERE CASE WHEN k < n1 THEN (a1 * k + b1) % n1 < seats WHEN k < most THEN (a2 * (k - n1) + b2) % n2 < seats - n1 ELSE false END),
sums AS (SELECT doc_id, none, name, shard, p, sum(x)::BIGINT AS taken FROM cut GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(s.taken, 0) AS taken FROM pos p
LEFT JOIN sums s ON p.doc_id = s.doc_id AND p.none = s.none AND p.name = s.name AND p.shard = s.shard AND p.p = s.p"""
