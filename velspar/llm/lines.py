"""Line dedup with DataFrame functions only, by winnowing: window minima of line hashes are fingerprints that a repeated run can't go without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velspar.llm.common import met, written

#: A run of so many lines that occurred before, earlier in its document or in an earlier one, is deleted.
WINDOW = 2


def _least(h: Column, start: Column, window: int) -> Column:
    """The place of the least hash among `window` lines from start on; the last of equal ones."""
    least = F.array_min(F.slice(h, start + 1, window))
    return start + window - F.array_position(F.reverse(F.slice(h, start + 1, window)), least).cast("int")


def fingerprints(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, __part, m1, m2, place, first, around) of the selected lines: those with the least hash of some window of lines that aren't blank.

    m1 and m2 are 128 bits of the line; place counts lines that aren't blank; around holds the lines (h, k, at) from `first` on
    that windows with this line can hold, at being their places in the text. Equal windows select equal lines, wherever they stand.
    """
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x))
    solid = F.filter(F.transform(trimmed, lambda x, i: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("k"), i.alias("at")))), lambda x: x.isNotNull())
    rows = documents.select("doc_id", "__part", solid.alias("l")).where(F.size("l") >= window).withColumn("h", F.col("l.h"))
    selected = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - window), lambda s: _least(F.col("h"), s, window)))
    near = rows.select("doc_id", "__part", F.explode(
        F.transform(selected, lambda p: F.struct(
            F.get("l", p).alias("own"), p.alias("place"), F.greatest(p - (window - 1), F.lit(0)).alias("first"),
            F.slice("l", F.greatest(p - (window - 1), F.lit(0)) + 1, F.least(p, F.lit(window - 1)) + window).alias("around")))
    ).alias("w"))
    return near.select("doc_id", "__part", F.col("w.own.h").alias("m1"), F.col("w.own.k").alias("m2"), "w.place", "w.first", "w.around")


def extended(prints: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, __part, r1, r2, start, at): a fingerprint extended to both sides, by each number of lines to its left that a window with this minimum has.

    r1 and r2 are 128 bits of the window's lines. A window has one minimum, so it comes from one fingerprint alone.
    """
    h = F.col("around.h")
    starts = F.sequence(F.lit(0), F.least(F.col("place") - F.col("first"), F.size("around") - window))
    own = F.filter(starts, lambda s: _least(h, s, window) == F.col("place") - F.col("first"))
    run = lambda s: F.slice("around", s + 1, window)
    hashed = lambda s, *salt: F.xxhash64(*salt, F.transform(run(s), lambda x: x["h"]), F.transform(run(s), lambda x: x["k"]))
    parts = F.transform(own, lambda s: F.struct(hashed(s).alias("r1"), hashed(s, F.lit(1)).alias("r2"), (F.col("first") + s).alias("start"), F.transform(run(s), lambda x: x["at"]).alias("at")))
    return prints.where(F.size("around") >= window).select("doc_id", "__part", F.explode(parts).alias("w")).select("doc_id", "__part", "w.*")


def dedup_lines(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents without the lines of runs that occurred before; n_removed counts them; text is null where it was.

    Fingerprints that occur once are dropped. The others are extended to the left and right to the windows that hold them; equal
    windows meet, the earliest by doc_id (null first), then by place in the text, keeps its lines and all later ones lose theirs.
    Windows of a longer run overlap, so together they reach as far as it does on both sides. A run is `window` or more neighbouring lines that
    aren't blank, equal after trimming blanks; a line that repeats between other neighbours stays, however long. Blank lines between them don't
    part a run and stay. Documents that lose all lines keep their row. Repeated rows of one doc_id count as one document in several parts,
    told apart by their text's hash; rows equal in both are one part and lose the same lines. Other columns stay, but for n_removed,
    which is replaced; an empty table gives an empty result.
    """
    base = documents.drop("n_removed").withColumn("__part", F.xxhash64("text"))
    prints = written(fingerprints(base, window), "line-prints")
    marks = written(prints.groupBy("m1", "m2").agg(F.count("*").alias("n")).where("n > 1"), "line-marks")
    windows = written(extended(met(prints, marks, ["m1", "m2"], prints.count()), window), "line-windows")
    here = F.struct(F.col("doc_id"), F.col("__part"), F.col("start"))
    first = written(windows.groupBy("r1", "r2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-first")
    later = met(windows, first, ["r1", "r2"], windows.count()).where(~here.eqNullSafe(F.col("first")))
    gone = later.select("doc_id", "__part", F.explode("at").alias("at")).groupBy("doc_id", "__part").agg(F.collect_set("at").alias("gone"))
    d, g = base.alias("d"), gone.alias("g")
    joined = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.__part").eqNullSafe(F.col("g.__part")), "left")
    # the difference of two sets of places is hashed, and the lines are bound once, so a text costs as much as it has lines
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "g.gone"), lambda i: F.get(ls, i))
    kept = F.transform(F.array(F.split("d.text", "\n", -1)), lambda ls: F.array_join(left(ls), "\n"))[0]
    return joined.select(
        *[F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in base.columns if c != "__part"],
        F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def oracle(table: str = "documents", window: int = WINDOW) -> str:
    """DuckDB SQL for (doc_id, n_removed, text) of dedup_lines, on texts instead of hashes, for unique doc_ids."""
    ahead = ", ".join(f"lead(line, {i}) OVER w AS l{i}, lead(ix, {i}) OVER w AS a{i}" for i in range(1, window))
    keys = ", ".join(["line", *(f"l{i}" for i in range(1, window))])
    gone = " UNION ".join(["SELECT doc_id, ix FROM later", *(f"SELECT doc_id, a{i} FROM later" for i in range(1, window))])
    return f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
pos AS (SELECT doc_id, ls, unnest(range(len(ls))) AS ix FROM cut),
every AS (SELECT doc_id, ix, ls[ix + 1] AS raw, trim(ls[ix + 1], ' ') AS line FROM pos),
solid AS (SELECT doc_id, ix, line, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS place FROM every WHERE line <> ''),
win AS (SELECT doc_id, place, ix, line, {ahead} FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, place) AS r FROM win WHERE l{window - 1} IS NOT NULL),
later AS (SELECT * FROM ranked WHERE r > 1),
gone AS ({gone}),
marked AS (SELECT e.doc_id, e.ix, e.raw, g.ix IS NOT NULL AS out FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.ix = g.ix)
SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY ix) FILTER (WHERE NOT out), '') AS text
FROM marked GROUP BY doc_id"""
