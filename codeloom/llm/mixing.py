"""Mixing sources to target weights: pivotal dependent rounding of fractional copies, residuals in a reduction tree."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

#: Documents of a leaf of the tree, about, and leaves that one node of the next level takes together.
LEAF, FAN = 256, 64


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    """Words to take of each source, as ``plan`` finds them for any number of sources, here in fractions. Sources in order of code points, null last, weigh ``weights`` in turn and share the
    total size; no target exceeds ``most`` times its source's size, and the excess is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weigh[s] for s in open_)
        full = [s for s in open_ if share * weigh[s] > most * sizes[s]]
        if not full:
            return {s: float(v) for s, v in (out | {s: share * weigh[s] for s in open_}).items()}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return {s: float(v) for s, v in out.items()}


def plan(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources(source, n, words) with the ``target`` of each, a table in the shared folder: ``targets`` without bringing
    the sources to the driver, which sees one row of sums a round.

    Sources get their weights by their rank: sorted in ranges, a row's rank is its place in its range and the rows of the
    ranges before. All open sources take one level times their weight; a source is full where that exceeds ``most`` times
    its size. Each round takes what full sources leave into the level, which only rises, until no more are full."""
    ranged = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("held"))  # a row for each shuffle partition
    offsets = ranges.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut(ranged.withColumn("part", part).join(offsets, "part").select("source", "n", "words", weight.alias("weight")))
    total, weigh = weighed.agg(F.sum("words"), F.sum("weight")).first()
    left, weigh, full = total or 0, weigh or 0, 0
    cap = F.col("words") * most

    def over(left: int, weigh: int) -> Column:
        return (F.lit(float(left)) * F.col("weight") > F.lit(float(weigh)) * cap) if weigh else F.lit(True)

    while weigh:
        is_full = over(left, weigh)
        r = weighed.agg(F.count(F.when(is_full, 1)), F.sum(F.when(is_full, cap)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if r[0] == full:
            break
        full, left, weigh = r[0], total - (r[1] or 0), r[2] or 0
    share = F.lit(float(left)) * F.col("weight") / float(weigh or 1)
    return weighed.select("source", "n", "words", F.when(over(left, weigh), cap.cast("double")).otherwise(share).alias("target"))


def _pivot(rows: pd.DataFrame) -> pd.DataFrame:
    """One node: two fractional documents at a time, neighbours by size, fight until one of them is 0 or 1; the last
    stays fractional. A fight takes the draw of the one that joins it, so that each draw of a level is used once; draws
    are hashes, so that a node that is run again decides alike."""
    rows = rows.sort_values(["size", "tie"], kind="stable").reset_index(drop=True)
    p, extra, draw = rows["part"].to_numpy(float).copy(), rows["extra"].to_numpy().copy(), rows["draw"].to_numpy()
    i = -1
    for j in range(len(p)):
        if i < 0:
            i = j
            continue
        a, b = p[i], p[j]
        if (total := a + b) < 1:
            keep = draw[j] * total < a
            p[i], p[j] = (total, 0.0) if keep else (0.0, total)
        else:
            keep = draw[j] * (2 - total) < 1 - b
            p[i], p[j] = (1.0, total - 1) if keep else (total - 1, 1.0)
        done, other = (j, i) if (p[j] in (0.0, 1.0)) else (i, j)
        extra[done] = int(p[done])
        i = other
        if p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
            extra[i], i = round(p[i]), -1
    rows["part"], rows["extra"] = p, extra
    rows["open"] = False
    if i >= 0:
        rows.loc[i, "open"] = True
    return rows


def _uniform(mark: Column, *role: int) -> Column:
    """From 0 to 1, by a hash of the row's mark and what the draw is for."""
    return F.pmod(F.xxhash64(*(F.lit(r) for r in role), mark), F.lit(1 << 53)) / float(1 << 53)


def _sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(*more, "doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")).alias("mark")))


def _rounded(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """The columns of ``sized`` but mark, with source_size, target and copies."""
    kept = [c for c in sized.columns if c != "mark"]
    goals = plan(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), weights, most)
    due = F.when(F.col("words") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("words"))).otherwise(0.0)
    goals = goals.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target", F.floor(due).cast("int").alias("whole"), (due - F.floor(due)).alias("part"), F.ceil(F.col("n") / LEAF).alias("leaves"))
    # Rows alike in all that marks them would meet in one leaf: where they fill one, their places part them.
    crowds = sized.groupBy("mark").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > LEAF)
    dealt = sized.withColumn("place", F.monotonically_increasing_id()).join(crowds, "mark", "left").join(goals, F.col("source").eqNullSafe(F.col("of")))
    leaf = F.xxhash64(F.lit(-1), F.col("mark"), F.when(F.col("crowd").isNotNull(), F.col("place")))
    level = dealt.select(*kept, "mark", "source_size", "target", "whole", "part", "leaves", F.lit(0).alias("extra"), F.lit(True).alias("open"), F.pmod(leaf, F.col("leaves")).alias("node"))
    done, depth, leaves = [], 0, goals.agg(F.max("leaves")).first()[0] or 1
    while True:
        drawn = level.withColumns({"draw": _uniform(F.col("mark"), depth, 0), "tie": F.xxhash64(F.lit(depth), F.lit(1), F.col("mark"))})
        level = cut(drawn.groupBy("source", "node").applyInPandas(_pivot, drawn.schema))
        if leaves == 1:
            break
        done.append(level.where("not open"))
        depth, leaves = depth + 1, -(-leaves // FAN)
        above = F.greatest(F.ceil(F.col("leaves") / FAN), F.lit(1))
        level = level.where("open").drop("draw", "tie").withColumn("leaves", above).withColumn("node", F.pmod(F.xxhash64(F.lit(depth), F.col("node")), F.col("leaves")))
    last = level.withColumn("extra", F.when(F.col("open"), (_uniform(F.col("mark"), -2, 0) < F.col("part")).cast("int")).otherwise(F.col("extra")))
    for d in done:
        last = last.unionByName(d)
    return last.select(*kept, "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``.

    size is the number of words of the text (null: 0), source_size that of its source, target the words to take of the
    source, taken = copies * size. Every document of a source is due target / source_size copies: the whole part is
    certain, and the fraction is rounded by pivotal sampling, which holds the sum of fractions and, as neighbours by size
    meet, nearly that of words. Leaves of about LEAF documents are rounded apart; each leaves one document open at most,
    and the open ones meet in the next level of the tree, FAN nodes in one, until one is left, which its own draw decides.

    A hash of doc_id, source and text seeds the draws, one for each level; rows alike in all three are rounded each, in
    leaves of their own where they are more than a leaf holds. Null is a source of its own, the last. Sources stay
    distributed, however many there are; an empty table gives an empty one.
    """
    made = _rounded(_sized(docs, seed), weights, most)
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def resample(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows get numbers as they are written to the shared folder
    and are taken by these: rows that share a doc_id, or have none, are rows like others."""
    row, copies = fresh(docs, "row"), fresh(docs, "copies")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    made = _rounded(_sized(numbered.select(F.col(row).alias("row"), "doc_id", "source", "text"), seed, "row"), weights, most)
    taken = made.where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    joined = numbered.join(taken, row)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).drop(copies)
