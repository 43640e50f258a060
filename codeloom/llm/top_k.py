"""Exact top-k search over integer vectors: MaxScore in shards, merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Components of a shard's rows and queries of a block, about. A task holds one of each: 2^22 components are 32 MB.
SHARD, BLOCK = 1 << 22, 256
#: Rows that open a shard, whose scores give each query its first threshold.
OPENING = 256
#: Queries whose essential terms are traversed in one product: the shard's postings are read once for all of them.
TOGETHER = 16
#: Times k rows, those that lead by their essential terms, that are scored in full to raise a query's threshold.
AHEAD = 4
#: While more than one in so many rows would be probed, half of the terms left are traversed as well.
PROBE = 64
#: What stands for a null id: it sorts last.
NO_ID = (1 << 63) - 1


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of any lengths as the rows of a matrix, padded with zeros."""
    lists = vectors.combine_chunks()
    size = lists.value_lengths().to_numpy()
    made = np.zeros((len(size), width), np.int64)
    made[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return made


def search_shard(query_places: np.ndarray, queries: np.ndarray, ids: np.ndarray, places: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's id, score) of each query's k best rows, ties to the smaller id, the row at the query's own
    place left out.

    A dimension is a term, and its posting the shard's values in it. Shifted by the term's lower bound, contributions
    are at least zero. The terms with the smallest ranges are non-essential as long as their ranges together stay below
    the threshold, the k-th best score so far: a row that scored nothing elsewhere could not reach it. The postings of
    the essential terms are traversed, for TOGETHER queries in one product; while many rows could
    still reach it, more terms are traversed; the others are probed, widest range first, only for rows whose score so far and
    the ranges still open reach the threshold.
    """
    bound = float(np.abs(rows).max(initial=1)) * float(np.abs(queries).max(initial=1)) * rows.shape[1]
    exact = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    held, weights = np.ascontiguousarray(rows.astype(exact)), queries.astype(exact)
    postings = np.ascontiguousarray(held.T)
    high, low = postings.max(1), postings.min(1)
    upper, lower = np.maximum(weights * high, weights * low), np.minimum(weights * high, weights * low)
    order = np.argsort(lower - upper, axis=1, kind="stable")
    after = lambda m: np.pad(np.cumsum(np.take_along_axis(m, order, 1)[:, ::-1], 1)[:, ::-1], ((0, 0), (0, 1)))  # noqa: E731 - sums over the terms from each place on
    ranges, left = after(upper - lower), after(upper)
    seeds = min(len(rows), max(4 * k, OPENING))
    opening = weights @ postings[:, :seeds]
    floors: list[float | None] = []
    essential = np.full(len(weights), rows.shape[1])
    for i in range(len(weights)):
        first = opening[i][places[:seeds] != query_places[i]]
        floors.append(np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else None)
        if floors[i] is not None:
            essential[i] = max(1, int((ranges[i] >= floors[i] - lower[i].sum()).sum()))
            essential[i] = min(essential[i], rows.shape[1])
    def terms(block: slice, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The queries' weights of the terms from start to stop in their order, zeros elsewhere."""
        at, made = np.arange(rows.shape[1]), np.zeros_like(weights[block])
        inside = (at >= start[:, None]) & (at < stop[:, None])
        np.put_along_axis(made, order[block], np.where(inside, np.take_along_axis(weights[block], order[block], 1), 0), 1)
        return made

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, q in enumerate(weights):
        if i % TOGETHER == 0:
            block, none = slice(i, i + TOGETHER), np.zeros(len(essential[i : i + TOGETHER]), int)
            traversed = terms(block, none, essential[block]) @ postings
            while True:
                many = np.zeros(len(traversed), bool)
                for j, scores in enumerate(traversed):
                    at, threshold = essential[i + j], floors[i + j]
                    if threshold is None or at == rows.shape[1]:
                        continue
                    if len(rows) > AHEAD * k:  # the rows that lead so far raise the threshold before the others are probed
                        leading = np.argpartition(scores, len(rows) - AHEAD * k)[len(rows) - AHEAD * k :]
                        full = held[leading[places[leading] != query_places[i + j]]] @ weights[i + j]
                        floors[i + j] = threshold = max(threshold, np.partition(full, len(full) - k)[len(full) - k])
                    many[j] = np.count_nonzero(scores >= threshold - left[i + j][at]) * PROBE > len(rows)
                if not many.any():
                    break
                start = essential[block].copy()
                essential[block] = np.where(many, start + (rows.shape[1] - start + 1) // 2, start)
                traversed += terms(block, start, essential[block]) @ postings
        scores, at, threshold = traversed[i % TOGETHER], essential[i], floors[i]
        if threshold is None:
            found = np.arange(len(rows))
        else:
            found = np.flatnonzero(scores >= threshold - left[i][at])
            scores, rest = scores[found], held[found] if at < rows.shape[1] else None
            while at < rows.shape[1] and len(found):
                part = order[i][at : at + 8]
                scores = scores + rest[:, part] @ q[part]
                at += len(part)
                kept = scores >= threshold - left[i][at]
                found, scores, rest = found[kept], scores[kept], rest[kept]
        other = places[found] != query_places[i]
        found, scores = found[other], scores[other]
        if len(found) > 4 * k:  # all that reach the k-th best score, ties included
            kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            found, scores = found[kept], scores[kept]
        best = np.lexsort((ids[found], -scores))[:k]
        out.append((np.full(len(best), query_places[i]), ids[found][best], scores[best].astype(np.int64)))
    join = lambda n: np.concatenate([x[n] for x in out]) if out else np.zeros(0, np.int64)
    return join(0), join(1), join(2)


def quantised(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(place, id, v): each component as floor(scale * x), x as double, and the row's number in the shared folder. Rows
    whose vector is null or holds a null or a non-finite component are left out; a null id becomes NO_ID."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("x").isNotNull() & sound)
    return cut(rows.select(F.monotonically_increasing_id().alias("place"), F.coalesce("id", F.lit(NO_ID)).alias("id"), F.transform("x", lambda c: F.floor(c * scale)).alias("v")))


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k other rows with the highest
    inner products, ties to the smaller id, null last; all rows where there are fewer. Shorter vectors count as padded
    with zeros. Rows that share an id are candidates each, and queries each, of which no row is its own candidate. A
    score beyond a long is undefined.

    Rows are dealt to shards and queries to blocks by a hash of their places; each pair of a shard and a block is a task's
    work. A shard holds as many rows as its memory allows, so that the partial results, k for each query and shard, are
    few beside the products that the search is made of; each query's best of all shards are merged."""
    rows = quantised(table, key, vector, scale)
    size = rows.agg(F.sum(F.greatest(F.size("v"), F.lit(1))), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-(size[0] or 0) // SHARD)), max(1, -(-(size[1] or 0) // BLOCK))
    place = lambda of, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("place")), F.lit(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    # New names on this side: both come from one table, and a cogroup would take equal columns for the same.
    dealt = rows.select(F.col("place").alias("c_place"), F.col("id").alias("c_id"), F.col("v").alias("c_v"), place(shards, 1).alias("shard"), spread(blocks).alias("block"))
    asked = rows.where((F.col("id") % every == 0) & (F.col("id") != NO_ID)).select("place", "id", "v", spread(shards).alias("shard"), place(blocks, 2).alias("block"))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found, named = (np.zeros(0, np.int64),) * 3, np.zeros(0, np.int64)
        if queries.num_rows and candidates.num_rows:
            width = max(1, *(pa.compute.max(pa.compute.list_value_length(v)).as_py() for v in (queries["v"], candidates["c_v"])))
            own = queries["place"].to_numpy()
            found = search_shard(own, _matrix(queries["v"], width), candidates["c_id"].to_numpy(), candidates["c_place"].to_numpy(), _matrix(candidates["c_v"], width), k)
            order = np.argsort(own)
            named = queries["id"].to_numpy()[order[np.searchsorted(own[order], found[0])]]
        return pa.table({"place": pa.array(found[0], pa.int64()), "query_id": pa.array(named, pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    parts = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(search, "place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
