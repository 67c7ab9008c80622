"""Exact top-k inner products by aggregation of sorted lists without random access.

Candidates are held in shards.  A shard has a list for each component, sorted by its value; an entry carries its
candidate's length.  The lists are read from the end that the query's sign prefers, a part at a time and all lists
alike.  What has been read of a candidate bounds its score from below and above: each unread component lies between
the end of its list and where reading stopped, and all unread ones together cannot give more than the product of
what is left of the two lengths.  A query stops when no more candidates than a few can still be among its best; the
final scores of those are resolved.  A block of queries is worked on at once, so a reading is some matrix products.

Shards stay where they are: a task holds a few and blocks of queries come to it, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates in a shard, shards that a task holds together, and queries in a block.
SHARD, TOGETHER, QUERIES = 4096, 16, 1024
#: Parts of the lists that have been read after each round, and the part of the candidates whose scores are resolved.
READ, RESOLVED = (3 / 4, 7 / 8, 15 / 16), 1 / 32

_BLOCK = "ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column, also_zero: bool = True) -> Column:
    """Whether a vector is there, has components, and none of them is null or not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)
    return out if also_zero else out & F.exists(vector, lambda x: x != 0)


def packed_blocks(rows: DataFrame, kind: str, block: str) -> DataFrame:
    """(block, ids, vectors): the rows (id, vector, block) of each block in two strings, by id."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "vector")))
    sized = rows.groupBy(block).agg(ordered.alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for rows in batch.column(1):
                ids.append(np.asarray(rows.values.field("id"), np.int64).tobytes())
                vectors.append(np.asarray(rows.values.field("vector").flatten(), kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(vectors, pa.binary())], [block, "ids", "vectors"])

    return sized.mapInArrow(pack, f"{block} long, {_BLOCK}")


def search_in_place(shards: DataFrame, n_shards: int, queries: DataFrame, search: Callable, schema: str) -> DataFrame:
    """What ``search`` yields for each block of ``queries`` (block, ids, vectors) and some of ``shards`` (shard, ids, vectors and, maybe, graph).

    ``search`` gets (ids, vectors) of the block and a list of shards' columns, all as buffers.  A task holds at most
    TOGETHER shards at a time; each block of queries is sent to each task once.
    """
    parts = max(-(-n_shards // TOGETHER), min(n_shards, shards.sparkSession.sparkContext.defaultParallelism))
    graph = F.col("graph") if "graph" in shards.columns else F.lit(None).cast("binary").alias("graph")
    still = shards.select((F.col("shard") % parts).alias("part"), F.lit(-1).cast("long").alias("block"), "ids", "vectors", graph)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    sent = queries.select(every.alias("part"), "block", "ids", "vectors", F.lit(None).cast("binary").alias("graph"))
    met = still.unionByName(sent).repartition(parts, "part").sortWithinPartitions("part", "block").select("part", "block", "ids", "vectors", "graph")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for at, block, *columns in zip(*(batch.column(i) for i in range(5)), strict=True):
                if at.as_py() != part:
                    part, held = at.as_py(), []
                if block.as_py() < 0:
                    held.append([bytes(c.as_buffer()) if c.is_valid else None for c in columns])
                else:
                    yield from search(columns[0].as_buffer(), columns[1].as_buffer(), held)

    return met.mapInArrow(searched, schema)


def best_of_shard(queries: np.ndarray, candidates: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """(query numbers, candidate numbers, scores, part of the lists read): the best of each query in a shard, ties with them, and maybe some more.

    ``queries`` and ``candidates`` are whole numbers held as doubles: sums up to 2**53 are exact.
    """
    n, width = candidates.shape
    ranks = np.empty((n, width), np.int64)
    order = np.argsort(candidates, axis=0, kind="stable")
    np.put_along_axis(ranks, order, np.arange(n)[:, None].repeat(width, 1), axis=0)
    falling, rising = np.maximum(queries, 0), np.minimum(queries, 0)
    above, below = (queries > 0).astype(np.float64), (queries < 0).astype(np.float64)
    squares, lengths = candidates**2, (candidates**2).sum(axis=1)
    least, most = candidates.min(axis=0), candidates.max(axis=0)
    open_ = np.arange(len(queries))
    own = lambda q, scores: np.where(ids[None, :] == query_ids[q][:, None], -np.inf, scores)
    few = min(n, max(4 * k + 8, int(n * RESOLVED)))
    for part in READ:
        depth = int(n * part)
        if not len(open_) or depth < 1 or n <= few:
            break
        # of a list read from the top, what is unread lies between the list's end and where reading stopped
        top, bottom = np.take_along_axis(candidates, order[-depth][None], 0), np.take_along_axis(candidates, order[depth - 1][None], 0)
        seen_top, seen_bottom = ranks >= n - depth, ranks < depth
        up, down = falling[open_], rising[open_]
        read = up @ np.where(seen_top, candidates, 0).T + down @ np.where(seen_bottom, candidates, 0).T
        no_top, no_bottom = (~seen_top).astype(np.float64), (~seen_bottom).astype(np.float64)
        left = lengths - above[open_] @ np.where(seen_top, squares, 0).T - below[open_] @ np.where(seen_bottom, squares, 0).T
        unasked = up**2 @ no_top.T + down**2 @ no_bottom.T
        rest = np.sqrt(np.maximum(left, 0) * unasked) * (1 + 1e-9) + 1e-6
        upper = own(open_, read + np.minimum(rest, (up * top) @ no_top.T + (down * bottom) @ no_bottom.T))
        lower = own(open_, read - np.minimum(rest, -((up * least) @ no_top.T + (down * most) @ no_bottom.T)))
        bar = -np.partition(-lower, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
        may = upper >= bar[:, None]
        done = may.sum(axis=1) <= few
        if done.any():
            q, c = np.nonzero(may[done])
            q = open_[done][q]
            q, c = q[ids[c] != query_ids[q]], c[ids[c] != query_ids[q]]
            yield q, c, np.einsum("ij,ij->i", queries[q], candidates[c]), part
            open_ = open_[~done]
    if len(open_):  # their lists are read to the end: both bounds are the score
        scores = own(open_, queries[open_] @ candidates.T)
        bar = -np.partition(-scores, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
        q, c = np.nonzero((scores >= bar[:, None]) & np.isfinite(scores))
        yield open_[q], c, scores[q, c], 1.0


def first_of_each(k: int, q: np.ndarray, found: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best, ties by the smaller id, and each id once."""
    order = np.lexsort((found, -scores, q))
    q, found, scores = q[order], found[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], found[place < k], scores[place < k]


def _search(k: int):
    def search(q_ids: pa.Buffer, q_vectors: pa.Buffer, shards: list[list[bytes | None]]) -> Iterator[pa.RecordBatch]:
        query_ids = np.frombuffer(q_ids, np.int64)
        asked = np.frombuffer(q_vectors, "<i8").reshape(len(query_ids), -1)
        parts = []
        for raw_ids, raw, _ in shards:
            ids = np.frombuffer(raw_ids, np.int64)
            whole = np.frombuffer(raw, "<i8").reshape(len(ids), -1)
            queries, candidates = asked.astype(np.float64), whole.astype(np.float64)
            if queries.shape[1] * np.abs(queries).max() * np.abs(candidates).max() >= 2.0**53:
                q, c = np.nonzero(query_ids[:, None] != ids[None, :])
                products = (asked.astype(object) @ whole.astype(object).T)[q, c]  # beyond doubles: in whole numbers of any size
                scores = np.asarray([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in products], np.int64)
            else:
                q, c, scores, _ = zip(*best_of_shard(queries, candidates, query_ids, ids, k), strict=True)
                q, c, scores = (np.concatenate(x) for x in (q, c, scores))
            parts.append(first_of_each(k, q, ids[c], scores.astype(np.int64)))
        q, found, scores = first_of_each(k, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return search


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``, its k best others.

    A score is the inner product of the vectors' components floor(scale * x); ties go to the smaller vec_id.
    Rows with a null vec_id, or a vector that is null, empty or holds null or non-finite components, take no part;
    vectors of another length than a query's are no candidates of it.  Repeated rows of one vec_id: the first by its
    components is used.  With fewer candidates than k, all are returned; an empty table gives no rows.  Where
    products pass 2**53, a shard's scores are worked out in whole numbers of any size instead of by bounds; a score
    beyond a long is the nearest long.  A task sends at most k rows of a query on.
    """
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min("embedding").alias("embedding")).select("id", scaled.alias("vector"), F.size("embedding").alias("width"))
    fine = cut(fine)
    asked = F.col("id") % every == 0
    sizes = fine.groupBy("width").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect()
    out = None
    for width, n, q in sorted(sizes):
        if not q:
            continue
        rows = fine.where(F.col("width") == width)
        shards, blocks = -(-n // shard), -(-q // QUERIES)
        of = lambda count: F.pmod(F.xxhash64("id"), F.lit(count))
        candidates = packed_blocks(rows.select("id", "vector", of(shards).alias("shard")), "<i8", "shard")
        queries = packed_blocks(rows.where(asked).select("id", "vector", of(blocks).alias("block")), "<i8", "block")
        found = search_in_place(candidates, shards, queries, _search(k), _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return fine.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).where(F.lit(False))
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
