"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Points enter a shard's graph in growing batches.  A greedy beam search of the graph so far proposes each new
point's neighbours; pruning takes the nearest and drops what is nearer to it, by the factor ``relax``, than to
the point, until ``degree`` edges are kept; edges back are added and pruned alike.  Queries search every shard's graph
by a beam, and the best of all shards are merged.  Largest inner products become smallest distances by one
more component, which makes all points of a shard equally long.  A shard's equal vectors are one point.  Searches
begin at a point near the mean, at some at random and at one of each piece that no path reaches, so every point can
be found.
Shards stay where they are: a task holds a few and blocks of queries come to it, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .topk import QUERIES, SHARD, first_of_each, packed_blocks, search_in_place, usable

#: Searches that advance together.
TOGETHER = 512
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 28, 48, 112, 1.2
#: Points at random that are proposed to each new point beside those that a search finds, and where searches begin:
#: in a crowd of near copies a search finds copies alone, and pruning leaves no way out of it.
FAR, STARTS = 16, 48

_GRAPH = "shard long, ids binary, vectors binary, graph binary"
_FOUND = "query_id long, vec_id long, score double"


def beam_search(queries: np.ndarray, points: np.ndarray, graph: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, distances) of each query's beam from the nearest of ``starts`` on, nearest first; unused places are -1 and infinite. Distances lack the query's own square."""
    n = len(queries)
    squares = (points**2).sum(axis=1)
    found = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, points.dtype)
    expanded = np.ones((n, beam), np.bool_)
    seen = np.zeros((n, len(points)), np.bool_)
    at_start = squares[starts] - 2 * (queries @ points[starts].T)
    order = np.argsort(at_start, axis=1, kind="stable")[:, :beam]
    width = order.shape[1]
    found[:, :width], expanded[:, :width] = starts[order], False
    far[:, :width] = np.take_along_axis(at_start, order, axis=1)
    seen[:, starts] = True
    at = np.arange(n)
    while len(at):
        place = np.argmin(expanded[at], axis=1)
        going = ~expanded[at, place]
        at, place = at[going], place[going]
        if not len(at):
            break
        expanded[at, place] = True
        near = graph[found[at, place]]
        new = (near >= 0) & ~seen[at[:, None], near]
        seen[at[:, None], np.where(new, near, found[at, place][:, None])] = True
        distance = squares[near] - 2 * np.matmul(points[near], queries[at][:, :, None])[:, :, 0]
        distance[~new] = np.inf
        distances = np.concatenate([far[at], distance], axis=1)
        ids = np.concatenate([found[at], near], axis=1)
        old = np.concatenate([expanded[at], ~new], axis=1)
        best = np.argsort(distances, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(at))[:, None]
        far[at], found[at], expanded[at] = distances[rows, best], ids[rows, best], old[rows, best]
    found[~np.isfinite(far)] = -1
    return found, far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """The edges (padded with -1) that each point of ``own`` keeps of its row of candidates (-1: none)."""
    n, width = candidates.shape
    theirs = points[candidates]
    away = ((theirs - points[own][:, None, :]) ** 2).sum(axis=2)
    squares = (theirs**2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(theirs, theirs.transpose(0, 2, 1))
    away[(candidates < 0) | (candidates == own[:, None])] = np.inf
    by_number = np.argsort(candidates, axis=1, kind="stable")
    sorted_ = np.take_along_axis(candidates, by_number, axis=1)
    again = np.zeros(candidates.shape, np.bool_)
    np.put_along_axis(again, by_number[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
    away[again] = np.inf
    kept = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(min(degree, width)):
        best = np.argmin(away, axis=1)
        alive = np.isfinite(away[rows, best])
        if not alive.any():
            break
        kept[alive, k] = candidates[rows[alive], best[alive]]
        away[rows, best] = np.inf
        away[alive[:, None] & (relax * relax * between[rows, best] <= away)] = np.inf
    return kept


def entries(graph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts``, and a point of each piece of the graph that cannot be reached from those before it."""
    reached = np.zeros(len(graph), np.bool_)
    out, front = starts.tolist(), starts
    while True:
        while len(front):
            reached[front] = True
            near = np.unique(graph[front])
            front = near[(near >= 0) & ~reached[near]]
        left = np.flatnonzero(~reached)
        if not len(left):
            return np.asarray(out)
        out.append(int(left[0]))
        front = left[:1]


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours (points, degree) padded with -1, the points where searches start: the one nearest to the mean, some at random, and those that ``entries`` adds)."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(n)
    order = rng.permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        new = order[done : done + min(TOGETHER, max(1, done))]
        found, _ = beam_search(points[new], points, graph, order[: min(done, STARTS)], beam)
        found = np.concatenate([found, order[rng.integers(0, done, (len(new), FAR))]], axis=1)
        graph[new] = robust_prune(points, new, found, degree, relax)
        # edges back: to each point, its edges so far and those that now lead from it
        source, target = np.repeat(new, degree), graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sort = np.lexsort((((points[source] - points[target]) ** 2).sum(axis=1), target))
        source, target = source[sort], target[sort]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        width = min(int(count.max()), 2 * degree) if len(count) else 0
        back = np.full((len(touched), width), -1, np.int64)
        fits = place < width  # of very many new edges back the nearest are considered
        back[np.repeat(np.arange(len(touched)), count)[fits], place[fits]] = source[fits]
        both = np.concatenate([graph[touched], back], axis=1)
        used = (both >= 0).sum(axis=1)
        easy = used <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        graph[touched[easy]] = packed[easy]
        hard = np.flatnonzero(~easy)
        for i in range(0, len(hard), TOGETHER):
            some = hard[i : i + TOGETHER]
            graph[touched[some]] = robust_prune(points, touched[some], both[some], degree, relax)
        done += len(new)
    return graph, entries(graph, order[:STARTS])


def distinct_points(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that first hold each distinct vector, and each row's vector, by number."""
    raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0]
    _, first, back = np.unique(raw, return_index=True, return_inverse=True)
    return first, back.ravel()


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Single-precision vectors of one length, in which the nearest to a query is the one of largest inner product."""
    top = np.abs(vectors).max() or 1.0
    scaled = vectors / top
    squares = (scaled**2).sum(axis=1)
    return np.concatenate([scaled, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = []
        for ids, raw in zip(batch.column(1), batch.column(2), strict=True):
            vectors = np.frombuffer(raw.as_buffer(), "<f8").reshape(len(ids.as_buffer()) // 8, -1)
            first, _ = distinct_points(vectors)
            graph, starts = build_graph(lengthened(vectors[first]))
            graphs.append(np.concatenate([[len(starts)], starts, graph.ravel()]).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(graphs, pa.binary())], ["shard", "ids", "vectors", "graph"])


def search_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, graph: np.ndarray, starts: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, vec_ids, scores) of each query's k best found in a shard, but for the query's own row."""
    first, back = distinct_points(vectors)
    points = lengthened(vectors[first])
    order = np.lexsort((ids, back))
    copies, sizes = np.searchsorted(back[order], np.arange(len(first))), np.bincount(back, minlength=len(first))
    top = np.abs(vectors).max() or 1.0
    for i in range(0, len(queries), TOGETHER):
        some = queries[i : i + TOGETHER]
        norms = np.maximum(np.sqrt(((some / top) ** 2).sum(axis=1)), 1e-300)[:, None]
        asked = np.concatenate([some / top / norms, np.zeros((len(some), 1))], axis=1).astype(np.float32)
        found, _ = beam_search(asked, points, graph, starts, beam)
        q, place = np.nonzero(found >= 0)
        point = found[q, place]
        scores = np.einsum("ij,ij->i", some[q], vectors[first[point]])
        best = np.lexsort((-scores, q))
        q, point, scores = q[best], point[best], scores[best]
        taken = np.minimum(sizes[point], k + 1)  # more copies of one vector cannot be among the k best
        rows = np.repeat(copies[point], taken) + np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
        q, scores, found_ids = np.repeat(q, taken), np.repeat(scores, taken), ids[order[rows]]
        other = found_ids != query_ids[i : i + TOGETHER][q]
        q, scores, found_ids = q[other], scores[other], found_ids[other]
        q, found_ids, scores = first_of_each(k, q, found_ids, scores)
        yield q + i, found_ids, scores


def _search(k: int, beam: int):
    def search(q_ids: pa.Buffer, q_vectors: pa.Buffer, shards: list[list[bytes | None]]) -> Iterator[pa.RecordBatch]:
        query_ids = np.frombuffer(q_ids, np.int64)
        queries = np.frombuffer(q_vectors, "<f8").reshape(len(query_ids), -1)
        parts = []
        for raw_ids, raw, raw_graph in shards:
            ids, graph = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_graph, "<i4").astype(np.int64)
            starts, edges = graph[1 : 1 + graph[0]], graph[1 + graph[0] :].reshape(-1, DEGREE)
            parts += search_shard(queries, query_ids, np.frombuffer(raw, "<f8").reshape(len(ids), -1), ids, edges, starts, k, beam)
        q, found, scores = first_of_each(k, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])

    return search


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = SEARCH_BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``, the k nearest others found.

    The nearest has the largest inner product, in double precision on the vectors as they are; ties go to the smaller
    vec_id.  Rows with a null vec_id, or a vector that is null, empty, all zero or holds null or non-finite
    components, take no part; vectors of another length than a query's are no candidates of it.  Repeated rows of
    one vec_id: the first by its components is used.  Every other row is indexed.  With fewer candidates than k,
    those found are returned; an empty table gives no rows.
    """
    beam = max(beam, k + 1)
    fine = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), also_zero=False)).groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min("embedding").alias("embedding"))
    fine = cut(fine.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.size("embedding").alias("width")))
    asked = F.col("id") % every == 0
    sizes = fine.groupBy("width").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect()
    out = None
    for width, n, q in sorted(sizes):
        if not q:
            continue
        rows = fine.where(F.col("width") == width)
        shards, blocks = -(-n // shard), -(-q // QUERIES)
        of = lambda count: F.pmod(F.xxhash64("id"), F.lit(count))
        index = cut(packed_blocks(rows.select("id", "vector", of(shards).alias("shard")), "<f8", "shard").repartition(shards, "shard").mapInArrow(_built, _GRAPH))
        queries = packed_blocks(rows.where(asked).select("id", "vector", of(blocks).alias("block")), "<f8", "block")
        found = search_in_place(index, shards, queries, _search(k, beam), _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return fine.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
