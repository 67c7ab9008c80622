"""Vector searches against brute force."""

import numpy as np
import pytest

from dupeloom.llm.ann import nearest_neighbours
from dupeloom.llm.topk import best_of_shard, exact_top_k


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (50, [0.5, -1.0]), (100, [0.0, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [3.0, 0.1]), (60, [1.0, 2.0, 3.0])]
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")


def usable(vectors, zero):
    best = {}
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and (zero or any(r.embedding)):
            best[r.vec_id] = min(best.get(r.vec_id, r.embedding), r.embedding)
    return best


def brute_force(vectors, k, every, scaled):
    """[(query_id, rank, vec_id, score)] of the k best."""
    rows = {i: np.floor(256 * np.asarray(v, float)) if scaled else np.asarray(v, float) for i, v in vectors.items()}
    out = []
    for q, v in rows.items():
        if q % every == 0:
            scored = sorted((-float(v @ w), i) for i, w in rows.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_exact_top_k(spark, sf_dir, odd_vectors):
    for vectors in (spark.read.parquet(f"{sf_dir}/embeddings.parquet"), odd_vectors):
        got = sorted((r.query_id, r.rank, r.vec_id, float(r.score)) for r in exact_top_k(vectors).collect())
        assert got == brute_force(usable(vectors, True), 5, 50, True)
    many = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted((r.query_id, r.rank, r.vec_id, float(r.score)) for r in exact_top_k(many, shard=10).collect())
    assert got == brute_force(usable(many, True), 5, 50, True)  # some 50 shards, more than a task holds together
    assert exact_top_k(odd_vectors.where("false")).collect() == []
    wide = spark.createDataFrame([(0, [1e300, 3.0]), (1, [1e300, 1.0])], "vec_id long, embedding array<double>")
    assert exact_top_k(wide).first().score == (1 << 63) - 1
    huge = spark.createDataFrame([(0, [1e6, 3.0]), (1, [2e6, 1.0])], "vec_id long, embedding array<double>")
    assert exact_top_k(huge).first().score == 256**2 * (2 * 10**12 + 3)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_reading_stops_early_only_with_the_right_answer(spread):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 6)) * 100
    candidates = np.floor(centres[rng.integers(0, 9, 900)] + rng.normal(size=(900, 6)) * 100 * spread)
    queries, ids = candidates[:40], np.arange(900)
    found = [np.concatenate(x) for x in zip(*((q, c, s) for q, c, s, _ in best_of_shard(queries, candidates, ids[:40], ids, 5)), strict=True)]
    scores = queries @ candidates.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    for q in range(40):
        best = np.sort(scores[q])[::-1][:5]
        assert sorted(found[2][found[0] == q], reverse=True)[:5] == best.tolist()


def test_bounds_settle_the_queries(spark):
    """On the test vectors no query has to read its lists to their ends, and most stop at three quarters."""
    rows = usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), True)
    ids = np.asarray(sorted(rows))
    candidates = np.floor(256 * np.asarray([rows[i] for i in ids], float))
    asked = ids % 50 == 0
    read = np.concatenate([np.full(len(np.unique(q)), part) for q, _, _, part in best_of_shard(candidates[asked], candidates, ids[asked], ids, 5)])
    assert len(read) == asked.sum() and read.max() < 1 and (read <= 0.75).mean() > 0.5


def test_all_points_of_a_graph_are_found(spark):
    """Tight clusters far apart: a graph may fall to pieces, and with few candidates all are returned."""
    from dupeloom.llm.ann import beam_search, build_graph, entries, lengthened

    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(30, 8)) * 9)[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 8)) * 0.3
    points = lengthened(vectors)
    graph, starts = build_graph(points)
    found, _ = beam_search(points, points, graph, starts, 96)
    assert (found[:, 0] == np.arange(1500)).mean() > 0.98
    cut = np.full((9, 2), -1)
    cut[0, 0], cut[3, 0], cut[4, 0] = 1, 4, 3
    assert entries(cut, np.asarray([0])).tolist() == [0, 2, 3, 5, 6, 7, 8]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors[:19])]
    few = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 1)
    assert few.count() == 19 * 18


def test_recall_of_the_graphs(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    wanted = brute_force(usable(vectors, False), 20, 20, False)
    truth = {(q, i): s for q, _, i, s in wanted}
    for shard in (4096, 90):  # one shard, and more than a task holds together
        rows = nearest_neighbours(vectors, shard=shard).collect()
        assert len(rows) == len(truth)
        assert sum((r.query_id, r.vec_id) in truth for r in rows) / len(truth) >= 0.95
        assert all(abs(truth[r.query_id, r.vec_id] - r.score) < 1e-12 for r in rows if (r.query_id, r.vec_id) in truth)


def test_copies_and_odd_vectors(spark, odd_vectors):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(odd_vectors).collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute_force(usable(odd_vectors, False), 20, 20, False)]
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) / 8**0.5 if i % 3 == 0 else rng.normal(size=8)).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted = brute_force(dict(rows), 20, 60, False)
    got = {(r.query_id, r.rank): r.vec_id for r in nearest_neighbours(vectors, 20, 60).collect()}
    assert np.mean([got[q, n] == i for q, n, i, _ in wanted]) > 0.9
    assert nearest_neighbours(odd_vectors.where("false")).collect() == []


def test_recall_beside_a_crowd_of_near_copies(spark):
    """A third of the points are one vector with a little noise: searches must not be caught among them."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 32))
    vectors[::3] = vectors[0] + rng.normal(size=(1000, 32)) * 0.01
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = dict(enumerate(vectors.tolist()))
    wanted = brute_force(rows, 20, 50, False)
    truth = {(q, i) for q, _, i, _ in wanted}
    found = nearest_neighbours(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), 20, 50, shard=1000).collect()
    assert len(found) == len(truth) and sum((r.query_id, r.vec_id) in truth for r in found) / len(truth) >= 0.95
