"""What the pipeline's stages hold at once, and how many files their rounds write."""

import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dupeloom.llm import lm, minhash
from dupeloom.llm.minhash import connected_components, shingle_set
from dupeloom.llm.packing import tokenizer_of
from dupeloom.operators import components

JSON = public_tokenizers.path("byte_bpe_50k.json")


def peak_mb(work):
    """What numpy and Python hold at most while ``work`` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def block(sets):
    members = [np.asarray([i, len(s), 0, 0], np.int64) for i, s in enumerate(sets)]
    return minhash._Block(np.stack(members).tobytes(), b"".join(s.tobytes() for s in sets))


def test_blocks_meet_in_bounded_memory():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 1 << 62, 30_000, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, 3000, replace=False)) for _ in range(400)]  # a shingle is in 40 of them, under FREQUENT
    one = block(sets)
    assert peak_mb(lambda: minhash._joining(one, one, 85, 30)) < 250
    sketches = rng.integers(0, 256, (minhash.CROWD, 16), dtype=np.uint8)
    keys = sorted(bytes(6) + rng.integers(0, 256, 10, dtype=np.uint8).tobytes() for _ in sketches)
    n = len(keys)
    crowd = pa.RecordBatch.from_pydict({"tree": [0] * n, "key": keys, "class": list(range(n)), "n": [100] * n, "sketch": [s.tobytes() for s in sketches]})
    assert peak_mb(lambda: list(minhash._candidates(0.8, 3, 30)(iter([crowd])))) < 100


def test_a_block_of_texts_is_scored_in_bounded_memory():
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(1, 1 << 62, 40_000, dtype=np.uint64))
    tokens, first = pool[(len(pool) * rng.random(lm.BLOCK) ** 3).astype(np.int64)], np.arange(0, lm.BLOCK, 300)
    asked = lm._Asked(tokens, first)
    grams = {1: np.unique(tokens, return_counts=True), 2: np.unique(asked.pairs, return_counts=True)}
    filter_ = lm.Filter({(kind, 0): lm.bloom_segment(*of).tobytes() for kind, of in grams.items()}, 1)
    hot = tuple(x[::2] for x in grams[1])
    ids = list(range(len(first)))

    def scored():
        block = lm._Asked(tokens, first)
        block.ask(filter_)
        return lm._block_rows(0, ids, [False] * len(ids), tokens, first, block.levels(), hot, 1, 1e6)

    assert (lm.expected_count(filter_.levels(2, grams[2][0]), 0.0) >= 1).all()  # in slices as in one
    assert peak_mb(scored) < 50


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_shared_shingles_are_counted_in_slices(monkeypatch, most):
    monkeypatch.setattr(minhash, "MOST_MET", most, raising=False)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 4000, rng.integers(1, 90), dtype=np.uint64)) for i in range(150)]  # some shingles are FREQUENT
    rows, columns = np.arange(10, 90), np.arange(40, 150)
    expected = [[len(np.intersect1d(sets[i], sets[k])) for k in columns] for i in rows]
    one = block(sets)
    assert minhash._shared(one, rows, one, columns).tolist() == expected


def test_a_worker_holds_the_tables_of_one_operator():
    shingle_set("one two three", 2)
    words = minhash._worker()[0]
    tokenizer_of(JSON)
    assert minhash._worker()[0] is not words
    table = tokenizer_of(JSON)[0]
    assert tokenizer_of(JSON)[0] is table
    assert shingle_set("one two three", 2).size == 2 and tokenizer_of(JSON)[0] is not table


def test_rounds_of_few_edges_are_written_by_few_tasks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
        found = connected_components(edges, "a", "b", few=20)
        assert found.rdd.getNumPartitions() == 1
        assert found.select("root").distinct().count() == 1 and found.count() == 201
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def files_of(spark, work):
    """The files that ``work`` leaves in the checkpoint folder, which is a local one."""
    components.ensure_checkpoint_dir(spark)
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {*top.rglob("*")}
    kept = work()  # else Spark's cleaner may take them
    return [p for p in top.rglob("*") if p.is_file() and p not in before], kept


def test_a_cut_makes_one_file_for_each_task(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files, out = files_of(spark, lambda: components.cut(spark.range(100, numPartitions=5)))
    assert len(files) == 5  # each one more is a process that shares the executor's memory until it begins
    assert out.count() == 100 and out.agg({"id": "sum"}).first()[0] == 4950
    assert conf.get("fs.file.impl") is None and conf.get("fs.file.impl.disable.cache") is None
    with pytest.raises(Exception, match="(?i)divi"):
        components.cut(spark.sql("select raise_error('divided') as x"))
    assert conf.get("fs.file.impl") is None
    conf.set("fs.file.impl", "org.apache.hadoop.fs.LocalFileSystem")
    try:
        files, out = files_of(spark, lambda: components.cut(spark.range(100, numPartitions=5)))
        assert len(files) == 10 and out.count() == 100 and conf.get("fs.file.impl").endswith(".LocalFileSystem")
    finally:
        conf.unset("fs.file.impl")


def test_what_has_a_row_for_each_class_is_written_by_few_tasks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        docs = spark.range(60).selectExpr("id as doc_id", "concat('a b c d e f g h i j k l m n o p q r s t u v w x y z ', id div 2) as text")
        files, out = files_of(spark, lambda: minhash.near_duplicates(docs, 3, 85).collect())
        assert len(out) == 60 and {r["component_id"] for r in out} == {0}
        assert len(files) <= 200
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
