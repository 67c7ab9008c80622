"""Connected components by hooking and contraction, with the lineage cut in every round."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task joins, and rows of a round's results that a task of it writes, if there are few.
FEW = 1 << 14

_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_raw_lock, _raw_users = threading.Lock(), [0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, but only if all of Spark is on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            wanted = tempfile.mkdtemp(prefix="dupeloom-checkpoint-")
            atexit.register(shutil.rmtree, wanted, True)
        context.setCheckpointDir(wanted)


@contextmanager
def _one_file_each(spark: SparkSession) -> Iterator[None]:
    """Within, a task's checkpoint in a local folder is one file, without one of checksums beside it.

    For each local file that it makes, Hadoop starts a ``chmod``, which shares the executor's whole memory until it
    begins.  Other stores, and a ``fs.file.impl`` of the user's own, are left alone.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    with _raw_lock:
        mine = spark.sparkContext.getCheckpointDir().startswith("file:") and (_raw_users[0] > 0 or not any(map(conf.get, _RAW)))
        if mine:
            _raw_users[0] += 1
            for k, v in _RAW.items():
                conf.set(k, v)
    try:
        yield
    finally:
        with _raw_lock:
            if mine:
                _raw_users[0] -= 1
                if not _raw_users[0]:
                    for k in _RAW:
                        conf.unset(k)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder: what follows neither recomputes it nor needs the executors that made it."""
    ensure_checkpoint_dir(df.sparkSession)
    with _one_file_each(df.sparkSession):
        return df.checkpoint(eager=True)


def cut_few(df: DataFrame, n: int) -> DataFrame:
    """``cut``, for at most about ``n`` rows: they are written by so many tasks, not by all that a shuffle has."""
    return cut(df.coalesce(max(1, -(-n // FEW))))


def cut_and_drop(df: DataFrame) -> DataFrame:
    """``cut``, for a result much smaller than what was shuffled for it: shuffle files go when the driver's garbage does, which is collected."""
    spark, out = df.sparkSession, cut(df)
    del df  # the plan that holds the shuffles
    for _ in range(2):  # Python lets go of plans first, and tells the JVM so from another thread; Spark keeps the last job's
        gc.collect()
        out.limit(1).count()
        time.sleep(0.5)
        spark._jvm.System.gc()
    return out


def unsized(df: DataFrame) -> DataFrame:
    """``df``, best a cut one, as a relation of unknown size, so that joins go by the bytes that shuffles measure.

    A size that Spark guesses from the columns of what ``df`` was made from can be a thousandth of the real one, where
    Python makes trees from numbers; a side that is thought small is then gathered on the driver to be broadcast.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of edges (a, b), all in one task: the first node of each component is its root."""
    parent: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    schema = None
    for batch in batches:
        schema = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(tuple(a.values())), find(tuple(b.values()))
            parent[max(a, b)] = min(a, b)
    if schema is not None:
        struct = lambda nodes: pa.array([dict(zip(("h", "id"), x, strict=True)) for x in nodes], schema)
        nodes = [*parent]
        yield pa.RecordBatch.from_arrays([struct(nodes), struct(map(find, nodes))], ["node", "root"])


def connected_components(edges: DataFrame, left: str, right: str, few: int = FEW) -> DataFrame:
    """node, root of every node that has an edge; the nodes of a component have one root among them.

    In each round every node hooks to that of itself and its neighbours which comes first, and what it hooked to is
    followed twice; edges move to where their ends came, and loops and repeats go.  Nodes come in the order of a hash:
    so a round leaves less than half of them, whatever the graph.  Minima are taken before rows meet, and a hub's
    edges meet its root by a join that adaptive execution splits.  At most ``few`` edges that are left, a fixed number,
    are joined in one task.  Edges with a null end are ignored; no edges give no rows.
    """
    kind = edges.schema[left].dataType
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    ordered = lambda d, a, b: d.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    now = cut(ordered(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(node(left).alias("x"), node(right).alias("y")), "x", "y"))
    hooks: list[tuple[DataFrame, int]] = []
    while n := now.count():
        if n <= few:
            of = now.schema["a"].dataType.simpleString()
            hooks.append((cut(now.coalesce(1).mapInArrow(_joined, f"node {of}, root {of}")), n))
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut_few(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), 2 * n)
        for _ in range(2):
            above = hook.select(F.col("node").alias("root"), F.col("root").alias("last")).where("root != last")
            hook = cut_few(hook.join(above, "root", "left").select("node", F.coalesce("last", "root").alias("root")), 2 * n)
        hooks.append((hook, 2 * n))
        moved = now.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        now = cut_few(ordered(moved, "ra", "rb"), n)
    if not hooks:
        return edges.select(F.col(left).cast(kind).alias("node"), F.col(left).cast(kind).alias("root")).where(F.lit(False))
    out, _ = hooks.pop()
    while hooks:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        hook, n = hooks.pop()
        out = cut_few(hook.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), n)
    return out.select("node.id", "root.id").toDF("node", "root")


def clusters(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: cluster_id, frag_id; summary: cluster_id, size, min_similarity, tier), from pairs (left_id, right_id, similarity, tier).

    A cluster is named by its smallest member; its tier is the weakest of its pairs.
    """
    roots = connected_components(pairs, "left_id", "right_id")
    named = roots.groupBy("root").agg(F.min("node").alias("cluster_id"))
    members = cut(roots.join(named, "root").select("cluster_id", F.col("node").alias("frag_id")))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    of_pairs = pairs.join(members.select("cluster_id", F.col("frag_id").alias("left_id")), "left_id").groupBy("cluster_id").agg(F.min("similarity").alias("min_similarity"), F.max(F.col("tier") == "similar").alias("weak"))
    return members, sizes.join(of_pairs, "cluster_id").select("cluster_id", "size", "min_similarity", F.when(F.col("weak"), "similar").otherwise("exact").alias("tier"))
