"""Duplicates put into a corpus on purpose, to measure how many of each kind a scan finds.

Functions are chosen from the corpus by a seeded order of hashes, changed as their kind says, and added to the end of
another file.  The corpus stays as it is: what is scanned is a relation of files in which some are longer.
"""

from __future__ import annotations

import ast
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .evaluate import precision_recall

#: Kinds of duplicates, and the least lines and statements of a function that is chosen. Fixed values.
TIERS = ("exact", "renamed", "restructured", "augmented", "semantic")
LEAST_LINES, LEAST_STATEMENTS = 12, 3

_CHOSEN = "file_path string, name string, start_line int, end_line int, text string"

#: Two ways to write the same function: {n} is a number, so that no two injected ones are alike.
SEMANTIC = (
    (
        "def gather_{n}(rows, limit):\n    found = []\n    seen = set()\n    for row in rows:\n        if row in seen:\n            continue\n        seen.add(row)\n        if row > limit + {n}:\n            found.append(row)\n    found.sort()\n    count = len(found)\n    return found, count\n",
        "def select_{n}(items, bound):\n    distinct = dict.fromkeys(items)\n    kept = [item for item in distinct if item > bound + {n}]\n    kept = sorted(kept)\n    size = 0\n    for _ in kept:\n        size += 1\n    result = (kept, size)\n    if not kept:\n        result = ([], 0)\n    return result\n",
    ),
    (
        "def fold_{n}(tree, start):\n    total = start\n    stack = [tree]\n    while stack:\n        node = stack.pop()\n        if node is None:\n            continue\n        total += node.value * {n}\n        stack.append(node.left)\n        stack.append(node.right)\n    report(total)\n    return total\n",
        "def walk_{n}(node, so_far):\n    if node is None:\n        return so_far\n    here = so_far + node.value * {n}\n    left = walk_{n}(node.left, here)\n    right = walk_{n}(node.right, left)\n    if right is None:\n        return left\n    if left is None:\n        return right\n    report(right)\n    return right\n",
    ),
    (
        "def parse_{n}(line):\n    parts = line.split(',')\n    record = {}\n    for part in parts:\n        key, _, value = part.partition('=')\n        key = key.strip()\n        if not key:\n            continue\n        record[key] = value.strip()\n    record['kind'] = {n}\n    check(record)\n    return record\n",
        "def read_{n}(text):\n    fields = (x.partition('=') for x in text.split(','))\n    out = {k.strip(): v.strip() for k, _, v in fields if k.strip()}\n    out.update(kind={n})\n    try:\n        check(out)\n    except ValueError:\n        raise\n    finally:\n        done(text)\n    if not out:\n        return {}\n    return out\n",
    ),
)


class _Renamer(ast.NodeTransformer):
    """Parameters and assigned names get new ones."""

    def __init__(self, function: ast.FunctionDef):
        names = [a.arg for a in ast.walk(function.args) if isinstance(a, ast.arg)]
        names += [n.id for n in ast.walk(function) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        kept = {n for x in ast.walk(function) if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
        kept |= {k.arg for x in ast.walk(function) if isinstance(x, ast.Call) for k in x.keywords if k.arg}
        self.new = {name: f"moved_{i}" for i, name in enumerate(dict.fromkeys(names)) if name not in kept}

    def visit_Name(self, node: ast.Name) -> ast.Name:
        node.id = self.new.get(node.id, node.id)
        return node

    def visit_arg(self, node: ast.arg) -> ast.arg:
        node.arg = self.new.get(node.arg, node.arg)
        return node


class _Restructurer(ast.NodeTransformer):
    """Branches change places, additions are written out, comparisons are turned round."""

    FLIPPED = {ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.LtE: ast.GtE, ast.GtE: ast.LtE, ast.Eq: ast.Eq, ast.NotEq: ast.NotEq}

    def visit_If(self, node: ast.If) -> ast.If:
        self.generic_visit(node)
        if node.orelse and not (len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If)):
            node.test = node.test.operand if isinstance(node.test, ast.UnaryOp) and isinstance(node.test.op, ast.Not) else ast.UnaryOp(ast.Not(), node.test)
            node.body, node.orelse = node.orelse, node.body
        return node

    def visit_AugAssign(self, node: ast.AugAssign) -> ast.stmt:
        self.generic_visit(node)
        if not isinstance(node.target, ast.Name):
            return node
        return ast.Assign([node.target], ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value))

    def visit_Compare(self, node: ast.Compare) -> ast.Compare:
        self.generic_visit(node)
        if len(node.ops) == 1 and type(node.ops[0]) in self.FLIPPED:
            node.left, node.comparators, node.ops = node.comparators[0], [node.left], [self.FLIPPED[type(node.ops[0])]()]
        return node


def mutated(text: str, tier: str, seed: int) -> str:
    """A function's text as a duplicate of a kind: as it is, with other names, another form, or more statements."""
    if tier == "exact":
        return text
    tree = ast.parse(text)
    function = tree.body[0]
    rng = random.Random(seed)
    if tier == "renamed":
        function.name = f"renamed_{seed % 100_000}"
        _Renamer(function).visit(function)
    elif tier == "restructured":
        _Restructurer().visit(function)
    elif tier == "augmented":
        body = []
        for i, statement in enumerate(function.body):
            body.append(statement)
            if i and not isinstance(statement, (ast.Return, ast.Raise)) and rng.random() < 0.7:
                body += ast.parse(f"note_{i} = observe({i}, {rng.randrange(100)})\nif note_{i}:\n    warn(note_{i}, 'step {i}')").body
        function.body = body
    else:
        raise ValueError(f"no such kind of duplicate: {tier}")
    return ast.unparse(ast.fix_missing_locations(tree)) + "\n"


def choosable(path: str, source: bytes) -> Iterator[tuple[str, str, int, int, str]]:
    """(path, name, first line, last line, text) of the top-level functions that are long enough and parse alone; lines from 0."""
    try:
        text = source.decode()
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = text.split("\n")
    for node in tree.body:
        if not isinstance(node, ast.FunctionDef) or node.end_lineno - node.lineno + 1 < LEAST_LINES or len(node.body) < LEAST_STATEMENTS or node.decorator_list:
            continue
        own = "\n".join(lines[node.lineno - 1 : node.end_lineno]) + "\n"
        try:
            ast.parse(own)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        yield path, node.name, node.lineno - 1, node.end_lineno - 1, own


def inject(files: DataFrame, per_tier: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(files with duplicates at their ends, manifest) of ``files`` (file_path, source, status).

    manifest: entry_id, tier, source_file, source_start, source_end, target_file, target_start, target_end; lines from 0.
    ``per_tier`` duplicates of each kind, each in a file of its own; fewer if the corpus has too few functions or files.
    """
    spark = files.sparkSession
    readable = files.where("status = 'ok' and source is not null")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in choosable(path, source)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], [x.split()[0] for x in _CHOSEN.split(", ")])

    functions = readable.select("file_path", "source").mapInArrow(chosen, _CHOSEN)
    first_of_file = Window.partitionBy("file_path").orderBy(F.xxhash64("name", "start_line", F.lit(seed)))
    one_each = functions.withColumn("place", F.row_number().over(first_of_file)).where("place = 1")
    plain = [t for t in TIERS if t != "semantic"]
    sources = one_each.orderBy(F.xxhash64("file_path", F.lit(seed)), "file_path").limit(per_tier * len(plain)).collect()  # as many as were asked for
    targets = readable.select("file_path").join(spark.createDataFrame([(r["file_path"],) for r in sources], "file_path string"), "file_path", "left_anti")
    targets = [r["file_path"] for r in targets.orderBy(F.xxhash64("file_path", F.lit(seed + 1)), "file_path").limit(len(sources) + 2 * per_tier).collect()]
    wanted: list[tuple] = []  # (entry, tier, source file, first, last, target file, text)
    for i, (r, target) in enumerate(zip(sources, targets, strict=False)):
        tier = plain[i % len(plain)]
        wanted.append((i, tier, r["file_path"], r["start_line"], r["end_line"], target, mutated(r["text"], tier, seed * 1000 + i)))
    spare = targets[len(wanted) :]
    for i, (one, two) in enumerate(zip(spare[::2], spare[1::2], strict=False)):
        left, right = (x.replace("{n}", str(seed + i)) for x in SEMANTIC[i % len(SEMANTIC)])
        wanted += [(1000 + i, "semantic source", None, None, None, one, left), (1000 + i, "semantic", one, None, None, two, right)]
    added = spark.createDataFrame(wanted, "entry int, tier string, source_file string, source_start int, source_end int, file_path string, text string")
    ends = F.regexp_count(F.decode("source", "UTF-8"), F.lit("\n"))
    joined = readable.join(added, "file_path").withColumns({"start": (ends + 3).cast("int"), "more": F.concat(F.lit("\n\n\n"), "text")})
    placed = joined.select("entry", "tier", "source_file", "source_start", "source_end", F.col("file_path").alias("target_file"), F.col("start").alias("target_start"), (F.col("start") + F.regexp_count("text", F.lit("\n")) - 1).cast("int").alias("target_end"))
    halves = placed.where("tier = 'semantic source'").select("entry", F.col("target_start").alias("s"), F.col("target_end").alias("e"))
    manifest = placed.where("tier <> 'semantic source'").join(halves, "entry", "left").select(F.concat("tier", F.lit(":"), "entry").alias("entry_id"), "tier", "source_file", F.coalesce("source_start", "s").alias("source_start"), F.coalesce("source_end", "e").alias("source_end"), "target_file", "target_start", "target_end")
    longer = joined.select("file_path", F.concat(F.col("source"), F.encode("more", "UTF-8")).alias("source"), "status")
    return files.join(added.select("file_path").distinct(), "file_path", "left_anti").select("file_path", "source", "status").unionByName(longer), manifest


def cluster_pairs(members: DataFrame, fragments: DataFrame) -> DataFrame:
    """pair_id, left_file, left_start, left_end, right_file, right_start, right_end: each two members of a cluster (cluster_id, frag_id)."""
    placed = members.join(fragments.select("frag_id", "file_path", "start_line", "end_line"), "frag_id")
    side = lambda s: placed.select("cluster_id", F.col("frag_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{n}") for c, n in (("file_path", "file"), ("start_line", "start"), ("end_line", "end"))])
    both = side("left").join(side("right"), "cluster_id").where("left_id < right_id")
    return both.select(F.concat("left_id", F.lit(":"), "right_id").alias("pair_id"), *[f"{s}_{n}" for s in ("left", "right") for n in ("file", "start", "end")])


def recall_of_injected(files: DataFrame, config: Config, per_tier: int = 10, seed: int = 42) -> DataFrame:
    """Precision, recall and F1 by kind of injected duplicate, of a scan of ``files`` with ``config``.

    Real duplicates of the corpus count as false positives, so precision says little.
    """
    from ..plans.scan import scan_files
    from .components import cut

    longer, manifest = inject(files, per_tier, seed)
    report = scan_files(longer, config)
    return precision_recall(cut(manifest), cluster_pairs(report.members, report.fragments))
