"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Each text becomes its set of word shingles, a digest of the set, and ``TREES`` short signatures of ``DEPTH``
   slots.  Equal sets are one class from here on.
2. Each tree sorts all classes by its signature.  Neighbours in that order that share a prefix of ``least_depth``
   slots are candidates: those ``REACH`` places apart, and in regions that hold more, each member's ``NEAREST`` by
   sketch, and the members that are nearest to the region's middle with all others.  A crowded region is taken
   apart by the next slot, and its parts again, for as long as they are crowded: its depth follows its members.
   Rows are dealt by ranges of the order, so a hot region spreads over tasks.
3. A candidate whose sketch is too far or whose size too different for the threshold cannot link or can so
   only with a chance of some 1e-6; the others are confirmed on full sets, which are made again from the
   texts of candidates alone.
4. Links are joined to components.
5. What is left are links between components within crowded regions, and regions that a task's end cuts.  Members are
   dealt in blocks in the order of their components, and blocks of different ones meet: first by sketch, which
   yields the components that may link at all; then, for those alone, by full sets, which travel with the block,
   once for each group of such components.  Blocks compare all their pairs and return only which components
   they join.  So every pair that shares a prefix is compared or already joined, and no pairs become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut_few
from .common import alone, cut, free_name

TREES, DEPTH = 16, 8
#: Places in a tree's order within which members of a region are candidates; a region of more than one more is crowded.
REACH = 3
#: Members next to the middle of a crowded region that are candidates of all others, and how many of the nearest by
#: sketch each member has as candidates, among at most CROWD that follow one another.  They join most members; the
#: rest of a crowded region's pairs follows by components.
MIDDLES, NEAREST, CROWD = 3, 8, 4096
#: Shingles of a block's sets (8 bytes each); a shingle that so many sets of a block hold is counted by a matrix product.
MOST_SHINGLES, FREQUENT = 1 << 21, 48
#: Rows of a matrix of pairs that are worked out at once, and the most shared shingles that are held as pairs of members.
ROWS, MOST_MET = 512, 1 << 20
#: Classes up to which a list of them is sent to the texts, not the texts to it.
FEW = 1 << 18
SLOTS = TREES * DEPTH

_SHINGLED = "row long, doc_id long, n_shingles long, digest binary, class long, sketch binary, trees array<binary>"
_FOUND = "a long, b long, region long, class long, n long, sketch binary"
_JOINED = "root_a long, root_b long"
_CROSSED = _JOINED + ", region long, block long, low long, high long, members binary, shingles binary"


class WordHashes(dict):
    """64-bit hashes of words; starts anew when full, which only costs time."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


@alone
@lru_cache(maxsize=1)
def _worker() -> tuple[WordHashes, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return WordHashes(), rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; all words as one if there are fewer; empty without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six ASCII spaces split
    hashes = np.fromiter(map(_worker()[0].__getitem__, words), np.uint64, len(words))
    if not len(hashes):
        return hashes
    size_here = min(size, len(hashes))
    total = np.full(len(hashes) - size_here + 1, size_here, np.uint64)
    for i in range(size_here):
        total = _mixed(total + hashes[i : len(hashes) - size_here + 1 + i])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each slot's hashes, mixed again."""
    factors = _worker()[1][:, None]
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (factors * shingles[None, i : i + 1024]).min(axis=1), out=least)
    return _mixed(least)


def _shingled(size: int):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, classes, sketches, trees = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text, size)
                counts.append(len(shingles))
                if not len(shingles):
                    for column in (digests, classes, sketches, trees):
                        column.append(None)
                    continue
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                slots = signature(shingles)
                keys = (slots >> np.uint64(48)).astype(">u2").tobytes()
                digests.append(digest)
                classes.append(int.from_bytes(digest[:8], "big", signed=True))
                sketches.append(np.packbits((slots & np.uint64(1)).astype(np.uint8)).tobytes())
                trees.append([keys[2 * DEPTH * t : 2 * DEPTH * (t + 1)] for t in range(TREES)])
            arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(trees, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_shingles", "digest", "class", "sketch", "trees"])

    return shingled


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


def _candidates(threshold: float, least_depth: int, most_bits: int):
    """Candidate pairs (a, b) of rows (tree, key, class, n, sketch) that come in a tree's order, and the members of regions of which these are not all."""

    def of_region(at: np.ndarray, sketches: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        bits = np.unpackbits(sketches[at], axis=1)
        middle = np.packbits((2 * bits.sum(axis=0) > len(at)).astype(np.uint8))
        near = at[np.argsort(_BITS[sketches[at] ^ middle].sum(axis=1), kind="stable")[:MIDDLES]]
        return [(np.full(len(at), c), at) for c in near]

    def in_crowd(at: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signs = np.unpackbits(sketches[at], axis=1).astype(np.float32) * 2 - 1
        k = min(NEAREST, len(at) - 1)
        near = []
        for i in range(0, len(at), ROWS):
            apart = signs[i : i + ROWS] @ -signs.T
            own = np.arange(len(apart))
            apart[own, i + own] = np.inf
            near.append(at[np.argpartition(apart, k - 1, axis=1)[:, :k].ravel()])
        return np.repeat(at, k), np.concatenate(near)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _in_runs(batches, least_depth):
            n = held.num_rows
            binary = lambda name, width: np.frombuffer(b"".join(held.column(name).to_pylist()), np.uint8).reshape(n, width)  # noqa: B023, E731
            keys = np.ascontiguousarray(binary("key", 2 * DEPTH)).view(">u2").astype(np.int64)
            keys = np.concatenate([held.column("tree").to_numpy().astype(np.int64)[:, None], keys], axis=1)
            sketches, sizes, classes = binary("sketch", SLOTS // 8), held.column("n").to_numpy(), held.column("class").to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            region = np.concatenate([[0], np.cumsum((keys[1:, : least_depth + 1] != keys[:-1, : least_depth + 1]).any(axis=1))])
            crowded = np.bincount(region)[region] > REACH + 1  # there the next is enough, for better candidates follow
            for reach in range(1, min(REACH, n - 1) + 1):
                at = np.flatnonzero((region[:-reach] == region[reach:]) & ((reach == 1) | ~crowded[:-reach]))
                found.append((at, at + reach))
            seen: set[tuple[int, int]] = set()
            for depth in range(least_depth, DEPTH + 1):
                change = np.flatnonzero((keys[1:, : depth + 1] != keys[:-1, : depth + 1]).any(axis=1)) + 1
                starts, ends = np.concatenate([[0], change]), np.concatenate([change, [n]])
                large = ends - starts > REACH + 1
                if not large.any():
                    break
                for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
                    if (a, b) not in seen:  # else this slot did not part it
                        seen.add((a, b))
                        found += of_region(np.arange(a, b), sketches)
                    if depth == least_depth:
                        found += [in_crowd(np.arange(i, min(i + CROWD, b)), sketches) for i in range(a, b, CROWD) if b - i > 1]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            fine = (a != b) & (small >= threshold * large - 1e-9) & (_BITS[sketches[a] ^ sketches[b]].sum(axis=1, dtype=np.int64) <= most_bits)
            a, b = classes[a[fine]], classes[b[fine]]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            left = np.flatnonzero(crowded | (region == 0) | (region == region[-1]))  # the first and the last may go on elsewhere
            codes = np.zeros(len(left), np.uint64)
            for slot in keys[left, : least_depth + 1].T:
                codes = _mixed(codes * np.uint64(1 << 16) + slot.astype(np.uint64))
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64()), *[none(len(both), pa.int64())] * 3, none(len(both), pa.binary())], _names(_FOUND))
            yield pa.RecordBatch.from_arrays([*[none(len(left), pa.int64())] * 2, pa.array(codes.view(np.int64)), pa.array(classes[left], pa.int64()), pa.array(sizes[left], pa.int64()), pa.array([x.tobytes() for x in sketches[left]], pa.binary())], _names(_FOUND))

    return pairs


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Blocks of rows (region, root, n, sketch, shingles or nulls) of one region, and whether one is all of its region.

    A block has at most CROWD rows, and MOST_SHINGLES or but one row.
    """
    held: pa.Table | None = None
    loose = None  # the region that may have rows elsewhere
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
        if held is None or not held.num_rows:
            continue
        regions, sizes = held.column(0).to_numpy(), held.column(2).to_numpy()
        loose = regions[0] if loose is None else loose
        weighed = np.zeros(len(sizes), np.int64) if held.column(4).null_count else sizes
        bounds = [0, *(np.flatnonzero(regions[1:] != regions[:-1]) + 1).tolist(), len(regions)]
        done = 0
        for a, b in pairwise(bounds):
            ends, at = [], a
            mass = np.cumsum(weighed[a:b])
            while at < b:
                below = mass[at - a - 1] if at > a else 0
                at = max(at + 1, min(at + CROWD, a + int(np.searchsorted(mass, below + MOST_SHINGLES, "right"))))
                ends.append(min(at, b))
            if b == len(regions):
                if batch is not None and len(ends) < 2:
                    break
                loose = regions[a]
            last = b == len(regions) and batch is not None  # there may be more of the last block
            for start, end in pairwise([a, *ends[: len(ends) - last]]):
                yield held.slice(start, end - start), bool(regions[a] != loose) and len(ends) == 1
            done = ends[-2] if last else b
        held = held.slice(done)


class _Block:
    """Members of a region: (root, n, sketch) as rows of numbers, and their sets, if they travel with them."""

    def __init__(self, members: bytes | pa.Buffer, shingles: bytes | pa.Buffer | None):
        self.members = np.frombuffer(members, np.int64).reshape(-1, 4)
        self.roots, self.sizes = self.members[:, 0], self.members[:, 1]
        self.sets = None if shingles is None else np.frombuffer(shingles, np.uint64)
        self.signs = np.unpackbits(np.ascontiguousarray(self.members[:, 2:]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def terms(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of some members, and the place of each one's member among them."""
        return np.concatenate([self.sets[self.first[i] : self.first[i + 1]] for i in rows.tolist()]), np.repeat(np.arange(len(rows)), self.sizes[rows])


def _slices(weights: np.ndarray, most: int, longest: int) -> Iterator[slice]:
    """Slices that follow one another, of at most ``longest`` places and of a weight of at most ``most``, or of one place."""
    total, at = np.cumsum(weights), 0
    while at < len(total):
        end = int(np.searchsorted(total, most + (total[at - 1] if at else 0), "right"))
        yield slice(at, at := max(at + 1, min(end, at + longest)))


def _shared(x: _Block, rows: np.ndarray, y: _Block, columns: np.ndarray) -> np.ndarray:
    """How many shingles each of some members of ``x`` shares with each of some of ``y``."""
    terms, owner = y.terms(columns)
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    known, df = terms[first], np.diff(np.append(first, len(terms)))
    del terms, order
    asked, asker = x.terms(rows)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    hit = known[at] == asked
    at, asker = at[hit], asker[hit]
    often = df[at] >= FREQUENT

    def having(some: np.ndarray) -> np.ndarray:
        """The members that have each of some shingles, one shingle's after the other's."""
        times = df[some]
        return owner[np.repeat(first[some] - np.cumsum(times) + times, times) + np.arange(times.sum())]

    few, who = at[~often], asker[~often]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for part in _slices(df[few], MOST_MET, len(few)):
        flat = np.repeat(who[part] * len(columns), df[few[part]]) + having(few[part])
        out += np.bincount(flat, minlength=out.size).reshape(out.shape)
    frequent = np.unique(at[often])
    for part in (frequent[s] for s in _slices(df[frequent], MOST_MET, 2048)):
        left, right = np.zeros((len(rows), len(part)), np.float32), np.zeros((len(part), len(columns)), np.float32)
        place = np.minimum(np.searchsorted(part, at), len(part) - 1)
        mine = part[place] == at
        left[asker[mine], place[mine]] = 1
        mine = np.repeat(np.arange(len(part)), df[part])
        right[mine, having(part)] = 1
        out += left @ right
    return out


def _joining(x: _Block, y: _Block, percent: int, most_bits: int) -> np.ndarray:
    """(root, root) that join all roots of two blocks that a pair joins: one that may link by sketch and size, or, with sets, that links."""
    roots, of = np.unique(np.concatenate([x.roots, y.roots]), return_inverse=True)
    of_x, of_y = of[: len(x.roots)], of[len(x.roots) :]
    label = np.arange(len(roots))
    for k in range(0, len(x.roots), ROWS):
        some = np.arange(k, min(k + ROWS, len(x.roots)))
        may = (x.signs[some] @ y.signs.T >= SLOTS - 2 * most_bits) & (label[of_x[some]][:, None] != label[of_y][None, :])
        small, large = np.minimum(x.sizes[some][:, None], y.sizes[None, :]), np.maximum(x.sizes[some][:, None], y.sizes[None, :])
        may &= 100 * small >= percent * large
        rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(rows):
            continue
        may = may[np.ix_(rows, columns)]
        if x.sets is not None:
            both = _shared(x, some[rows], y, columns)
            may &= 100 * both >= percent * (x.sizes[some[rows]][:, None] + y.sizes[columns][None, :] - both)
        for i, row in zip(some[rows].tolist(), may, strict=True):
            if row.any():
                group = np.unique(np.append(label[of_y[columns[row]]], label[of_x[i]]))
                if len(group) > 1:
                    label[np.isin(label, group)] = group[0]
    moved = np.flatnonzero(label != np.arange(len(roots)))
    return np.stack([roots[label[moved]], roots[moved]], axis=1)


def _crossed(percent: int, most_bits: int):
    """What joins within regions that are one block, and the blocks of the others, of rows in the order of region and root."""

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        none = lambda k, n: [pa.nulls(n, pa.int64())] * k
        for piece, alone in _pieces(batches):
            piece = piece.combine_chunks()
            sketches = np.frombuffer(b"".join(piece.column(3).to_pylist()), np.int64).reshape(-1, 2)
            roots = piece.column(1).to_numpy()
            members = np.concatenate([roots[:, None], piece.column(2).to_numpy()[:, None], sketches], axis=1).tobytes()
            sets = None if piece.column(4).null_count else b"".join(piece.column(4).to_pylist())
            if not alone:
                yield pa.RecordBatch.from_arrays([*none(2, 1), *[pa.array([int(v)], pa.int64()) for v in (piece.column(0)[0].as_py(), number, roots[0], roots[-1])], pa.array([members], pa.binary()), pa.array([sets], pa.binary())], _names(_CROSSED))
                number += 1
            elif roots[0] != roots[-1]:
                block = _Block(members, sets)
                pairs = _joining(block, block, percent, most_bits)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in pairs.T], *none(4, len(pairs)), *[pa.nulls(len(pairs), pa.binary())] * 2], _names(_CROSSED))

    return crossed


def _between(percent: int, most_bits: int):
    """What joins two groups of blocks, or one group with itself: rows (region, x, y, side, members, shingles) in their order; the first side is held, the other passes by."""

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        whole = lambda: _Block(b"".join(m for m, _ in held), None if held[0][1] is None else b"".join(s for _, s in held))

        def joined(one: _Block, two: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _joining(one, two, percent, most_bits).T], _names(_JOINED))

        for batch in batches:
            for *key, side, members, sets in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5), strict=True):
                if key != now:
                    if held and now[1] == now[2]:
                        yield joined(one := whole(), one)
                    now, held, block = key, [], None
                members, sets = members.as_buffer(), sets.as_buffer() if sets.is_valid else None
                if side == 0:
                    held.append((bytes(members), None if sets is None else bytes(sets)))
                else:
                    block = block or whole()
                    yield joined(block, _Block(members, sets))
        if held and now[1] == now[2]:
            yield joined(one := whole(), one)

    return between


def _across(crowd: DataFrame, percent: int, most_bits: int) -> DataFrame:
    """root_a, root_b, some more than once, that join the roots between which a pair of a region links, or may link where ``crowd`` (region, root, class, n, sketch, shingles) has no shingles.

    The blocks that tasks make of a region are put together, in their order, to groups of about CROWD rows and
    MOST_SHINGLES, however many tasks there were; groups of a region that hold different roots meet.
    """
    parts = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = crowd.repartitionByRange(parts, "region", "root", "class").sortWithinPartitions("region", "root", "class").select("region", "root", "n", "sketch", "shingles")
    crossed = cut(ordered.mapInArrow(_crossed(percent, most_bits), _CROSSED))
    blocks = crossed.where("block is not null")
    # a row for a block or for two groups: as many tasks as run at once write them, not all that a shuffle has
    few = lambda d: cut(d.coalesce(max(1, d.sparkSession.sparkContext.defaultParallelism)))
    weight = F.greatest(F.length("members") / (32 * CROWD), F.coalesce(F.length("shingles"), F.lit(0)) / (8 * MOST_SHINGLES))
    before = Window.partitionBy("region").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    weighed = blocks.select("region", "block", "low", "high", weight.alias("weight"))
    placed = few(weighed.select("region", "block", "low", "high", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0.0))).cast("long").alias("part")))
    groups = few(placed.groupBy("region", "part").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    # groups of one root meet those of others; mixed ones meet all and themselves; so none of the same root alone are paired
    mixed, pure = groups.where("low < high"), groups.where("low = high").select("region", "part", F.col("low").alias("root"))
    as_x, as_y = F.col("part").alias("x"), F.col("part").alias("y")
    of_mixed = mixed.select("region", as_x).join(mixed.select("region", as_y), "region").where("x <= y")
    with_pure = mixed.select("region", as_x).join(pure.select("region", as_y), "region")
    runs = pure.select("region", "root").distinct()
    apart = runs.select("region", F.col("root").alias("root_x")).join(runs.select("region", F.col("root").alias("root_y")), "region").where("root_x < root_y")
    of_pure = apart.join(pure.select("region", F.col("root").alias("root_x"), as_x), ["region", "root_x"]).join(pure.select("region", F.col("root").alias("root_y"), as_y), ["region", "root_y"])
    met = few(of_mixed.unionByName(with_pure).unionByName(of_pure.select("region", "x", "y")))
    side = lambda n, c: met.where("x < y" if n else "true").join(placed.select("region", F.col("part").alias(c), "block"), ["region", c]).select("region", "x", "y", F.lit(n).alias("side"), "block")
    sent = side(0, "x").unionByName(side(1, "y")).join(blocks.select("block", "members", "shingles"), "block")
    in_order = sent.repartition(parts, "region", "x", "y").sortWithinPartitions("region", "x", "y", "side", "block").select("region", "x", "y", "side", "members", "shingles")
    far = in_order.mapInArrow(_between(percent, most_bits), _JOINED)
    return crossed.where("root_a is not null").select("root_a", "root_b").unionByName(far)


def _in_runs(batches: Iterator[pa.RecordBatch], least_depth: int, most: int = 20_000) -> Iterator[pa.Table]:
    """The rows in tables that end between regions, or after ``most`` rows; then the last rows begin the next one too."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest.num_rows < most // 4:
            continue
        prefix = 2 * least_depth
        tail = rest.column("key").slice(max(0, rest.num_rows - most)).to_pylist()
        k = len(tail) - 1
        while k > 0 and tail[k - 1][:prefix] == tail[-1][:prefix]:
            k -= 1
        start = rest.num_rows - len(tail) + k
        if start == 0 and rest.num_rows < most:
            continue
        if start == 0:
            yield rest.combine_chunks()
            rest = rest.slice(rest.num_rows - REACH)
        else:
            yield rest.slice(0, start).combine_chunks()
            rest = rest.slice(start)
    if rest is not None:
        yield rest.combine_chunks()


def _confirmed(percent_of_union: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent_of_union * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["class", "shingles"])

    return sets


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, least_depth: int = 3) -> DataFrame:
    """row, doc_id, n_shingles, component_id, survivor of each row of ``docs`` (doc_id, text).

    Two documents link if 100 * (size of the sets' intersection) >= ``percent`` * (size of their union), for sets
    of shingles of ``shingle`` words.  component_id is the smallest doc_id that links reach; row is a hash of the
    row's doc_id and text; survivor marks the rows of one (doc_id, text) in each component: the smallest doc_id.

    Without words (null and empty texts) a set is empty and links with nothing: component_id is the doc_id and
    the row survives.  A null doc_id stays null and counts last; repeated rows are alike; an empty table gives
    no rows; other columns are ignored.  Nothing is gathered by group: classes, pairs and links are rows.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    apart = (1 - threshold) / 2 * SLOTS
    most_bits = int(apart + 4.8 * (apart * (1 - apart / SLOTS)) ** 0.5)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    rows = cut(base.mapInArrow(_shingled(shingle), _SHINGLED))
    classes = cut(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("trees").alias("trees")))
    n_classes = classes.count()  # what has a row for each class is written by so many tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = classes.select(F.posexplode("trees").alias("tree", "key"), "class", "n", "sketch")
    ordered = forest.repartitionByRange(parts, "tree", "key", "class").sortWithinPartitions("tree", "key", "class")
    found = cut(ordered.mapInArrow(_candidates(threshold, least_depth, most_bits), _FOUND))
    pairs = cut(found.where("a is not null").select("a", "b").distinct())

    def sets_of(wanted: DataFrame, few: bool) -> DataFrame:
        rows_of = classes.select("row", "class").join(wanted, "class", "left_semi")
        texts = base.join(F.broadcast(rows_of) if few else rows_of, "row").select("class", "text")
        return cut(texts.mapInArrow(_sets(shingle), "class long, shingles binary").dropDuplicates(["class"]))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long")

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = sets_of(ends(pairs), False)
    roots = cut_few(connected_components(confirmed(pairs, sets), "a", "b").select(F.col("node").alias("class"), "root"), n_classes)
    of_root = cut_few(classes.select("class", "least_id", "n", "sketch").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), n_classes)
    crowd = found.where("class is not null").select("region", "class").join(of_root, "class")
    may_link = _across(crowd.select("region", "root", "class", "n", "sketch", F.lit(None).cast("binary").alias("shingles")), percent, most_bits)
    groups = cut_few(connected_components(may_link, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("region")), n_classes)
    open_ = cut(of_root.join(groups, "root").select("region", "root", "class", "n", "sketch"))
    more = cut_few(open_.select("class").join(sets, "class", "left_anti"), n_classes)
    n_more = more.count()
    if n_more:
        sets = sets.unionByName(sets_of(more, n_more <= FEW))
    links = _across(open_.join(sets, "class"), percent, most_bits)
    last = cut_few(connected_components(links, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("last")), n_classes)
    rooted = of_root.join(last, "root", "left").select("class", "least_id", F.coalesce("last", "root").alias("root"))
    of_class = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).where("class is not null")
    rooted = cut_few(rooted.join(of_class, "class"), n_classes)
    heads = cut_few(rooted.groupBy("root").agg(F.min("first").alias("head")), n_classes)  # minima are taken before rows meet
    labelled = cut(rooted.select("class", "root").join(heads, "root").select("class", "head"))
    found = rows.drop("sketch", "trees", "digest").join(labelled, "class", "left")
    empty = F.col("class").isNull()
    return found.select("row", "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), (empty | (F.col("row") == F.col("head.row"))).alias("survivor"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` lets survive, with all their columns: one of each component, and all without words."""
    key = free_name(docs, "row")
    found = near_duplicates(docs, shingle, percent).where("survivor").select(F.col("row").alias(key), (F.col("n_shingles") == 0).alias("wordless"))
    chosen = cut(found.groupBy(key).agg(F.max("wordless").alias("wordless"), F.count("*").alias("n")))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    repeated = chosen.where("n > 1 and not wordless").select(key)
    kept = keyed.join(chosen.select(key), key, "left_semi")
    if not repeated.isEmpty():  # only rows that occur more than once have to meet
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
