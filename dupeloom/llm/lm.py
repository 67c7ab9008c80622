"""Language-model scores from a log-frequency Bloom filter.

Counting: each task sums its own words and word pairs and sends one sorted block of hashes and counts for each
bucket of the hash space.  A bucket's blocks come to one task in order and are merged as they come, so it holds the
bucket's distinct n-grams and a few blocks.  There is a bucket for each BUCKET_BYTES of text.  Each bucket also
makes its segment of the Bloom filter: an n-gram counted c times is entered once for each level 1 to
1 + floor(log2 c), so its level is found by asking for level after level, and level 0 is what was never counted.
Segments are broadcast to the workers in parts of at most ``most_bytes``.  With more than one part, a task holds
some blocks of texts and asks one part after the other, of which it holds one at a time: texts pass once.  With more
than ``most_parts``, the filter is not sent around any more: what a block asks, each n-gram once, goes to the task that
holds its segment, and the levels come back to the block.

Exact base scores: the most frequent words of each bucket, ``hot_words`` in all, are broadcast with their counts;
all others go, block by block, to their bucket, and come back as sums for each document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .minhash import WordHashes, _mixed

#: No word has white space, so these stand for no word.
END, START = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b" ")
#: Tokens that a task counts before it sends them on, and scores at once.
FLUSH, BLOCK = 2_000_000, 600_000
#: Text for which there is a bucket, the fewest and the most buckets, and entries that are held before they are merged.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, HELD = 8 << 20, 16, 1 << 16, 4_000_000
#: Tokens whose levels a task looks up together if the filter has more than one part, and n-grams that are looked up at once.
TOGETHER, ASKED = 3_000_000, 1 << 16
#: Of what was never counted, one in 200 is taken for counted: (1 - exp(-5 / 12)) ** 5.
BITS_PER_ENTRY, PROBES = 12, 5
#: Weight of the prior in a pair's probability (of the powers of two times 25, about the best for held-out texts of the test tables), and what the count of an unseen word is taken for.
PRIOR, SELDOM = 200.0, 0.5

_ASKS = "block long, kind int, bucket int, ids binary, held binary, first binary, payload binary"
_LEVELS = "block long, kind int, bucket int, payload binary"
_COUNTS = "kind int, bucket int, hashes binary, counts binary"
_TABLE = "kind int, bucket int, n long, total long, hashes binary, counts binary, hot_hashes binary, hot_counts binary, bits binary"
_SCORED = "block long, slot int, doc_id long, held_out boolean, n_tokens long, score double, base_score double, n_known long, bucket int, hashes binary, owners binary, times binary"
_PARTS = "block long, slots binary, sums binary, known binary"
_FINAL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@lru_cache(maxsize=1)
def _words() -> WordHashes:
    return WordHashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words with A-Z in lower case, and of the end."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """48-bit hashes of word pairs, in the upper bits."""
    return _mixed(_mixed(before) + word) & ~np.uint64(0xFFFF)


def _before(tokens: np.ndarray) -> np.ndarray:
    """What stands before each token, a start before the first; in whole numbers, for a Python int beside them can make doubles."""
    return np.concatenate([np.asarray([START], np.uint64), tokens[:-1]])


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Byte by byte, most significant first: of sorted numbers, what is alike stands together and compresses."""
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _summed(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and their summed counts."""
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(buckets: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def sent() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            before = _before(tokens)
            before[np.flatnonzero(before == END)] = START
            for kind, grams in ((1, tokens), (2, pair_hashes(before, tokens))):
                hashes, counts = _summed(grams)
                ends = np.searchsorted(_bucket_of(hashes, buckets), np.arange(buckets + 1))
                some = [b for b in range(buckets) if ends[b] < ends[b + 1]]
                for i in range(0, len(some), 64):
                    part = some[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([_planes(hashes[ends[b] : ends[b + 1]]) for b in part], pa.binary()), pa.array([counts[ends[b] : ends[b + 1]].astype("<u4").tobytes() for b in part], pa.binary())],
                        ["kind", "bucket", "hashes", "counts"],
                    )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(token_hashes(text))
                n += len(held[-1])
                if n >= FLUSH:
                    yield from sent()
                    held, n = [], 0
        if held:
            yield from sent()

    return counted


def _probes(hashes: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of n-grams at a level, in filters of ``size`` bits."""
    one = _mixed(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    two = (one >> np.uint64(32)) | np.uint64(1)
    one = one & np.uint64(0xFFFFFFFF)
    for i in range(PROBES):
        yield (one + np.uint64(i) * two) % size


def bloom_segment(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of the filter that holds 1 + floor(log2(count)) of each hash."""
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    entries = int(levels.sum())
    if not entries:
        return np.zeros(0, np.uint8)
    size = -(-entries * BITS_PER_ENTRY // 8) * 8
    bits = np.zeros(size, np.bool_)
    for level in range(1, int(levels.max()) + 1):
        for at in _probes(hashes[levels >= level], level, np.uint64(size)):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Some of a filter's segments, by kind and bucket."""

    def __init__(self, segments: dict[tuple[int, int], bytes], buckets: int):
        self.buckets = buckets
        self.bytes = np.frombuffer(b"".join(segments.values()) or b"\0", np.uint8)
        self.starts, self.sizes = np.zeros(2 * buckets, np.uint64), np.zeros(2 * buckets, np.uint64)
        at = 0
        for (kind, bucket), raw in segments.items():
            self.starts[(kind - 1) * buckets + bucket], self.sizes[(kind - 1) * buckets + bucket] = 8 * at, 8 * len(raw)
            at += len(raw)

    def levels(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """The level of each hash: 0 if it is not in these segments."""
        return np.concatenate([np.zeros(0, np.uint8), *(self._levels(kind, hashes[i : i + ASKED]) for i in range(0, len(hashes), ASKED))])

    def _levels(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        where = (kind - 1) * self.buckets + _bucket_of(hashes, self.buckets)
        out = np.zeros(len(hashes), np.uint8)
        here = np.flatnonzero(self.sizes[where])
        for level in range(1, 64):
            if not len(here):
                break
            start, size, asked = self.starts[where[here]], self.sizes[where[here]], hashes[here]
            ok = np.arange(len(here))
            for at in _probes(asked, level, size):
                at = (start[ok] + at[ok]).astype(np.int64)
                ok = ok[(self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            here = here[ok]
            out[here] = level
        return out


def expected_count(levels: np.ndarray, seldom: float) -> np.ndarray:
    """The middle, by ratio, of the counts that a level stands for: 1 at level 1, 2 and 3 at level 2; ``seldom`` at 0, the unseen."""
    return np.where(levels > 1, np.sqrt(2.0) * 2.0 ** (levels - 1.0) - 0.5, np.where(levels == 1, 1.0, seldom))


def _merged(hot_each: int):
    """A row of _TABLE for each kind and bucket, of blocks that come in their order."""

    def finished(key: tuple[int, int], held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, counts = held[0] if len(held) == 1 else _summed(*map(np.concatenate, zip(*held, strict=True)))
        kind, bucket = key
        row = {"kind": kind, "bucket": bucket, "n": len(hashes), "total": int(counts.sum()), "bits": bloom_segment(hashes, counts).tobytes()}
        if kind == 1:
            hot = np.sort(np.lexsort((hashes, -counts))[:hot_each])
            cold = np.setdiff1d(np.arange(len(hashes)), hot, assume_unique=True)
            row |= {"hashes": hashes[cold].tobytes(), "counts": counts[cold].tobytes(), "hot_hashes": hashes[hot].tobytes(), "hot_counts": counts[hot].tobytes()}
        return pa.RecordBatch.from_pylist([row], _schema(_TABLE))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, fresh = None, [], 0
        for batch in batches:
            for kind, bucket, hashes, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                key = kind.as_py(), bucket.as_py()
                if key != now:
                    if held:
                        yield finished(now, held)
                    now, held, fresh = key, [], 0
                held.append((_numbers(hashes.as_buffer()), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)))
                fresh += len(held[-1][0])
                if fresh >= HELD:
                    held, fresh = [_summed(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            yield finished(now, held)

    return merged


def _schema(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in ddl.split(", "))])


class _Asked:
    """What a block of texts asks of the filter: its distinct words and its pairs, and the levels found so far."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray):
        before = _before(tokens)
        before[first] = START
        self.first, self.pairs = first, pair_hashes(before, tokens)
        self.words, back = np.unique(tokens, return_inverse=True)
        self.back = back.astype(np.uint32)
        self.own, self.pair, self.start = np.zeros(len(self.words), np.uint8), np.zeros(len(tokens), np.uint8), 0

    def ask(self, part: Filter) -> None:
        """Adds the levels of one part: what another part holds is 0 in it."""
        self.own += part.levels(1, self.words)
        self.pair += part.levels(2, self.pairs)
        self.start += int(part.levels(1, np.asarray([END], np.uint64))[0])  # as many starts as ends

    def levels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels of each token, of what stands before it, and of the pair."""
        own = self.own[self.back]
        previous = np.concatenate([[0], own[:-1]]).astype(np.uint8)
        previous[self.first] = self.start
        return own, previous, self.pair


def _all_asked(blocks: Iterator[tuple], parts: list[Broadcast]) -> Iterator[tuple]:
    """The blocks (rows, tokens, first) with all their levels; of several parts a worker holds one at a time."""
    held: list[tuple] = []

    def answered() -> Iterator[tuple]:
        for part in parts:
            filter_ = part.value
            for *_, asked in held:
                asked.ask(filter_)
            if len(parts) > 1:
                del filter_, part._value  # it is read again from the worker's copy
        yield from held
        held.clear()

    n = 0
    for rows, tokens, first in blocks:
        held.append((rows, tokens, first, _Asked(tokens, first)))
        n += len(tokens)
        if len(parts) == 1 or n >= TOGETHER:
            yield from answered()
            n = 0
    yield from answered()


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, without the texts, with about BLOCK tokens, their tokens, and where each text's begin."""
    for batch in batches:
        held, start, n = [], 0, 0
        texts = batch.column(text_at)
        batch = batch.select([i for i in range(batch.num_columns) if i != text_at])
        for i in range(batch.num_rows):
            held.append(token_hashes(texts[i].as_py()))
            n += len(held[-1])
            if n >= BLOCK or i == batch.num_rows - 1:
                sizes = np.asarray([len(x) for x in held])
                block = batch.slice(start, i + 1 - start), np.concatenate(held), np.cumsum(sizes) - sizes
                held, start, n = [], i + 1, 0
                yield block


def _block_rows(block: int, ids: list, held: list, tokens: np.ndarray, first: np.ndarray, levels: tuple[np.ndarray, ...], hot: tuple[np.ndarray, np.ndarray], buckets: int, below: float) -> pa.RecordBatch:
    """Rows of _SCORED of a block: one for each text, with its score and what the hot words give to the base score, and one for each bucket that is asked for the rest."""
    hot_hashes, hot_counts = hot
    before, pair = expected_count(levels[1], SELDOM), expected_count(levels[2], 0.0)
    prior = (expected_count(levels[0], SELDOM) + 0.1) / below if below > 0 else np.ones(len(tokens))
    chance = np.add.reduceat(np.log10((pair + PRIOR * prior) / (np.maximum(before, pair) + PRIOR)), first)
    del before, pair, prior  # a block's numbers are let go once they are summed
    ends = np.concatenate([first[1:], [len(tokens)]])
    at = np.minimum(np.searchsorted(hot_hashes, tokens), max(0, len(hot_hashes) - 1))
    is_hot = hot_hashes[at] == tokens if len(hot_hashes) else np.zeros(len(tokens), np.bool_)
    known = np.add.reduceat(np.where(is_hot, np.log10((hot_counts[at] + 0.1) / below), 0.0) if len(hot_hashes) else np.zeros(len(tokens)), first)
    n_known = np.add.reduceat(is_hot.astype(np.int64), first)
    del at
    owner = np.repeat(np.arange(len(first), dtype=np.uint32), ends - first)
    cold = np.flatnonzero(~is_hot)
    order = cold[np.lexsort((owner[cold], tokens[cold]))]
    del cold, is_hot
    new = np.flatnonzero(np.concatenate([[True], (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1])])) if len(order) else np.zeros(0, np.int64)
    times, order = np.diff(np.concatenate([new, [len(order)]])), order[new]
    places = np.searchsorted(_bucket_of(tokens[order], buckets), np.arange(buckets + 1))
    some = [b for b in range(buckets) if places[b] < places[b + 1]]
    n, m = len(first), len(some)
    cut_out = lambda x, kind: [x[places[b] : places[b + 1]].astype(kind).tobytes() for b in some]
    none = lambda k: [None] * k
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (n + m), pa.int64()),
            pa.array([*range(n), *none(m)], pa.int32()),
            pa.array(ids + none(m), pa.int64()),
            pa.array(held + none(m), pa.bool_()),
            pa.array([*(ends - first).tolist(), *none(m)], pa.int64()),
            pa.array([*chance.tolist(), *none(m)], pa.float64()),
            pa.array([*known.tolist(), *none(m)], pa.float64()),
            pa.array([*n_known.tolist(), *none(m)], pa.int64()),
            pa.array([*none(n), *some], pa.int32()),
            pa.array(none(n) + cut_out(tokens[order], "<u8"), pa.binary()),
            pa.array(none(n) + cut_out(owner[order], "<u4"), pa.binary()),
            pa.array(none(n) + cut_out(times, "<u4"), pa.binary()),
        ],
        [x.split()[0] for x in _SCORED.split(", ")],
    )


def _scored(parts: list[Broadcast], hot: Broadcast, buckets: int, below: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows, tokens, first, asked in _all_asked(_blocks(batches, 2), parts):
            yield _block_rows(block, rows.column(0).to_pylist(), rows.column(1).to_pylist(), tokens, first, asked.levels(), hot.value, buckets, below)
            block += 1

    return scored


def _asking(buckets: int):
    """Each block of texts, as kind 0, and its distinct words and pairs, in order, for each bucket."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows, tokens, first in _blocks(batches, 2):
            ids, asked = rows.column(0), _Asked(tokens, first)
            flags = np.asarray([2 * (i is None) + h for i, h in zip(ids.to_pylist(), rows.column(1).to_pylist(), strict=True)], np.uint8)
            out = [(block, 0, -1, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), flags.tobytes(), first.astype("<i8").tobytes(), tokens.tobytes())]
            for kind, grams in ((1, asked.words), (2, np.unique(asked.pairs))):
                ends = np.searchsorted(_bucket_of(grams, buckets), np.arange(buckets + 1))
                out += [(block, kind, b, None, None, None, grams[ends[b] : ends[b + 1]].tobytes()) for b in range(buckets) if ends[b] < ends[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _schema(_ASKS).types, strict=True)], schema=_schema(_ASKS))
            block += 1

    return asking


def _answering(buckets: int):
    """Levels of what blocks ask: rows (bucket, kind, block, payload) in their order, a segment (block null) before those that ask it."""

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segment = None, Filter({}, buckets)
        for batch in batches:
            out = []
            for bucket, kind, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (bucket, kind) != at:
                    at, segment = (bucket, kind), Filter({}, buckets)
                if block is None:
                    segment = Filter({(kind, bucket): bytes(payload.as_buffer())}, buckets)
                else:
                    out.append((block, kind, bucket, segment.levels(kind, np.frombuffer(payload.as_buffer(), np.uint64)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _schema(_LEVELS).types, strict=True)], schema=_schema(_LEVELS))

    return answering


def _assembled(hot: Broadcast, buckets: int, below: float):
    """Scores of blocks: rows (block, kind, bucket, ids, held, first, payload) in their order, a block before its levels."""

    def finished(own: tuple, levels: dict[int, list[bytes]]) -> pa.RecordBatch:
        block, ids, flags, first, tokens = own
        asked = _Asked(tokens, first)
        distinct, back = np.unique(asked.pairs, return_inverse=True)
        asked.own = np.frombuffer(b"".join(levels[1]), np.uint8)
        asked.pair = np.frombuffer(b"".join(levels[2]), np.uint8)[back]
        asked.start = int(asked.own[np.searchsorted(asked.words, np.uint64(END))])
        return _block_rows(block, [None if f > 1 else i for i, f in zip(ids.tolist(), flags.tolist(), strict=True)], [bool(f & 1) for f in flags.tolist()], tokens, first, asked.levels(), hot.value, buckets, below)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, levels = None, {1: [], 2: []}
        for batch in batches:
            for block, kind, ids, held, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in range(3, 7)), strict=True):
                raw = bytes(payload.as_buffer())
                if kind:
                    levels[kind].append(raw)
                    continue
                if own is not None:
                    yield finished(own, levels)
                own = (block, np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(held.as_py(), np.uint8), np.frombuffer(first.as_py(), "<i8"), np.frombuffer(raw, np.uint64))
                levels = {1: [], 2: []}
        if own is not None:
            yield finished(own, levels)

    return assembled


def _routed(rows: DataFrame, table: DataFrame, hot: Broadcast, buckets: int, below: float) -> DataFrame:
    """What ``_scored`` gives, with the filter's segments left in their tasks: n-grams travel."""
    asks = cut(rows.mapInArrow(_asking(buckets), _ASKS))
    segments = table.select("bucket", "kind", F.lit(None).cast("long").alias("block"), F.col("bits").alias("payload"))
    met = segments.unionByName(asks.where("kind > 0").select("bucket", "kind", "block", "payload"))
    in_order = met.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", F.col("block").asc_nulls_first())
    levels = in_order.mapInArrow(_answering(buckets), _LEVELS)
    none = F.lit(None).cast("binary")
    back = asks.where("kind = 0").unionByName(levels.select("block", "kind", "bucket", none.alias("ids"), none.alias("held"), none.alias("first"), "payload"))
    blocks = max(1, asks.where("kind = 0").count())
    together = back.repartition(min(blocks, 4 * buckets), "block").sortWithinPartitions("block", "kind", "bucket")
    return together.mapInArrow(_assembled(hot, buckets, below), _SCORED)


def _looked_up(below: float):
    def looked_up(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(table["hashes"].iloc[0], np.uint64) if len(table) else np.zeros(0, np.uint64)
        counts = np.frombuffer(table["counts"].iloc[0], np.int64) if len(table) else np.zeros(0, np.int64)
        out = []
        for block, tokens, owners, times in zip(asked["block"], asked["hashes"], asked["owners"], asked["times"], strict=True):
            tokens, owners, times = np.frombuffer(tokens, np.uint64), np.frombuffer(owners, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            at = np.searchsorted(hashes, tokens)
            inside = np.minimum(at, max(0, len(hashes) - 1))
            count = np.where(hashes[inside] == tokens, counts[inside], 0) if len(hashes) else np.zeros(len(tokens), np.int64)
            slots, back = np.unique(owners, return_inverse=True)
            sums = np.bincount(back, times * np.log10((count + 0.1) / below))
            known = np.bincount(back, times * (count > 0)).astype(np.int64)
            out.append((block, slots.astype("<u4").tobytes(), sums.tobytes(), known.tobytes()))
        return pd.DataFrame(out, columns=["block", "slots", "sums", "known"])

    return looked_up


def _finished(n_train: int):
    def finished(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", ignore_index=True)
        sums, known = rows["base_score"].to_numpy().copy(), rows["n_known"].to_numpy().copy()
        for slots, more, found in zip(parts["slots"], parts["sums"], parts["known"], strict=True):
            slots = np.frombuffer(slots, "<u4")
            sums[slots] += np.frombuffer(more, np.float64)
            known[slots] += np.frombuffer(found, np.int64)
        return rows.assign(base_score=sums, n_known=known, train_tokens=n_train)[[x.split()[0] for x in _FINAL.split(", ")]]

    return finished


def score_documents(docs: DataFrame, fold: int = 10, hot_words: int = 1 << 19, most_bytes: int = 64 << 20, buckets: int | None = None, most_parts: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id as text) mod ``fold`` is 0 are held out; the others are counted.  score is the sum of
    log10 of (pair's count + PRIOR * p(word)) / (count before + PRIOR) with counts as the filter has them.
    A null text counts as empty: one token, the end.  A null doc_id counts as empty text, so is held out, and
    stays null; repeated rows count and are returned each; an empty table gives no rows; without training rows
    N and V are 0 and base scores 0.  Other columns are ignored.  ``buckets`` (a power of two) follows the bytes of
    text; what is broadcast is at most ``most_parts`` times ``most_bytes`` of filter and ``hot_words`` counts.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    fold_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of == 0).alias("held_out"), "text")
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
        buckets = 1 << math.ceil(math.log2(min(MOST_BUCKETS, max(LEAST_BUCKETS, size / BUCKET_BYTES))))
    counts = rows.where(~F.col("held_out")).select("text").mapInArrow(_counted(buckets), _COUNTS)
    ordered = counts.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket")
    table = cut(ordered.mapInArrow(_merged(max(1, hot_words // buckets)), _TABLE))
    sums = table.where("kind = 1").agg(F.sum("n"), F.sum("total")).first()
    n_words, n_train = int(sums[0] or 0), int(sums[1] or 0)
    below = n_train + 0.1 * (n_words + 1)
    hot = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)) for h, c in table.where("kind = 1").select("hot_hashes", "hot_counts").collect()]
    hashes = np.concatenate([h for h, _ in hot]) if hot else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    hot_table = context.broadcast((hashes[order], np.concatenate([c for _, c in hot])[order] if hot else np.zeros(0, np.int64)))
    if (table.agg(F.sum(F.length("bits"))).first()[0] or 0) > most_parts * most_bytes:
        scored = cut(_routed(rows, table, hot_table, buckets, below))
    else:
        parts, part, size = [], {}, 0
        for kind, bucket, raw in table.where(F.length("bits") > 0).select("kind", "bucket", "bits").orderBy("kind", "bucket").toLocalIterator():
            if part and size + len(raw) > most_bytes:
                parts.append(context.broadcast(Filter(part, buckets)))
                part, size = {}, 0
            part[kind, bucket] = bytes(raw)
            size += len(raw)
        parts.append(context.broadcast(Filter(part, buckets)))
        scored = cut(rows.mapInArrow(_scored(parts, hot_table, buckets, below), _SCORED))
    asked = scored.where("slot is null").select("block", "bucket", "hashes", "owners", "times")
    cold = table.where("kind = 1").select("bucket", "hashes", "counts")
    found = asked.groupBy("bucket").cogroup(cold.groupBy("bucket")).applyInPandas(_looked_up(below), _PARTS)
    given = scored.where("slot is not null").select("block", "slot", "doc_id", "held_out", "n_tokens", "score", "base_score", "n_known")
    return given.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_finished(n_train), _FINAL)
