"""Best-fit packing of documents into sequences, certified by dual-feasible lower bounds.

Each partition packs its pieces best-fit decreasing and computes a lower bound on its bins from families
of dual-feasible functions.  A partition whose bins equal its bound is certified and done.  The bins with
room of the others give their pieces up; those are dealt anew, mixed among the partitions, and packed
again.  A round that does not save bins is not taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_letters
from .chunked import ChunkTable, packed
from .common import alone, cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", uid long, bucket long, bin long, offset long, room long, bins long, bound long"


@alone
@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> tuple[ChunkTable, Callable[[str | None], bytes]]:
    """(chunk table, encoder of whole texts) of a Python worker: the ids that ``tokenizers`` gives.

    ``tokenizers`` itself encodes a text that holds one of its added tokens, which it recognises by default, and
    every chunk that is not plain ASCII.  Plain chunks go to a rank encoder, several times as fast, if
    ``rank_encoder`` proves that it makes the same merges.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    own = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
    fast = rank_encoder(tokenizer)
    table = ChunkTable(own if fast is None else lambda text: packed(fast(text)) if text.isascii() and not _control(text) else own(text))
    return table, lambda text: own(text) if text and any(x in text for x in added) else table.whole(text)


_control = re.compile(r"[^\n\x20-\x7e]").search


def rank_encoder(tokenizer) -> Callable[[str], list[int]] | None:
    """``encode_ordinary`` by ranks if on ASCII it gives the tokenizer's ids in every text without added tokens; else None.

    A rank encoder joins the two neighbours whose join has the least id; the tokenizer those of the first merge in
    its list.  They agree if ids are in the order of merges, a merge's parts come before it, and the tokenizer's
    model makes every token of its bytes alone: then two neighbours whose join is a token, all earlier merges done,
    can only be the parts of that token's own merge.  Pre-tokens agree by the pattern, which is the same.
    """
    import json

    import public_tokenizers
    import tiktoken

    whole = json.loads(tokenizer.to_str())
    model, split = whole["model"], whole["pre_tokenizer"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or whole["normalizer"] or whole["post_processor"] or not split or plain.items() - split.items():
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    letters = byte_letters()
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = {piece: i for piece, i in model["vocab"].items() if piece not in added}
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = ["".join(m) for m in merges]
    if {*ids} != {*letters, *made} or len(made) + 256 != len(ids) or any(ids[a] >= ids[b] for a, b in pairwise(made)):
        return None
    if any(max(ids[a], ids[b]) >= ids[c] for (a, b), c in zip(merges, made, strict=True)) or max(ids[c] for c in letters) >= ids[made[0]]:
        return None
    if any([t.id for t in tokenizer.model.tokenize(piece)] != [ids[piece]] for piece in made):
        return None
    back = {c: b for b, c in enumerate(letters)}
    ranks = {bytes(back[c] for c in piece): i for piece, i in ids.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document's ids, ended by ``end_id``.

    A document of more than ``capacity`` ids becomes pieces of ``capacity``, of which the first may be shorter.
    """
    ending = packed([end_id])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = tokenizer_of(tokenizer_path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + ending
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = at + (n - 1) % capacity + 1 if k == 0 else at + capacity
                    rows.append((key, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at = to
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Each item's bin and offset, and each bin's room. Items go, longest first, to the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = having[left].pop()
            if not having[left]:
                rooms &= ~(1 << left)
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        room[b] = left = left - size
        if left:
            having[left].append(b)
            rooms |= 1 << left
    return bins, offsets, room


def lower_bound(lengths: np.ndarray, capacity: int, families: int = 24) -> int:
    """The most bins that dual-feasible functions prove necessary, in whole numbers throughout.

    Three families: the identity; for each t up to half, items over capacity - t count whole and those under
    t not at all; for each k, lengths rounded down to k-ths, but for exact multiples of 1/(k+1).
    """
    sizes, counts = np.unique(lengths, return_counts=True)
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    few = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(sizes * counts)])
    t = np.arange(1, capacity // 2 + 1)
    low, high = np.searchsorted(sizes, t, "left"), np.searchsorted(sizes, capacity - t, "right")
    best = max(best, int((few[-1] - few[high] + -(-(mass[high] - mass[low]) // capacity)).max()))
    for k in range(1, families + 1):
        part = (k + 1) * sizes
        value = np.where(part % capacity == 0, sizes * k, part // capacity * capacity)  # in units of 1/(k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", ignore_index=True)  # the same bins, should the task run again
        lengths = frame["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        return frame.assign(bin=bins, offset=offsets, room=np.asarray(room, np.int64)[bins], bins=len(room), bound=lower_bound(lengths, capacity))

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, per_bucket: int = 20_000, rounds: int = 3) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (its partition's
    bins met the lower bound).  A null or empty text is the end token alone; a null doc_id stays null; repeated
    rows are packed each; an empty table gives no rows; other columns are ignored.  A partition holds about
    ``per_bucket`` pieces, dealt by a hash of the row's number, so no key can fill one.
    """
    pieces = cut(cut_pieces(docs, tokenizer_path, capacity, end_id)).withColumn("uid", F.monotonically_increasing_id())
    whole = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.where(F.col("length") < capacity)
    done: list[DataFrame] = []
    base = 0

    def dealt_and_packed(rows: DataFrame, n: int, salt: int) -> tuple[DataFrame, int]:
        buckets = max(1, -(-n // per_bucket))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(buckets)) + base)
        return cut(dealt.groupBy("bucket").applyInPandas(_pack(capacity), PACKED)), buckets

    n = rest.count()
    now, used = dealt_and_packed(rest, n, 0)
    for salt in range(1, rounds + 1):
        base += used
        open_bin = (F.col("bins") > F.col("bound")) & (F.col("room") > 0)
        loose = now.where(open_bin)
        had = loose.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0)).alias("bins")).first()
        if had["bins"] < 2:
            break
        again, used = dealt_and_packed(loose.select("doc_id", "piece", "start", "length", "ids_crc32", "uid"), had["n"], salt)
        took = again.agg(F.sum((F.col("offset") == 0).cast("long"))).first()[0]
        if took >= had["bins"]:
            break
        done.append(now.where(~open_bin))
        now = again
    out = whole
    for part in [*done, now]:
        out = out.unionByName(part.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bucket") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
    return out
