"""Byte-level BPE through sentencepiece, whose model is serialised straight from a rank file.

Every token's bytes are written as 256 letters that stand for bytes, and become a piece scored by the
negative rank, so that sentencepiece, which joins the best-scored pair first, makes the same merges.  The
normaliser is the identity.  Pre-tokens are encoded one by one; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import ChunkTable, packed

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: White space as the pattern means it (Unicode's White_Space); fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it prints, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """A protocol-buffer field: whole numbers as varints, floats in four bytes, the rest by length."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
        return bytes(out)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A sentencepiece BPE model of ``ranks``, and the rank of each of its ids; the last id is the unknown piece."""
    letters = byte_letters()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".join(letters[b] for b in token)) + _field(2, -float(rank)) + _field(3, normal) for token, rank in ordered]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))
    no_id = (1 << 64) - 1  # -1, as varints have it
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(n, no_id) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer), [rank for _, rank in ordered]


class ByteBpe:
    """Encodes and decodes as the rank file says."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        model, self.rank_of = serialise_model(ranks)
        self.same = self.rank_of == list(range(len(self.rank_of)))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.letters = byte_letters()
        self.wide = str.maketrans({b: c for b, c in enumerate(self.letters)})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.table = ChunkTable(self.encode_text)

    def encode_text(self, text: str) -> bytes:
        """The ids of a text, each pre-token encoded alone, as little-endian unsigned 32-bit integers."""
        words = [w.encode().decode("latin-1").translate(self.wide) for w in self.split(text)]
        # a call with a list starts threads, which pays only for long ones
        found = self.model.encode(words, num_threads=1) if len(words) > 99 else map(self.model.encode, words)
        return packed(i if self.same else self.rank_of[i] for ids in found for i in ids)

    def encode(self, text: str | None) -> bytes:
        return self.table.whole(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder of a Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    A null or empty text has no tokens (the digests are of no bytes); a null doc_id stays null; repeated rows
    give a row each; an empty table gives none; other columns are ignored.  Rows are independent: nothing is
    shuffled, and memory holds an Arrow batch and the table of chunks.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            counts, ids_of, bytes_of = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids) // 4)
                ids_of.append(digest(ids))
                bytes_of.append(digest(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_of, pa.string()), pa.array(bytes_of, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, ENCODED)
