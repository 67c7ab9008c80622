"""Front end for tables of texts: a text is a fragment, its non-empty lines are statements, word shingles its fingerprint.

All of it is built-in functions, within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import bound

#: Words of a shingle.
SHINGLE = 5
BLANKS = r"[\t\r\f\x0B ]+"
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def text_fragments(docs: DataFrame, key: str = "doc_id", extra: tuple[str, ...] = ("source",)) -> DataFrame:
    """frag_id, text, lines, exec_lines, exec_stmts, root_hash, words and the ``extra`` columns of each text.

    A null text counts as empty: no lines, no words, the hash of nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tidy = lambda line: F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))
    lined = docs.select(
        F.col(key).alias("frag_id"),
        *extra,
        text.alias("text"),
        F.filter(F.transform(F.split(text, "\n"), tidy), lambda line: line != "").alias("lines"),
        F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda word: word != "").alias("words"),
    )
    return lined.withColumns({"exec_lines": F.size("lines"), "exec_stmts": F.size("lines"), "root_hash": F.md5(F.array_join("lines", "\n"))})


def fingerprints(fragments: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The fragments with ``shingles``, the hashes of their distinct word shingles, and ``n``, how many; too short texts have none."""
    # the hash of an array of words; a slice would copy all of the words each time
    hashed = bound("words", lambda w: F.transform(_starts(w, size), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(size)])))
    return fragments.withColumn("shingles", F.array_distinct(hashed)).withColumn("n", F.size("shingles"))


def _starts(words: Column, size: int) -> Column:
    """The places, from 1, where a shingle of some words begins."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))


def text_shingles(fragments: DataFrame, size: int = SHINGLE) -> DataFrame:
    """frag_id, s: the distinct shingles of each text, as text."""
    texts = bound("words", lambda w: F.transform(_starts(w, size), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))
    return fragments.select("frag_id", F.explode(F.array_distinct(texts)).alias("s"))


def long_enough(fragments: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The fragments that have a fingerprint, without making it."""
    return fragments.where(F.size("words") >= size)


def reportable(prints: DataFrame, least_lines: int = 0) -> DataFrame:
    """Fragments with a fingerprint and enough lines: filtered before any join."""
    return prints.where((F.col("n") > 0) & (F.col("exec_lines") >= least_lines))


def shingle_places(fragments: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The fragments with ``places``: an array of (shingle, starts, ends) of each place where a shingle stands, with its lines."""
    of_line = lambda content, i: F.transform(F.filter(F.split(content, BETWEEN_WORDS), lambda word: word != ""), lambda w: F.struct((i + 1).alias("line"), w.alias("word")))
    flat = F.flatten(F.transform("lines", of_line))
    at = lambda w, i, k: F.get(w, i + (k - 1))
    place = lambda w, i: F.struct(F.xxhash64(*[at(w, i, k)["word"] for k in range(size)]).alias("shingle"), at(w, i, 0)["line"].alias("starts"), at(w, i, size - 1)["line"].alias("ends"))
    return fragments.withColumn("places", bound(flat, lambda w: F.transform(_starts(w, size), lambda i: place(w, i))))


def shingle_lines(fragments: DataFrame, size: int = SHINGLE) -> DataFrame:
    """frag_id, shingle, first_end, last_start: of each distinct shingle the first line it ends on and the last it starts on.

    A leading run of k lines has just the shingles with first_end <= k; one that begins at line s those with last_start >= s.
    """
    each = shingle_places(fragments, size).select("frag_id", F.explode("places").alias("s"))
    return each.groupBy("frag_id", F.col("s.shingle").alias("shingle")).agg(F.min("s.ends").alias("first_end"), F.max("s.starts").alias("last_start"))
