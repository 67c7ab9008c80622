"""Language identification by mixture inference.

Each language is a distribution over hashed letter trigrams, counted over all training rows.  A document is a
mixture of languages: expectation-maximisation finds the proportions that make its trigrams likeliest, and the
set of languages is chosen by the likelihood less half a logarithm of the trigrams for each language beyond the
first, among the nested sets of its weightiest languages.  The set may be empty: then no language makes the
trigrams as likely as drawing them evenly from all buckets, and the document is in none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hash buckets of trigrams, what is added to each count, and steps of expectation-maximisation.
GRAMS, ADDED, STEPS = 1 << 15, 0.5, 12
#: Distinct trigrams of documents that are worked on at once, and the most languages that are learned (256 KB each).
AT_ONCE, MOST_LANGUAGES = 150_000, 1024
UNDETERMINED = "und"

#: A letter's byte stays (every byte beyond ASCII counts as one), all else is a space.
_FOLD = np.asarray([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed trigram of bytes with a letter in its middle stands in the whole text, in lower case."""
    raw = _FOLD[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)].astype(np.uint32)
    grams = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    grams = grams[raw[1:-1] != 32]
    return np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=GRAMS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(text):
                sums[lang] = sums.get(lang, 0) + gram_counts(text)
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["lang", "gram", "n"])


class Languages:
    """Names, in order, and log-probabilities of trigrams (GRAMS, languages)."""

    def __init__(self, counts: pd.DataFrame):
        self.names = sorted(counts["lang"].unique())
        table = np.full((GRAMS, len(self.names)), ADDED)
        table[counts["gram"].to_numpy(), np.searchsorted(np.asarray(self.names, object), counts["lang"].to_numpy())] += counts["n"].to_numpy()
        self.chances = (table / table.sum(axis=0)).astype(np.float64) if self.names else table

    def mixtures(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """The proportions of each text's languages, zeros for those outside the chosen set, all zeros without trigrams; and whether a language is better than none."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for i, text in enumerate(texts):
            counts = gram_counts(text)
            some = np.flatnonzero(counts)
            held.append((some, counts[some]))
            n += len(some)
            if n >= AT_ONCE or i == len(texts) - 1:
                yield from self._chosen(held)
                held, n = [], 0

    def _fit(self, chances: np.ndarray, counts: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after STEPS steps, and log-likelihoods, of documents whose trigrams begin at ``first``."""
        weights, totals = start, np.add.reduceat(counts, first)
        for _ in range(STEPS):
            joint = chances * np.repeat(weights, sizes, axis=0)
            joint *= (counts / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            weights = np.add.reduceat(joint, first, axis=0) / totals[:, None]
        each = (chances * np.repeat(weights, sizes, axis=0)).sum(axis=1)
        return weights, np.add.reduceat(counts * np.log(np.maximum(each, 1e-300)), first)

    def _chosen(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, bool]]:
        out, some = np.zeros((len(held), len(self.names))), np.zeros(len(held), np.bool_)
        docs = [i for i, (grams, _) in enumerate(held) if len(grams)]
        if docs and self.names:
            sizes = np.asarray([len(held[i][0]) for i in docs])
            first = np.cumsum(sizes) - sizes
            grams, counts = np.concatenate([held[i][0] for i in docs]), np.concatenate([held[i][1] for i in docs]).astype(np.float64)
            chances = self.chances[grams]
            totals = np.add.reduceat(counts, first)
            alone = np.add.reduceat(counts[:, None] * np.log(chances), first, axis=0)
            best = alone.max(axis=1)
            weights = np.zeros((len(docs), len(self.names)))
            weights[np.arange(len(docs)), alone.argmax(axis=1)] = 1
            if len(self.names) > 1:
                full, _ = self._fit(chances, counts, first, sizes, np.full(weights.shape, 1 / len(self.names)))
                rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
                open_ = np.ones(len(docs), bool)
                for k in range(2, len(self.names) + 1):
                    # a larger set is tried only where the last one paid
                    at = np.flatnonzero(open_)
                    if not len(at):
                        break
                    entries = np.repeat(open_, sizes)
                    start = np.where(rank[at] < k, np.maximum(full[at], 1e-6), 0)
                    got, likelihood = self._fit(chances[entries], counts[entries], np.cumsum(sizes[at]) - sizes[at], sizes[at], start / start.sum(axis=1, keepdims=True))
                    value = likelihood - (k - 1) * 0.5 * np.log(totals[at])
                    better = value > best[at]
                    weights[at[better]] = got[better]
                    best[at[better]] = value[better]
                    open_[at[~better]] = False
            out[docs] = weights
            some[docs] = best > totals * np.log(1 / GRAMS)
        yield from zip(out, some.tolist(), strict=True)


def held_out(doc_id: str, fold: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``fold`` is ``remainder``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % fold == remainder


def learn_languages(docs: DataFrame) -> Broadcast:
    """Languages of ``docs`` (text, lang), from all rows whose lang is not null and whose text has a letter.

    Counts are summed in each task, then by (language, trigram): what reaches the driver and the workers is at most
    GRAMS rows a language.  More than MOST_LANGUAGES languages raise an error: then lang does not hold languages.
    """
    counts = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_learned, "lang string, gram int, n long")
    counts = cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if (n := counts.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"lang has {n} values; at most {MOST_LANGUAGES} languages can be learned")
    return docs.sparkSession.sparkContext.broadcast(Languages(counts.toPandas()))


def language_of(text: Column, languages: Broadcast) -> Column:
    """struct(lang_pred, score, languages, identified) of a text: the weightiest language, its proportion, all of them as name:proportion, and whether it is in any.

    A text without a letter is not identified; if no language was learned, every other is.
    """

    @F.pandas_udf("lang_pred string, score double, languages string, identified boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = languages.value
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        preds, scores, lists, identified = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts), [False] * len(texts)
        for i, (w, better) in zip(some, model.mixtures([texts.iloc[i] for i in some]), strict=True):
            identified[i] = better or not model.names
            if model.names:
                top = int(w.argmax())
                preds[i], scores[i] = model.names[top], min(1.0, float(w[top]))
                lists[i] = ",".join(f"{model.names[k]}:{w[k]:.3f}" for k in np.argsort(-w, kind="stable") if w[k] > 0.0005)
        return pd.DataFrame({"lang_pred": preds, "score": scores, "languages": lists, "identified": identified})

    return predicted(text)


def identify_languages(docs: DataFrame, fold: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of each row of ``docs`` (doc_id, text, lang).

    Learns from rows that are not held out and have a lang.  A null text, or one without a letter, is ``und`` with
    score 0, as is everything if nothing could be learned; a null doc_id counts as empty text and stays null;
    repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    out = held_out("doc_id", fold, remainder)
    languages = learn_languages(docs.where(~out))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), language_of(F.col("text"), languages).alias("l")).select("doc_id", "held_out", "l.lang_pred", "l.score", "l.languages")


def keep_identified(docs: DataFrame, fold: int = 4, remainder: int = 2) -> DataFrame:
    """The rows of ``docs`` whose text is in some language, with all their columns.

    What goes: nulls, texts without a letter, and texts whose set of languages is empty.  If nothing can be learned
    (no lang, or no row outside the held-out fold), all texts with a letter stay.
    """
    languages = learn_languages(docs.where(~held_out("doc_id", fold, remainder)))
    return docs.where(language_of(F.col("text"), languages)["identified"])
