"""Language ID by held-out accuracy and its own arithmetic; language-model scores against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from dupeloom.llm.langid import GRAMS, Languages, gram_counts, has_letter, identify_languages, keep_identified
from dupeloom.llm.lm import Filter, bloom_segment, expected_count, score_documents


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify_languages(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.98


def test_language_is_no_input_of_a_prediction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    masked = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) lang")
    assert sorted(map(tuple, identify_languages(docs).collect())) == sorted(map(tuple, identify_languages(masked).collect()))


def test_mixtures_find_both_languages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sums = {}
    for r in rows[:150]:
        sums[r.lang] = sums.get(r.lang, 0) + gram_counts(r.text)
    model = Languages(pd.DataFrame([(k, g, v[g]) for k, v in sums.items() for g in np.flatnonzero(v)], columns=["lang", "gram", "n"]))
    texts = {lang: next(r.text for r in rows[150:] if r.lang == lang and len(r.text) > 1500)[:1500] for lang in ("en", "de")}
    (both, some), (one, _), (_, none), (_, nothing) = model.mixtures([texts["en"] + " " + texts["de"], texts["de"], "xqzvk jwqpx zzkqw vvxqj qqzzx", "12"])
    assert some and not none and not nothing
    named = dict(zip(model.names, both, strict=True))
    assert named["en"] > 0.35 and named["de"] > 0.35 and abs(both.sum() - 1) < 1e-9
    assert model.names[one.argmax()] == "de" and one.max() > 0.95


def plain_mixture(grams, chances):
    """Proportions by the docstring's rule, in plain Python; chances: {gram: [of each language]}; None for the empty set."""
    n, names = sum(grams.values()), range(len(next(iter(chances.values()))))
    likelihood = lambda w: sum(c * math.log(sum(p * q for p, q in zip(w, chances[g], strict=True))) for g, c in grams.items())

    def fit(w):
        for _ in range(12):
            new = [0.0 for _ in names]
            for g, c in grams.items():
                joint = [p * q for p, q in zip(w, chances[g], strict=True)]
                for k in names:
                    new[k] += c * joint[k] / sum(joint) / n
            w = new
        return w

    alone = [[float(k == j) for j in names] for k in names]
    best = max(alone, key=likelihood)
    value = likelihood(best)
    full = fit([1 / len(names) for _ in names])
    for k in range(2, len(names) + 1):
        kept = sorted(names, key=lambda j: -full[j])[:k]
        start = [max(full[j], 1e-6) if j in kept else 0.0 for j in names]
        w = fit([x / sum(start) for x in start])
        new = likelihood(w) - (k - 1) * 0.5 * math.log(n)
        if new <= value:
            break
        best, value = w, new
    return best, value > n * math.log(1 / GRAMS)


def test_mixtures_equal_plain_expectation_maximisation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sums = {}
    for r in rows[:120]:
        sums[r.lang] = sums.get(r.lang, 0) + gram_counts(r.text)
    model = Languages(pd.DataFrame([(k, g, v[g]) for k, v in sums.items() for g in np.flatnonzero(v)], columns=["lang", "gram", "n"]))
    texts = [r.text[:300] for r in rows[120:135]] + [rows[i].text[:200] + rows[i + 1].text[:90] for i in range(120, 150)] + ["a b c d e f", "xqzvk jwqpx zzkqw vvxqj", "x"]
    seen = set()
    for text, (got, better) in zip(texts, model.mixtures(texts), strict=True):
        grams = {int(g): int(c) for g, c in enumerate(gram_counts(text)) if c}
        wanted, some = plain_mixture(grams, {g: model.chances[g].tolist() for g in grams})
        assert np.allclose(got, wanted, atol=1e-9) and better == some
        seen.add((int((got > 0).sum()), better))
    assert len(seen) >= 3


def test_too_many_languages_are_an_error(spark, monkeypatch):
    from dupeloom.llm import langid

    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang has"):
        identify_languages(docs)


def test_language_edges(spark, edge_docs, no_docs):
    rows = identify_languages(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3)) and by[5].lang_pred == "en"
    assert identify_languages(no_docs).collect() == []
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert identify_languages(nothing).first().lang_pred == "und"
    short = spark.createDataFrame([(1, "a b c d e f", "en"), (3, "a b c a b c", "en"), (4, "x y z", "zz")], "doc_id long, text string, lang string")
    assert all(r.score > 0 for r in identify_languages(short).collect())
    unlearned = spark.createDataFrame([(1, "text", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in keep_identified(unlearned).collect()] == [1]
    kept = keep_identified(edge_docs)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == edge_docs.columns and all(map(has_letter, texts)) and "same words again and again and again" in texts
    assert not has_letter("12 !?") and has_letter("1é") and gram_counts("").sum() == 0 and gram_counts("x").sum() == 1 and len(gram_counts("x")) == GRAMS


def base_scores(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for d, t in rows if fold(d, 10) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((d, fold(d, 10) == 0, len(tokens(t)), sum(w in counts for w in tokens(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"hot_words": 64, "buckets": 8}, {"hot_words": 1, "buckets": 1, "most_bytes": 4000}, {"hot_words": 64, "buckets": 8, "most_bytes": 1000, "most_parts": 1}])
def test_base_scores_equal_plain_python(spark, sf_dir, edge_docs, options):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), edge_docs.select("doc_id", "text")):
        wanted = base_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        rows = score_documents(docs.repartition(3), **options).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in wanted]
        assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-9)
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_parts_of_the_filter_give_the_same_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {r.doc_id: r.score for r in score_documents(docs, buckets=8).collect()}
    many = {r.doc_id: r.score for r in score_documents(docs, buckets=8, most_bytes=8000).collect()}
    routed = {r.doc_id: r.score for r in score_documents(docs.repartition(3), buckets=8, most_bytes=8000, most_parts=2).collect()}
    assert one.keys() == many.keys() == routed.keys()
    assert np.allclose([one[k] for k in one], [many[k] for k in one]) and np.allclose([one[k] for k in one], [routed[k] for k in one])


def test_no_training_rows(spark, no_docs):
    assert score_documents(no_docs).collect() == [] and score_documents(no_docs, most_parts=-1).collect() == []
    held = next(i for i in range(100) if fold(i, 10) == 0)
    row = score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and abs(row.base_score) < 1e-9


def test_filter_gives_levels_of_counts():
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = rng.geometric(0.2, len(hashes))
    levels = 1 + np.floor(np.log2(counts)).astype(int)
    found = Filter({(1, 0): bloom_segment(hashes, counts).tobytes()}, 1).levels(1, hashes)
    assert (found >= levels).all() and (found == levels).mean() > 0.9
    others = Filter({(1, 0): bloom_segment(hashes, counts).tobytes()}, 1).levels(1, hashes + np.uint64(1))
    assert (others == 0).mean() > 0.9


def test_what_was_seen_once_is_not_unseen(spark):
    train = [i for i in range(200) if fold(i, 10)]
    test = [i for i in range(200) if not fold(i, 10)]
    rows = [(i, f"a{i} b{i} c{i}") for i in train] + [(test[0], f"a{train[0]} b{train[0]} c{train[0]}"), (test[1], f"a{train[1]} c{train[2]} b{train[3]}"), (test[2], "x y z")]
    score = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs, words, unseen = (score[i] for i in test[:3])
    assert pairs > words + 0.01 and words > unseen + 0.01
    assert expected_count(np.asarray([0, 1, 2]), 0.0).tolist()[:2] == [0.0, 1.0] and 2 < expected_count(np.asarray([2]), 0.0)[0] < 3


def test_the_model_is_better_than_the_base(spark):
    rows = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_scores_equal_a_model_of_exact_counts(spark, sf_dir, monkeypatch, held):
    """The same model from a plain count of words and pairs: exactly, but for counts that the filter takes one level up."""
    from dupeloom.llm import lm

    monkeypatch.setattr(lm, "HELD", held)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    words, pairs = Counter(), Counter()
    for d, t in rows:
        if fold(d, 10):
            words.update(tokens(t))
            pairs.update(zip(["start", *tokens(t)[:-1]], tokens(t), strict=True))
    n, v = sum(words.values()), len(words)
    count = lambda c, seldom: lm.expected_count(np.asarray([1 + math.floor(math.log2(c)) if c else 0]), seldom)[0]
    got = {r.doc_id: r for r in score_documents(docs.repartition(5)).collect()}
    gaps = []
    for d, t in rows:
        total = 0.0
        for before, word in zip(["start", *tokens(t)[:-1]], tokens(t), strict=True):
            own, had, pair = count(words[word], lm.SELDOM), count(words[None if before == "start" else before], lm.SELDOM), count(pairs[before, word], 0.0)
            total += math.log10((pair + lm.PRIOR * (own + 0.1) / (n + 0.1 * (v + 1))) / (max(had, pair) + lm.PRIOR))
        gaps.append(abs(got[d].score - total) / len(tokens(t)))
    assert np.median(gaps) < 0.02 and np.mean(gaps) < 0.05
