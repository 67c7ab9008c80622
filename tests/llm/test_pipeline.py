"""The pipeline's stages, each on what the one before kept, against plain Python."""

import re

import pytest

import corpus_pipeline
from dupeloom.llm.langid import GRAMS, gram_counts, has_letter
from dupeloom.llm.secretscan import find_secrets

from .test_dedup import brute_force, shingles
from .test_models import fold, plain_mixture
from .test_scans import base_spans
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage returns, written and read again; junk is added to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "en", "s", 0), (10**6 + 3, "token: abcdefgh in a short text", "en", "s", 31), (10**6 + 4, "xqzvk jwqpx zzkqw vvxqj qqzzx", "en", "s", 29)], docs.schema)
    out = [docs.unionByName(junk)]
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], sf_dir).write.parquet(folder)
        out.append(spark.read.parquet(folder))
    return out


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "best_fit_packing"]
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns and docs.dtypes == stages[0].dtypes


def test_texts_in_no_language_go(stages):
    """Plain sums over the training rows: what stays is what some mixture makes likelier than even chances."""
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[:2])
    sums = {}
    for r in before.values():
        if fold(r.doc_id, 4) != 2 and r.lang is not None and has_letter(r.text):
            sums[r.lang] = sums.get(r.lang, 0) + gram_counts(r.text) * 1.0
    tables = [v + 0.5 for _, v in sorted(sums.items())]
    chances = {g: [float(t[g] / t.sum()) for t in tables] for g in range(GRAMS)}
    wanted = set()
    for r in before.values():
        if has_letter(r.text) and plain_mixture({g: int(c) for g, c in enumerate(gram_counts(r.text[:20_000])) if c}, chances)[1]:
            wanted.add(r.doc_id)
    assert after == {i: before[i] for i in wanted}
    assert set(before) - wanted == {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 4}


def test_one_of_each_group_stays(stages):
    before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in stages[1:3])
    wanted = {c for _, _, c in brute_force(before, 5, 80)}
    assert sorted(i for i, _ in after) == sorted(wanted) and set(after) <= set(before)
    assert all(shingles(t, 5) for _, t in after)


def test_secrets_are_masked_and_the_rest_is_kept(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[2:4])
    spans = {r.doc_id: r.secret_spans for r in find_secrets(stages[2]).collect()}
    assert before.keys() == after.keys()
    for i, old in before.items():
        base = base_spans(old.text)
        assert {f"{s.kind}:{s.start}:{s.end}" for s in spans[i]} >= set(base)
        if not spans[i]:
            assert after[i] == old
        else:
            pattern = ".*?".join(map(re.escape, after[i].text.split("[secret]")))
            assert re.fullmatch(pattern, old.text, re.S) and after[i].n_chars == len(after[i].text)
            assert not base_spans(after[i].text)
    assert after[10**6 + 3].text == "[secret] in a short text"


def test_packing_holds_all_that_is_left(stages):
    check_packing(stages[3], stages[4].collect(), 1024)


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert {tuple(r) for r in rows} == {tuple(r[:5]) for r in stages[4].collect() if r.doc_id < 10**6}


def test_an_empty_table_goes_through(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
