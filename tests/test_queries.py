"""Registered queries against DuckDB's answers to their SQL, and a stream of changes against a batch."""

import math
import os

import duckdb
import pytest

from dupeloom import queries
from dupeloom.streaming.delta import duplicate_stream


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def rounded(rows):
    return sorted((tuple(round(x, 7) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = queries.QUERIES[name](spark, sf_dir)
    wanted = tables.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    assert rounded(df.select(*columns).collect()) == rounded(tuple(r[i] for i in places) for r in wanted.fetchall())


def test_all_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_similarity_does_not_pass_through_frequent_phrases(spark, sf_dir):
    plan = queries.jaccard_pairs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_stream_finds_what_a_batch_finds(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i in range(2):
        docs.where(f"doc_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    duplicate_stream(stream, str(tmp_path / "prints"), str(tmp_path / "pairs"), str(tmp_path / "state")).awaitTermination(240)
    found = spark.read.parquet(str(tmp_path / "pairs")).select("left_id", "right_id", "tier").distinct()
    wanted = queries.pair_union_ranked(spark, sf_dir).select("left_id", "right_id", "tier")
    assert rounded(found.collect()) == rounded(wanted.collect())


@pytest.mark.parametrize("name", ["ast_rendered_templates", "ast_holes", "ast_suggestions", "ast_suffix_containment"])
def test_trees_are_not_taken_for_small(spark, sf_dir, name):
    """By its columns alone a relation of trees that were made from a few numbers looks small enough to be broadcast."""
    assert "BroadcastHashJoin" not in queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()


def test_sources_of_a_small_table_are_dealt_over_all_cores(spark, sf_dir):
    files = queries._sources(queries._table(spark, sf_dir, "supplier"), "s_suppkey", queries._AT_END, 1)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


LOOSE_QUERIES = ["nested_filter", "tier_histogram", "containment_findings", "containment_scores", "first_containment", "scan_stats", "file_overview_counts", "superseded_pairs", "clone_clusters", "cluster_order", "cluster_member_pairs"]


@pytest.mark.parametrize("name", LOOSE_QUERIES)
def test_pairs_keep_no_fingerprints(spark, sf_dir, name, monkeypatch):
    """What is written to the shared folder has sets only of texts that may have a partner; fingerprints of all take more room than the texts."""
    from dupeloom.operators import components, containment, pairs

    written = []
    keep = lambda df: written.append((df.columns, kept := components.cut(df), kept.count())[::2]) or kept
    for module in (pairs, containment):
        monkeypatch.setattr(module, "cut", keep)
        monkeypatch.setattr(module, "cut_and_drop", keep, raising=False)
    monkeypatch.setattr(queries, "cut", keep)
    queries.QUERIES[name](spark, sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert written and all(not {"shingles", "shingle"} & {*columns} or rows < texts / 2 for columns, rows in written)


def test_similar_classes_are_similar_pairs(spark, monkeypatch):
    """Frequent elements, repeated rows, broadcasts in parts, sizes at the threshold's edge: the same pairs as from kept sets."""
    import random

    from dupeloom.operators import pairs

    monkeypatch.setattr(pairs, "FREQUENT", 5)
    monkeypatch.setattr(pairs, "AT_ONCE", 7)
    deal = random.Random(4)
    rows = []
    for i in range(120):
        own = [deal.getrandbits(60) - (1 << 59) for _ in range(deal.randint(1, 30))]
        rows.append((i, list({*own, *range(deal.randint(0, 8))})))
        for j in range(i % 3):
            changed = set(own[: max(1, len(own) - deal.randint(0, len(own) // 2))]) | set(range(j * 3))
            rows.append((1000 * (j + 1) + i, list(changed)))
    rows += rows[:10]
    sets = spark.createDataFrame([(i, s, len(s)) for i, s in rows], "id long, shingles array<long>, n int").repartition(5)
    plain = sets.dropDuplicates(["id"]).withColumnRenamed("id", "frag_id")
    for threshold in (0.3, 0.6, 0.85, 1.0):
        found = pairs.similar_classes(sets, threshold).collect()
        wanted = pairs.similar_pairs(plain, threshold).select("left_id", "right_id", "similarity").collect()
        assert rounded(found) == rounded(wanted) and wanted


def test_runs_of_texts_are_those_of_kept_sets(spark, monkeypatch):
    """Copies, a host that holds its own copy, runs at both ends, frequent lines: the same accepted runs as from kept fingerprints and lines."""
    import random

    from dupeloom.operators import containment, pairs

    monkeypatch.setattr(pairs, "FREQUENT", 4)
    deal = random.Random(6)
    line = lambda: " ".join(deal.choice("abcdefghijkl") + str(deal.randint(0, 40)) for _ in range(deal.randint(1, 9)))
    texts = []
    for _ in range(25):
        own = [line() for _ in range(deal.randint(8, 24))]
        more = [line() for _ in range(deal.randint(2, 8))]
        near = [x if deal.random() > 0.04 else line() for x in own]
        texts += [own, own + more, more + own, near, near + more, ["the same line for all of them"] * 3 + own, ["one line that is there again and again"] * 20]
    rows = [(i, "\n".join(t), "s") for i, t in enumerate([*texts, *texts[:30], ["a b"], []])] + [(9999, None, "s")]
    fragments = queries.text_fragments(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    prints = queries.reportable(queries.fingerprints(fragments))
    lines = queries.shingle_lines(fragments)
    wanted = containment.containment_scores(prints, lines, containment.line_runs(lines, fragments, queries.CONTAINMENT), queries.CONTAINMENT)
    sets = queries.fingerprints(queries.long_enough(fragments)).selectExpr("xxhash64(root_hash) as id", "frag_id", "exec_lines", "shingles", "n")
    places = queries.shingle_places(queries.long_enough(fragments)).select("frag_id", "exec_lines", "places")
    found = containment.text_containment_scores(queries.long_enough(fragments), sets, places, queries.CONTAINMENT)
    columns = [*wanted.columns]
    assert rounded(found.select(*columns).collect()) == rounded(wanted.collect()) and wanted.count() > 100


COPIES = [{"text": "\n".join(f"line {i} of text {t} has words {i * t} and {i + t}" for i in range(24)), "n": n} for t, n in ((3, 60), (5, 50), (7, 1))]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Many copies of a text, of a longer one that begins with it and of a near copy, and one text alone: few texts and many pairs."""
    folder = tmp_path_factory.mktemp("copies")
    plain = COPIES[0]["text"]
    texts = [x["text"] for x in COPIES for _ in range(x["n"])] + [plain + "\nand one more line at the end of it"] * 40
    texts += [plain + "".join(f"\nno other text has row {i} or {i * i}" for i in range(5))] * 30
    rows = [(i, t, f"src{i % 4}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(str(folder / "documents.parquet"))
    return str(folder), len(rows)


LINKED_QUERIES = ["tier_histogram", "cluster_order", "clone_clusters", "cluster_member_pairs", "scan_stats", "file_overview_counts", "superseded_pairs"]


@pytest.mark.parametrize("name", LINKED_QUERIES)
def test_what_is_written_does_not_grow_with_the_pairs_of_copies(spark, copies, name, monkeypatch):
    """Thousands of pairs of a few texts' copies: links of texts are written, not pairs, and the result is that of the SQL."""
    from dupeloom.operators import components, containment, pairs

    folder, texts = copies
    rows = []
    keep = lambda df: rows.append((kept := components.cut(df)).count()) or kept
    for module in (pairs, containment, queries):
        monkeypatch.setattr(module, "cut", keep)
        monkeypatch.setattr(module, "cut_and_drop", keep, raising=False)
    df = queries.QUERIES[name](spark, folder)
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    wanted = tables.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    places = [wanted.columns.index(c) for c in columns]
    assert rounded(df.select(*columns).collect()) == rounded(tuple(r[i] for i in places) for r in wanted.fetchall())
    assert rows and max(rows) <= 2 * texts


def test_blocks_score_as_sets_do(spark, monkeypatch):
    """Groups larger than a block, sets that are in no candidate, repeated rows: the similarities of scored."""
    import random

    from dupeloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 4)
    deal = random.Random(8)
    rows = [(i - 30, deal.sample(range(-40, 40), deal.randint(1, 30))) for i in range(60)]
    met = [(a, b) for a in range(-30, 30) for b in range(a + 1, 30) if a % 3 == b % 3 and deal.random() < 0.7 and b < 25]
    sets = spark.createDataFrame([(i, s, len(s)) for i, s in rows + rows[:9]], "id long, shingles array<long>, n int").repartition(4)
    candidates = spark.createDataFrame(met, "left_id long, right_id long")
    plain = sets.dropDuplicates(["id"]).withColumnRenamed("id", "frag_id")
    wanted = pairs.scored(candidates, plain).select("left_id", "right_id", "similarity").collect()
    assert rounded(pairs.scored_in_blocks(candidates, sets).collect()) == rounded(wanted) and len(wanted) == len(met)


def _matched(manifest, found):
    """match_pairs, by trying all with all."""

    def iou(a, b, c, d):
        shared = max(min(b, d) - max(a, c) + 1, 0)
        return shared / ((b - a + 1) + (d - c + 1) - shared)

    out = set()
    for e, tier, f, s, t, g, u, v in manifest:
        for p, *sides in found:
            for h, a, b, k, c, d in (sides, sides[3:] + sides[:3]):
                if f is not None and g is not None and (f, g) == (h, k) and iou(s, t, a, b) >= 0.5 and iou(u, v, c, d) >= 0.5:
                    out.add((e, tier, p))
    return out


@pytest.mark.parametrize("repeated, most", [(0, 1000), (9, 1000), (9, 3)])
def test_matches_are_sorted_out_only_where_ids_repeat(spark, repeated, most, monkeypatch):
    """Both ways round, one file on both sides, null files, repeated ids; without these no result is shuffled, whose rows grow with the square of the input's."""
    import random

    from dupeloom.operators import evaluate

    monkeypatch.setattr(evaluate, "AT_ONCE", most, raising=False)
    deal = random.Random(5)

    def sides():
        for _ in range(2):
            start = deal.randint(1, 8)
            yield from (deal.choice([*"aabbc", None]), start, start + deal.randint(0, 9))

    manifest = [(f"e{i}", deal.choice("xy"), *sides()) for i in range(120)]
    found = [(f"p{i}", *sides()) for i in range(120)]
    manifest += [(r[0], r[1], *sides()) for r in manifest[:repeated]] + manifest[20 : 20 + repeated]
    found += [(r[0], *sides()) for r in found[:repeated]] + found[30 : 30 + repeated]
    columns = lambda a, b: ", ".join(f"{s}_file string, {s}_start int, {s}_end int" for s in (a, b))
    df = evaluate.match_pairs(spark.createDataFrame(manifest, f"entry_id string, tier string, {columns('source', 'target')}"), spark.createDataFrame(found, f"pair_id string, {columns('left', 'right')}"))
    rows = [tuple(r) for r in df.collect()]
    wanted = _matched(manifest, found)
    assert sorted(rows) == sorted(wanted) and len(wanted) > 100
    if not repeated:
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
