"""The registered queries over whole tables, and for each the same in DuckDB's SQL, written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, ContainmentConfig, ScanConfig
from .functions.globs import in_scope
from .functions.measures import balance, containment, distinct_lines, has_file_directive, has_inline_directive, line_iou, source_head
from .operators import containment as runs_of
from .operators import pairs as pairs_of
from .operators.components import clusters, cut
from .operators.evaluate import match_pairs, precision_recall
from .operators.inject import cluster_pairs
from .overview import best_partners, file_overview, function_entries, overview_of_ends, partner_lists
from .overview import file_order as overview_order
from .plans.scan import scan_files
from .report import format_json, format_sarif
from .sources.pyast import python_fragments
from .sources.textfrag import fingerprints, long_enough, reportable, shingle_lines, shingle_places, text_fragments, text_shingles
from .stats import pair_counts, scan_statistics

SCAN, CONTAINMENT = ScanConfig(), ContainmentConfig(enabled=True)
#: Settings in which the similar tier decides about the test tables' texts, most of which are short.
LOOSE = ScanConfig(threshold=0.6, min_lines=3)
#: The scope query's patterns over the paths of pages.
INCLUDE, EXCLUDE = ("**/en/*", "**/de/*", "fr/**"), ("**/5*", "**/*7")
FOCUS_SOURCE = "src3"

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def registered(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fragments(_table(spark, sf_dir, "documents"))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reportable fingerprints, made once: every join after reads them again."""
    return cut(reportable(fingerprints(_fragments(spark, sf_dir))).select("frag_id", "source", "exec_lines", "exec_stmts", "root_hash", "shingles", "n"))


def _lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reportable fragments without their fingerprints, which take more room than the texts."""
    return cut(long_enough(_fragments(spark, sf_dir)).select("frag_id", "source", "exec_lines", "exec_stmts", "root_hash"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints by class, made anew whenever they are read."""
    return fingerprints(long_enough(_fragments(spark, sf_dir))).select(F.xxhash64("root_hash").alias("id"), "frag_id", "exec_lines", "shingles", "n")


def _pairs(spark: SparkSession, sf_dir: str, config: ScanConfig = SCAN, prints: DataFrame | None = None) -> DataFrame:
    return cut(pairs_of.accepted_pairs(_lean(spark, sf_dir) if prints is None else prints, config, sets=_sets(spark, sf_dir)))


def _links(spark: SparkSession, sf_dir: str, config: ScanConfig = SCAN, prints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The accepted pairs as links of classes of equal texts, and the members of those."""
    return pairs_of.accepted_links(_lean(spark, sf_dir) if prints is None else prints, _sets(spark, sf_dir), config)


def _spanning(spark: SparkSession, sf_dir: str, config: ScanConfig = SCAN) -> DataFrame:
    """So many of the accepted pairs that their clusters are those of all: all of them grow with the square of a text's copies."""
    return cut(pairs_of.spanning_pairs(*_links(spark, sf_dir, config)))


def _finding_links(spark: SparkSession, sf_dir: str, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings as links of classes of equal texts, and the members of those."""
    places = shingle_places(long_enough(_fragments(spark, sf_dir))).select("frag_id", "exec_lines", "places")
    scores, members = runs_of.class_scores(prints, _sets(spark, sf_dir), places, CONTAINMENT)
    return cut(runs_of.finding_links(scores, members)), members


def _scores(spark: SparkSession, sf_dir: str, prints: DataFrame | None = None) -> DataFrame:
    places = shingle_places(long_enough(_fragments(spark, sf_dir))).select("frag_id", "exec_lines", "places")
    return runs_of.text_containment_scores(_lean(spark, sf_dir) if prints is None else prints, _sets(spark, sf_dir), places, CONTAINMENT)


def _findings(spark: SparkSession, sf_dir: str, prints: DataFrame | None = None) -> DataFrame:
    return cut(runs_of.best_findings(_scores(spark, sf_dir, prints)))


# The SQL of the same relations. Shingles are compared as text there, as hashes here.
FRAG = r"""
frag AS (
    SELECT doc_id AS frag_id, source, coalesce(text, '') AS text,
        list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(lower(l), '[\t\r\f\x0B ]+', ' ', 'g'))), lambda l: l <> '') AS lines,
        list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words
    FROM documents
),
sized AS (SELECT *, len(lines) AS exec_lines, md5(array_to_string(lines, chr(10))) AS root_hash FROM frag)"""
SHINGLES = FRAG + """,
places AS (SELECT frag_id, words, unnest(range(1, len(words) - 3)) AS i FROM sized),
sh AS (SELECT DISTINCT frag_id, array_to_string(words[i : i + 4], ' ') AS s FROM places),
fp AS (SELECT z.frag_id, any_value(z.source) AS source, any_value(z.exec_lines) AS exec_lines, any_value(z.root_hash) AS root_hash, count(*) AS n FROM sized z JOIN sh USING (frag_id) GROUP BY z.frag_id)"""
EXACT = SHINGLES + """,
exact AS (SELECT a.frag_id AS left_id, b.frag_id AS right_id, least(a.exec_lines, b.exec_lines) AS lines FROM fp a JOIN fp b ON a.root_hash = b.root_hash AND a.frag_id < b.frag_id)"""


def _jaccard(threshold: str, exact: int, similar: int) -> str:
    """Pairs at a threshold, and those that the tiers with these floors accept."""
    return _JACCARD.replace("0.85", threshold).replace("lines >= 5", f"lines >= {exact}").replace("lines >= 9", f"lines >= {similar}")


_JACCARD = EXACT + """,
jac AS (
    SELECT left_id, right_id, shared, a.n AS n_left, b.n AS n_right, least(a.exec_lines, b.exec_lines) AS lines, shared / (a.n + b.n - shared) AS similarity
    FROM (SELECT x.frag_id AS left_id, y.frag_id AS right_id, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.frag_id < y.frag_id GROUP BY 1, 2) o
    JOIN fp a ON a.frag_id = left_id JOIN fp b ON b.frag_id = right_id
    WHERE shared / (a.n + b.n - shared) >= 0.85
),
pairs AS (
    SELECT left_id, right_id, 1.0::DOUBLE AS similarity, CASE WHEN lines >= 5 THEN 'exact' ELSE 'similar' END AS tier FROM exact WHERE lines >= 5
    UNION ALL
    SELECT left_id, right_id, similarity, 'similar' FROM jac j WHERE lines >= 9 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.left_id = j.left_id AND e.right_id = j.right_id)
)"""
JACCARD, LOOSE_PAIRS = _jaccard("0.85", 5, 9), _jaccard("0.6", 3, 3)
_MEMBERS = """,
edges AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
members AS (SELECT min(seen) AS cluster_id, node AS frag_id FROM reach GROUP BY node)"""
CLUSTERS = LOOSE_PAIRS + _MEMBERS
RUNS = SHINGLES + r""",
line_words AS (SELECT frag_id, k AS line, unnest(list_filter(regexp_split_to_array(lines[k], '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(lines[k], '[^\p{L}\p{N}]+'), lambda w: w <> ''), 1) AS place FROM (SELECT frag_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM sized)),
in_order AS (SELECT frag_id, line, word, row_number() OVER (PARTITION BY frag_id ORDER BY line, place) AS i FROM line_words),
windows AS (SELECT frag_id, line AS starts, lead(line, 4) OVER w AS ends, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS s FROM in_order WINDOW w AS (PARTITION BY frag_id ORDER BY i)),
sl AS (SELECT frag_id, s, min(ends) AS first_end, max(starts) AS last_start FROM windows WHERE ends IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT frag_id AS host_id, exec_lines AS total, unnest(range(1, exec_lines)) AS length FROM sized),
fit AS (SELECT * FROM steps WHERE length >= 10 AND length / total <= 0.85),
runs AS (
    SELECT host_id, 'prefix' AS role, length, 1 AS start_line, length AS end_line, (SELECT count(*) FROM sl WHERE sl.frag_id = host_id AND first_end <= length) AS n FROM fit
    UNION ALL
    SELECT host_id, 'suffix', length, total - length + 1, total, (SELECT count(*) FROM sl WHERE sl.frag_id = host_id AND last_start >= total - length + 1) FROM fit
)"""
SCORES = RUNS + """,
met AS (
    SELECT a.frag_id AS contained_id, h.frag_id AS host_id, h.first_end, h.last_start, zh.exec_lines AS total
    FROM sh a JOIN sl h ON a.s = h.s AND a.frag_id <> h.frag_id
    JOIN sized za ON za.frag_id = a.frag_id JOIN sized zh ON zh.frag_id = h.frag_id
    WHERE za.exec_lines / zh.exec_lines >= 0.30
),
scored AS (
    SELECT m.contained_id, r.host_id, r.role, r.length, r.start_line, r.end_line, r.n AS n_run,
        count(*) FILTER (WHERE CASE r.role WHEN 'prefix' THEN m.first_end <= r.length ELSE m.last_start >= r.start_line END) AS shared
    FROM met m JOIN runs r ON r.host_id = m.host_id GROUP BY ALL
),
scores AS (
    SELECT contained_id, host_id, role, length, start_line, end_line, shared, fp.n AS n_contained, n_run, shared / least(fp.n, n_run) AS score, least(fp.n, n_run) / greatest(fp.n, n_run) AS balance,
        CASE WHEN shared = fp.n AND shared = n_run THEN 'exact' WHEN shared / least(fp.n, n_run) >= 0.85 AND length >= 15 THEN 'similar' END AS tier
    FROM scored JOIN fp ON fp.frag_id = contained_id WHERE n_run > 0
),
accepted AS (SELECT * FROM scores WHERE tier IS NOT NULL AND balance >= 0.8 - 1e-12)"""
FINDINGS = SCORES + """,
of_role AS (SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY contained_id, host_id, role ORDER BY score DESC, balance DESC, length) = 1),
findings AS (
    SELECT contained_id, host_id AS container_id, role, start_line, end_line, length AS statement_count, score, tier FROM of_role
    QUALIFY row_number() OVER (PARTITION BY least(contained_id, host_id), greatest(contained_id, host_id) ORDER BY score DESC, host_id, role, contained_id) = 1
)"""


@query(f"WITH {FRAG} SELECT frag_id, exec_lines::INT AS exec_lines, len(list_distinct(lines))::INT AS distinct_lines, len(words)::INT AS n_words FROM sized")
def line_measure(spark, sf_dir):
    """Executable lines, distinct lines and words of each text."""
    return _fragments(spark, sf_dir).select("frag_id", "exec_lines", distinct_lines(F.array("lines")).alias("distinct_lines"), F.size("words").alias("n_words"))


@query(
    """SELECT page_id, path,
        (regexp_matches(path, '^(.*/)?en/[^/]*$') OR regexp_matches(path, '^(.*/)?de/[^/]*$') OR starts_with(path, 'fr/') AND length(path) > 3)
        AND NOT (starts_with(parse_filename(path), '5') OR ends_with(path, '7')) AS in_scope
    FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/|[?#].*$', '', 'g') AS path FROM pages)"""
)
def glob_scope(spark, sf_dir):
    """Include and exclude patterns over paths."""
    paths = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]*/|[?#].*$", "").alias("path"))
    return paths.select("page_id", "path", in_scope(F.col("path"), INCLUDE, EXCLUDE).alias("in_scope"))


_INJECTED = "CASE doc_id % 4 WHEN 0 THEN concat('x', chr(10), '  # scan: ignore -- why', chr(10), coalesce(text, '')) WHEN 1 THEN concat('# scan: ignore-file', chr(10), coalesce(text, '')) WHEN 2 THEN concat(repeat(chr(10), 5), '# scan: ignore-file') ELSE coalesce(text, '') END"


@query(
    f"""SELECT doc_id AS frag_id, len(list_filter(string_split(t, chr(10))[1:5], lambda l: contains(l, '# scan: ignore-file'))) > 0 AS file_ignored,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '^\\s*# scan: ignore') AND NOT regexp_matches(l, '^\\s*# scan: ignore-file'))) > 0 AS inline_ignored FROM (SELECT doc_id, {_INJECTED} AS t FROM documents)"""
)
def ignore_directive(spark, sf_dir):
    """Directives in the first lines and at the start of any line (F2, F3), over texts into which some are put."""
    t = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frag_id"), F.expr(_INJECTED.replace("chr(10)", "'\\n'")).alias("t"))
    return t.select("frag_id", has_file_directive(F.col("t"), "scan").alias("file_ignored"), has_inline_directive(F.col("t"), "scan").alias("inline_ignored"))


@query(f"WITH {SHINGLES} SELECT frag_id, exec_lines::INT AS exec_lines, n::INT AS n FROM fp WHERE exec_lines >= 5")
def reportable_fragments(spark, sf_dir):
    """Fragments long enough for either tier and with a fingerprint."""
    return reportable(fingerprints(_fragments(spark, sf_dir)), SCAN.extraction_floor).select("frag_id", "exec_lines", "n")


@query(f"WITH {SHINGLES} SELECT root_hash, count(*) AS members, min(frag_id) AS first_id FROM fp GROUP BY 1 HAVING count(*) > 1")
def root_hash_groups(spark, sf_dir):
    """Groups of equal root hashes."""
    return long_enough(_fragments(spark, sf_dir)).groupBy("root_hash").agg(F.count("*").alias("members"), F.min("frag_id").alias("first_id")).where("members > 1")


@query(f"WITH {EXACT} SELECT left_id, right_id FROM exact")
def exact_pairs(spark, sf_dir):
    """Self-join on the root hash."""
    return pairs_of.exact_candidates(long_enough(_fragments(spark, sf_dir)).select("frag_id", "root_hash"))


@query(f"WITH {SHINGLES} SELECT z.frag_id, coalesce(fp.n, 0)::INT AS n FROM sized z LEFT JOIN fp USING (frag_id)")
def shingle_fingerprint_size(spark, sf_dir):
    """Size of each fingerprint."""
    return fingerprints(_fragments(spark, sf_dir)).select("frag_id", "n")


@query(f"WITH {JACCARD} SELECT left_id, right_id, shared::INT AS shared, n_left::INT AS n_left, n_right::INT AS n_right, round(similarity, 9) AS similarity FROM jac")
def jaccard_pairs(spark, sf_dir):
    """All pairs at the threshold, with scores."""
    return pairs_of.similar_pairs(_prints(spark, sf_dir), SCAN.threshold).select("left_id", "right_id", "shared", "n_left", "n_right", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {LOOSE_PAIRS} SELECT left_id, right_id, round(similarity, 9) AS similarity FROM pairs WHERE tier = 'similar'")
def similar_tier_pairs(spark, sf_dir):
    """Fuzzy pairs that are no exact candidates and pass the similar tier."""
    return _pairs(spark, sf_dir, LOOSE).where("tier = 'similar'").select("left_id", "right_id", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {JACCARD} SELECT left_id, right_id, round(similarity, 9) AS similarity, tier, row_number() OVER (ORDER BY similarity DESC, left_id, right_id) AS pair_rank FROM pairs")
def pair_union_ranked(spark, sf_dir):
    """All accepted pairs in rank order."""
    ranked = pairs_of.with_rank(_pairs(spark, sf_dir), F.desc("similarity"), "left_id", "right_id", rank="pair_rank")
    return ranked.select("left_id", "right_id", F.round("similarity", 9).alias("similarity"), "tier", "pair_rank")


@query(f"WITH {LOOSE_PAIRS} SELECT left_id, right_id, round(similarity, 9) AS similarity, tier FROM pairs ORDER BY pairs.similarity DESC, left_id, right_id LIMIT 50")
def top_k_pairs(spark, sf_dir):
    """The first of the ranked pairs (O5): here the limit is what is asked for."""
    return pairs_of.ranked(_pairs(spark, sf_dir, LOOSE), 50).select("left_id", "right_id", F.round("similarity", 9).alias("similarity"), "tier")


@query(
    f"""WITH {SHINGLES},
    slots AS (SELECT frag_id, seed, min(md5(concat(seed, ':', s))) AS slot FROM sh, (SELECT unnest(range(1, 7)) AS seed) GROUP BY 1, 2),
    bands AS (SELECT frag_id, (seed - 1) // 2 AS band, string_agg(slot, '' ORDER BY seed) AS key FROM slots GROUP BY 1, 2)
    SELECT DISTINCT a.frag_id AS left_id, b.frag_id AS right_id FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.frag_id < b.frag_id"""
)
def md5_minhash_bands(spark, sf_dir):
    """Three bands of two MinHash slots each, with a hash that any engine has."""
    return pairs_of.banded_candidates(_md5_signed(spark, sf_dir, 6), 3, 2, _md5_key)


def _md5_signed(spark, sf_dir, seeds: int) -> DataFrame:
    """Signatures of the texts' shingles by the engine's operator, with a hash that any engine has."""
    texts = text_shingles(_fragments(spark, sf_dir)).groupBy("frag_id").agg(F.collect_set("s").alias("shingles"), F.count("*").alias("n"))
    return pairs_of.minhash_signature(texts, seeds, lambda x, s: F.md5(F.concat(s.cast("string"), F.lit(":"), x)))


def _md5_key(part, band):
    return F.concat(band.cast("string"), F.lit(":"), F.array_join(part, ""))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT cluster_id, frag_id FROM members")
def clone_clusters(spark, sf_dir):
    """Connected components of accepted pairs (A2)."""
    return clusters(_spanning(spark, sf_dir, LOOSE))[0]


@query(
    f"""WITH RECURSIVE {CLUSTERS}
    SELECT m.cluster_id, any_value(size) AS size, round(min(similarity), 9) AS min_similarity, CASE WHEN bool_or(tier = 'similar') THEN 'similar' ELSE 'exact' END AS tier
    FROM pairs p JOIN members m ON p.left_id = m.frag_id JOIN (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1) s ON s.cluster_id = m.cluster_id GROUP BY 1"""
)
def cluster_summary(spark, sf_dir):
    """Size, lowest similarity and weakest tier of each cluster (A3, O3)."""
    return clusters(_spanning(spark, sf_dir, LOOSE))[1].select("cluster_id", "size", F.round("min_similarity", 9).alias("min_similarity"), "tier")


def _runs(spark, sf_dir, role):
    fragments = _fragments(spark, sf_dir)
    return runs_of.line_runs(cut(shingle_lines(fragments)), fragments, CONTAINMENT).where(F.col("role") == role).select("host_id", "length", "start_line", "end_line", "n")


_RUN_COLUMNS = "host_id, length::INT AS length, start_line::INT AS start_line, end_line::INT AS end_line, n::INT AS n"


@query(f"WITH {RUNS} SELECT {_RUN_COLUMNS} FROM runs WHERE role = 'prefix'")
def prefix_runs(spark, sf_dir):
    """Eligible leading runs and their fingerprint sizes."""
    return _runs(spark, sf_dir, "prefix")


@query(f"WITH {RUNS} SELECT {_RUN_COLUMNS} FROM runs WHERE role = 'suffix'")
def suffix_runs(spark, sf_dir):
    """Eligible trailing runs and their fingerprint sizes."""
    return _runs(spark, sf_dir, "suffix")


@query(f"WITH {FRAG}, k AS (SELECT DISTINCT frag_id, greatest(ceil(exec_lines * i / 8.0), 1)::INT AS length, exec_lines FROM sized, (SELECT unnest(range(1, 7)) AS i)) SELECT frag_id, length FROM k WHERE length < exec_lines AND length >= 10 AND length / exec_lines <= 0.85 QUALIFY row_number() OVER (PARTITION BY frag_id ORDER BY length) <= 6")
def probe_ladder(spark, sf_dir):
    """Run lengths at eighths."""
    return _fragments(spark, sf_dir).select("frag_id", F.explode(runs_of.probe_ladder(F.col("exec_lines"), CONTAINMENT)).alias("length"))


@query(f"WITH {RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY host_id, role ORDER BY length) AS place, count(*) OVER (PARTITION BY host_id, role) AS c FROM runs) SELECT role, {_RUN_COLUMNS} FROM p WHERE (place - 1) % ceil(c / 8.0)::BIGINT = 0")
def stride_runs(spark, sf_dir):
    """At most eight runs of a host and role, spread over its lengths."""
    fragments = _fragments(spark, sf_dir)
    return runs_of.strided(runs_of.line_runs(cut(shingle_lines(fragments)), fragments, CONTAINMENT), 8).select("role", "host_id", "length", "start_line", "end_line", "n")


@query(f"WITH {SCORES} SELECT contained_id, host_id, role, length::INT AS length, shared::BIGINT AS shared, n_contained::INT AS n_contained, n_run::INT AS n_run, round(score, 9) AS score, round(balance, 9) AS balance, tier FROM accepted")
def containment_scores(spark, sf_dir):
    """Every run that a tier accepts as another fragment."""
    return _scores(spark, sf_dir).select("contained_id", "host_id", "role", "length", "shared", "n_contained", "n_run", F.round("score", 9).alias("score"), F.round("balance", 9).alias("balance"), "tier")


_FINDING = "contained_id, container_id, role, start_line::INT AS start_line, end_line::INT AS end_line, statement_count::INT AS statement_count, round(score, 9) AS score, tier"


@query(f"WITH {FINDINGS} SELECT {_FINDING} FROM findings")
def containment_findings(spark, sf_dir):
    """The best run of each two fragments."""
    return _findings(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {LOOSE_PAIRS}, spans AS (SELECT frag_id, frag_id % 2 AS file, frag_id % 13 AS s, frag_id % 13 + frag_id % 7 AS e FROM frag)
    SELECT left_id AS contained_id, right_id AS container_id FROM pairs JOIN spans a ON a.frag_id = left_id JOIN spans b ON b.frag_id = right_id
    WHERE a.file <> b.file OR NOT (a.s >= b.s AND a.e <= b.e OR b.s >= a.s AND b.e <= a.e)"""
)
def nested_filter(spark, sf_dir):
    """Findings whose spans do not enclose one another (F12): the similar pairs, over made-up spans in two files."""
    spans = _fragments(spark, sf_dir).selectExpr("frag_id", "frag_id % 2 as file_path", "frag_id % 13 as byte_start", "frag_id % 13 + frag_id % 7 as byte_end")
    return runs_of.drop_nested(_pairs(spark, sf_dir, LOOSE).select(F.col("left_id").alias("contained_id"), F.col("right_id").alias("container_id")), spans)


@query(f"""WITH {FINDINGS.replace(SHINGLES, JACCARD)} SELECT left_id, right_id, tier FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE least(contained_id, container_id) = left_id AND greatest(contained_id, container_id) = right_id)""")
def superseded_pairs(spark, sf_dir):
    """Accepted pairs without those that a containment describes better."""
    prints = _lean(spark, sf_dir)
    links, members = _links(spark, sf_dir, SCAN, prints)
    known = _finding_links(spark, sf_dir, prints)[0].select(F.col("left_id").alias("contained_id"), F.col("right_id").alias("container_id"))
    return pairs_of.pairs_of_links(cut(pairs_of.not_superseded(links, known)), members).select("left_id", "right_id", "tier")


@query(f"WITH {JACCARD} SELECT left_id, right_id, tier FROM pairs WHERE left_id IN (SELECT frag_id FROM fp WHERE source = '{FOCUS_SOURCE}') OR right_id IN (SELECT frag_id FROM fp WHERE source = '{FOCUS_SOURCE}')")
def focus_pairs(spark, sf_dir):
    """Pairs with a side of one source."""
    focus = _table(spark, sf_dir, "documents").where(F.col("source") == FOCUS_SOURCE).select(F.col("doc_id").alias("frag_id"))
    return pairs_of.in_focus(_pairs(spark, sf_dir), focus).select("left_id", "right_id", "tier")


@query(
    r"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
    items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark),
    d AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
    b AS (SELECT DISTINCT item_id, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS i FROM items)),
    n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
    SELECT item_id, doc_id, count(*)::INT AS shared, any_value(n.n)::INT AS n_item, round(count(*) / any_value(n.n), 9) AS score FROM b JOIN d USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) / any_value(n.n) >= 0.85"""
)
def benchmark_contamination(spark, sf_dir):
    """Benchmark items that a document contains for the most part: directed containment between two tables."""
    items = fingerprints(text_fragments(_table(spark, sf_dir, "benchmark"), "item_id", ())).where("n > 0")
    docs = fingerprints(_fragments(spark, sf_dir)).select(F.col("frag_id").alias("doc_id"), F.explode("shingles").alias("shingle"))
    asked = items.select(F.col("frag_id").alias("item_id"), F.col("n").alias("n_item"), F.explode("shingles").alias("shingle"))
    shared = asked.join(docs, "shingle").groupBy("item_id", "doc_id", "n_item").agg(F.count("*").cast("int").alias("shared"))
    return shared.withColumn("score", F.round(containment(F.col("shared"), F.col("n_item"), F.col("n_item")), 9)).where("score >= 0.85").select("item_id", "doc_id", "shared", "n_item", "score")


@query(
    f"""WITH RECURSIVE {FINDINGS.replace(SHINGLES, JACCARD + _MEMBERS)}, ends AS (SELECT left_id AS frag_id FROM pairs UNION SELECT right_id FROM pairs)
    SELECT (SELECT count(*) FROM documents) AS files_scanned, (SELECT count(DISTINCT cluster_id) FROM members) AS clusters, (SELECT count(*) FROM fp) AS fragments, (SELECT count(*) FROM pairs) AS clone_pairs, (SELECT count(*) FROM findings) AS containment_findings,
        (SELECT count(*) FROM ends) AS fragments_in_clones, (SELECT count(DISTINCT source) FROM ends JOIN fp USING (frag_id)) AS files_with_clones,
        (SELECT round(min(similarity), 9) FROM pairs) AS min_similarity, (SELECT round(max(similarity), 9) FROM pairs) AS max_similarity, (SELECT round(avg(similarity), 9) FROM pairs) AS avg_similarity,
        coalesce(round(100 * (SELECT count(*) FROM ends) / nullif((SELECT count(*) FROM fp), 0), 9), 0) AS percent_in_clones"""
)
def scan_stats(spark, sf_dir):
    """The scan's counts and similarities in one row."""
    prints = _lean(spark, sf_dir)
    links, members = _links(spark, sf_dir, SCAN, prints)
    scanned = _table(spark, sf_dir, "documents").select(F.count("*").alias("files_scanned"))
    groups = clusters(pairs_of.spanning_pairs(links, members))[1]
    row = scan_statistics(prints.withColumn("file_path", F.col("source")), links, _finding_links(spark, sf_dir, prints)[0], scanned, groups, pairs_of.ends_of_links(links, members))
    return row.select("files_scanned", "clusters", "fragments", "clone_pairs", "containment_findings", "fragments_in_clones", "files_with_clones", *[F.round(c, 9).alias(c) for c in ("min_similarity", "max_similarity", "avg_similarity", "percent_in_clones")])


@query(f"WITH {LOOSE_PAIRS} SELECT count(*) FILTER (WHERE tier = 'exact') AS exact_pairs, count(*) FILTER (WHERE tier = 'similar') AS similar_pairs FROM pairs")
def tier_histogram(spark, sf_dir):
    """Pairs by tier."""
    return _links(spark, sf_dir, LOOSE)[0].agg(*pair_counts(F.col("weight"))).select("exact_pairs", "similar_pairs")


@query(f"WITH {LOOSE_PAIRS} SELECT count(*) FILTER (WHERE similarity = 1) AS identical, count(*) FILTER (WHERE similarity < 1 AND similarity >= 0.9) AS high, count(*) FILTER (WHERE similarity < 0.9) AS rest FROM pairs")
def score_histogram(spark, sf_dir):
    """Pairs by score (A7): an identical fingerprint need not be of the exact tier."""
    return _links(spark, sf_dir, LOOSE)[0].agg(*pair_counts(F.col("weight"))).select("identical", "high", "rest")


@query(
    f"""WITH {FINDINGS.replace(SHINGLES, JACCARD)},
    c AS (SELECT source, count(DISTINCT f) AS clone_count FROM (SELECT left_id AS f FROM pairs UNION SELECT right_id FROM pairs) JOIN fp ON fp.frag_id = f GROUP BY 1),
    k AS (SELECT source, count(DISTINCT f) AS containment_count FROM (SELECT contained_id AS f FROM findings UNION SELECT container_id FROM findings) JOIN fp ON fp.frag_id = f GROUP BY 1)
    SELECT source AS file_path, coalesce(clone_count, 0) AS clone_count, coalesce(containment_count, 0) AS containment_count FROM c FULL JOIN k USING (source)"""
)
def file_overview_counts(spark, sf_dir):
    """Fragments with findings for each source."""
    prints = _lean(spark, sf_dir)
    clones, contained = _links(spark, sf_dir, SCAN, prints), _finding_links(spark, sf_dir, prints)
    return overview_of_ends(prints.withColumn("file_path", F.col("source")), pairs_of.ends_of_links(*clones), pairs_of.ends_of_links(*contained)).select("file_path", "clone_count", "containment_count")


_BOTH_WAYS = "ways AS (SELECT left_id AS frag_id, right_id AS partner_id, * FROM pairs UNION ALL SELECT right_id, left_id, * FROM pairs)"


@query(f"WITH {LOOSE_PAIRS}, {_BOTH_WAYS} SELECT frag_id, partner_id, round(similarity, 9) AS similarity, tier FROM ways QUALIFY row_number() OVER (PARTITION BY frag_id ORDER BY similarity DESC, left_id DESC, right_id DESC) = 1")
def best_partner(spark, sf_dir):
    """Each fragment's best partner, of equals the last in the order of pairs."""
    return best_partners(_pairs(spark, sf_dir, LOOSE)).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {LOOSE_PAIRS}, {_BOTH_WAYS} SELECT frag_id, string_agg(partner_id::VARCHAR, ',' ORDER BY similarity DESC, partner_id) AS partners FROM ways GROUP BY 1")
def partner_list(spark, sf_dir):
    """All partners of each fragment, best first (K4)."""
    return partner_lists(_pairs(spark, sf_dir, LOOSE)).select("frag_id", F.array_join("partners.partner_id", ",").alias("partners"))


@query(
    f"""WITH {SHINGLES}, bands AS (SELECT frag_id, seed AS band, min(md5(concat(seed, ':', s))) AS key FROM sh, (SELECT unnest(range(1, 5)) AS seed) GROUP BY 1, 2),
    b AS (SELECT band, key, count(*) AS c FROM bands GROUP BY 1, 2) SELECT sum(c)::BIGINT AS entries, count(*) AS buckets, round(quantile_cont(c, 0.99), 9) AS p99, max(c) AS largest FROM b"""
)
def bucket_occupancy(spark, sf_dir):
    """Sizes of four bands' buckets."""
    return pairs_of.bucket_occupancy(_md5_signed(spark, sf_dir, 4), 4, 1, _md5_key).withColumn("p99", F.round("p99", 9))


_TRUTH = "SELECT l_orderkey % 500 AS source_file, l_linenumber * 10 AS source_start, l_linenumber * 10 + 8 AS source_end, l_partkey % 400 AS target_file, 5 AS target_start, 5 + CAST(l_quantity AS INT) AS target_end, l_returnflag AS tier, concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', CAST(round(l_extendedprice * 100) AS BIGINT)) AS entry_id FROM lineitem"
_FOUND = "SELECT l_partkey % 400 AS left_file, 7 AS left_start, 5 + CAST(l_quantity AS INT) AS left_end, l_orderkey % 500 AS right_file, l_linenumber * 10 + l_suppkey % 5 AS right_start, l_linenumber * 10 + 8 AS right_end, concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', CAST(round(l_extendedprice * 100) AS BIGINT)) AS pair_id FROM lineitem"


def _match_sql() -> str:
    iou = lambda a, b: f"(greatest(least({a}_end, {b}_end) - greatest({a}_start, {b}_start) + 1, 0) / (({a}_end - {a}_start + 1) + ({b}_end - {b}_start + 1) - greatest(least({a}_end, {b}_end) - greatest({a}_start, {b}_start) + 1, 0)))"
    straight = f"source_file = left_file AND target_file = right_file AND {iou('source', 'left')} >= 0.5 AND {iou('target', 'right')} >= 0.5"
    crossed = f"source_file = right_file AND target_file = left_file AND {iou('source', 'right')} >= 0.5 AND {iou('target', 'left')} >= 0.5"
    return f"truth AS ({_TRUTH}), found AS ({_FOUND}), matches AS (SELECT entry_id, tier, pair_id FROM truth JOIN found ON {straight} UNION SELECT entry_id, tier, pair_id FROM truth JOIN found ON {crossed})"


def _evaluation(spark, sf_dir):
    """A manifest and detections made up from order lines."""
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_TRUTH), spark.sql(_FOUND)


@query(f"WITH {_match_sql()} SELECT entry_id, tier, pair_id FROM matches")
def iou_match(spark, sf_dir):
    """Detections that overlap a known duplicate on both sides, either way round."""
    return match_pairs(*_evaluation(spark, sf_dir)).select("entry_id", "tier", "pair_id")


@query(
    f"""WITH {_match_sql()}, t AS (SELECT tier, count(*) AS total, count(DISTINCT CASE WHEN entry_id IN (SELECT entry_id FROM matches) THEN entry_id END) AS tp FROM truth GROUP BY tier),
    u AS (SELECT count(*) AS fp FROM found WHERE pair_id NOT IN (SELECT pair_id FROM matches)),
    r AS (SELECT tier, tp, 0::BIGINT AS fp, total - tp AS fn FROM t UNION ALL SELECT 'total', sum(tp)::BIGINT, (SELECT fp FROM u), sum(total - tp)::BIGINT FROM t)
    SELECT tier, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision_, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM r"""
)
def precision_recall_f1(spark, sf_dir):
    """Quality by tier and in total."""
    truth, found = _evaluation(spark, sf_dir)
    return precision_recall(truth, found).select("tier", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision_", "recall", "f1")])


@query("SELECT doc_id AS frag_id, array_to_string(string_split(coalesce(text, ''), chr(10))[1:3], chr(10)) AS head FROM documents")
def source_heads(spark, sf_dir):
    """The first lines of each source."""
    return _fragments(spark, sf_dir).select("frag_id", source_head(F.col("text"), 3).alias("head"))


@query("SELECT c_custkey, c_nationkey, round(least(c_custkey % 50, 40) / greatest(c_custkey % 50, 40), 9) AS balance FROM customer WHERE c_custkey % 50 > 0 UNION ALL SELECT c_custkey, c_nationkey, NULL FROM customer WHERE c_custkey % 50 = 0")
def size_balance(spark, sf_dir):
    """Balance of two sizes, null where one is zero."""
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.round(balance(F.col("c_custkey") % 50, F.lit(40)), 9).alias("balance"))


@query("SELECT 1 + l_linenumber AS size, round(least(l_linenumber + 9, 15) - greatest(l_linenumber, 6) + 1, 9) AS shared, round(greatest(least(l_linenumber + 9, 15) - greatest(l_linenumber, 6) + 1, 0) / (10 + 10 - greatest(least(l_linenumber + 9, 15) - greatest(l_linenumber, 6) + 1, 0)), 9) AS iou, count(*) AS n FROM lineitem GROUP BY ALL")
def line_overlaps(spark, sf_dir):
    """Overlap of lines n to n + 9 with lines 6 to 15."""
    n = F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select((n + 1).alias("size"), (F.least(n + 9, F.lit(15)) - F.greatest(n, F.lit(6)) + 1).alias("shared"), F.round(line_iou(n, n + 9, F.lit(6), F.lit(15)), 9).alias("iou"))
    return rows.groupBy("size", "shared", "iou").agg(F.count("*").alias("n"))


# Python sources made from rows: three of each class differ in names alone, and a class in its numbers.
_BODY = """    kept_{k} = [{c}]
    for r in rows_{k}:
        if r.size > {c}:
            kept_{k}.append(r.name + {c})
        else:
            log(r.name, {c})
    kept_{k}.sort(key={c})
    total = len(kept_{k}) * {c}
    report(total, {c})
    flush(kept_{k}, {c})
"""
_ALONE = "# file {k}\ndef f_{k}(rows_{k}, limit={c}):\n" + _BODY + "    return kept_{k}[{c}], total\n"
_INSIDE = "def part_{k}(rows_{k}):\n" + _BODY + "\ndef host_{k}(rows_{k}):\n" + _BODY + "".join(f"    step_{i} = call_{i}({{c}}, total, {i})\n" for i in range(5)) + "    return step_1, step_2\n"


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Keys dealt over all cores: a column of numbers is one task's worth to read, and the sources made from it are not."""
    return rows.select(key).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _sources(rows: DataFrame, key: str, template: str, every: int) -> DataFrame:
    rows = _dealt(rows, key)
    k = F.col(key).cast("string")
    c = F.floor(F.col(key) / every).cast("string")
    text = F.replace(F.replace(F.lit(template), F.lit("{k}"), k), F.lit("{c}"), c)
    return rows.select(F.concat(F.lit("src/f"), F.lpad(k, 12, "0"), F.lit(".py")).alias("file_path"), F.encode(text, "UTF-8").alias("source"), F.lit("ok").alias("status"))


def _code_report(spark, sf_dir, **settings):
    config = Config()
    for section, values in settings.items():
        config = config.with_settings(section, **values)
    return scan_files(_sources(_table(spark, sf_dir, "part"), "p_partkey", _ALONE, 3), config)


def _named(report, df, *columns):
    f = report.fragments.select("frag_id", "file_path", "name")
    for c in columns:
        df = df.join(f.select(F.col("frag_id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name")), f"{c}_id")
    return df


@query("SELECT concat('src/f', lpad(p_partkey::VARCHAR, 12, '0'), '.py') AS file_path, concat('f_', p_partkey) AS name, 1::INT AS start_line, 12::INT AS end_line, 11::INT AS exec_lines, 7::INT AS exec_stmts, 'ok' AS status FROM part")
def ast_functions(spark, sf_dir):
    """Functions of source files, with their places and sizes."""
    return python_fragments(_sources(_table(spark, sf_dir, "part"), "p_partkey", _ALONE, 3), Config()).where("name is not null").select("file_path", "name", "start_line", "end_line", "exec_lines", "exec_stmts", "status")


@query("SELECT concat('f_', a.p_partkey) AS left_name, concat('f_', b.p_partkey) AS right_name, 1.0::DOUBLE AS similarity, 'exact' AS tier FROM part a JOIN part b ON a.p_partkey // 3 = b.p_partkey // 3 AND a.p_partkey < b.p_partkey")
def ast_pairs(spark, sf_dir):
    """Duplicate functions of a whole scan (W1, J1, J2, J3, F7): renamed copies alone."""
    report = _code_report(spark, sf_dir)
    return _named(report, report.pairs, "left", "right").select("left_name", "right_name", "similarity", "tier")


@query("SELECT concat('f_', a.p_partkey) AS left_name, concat('f_', b.p_partkey) AS right_name, 1.0::DOUBLE AS score, 0::INT AS hole_count FROM part a JOIN part b ON a.p_partkey // 3 = b.p_partkey // 3 AND a.p_partkey < b.p_partkey")
def ast_suggestions(spark, sf_dir):
    """Templates of all pairs of a scan."""
    report = _code_report(spark, sf_dir, suggest={"enabled": True})
    return _named(report, report.suggestions, "left", "right").select("left_name", "right_name", "score", "hole_count")


# Pairs of functions that differ in the number of m of nine calls; m and the tree's parts give score and similarity.
_SITES = "def f_{k}(rows_{k}):\n    total = 0\n" + "".join(f"    total += work_{i}({{v{i}}}, rows_{{k}})\n" for i in range(9)) + "    return total\n"


def _site_sources(spark, sf_dir) -> DataFrame:
    k, c = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 2)
    text = F.replace(F.lit(_SITES), F.lit("{k}"), k)
    for i in range(9):
        text = F.replace(text, F.lit(f"{{v{i}}}"), F.when(F.lit(i) < c % 9, k).otherwise(c.cast("string")))
    rows = _dealt(_table(spark, sf_dir, "part"), "p_partkey")
    return rows.select(F.concat(F.lit("src/f"), F.lpad(k, 12, "0"), F.lit(".py")).alias("file_path"), F.encode(text, "UTF-8").alias("source"), F.lit("ok").alias("status"))


#: A call and the addition that holds it tell m of nine apart; nine statements, the block and the function never do.
_SITE_PAIRS = "(SELECT concat('f_', a.p_partkey) AS left_name, concat('f_', b.p_partkey) AS right_name, a.p_partkey // 2 % 9 AS m FROM part a JOIN part b ON a.p_partkey // 2 = b.p_partkey // 2 AND a.p_partkey < b.p_partkey)"


@query(f"SELECT left_name, right_name, round((29 - 2 * m) / (29 + 2 * m), 9) AS similarity, CASE WHEN m = 0 THEN 'exact' ELSE 'similar' END AS tier FROM {_SITE_PAIRS} WHERE (29 - 2 * m) / (29 + 2 * m) >= 0.5")
def ast_similar_pairs(spark, sf_dir):
    """Functions that are alike to different degrees (P9, P18, J2, J3, F7): m of nine numbers differ."""
    report = scan_files(_site_sources(spark, sf_dir), Config().with_settings("scan", threshold=0.5))
    return _named(report, report.pairs, "left", "right").select("left_name", "right_name", F.round("similarity", 9).alias("similarity"), "tier")


@query(f"SELECT left_name, right_name, round((83 - m) / 83, 9) AS score, m::INT AS hole_count FROM {_SITE_PAIRS} WHERE m <= 3")
def ast_holes(spark, sf_dir):
    """Templates with a hole for each number that differs; those with too many are suppressed."""
    report = scan_files(_site_sources(spark, sf_dir), Config().with_settings("scan", threshold=0.5).with_settings("suggest", enabled=True, max_holes=3))
    return _named(report, report.suggestions, "left", "right").select("left_name", "right_name", F.round("score", 9).alias("score"), "hole_count")


@query("SELECT concat('part_', s_suppkey) AS contained_name, concat('host_', s_suppkey) AS container_name, 'prefix' AS role, 13::INT AS start_line, 22::INT AS end_line, 6::INT AS statement_count, 1.0::DOUBLE AS score, 'exact' AS tier FROM supplier")
def ast_containment(spark, sf_dir):
    """Functions that are a leading run of another's statements."""
    report = scan_files(_sources(_table(spark, sf_dir, "supplier"), "s_suppkey", _INSIDE, 1), Config().with_settings("containment", enabled=True, min_fragment_lines=8))
    return _named(report, report.containments, "contained", "container").select("contained_name", "container_name", "role", "start_line", "end_line", "statement_count", "score", "tier")


_AT_END = "def part_{k}(rows_{k}):\n" + _BODY + "\ndef host_{k}(rows_{k}, total):\n" + "".join(f"    step_{i} = call_{i}({{c}}, total, {i})\n" for i in range(5)) + _BODY


@query("SELECT concat('part_', s_suppkey) AS contained_name, concat('host_', s_suppkey) AS container_name, 'suffix' AS role, 18::INT AS start_line, 27::INT AS end_line, 6::INT AS statement_count, 1.0::DOUBLE AS score, 'exact' AS tier FROM supplier")
def ast_suffix_containment(spark, sf_dir):
    """Functions that are a trailing run of another's statements, whose names are numbered anew."""
    report = scan_files(_sources(_table(spark, sf_dir, "supplier"), "s_suppkey", _AT_END, 1), Config().with_settings("containment", enabled=True, min_fragment_lines=8))
    return _named(report, report.containments, "contained", "container").select("contained_name", "container_name", "role", "start_line", "end_line", "statement_count", "score", "tier")


# One function in many forms: for each, what it is changed to, and under which settings its root hash is still the same.
_PLAIN = "def f_{k}(rows, limit):\n    kept = rows.first() + limit\n    if kept > limit:\n        report(kept, 'a', 7)\n    return kept\n"
_FORMS = (
    ("renamed", _PLAIN.replace("kept", "found").replace("rows", "items").replace("limit", "bound"), "TRUE", "TRUE", "TRUE"),
    ("commented", _PLAIN.replace("    if", "    # why\n    if").replace("    kept = rows", '    "what it does"\n    kept = rows'), "TRUE", "TRUE", "TRUE"),
    ("decorated", "@marked(1)\n" + _PLAIN, "TRUE", "TRUE", "TRUE"),
    ("annotated", _PLAIN.replace("rows,", "rows: list,").replace("):", ") -> int:", 1), "FALSE", "FALSE", "FALSE"),
    ("other_sign", _PLAIN.replace("> limit", "<= limit").replace("+ limit", "- limit"), "TRUE", "TRUE", "TRUE"),
    ("other_literals", _PLAIN.replace("'a'", "'b'").replace("7", "8"), "FALSE", "TRUE", "FALSE"),
    ("other_kind_of_literal", _PLAIN.replace("7", "'7'"), "FALSE", "FALSE", "FALSE"),
    ("swapped", _PLAIN.replace("rows.first() + limit", "limit + rows.first()"), "FALSE", "FALSE", "TRUE"),
    ("other_call", _PLAIN.replace("report", "log"), "FALSE", "FALSE", "FALSE"),
    ("positional", _PLAIN.replace("rows, limit", "rows, /, limit"), "FALSE", "FALSE", "FALSE"),
    ("longer", _PLAIN.replace("    return", "    kept = 2 * kept\n    return"), "FALSE", "FALSE", "FALSE"),
)


@query(
    "SELECT p_partkey, form, plain, any_literal, any_order FROM part, (VALUES "
    + ", ".join(f"('{name}', {a}, {b}, {c})" for name, _, a, b, c in _FORMS)
    + ") AS forms(form, plain, any_literal, any_order)"
)
def ast_normalised_forms(spark, sf_dir):
    """Whether forms of a function have its root hash: by default, with literals by kind, with commutative operands sorted."""
    parts = _table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    out = None
    for column, settings in (("plain", {}), ("any_literal", {"anonymize_literals": True}), ("any_order", {"sort_commutative": True})):
        hashes = []
        for name, text, *_ in (("", _PLAIN), *_FORMS):
            rows = parts.select(F.concat(F.lit(f"{name}/"), k).alias("file_path"), F.encode(F.replace(F.lit(text), F.lit("{k}"), k), "UTF-8").alias("source"), F.lit("ok").alias("status"))
            hashes.append(rows)
        files = hashes[0]
        for more in hashes[1:]:
            files = files.unionByName(more)
        config = Config().with_settings("scan", min_lines=1).with_settings("normalization", **settings)
        made = cut(python_fragments(files, config).where("name is not null").select(F.substring_index("file_path", "/", 1).alias("form"), F.substring_index("file_path", "/", -1).cast("long").alias("p_partkey"), "root_hash"))
        plain = made.where("form = ''").select("p_partkey", F.col("root_hash").alias("own"))
        found = made.where("form <> ''").join(plain, "p_partkey").select("p_partkey", "form", (F.col("root_hash") == F.col("own")).alias(column))
        out = found if out is None else out.join(found, ["p_partkey", "form"])
    return out


_BODIES = "CASE s_suppkey % 5 WHEN 0 THEN '    pass' WHEN 1 THEN '    ...' WHEN 2 THEN '    \"just words\"' WHEN 3 THEN '    pass' || chr(10) || '    return 1' ELSE '    x = 1' || chr(10) || '' || chr(10) || '    # words' || chr(10) || '    return x' END"


@query("SELECT concat('f_', s_suppkey) AS name, s_suppkey % 5 >= 3 AS has_body, [1, 1, 0, 2, 2][s_suppkey % 5 + 1]::INT AS exec_stmts, [2, 2, 1, 3, 3][s_suppkey % 5 + 1]::INT AS exec_lines FROM supplier")
def ast_bodies(spark, sf_dir):
    """Whether a body does anything, its statements and its lines that count."""
    body = F.expr(_BODIES.replace("chr(10)", "'\n'").replace('"just words"', '\\"just words\\"').replace('\\"', '"'))
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_path"), F.encode(F.concat(F.lit("def f_"), F.col("s_suppkey"), F.lit("():\n"), body, F.lit("\n")), "UTF-8").alias("source"), F.lit("ok").alias("status"))
    made = python_fragments(rows, Config().with_settings("scan", min_lines=1)).where("name is not null")
    return made.select("name", "has_body", "exec_stmts", "exec_lines")


@query(
    """SELECT count(*) FILTER (WHERE s_suppkey % 4 = 0) AS config_files, count(*) FILTER (WHERE s_suppkey % 4 = 1) AS file_comments, count(*) FILTER (WHERE s_suppkey % 4 = 2) AS inline_functions,
        count(*) FILTER (WHERE s_suppkey % 4 = 3) AS functions FROM supplier"""
)
def suppression_counts(spark, sf_dir):
    """Files and functions that settings and comments keep out."""
    k = F.col("s_suppkey")
    status = F.when(k % 4 == 0, "suppressed").otherwise("ok")
    mark = F.when(k % 4 == 1, "# dupeloom: ignore-file\n").when(k % 4 == 2, "# dupeloom: ignore -- why\n").otherwise("# none\n")
    text = F.concat(mark, F.replace(F.replace(F.lit(_ALONE.split("\n", 1)[1]), F.lit("{k}"), k.cast("string")), F.lit("{c}"), k.cast("string")))
    rows = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k).alias("file_path"), F.when(k % 4 > 0, F.encode(text, "UTF-8")).alias("source"), status.alias("status"))
    report = scan_files(rows, Config())
    return spark.createDataFrame([(*report.suppressed().values(), report.fragments.count())], "config_files long, file_comments long, inline_functions long, functions long")


@query(
    f"""SELECT left_name, right_name, concat('def f_', k, '(rows_', k, '):', chr(10), '    total = 0', chr(10),
        list_aggregate(list_transform(range(9), lambda i: concat('    total += work_', i, '(', CASE WHEN i < m THEN concat('$HOLE_', i) ELSE (k // 2)::VARCHAR END, ', rows_', k, ')', chr(10))), 'string_agg', ''), '    return total',
        list_aggregate(list_transform(range(m), lambda i: concat(chr(10), '# $HOLE_', i, ', literal: ', k, ' | ', k + 1)), 'string_agg', '')) AS rendered
    FROM (SELECT left_name, right_name, m, replace(left_name, 'f_', '')::BIGINT AS k FROM {_SITE_PAIRS}) WHERE m BETWEEN 1 AND 3"""
)
def ast_rendered_templates(spark, sf_dir):
    """Templates as text: holes by name in the left source, and both sides of each."""
    report = scan_files(_site_sources(spark, sf_dir), Config().with_settings("scan", threshold=0.5).with_settings("suggest", enabled=True, max_holes=3))
    return _named(report, report.suggestions.where("hole_count > 0"), "left", "right").select("left_name", "right_name", "rendered")


@query(
    f"""WITH RECURSIVE {CLUSTERS},
    summary AS (SELECT m.cluster_id, any_value(size) AS size, min(similarity) AS min_similarity FROM pairs p JOIN members m ON p.left_id = m.frag_id JOIN (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1) s ON s.cluster_id = m.cluster_id GROUP BY 1)
    SELECT cluster_id, row_number() OVER (ORDER BY min_similarity DESC, size DESC, cluster_id) AS place FROM summary"""
)
def cluster_order(spark, sf_dir):
    """Clusters in the order of the report (O3)."""
    summary = clusters(_spanning(spark, sf_dir, LOOSE))[1]
    return pairs_of.with_rank(summary, F.desc("min_similarity"), F.desc("size"), "cluster_id", rank="place").select("cluster_id", "place")


@query(f"WITH {FINDINGS}, o AS (SELECT contained_id, container_id, row_number() OVER (ORDER BY score DESC, container_id, contained_id) AS place FROM findings) SELECT frag_id, min_by(kind, place) AS kind, min_by(other, place) AS other_id FROM (SELECT container_id AS frag_id, 'contains' AS kind, contained_id AS other, place FROM o UNION ALL SELECT contained_id, 'contained_in', container_id, place FROM o) GROUP BY 1")
def first_containment(spark, sf_dir):
    """The first containment, in the order of the report, that a fragment is a side of."""
    prints = _lean(spark, sf_dir)
    none = _pairs(spark, sf_dir, SCAN, prints).where(F.lit(False))
    return function_entries(prints.select("frag_id"), none, _findings(spark, sf_dir, prints)).select("frag_id", "containment.kind", "containment.other_id")


@query(
    f"""WITH {JACCARD}, ends AS (SELECT left_id AS frag_id FROM pairs UNION SELECT right_id FROM pairs), c AS (SELECT source, count(*) AS n FROM ends JOIN fp USING (frag_id) GROUP BY 1)
    SELECT source AS file_path, row_number() OVER (ORDER BY n DESC, source) AS place FROM c"""
)
def file_order(spark, sf_dir):
    """Files by their number of findings, then by path."""
    prints = _lean(spark, sf_dir)
    overview = file_overview(prints.withColumn("file_path", F.col("source")), _pairs(spark, sf_dir, SCAN, prints))
    return pairs_of.with_rank(overview, *overview_order(), rank="place").select("file_path", "place")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT concat(a.frag_id, ':', b.frag_id) AS pair_id FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.frag_id < b.frag_id")
def cluster_member_pairs(spark, sf_dir):
    """Each two members of a cluster, as an evaluation takes them (bench side)."""
    fragments = _fragments(spark, sf_dir).select("frag_id", F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.col("exec_lines").alias("end_line"))
    return cluster_pairs(clusters(_spanning(spark, sf_dir, LOOSE))[0], fragments).select("pair_id")


@query()
def report_json(spark, sf_dir):
    """The report of a scan as JSON, one row (K2)."""
    return spark.createDataFrame([(format_json(_code_report(spark, sf_dir)),)], "report string")


@query()
def report_sarif(spark, sf_dir):
    """The report of a scan as SARIF, one row (K3)."""
    return spark.createDataFrame([(format_sarif(_code_report(spark, sf_dir)),)], "report string")
