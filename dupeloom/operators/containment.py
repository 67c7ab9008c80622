"""Directed containment: a whole fragment that is a leading or trailing run of another's lines.

For texts.  Every distinct shingle has the first line it ends on and the last it starts on, so the shingles of
all runs of a host, and those of them that another fragment has, are running counts over lines: all run lengths
are tried without making a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ContainmentConfig
from ..functions.measures import balance, containment, run_tier
from .components import cut, cut_and_drop
from .pairs import by_rarity, first_elements, prefix_length, repeated_hashes, those_of

#: Run lengths looked at for a host and role where they are strided.
MOST_RUNS = 64
#: Of the elements that a run must share with the contained set, the part that must be seen before the two meet.
MORE = 0.15


def eligible(length: Column, total: Column, lines: Column, config: ContainmentConfig) -> Column:
    """Runs that are a part, not too large a one, and long enough for either tier."""
    return (length > 0) & (length < total) & (length / total <= config.max_run_fraction) & (lines >= config.candidate_floor)


def line_runs(shingle_lines: DataFrame, fragments: DataFrame, config: ContainmentConfig) -> DataFrame:
    """host_id, role, length, start_line, end_line, n: the eligible runs of each fragment and their number of distinct shingles."""
    total = F.col("exec_lines")
    steps = fragments.where("exec_lines > 1").select(F.col("frag_id").alias("host_id"), "exec_lines", F.explode(F.sequence(F.lit(1), total - 1)).alias("length"))
    lead = shingle_lines.groupBy(F.col("frag_id").alias("host_id"), F.col("first_end").alias("length")).agg(F.count("*").alias("new"))
    size = fragments.select(F.col("frag_id").alias("host_id"), "exec_lines")
    trail = shingle_lines.join(size, shingle_lines.frag_id == size.host_id).groupBy("host_id", (F.col("exec_lines") - F.col("last_start") + 1).alias("length")).agg(F.count("*").alias("new"))
    along = Window.partitionBy("host_id").orderBy("length")
    out = None
    for role, new in (("prefix", lead), ("suffix", trail)):
        counted = steps.join(new, ["host_id", "length"], "left").withColumn("n", F.coalesce(F.sum("new").over(along), F.lit(0)))
        runs = counted.where(eligible(F.col("length"), total, F.col("length"), config))
        start = F.lit(1) if role == "prefix" else total - F.col("length") + 1
        rows = runs.select("host_id", F.lit(role).alias("role"), "length", start.cast("int").alias("start_line"), (start + F.col("length") - 1).cast("int").alias("end_line"), F.col("n").cast("int").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def probe_ladder(total: Column, config: ContainmentConfig) -> Column:
    """Run lengths at eighths of the statements, rounded up, that are eligible: the first half of the probes allowed."""
    steps = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.greatest(F.ceil(total * i / F.lit(8.0)), F.lit(1)).cast("int"))))
    return F.slice(F.filter(steps, lambda k: eligible(k, total, k, config)), 1, max(1, config.max_probes_per_function // 2))


def strided(runs: DataFrame, most: int = MOST_RUNS) -> DataFrame:
    """Of each host's and role's runs every k-th, so that no more than ``most`` are left, spread over all lengths."""
    of = Window.partitionBy("host_id", "role")
    step = F.greatest(F.ceil(F.count("*").over(of) / F.lit(float(most))), F.lit(1))
    return runs.withColumns({"place": F.row_number().over(of.orderBy("length")), "step": step}).where((F.col("place") - 1) % F.col("step") == 0).drop("place", "step")


def containment_candidates(prints: DataFrame, config: ContainmentConfig) -> DataFrame:
    """contained_id, host_id: a host that shares one of the first hashes, rare ones first, of the contained one, and is not too long.

    A run within the balance that reaches the threshold shares threshold * balance_floor of the contained set at least.
    """
    share = max(config.threshold * config.balance_floor, 1e-6)
    ordered = by_rarity(prints.select("frag_id", "exec_lines", "shingles", "n"))
    probes = ordered.select(F.col("frag_id").alias("contained_id"), F.col("exec_lines").alias("contained_lines"), F.col("n").alias("contained_n"), F.explode(F.slice("ordered", F.lit(1), prefix_length(F.col("n"), share))).alias("shingle"))
    hosts = prints.select(F.col("frag_id").alias("host_id"), F.col("exec_lines").alias("host_lines"), F.col("n").alias("host_n"), F.explode("shingles").alias("shingle"))
    # no run is larger than its host, and one that is too small for the contained set is out of balance
    guard = (F.col("contained_lines") / F.col("host_lines") >= config.min_ratio) & (F.col("host_n") >= F.col("contained_n") * config.balance_floor - 1e-9)
    return probes.join(hosts, "shingle").where((F.col("contained_id") != F.col("host_id")) & guard).select("contained_id", "host_id").distinct()


def class_candidates(sets: DataFrame, members: DataFrame, config: ContainmentConfig) -> DataFrame:
    """contained_id, host_id: containment_candidates of classes of equal texts, by their smallest members; a class of copies is its own candidate.

    ``sets``: id (the hash of the root hash), exec_lines, shingles, n, made anew whenever they are read; ``members``:
    id, frag_id, rep_id, exec_lines.  Hosts are texts of which a run can be long enough, and what is shorter than all hosts allow is left out.
    """
    share = max(config.threshold * config.balance_floor, 1e-6)
    can_host = F.col("exec_lines") * config.max_run_fraction >= config.candidate_floor - 1e-9
    can_be_in = F.col("exec_lines") * config.max_run_fraction >= config.min_ratio * config.candidate_floor - 1e-9
    able = sets.where(can_be_in)
    once = lambda df: df.repartition("shingle").distinct()  # noqa: E731  of copies, in the shuffle that the join needs
    probes = once(first_elements(able, share, repeated_hashes(able), MORE * share)).select(F.col("id").alias("contained"), "shingle", F.col("n").alias("contained_n"))
    hosts = once(first_elements(sets.where(can_host), 0.0, None)).select(F.col("id").alias("host"), "shingle", F.col("n").alias("host_n"))
    fine = F.col("host_n") >= F.col("contained_n") * config.balance_floor - 1e-9
    counted = probes.join(hosts, "shingle").where((F.col("contained") != F.col("host")) & fine).groupBy("contained", "host", "contained_n").agg(F.count("*").alias("c"))
    met = counted.where(F.col("c") >= F.ceil(F.col("contained_n") * F.lit(MORE * share) - 1e-9)).select("contained", "host")
    reps = members.where("frag_id = rep_id")
    a = reps.select(F.col("id").alias("contained"), F.col("frag_id").alias("contained_id"), F.col("exec_lines").alias("contained_lines"))
    b = reps.select(F.col("id").alias("host"), F.col("frag_id").alias("host_id"), F.col("exec_lines").alias("host_lines"))
    two = met.join(a, "contained").join(b, "host").where(F.col("contained_lines") / F.col("host_lines") >= config.min_ratio).select("contained_id", "host_id")
    copies = members.where(can_host & (F.col("frag_id") != F.col("rep_id"))).select("rep_id").distinct()
    return two.unionByName(copies.select(F.col("rep_id").alias("contained_id"), F.col("rep_id").alias("host_id")))


def _accepted_runs(own: np.ndarray, shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: int, config: ContainmentConfig) -> Iterator[tuple]:
    """(role, length, start_line, end_line, shared, n_contained, n_run, score, balance, tier) of a host's runs that a tier accepts as the set ``own``.

    The host: its shingles in order, with the lines on which each starts and ends.
    """
    distinct, of = np.unique(shingles, return_inverse=True)
    first_end, last_start = np.full(len(distinct), total + 1), np.zeros(len(distinct), dtype=np.int64)
    np.minimum.at(first_end, of, ends)
    np.maximum.at(last_start, of, starts)
    held = np.isin(distinct, own)
    n, length = len(own), np.arange(1, total)
    fits = (length / total <= config.max_run_fraction) & (length >= config.candidate_floor)
    for role, ready in (("prefix", first_end), ("suffix", total - last_start + 1)):
        n_run, shared = (np.cumsum(np.bincount(x, minlength=total + 2))[1:total] for x in (ready, ready[held]))
        smaller, larger = np.minimum(n_run, n), np.maximum(n_run, n)
        score, even = shared / np.maximum(smaller, 1), smaller / np.maximum(larger, 1)
        exact = (shared == n) & (shared == n_run) & (length >= config.exact_floor)
        similar = (score >= config.threshold) & (length >= config.similar_floor)
        for i in np.flatnonzero(fits & (smaller > 0) & (even >= config.balance_floor - 1e-12) & (exact | similar)).tolist():
            start = 1 if role == "prefix" else total - i
            yield role, i + 1, start, start + i, int(shared[i]), n, int(n_run[i]), float(score[i]), float(even[i]), "exact" if exact[i] else "similar"


_RUNS = "contained_id long, host_id long, role string, length int, start_line int, end_line int, shared long, n_contained int, n_run int, score double, balance double, tier string"


def text_containment_scores(prints: DataFrame, sets: DataFrame, hosts: DataFrame, config: ContainmentConfig) -> DataFrame:
    """containment_scores of texts: class_scores, written out for the members of both classes."""
    scores, members = class_scores(prints, sets, hosts, config)
    a, b = (members.select(F.col("rep_id").alias(f"{s}_id"), F.col("frag_id").alias(f"{s}_member")) for s in ("contained", "host"))
    all_of = scores.join(a, "contained_id").join(b, "host_id").where("contained_member <> host_member")
    return all_of.drop("contained_id", "host_id").withColumnsRenamed({"contained_member": "contained_id", "host_member": "host_id"}).select(*scores.columns)


def finding_links(scores: DataFrame, members: DataFrame) -> DataFrame:
    """left_id, right_id, weight: the two fragments of each of best_findings, as classes, and how many findings they stand for.

    ``scores``, ``members``: class_scores'.  A run that a tier accepts of two classes, in either direction, makes a finding of any two of
    their members; a class whose copies are in one another is linked with itself.
    """
    copies = members.groupBy("rep_id").agg(F.count("*").alias("copies"))
    a, b = (copies.select(F.col("rep_id").alias(f"{s}_id"), F.col("copies").alias(f"{s}_copies")) for s in ("left", "right"))
    two = scores.select(F.least("contained_id", "host_id").alias("left_id"), F.greatest("contained_id", "host_id").alias("right_id")).distinct()
    weight = F.when(F.col("left_id") == F.col("right_id"), F.expr("left_copies * (left_copies - 1) div 2")).otherwise(F.col("left_copies") * F.col("right_copies"))
    return two.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", weight.alias("weight"))


def class_scores(prints: DataFrame, sets: DataFrame, hosts: DataFrame, config: ContainmentConfig) -> tuple[DataFrame, DataFrame]:
    """(containment_scores of classes of equal texts, named by their smallest members; members: id, frag_id, rep_id, exec_lines).

    Sets and places are made for those texts alone that are candidates.

    ``prints``: frag_id, root_hash, exec_lines, kept; ``sets``: id (the hash of the root hash), frag_id, exec_lines,
    shingles, n, and ``hosts``: frag_id, exec_lines, places (array of shingle, starts, ends), both made anew whenever they
    are read.  Each two classes of equal texts are scored once, all runs in one call.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    heads = prints.groupBy("root_hash").agg(F.min("frag_id").alias("rep_id"))
    members = cut(prints.select("frag_id", "root_hash", "exec_lines").join(heads, "root_hash").select(F.xxhash64("root_hash").alias("id"), "frag_id", "rep_id", "exec_lines"))
    candidates = cut_and_drop(class_candidates(sets, members, config))
    ids = lambda column: cut(candidates.select(F.col(column).alias("id")).distinct())
    own = those_of(sets.drop("id").withColumn("id", F.col("frag_id")), ids("contained_id")).select(F.col("id").alias("contained_id"), F.col("shingles").alias("own"))
    column = lambda name: F.col(f"places.{name}").alias(name)
    places = those_of(hosts.withColumn("id", F.col("frag_id")), ids("host_id")).select(F.col("id").alias("host_id"), F.col("exec_lines").alias("total"), column("shingle"), column("starts"), column("ends"))
    met = candidates.join(own, "contained_id").join(places, "host_id").select("contained_id", "host_id", "total", "own", "shingle", "starts", "ends")
    schema = to_arrow_schema(_parse_datatype_string(_RUNS))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                contained, host, total = (batch.column(k)[i].as_py() for k in range(3))
                arrays = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(3, 7))
                rows += [(contained, host, *run) for run in _accepted_runs(*arrays, total, config)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    return cut_and_drop(met.mapInArrow(runs, _RUNS)), members


def containment_scores(prints: DataFrame, shingle_lines: DataFrame, runs: DataFrame, config: ContainmentConfig) -> DataFrame:
    """contained_id, host_id, role, length, start_line, end_line, shared, n_contained, n_run, score, balance of runs that a tier accepts, with tier."""
    candidates = cut(containment_candidates(prints, config))
    own = prints.select(F.col("frag_id").alias("contained_id"), F.explode("shingles").alias("shingle"))
    lines = shingle_lines.select(F.col("frag_id").alias("host_id"), "shingle", "first_end", "last_start")
    size = prints.select(F.col("frag_id").alias("host_id"), "exec_lines")
    met = candidates.join(own, "contained_id").join(lines, ["host_id", "shingle"]).join(size, "host_id")
    ends = F.array(F.struct(F.lit("prefix").alias("role"), F.col("first_end").alias("length")), F.struct(F.lit("suffix").alias("role"), (F.col("exec_lines") - F.col("last_start") + 1).alias("length")))
    new = met.select("contained_id", "host_id", F.explode(ends).alias("e")).groupBy("contained_id", "host_id", "e.role", "e.length").agg(F.count("*").alias("new"))
    n = prints.select(F.col("frag_id").alias("contained_id"), F.col("n").alias("n_contained"))
    # of a host's runs those alone whose size is in balance with the contained set
    fine = balance(F.col("n_contained"), F.col("n")) >= config.balance_floor - 1e-12
    grid = candidates.join(n, "contained_id").join(runs, "host_id").where(fine)
    # shared elements that end on lines between run lengths count for the next length: all lengths come before the running sum
    both = grid.select("contained_id", "host_id", "role", "length", F.lit(0).cast("long").alias("new")).unionByName(new.select("contained_id", "host_id", "role", "length", "new"))
    per_length = both.groupBy("contained_id", "host_id", "role", "length").agg(F.sum("new").alias("new"))
    along = Window.partitionBy("contained_id", "host_id", "role").orderBy("length")
    shared = per_length.withColumn("shared", F.sum("new").over(along))
    sized = shared.join(runs.withColumnRenamed("n", "n_run"), ["host_id", "role", "length"]).join(n, "contained_id")
    scored = sized.withColumns({"score": containment(F.col("shared"), F.col("n_contained"), F.col("n_run")), "balance": balance(F.col("n_contained"), F.col("n_run"))})
    exact = (F.col("shared") == F.col("n_contained")) & (F.col("shared") == F.col("n_run"))
    return scored.where(F.col("balance") >= config.balance_floor - 1e-12).withColumn("tier", run_tier(F.col("score"), exact, F.col("length"), config)).where("tier is not null").select("contained_id", "host_id", "role", "length", "start_line", "end_line", "shared", "n_contained", "n_run", "score", "balance", "tier")


def best_findings(scores: DataFrame) -> DataFrame:
    """contained_id, container_id, role, start_line, end_line, statement_count, score, tier: one finding for each two fragments.

    Of a host and role the run with the highest score, then balance, then the shortest; of two fragments the
    higher score, then the smaller container, prefix before suffix, the smaller contained.
    """
    of_role = scores.groupBy("contained_id", "host_id", "role").agg(F.max_by(F.struct("start_line", "end_line", "length", "score", "tier"), F.struct("score", "balance", -F.col("length"))).alias("r"))
    flat = of_role.select("contained_id", F.col("host_id").alias("container_id"), "role", "r.*")
    two = Window.partitionBy(F.least("contained_id", "container_id"), F.greatest("contained_id", "container_id")).orderBy(F.desc("score"), "container_id", "role", "contained_id")
    return flat.withColumn("place", F.row_number().over(two)).where("place = 1").select("contained_id", "container_id", "role", "start_line", "end_line", F.col("length").alias("statement_count"), "score", "tier")


def find_containments(fragments: DataFrame, prints: DataFrame, shingle_lines: DataFrame, config: ContainmentConfig) -> DataFrame:
    """The containments among fragments of text, ranked by nothing yet."""
    return best_findings(containment_scores(prints, shingle_lines, line_runs(shingle_lines, fragments, config), config))


def drop_nested(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings (contained_id, container_id) whose fragments, with spans (frag_id, file_path, byte_start, byte_end), do not enclose one another."""
    a, b = (spans.select(F.col("frag_id").alias(f"{s}_id"), F.col("file_path").alias(f"{s}_file"), F.col("byte_start").alias(f"{s}_start"), F.col("byte_end").alias(f"{s}_end")) for s in ("contained", "container"))
    joined = findings.join(a, "contained_id").join(b, "container_id")
    inside = (F.col("contained_start") >= F.col("container_start")) & (F.col("contained_end") <= F.col("container_end"))
    around = (F.col("container_start") >= F.col("contained_start")) & (F.col("container_end") <= F.col("contained_end"))
    return joined.where(~((F.col("contained_file") == F.col("container_file")) & (inside | around))).select(*findings.columns)
