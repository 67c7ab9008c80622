"""Findings by file and by fragment, and their text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.pairs import partners


def best_partners(pairs: DataFrame) -> DataFrame:
    """frag_id, partner_id, similarity, tier: the most similar partner, the last in the order of pairs among equals."""
    order = F.struct("similarity", "left_id", "right_id")
    return partners(pairs).groupBy("frag_id").agg(F.max_by(F.struct("partner_id", "similarity", "tier"), order).alias("b")).select("frag_id", "b.*")


def partner_lists(pairs: DataFrame) -> DataFrame:
    """frag_id, partners: array of (partner_id, similarity, tier), best first."""
    each = F.struct((-F.col("similarity")).alias("s"), "partner_id", "similarity", "tier")
    return partners(pairs).groupBy("frag_id").agg(F.array_sort(F.collect_list(each)).alias("all")).select("frag_id", F.transform("all", lambda x: F.struct(x["partner_id"].alias("partner_id"), x["similarity"].alias("similarity"), x["tier"].alias("tier"))).alias("partners"))


def _sides(table: DataFrame, a: str, b: str) -> DataFrame:
    return table.select(F.explode(F.array(a, b)).alias("frag_id")).distinct()


def function_entries(fragments: DataFrame, pairs: DataFrame, containments: DataFrame | None = None) -> DataFrame:
    """The fragments with findings: their columns, best partner (nulls without) and their first containment in report order."""
    out = fragments.join(best_partners(pairs), "frag_id", "left")
    if containments is None:
        return out.where("partner_id is not null").withColumn("containment", F.lit(None).cast("struct<kind:string,other_id:bigint,score:double>"))
    order = F.struct((-F.col("score")).alias("s"), "container_id", "contained_id")
    entry = lambda kind, own, other: containments.select(F.col(own).alias("frag_id"), order.alias("o"), F.struct(F.lit(kind).alias("kind"), F.col(other).alias("other_id"), "score").alias("containment"))
    both = entry("contains", "container_id", "contained_id").unionByName(entry("contained_in", "contained_id", "container_id"))
    first = both.groupBy("frag_id").agg(F.min_by("containment", "o").alias("containment"))
    return out.join(first, "frag_id", "left").where("partner_id is not null or containment is not null")


def file_overview(fragments: DataFrame, pairs: DataFrame, containments: DataFrame | None = None) -> DataFrame:
    """file_path, clone_count, containment_count: fragments with findings in each file that has any."""
    return overview_of_ends(fragments, _sides(pairs, "left_id", "right_id"), None if containments is None else _sides(containments, "contained_id", "container_id"))


def overview_of_ends(fragments: DataFrame, clones: DataFrame, contained: DataFrame | None = None) -> DataFrame:
    """file_overview, from the fragments (frag_id) in pairs and those in containments."""
    files = fragments.select("frag_id", "file_path")
    sides = clones.select("frag_id", F.lit(1).alias("clone"), F.lit(0).alias("contained"))
    if contained is not None:
        sides = sides.unionByName(contained.select("frag_id", F.lit(0).alias("clone"), F.lit(1).alias("contained")))
    return sides.join(files, "frag_id").groupBy("file_path").agg(F.sum("clone").alias("clone_count"), F.sum("contained").alias("containment_count"))


def file_order() -> tuple[Column, str]:
    """Most findings first, then by path."""
    return F.desc(F.col("clone_count") + F.col("containment_count")), "file_path"


def ordered_files(overview: DataFrame) -> DataFrame:
    return overview.orderBy(*file_order())


def format_overview(files: list[dict], entries: list[dict], names: dict[int, str], as_json: bool = False) -> str:
    """Files with findings and their functions, as text or JSON. ``entries`` may have ``partners``, all of them."""
    by_file: dict[str, list[dict]] = {}
    for e in sorted(entries, key=lambda e: (e["file_path"], e["start_line"])):
        by_file.setdefault(e["file_path"], []).append(e)
    if as_json:
        return json.dumps({"files": [{"file": f["file_path"], "clone_count": f["clone_count"], "containment_count": f["containment_count"], "functions": [{k: v for k, v in e.items() if v is not None} for e in by_file.get(f["file_path"], [])]} for f in files]}, indent=2, default=str)
    out = []
    for f in files:
        out.append(f"{f['file_path']}: {f['clone_count']} in clones, {f['containment_count']} in containments")
        for e in by_file.get(f["file_path"], []):
            notes = [f"like {names.get(e['partner_id'], e['partner_id'])} ({e['similarity']:.2f}, {e['tier']})"] if e.get("partner_id") is not None else []
            if (c := e.get("containment")) is not None:
                notes.append(f"{c['kind'].replace('_', ' ')} {names.get(c['other_id'], c['other_id'])}")
            out.append(f"  {e['name']} (lines {e['start_line'] + 1}-{e['end_line'] + 1}): " + "; ".join(notes))
    return "\n".join(out) + ("\n" if out else "No findings.\n")
