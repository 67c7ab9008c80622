"""How well detections find known duplicates: interval matching, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import line_iou
from .components import cut_and_drop
from .pairs import AT_ONCE


def match_pairs(manifest: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """entry_id, tier, pair_id: detections whose files are an entry's, in either order, and whose lines overlap enough on both sides.

    ``manifest``: entry_id, tier, source_file, source_start, source_end, target_file, target_start, target_end;
    ``found``: pair_id, left_file, left_start, left_end, right_file, right_start, right_end.
    Files are joined by equality, so lines are compared only within one pair of files.  Both sides name a pair of files in
    one order, so either way round is one row of the join, and a result, which grows with the square of a pair's rows, is
    sorted out only where ids are given more than once.
    """
    entries, e = _in_order(_marked(manifest, "entry_id", "tier"), "entry", ("source", "target"), "entry_id", "tier")
    pairs, f = _in_order(_marked(found, "pair_id"), "pair", ("left", "right"), "pair_id")
    near = lambda a, b: line_iou(F.col(f"{e}_{a}_start"), F.col(f"{e}_{a}_end"), F.col(f"{f}_{b}_start"), F.col(f"{f}_{b}_end")) >= least
    either = (near("x", "x") & near("y", "y")) | ((F.col("x") == F.col("y")) & near("x", "y") & near("y", "x"))
    met = entries.join(pairs, ["x", "y"]).where(either)
    again = F.col(f"{e}_again") | F.col(f"{f}_again")
    columns = ("entry_id", "tier", "pair_id")
    return met.where(~again).select(*columns).unionByName(met.where(again).select(*columns).distinct())


def _marked(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``again``: whether others have the key, too (or, by chance, one with its hash)."""
    hashed = F.xxhash64(*key)
    repeated = cut_and_drop(rows.select(hashed.alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    n = repeated.count()
    if n > AT_ONCE:
        return rows.withColumn("again", F.lit(True))
    if not n:
        return rows.withColumn("again", F.lit(False))
    return rows.withColumn("h", hashed).join(F.broadcast(repeated.withColumn("known", F.lit(True))), "h", "left").withColumn("again", F.col("known").isNotNull()).drop("h", "known")


def _in_order(rows: DataFrame, name: str, sides: tuple[str, str], *more: str) -> tuple[DataFrame, str]:
    """``rows`` with their two files, neither null, as x <= y and the lines of each, named ``name``_; and that name."""
    a, b = sides
    turned = F.col(f"{a}_file") > F.col(f"{b}_file")
    lines = [F.when(turned, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{name}_{s}_{c}") for s, p, q in (("x", a, b), ("y", b, a)) for c in ("start", "end")]
    known = rows.where(F.col(f"{a}_file").isNotNull() & F.col(f"{b}_file").isNotNull())
    return known.select(F.least(f"{a}_file", f"{b}_file").alias("x"), F.greatest(f"{a}_file", f"{b}_file").alias("y"), *lines, F.col("again").alias(f"{name}_again"), *more), name


def precision_recall(manifest: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """tier, tp, fp, fn, precision_, recall, f1 of each tier and of 'total'; false positives count in the total alone."""
    matches = match_pairs(manifest, found, least)
    hit = manifest.select("entry_id", "tier").join(matches.select("entry_id").distinct().withColumn("hit", F.lit(1)), "entry_id", "left")
    tiers = hit.groupBy("tier").agg(F.count("hit").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.count("*") - F.count("hit")).alias("fn"))
    false = found.join(matches.select("pair_id").distinct(), "pair_id", "left_anti").agg(F.count("*").alias("fp"))
    total = tiers.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn")).join(false).select(F.lit("total").alias("tier"), "tp", "fp", "fn")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tiers.unionByName(total).select("tier", "tp", "fp", "fn", share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
