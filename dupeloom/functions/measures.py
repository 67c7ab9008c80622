"""Similarity, size and acceptance rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ContainmentConfig, ScanConfig


def bound(value: Column | str, f) -> Column:
    """f of a value that is computed once, however often f's lambdas use it and wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """Of sizes: shared / union; 0 where both sets are empty."""
    union = left + right - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def containment(shared: Column, left: Column, right: Column) -> Column:
    """Shared elements by the smaller set's size; null if either is empty."""
    return F.when((left > 0) & (right > 0), shared / F.least(left, right))


def balance(left: Column, right: Column) -> Column:
    """The smaller size by the larger; null if either is zero."""
    return F.when((left > 0) & (right > 0), F.least(left, right) / F.greatest(left, right))


def pair_tier(similarity: Column, exact: Column, lines: Column, stmts: Column, config: ScanConfig) -> Column:
    """'exact', 'similar' or null, from the shorter side's lines and statements."""
    return F.when(exact & (lines >= config.exact_floor) & (stmts >= config.exact_min_stmts), F.lit("exact")).when((similarity >= F.lit(config.threshold)) & (lines >= config.similar_floor), F.lit("similar"))


def run_tier(score: Column, exact: Column, lines: Column, config: ContainmentConfig) -> Column:
    """'exact', 'similar' or null, from the run's lines."""
    return F.when(exact & (lines >= config.exact_floor), F.lit("exact")).when((score >= F.lit(config.threshold)) & (lines >= config.similar_floor), F.lit("similar"))


def line_iou(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Intersection by union of two inclusive ranges of lines."""
    shared = F.greatest(F.least(end, other_end) - F.greatest(start, other_start) + 1, F.lit(0))
    return shared / ((end - start + 1) + (other_end - other_start + 1) - shared)


def distinct_lines(lists: Column) -> Column:
    """Lines in any of some lists of line numbers, each once."""
    return F.size(F.array_distinct(F.flatten(lists)))


def has_file_directive(source: Column, directive: str) -> Column:
    """'# <directive>: ignore-file' in any of the first five lines."""
    return F.exists(F.slice(F.split(source, "\n"), 1, 5), lambda line: F.contains(line, F.lit(f"# {directive}: ignore-file")))


def has_inline_directive(text: Column, directive: str) -> Column:
    """A line that begins, after white space, with '# <directive>: ignore' and not with 'ignore-file'."""
    start = f"# {directive}: ignore"
    trimmed = lambda line: F.regexp_replace(line, r"^\s+", "")
    return F.exists(F.split(text, "\n"), lambda line: F.startswith(trimmed(line), F.lit(start)) & ~F.startswith(trimmed(line), F.lit(start + "-file")))


def source_head(source: Column, lines: int) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(F.split(source, "\n"), 1, lines), "\n")
