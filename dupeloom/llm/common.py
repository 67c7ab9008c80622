"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import cut

__all__ = ["alone", "cut", "documents", "free_name"]

_holder: list[Callable] = []


def alone(cached: Callable) -> Callable:
    """``cached``, an lru_cache of a Python worker's tables; when it is asked, the one that was asked before it lets go of its own.

    Spark's workers outlive stages, and would hold the tables of every operator that they ever ran.
    """

    @wraps(cached)
    def asked(*args):
        if not _holder or _holder[0] is not cached:
            for other in _holder:
                other.cache_clear()
            _holder[:] = [cached]
        return cached(*args)

    return asked


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` has not (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
