"""Source files: discovery by globs and ignore files, reading, focus lists."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.globs import any_glob, glob_to_regex, in_scope


def ignore_rules(text: str, base: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(expression of a path from the root, whether it takes back, whether folders alone) of each line of an ignore file in ``base``."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folders, line = line.endswith("/"), line.rstrip("/")
        glob = line.lstrip("/") if "/" in line else f"**/{line}"
        rules.append((re.compile(glob_to_regex(f"{base}{glob}")), back, folders))
    return rules


def discover_files(root: str | Path, scan: ScanConfig | None = None) -> list[str]:
    """Sorted paths below a folder on this machine that are in scope; hidden files too, those that .gitignore names not.

    For a folder of a shared store use ``read_files`` with its path: listing, globs and reading are then Spark's.
    """
    scan = scan or ScanConfig()
    root = Path(root)
    if root.is_file():
        return [str(root)]
    include, exclude = ([re.compile(glob_to_regex(g)) for g in globs] for globs in (scan.include, scan.exclude))
    found: list[str] = []

    def walk(folder: Path, base: str, rules: list) -> None:
        if (own := folder / ".gitignore").is_file():
            rules = rules + ignore_rules(own.read_text(errors="replace"), base)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = base + entry.name
            is_folder = entry.is_dir(follow_symlinks=False)
            ignored = False
            for pattern, back, folders in rules:
                if (is_folder or not folders) and pattern.match(path):
                    ignored = not back
            if ignored or entry.name == ".git":
                continue
            if is_folder:
                walk(Path(entry.path), path + "/", rules)
            elif any(p.match(path) for p in include) and not any(p.match(path) for p in exclude):
                found.append(entry.path)

    exclude_file = Path.home() / ".config/git/ignore"
    walk(root, "", ignore_rules(exclude_file.read_text(errors="replace"), "") if exclude_file.is_file() else [])
    return sorted(found)


def read_files(spark: SparkSession, path: str | Path | Iterable[str], scan: ScanConfig | None = None, suppress: Iterable[str] = (), base: str | None = None) -> DataFrame:
    """file_path, source, status of files: 'ok', 'suppressed' (by glob; not read), 'unreadable'.

    A list of paths is read as it is, by tasks that must see the driver's files (a scan of this machine); for
    ``suppress`` they count from ``base``, their common folder if there is none.  A folder, of any store that Spark reads, is listed by Spark, and
    its paths, relative to it, are filtered in the plan.
    """
    scan = scan or ScanConfig()
    if isinstance(path, (str, Path)):
        root = str(path).rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^.*?" + re.escape(root.split(":", 1)[-1].lstrip("/")) + "/", "")
        files = files.select(relative.alias("file_path"), "content").where(in_scope(F.col("file_path"), scan.include, scan.exclude))
        return files.select("file_path", F.when(~any_glob(F.col("file_path"), suppress), F.col("content")).alias("source"), F.when(any_glob(F.col("file_path"), suppress), "suppressed").otherwise("ok").alias("status"))
    paths = list(path)
    base = base or (os.path.commonpath([os.path.dirname(p) for p in paths]) if paths else "")
    kept_out = [re.compile(glob_to_regex(g)) for g in suppress]
    rows = [(p, any(g.match(os.path.relpath(p, base)) for g in kept_out)) for p in paths]
    listed = spark.createDataFrame(rows, "file_path string, suppressed boolean").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))

    def contents(batches):
        import pyarrow as pa

        for batch in batches:
            sources, status = [], []
            for name, suppressed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if suppressed:
                    sources.append(None)
                    status.append("suppressed")
                    continue
                try:
                    with open(name, "rb") as f:
                        sources.append(f.read())
                    status.append("ok")
                except OSError:
                    sources.append(None)
                    status.append("unreadable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sources, pa.binary()), pa.array(status)], ["file_path", "source", "status"])

    return listed.mapInArrow(contents, "file_path string, source binary, status string")


def read_focus_list(source: str) -> list[str]:
    """Paths of a file, or of standard input for '-': a line each; a byte-order mark, line ends of all kinds and blank lines are fine."""
    raw = sys.stdin.buffer.read() if source == "-" else Path(source).read_bytes()
    return [line.strip() for line in raw.decode("utf-8-sig", "replace").replace("\r", "\n").split("\n") if line.strip()]
