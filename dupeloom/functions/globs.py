"""Glob patterns as regular expressions, so that paths are filtered inside the plan."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """An anchored expression of a glob: ``**/`` is any number of folders, none included; ``*`` and ``?`` stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def any_glob(path: Column, globs: Iterable[str]) -> Column:
    """Whether a path, relative to the root, matches any of the globs."""
    patterns = [glob_to_regex(g) for g in globs]
    return path.rlike("|".join(patterns)) if patterns else F.lit(False)


def in_scope(path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """First any of ``include``, then none of ``exclude``."""
    return any_glob(path, include) & ~any_glob(path, exclude)
