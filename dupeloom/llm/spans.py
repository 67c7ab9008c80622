"""Places of pattern matches, and running values over arrays, as built-in expressions.

Spark's functions return what a pattern matches but not where.  split() returns what stands between the
matches of the same pass, so the places follow from the lengths of both, in code points.  A fold that carries
an array copies it in each step; running values are taken by blocks instead: n entries cost n to the power 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A match: code points from ``start`` up to, not including, ``end``; ``n``: code points of the asked group.
SPAN = "struct<start:int,rank:int,end:int,kind:string,n:int>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` in which ``name`` stands for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(entries: str, zero: str, value: str, combine: str) -> str:
    """SQL: array of (e, before): each entry and what the values of all before it combine to.

    ``value`` is SQL of the entry ``e``; ``combine`` is SQL of ``x`` and ``y`` and does not depend on their grouping.
    """
    joined = lambda x, y: combine.replace("{x}", x).replace("{y}", y)
    fold = lambda part, start, of: f"aggregate({part}, {start}, (x, e) -> {joined('x', of)})"
    block = "slice(xs, cast(k * b + 1 as int), b)"
    tops = f"transform(sequence(0, cast(greatest(size(xs) - 1, 0) div b as int)), k -> {fold(block, zero, value)})"
    above = fold("slice(tops, 1, k)", zero, "e")
    inside = f"transform({block}, (own, j) -> named_struct('e', own, 'before', {fold('slice(xs, cast(k * b + 1 as int), j)', 'above', value)}))"
    blocks = f"flatten(transform(tops, (top, k) -> {let('above', above, inside)}))"
    return let("xs", entries, let("b", "greatest(1, cast(ceil(sqrt(size(xs))) as int))", let("tops", tops, blocks)))


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """What ``placed`` needs, null for texts without a match (most): what matches, what is between, and a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.when(text.rlike(pattern), F.struct(found.alias("found"), F.split(text, pattern).alias("between"), value.alias("value")))


def placed(column: str, kind: str, rank: str) -> str:
    """SQL: array of SPAN of a ``matched`` column; kind and rank are SQL."""
    sizes = "transform(m.found, (f, i) -> named_struct('gap', length(m.between[i]), 'own', length(f), 'n', length(m.value[i])))"
    spans = f"transform({running(sizes, '0', 'e.gap + e.own', '{x} + {y}')}, r -> named_struct('start', r.before + r.e.gap, 'rank', {rank}, 'end', r.before + r.e.gap + r.e.own, 'kind', {kind}, 'n', r.e.n))"
    return f"if({column} is null, {NO_SPANS}, {let('m', column, spans)})"


def outermost(spans: str, order: str, always: str) -> str:
    """SQL: the spans that lie in none that comes earlier by (start, larger end, ``order``), and those for which ``always``, in SQL of ``s``, is true."""
    sorted_ = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'less', -s.end, 'order', {order}, 'end', s.end, 's', s)))"
    return f"transform(filter({running(sorted_, '-1', 'e.end', 'greatest({x}, {y})')}, r -> r.before < r.e.end or {let('s', 'r.e.s', always)}), r -> r.e.s)"
