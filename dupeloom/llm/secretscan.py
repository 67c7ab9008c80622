"""Secret scans by multipart credential linking, in built-in functions alone.

Sure patterns are reported wherever they stand.  Weak candidates (a short access identifier, an unlabelled
string of mixed letters and digits, an endpoint) mean little alone: scopes are windows of ``scope`` characters
that begin at every half window, each part is dealt to the scopes that its interval touches, and the parts are
joined on the scope.  A weak part is reported only where an identifier and a secret that lie apart share a scope
with it: no part completes itself.  A document's parts are joined inside its row, in the order of their places:
nothing is shuffled, no key gathers rows, and no part is held against all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .spans import NO_SPANS, let, matched, outermost, placed, running

#: The sure kinds, in the order that breaks ties of start; short matches are dropped afterwards or never match. Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
LEAST_ASSIGNED = 6

#: Weak parts.
WEAK_ID = r"""(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{8,}+|(?i:(?:client|access|account|user|login)[_-]?(?:id|key|name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}+))"""
WEAK_KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"(?<![A-Za-z0-9_])(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x20\x09-\x0D\"'<>]++"

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")


def _linked(first: str, second: str, half: int) -> str:
    """SQL: scopes that a part of ``first`` shares with one of ``second`` that begins where it ends or later.

    Of the parts before one, that with the last end shares the most scopes with it; so no others are looked at.
    """
    events = f"array_sort(concat(transform({first}, p -> named_struct('at', p.end, 'asks', 0, 'mark', p.end)), transform({second}, p -> named_struct('at', p.start, 'asks', 1, 'mark', -1))))"
    near = f"filter({running(events, '-1', 'e.mark', 'greatest({x}, {y})')}, r -> r.e.asks = 1 and r.before > 0 and (r.before - 1) div {half} >= r.e.at div {half} - 1)"
    return f"flatten(transform({near}, r -> sequence(r.e.at div {half} - 1, (r.before - 1) div {half})))"


def _touching(weak: str, linked: str, half: int) -> str:
    """SQL: the weak parts that touch a linked scope."""
    marks = f"transform({linked}, l -> named_struct('at', l, 'asks', 0, 'mark', l, 's', cast(null as struct<start:int,rank:int,end:int,kind:string,n:int>)))"
    asked = f"transform({weak}, s -> named_struct('at', (s.end - 1) div {half}, 'asks', 1, 'mark', -2L, 's', s))"
    return f"transform(filter({running(f'array_sort(concat({marks}, {asked}))', '-2L', 'e.mark', 'greatest({x}, {y})')}, r -> r.e.asks = 1 and r.before >= r.e.s.start div {half} - 1), r -> r.e.s)"


def find_secrets(docs: DataFrame, scope: int = 400, into: str = "secret_spans") -> DataFrame:
    """``docs`` with a column ``into``: array of (start, rank, end, kind, n), by start and kind, sure ones and linked weak ones.

    ``docs`` has a column text; a null text counts as empty and has no spans.  A weak part that lies in another part
    is left out.  Other columns pass through unchanged, whatever their names, repeated rows each; an empty table
    gives none.  ``into`` must be a name that ``docs`` does not have.
    """
    half = max(1, scope // 2)
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    names = {k: free_name(docs, f"{k}_{into}") for k in (*KINDS, "gate")}
    # weak parts are looked for only where an identifier can be
    has_id = text.rlike(WEAK_ID) | text.rlike(ACCESS)
    sure = docs.select(*kept, matched(text, ASSIGN, 2).alias(names["assign"]), matched(text, ACCESS).alias(names["access"]), matched(text, HEX).alias(names["hex"]), has_id.alias(names["gate"]))
    weak = lambda pattern: F.when(F.col(f"`{names['gate']}`"), matched(text, pattern))
    parts = sure.select("*", weak(WEAK_ID).alias(names["id"]), weak(WEAK_KEY).alias(names["key"]), weak(ENDPOINT).alias(names["endpoint"]))
    column = lambda k: f"`{names[k]}`"
    any_of = lambda *kinds: "(" + " or ".join(f"{column(k)} is not null" for k in kinds) + ")"
    spans = {k: placed(column(k), repr(k), str(r)) for r, k in enumerate(KINDS)}
    spans["assign"] = f"filter({spans['assign']}, s -> s.n >= {LEAST_ASSIGNED})"
    found = f"named_struct({', '.join(f'{k!r}, {v}' for k, v in spans.items())})"
    linked = let("ids", "concat(p.id, p.access)", let("keys", "concat(p.assign, p.hex, p.key)", f"array_distinct(concat({_linked('ids', 'keys', half)}, {_linked('keys', 'ids', half)}))"))
    touching = let("linked", linked, f"if(size(linked) = 0, {NO_SPANS}, {_touching('concat(p.id, p.key, p.endpoint)', 'linked', half)})")
    both = f"if(size(p.id) + size(p.access) = 0 or size(p.assign) + size(p.hex) + size(p.key) = 0, concat(p.assign, p.access, p.hex), {outermost(f'concat(p.assign, p.access, p.hex, {touching})', 's.rank', 's.rank < 3')})"
    whole = f"if({any_of('assign', 'access', 'hex', 'id')}, {let('p', found, f'array_sort({both})')}, {NO_SPANS})"
    return parts.select(*kept, F.expr(whole).alias(into))


def redact_secrets(docs: DataFrame, mark: str = "[secret]", scope: int = 400) -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``mark`` in text, and n_chars (if there) to match.

    Overlapping spans get one mark.  A null text stays null; all columns keep their names, values and order.
    """
    quoted = mark.replace("\\", "\\\\").replace("'", "\\'")
    into = free_name(docs, "secret_spans")
    # what is kept: from the furthest end before a span to its start, where there is something between
    ordered = running(f"`{into}`", "0", "e.end", "greatest({x}, {y})")
    pieces = f"transform(filter({ordered}, r -> r.e.end > r.before), r -> if(r.e.start < r.before, '', concat(substring(text, r.before + 1, r.e.start - r.before), '{quoted}')))"
    last = f"array_max(transform(`{into}`, s -> s.end))"
    marked = find_secrets(docs, scope, into).withColumn("text", F.expr(f"if(text is null or size(`{into}`) = 0, text, concat(array_join({pieces}, ''), substring(text, {last} + 1)))"))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.size(F.col(f"`{into}`")) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return marked.select(*[f"`{c}`" for c in docs.columns])


def secret_report(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of each row of ``docs`` (doc_id, text); nulls as find_secrets has them."""
    found = find_secrets(docs.select("doc_id", "text"), scope)
    count = lambda kind: F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    joined = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("filter(secret_spans, s -> s.rank < 3)"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"), F.expr("cast(size(filter(secret_spans, s -> s.rank >= 3)) as bigint)").alias("n_linked"))
