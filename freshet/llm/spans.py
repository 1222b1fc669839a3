"""Spans of regular-expression matches with code-point offsets, from built-in functions alone.

``regexp_extract_all`` gives the matches and ``split`` the pieces between them;
both walk the text from the left without overlap, so running lengths are offsets.
Running values are read from sums of parts, never from a list that grows by
copies, so the work is in proportion to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:long,end:long,hit:string,before:string>"
_FAN = 64
_LEVELS = 4  # parts of up to 64^4 elements are read in at most 64 steps a level


def bound(value: Column, body) -> Column:
    """``body`` of a name for ``value``: worked out once, where a lambda would do so for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_levels(values: Column, fold, body) -> Column:
    """``body`` of ``values`` folded in parts of 64, of those parts again, and so on: what ``prefix`` reads."""

    def grow(levels: list[Column]) -> Column:
        if len(levels) == _LEVELS:
            return body(levels)
        below = levels[-1]
        parts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(below) - 1, F.lit(0)) / _FAN).cast("int"))
        made = F.transform(parts, lambda k: _folded(below, k * _FAN, F.lit(_FAN), fold))
        return bound(made, lambda above: grow([*levels, above]))

    return bound(values, lambda first: grow([first]))


def _folded(values: Column, first: Column, n: Column, fold) -> Column:
    return F.aggregate(F.slice(values, first + 1, n), F.lit(0).cast("long"), fold)


def prefix(levels: list[Column], n: Column, fold) -> Column:
    """The fold (from 0) of the first ``n`` values: whole parts of each level, so the cost does not grow with ``n``."""
    out = F.lit(0).cast("long")
    for level, values in enumerate(levels):
        here = F.floor(n / _FAN**level).cast("int")
        first = F.floor(n / _FAN ** (level + 1)).cast("int") * _FAN if level < _LEVELS - 1 else F.lit(0)
        out = fold(out, _folded(values, first, here - first, fold))
    return out


def find_spans(text: Column, pattern: str, context: int = 24) -> Column:
    """``array<struct<start,end,hit,before>>`` of leftmost non-overlapping matches.

    ``before`` has up to ``context`` characters in front of the match, back to
    the previous match at most. No match, or a null text: an empty array. A span
    costs the same in a text of many as in one of few.
    """
    add = lambda a, b: a + b
    none = F.array().cast(f"array<{SPAN}>")

    def placed(x: Column) -> Column:
        lengths = F.transform(x["hits"], lambda h, i: (F.char_length(h) + F.char_length(F.get(x["pieces"], i))).cast("long"))

        def one(levels: list[Column]) -> Column:
            def span(h: Column, i: Column) -> Column:
                end = prefix(levels, i + 1, add)
                return F.struct((end - F.char_length(h)).alias("start"), end.alias("end"), h.alias("hit"), F.right(F.get(x["pieces"], i), F.lit(context)).alias("before"))

            return F.transform(x["hits"], span)

        return with_levels(lengths, add, one)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    return F.coalesce(F.when(text.rlike(pattern), bound(both, placed)), none)


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that share no character with one of ``others`` (both start, end, ...).

    Others stand by their starts; those that start before a span's end are found
    by halving, and their greatest end tells whether one reaches into it.
    """
    top = lambda a, b: F.greatest(a, b)
    ends = F.array_sort(F.transform(others, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def held(found: Column) -> Column:
        steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

        def kept(levels: list[Column]) -> Column:
            def clear(s: Column) -> Column:
                before = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get(found, at + k - 1)["start"] < s["end"], at + k).otherwise(at))
                return prefix(levels, before, top) <= s["start"]

            return F.filter(spans, clear)

        return with_levels(F.transform(found, lambda s: s["end"]), top, kept)

    return F.when(F.size(spans) == 0, spans).otherwise(bound(ends, held))


def tagged(spans: Column, kind: int) -> Column:
    """Spans as ``struct<start,kind,end>``: in that order they sort by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def listing(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` joined by commas, sorted by start, then kind."""
    label = F.array(*[F.lit(n) for n in names])
    text = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.get(label, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def sql_spans(column: str, pattern: str, kind: str, rank: int, test: str = "true") -> str:
    """The same as a DuckDB list of ``{s, k, e, kind}``; ``test`` is a condition on the match ``h``."""
    pattern = pattern.replace("'", "''")
    hits, pieces = f"regexp_extract_all({column}, '{pattern}')", f"regexp_split_to_array({column}, '{pattern}')"
    before = f"list_sum(list_transform(({pieces})[1:i], lambda p: length(p)))::BIGINT + coalesce(list_sum(list_transform(({hits})[1:i-1], lambda p: length(p))), 0)::BIGINT"
    made = f"list_transform({hits}, lambda h, i: {{'s': {before}, 'k': {rank}, 'e': {before} + length(h), 'kind': '{kind}', 'h': h}})"
    return f"list_filter({made}, lambda x: {test.replace('$h', 'x.h')})"


def sql_listing(spans: str) -> str:
    """The DuckDB text of such a list."""
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda x: x.kind || ':' || x.s || ':' || x.e), ','), '')"
