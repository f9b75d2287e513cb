"""Places of regular-expression matches, with built-in functions only.

``split`` and ``regexp_extract_all`` walk the same matches, so the lengths of what lies between them and of the
matches themselves give the offsets, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,stop:int,match:string>>"
#: Lengths are summed in chunks, so that a text with very many matches costs little more than linear time.
CHUNK = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


Op = Callable[[Column, Column], Column]


def _grow(values: Column, first: Column, op: Op) -> Column:
    """``first`` combined with the values before each one; one more than there are values."""
    step = lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x)))
    return F.aggregate(values, F.array(first.cast("int")), step)


def running_before(values: Column, op: Op) -> Column:
    """For each value of an int array what those before it make by ``op``, 0 for none."""

    def of_chunks(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op))
        return let(sums, lambda s: F.slice(_grow(s, F.lit(0), op), F.lit(1), F.size(s)))

    def chunked(all_values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_values, i * CHUNK + 1, F.lit(CHUNK)))
        return let(chunks, lambda c: F.flatten(F.zip_with(c, of_chunks(c), lambda chunk, base: F.when(chunk.isNotNull(), F.slice(_grow(chunk, base, op), F.lit(1), F.size(chunk))).otherwise(F.array().cast("array<int>")))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(chunked(v)))


def sums_before(values: Column) -> Column:
    """For each value of an int array the sum of those before it."""
    return running_before(values, lambda a, x: a + x)


def merged(spans: Column) -> Column:
    """Spans (start, .., stop, kind) in order of their starts, those that overlap as one of the first one's kind: array of (start, stop, kind)."""

    def heads(s: Column) -> Column:
        reach = running_before(F.transform(s, lambda x: x["stop"]), lambda a, x: F.greatest(a, x))
        first = F.filter(F.zip_with(s, reach, lambda x, m: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), m.alias("reach"))), lambda x: x["start"] >= x["reach"])
        last = F.array(F.array_max(F.transform(s, lambda x: x["stop"])))
        ends = lambda h: F.concat(F.transform(F.slice(h, F.lit(2), F.size(h)), lambda x: x["reach"]), last)
        return let(first, lambda h: F.zip_with(h, ends(h), lambda x, e: F.struct(x["start"].alias("start"), e.alias("stop"), x["kind"].alias("kind"))))

    return let(spans, lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<start:int,stop:int,kind:string>>")).otherwise(heads(s)))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with ``mark(span)`` in place of each of its spans; they are in order and don't overlap."""

    def cut(m: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(m, lambda s: s["stop"]))
        starts = F.concat(F.transform(m, lambda s: s["start"]), F.array(F.length(text)))
        kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
        return F.array_join(F.zip_with(kept, F.concat(F.transform(m, mark), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return let(spans, lambda m: F.when(F.size(m) == 0, text).otherwise(cut(m)))


def spans_of(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern, leftmost and without overlap: array of (start, stop, match)."""

    def placed(found: Column) -> Column:
        before = F.transform(F.split(text, pattern, -1), F.length)
        width = F.transform(found, F.length)
        steps = F.zip_with(F.slice(before, F.lit(1), F.size(found)), width, lambda a, b: a + b)
        return F.zip_with(found, F.zip_with(sums_before(steps), before, lambda s, b: s + b), lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), m.alias("match")))

    # The pieces are one more than the matches; zip_with leaves a null at the end, which the filter drops.
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.filter(placed(found), lambda s: s["match"].isNotNull())),
    )


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank, stop, kind): they sort by place, then by kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def digest(spans: Column) -> Column:
    """kind:start:end of labelled spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
