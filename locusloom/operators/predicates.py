"""INTERSECTS, CONTAINS and WITHIN as boolean columns. Strands play no part; nulls give null."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.ranges import Range, parse_range
from locusloom.schema import Interval

Operand = Interval | Range | str


def _other(b: Operand) -> tuple[Interval, Range | None]:
    if isinstance(b, Interval):
        return b, None
    r = parse_range(b) if isinstance(b, str) else b
    return Interval.literal(r), r


def intersects(a: Interval, b: Operand) -> Column:
    o, _ = _other(b)
    return (a.chrom == o.chrom) & (a.start < o.end) & (a.end > o.start)


def contains(a: Interval, b: Operand) -> Column:
    o, r = _other(b)
    if r is not None and r.is_point:
        return (a.chrom == o.chrom) & (a.start <= F.lit(r.start)) & (a.end > F.lit(r.start))
    return (a.chrom == o.chrom) & (a.start <= o.start) & (a.end >= o.end)


def within(a: Interval, b: Operand) -> Column:
    o, _ = _other(b)
    return (a.chrom == o.chrom) & (a.start >= o.start) & (a.end <= o.end)


def any_of(predicate, a: Interval, ranges: list[str | Range]) -> Column:
    return reduce(or_, [predicate(a, r) for r in ranges])


def all_of(predicate, a: Interval, ranges: list[str | Range]) -> Column:
    return reduce(and_, [predicate(a, r) for r in ranges])
