"""How a relation stores intervals, and its canonical columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.ranges import Range, parse_range

# The names of the encodings, and the default column names below.
#: What is added to the stored start and end to get 0-based half-open ones.
_SHIFT = {("0based", "half_open"): (0, 0), ("0based", "closed"): (0, 1), ("1based", "half_open"): (-1, -1), ("1based", "closed"): (-1, 0)}


@dataclass(frozen=True)
class IntervalSchema:
    """Names and encoding of the columns that hold intervals. strand=None: the relation has none."""

    interval: str = "interval"
    chrom: str = "chrom"
    start: str = "start"
    end: str = "end"
    strand: str | None = "strand"
    coordinate_system: str = "0based"
    interval_type: str = "half_open"

    def __post_init__(self) -> None:
        if (self.coordinate_system, self.interval_type) not in _SHIFT:
            known = ", ".join(f"{system} {kind}" for system, kind in _SHIFT)
            raise ValueError(f"unknown encoding {self.coordinate_system} {self.interval_type}; known: {known}")

    @property
    def shift(self) -> tuple[int, int]:
        return _SHIFT[self.coordinate_system, self.interval_type]

    def stored(self, start: Column, end: Column) -> tuple[Column, Column]:
        """Canonical positions in this encoding."""
        a, b = self.shift
        return _plus(start, -a), _plus(end, -b)


CANONICAL = IntervalSchema()


def _plus(column: Column, n: int) -> Column:
    return column + F.lit(n) if n else column


def _named(alias: str | None, name: str) -> Column:
    return F.col(f"{alias}.`{name}`" if alias else f"`{name}`")


@dataclass(frozen=True)
class Interval:
    """Canonical columns of one operand."""

    chrom: Column
    start: Column
    end: Column
    strand: Column | None = None

    @classmethod
    def of(cls, schema: IntervalSchema = CANONICAL, alias: str | None = None) -> Interval:
        a, b = schema.shift
        strand = _named(alias, schema.strand) if schema.strand else None
        return cls(_named(alias, schema.chrom), _plus(_named(alias, schema.start), a), _plus(_named(alias, schema.end), b), strand)

    @classmethod
    def literal(cls, range_: str | Range) -> Interval:
        r = parse_range(range_) if isinstance(range_, str) else range_
        return cls(F.lit(r.chrom), F.lit(r.start).cast("long"), F.lit(r.end).cast("long"), F.lit(r.strand) if r.strand else None)
