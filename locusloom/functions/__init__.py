"""Column functions over pairs of intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.operators.distance import distance
from locusloom.schema import Interval

__all__ = ["distance", "fraction_overlap", "overlap_bp", "same_strand"]


def overlap_bp(a: Interval, b: Interval) -> Column:
    """Positions that both hold; 0 if none or if a side is missing."""
    shared = F.least(a.end, b.end) - F.greatest(a.start, b.start)
    return F.when(a.chrom == b.chrom, F.greatest(shared, F.lit(0))).otherwise(F.lit(0)).cast("long")


def fraction_overlap(a: Interval, b: Interval) -> Column:
    """overlap_bp as a share of a's length."""
    return overlap_bp(a, b) / (a.end - a.start)


def same_strand(a: Interval, b: Interval) -> Column:
    return a.strand == b.strand
