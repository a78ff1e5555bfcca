"""DISTANCE between two intervals: 0 when they overlap, 1 when they touch, one more than the gap otherwise; null across chromosomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.schema import Interval


def distance(a: Interval, b: Interval, *, stranded: bool = False, signed: bool = False) -> Column:
    """signed: negative when b lies before a. stranded: seen along a's strand, null where a strand is null, '.' or '?'."""
    after = b.start - a.end + 1
    before = a.start - b.end + 1
    out = F.when(a.chrom != b.chrom, None).when(a.chrom.isNull() | b.chrom.isNull(), None)
    if stranded and a.strand is not None and b.strand is not None:
        for strand in (a.strand, b.strand):
            out = out.when(strand.isNull() | strand.isin(".", "?"), None)
        flip = F.when(a.strand == "-", F.lit(-1)).otherwise(F.lit(1))
        after, before = after * flip, before * flip
    overlap = (a.start < b.end) & (a.end > b.start)
    out = out.when(overlap, F.lit(0)).when(a.end <= b.start, after)
    return out.otherwise(-before if signed else before).cast("long")
