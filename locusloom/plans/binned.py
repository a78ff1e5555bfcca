"""Overlap joins as equi-joins on bins of positions.

Each interval is dealt to the bins that it touches; a pair is kept only in the bin where its overlap begins, so rows keep their
multiplicity without a distinct. CONTAINS and WITHIN hold only for intervals that overlap or touch; for them an interval is dealt
to the bin of its end, too. Where lengths are uneven, bins come in levels, each eight times as wide: an interval's own
level is the first whose bins are as long as it, so that it touches at most two of them, and it is dealt to one or two
bins of each wider level to meet longer intervals there. A chromosome-long interval then costs a few rows, not one per bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.schema import Interval

GROWTH = 8


def choose_bins(*sides: DataFrame) -> list[int]:
    """Widths of the bins, from the mean and the greatest length of sides with canonical _s and _e: one job over two narrow columns."""
    lengths = [x.select(F.lit(n).alias("side"), (F.col("_e") - F.col("_s")).alias("v")) for n, x in enumerate(sides)]
    both = lengths[0] if len(lengths) == 1 else lengths[0].unionByName(lengths[1])
    stats = both.groupBy("side").agg(F.avg("v").alias("a"), F.max("v").alias("m")).collect()  # a row for each side
    mean, most = max([float(s.a or 1) for s in stats], default=1.0), max([int(s.m or 1) for s in stats], default=1)
    width = 1 << max(6, int(2 * mean).bit_length())
    out = [width]
    if most > 16 * width:
        while out[-1] < most:
            out.append(out[-1] * GROWTH)
    return out


def _spread(df: DataFrame, width: Column | int, touch: bool) -> Column:
    """Bins that an interval touches; an empty or inverted one touches its start's. touch: that of its end, too."""
    w = width if isinstance(width, Column) else F.lit(width)
    upto = F.greatest(F.col("_e"), F.col("_s")) if touch else F.greatest(F.col("_e") - 1, F.col("_s"))
    return F.sequence(F.floor(_from(touch) / w).cast("long"), F.floor(upto / w).cast("long"))


def _from(touch: bool, side: str = "") -> Column:
    s, e = F.col(f"_s{side}"), F.col(f"_e{side}")
    return F.least(s, e) if touch else s


def binned_pairs(left: DataFrame, right: DataFrame, bins: list[int], predicate: Callable[[Interval, Interval], Column] | None = None) -> DataFrame:
    """All pairs whose intervals satisfy the predicate, or overlap. Sides: _c, _s, _e (canonical) and a struct column with the row, left `_l`, right `_r`."""
    left, right = (x.where(F.col("_c").isNotNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull()) for x in (left, right))
    touch = predicate is not None
    if len(bins) == 1:
        sides = [x.withColumn("_b", F.explode(_spread(x, bins[0], touch))).withColumn("_w", F.lit(bins[0]).cast("long")) for x in (left, right)]
        return _met(*sides, predicate, touch)
    widths = F.array(*[F.lit(b).cast("long") for b in bins])
    length = F.abs(F.col("_e") - F.col("_s"))
    own = F.coalesce(F.get(F.filter(widths, lambda w: w >= length), F.lit(0)), F.lit(bins[-1]).cast("long"))
    up = lambda x, strict: x.withColumn("_w", F.explode(F.filter(widths, lambda w: (w > own) if strict else (w >= own))))
    deal = lambda x: x.withColumn("_b", F.explode(_spread(x, F.col("_w"), touch)))
    longer_right = _met(deal(up(left, False)), deal(right.withColumn("_w", own)), predicate, touch)
    longer_left = _met(deal(left.withColumn("_w", own)), deal(up(right, True)), predicate, touch)
    return longer_right.unionByName(longer_left)


def _met(left: DataFrame, right: DataFrame, predicate, touch: bool) -> DataFrame:
    a = left.select(F.col("_c").alias("_c1"), F.col("_s").alias("_s1"), F.col("_e").alias("_e1"), F.col("_b").alias("_b1"), F.col("_w").alias("_w1"), "_l")
    b = right.select(F.col("_c").alias("_c2"), F.col("_s").alias("_s2"), F.col("_e").alias("_e2"), F.col("_b").alias("_b2"), F.col("_w").alias("_w2"), "_r")
    begins = F.floor(F.greatest(_from(touch, "1"), _from(touch, "2")) / F.col("_w1")).cast("long")
    on = (F.col("_c1") == F.col("_c2")) & (F.col("_b1") == F.col("_b2")) & (F.col("_w1") == F.col("_w2"))
    holds = predicate(Interval(F.col("_c1"), F.col("_s1"), F.col("_e1")), Interval(F.col("_c2"), F.col("_s2"), F.col("_e2"))) if touch else (F.col("_s1") < F.col("_e2")) & (F.col("_e1") > F.col("_s2"))
    return a.join(b, on & holds & (F.col("_b1") == begins)).select("_l", "_r")
