"""NEAREST: the k targets at the least absolute DISTANCE from each reference, ties by start, then end.

No reference is compared with a whole chromosome. Targets are numbered in order of start and in order of end, by running
counts in two levels; the number of targets that end before, or start before the end of, a reference tells which numbers
its k candidates on either side have, and an equi-join on number fetches them. Together with the overlapping targets, from
an overlap join, they hold the k nearest. Equal references are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.operators.distance import distance
from locusloom.operators.joins import overlap_join
from locusloom.plans.running import Segments, carried, segment_limits
from locusloom.schema import CANONICAL, Interval, IntervalSchema

_KEY = ["_c", "_t"]


def _numbered(targets: DataFrame, position: str, order: list[Column], segment: Segments) -> DataFrame:
    """Targets with `_n`, their number from 1 in the given order, which starts with `position`."""
    work = carried(targets, _KEY, position, {"sum_rows": F.count(F.lit(1))}, segment)
    w = Window.partitionBy(*_KEY, "_seg").orderBy(*order)
    return work.withColumn("_n", F.row_number().over(w) + F.coalesce("sum_rows", F.lit(0))).drop("_seg", "sum_rows")


def _before(keys: DataFrame, at: str, targets: DataFrame, position: str, inclusive: bool, segment: Segments) -> DataFrame:
    """keys with `_n`, how many targets of their chromosome have a position below `at` (or at it, if inclusive)."""
    a = keys.select(*_KEY, F.col(at).alias("_p"), "_key", F.lit(0).alias("_one"))
    b = targets.select(*_KEY, F.col(position).alias("_p"), F.lit(None).cast(keys.schema["_key"].dataType).alias("_key"), F.lit(1).alias("_one"))
    work = carried(a.union(b), _KEY, "_p", {"sum_one": F.sum("_one")}, segment)
    w = Window.partitionBy(*_KEY, "_seg").orderBy("_p")
    w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive else w.rangeBetween(Window.unboundedPreceding, -1)
    count = F.coalesce(F.sum("_one").over(w), F.lit(0)) + F.coalesce("sum_one", F.lit(0))
    return work.withColumn("_n", count).where("_key is not null").select("_key", *_KEY, "_n")


def nearest(reference: DataFrame, target: DataFrame, *, k: int = 1, max_distance: int | None = None, stranded: bool = False, signed: bool = False, reference_schema: IntervalSchema = CANONICAL, target_schema: IntervalSchema = CANONICAL, strategy: str = "auto", segment: Segments | None = None) -> DataFrame:
    """For each reference row its k nearest targets of the same chromosome: struct columns a and b, and distance.

    stranded: only targets on the reference's strand, seen along it; where that strand is '.' or '?', distances are null and
    targets come in order of start. max_distance drops null distances. References without candidates vanish.
    """
    stranded = stranded and reference_schema.strand is not None and target_schema.strand is not None
    r, t = Interval.of(reference_schema), Interval.of(target_schema)
    none = F.lit(None).cast("string")
    keys = reference.select(r.chrom.alias("_c"), r.start.cast("long").alias("_s"), r.end.cast("long").alias("_e"), (r.strand if stranded else none).alias("_t")).where("_c is not null and _s is not null and _e is not null" + (" and _t is not null" if stranded else "")).distinct()
    keys = keys.withColumn("_key", F.struct("_c", "_s", "_e", "_t")).withColumn("_t", F.coalesce("_t", F.lit("")))
    own = target.select(t.chrom.alias("_c"), t.start.cast("long").alias("_s"), t.end.cast("long").alias("_e"), (t.strand if stranded else F.lit("")).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("_row")).where("_c is not null and _s is not null and _e is not null and _t is not null")
    segment = segment_limits((own, "_s"), (keys, "_s")) if segment is None else segment
    by_start = _numbered(own, "_s", [F.col("_s"), F.col("_e")], segment)
    by_end = _numbered(own, "_e", [F.col("_e"), F.col("_s").desc()], segment)
    unknown = F.col("_t").isin(".", "?") if stranded else F.lit(False)
    known = keys.where(~unknown)
    # Targets that start at or after the reference's end, and targets that end at or before its start.
    after = _before(known, "_e", own, "_s", False, segment).withColumn("_n", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + k)))
    before = _before(known, "_s", own, "_e", True, segment).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_n") - k + 1), F.col("_n"))))
    pick = lambda wanted, numbered: wanted.join(numbered, [*_KEY, "_n"]).select("_key", "_s", "_e", "_row")
    found = pick(after, by_start).unionByName(pick(before, by_end))
    if stranded:
        first = keys.where(unknown).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))).select("_key", *_KEY, "_n")
        found = found.unionByName(pick(first, by_start))
    plain = IntervalSchema(chrom="_c", start="_s", end="_e", strand=None)
    over = overlap_join(known.select("_key", "_c", "_s", "_e", "_t"), own, left_schema=plain, right_schema=plain, on=F.col("a._t") == F.col("b._t"), strategy=strategy).select(F.col("a._key").alias("_key"), F.col("b._s").alias("_s"), F.col("b._e").alias("_e"), F.col("b._row").alias("_row"))
    apart = ~((F.col("_s") < F.col("_key._e")) & (F.col("_e") > F.col("_key._s")))
    apart = apart | F.col("_key._t").isin(".", "?") if stranded else apart
    found = found.where(apart).unionByName(over)
    key, row = Interval(F.col("_key._c"), F.col("_key._s"), F.col("_key._e"), F.col("_key._t") if stranded else None), Interval(F.col("_key._c"), F.col("_s"), F.col("_e"), F.col(f"_row.`{target_schema.strand}`") if stranded else None)
    found = found.withColumn("distance", distance(key, row, stranded=stranded, signed=signed))
    if max_distance is not None:
        found = found.where(F.abs("distance") <= max_distance)
    w = Window.partitionBy("_key").orderBy(F.abs("distance").asc_nulls_last(), "_s", "_e")
    best = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    strand_ok = F.col("a_strand").eqNullSafe(F.col("_key._t"))
    refs = reference.select(F.struct(*[F.col(f"`{c}`") for c in reference.columns]).alias("a"), r.chrom.alias("a_chrom"), r.start.cast("long").alias("a_start"), r.end.cast("long").alias("a_end"), (r.strand if stranded else none).alias("a_strand"))
    same = (F.col("a_chrom") == F.col("_key._c")) & (F.col("a_start") == F.col("_key._s")) & (F.col("a_end") == F.col("_key._e")) & strand_ok
    return refs.join(best, same).select("a", F.col("_row").alias("b"), "distance")


def nearest_to(target: DataFrame, literal: str, *, k: int = 1, max_distance: int | None = None, stranded: bool = False, signed: bool = False, target_schema: IntervalSchema = CANONICAL) -> DataFrame:
    """The k targets nearest to a literal range: the target's columns and distance. A filter and a top-k, no join."""
    ref, own = Interval.literal(literal), Interval.of(target_schema)
    stranded = stranded and ref.strand is not None and own.strand is not None
    near = target.where(own.chrom == ref.chrom)
    if stranded:
        near = near.where(own.strand == ref.strand)
    near = near.withColumn("distance", distance(ref, own, stranded=stranded, signed=signed))
    if max_distance is not None:
        near = near.where(F.abs("distance") <= max_distance)
    return near.orderBy(F.abs("distance").asc_nulls_last(), own.start, own.end).limit(k)
