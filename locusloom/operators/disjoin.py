"""DISJOIN: target intervals cut at the breakpoints of a reference.

Breakpoints inside a target come from an overlap join of points with intervals, so they are found by bins, not by comparing
every point of a chromosome with every interval. Segments of equal targets are made once and given to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.operators.joins import overlap_join
from locusloom.schema import CANONICAL, Interval, IntervalSchema

OUTPUT = ("disjoin_chrom", "disjoin_start", "disjoin_end")
_PLAIN = IntervalSchema(chrom="_c", start="_s", end="_e", strand=None)


def _canonical(df: DataFrame, schema: IntervalSchema) -> DataFrame:
    i = Interval.of(schema)
    return df.select(i.chrom.alias("_c"), i.start.cast("long").alias("_s"), i.end.cast("long").alias("_e")).where("_c is not null and _s is not null and _e is not null")


def disjoin(target: DataFrame, reference: DataFrame | None = None, *, schema: IntervalSchema = CANONICAL, reference_schema: IntervalSchema = CANONICAL, strategy: str = "auto") -> DataFrame:
    """Each target row once for each segment of it: its columns, then disjoin_chrom, disjoin_start, disjoin_end in its encoding.

    Without a reference the targets cut each other. With one, only segments that begin inside a reference interval stay.
    """
    taken = [c for c in target.columns if c.lower() in OUTPUT]
    if taken:
        raise ValueError(f"the target already has {', '.join(taken)}")
    keys = _canonical(target, schema).distinct()
    ref = keys if reference is None else _canonical(reference, reference_schema)
    points = ref.select("_c", F.col("_s").alias("_p")).union(ref.select("_c", F.col("_e").alias("_p"))).distinct()
    points = points.select("_c", F.col("_p").alias("_s"), (F.col("_p") + 1).alias("_e"))
    # A breakpoint strictly inside [s, e) is a point that overlaps [s + 1, e).
    inner = keys.select("_c", (F.col("_s") + 1).alias("_s"), "_e", F.col("_s").alias("_k")).where("_s < _e")
    met = overlap_join(inner, points, left_schema=_PLAIN, right_schema=_PLAIN, strategy=strategy)
    cuts = met.select(F.col("a._c").alias("_c"), F.col("a._k").alias("_s"), F.col("a._e").alias("_e"), F.col("b._s").alias("_p"))
    cuts = cuts.union(keys.select("_c", "_s", "_e", F.col("_s").alias("_p"))).union(keys.select("_c", "_s", "_e", F.col("_e").alias("_p"))).distinct()
    upto = F.lead("_p").over(Window.partitionBy("_c", "_s", "_e").orderBy("_p"))
    segments = cuts.withColumn("_q", upto).where("_q > _p")
    if reference is not None:
        begins = segments.select("_c", F.col("_p").alias("_s"), (F.col("_p") + 1).alias("_e")).distinct()
        covered = overlap_join(begins, ref, how="left_semi", left_schema=_PLAIN, right_schema=_PLAIN, strategy=strategy).select(F.col("_c").alias("_cc"), F.col("_s").alias("_cp"))
        segments = segments.join(covered, (F.col("_c") == F.col("_cc")) & (F.col("_p") == F.col("_cp")), "left_semi")
    i = Interval.of(schema, "t")
    on = (i.chrom == F.col("g._c")) & (i.start == F.col("g._s")) & (i.end == F.col("g._e"))
    start, end = schema.stored(F.col("g._p"), F.col("g._q"))
    return target.alias("t").join(segments.alias("g"), on).select(*[F.col(f"t.`{c}`") for c in target.columns], F.col("g._c").alias(OUTPUT[0]), start.alias(OUTPUT[1]), end.alias(OUTPUT[2]))
