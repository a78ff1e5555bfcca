"""CLUSTER and MERGE.

Rows of one chromosome (and strand, if asked), in order of start, belong to one cluster as long as each begins no later than
`distance` after the greatest end so far; touching rows join at distance 0. Both work on the stored columns, whatever the
encoding. Cluster ids count from 1 in each chromosome (and strand). Windows run in two levels (plans/running.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.plans.running import Segments, carried, segment_limits
from locusloom.schema import CANONICAL, IntervalSchema

Prev = Callable[[str], Column]
_ORDERED = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "binary")


def cluster(df: DataFrame, *, schema: IntervalSchema = CANONICAL, distance: int = 0, stranded: bool = False, predicate: Callable[[Prev], Column] | None = None, name: str = "cluster", segment: Segments | None = None) -> DataFrame:
    """df with the cluster id as a further column.

    segment: limits or width of the segments that windows run in; by default chosen from the data.
    predicate: a function of prev that must hold for a row to join its predecessor's cluster; prev(c) is column c of the row
    before, in order of start, end and then all other columns, which makes ties definite.
    """
    if stranded and schema.strand is None:
        raise ValueError("stranded clusters need a strand column")
    keys = [schema.chrom] + ([schema.strand] if stranded else [])
    start, end = F.col(f"`{schema.start}`"), F.col(f"`{schema.end}`")
    used: list[str] = []
    if predicate is not None:
        predicate(lambda c: used.append(c) or F.lit(None))
    rest = [f.name for f in df.schema.fields if f.name not in (schema.start, schema.end) and (f.dataType.simpleString() in _ORDERED or f.dataType.simpleString().startswith("decimal"))]
    total = [start.asc_nulls_last(), end.asc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_last() for c in rest]] if predicate is not None else [start.asc_nulls_last()]
    told = {"max_end": F.max(end)}
    row = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(dict.fromkeys(used))]) if used else None
    if used:
        last = F.struct(start, end, *[F.col(f"`{c}`") for c in rest])
        told["last_row"] = F.max_by(row, last)
    segment = segment_limits((df, schema.start)) if segment is None else segment
    work = carried(df, keys, schema.start, told, segment)
    window = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_seg").orderBy(*total)
    edge = F.greatest(F.max(end).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.col("max_end"))
    work = work.withColumn("_edge", edge)
    joins = F.col("_edge") + F.lit(distance) >= start
    if predicate is not None:
        names = list(dict.fromkeys(used))
        if used:
            work = work.withColumn("_prev", F.coalesce(F.lag(row).over(window), F.col("last_row")))
        joins = joins & predicate(lambda c: F.col("_prev")[f"v{names.index(c)}"])
    work = work.withColumn("_flag", F.when(joins, F.lit(0)).otherwise(F.lit(1)))
    work = carried(work.drop("_seg"), keys, schema.start, {"sum_flag": F.sum("_flag")}, segment)
    peers = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_seg").orderBy(start.asc_nulls_last())  # rows of equal start count together
    id_ = (F.sum("_flag").over(peers) + F.coalesce("sum_flag", F.lit(0))).cast("long")
    return work.select(*[F.col(f"`{c}`") for c in df.columns], id_.alias(name))


def merge(df: DataFrame, *aggregates: Column, schema: IntervalSchema = CANONICAL, distance: int = 0, stranded: bool = False, predicate: Callable[[Prev], Column] | None = None, segment: Segments | None = None) -> DataFrame:
    """One row per cluster: chromosome (and strand), least start, greatest end, under their stored names, then the aggregates."""
    keys = [schema.chrom] + ([schema.strand] if stranded else [])
    marked = cluster(df, schema=schema, distance=distance, stranded=stranded, predicate=predicate, name="_cluster", segment=segment)
    return marked.groupBy(*[F.col(f"`{k}`") for k in keys], "_cluster").agg(F.min(F.col(f"`{schema.start}`")).alias(schema.start), F.max(F.col(f"`{schema.end}`")).alias(schema.end), *aggregates).drop("_cluster")
