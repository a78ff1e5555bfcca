"""What intervals need of Structured Streaming: filters and joins of a stream with a table keep no state; operators that need all rows run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from locusloom.operators.joins import _side
from locusloom.operators.predicates import intersects
from locusloom.plans.binned import binned_pairs
from locusloom.ranges import Range
from locusloom.schema import CANONICAL, Interval, IntervalSchema


def stream_filter(stream: DataFrame, range_: str | Range, *, schema: IntervalSchema = CANONICAL, predicate=intersects) -> DataFrame:
    """The stream's rows that satisfy a literal predicate."""
    return stream.where(predicate(Interval.of(schema), range_))


def stream_overlap_join(stream: DataFrame, table: DataFrame, *, schema: IntervalSchema = CANONICAL, table_schema: IntervalSchema = CANONICAL, bins: list[int]) -> DataFrame:
    """Overlapping pairs of a stream's and a table's rows as structs a and b, by bins; bins are given, since a stream can't be measured."""
    return binned_pairs(_side(stream, schema, "_l"), _side(table, table_schema, "_r"), bins).select(F.col("_l").alias("a"), F.col("_r").alias("b"))


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Runs an operator that needs all rows (cluster, merge, nearest, disjoin) on each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(operator(batch), n))
