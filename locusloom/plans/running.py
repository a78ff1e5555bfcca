"""Running aggregates along a position without one task for each chromosome.

A window over a chromosome puts all its rows into one task. Here positions are cut into segments: a window runs within each
segment, one small table holds an aggregate per segment, and a window over that table gives what has come before. Rows with
equal positions lie in one segment, so the result is that of one window over the whole chromosome.

Segments follow the data: their limits are approximate quantiles of the positions, so that a segment holds about as many rows as any
other however the positions crowd, and their number grows with the rows. A fixed width can be given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a segment, about, and the most limits that are sent to tasks.
ROWS, MOST = 1 << 19, 2048

Segments = int | list[float]


def segment_limits(*sides: tuple[DataFrame, str], rows: int = ROWS) -> list[float]:
    """Limits of segments of about equal rows, from one aggregate over the positions (DataFrame, column) of all sides: their count and MOST quantiles, of which as many are used as there are rows for."""
    every = [df.select(F.col(f"`{c}`").cast("double").alias("p")) for df, c in sides]
    spark, both = every[0].sparkSession, every[0]
    for x in every[1:]:
        both = both.unionByName(x)
    got = both.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("p", [k / MOST for k in range(1, MOST)], 4 * MOST).alias("q")).first()
    wanted = min(MOST, max(-(-got.n // rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return sorted({got.q[k * MOST // wanted - 1] for k in range(1, wanted)}) if got.q else []


def segment_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def _segmented(df: DataFrame, position: str, segments: Segments) -> DataFrame:
    """df with `_seg`, which grows with the position; null positions come last."""
    if isinstance(segments, int):
        return df.withColumn("_seg", segment_of(F.col(f"`{position}`"), segments))
    if not segments:
        return df.withColumn("_seg", F.when(F.col(f"`{position}`").isNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    from pyspark.ml.feature import Bucketizer

    marked = df.withColumn("_at", F.coalesce(F.col(f"`{position}`").cast("double"), F.lit(float("nan"))))
    cuts = Bucketizer(splits=[float("-inf"), *segments, float("inf")], inputCol="_at", outputCol="_seg", handleInvalid="keep")  # a binary search
    return cuts.transform(marked).drop("_at").withColumn("_seg", F.col("_seg").cast("long"))


def carried(df: DataFrame, keys: list[str], position: str, aggregates: dict[str, Column], segments: Segments) -> DataFrame:
    """df with `_seg` and the aggregates of all earlier segments of the same keys as `<name>`: aggregates maps names to aggregate columns that F.max or F.sum can combine, told by their prefix max_ or sum_; last_ keeps the one of the nearest earlier segment."""
    cut_ = _segmented(df, position, segments)
    each = cut_.groupBy(*[F.col(f"`{k}`") for k in keys], "_seg").agg(*[c.alias(n) for n, c in aggregates.items()])
    over = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col("_seg").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col("_seg").asc_nulls_last())
    combine = {"max": lambda n: F.max(n).over(over), "sum": lambda n: F.sum(n).over(over), "last": lambda n: F.lag(n).over(back)}
    told = each.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_carried"), *[combine[n.split("_")[0]](n).alias(n) for n in aggregates])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_seg").eqNullSafe(F.col("_carried"))]
    return cut_.join(told, same, "left").drop("_carried", *[f"_k{i}" for i in range(len(keys))])
