"""Connected components by alternating stars, with DataFrame operations only.

Each round points every vertex's larger neighbours, then its smaller ones, at the least vertex it knows. The edges shrink
to stars around each component's least vertex in a logarithmic number of rounds. Minima are aggregated before the
shuffle, the joins back are ordinary ones that adaptive execution can split, and each round is kept in the shared
checkpoint folder, so a vertex with any number of neighbours and a lost executor are both harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours v."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return pairs.join(m, F.col("u") == F.col("c")).drop("c")


def _two(rows: DataFrame, names: tuple[str, str], *pairs: tuple[str, str]) -> DataFrame:
    """Each row's pairs, as rows with these names. A union would plan, and run, all that stands below it once for each pair."""
    return rows.select(F.inline(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(pair, names, strict=True)]) for pair in pairs])))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _two(edges, ("u", "v"), ("a", "b"), ("b", "a"))
    return _least(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _two(_least(down), ("a", "b"), ("m", "v"), ("m", "u")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each vertex of the edges (a, b) that is not its component's least: root is the least one. Ids may have any ordered type; loops and nulls are ignored."""
    edges = cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = edges.select(mark.alias("x")).first().x
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = edges.select(mark.alias("x")).first().x
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
