"""Overlap joins of every type, under two strategies with one result.

`plain` hands Catalyst the equality of chromosomes with the predicate as a residual, where a side has a few rows; it counts up to
that many, and goes on as binned if both sides have more, since a residual tries all pairs of a chromosome. `binned` is
an equi-join on bins of positions (plans/binned.py). `auto` is binned unless Catalyst can prove that a side has few rows:
an estimate in bytes is no proof, and even 10 MB of intervals against a large side are too many pairs to try one by one. Semi,
anti and outer joins are built on the matched pairs: whether a row has a partner depends on its values alone, so rows are
told apart by a 128-bit hash of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.operators.predicates import intersects
from locusloom.plans.binned import binned_pairs, choose_bins
from locusloom.plans.registry import Join, joined_by, register_strategy
from locusloom.schema import CANONICAL, Interval, IntervalSchema

#: Rows up to which a side counts as small.
SMALL = 4096
_HOW = {"inner": "inner", "left": "left", "leftouter": "left", "left_outer": "left", "right": "right", "rightouter": "right", "right_outer": "right", "full": "full", "outer": "full", "fullouter": "full", "full_outer": "full", "semi": "semi", "leftsemi": "semi", "left_semi": "semi", "anti": "anti", "leftanti": "anti", "left_anti": "anti"}

On = Callable[[Interval, Interval], Column]


def is_small(df: DataFrame) -> bool:
    """Whether the plan itself bounds the rows (a local relation, a limit, a global aggregate). Runs nothing."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and int(str(most.get())) <= SMALL


def overlap_join(left: DataFrame, right: DataFrame, *, how: str = "inner", left_schema: IntervalSchema = CANONICAL, right_schema: IntervalSchema = CANONICAL, on: Column | None = None, predicate: On = intersects, left_alias: str = "a", right_alias: str = "b", strategy: str = "auto", bins: list[int] | None = None) -> DataFrame:
    """Joins rows whose intervals satisfy `predicate` (intersects, contains or within, all of which imply overlap or touch).

    on: further conditions over a.<column> and b.<column>. Columns of the result can be named a.<column> and b.<column>;
    semi and anti joins return the left side's. strategy: plain, binned, another that is registered (plans/registry.py), or auto. bins: widths of the bins, where known.
    """
    return joined_by(strategy, Join(left, right, _HOW[how.lower()], left_schema, right_schema, predicate, on, left_alias, right_alias, bins))


def _has_few(df: DataFrame) -> bool:
    """Whether there are SMALL rows at most: by the plan, or by a count that stops there. Streams are joined as they come."""
    return df.isStreaming or is_small(df) or df.limit(SMALL + 1).count() <= SMALL


def _plain(j: Join) -> DataFrame:
    if not (_has_few(j.left) or _has_few(j.right)):
        return _binned(j)
    test = j.predicate(Interval.of(j.left_schema, j.left_alias), Interval.of(j.right_schema, j.right_alias))
    condition = test if j.on is None else test & j.on
    return j.left.alias(j.left_alias).join(j.right.alias(j.right_alias), condition, {"semi": "left_semi", "anti": "left_anti"}.get(j.how, j.how))


def _binned(j: Join) -> DataFrame:
    x, y = _side(j.left, j.left_schema, "_l"), _side(j.right, j.right_schema, "_r")
    pairs = binned_pairs(x, y, j.bins or choose_bins(x, y), None if j.predicate is intersects else j.predicate).select(F.col("_l").alias(j.left_alias), F.col("_r").alias(j.right_alias))
    if j.on is not None:
        pairs = pairs.where(j.on)
    told = lambda alias, df: pairs.select(*_row_hash(df, alias)).distinct()
    if j.how in ("semi", "anti"):
        return _by_hash(j.left, told(j.left_alias, j.left), f"left_{j.how}")
    # One aliased side at a time, so that a.x and b.x keep their meaning.
    whole = pairs
    row = lambda df, alias: F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias)
    none = lambda alias: F.lit(None).cast(pairs.schema[alias].dataType).alias(alias)
    if j.how in ("left", "full"):
        lone = _by_hash(j.left, told(j.left_alias, j.left), "left_anti")
        whole = whole.unionByName(lone.select(row(j.left, j.left_alias), none(j.right_alias)))
    if j.how in ("right", "full"):
        lone = _by_hash(j.right, told(j.right_alias, j.right), "left_anti")
        whole = whole.unionByName(lone.select(none(j.left_alias), row(j.right, j.right_alias)))
    return whole


register_strategy("binned", _binned, lambda j: True)
register_strategy("plain", _plain, lambda j: is_small(j.left) or is_small(j.right))


def _side(df: DataFrame, schema: IntervalSchema, name: str) -> DataFrame:
    i = Interval.of(schema)
    return df.select(i.chrom.alias("_c"), i.start.cast("long").alias("_s"), i.end.cast("long").alias("_e"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def _row_hash(df: DataFrame, alias: str | None = None) -> list[Column]:
    """Two hashes of a row. Hashes pass over nulls, so a mask of them is hashed too; nested values are hashed as text."""
    named = {f.name: F.col(f"{alias}.`{f.name}`" if alias else f"`{f.name}`") for f in df.schema.fields}
    nested = {f.name for f in df.schema.fields if f.dataType.simpleString().startswith(("struct", "array", "map", "variant"))}
    columns = [F.to_json(F.struct(c.alias("v"))) if n in nested else c for n, c in named.items()]
    mask = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in named.values()])
    return [F.xxhash64(mask, *columns).alias("_h1"), F.xxhash64(F.lit(7), *columns, mask).alias("_h2")]


def _by_hash(df: DataFrame, matched: DataFrame, how: str) -> DataFrame:
    mine = df.select("*", *[h.alias(n) for h, n in zip(_row_hash(df), ("_h3", "_h4"), strict=True)])
    return mine.join(matched, (F.col("_h1") == F.col("_h3")) & (F.col("_h2") == F.col("_h4")), how).drop("_h3", "_h4")


def count_overlaps(left: DataFrame, right: DataFrame, *, keys: list[str] | None = None, left_schema: IntervalSchema = CANONICAL, right_schema: IntervalSchema = CANONICAL, on: Column | None = None, name: str = "n_overlaps", **options) -> DataFrame:
    """For each distinct value of the keys (all left columns by default) the number of overlapping right rows, 0 if none; equal left rows add up."""
    keys = keys or left.columns
    joined = overlap_join(left, right, how="left", left_schema=left_schema, right_schema=right_schema, on=on, **options)
    return joined.groupBy(*[F.col(f"a.`{k}`").alias(k) for k in keys]).agg(F.count(F.col(f"b.`{right_schema.chrom}`")).alias(name))


def within_distance_join(left: DataFrame, right: DataFrame, limit: int, *, left_schema: IntervalSchema = CANONICAL, right_schema: IntervalSchema = CANONICAL, strategy: str = "auto", bins: list[int] | None = None) -> DataFrame:
    """Pairs at a DISTANCE of at most `limit`, with it as `distance`: an overlap join of the left side widened by limit - 1, or none at limit 0."""
    from locusloom.operators.distance import distance

    wide = "_wide_start", "_wide_end"
    i = Interval.of(left_schema)
    grown = left.withColumns({wide[0]: i.start - max(limit, 0), wide[1]: i.end + max(limit, 0)})
    # Touching at exactly `limit` gives DISTANCE limit + 1: the exact test follows.
    joined = overlap_join(grown, right, left_schema=IntervalSchema(chrom=left_schema.chrom, start=wide[0], end=wide[1], strand=left_schema.strand), right_schema=right_schema, strategy=strategy, bins=bins)
    d = distance(Interval.of(left_schema, "a"), Interval.of(right_schema, "b"))
    return joined.withColumn("distance", d).where(F.col("distance") <= limit)
