"""A Spark-native engine for genomic intervals."""

from locusloom.operators import all_of, any_of, cluster, contains, count_overlaps, disjoin, distance, intersects, merge, nearest, nearest_to, overlap_join, within, within_distance_join
from locusloom.plans.registry import register_strategy, strategies
from locusloom.ranges import Range, parse_range
from locusloom.schema import CANONICAL, Interval, IntervalSchema
from locusloom.session import IntervalSession, session

__all__ = [
    "CANONICAL",
    "Interval",
    "IntervalSchema",
    "IntervalSession",
    "Range",
    "all_of",
    "any_of",
    "cluster",
    "contains",
    "count_overlaps",
    "disjoin",
    "distance",
    "intersects",
    "merge",
    "nearest",
    "nearest_to",
    "overlap_join",
    "parse_range",
    "register_strategy",
    "session",
    "strategies",
    "within",
    "within_distance_join",
]
