"""Interval operators over DataFrames."""

from locusloom.operators.cluster import cluster, merge
from locusloom.operators.disjoin import disjoin
from locusloom.operators.distance import distance
from locusloom.operators.joins import count_overlaps, overlap_join, within_distance_join
from locusloom.operators.nearest import nearest, nearest_to
from locusloom.operators.predicates import all_of, any_of, contains, intersects, within

__all__ = ["all_of", "any_of", "cluster", "contains", "count_overlaps", "disjoin", "distance", "intersects", "merge", "nearest", "nearest_to", "overlap_join", "within", "within_distance_join"]
