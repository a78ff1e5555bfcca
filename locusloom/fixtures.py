"""Interval relations derived from the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FEATURES = """
SELECT concat('chr', cast(l_suppkey % 4 + 1 AS {text})) AS chrom,
  l_orderkey * 40 + (l_partkey * 97 + l_linenumber * 31) % 400 AS {q}start{q},
  l_orderkey * 40 + (l_partkey * 97 + l_linenumber * 31) % 400 + cast(floor(l_quantity) AS bigint) AS {q}end{q},
  l_orderkey * 10 + l_linenumber AS name, cast(floor(l_extendedprice) AS bigint) % 1000 AS score,
  CASE WHEN l_linenumber % 3 = 0 THEN '-' WHEN l_linenumber % 7 = 0 THEN '.' ELSE '+' END AS strand
FROM lineitem
"""
_PEAKS = """
SELECT concat('chr', cast(o_custkey % 5 + 1 AS {text})) AS chrom,
  o_orderkey * 40 + (o_custkey * 53) % 400 AS {q}start{q},
  o_orderkey * 40 + (o_custkey * 53) % 400 + 1 + cast(floor(o_totalprice) AS bigint) % 60 AS {q}end{q},
  o_orderkey AS name, cast(floor(o_totalprice) AS bigint) % 1000 AS score,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand
FROM orders
"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(text="string", q="`").replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", _FEATURES)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", _PEAKS)


#: The same for DuckDB, to stand before a query.
WITH = f"""features AS ({_FEATURES.format(text="varchar", q='"').strip()}), peaks AS ({_PEAKS.format(text="varchar", q='"').strip()})"""
