"""Readers and writers of interval files. Schemas are given, never inferred; filters and columns reach the scan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.schema import CANONICAL, IntervalSchema

_BED = ["chrom string", "start long", "end long", "name string", "score double", "strand string", "thick_start long", "thick_end long", "item_rgb string", "block_count int", "block_sizes string", "block_starts string"]
_PEAK = [*_BED[:6], "signal_value double", "p_value double", "q_value double", "peak long"]
_GFF = "chrom string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
_VCF = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"
#: 1-based, closed.
GFF_SCHEMA = IntervalSchema(coordinate_system="1based", interval_type="closed")
VCF_SCHEMA = replace(GFF_SCHEMA, strand=None)


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    quoted = ", ".join("`{}` {}".format(*c.strip().split(" ", 1)) for c in schema.split(","))
    return spark.read.schema(quoted).options(sep="\t", comment="#", quote="", nullValue=".", mode="PERMISSIVE").csv(path)


def read_bed(spark: SparkSession, path: str, columns: int = 6) -> tuple[DataFrame, IntervalSchema]:
    """A BED file with 3 to 12 columns."""
    if not 3 <= columns <= 12:
        raise ValueError("BED files have 3 to 12 columns")
    df = _tsv(spark, path, ", ".join(_BED[:columns]))
    # '.' is a strand of its own, unlike '.' as a missing name or score.
    return (df.withColumn("strand", F.coalesce("strand", F.lit("."))) if columns >= 6 else df), (CANONICAL if columns >= 6 else replace(CANONICAL, strand=None))


def read_narrow_peak(spark: SparkSession, path: str) -> tuple[DataFrame, IntervalSchema]:
    return _tsv(spark, path, ", ".join(_PEAK)).withColumn("strand", F.coalesce("strand", F.lit("."))), CANONICAL


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, IntervalSchema]:
    return _tsv(spark, path, _GFF).withColumn("strand", F.coalesce("strand", F.lit("."))), GFF_SCHEMA


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, IntervalSchema]:
    """Records with start and end: to END of INFO, else by SVLEN for symbolic alleles, else over REF."""
    df = _tsv(spark, path, _VCF)
    told = lambda name: F.expr(f"try_cast(nullif(regexp_extract(info, '(?:^|;){name}=(-?[0-9]+)', 1), '') AS bigint)")
    by_length = F.when(F.col("alt").startswith("<"), F.col("pos") + F.abs(told("SVLEN")))
    return df.withColumn("start", F.col("pos")).withColumn("end", F.coalesce(told("END"), by_length, F.col("pos") + F.length("ref") - 1)), VCF_SCHEMA


def read_parquet(spark: SparkSession, path: str, schema: IntervalSchema = CANONICAL) -> tuple[DataFrame, IntervalSchema]:
    return spark.read.parquet(path), schema


def write_bed(df: DataFrame, path: str, schema: IntervalSchema = CANONICAL, columns: list[str] | None = None) -> None:
    """Tab-separated, 0-based and half-open, chromosome, start and end first."""
    from locusloom.schema import Interval

    i = Interval.of(schema)
    rest = columns if columns is not None else [c for c in df.columns if c not in (schema.chrom, schema.start, schema.end)]
    df.select(i.chrom, i.start, i.end, *[F.col(f"`{c}`") for c in rest]).write.options(sep="\t", nullValue=".", quote="").csv(path)


def write_parquet(df: DataFrame, path: str, schema: IntervalSchema = CANONICAL) -> None:
    """Sorted by chromosome and start, dealt by range: row groups then hold narrow ranges, which literal predicates prune."""
    df.repartitionByRange(F.col(f"`{schema.chrom}`"), F.col(f"`{schema.start}`")).sortWithinPartitions(schema.chrom, schema.start).write.parquet(path)
