"""Readers and writers of interval files."""

import pytest

from locusloom.operators import intersects
from locusloom.schema import Interval
from locusloom.session import IntervalSession
from locusloom.sources import read_bed, read_gff, read_narrow_peak, read_parquet, read_vcf, write_bed, write_parquet


def written(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join("\t".join(map(str, x)) if isinstance(x, tuple) else x for x in lines) + "\n")
    return str(path)


def named(df, schema, literal, column="name"):
    return sorted(r[0] for r in df.where(intersects(Interval.of(schema), literal)).select(column).collect())


@pytest.mark.parametrize("columns", [3, 4, 6, 12])
def test_bed(spark, tmp_path, columns):
    full = ("chr1", 100, 200, "a", 1.5, "+", 100, 200, "0,0,0", 1, "100", "0"), ("chr1", 200, 260, ".", 0, ".", 200, 260, "0", 1, "60", "0")
    path = written(tmp_path, "x.bed", "#comment", *[x[:columns] for x in full])
    df, schema = read_bed(spark, path, columns)
    assert len(df.columns) == columns and (schema.strand is None) == (columns < 6)
    assert df.where(intersects(Interval.of(schema), "chr1:199-201")).count() == 2 and df.where(intersects(Interval.of(schema), "chr1:200-201")).count() == 1
    if columns >= 6:
        assert [tuple(r) for r in df.select("name", "score", "strand").collect()] == [("a", 1.5, "+"), (None, 0.0, ".")]
    with pytest.raises(ValueError, match="3 to 12"):
        read_bed(spark, path, 2)


def test_narrow_peak(spark, tmp_path):
    path = written(tmp_path, "x.narrowPeak", ("chr2", 10, 50, "p1", 900, ".", 5.5, 3.2, -1, 20), ("chr2", 60, 90, "p2", 100, "-", 1.5, 2.0, 1.0, 5))
    df, schema = read_narrow_peak(spark, path)
    assert named(df, schema, "chr2:49-60") == ["p1"]
    assert [tuple(r) for r in df.select("signal_value", "q_value", "peak", "strand").collect()] == [(5.5, -1.0, 20, "."), (1.5, 1.0, 5, "-")]


def test_gff(spark, tmp_path):
    path = written(tmp_path, "x.gff", "##gff-version 3", ("chr1", "src", "gene", 101, 200, ".", "+", ".", "ID=g1;Name=x"), ("chr1", "src", "exon", 201, 300, "3", "-", "0", "ID=e1"))
    df, schema = read_gff(spark, path)
    # The first holds 0-based positions 100 to 199.
    assert named(df, schema, "chr1:199-200", "type") == ["gene"] and named(df, schema, "chr1:200-201", "type") == ["exon"]
    session = IntervalSession(spark)
    session.register("genes", df, schema)
    assert [tuple(r) for r in session.sql("SELECT type, CLUSTER(interval, 1) AS id FROM genes ORDER BY start").collect()] == [("gene", 1), ("exon", 1)]


def test_vcf(spark, tmp_path):
    rows = ("chr1", 100, "snv", "A", "T", 50, "PASS", "DP=3"), ("chr1", 200, "del", "ACGT", "A", ".", ".", "."), ("chr1", 300, "sv", "N", "<DEL>", ".", "PASS", "SVTYPE=DEL;END=400"), ("chr1", 500, "len", "N", "<DEL>", ".", "PASS", "SVLEN=-50;SVTYPE=DEL")
    df, schema = read_vcf(spark, written(tmp_path, "x.vcf", "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", *rows))
    assert {r.id: (r.start, r.end) for r in df.collect()} == {"snv": (100, 100), "del": (200, 203), "sv": (300, 400), "len": (500, 550)}
    assert named(df, schema, "chr1:399-400", "id") == ["sv"] and named(df, schema, "chr1:400-401", "id") == [] and named(df, schema, "chr1:99-100", "id") == ["snv"]


def test_round_trips(spark, tmp_path):
    df, schema = read_gff(spark, written(tmp_path, "y.gff", ("chr1", "s", "gene", 101, 200, ".", "+", ".", "a")))
    write_bed(df, str(tmp_path / "bed"), schema, columns=["type"])
    again, own = read_bed(spark, str(tmp_path / "bed"), 4)
    assert [tuple(r) for r in again.collect()] == [("chr1", 100, 200, "gene")] and own.strand is None
    write_parquet(again, str(tmp_path / "pq"))
    assert [tuple(r) for r in read_parquet(spark, str(tmp_path / "pq"))[0].collect()] == [("chr1", 100, 200, "gene")]
