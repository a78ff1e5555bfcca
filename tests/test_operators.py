"""Operators against brute force over small random intervals with ties, duplicates, empty intervals and unknown strands."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusloom.operators import cluster, count_overlaps, disjoin, distance, merge, nearest, overlap_join, within_distance_join
from locusloom.schema import Interval, IntervalSchema
from locusloom.streaming import stream_filter, stream_overlap_join

SCHEMA = "chrom string, start long, end long, strand string, id int"


def make(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["c1", "c2"]), (a := rng.randint(0, 60)), a + rng.randint(0, 12), rng.choice("+-.?"), i) for i in range(n)]
    return rows + rows[:2]


A, B = make(1, 30), make(2, 40)


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)


def over(x, y):
    return x[0] == y[0] and x[1] < y[2] and x[2] > y[1]


def apart(x, y, stranded=False, signed=False):
    if x[0] != y[0] or stranded and (x[3] in ".?" or y[3] in ".?"):
        return None
    flip = -1 if stranded and x[3] == "-" else 1
    if over(x, y):
        return 0
    if x[2] <= y[1]:
        return (y[1] - x[2] + 1) * flip
    return (x[1] - y[2] + 1) * flip * (-1 if signed else 1)


@pytest.mark.parametrize(("strategy", "bins"), [("plain", None), ("binned", [64]), ("binned", [2, 16, 128])])
@pytest.mark.parametrize("how", ["inner", "left", "full", "semi", "anti"])
def test_overlap_joins(sides, how, strategy, bins):
    joined = overlap_join(*sides, how=how, strategy=strategy, bins=bins)
    if how in ("semi", "anti"):
        assert Counter(map(tuple, joined.collect())) == Counter(x for x in A if any(over(x, y) for y in B) == (how == "semi"))
        return
    expected = Counter((x[4], y[4]) for x in A for y in B if over(x, y))
    if how != "inner":
        expected += Counter((x[4], None) for x in A if not any(over(x, y) for y in B))
    if how == "full":
        expected += Counter((None, y[4]) for y in B if not any(over(x, y) for x in A))
    assert Counter(map(tuple, joined.select("a.id", "b.id").collect())) == expected


@pytest.mark.parametrize(
    ("how", "rows"),
    [
        ("anti", 2500),
        ("full", 7500),
        ("left", 5000),
        ("count", 5000),
        ("inner", 2500),
        ("right", 5000),
        ("semi", 2500),
    ],
)
def test_plain_joins_of_many_rows_try_no_chromosome_whole(spark, how, rows):
    left = spark.range(5000).selectExpr("'c' AS chrom", "id * 10 AS start", "id * 10 + 5 AS end", "id")
    right = spark.range(5000).selectExpr("'c' AS chrom", "id * 20 + 3 AS start", "id * 20 + 6 AS end", "id")
    if how == "count":
        joined = count_overlaps(left, right, strategy="plain")
        assert joined.agg(F.sum("n_overlaps")).first()[0] == 2500
    else:
        joined = overlap_join(left, right, how=how, strategy="plain")
    assert joined.count() == rows
    assert "_b1" in joined._jdf.queryExecution().optimizedPlan().toString()  # the equality of bins
    few = overlap_join(left, right.limit(5), how="inner", strategy="plain")
    assert few.count() == 5 and "_b1" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_counts_and_distances(sides):
    a, b = sides
    counted = count_overlaps(a, b, strategy="binned", bins=[8]).select("id", "n_overlaps")
    copies = Counter(x[4] for x in A)
    assert dict(map(tuple, counted.collect())) == {x[4]: copies[x[4]] * sum(over(x, y) for y in B) for x in A}
    near = within_distance_join(a, b, 5).select("a.id", "b.id", "distance")
    assert Counter(map(tuple, near.collect())) == Counter((x[4], y[4], apart(x, y)) for x in A for y in B if x[0] == y[0] and apart(x, y) <= 5)
    for stranded, signed in itertools.product((False, True), repeat=2):
        d = distance(Interval.of(alias="a"), Interval.of(alias="b"), stranded=stranded, signed=signed)
        got = a.alias("a").crossJoin(b.alias("b")).select("a.id", "b.id", d)
        assert Counter(map(tuple, got.collect())) == Counter((x[4], y[4], apart(x, y, stranded, signed)) for x in A for y in B)


@pytest.mark.parametrize(("k", "most", "stranded", "signed"), [(1, None, False, False), (3, 4, False, True), (2, None, True, True)])
def test_nearest(sides, k, most, stranded, signed):
    found = nearest(*sides, k=k, max_distance=most, stranded=stranded, signed=signed, segment=8).select("a.id", "b.start", "b.end", "distance")
    expected = Counter()
    for x in A:
        near = [(apart(x, y, stranded, signed), y) for y in B if x[0] == y[0] and (not stranded or x[3] == y[3])]
        near = [v for v in near if most is None or v[0] is not None and abs(v[0]) <= most]
        near.sort(key=lambda v: (10**9 if v[0] is None else abs(v[0]), v[1][1], v[1][2]))
        expected.update((x[4], y[1], y[2], d) for d, y in near[:k])
    assert Counter(map(tuple, found.collect())) == expected


@pytest.mark.parametrize(("gap", "stranded", "gated"), [(0, False, False), (3, True, False), (0, False, True)])
def test_cluster_and_merge(sides, gap, stranded, gated):
    groups = {}
    for x in sorted(B, key=lambda x: (x[1], x[2], x[0], x[3], x[4])):
        groups.setdefault((x[0], x[3]) if stranded else x[0], []).append(x)
    expected = Counter()
    for rows in groups.values():
        end, flags = None, []
        for i, x in enumerate(rows):
            flags.append(int(not (end is not None and end + gap >= x[1] and (not gated or rows[i - 1][3] == x[3]))))
            end = x[2] if end is None else max(end, x[2])
        expected.update((x[4], sum(f for f, y in zip(flags, rows, strict=True) if y[1] <= x[1])) for x in rows)
    options = {"distance": gap, "stranded": stranded, "predicate": (lambda prev: F.col("strand") == prev("strand")) if gated else None, "segment": 8}
    assert Counter(map(tuple, cluster(sides[1], **options).select("id", "cluster").collect())) == expected
    assert sum(r.n for r in merge(sides[1], F.count(F.lit(1)).alias("n"), **options).collect()) == len(B)


@pytest.mark.parametrize("strategy", ["plain", "binned"])
def test_disjoin(sides, strategy):
    def expected(targets, others):
        out = Counter()
        for t in targets:
            points = sorted({t[1], t[2]} | {p for r in others or targets if r[0] == t[0] for p in r[1:3] if t[1] < p < t[2]})
            out.update((t[4], u, v) for u, v in itertools.pairwise(points) if others is None or any(r[0] == t[0] and r[1] <= u < r[2] for r in others))
        return out

    a, b = sides
    for reference, rows in ((None, None), (a, A)):
        got = disjoin(b, reference, strategy=strategy).select("id", "disjoin_start", "disjoin_end")
        assert Counter(map(tuple, got.collect())) == expected(B, rows)
    with pytest.raises(ValueError, match="already has"):
        disjoin(b.withColumn("disjoin_start", F.lit(1)))


def test_encodings_agree(sides):
    a, b = sides
    expected = Counter(map(tuple, overlap_join(a, b).select("a.id", "b.id").collect()))
    for (system, kind), (ds, de) in {("0based", "closed"): (0, 1), ("1based", "half_open"): (-1, -1), ("1based", "closed"): (-1, 0)}.items():
        schema = IntervalSchema(coordinate_system=system, interval_type=kind)
        stored = b.withColumns({"start": F.col("start") - ds, "end": F.col("end") - de})
        assert Counter(map(tuple, overlap_join(a, stored, right_schema=schema).select("a.id", "b.id").collect())) == expected


def test_literals_reach_the_scan(spark, sides, tmp_path):
    from locusloom.operators import intersects
    from locusloom.sources import read_bed, read_parquet, write_bed, write_parquet

    write_parquet(sides[0], str(tmp_path / "p"))
    df, _ = read_parquet(spark, str(tmp_path / "p"))
    plan = df.where(intersects(Interval.of(), "c1:5-9")).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(chrom,c1)" in plan and "LessThan(start,9)" in plan
    write_bed(sides[0].select("chrom", "start", "end"), str(tmp_path / "b"))
    back, _ = read_bed(spark, str(tmp_path / "b"), 3)
    assert Counter(map(tuple, back.collect())) == Counter(x[:3] for x in A)


def test_streams(spark, sides, tmp_path):
    sides[0].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, df in (("near", stream_filter(stream, "c1:5-20").select("id")), ("pairs", stream_overlap_join(stream, sides[1], bins=[16]).select("a.id", F.col("b.id").alias("other")))):
        query = df.writeStream.format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert Counter(r.id for r in spark.table("near").collect()) == Counter(x[4] for x in A if over(x, ("c1", 5, 20)))
    assert Counter(map(tuple, spark.table("pairs").collect())) == Counter((x[4], y[4]) for x in A for y in B if over(x, y))


def test_strategies_can_be_registered(sides):
    from locusloom import overlap_join, register_strategy, strategies
    from locusloom.plans.registry import unregister_strategy

    left, right = sides
    register_strategy("nothing", lambda j: j.left.alias(j.left_alias).join(j.right.alias(j.right_alias), F.lit(False)), lambda j: j.bins == [7])
    try:
        assert strategies()[-1] == "nothing"
        assert overlap_join(left, right, strategy="nothing").count() == 0 == overlap_join(left, right, bins=[7]).count()
        assert overlap_join(left, right).count() == overlap_join(left, right, strategy="plain").count() > 0
    finally:
        unregister_strategy("nothing")
    with pytest.raises(ValueError, match="unknown strategy"):
        overlap_join(left, right, strategy="nothing")


def test_crowded_positions_run_in_segments_of_like_size(spark):
    """All rows in one million positions, most of them in a tenth of these: windows still run in many tasks, none of which holds much."""
    from locusloom.plans.running import _segmented, segment_limits

    rows = spark.range(40_000).selectExpr("'chr1' AS chrom", "cast(if(id % 10 < 9, pmod(hash(id), 100000), pmod(hash(id), 1000000)) AS long) AS start").withColumn("end", F.col("start") + 5)
    limits = segment_limits((rows, "start"), rows=1000)
    sizes = [r["count"] for r in _segmented(rows, "start", limits).groupBy("_seg").count().collect()]
    assert len(sizes) >= 35 and max(sizes) <= 1500
    whole = cluster(rows, segment=1 << 40).agg(F.max("cluster"), F.sum("cluster")).first()
    assert cluster(rows, segment=limits).agg(F.max("cluster"), F.sum("cluster")).first() == whole == cluster(rows).agg(F.max("cluster"), F.sum("cluster")).first()
