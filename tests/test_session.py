import pytest

from locusloom.schema import IntervalSchema
from locusloom.session import IntervalSession


@pytest.fixture()
def session(spark, small):
    out = IntervalSession(spark)
    for name, df in small.items():
        out.register(name, df)
    closed = small["features"].selectExpr("chrom AS seqid", "start + 1 AS lo", "end AS hi", "name", "strand")
    out.register("closed", closed, IntervalSchema(chrom="seqid", start="lo", end="hi", coordinate_system="1based", interval_type="closed"))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("where", "names"),
    [
        ("interval INTERSECTS 'chr1:0-60'", "a"),
        ("interval CONTAINS 'chr1:60'", "ab"),
        ("interval CONTAINS 'chr1:[99,100]'", "b"),
        ("interval WITHIN 'chr1:0-100'", "a"),
        ("NOT f.interval INTERSECTS 'chr1:0-60'", "bc"),
        ("interval INTERSECTS ANY('chr1:0-10', 'chr2:[20,30]')", "ac"),
        ("interval INTERSECTS ALL('chr1:0-61', 'chr1:170-175')", "b"),
        ("interval INTERSECTS SOME('chr3:1-2')", ""),
    ],
)
def test_literal_predicates(session, where, names):
    assert "".join(r[0] for r in rows(session.sql(f"SELECT name FROM features f WHERE {where}"))) == names


def test_other_encoding(session):
    assert rows(session.sql("SELECT name FROM closed WHERE interval INTERSECTS 'chr1:99-101'")) == [("a",), ("b",)]
    joined = session.sql("SELECT a.name, b.name AS other FROM closed a JOIN mask b ON a.interval INTERSECTS b.interval")
    assert rows(joined) == rows(session.sql("SELECT a.name, b.name AS other FROM features a JOIN mask b ON a.interval INTERSECTS b.interval"))


def test_joins(session):
    pairs = 'SELECT a.name, b.name AS other FROM features a {} mask b ON a.interval INTERSECTS b.interval AND a."start" >= 0'
    assert rows(session.sql(pairs.format("JOIN"))) == [("a", "m1"), ("a", "m2"), ("b", "m1"), ("b", "m2"), ("c", "m3")]
    three = session.sql("SELECT a.name, b.name AS other, c.name AS third FROM features a JOIN mask b ON a.interval INTERSECTS b.interval JOIN annotations c ON b.interval INTERSECTS c.interval")
    assert rows(three) == [("a", "m1", "g1"), ("b", "m1", "g1"), ("c", "m3", "g2")]
    text = session.to_spark_sql("SELECT 1 FROM features a JOIN mask b ON a.interval INTERSECTS b.interval JOIN annotations c ON b.interval INTERSECTS c.interval")
    assert text.count("= `_start_") == 2 and "<" not in text
    anti = session.sql("SELECT a.name FROM features a LEFT ANTI JOIN annotations b ON a.interval INTERSECTS b.interval")
    assert rows(anti) == [("b",)]
    exists = session.sql("SELECT a.name FROM features a WHERE NOT EXISTS (SELECT 1 FROM annotations b WHERE a.interval INTERSECTS b.interval)")
    assert rows(exists) == [("b",)]
    counted = session.sql("SELECT a.name, count(b.name) AS n FROM features a LEFT JOIN annotations b ON a.interval INTERSECTS b.interval GROUP BY a.name HAVING count(b.name) < 1")
    assert rows(counted) == [("b", 0)]


def test_distance(session):
    got = session.sql("SELECT a.name, b.name AS other, DISTANCE(a.interval, b.interval, signed := true) AS d FROM features a JOIN annotations b ON a.chrom = b.chrom")
    assert rows(got) == [("a", "g1", 0), ("b", "g1", -31), ("c", "g2", 0)]
    with pytest.raises(ValueError, match="second argument"):
        session.sql("SELECT DISTANCE(a.interval, 'chr1:1-2') FROM features a")


def test_cluster(session):
    got = session.sql("SELECT *, CLUSTER(interval) AS c FROM features WHERE name <> 'x' ORDER BY name")
    assert got.columns == ["chrom", "start", "end", "name", "strand", "c"]
    assert [(r.name, r.c) for r in got.collect()] == [("a", 1), ("b", 1), ("c", 1)]
    stranded = session.sql("SELECT name, CLUSTER(interval, stranded := true, predicate := strand = PREV(strand)) AS c FROM features")
    assert rows(stranded) == [("a", 1), ("b", 1), ("c", 1)]
    gated = session.sql("SELECT name, CLUSTER(interval, 5, predicate := strand = PREV(strand)) AS c FROM features")
    assert rows(gated) == [("a", 1), ("b", 2), ("c", 1)]


def test_merge(session):
    got = session.sql("SELECT MERGE(interval), COUNT(*) AS n, max(name) AS last FROM features")
    assert [tuple(r) for r in got.collect()] == [("chr1", 0, 180, 2, "b"), ("chr2", 10, 40, 1, "c")]
    assert got.columns == ["chrom", "start", "end", "n", "last"]
    assert [tuple(r) for r in session.sql("SELECT MERGE(interval), COUNT(*) AS n FROM features HAVING COUNT(*) > 1 ORDER BY n LIMIT 1").collect()] == [("chr1", 0, 180, 2)]
    # Stored columns count, whatever the encoding: touching closed intervals don't meet.
    depth = session.sql("WITH d AS (SELECT disjoin_chrom AS chrom, disjoin_start AS start, disjoin_end AS end, count(*) AS n FROM DISJOIN(features) GROUP BY 1, 2, 3) SELECT MERGE(interval, predicate := n = PREV(n)) FROM d")
    assert rows(depth) == [("chr1", 0, 60), ("chr1", 60, 100), ("chr1", 100, 180), ("chr2", 10, 40)]


def test_disjoin(session):
    own = session.sql("SELECT name, disjoin_start, disjoin_end FROM DISJOIN(features) AS d")
    assert rows(own) == [("a", 0, 60), ("a", 60, 100), ("b", 60, 100), ("b", 100, 180), ("c", 10, 40)]
    other = session.sql("SELECT name, disjoin_start, disjoin_end FROM DISJOIN(features, reference := mask)")
    assert rows(other) == [("a", 0, 70), ("a", 90, 100), ("b", 60, 70), ("b", 90, 180), ("c", 10, 40)]
    sub = session.sql("SELECT name FROM DISJOIN(features, reference := (SELECT * FROM annotations WHERE chrom = 'chr2'))")
    assert rows(sub) == [("c",)]
    assert rows(session.sql("SELECT lo, hi, disjoin_start, disjoin_end FROM DISJOIN(closed) WHERE name = 'a'")) == [(1, 100, 1, 60), (1, 100, 61, 100)]


def test_nearest(session):
    alone = session.sql("SELECT name, distance FROM NEAREST(features, reference := 'chr1:200-210', k := 2)")
    assert rows(alone) == [("a", 101), ("b", 21)]
    lateral = session.sql("SELECT a.name, n.name AS other, n.distance FROM features a CROSS JOIN LATERAL NEAREST(annotations, reference := a.interval, signed := true) AS n")
    assert rows(lateral) == [("a", "g1", 0), ("b", "g1", -31), ("c", "g2", 0)]
    with pytest.raises(ValueError, match="not found"):
        session.sql("SELECT * FROM NEAREST(nothing, reference := 'chr1:1-2')")


def test_around_the_operators(session):
    assert rows(session.sql("SELECT name FROM features QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY start) = 1")) == [("a",), ("c",)]
    union = session.sql("WITH x AS (SELECT * FROM features WHERE interval INTERSECTS 'chr1:0-10') SELECT name FROM x UNION ALL SELECT name FROM mask WHERE interval CONTAINS 'chr2:99'")
    assert rows(union) == [("a",), ("m3",)]
    nested = session.sql("SELECT c, count(*) AS n FROM (SELECT CLUSTER(interval) AS c, chrom FROM features) GROUP BY c")
    assert rows(nested) == [(1, 3)]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("SELECT CLUSTER(interval), MERGE(interval) FROM features", "one SELECT"),
        ("SELECT CLUSTER(interval) AS a, CLUSTER(interval, 5) AS b FROM features", "Multiple CLUSTER"),
        ("SELECT CLUSTER(interval) + 1 FROM features a", "item of the SELECT list"),
        ("SELECT CLUSTER(a.interval) FROM features a JOIN mask b ON a.chrom = b.chrom", "over a join"),
        ("SELECT *, MERGE(interval) FROM features", "star"),
        ("SELECT 1 + CLUSTER(interval) FROM features", "item of the SELECT list"),
        ("SELECT name FROM features a WHERE a.interval INTERSECTS b", "Could not parse genomic range"),
        ("SELECT * FROM DISJOIN(features, reference := nothing)", "not found"),
    ],
)
def test_errors(session, text, message):
    with pytest.raises(Exception, match=message):
        session.sql(text).collect()


def test_tokens_pass_through(session):
    got = session.sql("SELECT 1.5e1 AS a, .5 AS b, 1 == 1 AS c, NULL <=> NULL AS d, transform(array(1, 2), x -> x + 1) AS e, 8 % 3 AS f, 2L AS g, 'it''s' AS h, 1e-2D AS i").first()
    assert (float(got.a), float(got.b), got.c, got.d, got.e, got.f, got.g, got.i) == (15.0, 0.5, True, True, [2, 3], 2, 2, 0.01)
    assert rows(session.sql("SELECT f.* EXCEPT (name, strand) FROM features f WHERE f.interval INTERSECTS 'chr2:0-100' AND start < 1e5")) == [("chr2", 10, 40)]
    assert rows(session.sql("SELECT name FROM features EXCEPT SELECT name FROM features WHERE interval INTERSECTS 'chr1:0-50'")) == [("b",), ("c",)]
    assert session.sql("SELECT name FROM features MINUS (SELECT name FROM features)").count() == 0
    assert rows(session.sql("SELECT name FROM features WHERE strand IS NOT DISTINCT FROM '-' AND start BETWEEN 1 AND 90")) == [("b",)]


def test_distinct_on_and_cte_columns(session):
    got = session.sql("SELECT DISTINCT ON (chrom) chrom, name FROM features ORDER BY chrom, start DESC")
    assert [tuple(r) for r in got.collect()] == [("chr1", "b"), ("chr2", "c")]
    got = session.sql("WITH f(c, n) AS (SELECT chrom, name FROM features) SELECT n FROM f WHERE c = 'chr2'")
    assert rows(got) == [("c",)]
    got = session.sql("SELECT f.name FROM features f QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY start) = 1 ORDER BY f.start DESC LIMIT 1")
    assert rows(got) == [("c",)]


def test_cluster_beside_distinct_and_named_windows(session):
    assert rows(session.sql("SELECT DISTINCT chrom, CLUSTER(interval) AS id FROM features")) == [("chr1", 1), ("chr2", 1)]
    got = session.sql("SELECT name, CLUSTER(interval) AS id, row_number() OVER w AS n FROM features WINDOW w AS (PARTITION BY chrom ORDER BY start)")
    assert rows(got) == [("a", 1, 1), ("b", 1, 2), ("c", 1, 1)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT a.name, b.name FROM features a, mask b WHERE a.interval INTERSECTS b.interval", "am1 am2 bm1 bm2 cm3"),
        ("SELECT a.name, b.name FROM features a JOIN mask b ON b.interval CONTAINS a.interval AND a.start > 0", "cm3"),
        ("SELECT a.name, b.name FROM features a JOIN mask b ON a.interval WITHIN b.interval", "cm3"),
        ("SELECT a.name, b.name FROM features a LEFT JOIN mask b ON a.interval INTERSECTS b.interval AND b.name <> 'm1'", "am2 bm2 cm3"),
        ("SELECT a.name, b.name FROM features a RIGHT JOIN mask b ON a.interval INTERSECTS b.interval AND a.name = 'c'", "-m1 -m2 cm3"),
        ("SELECT a.name, b.name FROM features a FULL JOIN annotations b ON a.interval INTERSECTS b.interval", "ag1 b- cg2"),
        ("SELECT a.name, b.name FROM features a JOIN features b ON a.interval INTERSECTS b.interval WHERE a.name < b.name", "ab"),
        ("SELECT a.name, c.name FROM features a JOIN mask b ON a.interval INTERSECTS b.interval JOIN annotations c ON b.interval INTERSECTS c.interval", "ag1 bg1 cg2"),
        ("SELECT a.name, b.name FROM features a LEFT JOIN mask b ON a.strand = b.strand AND a.chrom = b.chrom WHERE a.interval INTERSECTS b.interval", "am1 am2"),
        ("SELECT a.name, '' FROM features a LEFT SEMI JOIN mask b ON a.interval INTERSECTS b.interval AND b.strand = '-'", "c"),
        ("SELECT a.name, '' FROM features a WHERE EXISTS (SELECT 1 FROM mask b WHERE a.interval INTERSECTS b.interval AND b.name = 'm2')", "a b"),
        ("SELECT a.name, '' FROM features a WHERE a.interval INTERSECTS ANY (SELECT interval FROM mask WHERE name = 'm1') OR a.name = 'c'", "a b c"),
        ("SELECT a.name, '' FROM features a WHERE NOT a.interval INTERSECTS ANY (SELECT m.interval FROM mask m WHERE m.name = 'm1')", "c"),
        ("SELECT a.name, b.name FROM (SELECT * FROM features WHERE strand = '+') a JOIN mask b ON a.interval INTERSECTS b.interval", "am1 am2 cm3"),
        ("SELECT a.name, b.name FROM features a JOIN mask b ON a.interval INTERSECTS b.interval OR a.name = 'never'", "am1 am2 bm1 bm2 cm3"),
    ],
)
def test_predicates_between_relations(session, text, expected):
    got = {"".join("-" if v is None else v for v in r) for r in session.sql(text).collect()}
    assert got == set(expected.split())


def test_joins_are_equi_joins_and_stars_hide_their_keys(session):
    text = session.to_spark_sql("SELECT * FROM features a JOIN mask b ON a.interval INTERSECTS b.interval")
    assert "<" not in text and "`a`.`chrom` = `_chrom_" in text
    assert session.spark.sql(text).columns == ["chrom", "start", "end", "name", "strand"] * 2
    assert session.sql("SELECT b.*, a.name AS other FROM features a JOIN mask b ON a.interval INTERSECTS b.interval").columns == ["chrom", "start", "end", "name", "strand", "other"]


def test_nearest_among_other_relations(session):
    text = """SELECT a.name, n.name AS near, n.distance, g.name AS gene FROM features a JOIN mask m ON a.interval INTERSECTS m.interval AND m.name = 'm1'
    CROSS JOIN LATERAL NEAREST(annotations, reference := a.interval, k := 1) AS n LEFT JOIN annotations g ON a.interval INTERSECTS g.interval ORDER BY a.name"""
    assert rows(session.sql(text)) == [("a", "g1", 0, "g1"), ("b", "g1", 31, None)]
    star = session.sql("SELECT * FROM features a, LATERAL NEAREST(annotations, reference := a.interval) n")
    assert star.columns == ["chrom", "start", "end", "name", "strand"] * 2 + ["distance"]
    left = session.sql("SELECT a.name, n.name AS near FROM features a LEFT JOIN LATERAL NEAREST(annotations, reference := a.interval, max_distance := 5) n ON true")
    assert sorted((r.name, r.near or "") for r in left.collect()) == [("a", "g1"), ("b", ""), ("c", "g2")]


def test_views_are_dropped(spark, small):
    own = IntervalSession(spark)
    own.register("features", small["features"])
    own.sql("SELECT CLUSTER(interval) FROM features")
    names = list(own._made)
    own.close()
    assert names and not {t.name for t in spark.catalog.listTables()} & set(names)
