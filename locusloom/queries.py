"""One query per operator shape over the fixtures, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom import fixtures
from locusloom.functions import fraction_overlap, overlap_bp
from locusloom.operators import all_of, any_of, cluster, contains, count_overlaps, disjoin, distance, intersects, merge, nearest, nearest_to, overlap_join, within, within_distance_join
from locusloom.schema import Interval, IntervalSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_COLUMNS = ("chrom", "start", "end", "name", "score", "strand")
_OWN = ", ".join(f'"{c}"' for c in _COLUMNS)
_OVERLAP = 'a.chrom = b.chrom AND a."start" < b."end" AND a."end" > b."start"'
#: The literal that the range queries ask for.
_RANGE, _START, _END = "chr1:10000-20000", 10000, 20000


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{fixtures.WITH}{sql.replace('RECURSIVE', '')}"
        return f

    return register


def _pair(joined: DataFrame, *more) -> DataFrame:
    """Both sides' positions and names."""
    return joined.select(F.col("a.chrom").alias("chrom"), F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.col("a.name").alias("a_name"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"), F.col("b.name").alias("b_name"), *more)


_PAIR = 'a.chrom AS chrom, a."start" AS a_start, a."end" AS a_end, a.name AS a_name, b."start" AS b_start, b."end" AS b_end, b.name AS b_name'


def _a() -> Interval:
    return Interval.of(alias="a")


def _b() -> Interval:
    return Interval.of(alias="b")


def _literal(name: str, test: Callable, where: str) -> None:
    _query(name, f" SELECT {_OWN} FROM features WHERE {where}")(lambda s, d: fixtures.features(s, d).where(test(Interval.of())))


_literal("intersects_literal", lambda i: intersects(i, _RANGE), f"chrom = 'chr1' AND \"start\" < {_END} AND \"end\" > {_START}")
_literal("contains_point", lambda i: contains(i, "chr2:1088"), "chrom = 'chr2' AND \"start\" <= 1088 AND \"end\" > 1088")
_literal("contains_range", lambda i: contains(i, "chr2:[1085,1089]"), "chrom = 'chr2' AND \"start\" <= 1085 AND \"end\" >= 1090")
_literal("within_literal", lambda i: within(i, _RANGE), f"chrom = 'chr1' AND \"start\" >= {_START} AND \"end\" <= {_END}")
_literal("not_intersects", lambda i: ~intersects(i, _RANGE), f"NOT (chrom = 'chr1' AND \"start\" < {_END} AND \"end\" > {_START})")
_literal("intersects_any", lambda i: any_of(intersects, i, [_RANGE, "chr3:5000-9000"]), f"(chrom = 'chr1' AND \"start\" < {_END} AND \"end\" > {_START}) OR (chrom = 'chr3' AND \"start\" < 9000 AND \"end\" > 5000)")
_literal("intersects_all", lambda i: all_of(intersects, i, [_RANGE, "chr1:[19000,30000)"]), f"chrom = 'chr1' AND \"start\" < {_END} AND \"end\" > {_START} AND \"start\" < 30000 AND \"end\" > 19000")

_CODES = {"0c": ("0based", "closed", 0, 1), "1h": ("1based", "half_open", -1, -1), "1c": ("1based", "closed", -1, 0)}
for _code, (_system, _kind, _ds, _de) in _CODES.items():
    # The fixture as it would be stored in another encoding gives the same rows.
    def _encoded(s, d, system=_system, kind=_kind, ds=_ds, de=_de):
        stored = fixtures.features(s, d).withColumns({"start": F.col("start") - ds, "end": F.col("end") - de})
        return stored.where(intersects(Interval.of(IntervalSchema(coordinate_system=system, interval_type=kind)), _RANGE))

    _query(f"intersects_encoding_{_code}", f' SELECT chrom, "start" - ({_ds}) AS "start", "end" - ({_de}) AS "end", name, score, strand FROM features WHERE chrom = \'chr1\' AND "start" < {_END} AND "end" > {_START}')(_encoded)

for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    for _strategy in ("plain", "binned"):
        _query(f"overlap_{_how}_{_strategy}", f" SELECT {_PAIR.replace('a.chrom AS chrom', 'a.chrom AS chrom, b.chrom AS b_chrom')} FROM peaks a {_join} features b ON {_OVERLAP}")(lambda s, d, how=_how, strategy=_strategy: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d), how=how, strategy=strategy), F.col("b.chrom").alias("b_chrom")))
for _how, _exists in (("semi", "EXISTS"), ("anti", "NOT EXISTS")):
    for _strategy in ("plain", "binned"):
        _query(f"overlap_{_how}_{_strategy}", f" SELECT {_OWN} FROM peaks a WHERE {_exists} (SELECT 1 FROM features b WHERE {_OVERLAP})")(lambda s, d, how=_how, strategy=_strategy: overlap_join(fixtures.peaks(s, d), fixtures.features(s, d), how=how, strategy=strategy).select(*_COLUMNS))

_query("join_contains", f' SELECT {_PAIR} FROM features a JOIN peaks b ON a.chrom = b.chrom AND a."start" <= b."start" AND a."end" >= b."end"')(lambda s, d: _pair(overlap_join(fixtures.features(s, d), fixtures.peaks(s, d), predicate=contains)))
_query("join_within", f' SELECT {_PAIR} FROM features a JOIN peaks b ON a.chrom = b.chrom AND a."start" >= b."start" AND a."end" <= b."end"')(lambda s, d: _pair(overlap_join(fixtures.features(s, d), fixtures.peaks(s, d), predicate=within)))
_query("overlap_same_strand", f" SELECT {_PAIR} FROM peaks a JOIN features b ON {_OVERLAP} AND a.strand = b.strand")(lambda s, d: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d), on=F.col("a.strand") == F.col("b.strand"))))
_query("overlap_opposite_strand", f" SELECT {_PAIR} FROM peaks a JOIN features b ON {_OVERLAP} AND a.strand <> b.strand AND a.strand IN ('+', '-') AND b.strand IN ('+', '-')")(lambda s, d: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d), on=(F.col("a.strand") != F.col("b.strand")) & F.col("a.strand").isin("+", "-") & F.col("b.strand").isin("+", "-"))))
_BP = 'least(a."end", b."end") - greatest(a."start", b."start")'
_query("overlap_bp", f" SELECT {_PAIR}, {_BP} AS bp FROM peaks a JOIN features b ON {_OVERLAP}")(lambda s, d: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d)), overlap_bp(_a(), _b()).alias("bp")))
_query("overlap_bp_all", f" SELECT {_PAIR}, CASE WHEN b.chrom IS NULL THEN 0 ELSE {_BP} END AS bp FROM peaks a LEFT JOIN features b ON {_OVERLAP}")(lambda s, d: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d), how="left"), overlap_bp(_a(), _b()).alias("bp")))
_query("overlap_fraction", f' SELECT {_PAIR} FROM peaks a JOIN features b ON {_OVERLAP} WHERE 2 * ({_BP}) >= a."end" - a."start"')(lambda s, d: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d)).where(fraction_overlap(_a(), _b()) >= 0.5)))
_query("overlap_reciprocal", f' SELECT {_PAIR} FROM peaks a JOIN features b ON {_OVERLAP} WHERE 2 * ({_BP}) >= a."end" - a."start" AND 2 * ({_BP}) >= b."end" - b."start"')(lambda s, d: _pair(overlap_join(fixtures.peaks(s, d), fixtures.features(s, d)).where((fraction_overlap(_a(), _b()) >= 0.5) & (fraction_overlap(_b(), _a()) >= 0.5))))
for _strategy in ("plain", "binned"):
    _query(f"count_overlaps_{_strategy}", f" SELECT a.chrom, a.\"start\", a.\"end\", a.name, count(b.chrom) AS n_overlaps FROM peaks a LEFT JOIN features b ON {_OVERLAP} GROUP BY 1, 2, 3, 4")(lambda s, d, strategy=_strategy: count_overlaps(fixtures.peaks(s, d), fixtures.features(s, d), keys=["chrom", "start", "end", "name"], strategy=strategy))

_AFTER, _BEFORE = 'b."start" - a."end" + 1', 'a."start" - b."end" + 1'


def _distance_sql(stranded: bool, signed: bool) -> str:
    flip = "* CASE WHEN a.strand = '-' THEN -1 ELSE 1 END" if stranded else ""
    unknown = "WHEN a.strand IS NULL OR b.strand IS NULL OR a.strand IN ('.', '?') OR b.strand IN ('.', '?') THEN NULL" if stranded else ""
    return f'CASE WHEN a.chrom <> b.chrom THEN NULL {unknown} WHEN a."start" < b."end" AND a."end" > b."start" THEN 0 WHEN a."end" <= b."start" THEN ({_AFTER}) {flip} ELSE {"-" if signed else ""}({_BEFORE}) {flip} END'


for _stranded in (False, True):
    for _signed in (False, True):
        _name = "distance" + "_stranded" * _stranded + "_signed" * _signed
        _query(_name, f" SELECT a.name AS a_name, b.name AS b_name, a.chrom AS a_chrom, b.chrom AS b_chrom, {_distance_sql(_stranded, _signed)} AS distance FROM peaks a JOIN features b ON a.name = b.name // 10")(lambda s, d, stranded=_stranded, signed=_signed: fixtures.peaks(s, d).alias("a").join(fixtures.features(s, d).alias("b"), F.col("a.name") == F.floor(F.col("b.name") / 10)).select(F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"), F.col("a.chrom").alias("a_chrom"), F.col("b.chrom").alias("b_chrom"), distance(_a(), _b(), stranded=stranded, signed=signed).alias("distance")))
_query("distance_join", f" SELECT {_PAIR}, {_distance_sql(False, False)} AS distance FROM peaks a JOIN features b ON a.chrom = b.chrom AND {_distance_sql(False, False)} <= 100")(lambda s, d: _pair(within_distance_join(fixtures.peaks(s, d), fixtures.features(s, d), 100), "distance"))


def _cluster_sql(distance_: int, stranded: bool, table: str = "features", predicate: str = "") -> str:
    part = "PARTITION BY chrom" + ", strand" * stranded
    return f""", edged AS (SELECT *, max("end") OVER ({part} ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM {table}),
    flagged AS (SELECT *, CASE WHEN edge + {distance_} >= "start" {predicate} THEN 0 ELSE 1 END AS flag FROM edged),
    clustered AS (SELECT *, CAST(sum(flag) OVER ({part} ORDER BY "start") AS BIGINT) AS cluster FROM flagged)"""


for _name, _d, _stranded in (("plain", 0, False), ("distance", 25, False), ("stranded", 0, True)):
    _query(f"cluster_{_name}", f"{_cluster_sql(_d, _stranded)} SELECT {_OWN}, cluster FROM clustered")(lambda s, d, dist=_d, stranded=_stranded: cluster(fixtures.features(s, d), distance=dist, stranded=stranded))
    _query(f"merge_{_name}", f"{_cluster_sql(_d, _stranded)} SELECT chrom, {'strand, ' * _stranded}min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n FROM clustered GROUP BY chrom, {'strand, ' * _stranded}cluster")(lambda s, d, dist=_d, stranded=_stranded: merge(fixtures.features(s, d), F.count(F.lit(1)).alias("n"), distance=dist, stranded=stranded))

# Peaks merged first have no ties, so the predecessor is definite.
_MERGED = _cluster_sql(0, False, "peaks").replace("edged", "e0").replace("flagged", "f0").replace("clustered", "c0") + ', spans AS (SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n FROM c0 GROUP BY chrom, cluster)'
_PREV = _cluster_sql(300, False, "spans").replace('max("end")', 'lag(n) OVER (PARTITION BY chrom ORDER BY "start") AS before, max("end")').replace('>= "start" ', '>= "start" AND n = before ')
_query("cluster_predicate", f'{_MERGED}{_PREV} SELECT chrom, "start", "end", n, cluster FROM clustered')(lambda s, d: cluster(merge(fixtures.peaks(s, d), F.count(F.lit(1)).alias("n")), distance=300, predicate=lambda prev: F.col("n") == prev("n")))
_query("merge_predicate", f'{_MERGED}{_PREV} SELECT chrom, min("start") AS "start", max("end") AS "end", CAST(sum(n) AS BIGINT) AS total FROM clustered GROUP BY chrom, cluster')(lambda s, d: merge(merge(fixtures.peaks(s, d), F.count(F.lit(1)).alias("n")), F.sum("n").alias("total"), distance=300, predicate=lambda prev: F.col("n") == prev("n")))
_query("merge_aggregates", f'{_cluster_sql(0, False)} SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n, CAST(sum(score) AS BIGINT) AS total, min(score) AS least, string_agg(CAST(name AS VARCHAR), \',\' ORDER BY CAST(name AS VARCHAR)) AS names FROM clustered GROUP BY chrom, cluster')(lambda s, d: merge(fixtures.features(s, d), F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.min("score").alias("least"), F.array_join(F.array_sort(F.collect_list(F.col("name").cast("string"))), ",").alias("names")))


def _disjoin_sql(target: str, reference: str | None) -> str:
    covered = f' AND EXISTS (SELECT 1 FROM {reference} r WHERE r.chrom = s.chrom AND r."start" <= s.p AND r."end" > s.p)' if reference else ""
    return f""", keys AS (SELECT DISTINCT chrom, "start", "end" FROM {target}),
    points AS (SELECT chrom, "start" AS p FROM {reference or target} UNION SELECT chrom, "end" FROM {reference or target}),
    cuts AS (SELECT k.chrom, k."start", k."end", q.p FROM keys k JOIN points q ON q.chrom = k.chrom AND q.p > k."start" AND q.p < k."end" UNION SELECT chrom, "start", "end", "start" FROM keys UNION SELECT chrom, "start", "end", "end" FROM keys),
    segments AS (SELECT *, lead(p) OVER (PARTITION BY chrom, "start", "end" ORDER BY p) AS q FROM cuts)
    SELECT t.chrom, t."start", t."end", t.name, t.score, t.strand, s.chrom AS disjoin_chrom, s.p AS disjoin_start, s.q AS disjoin_end FROM {target} t JOIN segments s ON t.chrom = s.chrom AND t."start" = s."start" AND t."end" = s."end" WHERE s.q > s.p{covered}"""


_query("disjoin_self", _disjoin_sql("peaks", None))(lambda s, d: disjoin(fixtures.peaks(s, d)))
_query("disjoin_reference", _disjoin_sql("peaks", "features"))(lambda s, d: disjoin(fixtures.peaks(s, d), fixtures.features(s, d)))
_query("disjoin_depth", _disjoin_sql("peaks", None).replace("SELECT t.chrom", ", parts AS (SELECT t.chrom") + ") SELECT disjoin_chrom, disjoin_start, disjoin_end, count(*) AS depth FROM parts GROUP BY 1, 2, 3")(lambda s, d: disjoin(fixtures.peaks(s, d)).groupBy("disjoin_chrom", "disjoin_start", "disjoin_end").agg(F.count(F.lit(1)).alias("depth")))


def _nearest_sql(k: int, most: int | None, stranded: bool, signed: bool) -> str:
    d = _distance_sql(stranded, signed)
    return f""", ranked AS (SELECT a.name AS a_name, a.chrom AS chrom, b."start" AS b_start, b."end" AS b_end, {d} AS distance, row_number() OVER (PARTITION BY a.name ORDER BY abs({d}), b."start", b."end") AS r
      FROM peaks a JOIN features b ON a.chrom = b.chrom {'AND a.strand = b.strand' if stranded else ''} {f'WHERE abs({d}) <= {most}' if most is not None else ''})
    SELECT a_name, chrom, b_start, b_end, distance FROM ranked WHERE r <= {k}"""


def _nearest(name: str, k: int, most: int | None, stranded: bool, signed: bool) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = nearest(fixtures.peaks(s, d), fixtures.features(s, d), k=k, max_distance=most, stranded=stranded, signed=signed)
        return found.select(F.col("a.name").alias("a_name"), F.col("a.chrom").alias("chrom"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"), "distance")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {fixtures.WITH}{_nearest_sql(k, most, stranded, signed)}"


_nearest("nearest", 1, None, False, False)
_nearest("nearest_k", 3, None, False, False)
_nearest("nearest_max_distance", 5, 60, False, True)
_nearest("nearest_stranded_signed", 2, None, True, True)
_query("nearest_literal", f""" SELECT chrom, "start", "end", name, CASE WHEN "start" < {_END} AND "end" > {_START} THEN 0 WHEN {_END} <= "start" THEN "start" - {_END} + 1 ELSE {_START} - "end" + 1 END AS distance
    FROM features WHERE chrom = 'chr4' ORDER BY 5, "start", "end", name LIMIT 5""")(lambda s, d: nearest_to(fixtures.features(s, d), f"chr4:{_START}-{_END}", k=5).select("chrom", "start", "end", "name", "distance"))
