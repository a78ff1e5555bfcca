"""Queries in the dialect over the fixtures, through IntervalSession.sql, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusloom import fixtures
from locusloom.queries import _OVERLAP, _cluster_sql, _distance_sql, _nearest_sql
from locusloom.session import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, text: str, oracle: str, ctes: str = "") -> None:
    """text: the dialect. oracle: a SELECT for DuckDB over peaks, features and further common table expressions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, peaks=fixtures.peaks(spark, sf_dir), features=fixtures.features(spark, sf_dir)).sql(text)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {fixtures.WITH}{ctes} {oracle}"


def _columns(alias: str, prefix: str = "") -> str:
    return ", ".join(f'{alias}."{c}" AS {prefix}{c}' if prefix else f'{alias}."{c}"' for c in ("chrom", "start", "end", "name", "score", "strand"))


_ON = "a.interval INTERSECTS b.interval"
_BP = 'least(a."end", b."end") - greatest(a."start", b."start")'
_NAMES = "a.name AS a_name, b.name AS b_name"
_A, _AB = _columns("a"), f"{_columns('a', 'a_')}, {_columns('b', 'b_')}"
_LEFT = f"FROM peaks a LEFT JOIN features b ON {_OVERLAP}"
_INNER = f"FROM peaks a JOIN features b ON {_OVERLAP}"

# bedtools intersect
_query("bedtools_intersect", f"SELECT DISTINCT a.* FROM peaks a, features b WHERE {_ON}", f"SELECT DISTINCT {_A} {_INNER}")
_query("bedtools_intersect_wa", f"SELECT a.* FROM peaks a, features b WHERE {_ON}", f"SELECT {_A} {_INNER}")
_query("bedtools_intersect_wb", f"SELECT b.* FROM peaks a, features b WHERE {_ON}", f"SELECT {_columns('b')} {_INNER}")
_query("bedtools_intersect_wa_wb", f"SELECT {_AB} FROM peaks a, features b WHERE {_ON}", f"SELECT {_AB} {_INNER}")
_query("bedtools_intersect_v", f"SELECT a.* FROM peaks a LEFT JOIN features b ON {_ON} WHERE b.chrom IS NULL", f"SELECT {_A} {_LEFT} WHERE b.chrom IS NULL")
_query("bedtools_intersect_u", f"SELECT DISTINCT a.* FROM peaks a JOIN features b ON {_ON}", f"SELECT DISTINCT {_A} {_INNER}")
_query("bedtools_intersect_c", f'SELECT {_A}, COUNT(b.name) AS n FROM peaks a LEFT JOIN features b ON {_ON} GROUP BY {_A}', f"SELECT {_A}, COUNT(b.name) AS n {_LEFT} GROUP BY {_A}")
_query("bedtools_intersect_wo", f"SELECT {_AB}, {_BP} AS bp FROM peaks a JOIN features b ON {_ON}", f"SELECT {_AB}, {_BP} AS bp {_INNER}")
_query("bedtools_intersect_wao", f"SELECT {_AB}, CASE WHEN b.chrom IS NULL THEN 0 ELSE {_BP} END AS bp FROM peaks a LEFT JOIN features b ON {_ON}", f"SELECT {_AB}, CASE WHEN b.chrom IS NULL THEN 0 ELSE {_BP} END AS bp {_LEFT}")
_query("bedtools_intersect_loj", f"SELECT {_AB} FROM peaks a LEFT JOIN features b ON {_ON}", f"SELECT {_AB} {_LEFT}")
_query("bedtools_intersect_s", f"SELECT {_NAMES} FROM peaks a JOIN features b ON {_ON} AND a.strand = b.strand", f"SELECT {_NAMES} {_INNER} AND a.strand = b.strand")
_OPPOSITE = "a.strand <> b.strand AND a.strand IN ('+', '-') AND b.strand IN ('+', '-')"
_query("bedtools_intersect_S", f"SELECT {_NAMES} FROM peaks a, features b WHERE {_ON} AND {_OPPOSITE}", f"SELECT {_NAMES} {_INNER} AND {_OPPOSITE}")
_HALF, _BOTH = f'2 * ({_BP}) >= a."end" - a."start"', f'2 * ({_BP}) >= a."end" - a."start" AND 2 * ({_BP}) >= b."end" - b."start"'
_query("bedtools_intersect_f", f"SELECT {_NAMES} FROM peaks a, features b WHERE {_ON} AND {_HALF}", f"SELECT {_NAMES} {_INNER} AND {_HALF}")
_query("bedtools_intersect_f_r", f"SELECT {_NAMES} FROM peaks a, features b WHERE {_ON} AND {_BOTH}", f"SELECT {_NAMES} {_INNER} AND {_BOTH}")
# bedtools closest, cluster, merge
_FOUND = 'a.name AS a_name, a.chrom, n."start" AS b_start, n."end" AS b_end, n.distance'
_query("bedtools_closest_k", f"SELECT {_FOUND} FROM peaks a CROSS JOIN LATERAL NEAREST(features, reference := a.interval, k := 3) AS n", "SELECT a_name, chrom, b_start, b_end, distance FROM ranked WHERE r <= 3", _nearest_sql(3, None, False, False).rsplit("SELECT a_name", 1)[0])
_query("bedtools_closest_d", "SELECT a.name AS a_name, b.name AS b_name, DISTANCE(a.interval, b.interval) AS distance FROM peaks a JOIN features b ON a.name = b.name DIV 10", f"SELECT {_NAMES}, {_distance_sql(False, False)} AS distance FROM peaks a JOIN features b ON a.name = b.name // 10")
_query("bedtools_closest_s_k", f"SELECT {_FOUND} FROM peaks a CROSS JOIN LATERAL NEAREST(features, reference := a.interval, k := 2, stranded := true) AS n", "SELECT a_name, chrom, b_start, b_end, distance FROM ranked WHERE r <= 2", _nearest_sql(2, None, True, False).rsplit("SELECT a_name", 1)[0])
_MERGED = 'chrom, min("start") AS "start", max("end") AS "end"'
for _name, _call, _d, _stranded in (("", "interval", 0, False), ("_d", "interval, 25", 25, False), ("_s", "interval, stranded := true", 0, True)):
    _ctes, _key = _cluster_sql(_d, _stranded), "strand, " * _stranded
    _query(f"bedtools_cluster{_name}", f"SELECT *, CLUSTER({_call}) AS cluster FROM features", f"SELECT {_columns('clustered')}, cluster FROM clustered", _ctes)
    _query(f"bedtools_merge{_name}", f"SELECT MERGE({_call}) FROM features", f"SELECT {_key}{_MERGED} FROM clustered GROUP BY chrom, {_key}cluster", _ctes)
_CLUSTERED = _cluster_sql(0, False)
for _name, _spark, _duck in (
    ("count", "COUNT(*) AS n", "COUNT(*) AS n"),
    ("mean", "round(AVG(score), 6) AS mean", "round(AVG(score), 6) AS mean"),
    ("collapse", "array_join(array_sort(collect_list(CAST(name AS STRING))), ',') AS names", "string_agg(CAST(name AS VARCHAR), ',' ORDER BY CAST(name AS VARCHAR)) AS names"),
):
    _query(f"bedtools_merge_c_{_name}", f"SELECT MERGE(interval), {_spark} FROM features", f"SELECT {_MERGED}, {_duck} FROM clustered GROUP BY chrom, cluster", _CLUSTERED)

# Joins of every shape
_query("sql_join_contains", "SELECT a.name AS a_name, b.name AS b_name FROM features a JOIN peaks b ON a.interval CONTAINS b.interval", f'SELECT {_NAMES} FROM features a JOIN peaks b ON a.chrom = b.chrom AND a."start" <= b."start" AND a."end" >= b."end"')
_query("sql_right_join", f"SELECT {_NAMES} FROM peaks a RIGHT JOIN features b ON a.name = b.name DIV 10 AND {_ON}", f"SELECT {_NAMES} FROM peaks a RIGHT JOIN features b ON a.name = b.name // 10 AND {_OVERLAP}")
_query("sql_outer_join_where", f"SELECT {_NAMES} FROM peaks a LEFT JOIN features b ON a.name = b.name DIV 10 WHERE {_ON}", f"SELECT {_NAMES} FROM peaks a LEFT JOIN features b ON a.name = b.name // 10 WHERE {_OVERLAP}")
_query("sql_exists", f"SELECT a.name FROM peaks a WHERE EXISTS (SELECT 1 FROM features b WHERE {_ON} AND b.strand = '-')", f"SELECT a.name FROM peaks a WHERE EXISTS (SELECT 1 FROM features b WHERE {_OVERLAP} AND b.strand = '-')")
_query("sql_not_exists", f"SELECT a.name FROM peaks a WHERE NOT EXISTS (SELECT 1 FROM features b WHERE {_ON})", f"SELECT a.name FROM peaks a WHERE NOT EXISTS (SELECT 1 FROM features b WHERE {_OVERLAP})")
_query("sql_semi_join", f"SELECT a.name FROM peaks a LEFT SEMI JOIN features b ON {_ON}", f"SELECT a.name FROM peaks a WHERE EXISTS (SELECT 1 FROM features b WHERE {_OVERLAP})")
_query("sql_self_join", f"SELECT {_NAMES} FROM peaks a JOIN peaks b ON {_ON} WHERE a.name < b.name", f"SELECT {_NAMES} FROM peaks a JOIN peaks b ON {_OVERLAP} WHERE a.name < b.name")
_query("sql_three_relations", f"SELECT {_NAMES}, c.name AS c_name FROM peaks a JOIN features b ON {_ON} JOIN peaks c ON b.interval INTERSECTS c.interval AND c.strand = '+'", f"SELECT a_name, b.b_name, c.name AS c_name FROM ab b JOIN peaks c ON {_OVERLAP.replace('b.', 'c.').replace('a.', 'b.')} AND c.strand = '+'", f', ab AS MATERIALIZED (SELECT {_NAMES}, b.chrom, b."start", b."end" {_INNER})')
_ONE = "chr1:20000-40000"
_IN_ONE = "chrom = 'chr1' AND \"start\" < 40000 AND \"end\" > 20000"
_query("sql_using", f"SELECT chrom, COUNT(*) AS n FROM peaks JOIN (SELECT DISTINCT chrom FROM features WHERE interval INTERSECTS '{_ONE}') d USING (chrom) GROUP BY chrom", f"SELECT chrom, COUNT(*) AS n FROM peaks JOIN (SELECT DISTINCT chrom FROM features WHERE {_IN_ONE}) d USING (chrom) GROUP BY chrom")
_query("sql_natural_join", "SELECT name, strand FROM peaks NATURAL JOIN (SELECT name, max(strand) AS strand FROM peaks GROUP BY name) d", "SELECT name, strand FROM peaks NATURAL JOIN (SELECT name, max(strand) AS strand FROM peaks GROUP BY name) d")
_query("sql_any_of_rows", f"SELECT a.name FROM peaks a WHERE a.interval INTERSECTS ANY (SELECT interval FROM features WHERE score > 900)", f"SELECT a.name FROM peaks a WHERE EXISTS (SELECT 1 FROM features b WHERE {_OVERLAP} AND b.score > 900)")
_query("sql_nearest_and_join", f"SELECT {_FOUND}, g.score AS next_score FROM peaks a CROSS JOIN LATERAL NEAREST(features, reference := a.interval, k := 1) AS n LEFT JOIN peaks g ON g.name = a.name + 1", "SELECT a_name, ranked.chrom, b_start, b_end, distance, g.score AS next_score FROM ranked LEFT JOIN peaks g ON g.name = a_name + 1 WHERE r <= 1", _nearest_sql(1, None, False, False).rsplit("SELECT a_name", 1)[0])
# CLUSTER, MERGE and DISJOIN among other clauses
_query("sql_cluster_distinct", "SELECT DISTINCT chrom, CLUSTER(interval) AS id FROM features", "SELECT DISTINCT chrom, cluster AS id FROM clustered", _CLUSTERED)
_query("sql_cluster_where", "SELECT name, CLUSTER(interval, 25) AS id FROM features WHERE score > 500", "SELECT name, cluster AS id FROM clustered", f", loud AS (SELECT * FROM features WHERE score > 500){_cluster_sql(25, False, 'loud')}")
_query("sql_cluster_window", "SELECT name, CLUSTER(interval) AS id, row_number() OVER w AS n FROM features WINDOW w AS (PARTITION BY chrom ORDER BY start, name)", 'SELECT name, cluster AS id, row_number() OVER (PARTITION BY chrom ORDER BY "start", name) AS n FROM clustered', _CLUSTERED)
_query("sql_merge_having", "SELECT MERGE(interval), COUNT(*) AS n, SUM(score) AS total FROM features HAVING COUNT(*) > 2", f"SELECT {_MERGED}, COUNT(*) AS n, CAST(SUM(score) AS BIGINT) AS total FROM clustered GROUP BY chrom, cluster HAVING COUNT(*) > 2", _CLUSTERED)
_query("sql_disjoin_subquery", "SELECT d.name, d.disjoin_start, d.disjoin_end FROM DISJOIN(peaks, reference := (SELECT * FROM features WHERE strand = '-')) AS d", """SELECT t.name, s.p AS disjoin_start, s.q AS disjoin_end FROM peaks t JOIN segments s ON t.chrom = s.chrom AND t."start" = s."start" AND t."end" = s."end" WHERE s.q > s.p AND EXISTS (SELECT 1 FROM minus r WHERE r.chrom = s.chrom AND r."start" <= s.p AND r."end" > s.p)""", """, minus AS (SELECT * FROM features WHERE strand = '-'), points AS (SELECT chrom, "start" AS p FROM minus UNION SELECT chrom, "end" FROM minus), keys AS (SELECT DISTINCT chrom, "start", "end" FROM peaks),
    cuts AS (SELECT k.chrom, k."start", k."end", q.p FROM keys k JOIN points q ON q.chrom = k.chrom AND q.p > k."start" AND q.p < k."end" UNION SELECT chrom, "start", "end", "start" FROM keys UNION SELECT chrom, "start", "end", "end" FROM keys),
    segments AS (SELECT *, lead(p) OVER (PARTITION BY chrom, "start", "end" ORDER BY p) AS q FROM cuts)""")
# Projection, expressions, literals
_query("sql_star_except", f"SELECT f.* EXCEPT (score, strand) FROM features f WHERE f.interval INTERSECTS '{_ONE}'", f'SELECT chrom, "start", "end", name FROM features WHERE {_IN_ONE}')
_query("sql_distinct_on", "SELECT DISTINCT ON (chrom, strand) chrom, strand, name FROM peaks ORDER BY chrom, strand, start DESC, name", 'SELECT DISTINCT ON (chrom, strand) chrom, strand, name FROM peaks ORDER BY chrom, strand, "start" DESC, name')
_query("sql_literals", "SELECT name, score * 1.5e1 AS x, name == 7 AS is_seven FROM features WHERE start < 1e4 AND NOT strand <=> '.'", "SELECT name, score * 1.5e1 AS x, name = 7 AS is_seven FROM features WHERE \"start\" < 1e4 AND strand IS DISTINCT FROM '.'")
_query("sql_cte_columns", "WITH t(c, n) AS (SELECT chrom, COUNT(*) FROM features GROUP BY chrom), u AS (SELECT max(n) AS most FROM t) SELECT c, n FROM t, u WHERE n = most", "SELECT c, n FROM t, u WHERE n = most", ", t(c, n) AS (SELECT chrom, COUNT(*) FROM features GROUP BY chrom), u AS (SELECT max(n) AS most FROM t)")
_query("sql_values", "SELECT v.label, COUNT(*) AS n FROM features f JOIN (VALUES ('chr1', 'one'), ('chr2', 'two')) AS v(chrom, label) ON f.chrom = v.chrom GROUP BY v.label", "SELECT v.label, COUNT(*) AS n FROM features f JOIN (VALUES ('chr1', 'one'), ('chr2', 'two')) AS v(chrom, label) ON f.chrom = v.chrom GROUP BY v.label")
_query("sql_quoted_names", 'SELECT "f"."name" AS "the name", f."start" + 1 AS "from" FROM features AS "f" WHERE "f".interval CONTAINS \'chr2:1088\'', 'SELECT f.name AS "the name", f."start" + 1 AS "from" FROM features f WHERE chrom = \'chr2\' AND "start" <= 1088 AND "end" > 1088')
_query("sql_scalars", f"SELECT upper(chrom) AS c, abs(start - end) AS l, coalesce(nullif(strand, '.'), '?') AS s, CASE WHEN score BETWEEN 100 AND 500 THEN 'mid' ELSE 'other' END AS k, concat(chrom, ':', CAST(name AS STRING)) AS id FROM features WHERE interval INTERSECTS '{_ONE}'", f"SELECT upper(chrom) AS c, abs(\"start\" - \"end\") AS l, coalesce(nullif(strand, '.'), '?') AS s, CASE WHEN score BETWEEN 100 AND 500 THEN 'mid' ELSE 'other' END AS k, concat(chrom, ':', CAST(name AS VARCHAR)) AS id FROM features WHERE {_IN_ONE}")
_query("sql_range_grid", "SELECT g.id AS bin, COUNT(f.name) AS n FROM range(0, 700000, 10000) AS g(id) LEFT JOIN features f ON f.start DIV 10000 * 10000 = g.id GROUP BY g.id", 'SELECT g.id AS bin, COUNT(f.name) AS n FROM range(0, 700000, 10000) AS g(id) LEFT JOIN features f ON f."start" // 10000 * 10000 = g.id GROUP BY g.id')
# Aggregates, windows, sets
_query("sql_string_agg", f"SELECT chrom, string_agg(CAST(name AS STRING), ',') WITHIN GROUP (ORDER BY name) AS names FROM features WHERE interval INTERSECTS '{_ONE}' GROUP BY chrom", f"SELECT chrom, string_agg(CAST(name AS VARCHAR), ',' ORDER BY name) AS names FROM features WHERE {_IN_ONE} GROUP BY chrom")
_query("sql_filter", "SELECT chrom, COUNT(*) FILTER (WHERE strand = '+') AS plus, SUM(score) FILTER (WHERE strand = '-') AS minus FROM features GROUP BY chrom HAVING COUNT(*) > 10", "SELECT chrom, COUNT(*) FILTER (WHERE strand = '+') AS plus, CAST(SUM(score) FILTER (WHERE strand = '-') AS BIGINT) AS minus FROM features GROUP BY chrom HAVING COUNT(*) > 10")
for _name, _groups in (("grouping_sets", "GROUPING SETS ((chrom), (strand), ())"), ("cube", "CUBE (chrom, strand)"), ("rollup", "ROLLUP (chrom, strand)")):
    _query(f"sql_{_name}", f"SELECT chrom, strand, COUNT(*) AS n FROM features GROUP BY {_groups}", f"SELECT chrom, strand, COUNT(*) AS n FROM features GROUP BY {_groups}")
_query("sql_window", "SELECT name, rank() OVER (PARTITION BY chrom ORDER BY score DESC) AS r, SUM(score) OVER (PARTITION BY strand ORDER BY start, name ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM peaks", 'SELECT name, rank() OVER (PARTITION BY chrom ORDER BY score DESC) AS r, CAST(SUM(score) OVER (PARTITION BY strand ORDER BY "start", name ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM peaks')
_query("sql_named_window", "SELECT name, lag(name) OVER w AS before FROM peaks WINDOW w AS (PARTITION BY chrom ORDER BY start, name)", 'SELECT name, lag(name) OVER w AS before FROM peaks WINDOW w AS (PARTITION BY chrom ORDER BY "start", name)')
_query("sql_qualify", "SELECT chrom, name FROM peaks QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY score DESC, name) <= 3 ORDER BY chrom, score DESC, name", "SELECT chrom, name FROM peaks QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY score DESC, name) <= 3")
_query("sql_order_limit_offset", "SELECT name FROM peaks WHERE interval WITHIN 'chr1:0-100000' ORDER BY start, name LIMIT 10 OFFSET 5", "SELECT name FROM peaks WHERE chrom = 'chr1' AND \"start\" >= 0 AND \"end\" <= 100000 ORDER BY \"start\", name LIMIT 10 OFFSET 5")
_query("sql_sets", f"SELECT chrom, strand FROM features WHERE interval INTERSECTS '{_ONE}' UNION SELECT chrom, strand FROM peaks EXCEPT SELECT 'chr1', '+' UNION ALL SELECT chrom, strand FROM peaks INTERSECT SELECT 'chr3', '-'", f"SELECT chrom, strand FROM features WHERE {_IN_ONE} UNION SELECT chrom, strand FROM peaks EXCEPT SELECT 'chr1', '+' UNION ALL SELECT chrom, strand FROM peaks INTERSECT SELECT 'chr3', '-'")
