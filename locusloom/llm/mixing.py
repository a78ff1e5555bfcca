"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Every document of it first gets the whole copies that are certain,
floor(target / words of the source). The words still missing are drawn without replacement with unequal inclusion
probabilities p = min(1, rate * weight), weight being the integer square root of the document's size, and the rate such
that the expected words are those missing. Documents are ranked by random odds divided by inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the sample is the longest prefix of that order that fits the missing words; so its
size in words is fixed, not only expected. Further rounds offer the room that is left to smaller documents, in the same
order. u comes from a hash of the key and a seed, so reruns agree.

`plan` needs one aggregate per (source, weight), as many rows as the root of the largest size, and per round one per (source, bucket of rank), with a window over the one
bucket of each source where the prefix ends; it never sorts a source as a whole. It gives one row per source, from which
`apply_plan` decides about each document by itself. That table has a row for each component of the mixture; it is held
by the driver.

Nulls and edges: a null text has size 0; a null source is a source, last in order; a null key hashes as the empty text.
Rows that agree in key and size rank alike and are taken or left together. A source without words has target 0 and
nothing is taken from it. No document gets more than `limit` copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import cut

LIMIT = 3
ROUNDS = 3
SEED = 20240607
#: Buckets of rank: the window of a round sees about this share of a source's rows.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, int], limit: int = LIMIT) -> dict[str | None, float]:
    """Shares all words by weight; a target stops at `limit` times its source, and the excess is shared again by weight."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - limit * sum(sizes[s] for s in capped)
        shared = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and rest * weights[s] > limit * sizes[s] * shared}
        if not over:
            return {s: float(limit * n) if s in capped else float(rest * weights[s]) / float(shared) for s, n in sizes.items()}
        capped |= over


@dataclass(frozen=True)
class Ranked:
    """Columns of a document's rank within its source, given the source's `rate`."""

    p: Column
    q: Column
    h: Column
    bucket: Column


def ranked(key: Column, size: Column, rate: Column, seed: int = SEED) -> Ranked:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))
    p = F.least(F.lit(1.0), rate * F.floor(F.sqrt(size.cast("double"))).cast("double"))
    q = F.when(p > 0, (u / (1 - u)) * ((1 - p) / p))
    return Ranked(p, q, h, F.floor(q / (1 + q) * BUCKETS).cast("int"))


def _rate(words: list[tuple[int, int]], missing: float) -> float:
    """The rate at which min(1, rate * weight) is expected to draw the missing words; words: (weight, words of that weight's documents)."""
    rest = sum(w * n for w, n in words)
    sure = 0
    for w, n in sorted(words, reverse=True):
        if w == 0 or rest == 0:
            break
        rate = float(missing - sure) / float(rest)
        if rate * w < 1:
            return rate
        sure, rest = sure + n, rest - w * n
    return 1.0


def plan(documents: DataFrame, weights, *, key: str = "doc_id", text: str = "text", source: str = "source", limit: int = LIMIT, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per source: source_size, target, whole (certain copies), rate, and the end of each round's prefix.

    weights: a function of the sources in order (by code point, null last) that gives each one's positive integer weight.
    """
    spark = documents.sparkSession
    sized = cut(documents.select(F.col(key).alias("k"), F.col(source).alias("s"), size_of(F.col(text)).alias("size")))
    found: dict[str | None, list[tuple[int, int]]] = {}
    for r in sized.groupBy("s", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long").alias("w")).agg(F.sum("size").alias("n")).collect():
        found.setdefault(r["s"], []).append((r["w"], r["n"]))
    order = sorted(found, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, n in found[s]) for s in order}
    goal = targets(sizes, dict(zip(order, weights(order), strict=True)), limit)
    rows = {}
    for s in order:
        whole = min(limit, int(goal[s] // sizes[s])) if sizes[s] else 0
        missing = goal[s] - float(whole * sizes[s])
        rows[s] = {"s": s, "source_size": sizes[s], "target": goal[s], "whole": whole, "rate": _rate(found[s], missing) if missing > 0 and whole < limit else 0.0, "ends": [], "room": missing if whole < limit else 0.0}
    for _ in range(rounds):
        _end(sized, rows, seed)
    schema = "s string, source_size long, target double, whole int, rate double, ends array<struct<room: double, bucket: int, q: double, h: string>>"
    return spark.createDataFrame([[r[c.split(" ")[0]] for c in ("s", "source_size", "target", "whole", "rate", "ends")] for r in rows.values()], schema)


def _taken(size: Column, rank: Ranked, ends: Column) -> Column:
    """Whether any round takes the document. ends: an array of structs (room, bucket, q, h), one for each round."""

    def inside(end: Column) -> Column:
        upto = (rank.bucket < end["bucket"]) | ((rank.bucket == end["bucket"]) & ((rank.q < end["q"]) | ((rank.q == end["q"]) & (rank.h <= end["h"]))))
        return (size.cast("double") <= end["room"]) & (end["bucket"].isNull() | F.coalesce(upto, F.lit(False)))

    return F.coalesce((size > 0) & rank.q.isNotNull() & F.exists(ends, inside), F.lit(False))


def _end(sized: DataFrame, rows: dict, seed: int) -> None:
    """One round: finds where the prefix that fits each source's room ends, and takes its words off the room."""
    if not any(r["room"] >= 1 for r in rows.values()):
        return
    held = "s string, rate double, room double, ends array<struct<room: double, bucket: int, q: double, h: string>>"
    state = sized.sparkSession.createDataFrame([(r["s"], r["rate"], r["room"], r["ends"]) for r in rows.values()], held)
    open_ = sized.join(state.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")))
    rank = ranked(F.col("k"), F.col("size"), F.col("rate"), seed)
    open_ = open_.withColumns({"q": rank.q, "h": rank.h})
    rank = Ranked(rank.p, F.col("q"), F.col("h"), F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))
    taken = _taken(F.col("size"), rank, F.col("ends"))
    offered = open_.where((F.col("size") > 0) & F.col("q").isNotNull() & (F.col("size") <= F.col("room")) & ~taken).withColumn("bucket", rank.bucket)
    sums: dict[str | None, list[tuple[int, int]]] = {}
    for r in offered.groupBy("s", "bucket").agg(F.sum("size").alias("n")).collect():  # at most BUCKETS rows a source
        sums.setdefault(r["s"], []).append((r["bucket"], r["n"]))
    edges = []
    for s, r in rows.items():
        before, r["_edge"] = 0, None
        for bucket, n in sorted(sums.get(s, [])):
            if before + n > r["room"]:
                r["_edge"] = bucket
                edges.append((s, bucket, before))
                break
            before += n
        r["_before"] = before
    ends = {}
    if edges:
        edge = sized.sparkSession.createDataFrame(edges, "s3 string, b3 int, before long")
        w = Window.partitionBy("s").orderBy("q", "h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = offered.join(edge, F.col("s").eqNullSafe(F.col("s3")) & (F.col("bucket") == F.col("b3"))).withColumn("upto", F.col("before") + F.sum("size").over(w)).where(F.col("upto") <= F.col("room"))
        ends = {r["s"]: r for r in last.groupBy("s").agg(F.max(F.struct("q", "h")).alias("end"), F.max("upto").alias("upto")).collect()}
    for s, r in rows.items():
        got = ends.get(s)
        r["ends"].append((r["room"], r["_edge"], got["end"]["q"] if got else None, got["end"]["h"] if got else None))
        r["room"] -= float(got["upto"] if got else r["_before"])


def apply_plan(documents: DataFrame, made: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, names: tuple[str, ...] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """The documents with size, source_size, target and copies (0 to the limit), under these or other names; columns of those names are replaced."""
    marked = documents.withColumn("_size", size_of(F.col(f"`{text}`"))).join(made.alias("_made"), F.col(f"`{source}`").eqNullSafe(F.col("_made.s")))
    rank = ranked(F.col(key), F.col("_size"), F.col("_made.rate"), seed)
    marked = marked.withColumns({"_q": rank.q, "_h": rank.h})
    rank = Ranked(rank.p, F.col("_q"), F.col("_h"), F.floor(F.col("_q") / (1 + F.col("_q")) * BUCKETS).cast("int"))
    more = _taken(F.col("_size"), rank, F.col("_made.ends"))
    added = F.col("_size"), F.col("_made.source_size"), F.col("_made.target"), F.col("_made.whole") + more.cast("int")
    return marked.select(*[documents[f"`{c}`"] for c in documents.columns if c not in names], *[c.alias(n) for c, n in zip(added, names, strict=True)])


def repeating(order: list) -> list[int]:
    """Weights 1, 2, 3, 1, 2, 3, ..."""
    return [i % 3 + 1 for i in range(len(order))]


def mix(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights=repeating) -> DataFrame:
    """The documents, each as many times as the mix takes it."""
    columns = {"key": key, "text": text, "source": source}
    marked = apply_plan(documents, plan(documents, weights, **columns), **columns, names=("_mix_size", "_mix_source", "_mix_target", "_mix_copies"))
    return marked.where("_mix_copies > 0").withColumn("_mix_copies", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"`{c}`") for c in documents.columns])


#: The same in SQL, over the whole table.
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, sum(n) OVER () AS total,
    coalesce(sum({LIMIT} * n) OVER (ORDER BY {LIMIT} * n / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY {LIMIT} * n / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM sources
), level AS (
  SELECT CAST(total - below AS BIGINT) AS rest, CAST(above AS BIGINT) AS shared FROM levels
  WHERE (total - below) * w <= {LIMIT} * n * above ORDER BY below, shared DESC LIMIT 1
), goals AS (
  SELECT source, n, w, CASE WHEN coalesce(rest * w > {LIMIT} * n * shared, true) THEN CAST({LIMIT} * n AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / CAST(shared AS DOUBLE) END AS target
  FROM sources LEFT JOIN level ON true
), parts AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(least({LIMIT}, floor(target / n)) AS BIGINT) END AS whole FROM goals
), lacks AS (
  SELECT *, CASE WHEN whole < {LIMIT} THEN target - CAST(whole * n AS DOUBLE) ELSE 0.0 END AS missing FROM parts
), grouped AS (
  SELECT source, size, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS m, CAST(count(*) AS BIGINT) AS c FROM sized WHERE size > 0 GROUP BY source, size
), steps AS (
  SELECT *, coalesce(sum(size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
    sum(m * size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM grouped
), rates AS (
  SELECT l.source, arg_max((l.missing - CAST(sure AS DOUBLE)) / CAST(rest AS DOUBLE), size) AS rate
  FROM lacks l JOIN steps s ON l.source IS NOT DISTINCT FROM s.source
  WHERE (l.missing - CAST(sure AS DOUBLE)) / CAST(rest AS DOUBLE) * m < 1 GROUP BY l.source
), drawn AS (
  SELECT d.doc_id, d.size, l.source, l.n, l.target, l.whole, l.missing,
    md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS h,
    least(1.0, CASE WHEN l.missing > 0 THEN coalesce(r.rate, 1.0) ELSE 0.0 END * floor(sqrt(CAST(d.size AS DOUBLE)))) AS p
  FROM sized d JOIN lacks l ON d.source IS NOT DISTINCT FROM l.source LEFT JOIN rates r ON r.source IS NOT DISTINCT FROM l.source
), odds AS (
  SELECT *, (CAST(('0x' || substr(h, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM drawn
), ranks AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM odds
), one AS (
  SELECT *, q IS NOT NULL AND size > 0 AND size <= missing AND sum(CASE WHEN q IS NOT NULL AND size > 0 AND size <= missing THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= missing AS t1 FROM ranks
), room1 AS (SELECT *, missing - CAST(sum(CASE WHEN t1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE) AS g1 FROM one
), two AS (
  SELECT *, NOT t1 AND q IS NOT NULL AND size > 0 AND size <= g1 AND sum(CASE WHEN NOT t1 AND q IS NOT NULL AND size > 0 AND size <= g1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= g1 AS t2 FROM room1
), room2 AS (SELECT *, g1 - CAST(sum(CASE WHEN t2 THEN size ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE) AS g2 FROM two
), three AS (
  SELECT *, NOT t1 AND NOT t2 AND q IS NOT NULL AND size > 0 AND size <= g2 AND sum(CASE WHEN NOT t1 AND NOT t2 AND q IS NOT NULL AND size > 0 AND size <= g2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= g2 AS t3 FROM room2
)
SELECT doc_id, size, n AS source_size, target, CAST(size * (whole + CAST(t1 OR t2 OR t3 AS BIGINT)) AS BIGINT) AS taken FROM three
"""
