"""Fixity audit of WARC archives by Merkle trees.

A record is the WARC response record of a page; archives are cut into volumes, in which records lie one after another. Leaves are
the SHA-256 of a record's offset, length, copies and own SHA-256, in order of offset; each node hashes the range of offsets it
covers and its at most FANOUT children in order. Above a volume's root come nodes over the volumes of a bucket of keys, then nodes
over buckets, up to the one root of the replica. `audit` compares the roots of two replicas and, level by level, only the
children of nodes that differ, so records are compared only in branches that hold a difference. The trees of both replicas
have the same shape and travel together, told apart by `side`.

Only digests, keys and lengths are shuffled, never the records' bytes. A volume holds the keys of one bucket of SPAN numbers; a bucket with
more than LIMIT records is split by hash of key and address, and a key and address with more than LIMIT records by hash of the
digest, too, so no volume depends on a key being rare. Equal records of one key and address are one leaf with a count.

Status of a record: `changed` (same key and address, and the same place among those that differ, other content), `missing` (only in
the first replica, or more copies of it there), `extra` (only, or more copies, in the second), `moved` (same content at another
offset, because of one of the others in its volume). copies_a and copies_b say how many copies a row is about.

Nulls and edges: null addresses and null pages are written as empty; records with null keys have bucket -1 and are audited like others. An empty
replica has no root and differs from any that holds records; two empty ones agree. Pages of any length are hashed where they are read.
Other columns pass unread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import cut, integer_key

SPAN, LIMIT, FANOUT = 1024, 4096, 16
_RECORD = ["bucket", "key", "url", "digest", "length", "copies"]


def record(key: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record."""
    body = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


@dataclass(frozen=True)
class Trees:
    """The trees of two replicas (side 1 and 2). leaves: (side, bucket, part, at, key, url, digest, length, copies, offset, hash). levels: names of the columns that, before `at`, tell a level's nodes apart, and nodes (side, ..., at, first, last, hash), from the leaves' parents to the root."""

    leaves: DataFrame
    levels: list[tuple[list[str], DataFrame]]

    def root(self, side: int) -> str | None:
        top = self.levels[-1][1].where(F.col("side") == side).collect()  # one row
        return top[0].hash if top else None


def manifest(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", span: int = SPAN) -> DataFrame:
    """(bucket, key, url, digest, length, copies) of the distinct records; the bytes are hashed where they are read."""
    raw = record(F.col(key), F.col(url), F.col(html))
    rows = pages.select(F.coalesce(F.floor(F.col(key) / span), F.lit(-1)).cast("long").alias("bucket"), integer_key(pages, key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), raw.alias("raw"))
    rows = rows.select("bucket", "key", "url", F.sha2("raw", 256).alias("digest"), F.octet_length("raw").cast("long").alias("length"))
    return rows.groupBy("bucket", "key", "url", "digest", "length").agg(F.count(F.lit(1)).alias("copies"))


def _parents(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Nodes over each FANOUT neighbours."""
    child = F.struct("at", "first", "last", "hash")
    group = nodes.groupBy("side", *by, F.floor(F.col("at") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))  # FANOUT children
    span = group.select("side", *by, F.col("up").alias("at"), F.col("c")[0]["first"].alias("first"), F.element_at("c", -1)["last"].alias("last"), F.transform("c", lambda x: x["hash"]).alias("hashes"))
    return span.withColumn("hash", F.sha2(F.concat_ws("|", F.col("first").cast("string"), F.col("last").cast("string"), F.array_join("hashes", "")), 256)).drop("hashes")


def _volumes(records: DataFrame, limit: int) -> DataFrame:
    """The records with `part`, the volume of their bucket, by the larger of the two replicas."""
    most = lambda by, name: records.groupBy("side", *by).agg(F.count(F.lit(1)).alias("n")).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.ceil(F.max("n") / limit).cast("int").alias(name))
    parts, hot = most(["bucket"], "parts"), most(["bucket", "key", "url"], "split").where("split > 1")
    of = records.join(parts, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    of = of.join(hot, (F.col("bucket") == F.col("_bucket")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("url") == F.col("_url")), "left")
    spot = F.when(F.col("split").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("digest"), F.col("split")))
    return of.select("side", *_RECORD, F.pmod(F.xxhash64("key", "url", spot), F.col("parts")).cast("long").alias("part"))


def plant(first: DataFrame, second: DataFrame, limit: int = LIMIT) -> Trees:
    """The trees of two manifests over the same volumes."""
    records = cut(first.select(F.lit(1).alias("side"), *_RECORD).union(second.select(F.lit(2).alias("side"), *_RECORD)))
    order = Window.partitionBy("side", "bucket", "part").orderBy(F.col("key").asc_nulls_first(), "url", "digest")
    bytes_ = F.col("length") * F.col("copies")
    leaves = _volumes(records, limit).withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    leaves = leaves.withColumn("offset", F.sum(bytes_).over(order.rowsBetween(Window.unboundedPreceding, 0)) - bytes_)
    leaves = cut(leaves.withColumn("hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("offset", "length", "copies")], "digest"), 256)))
    levels: list[tuple[list[str], DataFrame]] = []
    least = records.agg(F.min("bucket")).first()[0] or 0
    # Over the leaves of a volume, the volumes of a bucket, the buckets.
    now = leaves.select("side", "bucket", "part", "at", F.col("offset").alias("first"), (F.col("offset") + bytes_).alias("last"), "hash")
    for by, up in ((["bucket", "part"], F.col("part")), (["bucket"], F.col("bucket") - F.lit(least)), ([], None)):
        while True:
            now = cut(_parents(now, by))
            levels.append((by, now))
            if not now.where("at > 0").limit(1).count():
                break
        if up is not None:
            now = now.select("side", *by[:-1], up.cast("long").alias("at"), up.cast("long").alias("first"), up.cast("long").alias("last"), "hash")
    return Trees(leaves, levels)


def _differing(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The places of the nodes that differ or that only one side has."""
    return nodes.groupBy(*by, "at").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("x"), F.max("hash").alias("y")).where("n < 2 or x <> y").select(*by, "at")


def _below(nodes: DataFrame, by: list[str], at: Column, found: DataFrame) -> DataFrame:
    """The nodes whose parents, at `at` of their level, are found."""
    up = found.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
    both = at == F.col("_at")
    for c in by:
        both = both & (F.col(c) == F.col(f"_{c}"))
    return nodes.join(up, both, "left_semi")


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows with `n`, their number in order of digest among those with equal `by`. In two levels: within the digests of one beginning, and over beginnings."""
    rows = rows.withColumn("_head", F.substring("digest", 1, 3))
    counts = rows.groupBy(*by, "_head").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows
    told = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_head").alias("_h"), before.alias("_before"))
    on = F.col("_head") == F.col("_h")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*by, "_head").orderBy("digest", "length"))
    return rows.withColumn("_n", within).join(told, on).withColumn("n", F.col("_n") + F.col("_before")).drop("_head", "_h", "_before", "_n", *[f"_{c}" for c in by])


def audit(trees: Trees) -> DataFrame:
    """The records in which two replicas differ: key, url, status, bucket, and of either replica offset, length, copies and digest."""
    by, top = trees.levels[-1]
    found = cut(_differing(top, by))
    least = trees.leaves.agg(F.min("bucket")).first()[0] or 0
    for below, (by, nodes) in zip(reversed(trees.levels[:-1]), reversed(trees.levels), strict=False):
        kind, children = below
        if kind == by:
            at = F.floor(F.col("at") / FANOUT).cast("long")
        elif not by:  # from buckets' numbers to buckets
            at = F.floor((F.col("bucket") - F.lit(least)) / FANOUT).cast("long")
        else:
            at = F.floor(F.col("part") / FANOUT).cast("long")
        found = cut(_differing(_below(children, by, at, found), kind))
    leaves = _below(trees.leaves, ["bucket", "part"], F.floor(F.col("at") / FANOUT).cast("long"), found)
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    sides = leaves.groupBy("bucket", "key", "url", "digest", "length").agg(of("offset", 1).alias("oa"), of("offset", 2).alias("ob"), F.coalesce(of("copies", 1), F.lit(0)).alias("ca"), F.coalesce(of("copies", 2), F.lit(0)).alias("cb"))
    sides = cut(sides.where("ca <> cb or oa <> ob"))
    moved = sides.where("oa <> ob").select("key", "url", F.lit("moved").alias("status"), "bucket", F.col("oa").alias("offset_a"), F.col("length").alias("length_a"), F.least("ca", "cb").alias("copies_a"), F.col("digest").alias("digest_a"), F.col("ob").alias("offset_b"), F.col("length").alias("length_b"), F.least("ca", "cb").alias("copies_b"), F.col("digest").alias("digest_b"))
    # Surplus copies lie behind those that both hold; the n-th missing record of a key and address is paired with the n-th extra one.
    names = ["bucket", "key", "url"]
    less = _numbered(sides.where("ca > cb").select(*names, "digest", "length", (F.col("oa") + F.col("cb") * F.col("length")).alias("offset"), (F.col("ca") - F.col("cb")).alias("copies")), names).alias("l")
    more = _numbered(sides.where("cb > ca").select(*names, "digest", "length", (F.col("ob") + F.col("ca") * F.col("length")).alias("offset"), (F.col("cb") - F.col("ca")).alias("copies")), names).alias("r")
    pair = (F.col("l.bucket") == F.col("r.bucket")) & F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.url") == F.col("r.url")) & (F.col("l.n") == F.col("r.n"))
    status = F.when(F.col("r.n").isNull(), "missing").when(F.col("l.n").isNull(), "extra").otherwise("changed")
    first, second = ([F.col(f"{x}.{c}").alias(f"{c}_{y}") for c in ("offset", "length", "copies", "digest")] for x, y in (("l", "a"), ("r", "b")))
    lost = less.join(more, pair, "full_outer").select(F.coalesce("l.key", "r.key").alias("key"), F.coalesce("l.url", "r.url").alias("url"), status.alias("status"), F.coalesce("l.bucket", "r.bucket").alias("bucket"), *first, *second)
    return lost.unionByName(moved)


def damaged(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A replica with what the audit is to find, by hash of the key: one page in sixteen with every e written as 3, one in 64 lost, one in 64 there under a further address, too."""
    mark = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    left = pages.where(~mark.rlike("^1[0-3]")).withColumn(html, F.when(mark.startswith("0"), F.translate(F.col(html), "e", "3")).otherwise(F.col(html)))
    return left.union(pages.where(mark.rlike("^2[0-3]")).withColumn(url, F.concat(F.coalesce(F.col(url), F.lit("")), F.lit("#2"))))


#: The audit of `pages` against `damaged(pages)` where no bucket holds more than LIMIT different records.
SQL = f"""
WITH p AS (
  SELECT page_id AS k, coalesce(url, '') AS u, coalesce(html, '') AS h, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS m FROM pages
), s AS (
  SELECT 1 AS side, k, u, h FROM p
  UNION ALL SELECT 2, k, u, CASE WHEN m LIKE '0%' THEN replace(h, 'e', '3') ELSE h END FROM p WHERE substr(m, 1, 2) NOT IN ('10', '11', '12', '13')
  UNION ALL SELECT 2, k, u || '#2', h FROM p WHERE substr(m, 1, 2) IN ('20', '21', '22', '23')
), r AS (
  SELECT side, k, u, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(k AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(h) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS raw FROM s
), d AS (
  SELECT side, k, u, coalesce(CAST(floor(k / {SPAN}.0) AS BIGINT), -1) AS bucket, sha256(raw) AS digest, CAST(strlen(raw) AS BIGINT) AS length, count(*) AS copies FROM r GROUP BY ALL
), o AS (
  SELECT *, CAST(sum(length * copies) OVER (PARTITION BY side, bucket ORDER BY k NULLS FIRST, u, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - length * copies AS off FROM d
), x AS (
  SELECT k, u, digest, length, max(off) FILTER (WHERE side = 1) AS oa, max(off) FILTER (WHERE side = 2) AS ob, coalesce(max(copies) FILTER (WHERE side = 1), 0) AS ca, coalesce(max(copies) FILTER (WHERE side = 2), 0) AS cb FROM o GROUP BY k, u, digest, length
), l AS (
  SELECT k, u, digest, length, oa + cb * length AS off, ca - cb AS copies, row_number() OVER (PARTITION BY k, u ORDER BY digest, length) AS n FROM x WHERE ca > cb
), e AS (
  SELECT k, u, digest, length, ob + ca * length AS off, cb - ca AS copies, row_number() OVER (PARTITION BY k, u ORDER BY digest, length) AS n FROM x WHERE cb > ca
)
SELECT coalesce(l.k, e.k) AS page_id, coalesce(l.u, e.u) AS url, CASE WHEN e.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' ELSE 'changed' END AS status,
  l.off AS offset_a, e.off AS offset_b, l.length AS length_a, e.length AS length_b, l.copies AS copies_a, e.copies AS copies_b, l.digest AS digest_a, e.digest AS digest_b
FROM l FULL JOIN e ON l.k IS NOT DISTINCT FROM e.k AND l.u = e.u AND l.n = e.n
UNION ALL
SELECT k, u, 'moved', oa, ob, length, length, least(ca, cb), least(ca, cb), digest, digest FROM x WHERE oa <> ob
"""
