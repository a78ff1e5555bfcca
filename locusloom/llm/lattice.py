"""Near-duplicate embeddings by lattice hashing: random projections decoded to points of the lattice E8.

Each of TABLES tables projects a unit vector onto CHUNKS times eight orthogonal random directions, scales it and decodes every
eight coordinates to the nearest point of E8; the points are its cell. A vector is at home in its cell and probes the PROBES
neighbouring cells whose centres are nearest, each one a minimal lattice vector away. Two vectors meet in a table if one of
them is at home in a cell that the other is at home in or probes; pairs that meet are verified by cosine in double precision.
Scales grow with the root of the dimension, so that a projection's spread, and with it the cells, are alike in all dimensions: at the
usual parameters a pair of cosine 0.93 meets with probability 0.997 (independent of the data).

Equal vectors, told by a 64-bit hash, are one vertex with a weight. A bitmap of fixed size keeps most probes of cells that are nobody's
home from being shuffled, and cells with one member are left out before any vector travels. The others are cut
into blocks by hash, so that a task compares at most about BLOCK homes with BLOCK members, by a matrix product, and gives
back for each vector the weight of its links and the edges of a spanning forest, never the pairs. A pair that meets more
than once counts where it meets first, which both vectors' cells tell; these are decoded anew for linked pairs only, from
projections that are summed in a fixed order and rounded, so that they come out alike.

Nulls and edges: vectors are compared only within one label and length. Null labels, null, empty and zero vectors, and those with null
or non-finite components, link with nothing. Rows that repeat a vec_id are
vectors each. Null ids link nothing and have a null component. Other columns pass unread.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import cut, grouped, integer_key, mixed, sieve, stored
from locusloom.llm.components import components

TABLES, CHUNKS, PROBES, SCALE = 8, 2, 8, 4.0
BLOCK = 256
COSINE = 0.93


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    out = np.rint(y)
    error = y - out
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(1)
    out[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to the rows of y (n, 8): of D8 or of D8 shifted by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


class Tables:
    """The cells of unit vectors of one dimension."""

    def __init__(self, dimension: int, tables: int = TABLES, chunks: int = CHUNKS, probes: int = PROBES, scale: float = SCALE, seed: int = 3):
        self.chunks, self.probes, self.roots = chunks, probes, minimal_vectors()
        width = 8 * chunks
        self.maps = []
        for t in range(tables):
            rng = np.random.default_rng([seed, t, dimension])
            q = np.linalg.qr(rng.normal(size=(max(dimension, width), width)))[0][:dimension]
            self.maps.append(q * scale * np.sqrt(dimension / 64))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cells (n, tables) and probed cells (n, tables, probes), by hash."""
        homes, probes = [], []
        for t, q in enumerate(self.maps):
            y = np.round(np.einsum("ij,jk->ik", x, q), 9)
            points = [nearest_e8(y[:, 8 * c : 8 * c + 8]) for c in range(self.chunks)]
            home = np.concatenate(points, 1) * 2
            gain = np.concatenate([(y[:, 8 * c : 8 * c + 8] - points[c]) @ self.roots.T for c in range(self.chunks)], 1)
            best = np.argsort(-gain, 1, kind="stable")[:, : self.probes]
            near = np.repeat(home[:, None, :], best.shape[1], 1).reshape(len(x), best.shape[1], self.chunks, 8)
            at = np.indices(best.shape)
            near[at[0], at[1], best // 240] += 2 * self.roots[best % 240]
            homes.append(self._hash(home, t))
            probes.append(self._hash(near.reshape(-1, 8 * self.chunks), t).reshape(best.shape))
        return np.stack(homes, 1), np.stack(probes, 1)

    @staticmethod
    def _hash(points: np.ndarray, table: int) -> np.ndarray:
        out = np.full(len(points), table + 1, np.uint64)
        for column in points.astype(np.int64).T:
            out = mixed(out * np.uint64(0x100000001B3) + column.view(np.uint64))
        return out


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # neither squares too large nor too small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _celled(vertices: DataFrame, options: dict) -> DataFrame:
    """(id, homes, probes) of the vertices (id, grp, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            lists = batch.column("x")
            sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                homes, probes = made.setdefault(int(size), Tables(int(size), **options)).cells(_unit(x))
                salt = mixed(part.column("grp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(size))
                homes, probes = mixed(homes + salt[:, None]), mixed(probes + salt[:, None, None])
                flat = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1).view(np.int64)), a[0].size).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), flat(homes), flat(probes)], names=["id", "homes", "probes"])

    return vertices.select("id", "grp", "x").mapInArrow(run, "id long, homes array<long>, probes array<long>")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(u), find(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    ids = np.array([v for v in parent if find(v) != v], np.int64)
    return np.array([find(v) for v in ids.tolist()], np.int64), ids


def _block(rows: pa.RecordBatch, cosine: float, tables: Tables) -> pa.RecordBatch | None:
    """The links that count in one block: homes against members of a cell."""
    take = lambda c, kind: rows.column(c).to_numpy(zero_copy_only=False).astype(kind)
    first = np.flatnonzero(take("first", bool))
    second = np.flatnonzero(~take("first", bool))
    if not len(first) or not len(second):
        return None
    ids, weight, home = take("id", np.int64), take("weight", np.int64), take("home", bool)
    n = rows.num_rows
    x = _unit(rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
    i, j = np.nonzero(x[first] @ x[second].T >= cosine)
    a, b = first[i], second[j]
    # Two homes meet in both orders, and each vector meets itself.
    ok = (ids[a] != ids[b]) & (~home[b] | (ids[a] < ids[b]))
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    linked, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    homes, probed = tables.cells(x[linked])
    u, v = at[: len(a)], at[len(a) :]
    table = int(take("table", np.int64)[0])
    counts = np.ones(len(a), bool)
    for t in range(table + 1):
        ha, hb = homes[u, t], homes[v, t]
        a_at_b, b_at_a = (probed[u, t] == hb[:, None]).any(1), (probed[v, t] == ha[:, None]).any(1)
        if t < table:
            counts &= ~((ha == hb) | a_at_b | b_at_a)
        else:  # met at a's home; if also at b's, the smaller id's home counts
            counts &= (ha == hb) | ~a_at_b | (ids[a] < ids[b])
    a, b = a[counts], b[counts]
    if not len(a):
        return None
    linked, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    total = np.bincount(at, np.concatenate([weight[b], weight[a]]), len(linked)).astype(np.int64)
    root, leaf = _roots(ids[a], ids[b])
    k, m = len(linked), len(leaf)
    pad = np.zeros(m, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([linked, leaf])), pa.array(np.concatenate([total, pad])), pa.array(np.concatenate([np.zeros(k, np.int64), root]), mask=np.arange(k + m) < k)], names=["id", "links", "root"])


def _met(celled: DataFrame, vertices: DataFrame, cosine: float, block: int, options: dict) -> DataFrame:
    """(id, links, root): weights of links, and where root is not null an edge."""
    homes = celled.select("id", F.posexplode("homes").alias("table", "cell")).withColumn("home", F.lit(True))
    others = celled.select("id", F.posexplode("probes").alias("spot", "cell")).select("id", F.floor(F.col("spot") / options["probes"]).cast("int").alias("table"), "cell").withColumn("home", F.lit(False))
    members = homes.union(sieve(others, "cell", homes.select(F.col("cell").alias("v"))))
    busy = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).where("n > 1 and home").select(F.col("cell").alias("c"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    held = stored(members.join(busy, F.col("cell") == F.col("c")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = held.where("home").select("id", "cell", "table", "home", F.lit(True).alias("first"), F.col("own").alias("i"), every.alias("j"))
    second = held.select("id", "cell", "table", "home", F.lit(False).alias("first"), every.alias("i"), F.col("own").alias("j"))
    dealt = first.union(second).join(vertices.select(F.col("id").alias("v"), "x", "weight"), F.col("id") == F.col("v")).drop("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for rows in grouped(batches, ["key", "cell", "i", "j"]):
            size = len(rows.column("x")[0])
            if (out := _block(rows, cosine, made.get(size) or made.setdefault(size, Tables(size, **options)))) is not None:
                yield out

    ordered = dealt.withColumn("key", F.xxhash64("cell", "i", "j")).repartition("key").sortWithinPartitions("key", "cell", "i", "j")
    return ordered.mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES, chunks: int = CHUNKS, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """One row per vector: the key, n_links, component_id, kept."""
    options = {"tables": tables, "chunks": chunks, "probes": probes, "scale": scale}
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"  # floats travel as such
    x = F.transform(F.col(vector), lambda v: v.cast(kind) + F.lit(0.0).cast(kind))
    told = vectors.select(integer_key(vectors, key).alias("k"), F.col(label).alias("y"), x.alias("x"))
    fine = F.col("k").isNotNull() & F.col("y").isNotNull() & (F.size("x") > 0)
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("x", lambda v: v != 0)
    told = told.withColumn("fine", F.coalesce(fine & ~bad, F.lit(False)))
    named = told.where("fine").select("k", F.xxhash64("y", "x").alias("v"), F.xxhash64("y").alias("grp"), "x")
    # Vertices are numbered by what they hold: an id may be repeated.
    vertices = stored(named.groupBy(F.col("v").alias("id")).agg(F.first("grp").alias("grp"), F.first("x").alias("x"), F.count(F.lit(1)).alias("weight"), F.min("k").alias("least")))
    met = cut(_met(stored(_celled(vertices, options)), vertices, cosine, block, options))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    edges = met.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b"))
    joined = components(edges)
    of = vertices.select("id", "least", "weight").join(joined.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("id", "least", "weight", F.coalesce("root", "id").alias("r"))
    least = of.groupBy("r").agg(F.min("least").alias("component"))
    of = of.join(least, "r").join(links, "id", "left").select("id", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = named.select("k", "v").join(of, F.col("v") == F.col("id")).select("k", "n_links", F.col("component").alias("component_id"))
    rest = told.where("not fine").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = found.union(rest)
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"))
