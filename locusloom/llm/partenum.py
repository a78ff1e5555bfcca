"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles. Sets are taken in bands of size; within a band, Jaccard similarity of
at least the threshold bounds the number of elements in which two sets differ by some k. The feature domain is hashed
into n1 parts, so that in one of them at most k // n1 = 1 elements differ, and each part into n2 = 3 smaller ones, of which
then at least two agree. A signature is the hash of the set's elements in two of the three smaller parts of a part: sets that
are similar enough share one, with certainty. A set emits the signatures of its own band and of the next one if a larger
partner can lie there.

An empty projection says little and would be shared by many. n1 holds a tenth more parts than needed (`SPARE`), so at least
that many more parts agree; a set with no more empty projections than that leaves them out without losing a pair.

Candidates: a batch of documents sends one row for each set that it holds, by the set's digest, which finds equal sets, and one for each
signature; copies inside the batch name the first of them, so a group in the window has a row a batch, however many copies. Every other
member of a signature's group is paired with the group's least member; inside a batch of documents this is done before the
shuffle, so a set that a batch repeats sends its signatures once, and a frequent signature is sent once a batch. Where the
least member is not similar to some of the others, each member outside its component is compared with all of the group,
block by block. Pairs are first held against a sketch: how many elements fall into each of 256 cells. The sum of the
differences never exceeds the number of elements in which two sets differ, so no similar pair is lost. What remains is
compared exactly. Components are therefore those of all similar pairs, though only a few pairs of a dense group are made.

Nulls and edges: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle are
one shingle. Rows with the same key are one vertex. Rows with a null key are returned with a null component_id and link
nothing. Shingles are compared by 64-bit hashes, equal sets found by 128-bit digests. Other columns pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import byte_words, cut, grouped, integer_key, lowered, mixed, slices, stored, word_hashes
from locusloom.llm.components import components

WORDS = 4
#: Linked if PERCENT of the union's size is at most 100 times the intersection's.
PERCENT = 85
#: Bands of size: each ends at RATIO times its beginning.
RATIO = 1.5
SPARE = 10
SUBSETS = ((0, 1), (0, 2), (1, 2))


class Bands:
    """Bands of set sizes, and for each its number of first parts and how many of them are spare."""

    def __init__(self, percent: int = PERCENT, ratio: float = RATIO):
        self.percent, self.ratio = percent, ratio
        self.lows, self.highs = [1], []

    def of(self, size: int) -> int:
        while not self.highs or self.highs[-1] < size:
            self.highs.append(max(self.lows[-1], int(self.lows[-1] * self.ratio)))
            self.lows.append(self.highs[-1] + 1)
        return int(np.searchsorted(self.highs, size))

    def parts(self, band: int) -> tuple[int, int]:
        """Of sets up to the band's end at most k elements differ; parts for that many differences, at most one in one of them, and spare ones."""
        k = 2 * self.highs[band] * (100 - self.percent) // (100 + self.percent)
        base = (k + 2) // 2
        spare = base // SPARE
        return base + spare, spare

    def instances(self, size: int) -> range:
        """The bands whose signatures a set of this size emits: those that a partner at least as large can lie in."""
        return range(self.of(size), self.of(size * 100 // self.percent) + 1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    data, starts, stops, ends = byte_words(lowered(texts))
    ids = word_hashes(data, starts, stops)
    n = len(ids) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        rolled = mixed(rolled * np.uint64(0x9FB21C651E98DF25) + ids[j : j + len(rolled)] + np.uint64(j + 1))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in range(a, b):
                h = mixed(h + ids[x : x + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """The PartEnum signatures of one non-empty set."""
    out = []
    for band in bands.instances(len(elements)):
        n1, spare = bands.parts(band)
        spread = mixed(elements + np.uint64(band * 0x2545F491))
        cell = (spread % np.uint64(n1)).astype(np.int64) * 3 + ((spread >> np.uint64(40)) % np.uint64(3)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        values = mixed(spread[order])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        edges = np.searchsorted(cell[order], np.arange(3 * n1 + 1))
        sums = (total[edges[1:]] - total[edges[:-1]]).reshape(n1, 3)
        sizes = np.diff(edges).reshape(n1, 3)
        made, empty = [], []
        for i, (x, y) in enumerate(SUBSETS):
            key = mixed(sums[:, x] + np.uint64(0x1000003) * sums[:, y] + (sizes[:, x] * 65537 + sizes[:, y]).astype(np.uint64))
            made.append(mixed(key + mixed(np.arange(n1, dtype=np.uint64) * np.uint64(3) + np.uint64(i)) + np.uint64(band)))
            empty.append(sizes[:, x] + sizes[:, y] == 0)
        made, empty = np.concatenate(made), np.stack(empty)
        if empty.any(0).sum() <= spare:
            made = made[~empty.ravel()]
        out.append(made)
    return np.concatenate(out)


#: Cells of a sketch.
CELLS = 256
#: Members of a group that one block compares with as many others.
BLOCK = 2048
#: sig: the signature of a finished pair; of a document, the first key in its batch with an equal set.
_SENT = "at long, x long, a long, b long, sig long, n long, sketch binary"


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall into each cell, 255 at most."""
    return np.minimum(np.bincount((mixed(elements ^ np.uint64(0xC0FFEE)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _sent(keys: np.ndarray, null: np.ndarray, sets: list[np.ndarray], bands: Bands) -> pa.RecordBatch:
    """What a batch of sets sends: a row of each document by its digest, and of each distinct set's signatures by signature; members of a group that the batch holds twice as finished pairs, dealt by hash."""
    sizes = np.array([len(s) for s in sets], np.int64)
    raw = [hashlib.md5(s.tobytes()).digest() if len(s) else hashlib.md5(f"{k}".encode()).digest() for s, k in zip(sets, keys.tolist(), strict=True)]
    digests = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    usable = np.flatnonzero((sizes > 0) & ~null)
    usable = usable[np.argsort(keys[usable], kind="stable")]
    _, index, inverse = np.unique(digests[usable, 0], return_index=True, return_inverse=True)
    reps = usable[np.sort(index)]
    # Only the first of equal sets in a batch is sent by its digest; the others name it and are spread by their keys.
    of = usable[index][inverse]
    same = digests[of, 1] == digests[usable, 1]
    local, copies = keys.copy(), usable[same & (of != usable)]
    local[usable[same]] = keys[of[same]]
    digests = digests.copy()
    digests[copies, 0], digests[copies, 1] = mixed(keys[copies].view(np.uint64)).view(np.int64), keys[copies]
    made = [signatures(sets[i], bands).view(np.int64) for i in reps.tolist()]
    sigs = np.concatenate([np.zeros(0, np.int64), *made])
    owner = np.repeat(keys[reps], [len(m) for m in made])
    order = np.lexsort((owner, sigs))
    sigs, owner = sigs[order], owner[order]
    first = np.ones(len(sigs), bool)
    first[1:] = sigs[1:] != sigs[:-1]
    least = owner[first][np.cumsum(first) - 1]
    rest = ~first & (owner != least)
    spread = mixed(owner[rest].view(np.uint64) * np.uint64(3) + sigs[rest].view(np.uint64)).view(np.int64)
    d, n, m = len(sets), int(first.sum()), int(rest.sum())
    column = lambda docs, firsts, rests, null_: pa.array(np.concatenate([docs, firsts, rests]), mask=null_)
    zeros = np.zeros
    part = np.repeat([0, 1, 2], [d, n, m])
    nulls = np.concatenate([null, zeros(n + m, bool)])
    sketches = pa.array([sketch(s) for s in sets] + [None] * (n + m), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            column(digests[:, 0], sigs[first], spread, None),
            column(digests[:, 1], zeros(n, np.int64), zeros(m, np.int64), part > 0),
            column(keys, owner[first], least[rest], nulls),
            column(zeros(d, np.int64), zeros(n, np.int64), owner[rest], part < 2),
            column(local, zeros(n, np.int64), sigs[rest], (part == 1) | nulls),
            column(sizes, zeros(n, np.int64), zeros(m, np.int64), part > 0),
            sketches,
        ],
        names=["at", "x", "a", "b", "sig", "n", "sketch"],
    )


def met(documents: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT, ratio: float = RATIO) -> DataFrame:
    """Rows of documents: (k, n, sketch, m), m a lesser key with an equal set, or its own. Rows of candidates: (sig, a, b), b a member of the signature's group and a the one that it is paired with."""
    source = documents.select(integer_key(documents, key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, ratio)
        for batch in batches:
            for part in slices(batch, "t", 4_000_000):
                keys = part.column("k")
                null = keys.is_null().to_numpy(zero_copy_only=False)
                yield _sent(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, shingle_sets(part.column("t"), words), bands)

    near = source.mapInArrow(run, _SENT).withColumn("m", F.least(F.min("a").over(Window.partitionBy("at", "x")), F.when(F.col("n").isNotNull(), F.col("sig"))))  # a group has a row a batch
    star = F.when(F.col("b").isNotNull(), F.struct("sig", "a", "b")).when(F.col("n").isNull() & (F.col("a") > F.col("m")), F.struct(F.col("at").alias("sig"), F.col("m").alias("a"), F.col("a").alias("b")))
    near = near.withColumn("s", star).where("n is not null or s is not null")
    return near.select("s.sig", "s.a", "s.b", F.when(F.col("n").isNotNull(), F.col("a")).alias("k"), "n", "sketch", "m")


def _differ(sketch_a: np.ndarray, sketch_b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches (rows against rows) prove that sets are not similar enough."""
    apart = np.abs(sketch_a.astype(np.int16) - sketch_b.astype(np.int16)).sum(1)
    return (apart * (100 + percent) > (na + nb) * (100 - percent)) | (100 * np.minimum(na, nb) < percent * np.maximum(na, nb))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _plausible(pairs: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""
    sides = [told.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                out = _differ(_sketches(batch.column("sa")), _sketches(batch.column("sb")), na, nb, percent)
                yield batch.select(["a", "b"]).filter(pa.array(~out))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _others(members: DataFrame, percent: int) -> DataFrame:
    """The plausible pairs, across components, of members outside the component of their group's least with all members. members: (sig, k, root, head, n, sketch), head the least member's component."""
    sized = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).select(F.col("sig").alias("g"), F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    held = members.join(sized, F.col("sig") == F.col("g")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    names = ["sig", "k", "root", "n", "sketch"]
    first = held.where("root <> head").select(*names, F.lit(1).alias("side"), F.col("own").alias("i"), every.alias("j"))
    second = held.select(*names, F.lit(2).alias("side"), every.alias("i"), F.col("own").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["sig", "i", "j"]):
            side, k, root, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("side", "k", "root", "n"))
            marks = _sketches(rows.column("sketch"))
            found = []
            all_ = np.flatnonzero(side == 2)
            for i in np.flatnonzero(side == 1).tolist():
                at = all_[root[all_] != root[i]]
                at = at[~_differ(marks[i : i + 1], marks[at], n[i], n[at], percent)]
                found.append(np.stack([np.minimum(k[at], k[i]), np.maximum(k[at], k[i])], 1))
            if found and len(pairs := np.unique(np.concatenate(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    dealt = first.union(second).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


#: Bits of the filter that picks the documents to be read again: 1,024 rows of 4 KB at most, whatever the input.
_FILTER = 1024 * 32768


def _among(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the ids, as bits."""
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "k"), F.lit(_FILTER)) for i in range(3)])).alias("x"))
    rows = spots.groupBy((F.col("x") / 32768).cast("long").alias("row")).agg(F.bitmap_construct_agg(F.col("x") % 32768).alias("bits")).collect()
    out = np.zeros(_FILTER // 8, np.uint8)
    for r in rows:
        out[r.row * 4096 : (r.row + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _compared(documents: DataFrame, pairs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """(a, b, linked) for the distinct pairs, by exact comparison of their sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    bits = _among(ids)
    spots = F.array(*[F.pmod(F.xxhash64(F.lit(i), "k"), F.lit(_FILTER)) for i in range(3)])
    source = documents.select(integer_key(documents, key).alias("k"), F.col(text).alias("t")).where("k is not null").withColumn("x", spots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            batch = batch.filter(pa.array(((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1).all(1)))
            for part in slices(batch, "t"):
                sets = shingle_sets(part.column("t"), words)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k", "s"])

    found = source.mapInArrow(run, "k long, s array<long>")
    sets = found.join(ids.withColumnRenamed("k", "i"), F.col("k") == F.col("i"), "left_semi")
    left = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("n"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("c"))
    return shared.select("a", "b", (100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).alias("linked")).groupBy("a", "b").agg(F.max("linked").alias("linked"))


def classes(documents: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT, ratio: float = RATIO) -> DataFrame:
    """One row per row of documents: the key, n_shingles, component_id."""
    names = {"text": text, "key": key}
    near = stored(met(documents, **names, words=words, percent=percent, ratio=ratio))
    told = near.where("n is not null")
    stars = near.where("b is not null").select("sig", "a", "b")
    # Most signatures of a family of copies have the same members, and so the same pairs: one of them stands for all.
    # Sums, as rows that repeat in other batches send a pair more than once; halves of 32 bits, so that none overflows.
    hashes = [F.xxhash64("b"), F.xxhash64(F.lit(1), "a", "b")]
    halves = [x for h in hashes for x in (h.bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned(h, 32))]
    same = [F.min("a"), F.count(F.lit(1)), *[F.sum(x) for x in halves]]
    stands = stars.groupBy("sig").agg(F.struct(*same).alias("same")).groupBy("same").agg(F.min("sig").alias("sig")).select("sig")
    stars = stored(stars.join(stands, "sig"))
    equal = told.where("n > 0 and k > m").select(F.col("m").alias("a"), F.col("k").alias("b"))
    one = told.where("k is not null").groupBy("k").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    plausible = cut(_plausible(stars.select("a", "b").distinct(), one, percent))
    checked = cut(_compared(documents, plausible, **names, words=words, percent=percent))
    links = checked.where("linked").select("a", "b").union(equal)
    found = components(links)
    roots = found.select(F.col("id").alias("v"), "root")
    both = stars.join(roots.withColumnRenamed("v", "a").withColumnRenamed("root", "ra"), "a", "left").select("sig", "a", "b", F.coalesce("ra", "a").alias("ra"))
    both = both.join(roots.withColumnRenamed("v", "b").withColumnRenamed("root", "rb"), "b", "left").select("sig", "a", "b", "ra", F.coalesce("rb", "b").alias("rb"))
    both = stored(both)
    apart = both.where("ra <> rb").select("sig").distinct()
    if not apart.isEmpty():
        split = stored(both.join(apart, "sig"))
        members = split.select("sig", F.col("a").alias("k"), F.col("ra").alias("root")).union(split.select("sig", F.col("b").alias("k"), F.col("rb").alias("root"))).distinct()
        heads = split.groupBy("sig").agg(F.min("ra").alias("head"))
        rest = _others(members.join(heads, "sig").join(one, "k").select("sig", "k", "root", "head", "n", "sketch"), percent)
        rest = cut(rest.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            more = cut(_compared(documents, rest, **names, words=words, percent=percent).where("linked").select("a", "b"))
            if not more.isEmpty():
                found = components(links.union(more))
    out = told.select("k", "n").join(found.select(F.col("id").alias("k"), "root"), "k", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "k").alias("component_id"))


#: The same by comparing all sets that share a shingle.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS v, a AS r FROM both_ways UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.v AND reach.r < e.b
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT v, min(r) AS m FROM reach GROUP BY v) ON v = d.doc_id
"""
