"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are the parts of a text between line feeds that hold a word. A line's shingles are its runs of SHINGLE bytes of UTF-8
(a shorter line is one shingle). Its signature holds MINIMA minima: each is the least shingle hash after an exclusive or
with a constant, which orders the hashes anew. All lines sign all their shingles. Minima are aggregated from one generated row
per shingle, inside generated code and before the shuffle, and never from whole sets.

Each band is a triple of minima; lines that agree in one are candidates. Equal lines are one vertex.

1. Every member of a band's group is compared with the group's pivot, its most frequent line: of near copies that is mostly the one
   that they were made from, so one comparison each links nearly all of them.
2. Members outside the pivot's component are then compared with all members of other components in the group, in blocks
   of bounded size. A bound goes before the sets: the number of bits in which two bitmaps of the shingles differ, which the sets
   differ in at least. Blocks give back pairs of components, not of lines.

Comparison is exact: Jaccard similarity of the shingle sets of at least `percent` hundredths. Components of linked lines are found
by alternating stars; the first line of each, by key and line number, is kept.

Two lines of similarity 0.8 share a band with probability 0.981, of 0.85 with 0.995, of 0.9 with 0.9994.

Nulls and edges: null texts and null keys have no lines here, blank lines are never removed, lines of any length are signed and
compared whole. Rows with the same key are one document given twice: both keep the same lines. Lines are told apart by a
64-bit hash and a second one; of lines that collide in the first only, all but one kind are kept and linked with nothing.
Other columns pass unread.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import among, cut, discard, integer_key, sieve, stored
from locusloom.llm.components import components

SHINGLE, PERCENT = 9, 80
#: Minima of a signature, and the triples of them that are its bands; each is in two.
MINIMA = 12
BANDS = ((4, 7, 10), (0, 3, 9), (2, 6, 8), (1, 5, 11), (2, 3, 10), (1, 5, 7), (0, 4, 6), (8, 9, 11))
#: Members of a block, and their shingles, about; words of 64 bits in a bitmap of shingles, and how many of them are looked at first.
BLOCK, BLOCK_SHINGLES, WORDS, FIRST = 512, 400_000, 32, 12
#: Neighbouring shingles that one generated row signs, a power of 2.
RUN = 4
#: A text of these alone holds no word.
_SPACES = " \t\n\x0b\x0c\r"


def lines_of(documents: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, no, line, h, g): the lines that hold a word, with their hashes."""
    lines = documents.where(F.col(key).isNotNull()).select(integer_key(documents, key).alias("k"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))
    return lines.where(F.ltrim("line", F.lit(_SPACES)) != "").select("k", "no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _positions(raw: Column, shingle: int) -> Column:
    return F.greatest(F.lit(1), F.octet_length(raw) - shingle + 1)


def _runs(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, i, x0, x1, ...): the shingle hashes of lines (h, b, n), RUN in a row. Position 0 is the first shingle, too, and beyond a line's end a row repeats the last one: both change no minimum and no set."""
    at = texts.select("h", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(RUN))).alias("i"))
    return at.select("h", "i", *[F.hash(F.substring("b", F.least(F.col("i").bitwiseOR(F.lit(j)), F.col("n")), F.lit(shingle))).alias(f"x{j}") for j in range(RUN)])


def signatures(lines: DataFrame, *, shingle: int = SHINGLE, minima: int = MINIMA, seed: int = 5) -> DataFrame:
    """(h, c, m0, m1, ...): how often each distinct line occurs, and its minima."""
    rng = random.Random(seed)
    x = _runs(lines.select("h", F.encode("line", "utf-8").alias("b")).withColumn("n", _positions(F.col("b"), shingle)), shingle)
    turned = [F.lit(rng.getrandbits(32) - 2**31).cast("int") for _ in range(minima)]
    least = [F.min(F.least(*[F.col(f"x{i}").bitwiseXOR(c) for i in range(RUN)])).alias(f"m{j}") for j, c in enumerate(turned)]
    return x.groupBy("h").agg(F.count_if(F.col("i") == 0).alias("c"), *least)


def banded(signed: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """(band, h, c)."""
    keys = F.array(*[F.xxhash64(F.lit(j), *[f"m{i}" for i in triple]) for j, triple in enumerate(bands)])
    return signed.select("h", "c", F.explode(keys).alias("band"))


def _members(in_bands: DataFrame) -> DataFrame:
    """(band, h, a): the members of groups of two lines or more, with their pivot."""
    # Nearly all bands are single: dealt out first, they are not aggregated twice on either side of the shuffle.
    dealt = in_bands.select("band", "h").repartition(int(in_bands.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band")
    several = stored(dealt.groupBy("band").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select(F.col("band").alias("v")))
    members = stored(among(in_bands, "band", several))
    pivots = members.groupBy("band").agg(F.max(F.struct("c", "h")).alias("p")).select(F.col("band").alias("e"), F.col("p.h").alias("a"))
    out = stored(members.join(pivots, F.col("band") == F.col("e")).select("band", "h", "a"))
    discard(several, members)
    return out


def _texts(lines: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(h, b, n): the bytes and shingle positions of the lines with the given hashes."""
    found = among(lines.select("h", "line"), "h", ids).groupBy("h").agg(F.max("line").alias("line"))
    return found.select("h", F.encode("line", "utf-8").alias("b")).withColumn("n", _positions(F.col("b"), shingle))


def _hashes(raw: Column, shingle: int, whole=lambda x: x) -> Column:
    """The shingle hashes of a line, and `whole` of them. The bytes are bound once, not copied for each shingle."""
    return F.transform(F.array(raw), lambda r: whole(F.transform(F.sequence(F.lit(1), _positions(r, shingle)), lambda i: F.xxhash64(F.substring(r, i, F.lit(shingle))))))[0]


def _shingles(raw: Column, shingle: int) -> Column:
    """The distinct shingle hashes of a line."""
    return _hashes(raw, shingle, F.array_distinct)


def _alike(pairs: DataFrame, x: str, y: str, shingle: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose lines, in columns x and y, are similar."""
    # Rows come out of a generator, which no filter is moved through: else each set is made twice.
    sets = pairs.select("a", "b", F.explode(F.array(F.struct(_hashes(F.col(x), shingle).alias("x"), _hashes(F.col(y), shingle).alias("y")))).alias("s"))
    # Both functions take repeats out, in generated code. Most pairs fail by their union alone, since sets have no more members than lines have positions.
    sets = sets.select("a", "b", F.explode(F.array(F.struct("s.x", "s.y", F.size(F.array_union("s.x", "s.y")).alias("u")))).alias("s"))
    told = ((F.size("s.x") + F.size("s.y")) * 100 >= (100 + percent) * F.col("s.u")) & (F.size(F.array_intersect("s.x", "s.y")) * 100 >= percent * F.col("s.u"))
    return sets.where(told).select("a", "b")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b)."""
    sides = [texts.select(F.col("h").alias(c), F.col("b").alias(f"b{c}")) for c in ("a", "b")]
    return _alike(pairs.join(sides[0], "a").join(sides[1], "b"), "ba", "bb", shingle, percent)


#: The columns of a bitmap.
_WORDS = [f"w{j}" for j in range(WORDS)]


def _bitmaps(texts: DataFrame, shingle: int) -> DataFrame:
    """(v, w0, w1, ...): for each line 64 * WORDS bits, set where a shingle's hash falls. Made in generated code, RUN shingles a row."""
    x = _runs(texts, shingle)
    x = x.select("h", *[F.shiftrightunsigned(f"x{i}", 6).bitwiseAND(F.lit(WORDS - 1)).alias(f"at{i}") for i in range(RUN)], *[F.expr(f"shiftleft(1L, x{i} & 63)").alias(f"bit{i}") for i in range(RUN)])
    own = lambda j: [F.when(F.col(f"at{i}") == j, F.col(f"bit{i}")).otherwise(F.lit(0).cast("long")) for i in range(RUN)]
    return x.groupBy(F.col("h").alias("v")).agg(*[F.bit_or(reduce(lambda p, q: p.bitwiseOR(q), own(j))).alias(w) for j, w in enumerate(_WORDS)])


def _total(columns: list[Column]) -> Column:
    """Their sum, added up in pairs: no addition waits for all before it."""
    while len(columns) > 1:
        columns = [reduce(add, columns[i : i + 2]) for i in range(0, len(columns), 2)]
    return columns[0]


def _bounds(x: str, y: str, percent: int) -> list[Column]:
    """What holds for similar lines: their sets differ in at most (100 - percent) of (100 + percent) of their sizes' sum, and bitmaps in no more bits. Most others do within the first few words."""
    # Doubles, which hold these counts exactly: additions of integers call a check of overflow each.
    differ = lambda some: _total([F.bit_count(F.col(f"{w}_{x}").bitwiseXOR(F.col(f"{w}_{y}"))).cast("double") for w in some])
    most = (F.col(f"n_{x}") + F.col(f"n_{y}")) * float(100 - percent)
    return [differ(some) * float(100 + percent) <= most for some in (_WORDS[:FIRST], _WORDS)]


def _others(members: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links (a, b) between components that hold members of one group, of members outside the pivot's component with all others. Compared inside blocks of bounded size."""
    roots = cut(found.select(F.col("id").alias("v"), "root"))
    told = members.join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("v").alias("h"), F.col("root").alias("rh")), "h", "left")
    told = stored(told.select("band", "h", F.coalesce("rh", "h").alias("root"), F.coalesce("ra", "a").alias("head")))
    # A group of two has been compared; one whose members are all of the pivot's component has nothing left.
    left = told.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("root") != F.col("head")).alias("o")).where("c > 2 and o > 0").select(F.col("band").alias("g"))
    held = group = stored(told.join(left, F.col("band") == F.col("g"), "left_semi"))
    own = stored(among(texts, "h", held.select(F.col("h").alias("v")).distinct()))
    shared = held.groupBy(F.col("h").alias("u")).agg(F.collect_list("band").alias("bands"))  # one of each band at most
    known = own.join(_bitmaps(own, shingle), F.col("h") == F.col("v")).join(shared, F.col("h") == F.col("u"))
    # A set has as many members as its bitmap has bits at least, and as its line has positions at most; it is made only where these are far apart.
    bits = _total([F.bit_count(w).cast("double") for w in _WORDS])
    size = lambda bound: F.when(bits * 2.0 >= F.col("n"), bound.cast("double")).otherwise(F.size(_shingles(F.col("b"), shingle)).cast("double"))
    kept = known = stored(known.select("v", "b", size(F.col("n")).alias("n"), size(bits).alias("least"), "bands", *_WORDS))
    held = held.join(known.select("v", "n"), F.col("h") == F.col("v")).drop("v")
    sized = held.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).select(F.col("band").alias("g"), F.ceil(F.greatest(F.col("c") / BLOCK, F.col("t") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    held = held.join(sized, F.col("band") == F.col("g")).withColumn("own", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # Side x holds the members outside the pivot's component, side y all; two of the former meet once.
    known = known.select("v", "b", "bands", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "least", *_WORDS)])
    out = F.col("root") != F.col("head")
    first = held.where(out).select("band", F.col("own").alias("i"), every.alias("j"), "h", "root")
    second = held.select("band", every.alias("i"), F.col("own").alias("j"), "h", "root", out.alias("out"))
    # Few bytes but much work: a fixed number of partitions, which adaptive execution doesn't make fewer.
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("band", "i", "j")
    x, y = (side.join(known, F.col("h") == F.col("v")).drop("v").repartition(tasks, *keys) for side in (first, second))
    x, y = (side.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in side.columns if c not in keys]) for side, s in ((x, "x"), (y, "y")))
    met = [x[k] == y[k] for k in keys]
    met += [F.col("root_x") != F.col("root_y"), ~F.col("out_y") | (F.col("h_x") < F.col("h_y"))]
    met += [F.col("n_x") * 100.0 >= F.col("least_y") * float(percent), F.col("n_y") * 100.0 >= F.col("least_x") * float(percent)]
    met += _bounds("x", "y", percent)
    # Two lines are compared in the first of the groups that both are in.
    met += [F.array_min(F.array_intersect("bands_x", "bands_y")) == x["band"]]
    near = x.join(y.hint("merge"), reduce(and_, met)).select(F.least("root_x", "root_y").alias("a"), F.greatest("root_x", "root_y").alias("b"), "b_x", "b_y")
    out = cut(_alike(near, "b_x", "b_y", shingle, percent).distinct())
    discard(told, group, own, kept)
    return out


def linked_lines(lines: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, minima: int = MINIMA, bands: tuple = BANDS) -> DataFrame:
    """(id, root) of the hashes of linked lines that are not the least of their component."""
    signed = stored(signatures(lines, shingle=shingle, minima=minima))
    members = _members(banded(signed, bands))
    discard(signed)
    pairs = members.where("h <> a").select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct()
    texts = stored(_texts(lines, members.select(F.col("h").alias("v")).distinct(), shingle))
    links = cut(_compared(pairs, texts, shingle, percent))
    found = components(links)
    more = _others(members, found, texts, shingle, percent)
    discard(members, texts)
    return found if more.isEmpty() else components(links.union(more))


def deduplicate(documents: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, minima: int = MINIMA, bands: tuple = BANDS) -> DataFrame:
    """One row per line that holds a word: key, line_no (from 0), first_key and first_line (where its component is first seen), kept."""
    lines = lines_of(documents, text=text, key=key)
    found = linked_lines(lines, shingle=shingle, percent=percent, minima=minima, bands=bands)
    place = F.col("k").cast("decimal(38,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("no")
    told = stored(lines.select("k", "no", "h", "g"))
    first = told.groupBy("h", "g").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("c"))
    members = found.select(F.col("id").alias("v"), "root").union(found.select(F.col("root").alias("v"), "root").distinct())
    # Only lines that occur again or are linked have a head elsewhere.
    again = stored(first.join(members, F.col("h") == F.col("v"), "left").where("c > 1 or root is not null").drop("v", "c"))
    kinds = again.where("root is not null").groupBy(F.col("h").alias("i")).agg(F.min("g").alias("d"))
    mine = again.join(kinds, F.col("h") == F.col("i"), "left").select("h", "g", "at", F.when(F.col("g") == F.col("d"), F.col("root")).alias("root"))
    roots = mine.where("root is not null").groupBy("root").agg(F.min("at").alias("head")).withColumnRenamed("root", "r")
    heads = mine.join(roots, F.col("root") == F.col("r"), "left").select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.coalesce("head", "at").alias("head"))
    # Here and not below: decimals are slow, and there are fewer heads than lines.
    head_key = F.floor(F.col("head") / F.lit(2**31).cast("decimal(10,0)"))
    head_no = F.col("head") - head_key * F.lit(2**31).cast("decimal(10,0)")
    heads = heads.select("h2", "g2", head_key.cast("long").alias("hk"), head_no.cast("int").alias("hn"))
    near, far = sieve(told, "h", again.select(F.col("h").alias("v")), apart=True)
    out = near.join(heads, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left").select("k", "no", F.coalesce("hk", "k").alias("hk"), F.coalesce("hn", "no").alias("hn"))
    out = out.union(far.select("k", "no", F.col("k"), F.col("no")))
    return out.select(F.col("k").alias(key), F.col("no").alias("line_no"), F.col("hk").alias("first_key"), F.col("hn").alias("first_line"), ((F.col("hk") == F.col("k")) & (F.col("hn") == F.col("no"))).alias("kept"))


def without_copies(documents: DataFrame, *, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without their removed lines; a document that loses its last word goes."""
    dropped = deduplicate(documents, text=text, key=key, **options).where("not kept").groupBy(F.col(key).alias("_k")).agg(F.collect_set("line_no").alias("_no"))
    marked = documents.join(dropped, F.col(f"`{key}`") == F.col("_k"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_no"), i)), "\n")
    marked = marked.withColumn(text, F.when(F.col("_no").isNull(), F.col(text)).otherwise(kept))
    return marked.where(F.col("_no").isNull() | (F.ltrim(F.col(text), F.lit(_SPACES)) != "")).select(*[F.col(f"`{c}`") for c in documents.columns])
