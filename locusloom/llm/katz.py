"""Word bigram language model with Katz backoff, learnt and evaluated over partitioned tables.

Tokens are the words of a text, A-Z lower-cased, and one end. P(w | h) is the Good-Turing discounted share of the bigram
h w where training saw it, else alpha(h) P(w); P(w) is the discounted share of the word, else the mass that discounting
leaves to the one event "unknown". Counts of 1 to 5 are discounted, by Katz's formula; where its estimates are no proper
discounts for the counts at hand, fewer are. alpha(h) is (1 - sum of P(w | h)) / (1 - sum of P(w)) over the words seen after h,
so that each context's probabilities sum to one exactly; a context none of whose counts is discounted counts one event
more, which leaves mass to the rest. The contexts of the model are the beginning of a text and all training words; with `share`
only those that make up at least that share of the training tokens, others have no bigrams and alpha 1.

1. Word counts by hash of the word: N, V, counts of counts, the frequent words. There are at most 1 / FREQUENT of these whatever
   the input; their table is sent to every task. It decides only how rows are dealt out and packed.
2. Bigram occurrences, one row per document and bigram, dealt by the hash of their last word, or of the bigram if that word
   is frequent; so a frequent word is split over the parts, and its count is known anyway. Rows travel as packed blocks.
3. Each part counts its bigrams and sends, for each context it meets, their counts of counts and seen word mass to the bucket that
   the context's hash falls into. Buckets add them up, so the contexts are a table partitioned by context. Counts of counts of
   all buckets give the discounts.
4. Buckets answer each part with the events and backoff weights of the contexts it asked for, in blocks.
5. Each part evaluates its tokens: bigram, else backoff weight and word, else unknown; sums by document add up to the scores.
   Steps 2 to 5 are one plan, so that what 3 and 5 both read is shuffled once.

Words are 64-bit hashes. Nulls and edges: a null text is an empty one and has one token, its end. Rows that repeat a key and a
text are trained on and scored each. With no training tokens every token is unknown and has probability 1. Other columns
pass unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import byte_words, cut, integer_key, lowered, mixed, partition_keys, slices, word_hashes

#: Words with at least this share of the training tokens count as frequent; contexts need SHARE of them, so all are.
FREQUENT, SHARE = 2.0**-17, 0.0
DISCOUNTED = 5
#: Characters whose tokens are packed together, and training tokens for which there is one part.
CHARS, TOKENS = 8_000_000, 2_000_000
#: Parts that one task takes, one after another; its sums by document are added up before they are sent, so many at a time.
TASK, HELD = 4, 2_000_000
_END, _BEGIN = np.uint64(0x5E17D0C0FFEE0001), np.uint64(0x5E17D0C0FFEE0002)


def discounts(counts: dict[int, int], most: int = DISCOUNTED) -> np.ndarray:
    """Katz's discount ratios for counts 0..most (1 where none): Good-Turing estimates, scaled so that larger counts stay whole. counts: how many events were seen r times."""
    out = np.ones(most + 1)
    for k in range(most, 0, -1):
        n = [counts.get(r, 0) for r in range(k + 2)]
        if not all(n[1 : k + 1]):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = np.array([((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)])
        if ((d > 0) & (d <= 1)).all():
            out[1 : k + 1] = d
            return out
    return out


@dataclass(frozen=True)
class Words:
    """The word level: training tokens, vocabulary, discounts, and the frequent words' hashes (sorted) and counts."""

    total: int
    kinds: int
    ratio: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    seen_mass: float

    @property
    def scale(self) -> float:
        """Events of the word level: one more than the tokens if nothing is discounted."""
        return float(self.total + (self.seen_mass >= self.total))

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w) of words seen so often; 0 times: unknown."""
        left = max(1.0 - self.seen_mass / self.scale, 0.0) if self.total else 1.0
        p = np.where(counts > 0, self.ratio[np.minimum(counts, DISCOUNTED)] ** (counts <= DISCOUNTED) * counts / max(self.scale, 1.0), left)
        return np.log10(p)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.kinds + 1)))

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)


def _total(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place; floating point for no values, too."""
    return np.bincount(at, values, n).astype(np.float64)


#: Rows of a part that one step handles, where arrays of all would add up.
STEP = 2**19


def _steps(n: int) -> Iterator[slice]:
    return (slice(i, min(i + STEP, n)) for i in range(0, n, STEP))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts one after another, each text's closed by the end, and the texts' offsets."""
    data, starts, stops, ends = byte_words(lowered(texts))
    words = word_hashes(data, starts, stops)
    ends = ends + np.arange(len(ends))
    out = np.full(int(ends[-1]), _END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends[1:] - 1] = False
    out[inner] = words
    return out, ends


def word_counts(documents: DataFrame, among: Column, text: str) -> DataFrame:
    """(w, c): the training tokens."""
    source = documents.where(among).select(F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", CHARS):
                w, c = np.unique(tokens(part.column("t"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    return source.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def word_level(counted: DataFrame, frequent: float = FREQUENT) -> Words:
    summed = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]).first()
    total = summed.n or 0
    ratio = discounts({r: summed[f"n{r}"] for r in range(1, DISCOUNTED + 2)})
    seen = total - sum((1 - ratio[r]) * r * summed[f"n{r}"] for r in range(1, DISCOUNTED + 1))
    rows = counted.where(F.col("c") >= max(1.0, frequent * total)).collect() if total else []  # at most 1 / frequent words
    hashes = np.array([r.w for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Words(total, summed.v, ratio, hashes[order], np.array([r.c for r in rows], np.int64)[order], float(seen))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each in planes of equal significance."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x)
        planes = zlib.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), 1)
        out.append(len(raw).to_bytes(8, "little") + len(planes).to_bytes(8, "little") + raw.dtype.str.encode().ljust(8) + planes)
    return b"".join(out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, size, kind = int.from_bytes(blob[at : at + 8], "little"), int.from_bytes(blob[at + 8 : at + 16], "little"), np.dtype(blob[at + 16 : at + 24].strip().decode())
        planes = np.frombuffer(zlib.decompress(blob[at + 24 : at + 24 + size]), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 24 + size
    return out


def occurrences(documents: DataFrame, level: Words, parts: int, *, text: str, key: str, held_out: Column) -> DataFrame:
    """(p, docs, rows): packed blocks of bigram occurrences with their documents, and, with null rows, of each document and what could be evaluated at once."""
    source = documents.select(integer_key(documents, key).alias("k"), F.col(text).alias("t"), held_out.alias("held"), F.xxhash64(key, text).alias("rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", CHARS):  # a batch has fewer than 2**20 rows
                words, ends = tokens(part.column("t"))
                n = len(ends) - 1
                doc = np.repeat(np.arange(n), np.diff(ends))
                kinds, word = np.unique(words, return_inverse=True)
                place = level.find(kinds)
                frequent = place >= 0
                count = np.where(frequent, level.counts[place] if len(level.counts) else 0, 0)
                marks = np.append(kinds, _BEGIN)
                context = np.concatenate([[0], word[:-1]])
                context[ends[:-1]] = len(kinds)
                # Frequent words' base scores need no other rows.
                known = frequent[word]
                base = _total(doc[known], level.log_base(count)[word[known]], n)
                rid = part.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                told = _documents(part.column("k"), rid, held, np.diff(ends), np.bincount(doc[known], minlength=n), base)
                yield pa.RecordBatch.from_arrays([pa.array((mixed(rid[:1].view(np.uint64)) % np.uint64(parts)).astype(np.int32)), pa.array([told]), pa.array([None], pa.binary())], names=["p", "docs", "rows"])
                pair = word * len(marks) + context
                if len(kinds) * len(marks) * n >= 2**63:
                    own, pair = np.unique(pair, return_inverse=True)
                else:
                    own = None
                keys, times = np.unique(pair * n + doc, return_counts=True)
                pair, d = np.divmod(keys, n)
                w, c = np.divmod(pair if own is None else own[pair], len(marks))
                del pair, keys, context, words
                # 0: a context whose hash is told; 1: the beginning; else a frequent word.
                code = np.append(np.where(frequent, place + 2, 0), 1).astype(np.uint32)
                spread = np.where(frequent[w], mixed(kinds[w] + marks[c]), mixed(kinds[w]))
                dealt = (spread % np.uint64(parts)).astype(np.int64)
                order = np.argsort(dealt, kind="stable")
                edges = np.searchsorted(dealt[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    at = order[edges[p] : edges[p + 1]]
                    own, inverse = np.unique(w[at], return_inverse=True)
                    ds, di = np.unique(d[at], return_inverse=True)
                    cs, ci = np.unique(c[at], return_inverse=True)
                    rare = marks[cs[code[cs] == 0]]
                    block = _packed(kinds[own], np.bincount(inverse).astype(np.uint32), code[cs], rare, _index(ci, len(cs)), _index(di, len(ds)), np.minimum(times[at], 255).astype(np.uint8), times[at][times[at] >= 255].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(rid[ds], held[ds].astype(np.uint8))]), pa.array([block])], names=["p", "docs", "rows"])

    return source.mapInArrow(run, "p int, docs binary, rows binary")


def _index(at: np.ndarray, n: int) -> np.ndarray:
    return at.astype(np.uint16 if n < 2**16 else np.uint32)


def _documents(keys: pa.Array, rid, held, n, known, base) -> bytes:
    null = keys.is_null().to_numpy(zero_copy_only=False)
    return _packed(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null.astype(np.uint8), rid, held.astype(np.uint8), n.astype(np.int64), known.astype(np.int64), base)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one value of the first column after another."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
        del batch
    if held:
        yield held


class _Part:
    """The rows of one part: documents, and by row the pair (word, context) it belongs to; for each pair its training count, for each word its own; the contexts' hashes."""

    def __init__(self, rows: list[tuple[bytes, bytes]], level: Words):
        """Takes the rows out of the list."""
        rids, helds, kinds, sizes, marks, contexts, docs, times = [], [], [], [], [], [], [], []
        while rows:
            d, r = rows.pop()
            rid, held = _unpacked(d)
            own, per, code, rare, c, di, n, large = _unpacked(r)
            if len(large):
                n = n.astype(np.int64)
                n[n == 255] = large
            mark = np.full(len(code), _BEGIN, np.uint64)
            mark[code == 0] = rare
            mark[code > 1] = level.hashes[code[code > 1] - 2]
            for x, y in zip((rids, helds, kinds, sizes, marks, contexts, docs, times), (rid, held.astype(bool), own, per, mark, c, di, n), strict=True):
                x.append(y)
        lengths = [len(x) for x in docs]
        n = sum(lengths)
        self.words, word = np.unique(np.concatenate(kinds), return_inverse=True)
        self.marks, mark = np.unique(np.concatenate(marks), return_inverse=True)
        of_kinds, of_marks = np.cumsum([0, *map(len, kinds)]), np.cumsum([0, *map(len, marks)])
        key, at = np.empty(n, np.int64), np.cumsum([0, *lengths])
        for i in range(len(docs)):
            key[at[i] : at[i + 1]] = np.repeat(word[of_kinds[i] : of_kinds[i + 1]], sizes[i]) * len(self.marks) + mark[of_marks[i] : of_marks[i + 1]][contexts[i]]
        del kinds, sizes, marks, contexts, word, mark
        base = np.cumsum([0, *map(len, rids)])
        self.doc = np.empty(n, np.int32)
        for i, x in enumerate(docs):
            self.doc[at[i] : at[i + 1]] = x
            self.doc[at[i] : at[i + 1]] += base[i]
        del docs
        self.times, self.rid, held = np.concatenate(times), np.concatenate(rids), np.concatenate(helds)
        del times, rids, helds
        pairs = np.sort(key)
        first = np.ones(n, bool)
        first[1:] = pairs[1:] != pairs[:-1]
        pairs = pairs[first]
        del first
        self.pair = np.empty(n, np.int32 if n < 2**31 else np.int64)
        for s in _steps(n):
            self.pair[s] = np.searchsorted(pairs, key[s])
        del key
        self.word, self.context = np.divmod(pairs, len(self.marks))
        del pairs
        self.count = self.sums(self.pair, len(self.word), lambda s: np.where(held[self.doc[s]], 0, self.times[s])).astype(np.int64)
        place = level.find(self.words)
        self.frequent = place >= 0
        counted = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)
        self.word_count = np.where(self.frequent, level.counts[place] if len(level.counts) else 0, counted)


    def sums(self, at: np.ndarray, n: int, values) -> np.ndarray:
        """Sums by place of what `values` gives for a slice of the rows."""
        out = np.zeros(n)
        for s in _steps(len(at)):
            out += np.bincount(at[s], values(s), n)
        return out

    def buckets(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """The places of the contexts that fall into each bucket."""
        bucket = (mixed(self.marks + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(parts + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            yield b, order[edges[b] : edges[b + 1]]


def asked(packed: DataFrame, level: Words, parts: int) -> DataFrame:
    """(b, p, told): for each bucket what a part knows of its contexts: their hashes, the occurrences of their bigrams, how many bigrams occur 1 to 6 times, the word mass after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            p, blocks = rows[0][0], [(d, r) for _, d, r, _ in rows if r is not None]
            rows.clear()
            if not blocks:
                continue
            part = _Part(blocks, level)
            del part.doc, part.pair, part.times
            seen = part.count > 0
            at, count, n = part.context[seen], part.count[seen], len(part.marks)
            columns = [_total(at, count, n).astype(np.int64), *(np.bincount(at[count == r], minlength=n).astype(np.uint32) for r in range(1, DISCOUNTED + 2)), _total(at, 10.0 ** level.log_p(part.word_count[part.word[seen]]), n)]
            del seen, at, count
            told = [(b, p, _packed(part.marks[i], *[x[i] for x in columns])) for b, i in part.buckets(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*told, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["b", "p", "told"])

    return packed.sortWithinPartitions("p").mapInArrow(run, "b int, p int, told binary")


def _context_masses(told: list[bytes], least: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of one bucket: each told context's place among the distinct ones, their sums, and which of them the model has."""
    parts = [_unpacked(x) for x in told]
    marks, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    sums = [_total(at, np.concatenate([x[j] for x in parts]), len(marks)) for j in range(1, DISCOUNTED + 4)]
    return at, sums, (sums[0] >= least) | (marks == _BEGIN)


_SEEN = [f"n{r}" for r in range(1, DISCOUNTED + 2)]


def counts_of_counts(told: DataFrame, least: float) -> DataFrame:
    """One row: how many bigrams of the model occur 1 to 6 times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            _, sums, inside = _context_masses([x for *_, x in rows], least)
            yield pa.RecordBatch.from_arrays([pa.array([int(x[inside].sum())]) for x in sums[1:-1]], names=_SEEN)

    return told.sortWithinPartitions("b").mapInArrow(run, ", ".join(f"{c} long" for c in _SEEN)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SEEN])


def answered(told: DataFrame, least: float) -> DataFrame:
    """(p, b, events, n1, ...): for each part and bucket the contexts' events (0: none of the model) and log10 of their backoff weights, in the order they were asked for; and the counts of counts."""
    source = told.crossJoin(F.broadcast(counts_of_counts(told, least))).sortWithinPartitions("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            at, (total, *seen, words), inside = _context_masses([x[2] for x in rows], least)
            counts = rows[0][3:]
            ratio = discounts(dict(enumerate(counts, 1)))
            mass = total - sum((1 - ratio[r]) * r * seen[r - 1] for r in range(1, DISCOUNTED + 1))
            size = total + (mass >= total)
            weight = np.where(inside, np.log10(1 - mass / size) - np.log10(1 - words), 0.0)
            size = np.where(inside, size, 0).astype(np.int64)
            edges = np.cumsum([0, *[int.from_bytes(x[2][:8], "little") for x in rows]])
            blocks = [_packed(size[at[a:z]], weight[at[a:z]]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows], pa.int32()), pa.array([x[0] for x in rows], pa.int32()), pa.array(blocks, pa.binary()), *[pa.array([c] * len(rows), pa.int64()) for c in counts]], names=["p", "b", "events", *_SEEN])

    return source.mapInArrow(run, ", ".join(["p int, b int, events binary", *[f"{c} long" for c in _SEEN]]))


def score_documents(documents: DataFrame, held_out: Column, *, text: str = "text", key: str = "doc_id", share: float = SHARE, frequent: float = FREQUENT) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows that are held out teach nothing; all are scored."""
    counted = cut(word_counts(documents, ~held_out, text))
    level = word_level(counted, frequent)
    parts = max(8, -(-level.total // TOKENS))
    tasks = max(8, -(-parts // TASK))
    dealt = F.expr(f"element_at(array({', '.join(map(str, partition_keys(tasks)))}), p % {tasks} + 1)")  # a partition for each run of parts
    packed = occurrences(documents, level, parts, text=text, key=key, held_out=held_out).withColumn("q", dealt).repartition(tasks, "q")
    told = asked(packed, level, parts).repartition(tasks, "b")
    answers = answered(told, max(1.0, share * level.total)).withColumn("q", dealt).repartition(tasks, "q")

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        sent: list[tuple] = []

        def add_up() -> None:
            rid, known, base, score = (np.concatenate(x) for x in zip(*sent, strict=True))
            sent.clear()
            own, at = np.unique(rid, return_inverse=True)
            zero = np.zeros(len(own), np.int64)
            out.append(_summed(own, pa.nulls(len(own), pa.int64()), zero, zero, zero, np.bincount(at, known).astype(np.int64), _total(at, base, len(own)), _total(at, score, len(own))))

        of_block, of_reply = (x.column("p").to_numpy() for x in (blocks, replies))
        ratio = discounts({r: replies.column(c)[0].as_py() for r, c in enumerate(_SEEN, 1)}) if len(of_reply) else None
        for p in np.unique(of_block).tolist():
            rows = []
            for i in np.flatnonzero(of_block == p).tolist():
                d, r = blocks.column("docs")[i].as_py(), blocks.column("rows")[i].as_py()
                if r is not None:
                    rows.append((d, r))
                    continue
                k, null, rid, held, tokens_, known, base = _unpacked(d)
                out.append(_summed(rid, pa.array(k, mask=null.astype(bool)), held.astype(np.int64), tokens_, np.ones(len(rid), np.int64), known, base, np.zeros(len(rid))))
            if not rows:
                continue
            part = _Part(rows, level)
            place = {replies.column("b")[i].as_py(): i for i in np.flatnonzero(of_reply == p).tolist()}
            size, weight = np.zeros(len(part.marks)), np.zeros(len(part.marks))
            for b, at in part.buckets(parts):
                size[at], weight[at] = _unpacked(replies.column("events")[place[b]].as_py())
            of_word = part.word_count[part.word]
            backed = level.log_p(of_word)
            c = part.context
            seen = (part.count > 0) & (size[c] > 0)
            count = np.maximum(part.count, 1)
            log_p = np.where(seen, np.log10(np.where(count <= DISCOUNTED, ratio[np.minimum(count, DISCOUNTED)], 1.0) * count / np.maximum(size[c], 1)), weight[c] + backed)
            del seen, count, backed
            rare = ~part.frequent[part.word]
            log_base, known = np.where(rare, level.log_base(of_word), 0.0), rare & (of_word > 0)
            own, at = np.unique(part.rid, return_inverse=True)
            doc = at.astype(np.int32)[part.doc]
            sent.append((own, *(part.sums(doc, len(own), lambda s, x=x: x[part.pair[s]] * part.times[s]) for x in (known, log_base, log_p))))
            del part, doc
            if sum(len(x[0]) for x in sent) > HELD:
                add_up()
        if sent:
            add_up()
        return pa.Table.from_batches(out)

    added = packed.groupBy("q").cogroup(answers.groupBy("q")).applyInArrow(run, "rid long, k long, held long, n_tokens long, copies long, known long, base double, score double")
    total = cut(added.groupBy("rid").agg(F.max("k").alias("k"), F.max("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_tokens", "copies", "known", "base", "score")]))
    each = total.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    whole = [(F.col(c) / F.col("copies")).cast("long").alias(name) for c, name in (("n_tokens", "n_tokens"), ("known", "n_known"))]
    return each.select(F.col("k").alias(key), (F.col("held") > 0).alias("held_out"), *whole, F.lit(level.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def _summed(rid, k, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), k, *map(pa.array, columns)], names=["rid", "k", "held", "n_tokens", "copies", "known", "base", "score"])
