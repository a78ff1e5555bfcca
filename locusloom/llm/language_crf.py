"""Language labels of words in code-switched text by a linear-chain CRF, decoded by forward-backward.

Word features are affixes (first and last two, three and four bytes), byte bigrams, trigrams and four-grams, and the
whole word (the lexicon), hashed into one weight table per run of features. Transitions are learnt too: training chains
splice runs of words of different languages, since documents of one label never show a switch.

`fit` learns from a bounded sample of labelled documents (`max_docs` of each label, those first by hash of the key).
`label_words` gives the label and its posterior for every word of a text, `label_documents` the language with the highest
mean posterior over the words that hold a letter, with that mean as score.

Nulls and edges: a text that is null or holds no letter is `und` with score 0. Repeated rows get the same answer. Labels
that are null teach nothing. Without any labelled text every answer is `und`. Other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm import crf
from locusloom.llm.common import byte_words, in_small_batches, kept_columns, mixed, order_hash, release, slices, word_hashes

UNKNOWN = "und"
#: Training documents of each label at most.
MAX_DOCS = 600
BITS = 16
CHAIN, CHAINS = 32, 6000
_AFFIX, _GRAMS = (2, 3, 4), (2, 3, 4)
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(x + np.uint64(kind * 0x51ED270B)) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words given as ranges of bytes: all rows one after another, and each word's offset in them."""
    n, sizes = len(starts), stops - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    four = padded[:-3] | padded[1:-2] << np.uint64(8) | padded[2:-1] << np.uint64(16) | padded[3:] << np.uint64(24)
    rows, owners = [_bucket(word_hashes(data, starts, stops), 1)], [np.arange(n)]
    for k in _AFFIX:
        mask = np.uint64(2 ** (8 * k) - 1)
        long = np.flatnonzero(sizes >= k)
        rows += [_bucket(four[starts[long]] & mask, 10 + k), _bucket(four[stops[long] - k] & mask, 20 + k)]
        owners += [long, long]
    for k in _GRAMS:
        mask = np.uint64(2 ** (8 * k) - 1)
        count = np.maximum(sizes - k + 1, 0)
        owner = np.repeat(np.arange(n), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        rows.append(_bucket(four[at] & mask, 30 + k))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


@dataclass(frozen=True)
class LanguageField:
    labels: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Posteriors (words, labels), whether each word holds a letter, the texts' offsets, and the words as byte ranges."""
        data, starts, stops, ends = byte_words(lower(texts))
        ids, first, inverse = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        feats, at = word_features(data, starts[first], stops[first])
        scores = np.add.reduceat(self.weights[feats], at[:-1]) if len(ids) else np.zeros((0, len(self.labels)), np.float32)
        letters, beyond = (np.concatenate([[0], np.cumsum(x)]) for x in (_LETTER[data], data >= 128))
        begin, end = starts[first], stops[first]
        own = letters[end] > letters[begin]
        for i in np.flatnonzero(~own & (beyond[end] > beyond[begin])).tolist():  # no letter of ASCII
            own[i] = any(c.isalpha() for c in data[begin[i] : end[i]].tobytes().decode(errors="replace"))
        lettered = own[inverse]
        return crf.posteriors(scores[inverse].astype(np.float64), ends, self.moves), lettered, ends, (data, starts, stops)

    def documents(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score."""
        n, k = len(texts), len(self.labels)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        post, lettered, ends, _ = self.words(texts)
        owner = np.repeat(np.arange(n), np.diff(ends))
        count = np.bincount(owner[lettered], minlength=n)
        means = np.stack([np.bincount(owner[lettered], post[lettered, y], n) for y in range(k)], 1) / np.maximum(count, 1)[:, None]
        best = means.argmax(1)
        return [self.labels[y] if c else UNKNOWN for y, c in zip(best, count, strict=True)], np.where(count > 0, np.minimum(means.max(1), 1.0), 0.0)


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def fit_texts(texts: dict[str, list[str]], *, chains: int = CHAINS, seed: int = 11) -> LanguageField:
    """The field learnt from chains spliced of runs of words of texts of each label."""
    pools, names = [], []
    for label in sorted(texts):
        data, starts, stops, _ = byte_words(lower(pa.array(texts[label], pa.string())))
        if len(starts):
            names.append(label)
            pools.append((data, starts, stops))
    k = len(names)
    if not k:
        return LanguageField((), np.zeros((2**BITS, 0), np.float32), np.zeros((0, 0)))
    offsets = np.cumsum([0, *[len(p[0]) for p in pools]])
    data = np.concatenate([p[0] for p in pools])
    begin = [p[1] + o for p, o in zip(pools, offsets, strict=False)]
    end = [p[2] + o for p, o in zip(pools, offsets, strict=False)]
    rng = np.random.default_rng(seed)
    labels, words = np.zeros((chains, CHAIN), np.int64), []
    for c in range(chains):
        t, y = 0, int(rng.integers(k))
        while t < CHAIN:
            run = min(int(rng.geometric(0.1)), CHAIN - t)
            at = (int(rng.integers(len(begin[y]))) + np.arange(run)) % len(begin[y])
            words.append(np.stack([begin[y][at], end[y][at]]))
            labels[c, t : t + run] = y
            t, y = t + run, (y + int(rng.integers(1, k))) % k if k > 1 else 0
    chosen = np.concatenate(words, 1)
    feats, at = word_features(data, chosen[0], chosen[1])
    weights, moves = crf.train(feats, at, labels, 2**BITS, k, epochs=3, batch=256, rate=0.05, l2=1e-5, seed=seed)
    return LanguageField(tuple(names), weights.astype(np.float32), moves)


def fit(documents: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", among: Column | None = None, max_docs: int = MAX_DOCS) -> LanguageField:
    """Learns from at most max_docs documents of each non-null label, of the rows `among`."""
    pool = documents.where(F.col(lang).isNotNull() & (among if among is not None else F.lit(True)))
    ranked = pool.select(F.col(key).alias("k"), F.col(lang).alias("y"), order_hash(F.col(key)).alias("h")).dropDuplicates(["k", "y"])
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "k"))).where(F.col("r") <= max_docs).select("k", "y")
    rows = pool.select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(first), ["k", "y"]).groupBy("y", "k").agg(F.max("t").alias("t")).collect()  # max_docs a label
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.y, str(r.k))):
        texts.setdefault(r.y, []).append(r.t)
    made = fit_texts(texts)
    del rows, texts
    release()
    return made


def label_documents(documents: DataFrame, field: LanguageField, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row with lang_pred and score."""
    keep = kept_columns(documents, keep, ["lang_pred", "score"])
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                langs, scores = field.documents(part.column("_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return in_small_batches(source).mapInArrow(run, ", ".join([*schema, "lang_pred string", "score double"]))


def label_words(documents: DataFrame, field: LanguageField, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per word: key, word_no, word, lang (highest posterior), posterior."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                post, _, ends, _ = field.words(part.column("text"))
                words = [w.decode() for x in part.column("text").to_pylist() for w in (x or "").encode().split()]
                owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
                best = post.argmax(1) if len(post) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(owner)), pa.array(np.arange(len(owner)) - ends[owner], pa.int64()), pa.array(words, pa.string()), pa.array([field.labels[y] for y in best], pa.string()), pa.array(post.max(1) if len(post) else [], pa.float64())], names=["key", "word_no", "word", "lang", "posterior"])

    return in_small_batches(source).mapInArrow(run, f"key {kind}, word_no long, word string, lang string, posterior double").withColumnRenamed("key", key)
