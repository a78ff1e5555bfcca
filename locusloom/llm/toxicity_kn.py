"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the bytes of words, one learnt from toxic and one from ordinary documents, give
each word a log-likelihood under either class. Orders above `SHARED` are conditional on the class; below them both back
off to the same continuation counts, gathered over both classes, so that expressions too rare to tell the classes apart
are equally likely under both. A text's words are compared by length-normalised log-likelihoods: over the whole text, and
over its best window of words, so that a short insult in a long text is not averaged away. A logistic curve over these,
fitted to labelled documents that the models have not seen, turns them into a score from 0 to 1.

`fit` learns from a bounded sample of the labelled rows it is given (`max_docs` of each class for the models and as many
rows for the curve, those first by hash of the key). The model holds one number for each n-gram of that sample.

Nulls and edges: null and empty texts have no words and get the score of a text in which nothing speaks for either class.
Labels other than 0 and 1, and keys labelled both ways, teach nothing; without both classes every score is 0. Repeated
rows get the same score. Other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import byte_words, in_small_batches, kept_columns, order_hash, pieces_of, release, slices, word_hashes

#: Bytes of the longest n-gram; at most 8, so that one fits a 64-bit key.
ORDER = 6
#: Orders up to this one are shared by both classes.
SHARED = 2
DISCOUNT = 0.75
MAX_DOCS = 4000
WINDOW = 8
_BEGIN, _END = 1, 2


def word_grams(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end mark: the ORDER bytes up to it as a key (zeros before the begin mark), and the owning word."""
    sizes = stops - starts + 2
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(owner)) - offsets[owner]
    line = np.empty(len(owner), np.uint64)
    inner = (place > 0) & (place < sizes[owner] - 1)
    line[place == 0], line[place == sizes[owner] - 1] = _BEGIN, _END
    line[inner] = data[starts[owner[inner]] + place[inner] - 1]
    keys = line.copy()
    for back in range(1, ORDER):
        ok = np.flatnonzero(place >= back)
        keys[ok] |= line[ok - back] << np.uint64(8 * back)
    told = place > 0
    return keys[told], owner[told]


def _tail(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return keys & np.uint64(2 ** (8 * n) - 1) if n < 8 else keys


class _Level:
    """Interpolated Kneser-Ney of one order: discounted counts of n-grams and the weight of what lies below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order].astype(np.float64)
        context = self.grams >> np.uint64(8)
        self.contexts, first = np.unique(context, return_index=True)
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        kinds = np.diff(np.append(first, len(context)))
        self.weights = DISCOUNT * kinds / self.totals if len(first) else np.zeros(0)

    def parts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The discounted share and the weight of the lower order, for any n-grams."""
        share, weight = np.zeros(len(grams)), np.ones(len(grams))
        if not len(self.grams):
            return share, weight
        context = grams >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        seen = self.contexts[at] == context
        weight[seen] = self.weights[at[seen]]
        g = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[g] == grams
        share[hit] = (self.counts[g[hit]] - DISCOUNT) / self.totals[at[hit]]
        return share, weight


def _continuations(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams with the number of different (n+1)-grams that end in them."""
    return np.unique(_tail(np.unique(_tail(grams, n + 1)), n), return_counts=True)


def levels(grams: list[np.ndarray], counts: list[np.ndarray]) -> list[list[_Level]]:
    """Both classes' levels, lowest order first; the shared ones are the same objects."""
    both = np.concatenate(grams)
    shared = [_Level(*_continuations(both, n)) for n in range(1, SHARED + 1)]
    return [[*shared, *(_Level(*_continuations(g, n)) for n in range(SHARED + 1, ORDER)), _Level(g, c)] for g, c in zip(grams, counts, strict=True)]


def log_likelihood(model: list[_Level], grams: np.ndarray) -> np.ndarray:
    """The natural log-likelihood of each n-gram's last byte."""
    p = np.full(len(grams), 1 / 256)
    for n, level in enumerate(model, 1):
        share, weight = level.parts(_tail(grams, n))
        p = share + weight * p
    return np.log(p)


@dataclass(frozen=True)
class Toxicity:
    """Both models, and the curve over (mean, best window, second best word, length)."""

    models: list
    curve: np.ndarray

    def measures(self, texts: pa.Array) -> np.ndarray:
        """Per text: toxic and ordinary log-likelihood a word, their best difference a word over a window, and the second best word's difference."""
        data, starts, stops, ends = byte_words(pc.utf8_lower(texts))
        out = np.zeros((len(texts), 4))
        if not len(starts) or not self.models:
            return out
        first, inverse = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)[1:]
        grams, owner = word_grams(data, starts[first], stops[first])
        kinds, back = np.unique(grams, return_inverse=True)
        toxic, plain = (np.bincount(owner, log_likelihood(m, kinds)[back], len(first))[inverse] for m in self.models)
        n = np.diff(ends)
        texts_ = np.repeat(np.arange(len(n)), n)
        out[:, 0] = np.bincount(texts_, toxic, len(n)) / np.maximum(n, 1)
        out[:, 1] = np.bincount(texts_, plain, len(n)) / np.maximum(n, 1)
        gap = toxic - plain
        total = np.concatenate([[0], np.cumsum(gap)])
        left = np.minimum(np.arange(len(gap)) + WINDOW, ends[1:][texts_])
        best = (total[left] - total[:-1]) / WINDOW  # shorter windows at a text's end count as padded with neutral words
        at = ends[:-1][n > 0]
        out[n > 0, 2] = np.maximum.reduceat(best, at)
        top = np.maximum.reduceat(gap, at)
        rest = gap.copy()
        holder = np.flatnonzero(gap == np.repeat(top, n[n > 0]))
        rest[holder[np.unique(texts_[holder], return_index=True)[1]]] = -50.0
        second = np.maximum.reduceat(rest, at)
        out[n > 0, 3] = np.where(n[n > 0] > 1, second, 0.0)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        m = self.measures(texts)
        return 1 / (1 + np.exp(-np.clip(design(m) @ self.curve, -30, 30))) if len(self.models) else np.zeros(len(texts))


def design(m: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(m)), m[:, 0] - m[:, 1], m[:, 2], np.clip(m[:, 3], -5, 12)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method with a small penalty on all weights but the constant."""
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [l2 * len(y)] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -2, 2)
    return w


def fit_texts(toxic: list[str], plain: list[str], curve: list[tuple[str, int]]) -> Toxicity:
    """Both models learnt from as many words as there are, and the curve from texts with labels."""
    if not toxic or not plain or len({y for _, y in curve}) < 2:
        return Toxicity([], np.zeros(4))
    grams, counts = [], []
    for texts in (toxic, plain):
        kinds, total = np.zeros(0, np.uint64), np.zeros(0)
        for some in pieces_of(texts):
            data, starts, stops, _ = byte_words(pc.utf8_lower(pa.array(some, pa.string())))
            _, first, times = np.unique(word_hashes(data, starts, stops), return_index=True, return_counts=True)
            keys, owner = word_grams(data, starts[first], stops[first])
            kinds, inverse = np.unique(np.concatenate([kinds, keys]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([total, times[owner]]), len(kinds))
        grams.append(kinds)
        counts.append(total)
    made = Toxicity(levels(grams, counts), np.zeros(4))
    measured = np.concatenate([made.measures(pa.array([t for t, _ in curve[i : i + 500]], pa.string())) for i in range(0, len(curve), 500)])
    return Toxicity(made.models, _logistic(design(measured), np.array([y for _, y in curve], float)))


def fit(documents: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", among: Column | None = None, max_docs: int = MAX_DOCS) -> Toxicity:
    """Learns from the labelled documents `among`: three quarters of them by hash teach the models, the others the curve."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    marked = marked.where(among if among is not None else F.lit(True)).select(F.col(key).alias("k"), "y", order_hash(F.col(key)).alias("h"))
    models = F.substring("h", 1, 1) >= "4"
    parts = [marked.where(models & (F.col("y") == 1)), marked.where(models & (F.col("y") == 0)), marked.where(~models)]
    picked = [(r.k, r.y, i) for i, part in enumerate(parts) for r in part.orderBy("h", "k").limit(max_docs).collect()]
    if not picked:
        return fit_texts([], [], [])
    kind = documents.schema[key].dataType.simpleString()
    sample = documents.sparkSession.createDataFrame(picked, f"k {kind}, y int, part int")  # 3 * max_docs rows at most
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(sample), "k").groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y"), F.max("part").alias("part")).collect()
    rows.sort(key=lambda r: (str(r.k), r.t))
    sides = [[r.t for r in rows if r.part == i] for i in (0, 1)]
    made = fit_texts(sides[0], sides[1], [(r.t, r.y) for r in rows if r.part == 2])
    del rows, sides
    release()
    return made


def score_documents(documents: DataFrame, model: Toxicity, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row with toxic_ll and plain_ll (log-likelihoods a word), best_window, score and predicted."""
    keep = kept_columns(documents, keep, ["toxic_ll", "plain_ll", "best_window", "score", "predicted"])
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                m = model.measures(part.column("_text"))
                scores = 1 / (1 + np.exp(-np.clip(design(m) @ model.curve, -30, 30))) if model.models else np.zeros(len(m))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, (m[:, 0], m[:, 1], m[:, 2], scores)), pa.array((scores >= 0.5).astype(np.int32))], names=[*keep, "toxic_ll", "plain_ll", "best_window", "score", "predicted"])

    return in_small_batches(source).mapInArrow(run, ", ".join([*schema, "toxic_ll double, plain_ll double, best_window double, score double, predicted int"]))
