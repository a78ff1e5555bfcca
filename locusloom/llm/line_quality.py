"""Quality rules by line sequence labelling: a linear-chain CRF marks each line as content or boilerplate.

`fit` learns the field from documents labelled good or bad (a bounded sample, see `max_docs`), `label_lines` returns the
Viterbi label of each line, `score_documents` the base counts of each document, the content share and the verdict.

Lines are the parts of a text between line feeds. A line's features are buckets of what it is made of (symbols, case,
digits, punctuation, word lengths, repetition), never its words, so the field carries over to new vocabularies.
Training chains are spliced from runs of lines of good and bad documents: that gives the transitions, which documents
of one label alone could not show.

Nulls and edges: a null text counts as an empty one and has one empty line; an empty text has no words, fails the base
rules and is not kept. Rows are independent, so repeated rows get the same answer. Other columns pass unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm import crf
from locusloom.llm.common import byte_words, in_small_batches, kept_columns, mixed, order_hash, pieces_of, release, slices, word_hashes

BOILERPLATE, CONTENT = 0, 1
#: Labels of training documents: at most so many of each, those first by hash of doc_id.
MAX_DOCS = 1500
CHAIN = 24
#: A document is kept if at least this share of its words stands in lines labelled content.
MIN_SHARE = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_LINK = re.compile(rb"https?://|\S@\S+\.\S")

#: Line measures with the cuts between their buckets: what is counted, per what, cuts.
_MEASURES = (
    ("symbols", "words", (0.0, 0.02, 0.1, 0.3, 0.7)),
    ("upper", "letters", (0.0, 0.05, 0.15, 0.4, 0.8)),
    ("digits", "chars", (0.0, 0.03, 0.1, 0.3)),
    ("letters", "chars", (0.3, 0.5, 0.65, 0.75, 0.85)),
    ("marks", "words", (0.0, 0.1, 0.3, 0.6, 1.0)),
    ("shouts", "words", (0.0, 0.05, 0.3, 1.0)),
    ("letters", "words", (1.5, 3.0, 4.0, 5.5, 8.0, 12.0)),
    ("words", "", (2, 5, 10, 30, 100)),
    ("links", "", (0, 1)),
)
_WIDTH = 8
_BLANK = _WIDTH * (len(_MEASURES) + 2)
N_FEATURES = _BLANK + 1


def _table(wanted: str) -> np.ndarray:
    """1 for each byte of the class. Bytes that begin a character beyond ASCII count as letters."""
    lead = {*range(0xC2, 0xF5)}
    kinds = {
        "symbols": {*SYMBOLS.encode()},
        "upper": {*range(65, 91)},
        "letters": {*range(65, 91), *range(97, 123), *lead},
        "digits": {*range(48, 58)},
        "shouts": {33, 63},
        "marks": {x for x in range(33, 127) if not chr(x).isalnum()},
        "chars": {x for x in range(256) if x & 0xC0 != 0x80},
    }
    return np.isin(np.arange(256), list(kinds[wanted])).astype(np.uint8)


_CLASSES = {x: _table(x) for x in ("symbols", "upper", "letters", "digits", "shouts", "marks", "chars")}
#: How a line's last word may end: sentence marks, other marks, symbols; everything else is 3.
_LAST = np.full(256, 3)
for _kind, _marks in ((0, ".!?\"')"), (1, ",;:"), (2, SYMBOLS)):
    _LAST[list(_marks.encode())] = _kind


@dataclass
class Lines:
    """The lines of some texts: word hashes, words and lines of all texts, and the texts' offsets in them."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    word_ends: np.ndarray
    line_starts: np.ndarray
    line_stops: np.ndarray
    line_ends: np.ndarray
    words: np.ndarray
    again: np.ndarray
    features: np.ndarray


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of disjoint, ordered runs of the values, without a running sum of all."""
    if not len(starts):
        return np.zeros(0, np.int64)
    padded = np.append(values, values.dtype.type(0))
    total = np.add.reduceat(padded, np.stack([starts, stops], 1).ravel(), dtype=np.int64)[::2]
    return np.where(stops > starts, total, 0)


def read_lines(texts: pa.Array) -> Lines:
    """Splits texts into lines and measures them; null texts are empty."""
    data, starts, stops, word_ends = byte_words(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    breaks = np.flatnonzero(data == 10)
    # Each text has one line more than line feeds.
    line_ends = np.searchsorted(breaks, ends) + np.arange(len(ends))
    line_starts, line_stops = np.empty(int(line_ends[-1]), np.int64), np.empty(int(line_ends[-1]), np.int64)
    after = np.ones(len(line_starts), bool)
    after[line_ends[:-1]] = False
    line_starts[line_ends[:-1]], line_starts[after] = ends[:-1], breaks + 1
    before = np.ones(len(line_stops), bool)
    before[line_ends[1:] - 1] = False
    line_stops[line_ends[1:] - 1], line_stops[before] = ends[1:], breaks
    first = np.searchsorted(starts, line_starts)
    words = np.searchsorted(starts, line_stops) - first
    count = {k: _sums(v[data], line_starts, line_stops) for k, v in _CLASSES.items()} | {"words": words}
    raw, again, links = data.tobytes(), np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    odd = _sums((data == 64) | (data == 58), line_starts, line_stops) > 0
    for t in range(len(sizes)):
        seen = set()
        for i in range(line_ends[t], line_ends[t + 1]):
            if words[i]:
                line = raw[line_starts[i] : line_stops[i]]
                again[i] = line in seen
                seen.add(line)
                if odd[i]:
                    links[i] = len(_LINK.findall(line))
    count["links"] = links
    columns = []
    for k, (what, per, cuts) in enumerate(_MEASURES):
        value = count[what] / np.maximum(count[per], 1) if per else count[what]
        columns.append(_WIDTH * k + np.searchsorted(cuts, value, side="left"))
    columns.append(_WIDTH * len(_MEASURES) + again)
    last = np.zeros(len(words), np.int64)
    last[words > 0] = _LAST[data[stops[(first + words - 1)[words > 0]] - 1]]
    columns.append(_WIDTH * (len(_MEASURES) + 1) + last)
    features = np.stack(columns, 1)
    features[words == 0] = _BLANK
    return Lines(data, starts, stops, word_ends, line_starts, line_stops, line_ends, words, again, features)


@dataclass(frozen=True)
class LineField:
    """Emission weights by feature and label, transitions by label and next label."""

    weights: np.ndarray
    moves: np.ndarray

    def label(self, lines: Lines) -> np.ndarray:
        """The Viterbi label of each line."""
        return crf.viterbi(self.weights[lines.features].sum(1), lines.line_ends, self.moves)


def fit_lines(good: list[str], bad: list[str], seed: int = 7) -> LineField:
    """The field learnt from chains spliced of runs of lines of good and of bad texts; without one of the two kinds, a field that calls every line content."""
    features = lambda texts: (got := read_lines(pa.array(texts, pa.string()))).features[got.words > 0]
    pools = [np.concatenate([np.zeros((0, len(_MEASURES) + 2), np.int64), *map(features, pieces_of(texts))]) for texts in (bad, good)]
    if not all(map(len, pools)):
        return LineField(np.tile([0.0, 1.0], (N_FEATURES, 1)), np.zeros((2, 2)))
    rng = np.random.default_rng(seed)
    n = max(64, min(4000, sum(map(len, pools)) // CHAIN))
    rows, labels = [], np.zeros((n, CHAIN), np.int64)
    for c in range(n):
        t, y = 0, int(rng.integers(2))
        while t < CHAIN:
            run = min(int(rng.geometric(0.12)), CHAIN - t)
            rows.append(pools[y][(int(rng.integers(len(pools[y]))) + np.arange(run)) % len(pools[y])])
            labels[c, t : t + run] = y
            t, y = t + run, 1 - y
    flat = np.concatenate(rows)
    return LineField(*crf.train(flat.ravel(), np.arange(len(flat) + 1) * flat.shape[1], labels, N_FEATURES, 2, epochs=6, batch=128, rate=0.1, l2=1e-3, seed=seed))


def fit(documents: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", max_docs: int = MAX_DOCS) -> LineField:
    """Learns from at most max_docs documents of label 1 and as many of label 0. Null and other labels teach nothing; a key labelled both ways counts for neither."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select(F.col(key).alias("k"), "y")
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(order_hash(F.col("k")), "k").limit(max_docs).collect()]
    if not chosen:
        return fit_lines([], [])
    picked = documents.sparkSession.createDataFrame(chosen, marked.schema)  # at most 2 * max_docs rows
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(picked), "k").groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: (str(r.k), r.t))
    made = fit_lines([r.t for r in rows if r.y == 1], [r.t for r in rows if r.y == 0])
    del rows
    release()
    return made


def repeated_words(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text the words in 3-word windows that occur twice or more in it. ids: the texts' words one after another."""
    n = len(ids) - 2
    if n < 1:
        return np.zeros(len(ends) - 1, np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = owner[:-2] == owner[2:]
    keys = mixed(mixed(mixed(ids[:-2] + owner[:-2].astype(np.uint64)) + ids[1:-1]) + ids[2:])
    at = np.flatnonzero(inside)
    order = at[np.argsort(keys[at])]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(ids), bool)
    for shift in range(3):
        hit[shift : shift + n] |= twice
    return _sums(hit, ends[:-1], ends[1:])


def base_counts(lines: Lines) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    letters = _sums(_sums(_CLASSES["chars"][lines.data], lines.starts, lines.stops), lines.word_ends[:-1], lines.word_ends[1:])
    symbols = _sums(_sums(_CLASSES["symbols"][lines.data], lines.line_starts, lines.line_stops), lines.line_ends[:-1], lines.line_ends[1:])
    repeated = repeated_words(word_hashes(lines.data, lines.starts, lines.stops), lines.word_ends)
    return {"n_words": np.diff(lines.word_ends), "word_chars": letters, "n_symbols": symbols, "n_dup_lines": _sums(lines.again, lines.line_ends[:-1], lines.line_ends[1:]), "n_repeat_words": repeated}


def score_documents(documents: DataFrame, field: LineField, *, text: str = "text", keep: list[str] | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """Columns `keep` of each row with its base counts, base_failed, the words in content lines, content_share (null without words) and kept."""
    keep = kept_columns(documents, keep, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "content_share", "kept"])
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, content_share double, kept boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                lines = read_lines(part.column("_text"))
                out = base_counts(lines)
                n = out["n_words"]
                content = _sums(np.where(field.label(lines) == CONTENT, lines.words, 0), lines.line_ends[:-1], lines.line_ends[1:])
                failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
                share = content / np.maximum(n, 1)
                columns = [*part.columns[:-1], *(pa.array(x, pa.int64()) for x in out.values()), pa.array(failed), pa.array(content, pa.int64()), pa.array(share, mask=n == 0), pa.array(~failed & (share >= min_share))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(x.split()[0] for x in added.split(", "))])

    return in_small_batches(source).mapInArrow(run, f"{schema}, {added}" if schema else added)


def label_lines(documents: DataFrame, field: LineField, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per line: key, line_no, line, content (the Viterbi label)."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = read_lines(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(lines.line_ends))
                texts = [y for x in part.column("text").to_pylist() for y in (x or "").split("\n")]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(owner)), pa.array(np.arange(len(owner)) - lines.line_ends[owner], pa.int64()), pa.array(texts, pa.string()), pa.array(field.label(lines) == CONTENT)], names=["key", "line_no", "line", "content"])

    return in_small_batches(source).mapInArrow(run, f"key {kind}, line_no long, line string, content boolean").withColumnRenamed("key", key)


