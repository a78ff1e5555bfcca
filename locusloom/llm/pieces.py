"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary comes from a SentencePiece model file, whose path is a parameter; nothing is trained. A unigram model's
scores are used as they are. The path is an argument, by default what LOCUSLOOM_PIECES names. A BPE model gives ranks instead, and since
tokenizers are not trained here no scores can be estimated: piece number r of its merges gets the log-probability of
Zipf's law, -ln(r + 1) - ln(sum of 1/i). Scores are rounded to multiples of 2**-8, so that sums are exact and ties are
real ties; of equal paths the one with the longer last piece wins.

Text is escaped as the model says: a dummy space in front, then U+2581 for each space. A character that no piece covers
becomes its UTF-8 bytes' pieces. Decoding joins the pieces, turns markers to spaces, takes the dummy space away and reads
runs of byte pieces as UTF-8 (a malformed one as U+FFFD). decode(encode(t)) is t for each t without U+2581.

No piece has a marker after another character, so a best path never crosses the start of a run of spaces, nor a line
feed, which is in no piece. Texts are cut there, the distinct parts of a slice are decoded together, step by step over
all of them, and each text takes its parts' pieces. (Models for which that doesn't hold are decoded text by text.)

Nulls and edges: a null text encodes to null, an empty one to no pieces. Any length of text or word is encoded whole.
Repeated rows get the same pieces. Other columns pass unread.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import in_small_batches, kept_columns, slices, word_hashes

MODEL = os.environ.get("LOCUSLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Inside, the marker U+2581 is one byte that UTF-8 never has.
MARK = 0xFF
#: Parts of at most so many bytes are decoded together, longer ones alone.
LONG = 48
CHARS = 1_000_000
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = data[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    scores: np.ndarray
    dummy_prefix: bool = True


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces and log scores of a SentencePiece model file."""
    pieces, raw, kinds, model, dummy = [], [], [], _UNIGRAM, True
    for field, value in _wire(Path(path).read_bytes()):
        if field == 1:
            got = dict(_wire(value))
            pieces.append(got[1].decode())
            raw.append(struct.unpack("<f", got.get(2, b"\0" * 4))[0])
            kinds.append(got.get(3, _NORMAL))
        elif field == 2:
            model = dict(_wire(value)).get(3, _UNIGRAM)
        elif field == 3:
            rules = dict(_wire(value))
            dummy = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("only models without a character map that keep all spaces are supported")
    scores = np.array(raw, np.float64)
    if model == _BPE:
        normal = np.array([k == _NORMAL for k in kinds])
        order = np.flatnonzero(normal)[np.argsort(-scores[normal], kind="stable")]
        rank = np.arange(1, len(order) + 1)
        scores[order] = -np.log(rank + 1) - np.log((1 / rank).sum())
    return Vocabulary(tuple(pieces), tuple(kinds), np.round(scores * 256) / 256, dummy)


class DoubleArray:
    """A trie over bytes in two arrays: the child of node s by byte c is base[s] + c if check[base[s] + c] == s. value: the piece that ends there, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        size = max(4096, 4 * sum(map(len, keys)) + 1024)
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        taken, low, wide = np.zeros(size, bool), 257, 257
        taken[0] = True
        words = sorted(keys)
        todo = [(0, 0, len(words), 0)]  # node, its range of words, depth
        while todo:
            node, begin, end, depth = todo.pop()
            if begin < end and len(words[begin]) == depth:
                self.value[node] = keys[words[begin]]
                begin += 1
            if begin == end:
                continue
            firsts, at = [], begin
            while at < end:
                c = words[at][depth]
                stop = at
                while stop < end and words[stop][depth] == c:
                    stop += 1
                firsts.append((c, at, stop))
                at = stop
            while taken[low]:
                low += 1
            if len(firsts) == 1:  # one child fills the first hole
                base = low - firsts[0][0]
            else:  # more start where such nodes last found room
                codes = np.array([c for c, _, _ in firsts])
                at = begun = max(wide, low) - int(codes[0])
                while not (free := ~taken[np.arange(at, at + 256)[:, None] + codes].any(1)).any():
                    at += 256
                base = at + int(free.argmax())
                if at > begun + 512:
                    wide = at
            self.base[node] = base
            for c, lo, hi in firsts:
                taken[base + c] = True
                self.check[base + c] = node
                todo.append((base + c, lo, hi, depth + 1))
        used = int(np.flatnonzero(taken)[-1]) + 257
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]


class Encoder:
    """Pieces of texts and texts of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.scores, self.dummy = v.scores, v.dummy_prefix
        inner = [p.replace("▁", "\0").encode().replace(b"\0", bytes([MARK])) for p in v.pieces]
        if any(b"\0" in p.encode() for p, k in zip(v.pieces, v.kinds, strict=True) if k in (_NORMAL, _USER)):
            raise ValueError("a piece has a zero byte")
        keys = {b: i for i, (b, k) in enumerate(zip(inner, v.kinds, strict=True)) if k in (_NORMAL, _USER) and b}
        self.trie = DoubleArray(keys)
        normal = [v.scores[i] for i, k in enumerate(v.kinds) if k == _NORMAL]
        self.unknown_score = (min(normal) if normal else 0.0) - 10.0
        self.unknown = v.kinds.index(_UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if k == _BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.is_byte = np.array([k == _BYTE for k in v.kinds])
        self.parts = not any(bytes([MARK]) in b.lstrip(bytes([MARK])) or b"\n" in b for b in keys)
        self.texts = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else b.replace(bytes([MARK]), b" ") for p, k, b in zip(v.pieces, v.kinds, inner, strict=True)]

    def escaped(self, text: str) -> bytes:
        raw = text.encode(errors="surrogatepass").replace(b"\xe2\x96\x81", b" ").replace(b" ", bytes([MARK]))
        return bytes([MARK]) + raw if raw and self.dummy else raw

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's offset in them."""
        raw = [self.escaped(t) if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        if self.parts and len(data):
            mark, feed = data == MARK, data == 10
            edge[1:-1] |= mark[1:] & ~mark[:-1] | feed[1:] | feed[:-1]
        cuts = np.flatnonzero(edge)
        starts, stops = cuts[:-1], cuts[1:]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first, inverse = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)[1:]
        flat, at = self._distinct(data, starts[first], stops[first])
        counts = np.diff(at)[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(at[:-1][inverse] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, ends)]

    def _distinct(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each part, one after another, and the parts' offsets."""
        sizes = stops - starts
        owners, found, places = [], [], []
        order = np.argsort(sizes, kind="stable")
        short = order[: int(np.searchsorted(sizes[order], LONG, side="right"))]
        groups = np.split(short, np.unique(np.searchsorted(sizes[short], [4, 8, 12, 16, 24, 32], side="right")))
        for group in groups:
            if len(group):
                owner, place, ids = self._together(data, starts[group], sizes[group])
                owners.append(group[owner])
                places.append(place)
                found.append(ids)
        for i in order[len(short) :]:
            ids = self._alone(data[starts[i] : stops[i]].tobytes())
            owners.append(np.full(len(ids), i))
            places.append(np.arange(len(ids)))
            found.append(np.array(ids, np.int32))
        owner, place, ids = np.concatenate(owners), np.concatenate(places), np.concatenate(found)
        sort = np.lexsort((place, owner))
        return ids[sort], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))])

    def _together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over many parts at once: for each piece its part, its place in it and its id."""
        n, most = len(starts), int(sizes.max())
        grid = np.concatenate([data, np.zeros(most, np.uint8)])[starts[:, None] + np.arange(most)]
        grid[np.arange(most) >= sizes[:, None]] = 0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((n, most + 5), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, most + 5), np.int16), np.full((n, most + 5), -1, np.int32)
        char = np.where(grid < 0x80, 1, np.where(grid == MARK, 1, np.where(grid < 0xE0, 2, np.where(grid < 0xF0, 3, 4))))
        for s in range(most):
            rows = np.flatnonzero((sizes > s) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            single, live, node = np.zeros(n, bool), rows, np.zeros(len(rows), np.int64)
            for d in range(1, most - s + 1):
                to = base[node] + grid[live, s + d - 1].astype(np.int64)
                ok = (check[to] == node) & (sizes[live] >= s + d)
                ok &= to > 0
                live, node = live[ok], to[ok]
                if not len(live):
                    break
                ends = value[node] >= 0
                at, ids = live[ends], value[node[ends]]
                score = best[at, s] + scores[ids]
                better = score > best[at, s + d]
                at, ids = at[better], ids[better]
                best[at, s + d], back[at, s + d], piece[at, s + d] = score[better], s, ids
                whole = live[ends]
                single[whole[char[whole, s] == d]] = True
            lone = rows[~single[rows]]
            if len(lone):
                d = char[lone, s]
                score = best[lone, s] + self.unknown_score
                better = score > best[lone, s + d]
                at, to = lone[better], (s + d)[better]
                best[at, to], back[at, to], piece[at, to] = score[better], s, -1
        owners, froms, ids = [], [], []
        live, at = np.arange(n), sizes.copy()
        while len(live):
            begin = back[live, at].astype(np.int64)
            got = piece[live, at]
            known = got >= 0
            owners.append(live[known])
            froms.append(begin[known])
            ids.append(got[known])
            for j in range(4):  # the bytes of what no piece covers
                more = ~known & (begin + j < at)
                owners.append(live[more])
                froms.append(begin[more] + j)
                ids.append(self.byte_ids[grid[live[more], begin[more] + j]])
            at, left = begin, begin > 0
            live, at = live[left], at[left]
        return np.concatenate(owners), np.concatenate(froms), np.concatenate(ids).astype(np.int32)

    def _alone(self, part: bytes) -> list[int]:
        """Viterbi over one part of any length."""
        n = len(part)
        base, check, value = (x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value)) if n > 20_000 else (self.trie.base, self.trie.check, self.trie.value)
        scores = self.scores
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here == -np.inf:
                continue
            c = part[s]
            width = 1 if c < 0x80 or c == MARK else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            node, single = 0, False
            for e in range(s, n):
                to = base[node] + part[e]
                if to <= 0 or check[to] != node:
                    break
                node = to
                i = value[node]
                if i >= 0:
                    score = here + scores[i]
                    if score > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = score, s, i
                    single |= e + 1 - s == width
            if not single and here + self.unknown_score > best[s + width]:
                best[s + width], back[s + width], piece[s + width] = here + self.unknown_score, s, -1
        out, at = [], n
        while at:
            s = back[at]
            out += [int(piece[at])] if piece[at] >= 0 else [int(self.byte_ids[c]) for c in reversed(part[s:at])]
            at = s
        return out[::-1]

    def decode(self, ids) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def encode(documents: DataFrame, encoder: Encoder, *, text: str = "text", keep: list[str] | None = None, to: str = "ids") -> DataFrame:
    """Columns `keep` of each row with the pieces of its text in column `to` (array<int>)."""
    keep = kept_columns(documents, keep, [to])
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", CHARS):
                texts = part.column("_text")
                ids, ends = encoder.encode_all(texts.to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*keep, to])

    return in_small_batches(source).mapInArrow(run, ", ".join([*schema, f"`{to}` array<int>"]))


def decode(encoded: DataFrame, encoder: Encoder, *, ids: str = "ids", keep: list[str] | None = None, to: str = "text") -> DataFrame:
    """Columns `keep` of each row with the text of its pieces in column `to`."""
    keep = kept_columns(encoded, [c for c in encoded.columns if c != ids] if keep is None else keep, [to])
    source = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("_ids"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, to])

    return in_small_batches(source).mapInArrow(run, ", ".join([*schema, f"`{to}` string"]))


def audit(documents: DataFrame, encoder: Encoder, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and decodes each text: key, n_pieces, n_byte_pieces, the MD5 of the ids as 32-bit little-endian numbers, and whether decoding gives the text back (null text: 0, 0, the MD5 of nothing, true)."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", CHARS):
                texts = part.column("_text").to_pylist()
                ids, ends = encoder.encode_all(texts)
                spans = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                same = [encoder.decode(x.tolist()) == (t or "") for x, t in zip(spans, texts, strict=True)]
                byte = np.concatenate([[0], np.cumsum(encoder.is_byte[ids])])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(ends)), pa.array(byte[ends[1:]] - byte[ends[:-1]], pa.int64()), pa.array([hashlib.md5(x.astype("<i4").tobytes()).hexdigest() for x in spans]), pa.array(same, pa.bool_())], names=["key", "n_pieces", "n_byte_pieces", "ids_md5", "decodes"])

    return in_small_batches(source).mapInArrow(run, f"key {kind}, n_pieces long, n_byte_pieces long, ids_md5 string, decodes boolean").withColumnRenamed("key", key)
