"""What the operators share: reading, held-out folds, cutting lineage, and vectorised word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step handles at most, unless one text alone is longer.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that the JVM packs into one batch for Python at most.
BATCH_BYTES = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same DataFrame, in a session whose batches for Python hold BATCH_BYTES at most: long texts would fill large buffers on both sides."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in conf.get(name) if c.isdigit() or c == "-")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a folder of this machine only where none is set (tests, local mode)."""
    context = spark.sparkContext
    if (at := spark.conf.get("spark.checkpoint.dir", None)) and not context.getCheckpointDir():
        context.setCheckpointDir(at)
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="locusloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder: lost executors don't bring back the work before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared checkpoint folder: as cut(), for tables that are large or read in parts."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("compression", "uncompressed").parquet(path)  # codecs keep native memory
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more: what was made of them is stored itself. Trims the driver's JVM, too."""
    for table_ in tables:
        context = table_.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(table_._stored_at)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    for session in {id(t.sparkSession): t.sparkSession for t in tables}.values():
        trim(session)


def trim(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system, where it can. Its compiler and Spark's many threads for exchanges leave it in the allocator's arenas."""
    context = spark.sparkContext
    jvm, array = context._jvm, context._gateway.new_array
    try:
        # By the interface's method: the server's own class is not exported.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        values = array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # a JVM without this command
        return False
    return True


#: Rows of the filter of sieve() at most, whatever the input, and words of 64 bits in each.
_BUCKETS, _WORDS = 65536, 8


def sieve(rows: DataFrame, column: str, ids: DataFrame, apart: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The rows whose long column may be one of `ids` (v): a bitmap of fixed size, sent to all tasks, keeps most others from being shuffled. apart: the others, too."""
    spot = lambda c: F.xxhash64(F.lit(2), c)
    bucket = lambda c: F.xxhash64(c).bitwiseAND(F.lit(_BUCKETS - 1)).alias("_row")
    word = lambda c: spot(c).bitwiseAND(F.lit(_WORDS - 1)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spot(c), 58).cast("int"))
    placed = ids.select(bucket(F.col("v")), word(F.col("v")).alias("_word"), bit(F.col("v")).alias("_bit"))
    bits = placed.groupBy("_row").agg(*[F.bit_or(F.when(F.col("_word") == j, F.col("_bit"))).alias(f"_w{j}") for j in range(_WORDS)])
    held = F.lit(0).cast("long")
    for j in range(_WORDS):
        held = F.when(word(F.col(column)) == j, F.col(f"_w{j}")).otherwise(held)
    test = F.coalesce(held.bitwiseAND(bit(F.col(column))) != 0, F.lit(False))
    met = rows.withColumn("_row", bucket(F.col(column))).join(F.broadcast(bits), "_row", "left" if apart else "inner")
    near = met.where(test).select(*rows.columns)
    return (near, met.where(~test).select(*rows.columns)) if apart else near


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose long column is one of the distinct `ids` (v). The join is an inner one, since a semi-join would be pushed below the filter."""
    return sieve(rows, column, ids).join(ids, F.col(column) == F.col("v")).drop("v")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def pieces_of(texts: list[str], limit: int = SLICE_CHARS // 2) -> Iterator[list[str]]:
    """The texts in lists of about `limit` characters; what is learnt from a sample is gathered list by list, so that the driver stays small."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def release() -> None:
    """Gives memory that a fit has freed back to the system, where the allocator can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def kept_columns(df: DataFrame, keep: list[str] | None, added: list[str]) -> list[str]:
    """The columns to keep (all by default) but those that added ones of the same name replace."""
    names = {c.lower() for c in added}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in names]


def integer_key(df: DataFrame, key: str) -> Column:
    """The key column as long; keys of other kinds than integers are refused, since they would become null."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"the key {key} must be an integer, not {kind}")
    return F.col(f"`{key}`").cast("long")


def order_hash(*keys: Column) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `limit` bytes of text each; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


#: The bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def byte_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in UTF-8: the bytes, each word's start and end in them, and the words of each text as offsets into the words. Null texts have none."""
    flat = pa.array(texts.fill_null("") if texts.null_count else texts, pa.large_string())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(flat) else np.zeros(0, np.uint8)
    ends = ends - (ends[0] if len(ends) else 0)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data), bool)
    edge[ends[:-1][ends[:-1] < len(data)]] = True  # a text's first byte starts a word whatever stands before it
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    stops_at = np.empty(len(data), bool)
    if len(data):
        stops_at[-1] = True
        stops_at[:-1] = ~inside[1:] | edge[1:]
    stops = np.flatnonzero(inside & stops_at) + 1
    return data, starts, stops, np.searchsorted(starts, ends)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partition_keys(n: int) -> list[int]:
    """For each of n hash partitions an integer that Spark deals to it (Murmur3 of an int column, seed 42), so that rows dealt by these spread evenly."""
    turn = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    found, at = np.full(n, -1, np.int64), 0
    while (found < 0).any():
        x = np.arange(at, at + 4 * n + 64, dtype=np.uint32)
        k = turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = (turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        spot = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        free = found[spot] < 0
        found[spot[free][::-1]] = x[free][::-1]
        at += len(x)
    return found.tolist()


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from its eight-byte parts."""
    out = mixed((stops - starts).astype(np.uint64) * _ODD)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        part = np.ascontiguousarray(eight[at]).view(np.uint64).ravel()
        left = stops[live] - at
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[live] = mixed(out[live] * np.uint64(0xD6E8FEB86659FD93) + part)
        more = left > 8
        live, at = live[more], at[more] + 8
    return out


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z as a-z, all else as it is."""
    return pc.ascii_lower(texts)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal integer keys, of batches sorted by them, as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], 1)
        edges = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(1)])).tolist()
        for a, b in zip(edges, [*edges[1:], len(marks)], strict=True):
            mark = tuple(marks[a].tolist())
            if held and mark != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = mark
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
