"""What the operators of this subpackage share: scratch tables, salted ranks, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import shared_folder, spread

#: Rows of a salted bucket: what one window partition sorts at most, about.
BUCKET_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """What this process freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        pass


def rest_driver(spark: SparkSession) -> None:
    """The driver gives freed memory back once its heap has grown to over half of what it may take.

    An operator of many small plans leaves their garbage behind faster than the JVM collects it, and the heap grows to
    its limit though little of it is in use. Plans that Python still names live on, so Python's garbage goes first.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() <= runtime.maxMemory():
        return
    gc.collect()
    jvm.java.lang.System.gc()
    trim()


class Scratch:
    """Tables that cut a plan's lineage: written once to the shared folder, read by every later step.

    A lost executor costs a re-read, never a recomputation of what stands before. The folder goes when the
    JVM's file system closes; ``drop`` frees a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/trelliq-{name}-{uuid.uuid4().hex}"
        self.count = 0
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        rest_driver(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def buckets_for(rows: int, least: int = 8) -> int:
    return max(least, -(-rows // BUCKET_ROWS))


def ranked(df: DataFrame, by: list[str], order: list[Column], buckets: int, name: str = "rank") -> DataFrame:
    """Adds the row's place (from 0, gapless) in its group, though a group may hold most rows.

    A group is salted by a hash of the ordering columns: places are row numbers within (group, salt) plus the
    count of the salts before. Only the counts, one row a group and salt, pass through a window of a whole group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    # <=> : a group whose key is null is a group as well
    before = (
        salted.groupBy(*by, "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_salt").alias("_s"), "_before")
    )
    on = F.col("_salt") == F.col("_s")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    placed = salted.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
    return placed.join(before, on).withColumn(name, (F.col("_row") - 1 + F.col("_before")).cast("long")).drop("_salt", "_row", "_s", "_before", *[f"_by{i}" for i in range(len(by))])


#: Bytes of an Arrow batch, and the session's setting of it with the value that Spark gives it.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES in this session, unless it names a size of its own.

    Plans read the setting when they run, so it can't be put back here; all operators set the one value, and results
    don't depend on it. A worker then holds a few batches of texts, whatever their lengths.
    """
    if spark.conf.get(BATCH_SETTING).rstrip("bB") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def tidy(work):
    """``work`` on a task's batches, after which the worker gives what it freed back to the system: it lives on for other operators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of slices of about `most` bytes; a longer text is a slice alone. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Bytes of text that a task works on at once: what it needs per byte stays below this many bytes a few hundred times.
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about PIECE_BYTES of text in column ``at`` each; a longer text is a run alone."""
    if not len(batch):
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(batch):
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_BYTES, side="right")))
        yield batch.slice(first, upto - first)
        first = upto


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of ragged runs, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: Odd multipliers of the polynomial and the finishing hash.
BASE, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


#: Runs longer than this are hashed one by one, so that few rounds over all runs remain.
LONG_RUN = 256


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes of every run a round, mixed in between.

    Runs of equal length up to eight bytes never collide; who needs certainty for longer ones compares the bytes.
    """
    starts, size = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    held = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    held[: len(data)] = data
    lanes = held.view("<u8")
    with np.errstate(over="ignore"):
        value = mix(size.astype(np.uint64) * MIX2 + BASE)
        long = np.flatnonzero(size > LONG_RUN)
        at = np.flatnonzero((size > 0) & (size <= LONG_RUN))
        begin, left = starts[at], size[at]
        while len(at):
            shift = ((begin & 7) << 3).astype(np.uint64)
            lane = lanes[begin >> 3] >> shift | lanes[(begin >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1)
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short] << 3).astype(np.uint64)) - np.uint64(1)
            value[at] = mix(value[at] ^ lane) + BASE
            more = left > 8
            at, begin, left = at[more], begin[more] + 8, left[more] - 8
    for i in long.tolist():
        value[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return value


def map_text(docs: DataFrame, text_col: str, keep: list[str], extra: str, make) -> DataFrame:
    """Columns ``keep`` of ``docs`` and those of the schema ``extra`` that ``make(text array)`` gives for each Arrow batch.

    ``make`` returns the extra columns as Arrow arrays in order; it gets PIECE_BYTES of text at once, or one longer text. The
    text travels back only if it is in ``keep``. A column of ``docs`` with the name of an extra one is not kept: the
    extra one takes its place.
    """
    fields = T._parse_datatype_string(extra).fields
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    sent = list(dict.fromkeys([*keep, text_col]))
    at = sent.index(text_col)
    out = T.StructType([*[docs.schema[c] for c in keep], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                arrays = [part.column(i) for i, c in enumerate(sent) if c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, *make(part.column(at))], [*keep, *names])

    small_batches(docs.sparkSession)
    return spread(docs.select(*[F.col(f"`{c}`") for c in sent])).mapInArrow(tidy(run), out)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def hash_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, by a hash of the key: the same ones at every run."""
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(7919), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / rows))
