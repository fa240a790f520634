"""Shared pieces of the training-data operators: work folders, Arrow text buffers, word segmentation and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised kernels take at once; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
#: ASCII blanks that separate words: space and 0x09 to 0x0D.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True

_own_dir: list[str] = []
#: Frames whose files have been written and not deleted yet.
_kept: list[DataFrame] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset a temporary folder does in local mode only: on a cluster each machine would see its own, and rows be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="cytoplan-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/cytoplan/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch while frames are materialised: texts are long, and both sides of the pipe hold a batch.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession, most: int | None = None) -> Iterator[None]:
    """The session's Arrow batches have the bounds of ``ARROW`` meanwhile, or ``most`` bytes."""
    before = {key: spark.conf.get(key, None) for key in ARROW}
    try:
        for key, value in (ARROW if most is None else ARROW | {"spark.sql.execution.arrow.maxBytesPerBatch": str(most)}).items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors. ``batch``: bytes of an Arrow batch meanwhile."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with small_batches(spark, batch):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cytoplan_path = path  # type: ignore[attr-defined]
    _kept.append(out)
    return out


def materialised() -> int:
    """A mark for :func:`discard_since`: how many frames have been materialised."""
    return len(_kept)


def since(mark: int) -> list[DataFrame]:
    """Frames materialised since ``mark`` whose files are still there."""
    return list(_kept[mark:])


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Delete the files of all frames materialised since ``mark`` but those to keep, once nothing reads them any more."""
    later, _kept[mark:] = _kept[mark:], list(keep)
    discard(*[df for df in later if not any(df is k for k in keep)])


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "cytoplan_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            _kept[:] = [k for k in _kept if k is not df]


def _trimmer():
    """The C library's call that gives free memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release() -> None:
    """To be called at a task's end: workers live on, and what they hold without need counts against an executor's memory."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def partitions_of(df: DataFrame, each: int) -> int:
    """Tasks for data in proportion to ``df``, by Spark's estimate of its size, ``each`` bytes a task; at least :func:`parallelism`, which stands where the size is unknown."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = parallelism(df.sparkSession)
    return least if size >= 1 << 60 else min(max(least, -(-size // each)), max(least, 1 << 17))


# ---------------------------------------------------------------- Arrow text buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return flat[:0], np.zeros(1, np.int64)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made of one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for consecutive rows, of bounded size."""
    flat, offsets = text_buffer(column)
    for i, j in row_slices(offsets, limit):
        yield i, j, flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


# ---------------------------------------------------------------- words


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not ``blank``) of all rows, and the index of each row's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[heads] = inside[heads]
    starts = np.flatnonzero(edge)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
_MIX = (np.arange(256, dtype=_U64) + _U64(1)) * _U64(0xD6E8FEB86659FD93)
_MIX ^= _MIX >> _U64(29)


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, _U64)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, for :func:`span_hash`."""
    out = np.zeros(len(data) + 1, _U64)
    np.cumsum(_MIX[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    x = (prefix[ends] - prefix[starts]) * _power(_BASE_INV, len(prefix))[starts]
    return mix64(x + (ends - starts).astype(_U64) * _U64(0xA24BAED4963EE407))


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by the first word's index; callers keep runs within a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    out = np.zeros(n, _U64)
    for i in range(k):
        out *= _U64(0x9FB21C651E98DF25)
        out += words[i : i + n]
    return mix64(out)


def rows_of_windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each run of ``k`` words that stays in its row, and the run's row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return start, row
