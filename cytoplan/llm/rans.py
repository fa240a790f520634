"""Token ids as binary files: a static range asymmetric numeral system.

One frequency table, counted over all ids and scaled to 2**20, is shared by every block. A block holds whole documents of about
``BLOCK`` ids; its ids are dealt to ``LANES`` interleaved coder states, so one numpy step codes one id of each lane. Blocks are
independent: each frame has the document directory, the decoder's states at checkpoints every ``EVERY`` steps with their places
in the word stream, the words, and two checksums (of the ids and of the frame), so blocks decode in parallel and a decoder can
start at any checkpoint.

Files: a Parquet folder of frames (part, block, start_in_part, n_tokens, frame), in ascending doc_id order of (part, block), and
beside it a one-row folder with the table. Parquet is only the container, so any store that Spark reaches will do.

Edge cases: a null text is empty and holds the end id alone; equal doc_ids stand next to each other, in order of their texts'
hashes; null doc_ids come first; an empty table gives no frames and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens

SCALE, LANES, BLOCK, EVERY = 20, 2048, 1 << 19, 128
_U = np.uint64
_LOW, _WORD = _U(1 << 31), _U(0xFFFFFFFF)
_HEAD = struct.Struct("<4sBHIIIIII")
MAGIC = b"RNS1"


class Table:
    """Scaled frequencies of all symbols that occur."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(_U)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self._slots = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._slots

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        """Largest parts are rounded so that the sum is 2**SCALE and every symbol that occurs keeps at least one slot."""
        counts = np.asarray(counts, np.float64)
        if not counts.sum():
            counts = np.ones(1)
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * (1 << SCALE))), 0).astype(np.int64)
        rest = (1 << SCALE) - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        if rest > 0:
            freq[order[0]] += rest
        at = 0
        while rest < 0:
            take = min(-rest, int(freq[order[at]]) // 2)
            freq[order[at]] -= take
            rest += take
            at += 1
        return Table(freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        return Table(np.frombuffer(zlib.decompress(data), "<u4"))


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, table: Table, doc_null: np.ndarray | None = None) -> bytes:
    """A frame of the ids of whole documents."""
    n = len(ids)
    steps = -(-n // LANES)
    x = np.full(LANES, _LOW, _U)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    freq, cum = table.freq, table.cum
    for t in range(steps - 1, -1, -1):
        s = ids[t * LANES : (t + 1) * LANES]
        k = len(s)
        f = freq[s]
        y = x[:k]
        full = np.flatnonzero(y >= f << _U(63 - SCALE))
        words.append((y[full] & _WORD).astype("<u4"))
        y[full] >>= _U(32)
        q = y // f
        x[:k] = (q << _U(SCALE)) + (y - q * f) + cum[s]
        if t % EVERY == 0:
            marks.append(x.copy())
    words.reverse()
    marks.reverse()
    sizes = np.array([len(w) for w in words], np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    places = before[np.arange(0, steps, EVERY)] if steps else np.zeros(0, np.int64)
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    nulls = np.packbits(doc_null if doc_null is not None else np.zeros(len(doc_ids), bool))
    body = b"".join([doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), nulls.tobytes(), places.astype("<u4").tobytes(), *[m.astype("<u8").tobytes() for m in marks], stream.tobytes()])
    head = _HEAD.pack(MAGIC, SCALE, LANES, EVERY, n, len(doc_ids), len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def decode_block(frame: bytes, table: Table, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids ``begin`` to ``end`` of a frame, decoded from the last checkpoint before them, and its doc_ids, their null marks and lengths.

    Raises ValueError if a checksum does not hold.
    """
    magic, scale, lanes, every, n, n_docs, n_marks, n_words, crc = _HEAD.unpack_from(frame)
    if magic != MAGIC or struct.unpack_from("<I", frame, len(frame) - 4)[0] != zlib.crc32(memoryview(frame)[:-4]):
        raise ValueError("damaged frame")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(frame, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, lengths, nulls = take("<i8", n_docs), take("<u4", n_docs), np.unpackbits(take("u1", -(-n_docs // 8)), count=n_docs).astype(bool)
    places, marks, words = take("<u4", n_marks), take("<u8", n_marks * lanes).reshape(n_marks, lanes), take("<u4", n_words).astype(_U)
    end = n if end is None else min(end, n)
    whole = begin == 0 and end == n
    mark = begin // lanes // every
    first = mark * every
    out = np.empty(max(0, end - first * lanes), np.uint32)
    if len(out):
        x, pos = marks[mark].copy(), int(places[mark])
        freq, cum, slots, low = table.freq, table.cum, table.slots, _U((1 << scale) - 1)
        for t in range(first, -(-end // lanes)):
            k = min(lanes, n - t * lanes)
            slot = x[:k] & low
            s = slots[slot]
            y = freq[s] * (x[:k] >> _U(scale)) + slot - cum[s]
            need = np.flatnonzero(y < _LOW)
            y[need] = (y[need] << _U(32)) | words[pos : pos + len(need)]
            pos += len(need)
            x[:k] = y
            o = (t - first) * lanes
            out[o : o + k] = s[: len(out) - o]
    if whole and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("ids do not match their checksum")
    return out[begin - first * lanes :], doc_ids, nulls, lengths


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into the folders ``path``/frames and ``path``/table."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    n = partitions or C.parallelism(spark)
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        kind = "<u2" if max(coder.size, end_id + 1) <= 1 << 16 else "<u4"
        held: list[bytes] = []
        ids: list[int | None] = []
        size = block = start = 0

        def row() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(b) // 4 for b in held]], pa.list_(pa.int32())), pa.array([flat.astype(kind).tobytes()], pa.binary())],
                ["part", "block", "start_in_part", "doc_ids", "lengths", "ids"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(coder.encode(text) + tail)
                ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= BLOCK:
                    yield row()
                    start += size
                    held, ids, size, block = [], [], 0, block + 1
        if held:
            yield row()

    raw = C.materialise(rows.mapInArrow(encode, "part int, block int, start_in_part long, doc_ids array<long>, lengths array<int>, ids binary"), "rans-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for wide, lengths in zip(batch.column(0), batch.column(1), strict=True):
                ids = _ids(wide.as_py(), sum(lengths.as_py()))
                seen = np.bincount(ids, minlength=len(total))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # At most as many rows as the tokenizer has ids.
    counts = raw.select("ids", "lengths").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    packed = Table.of_counts(total).to_bytes()
    spark.createDataFrame([(packed,)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(packed)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, start, doc_ids, lengths, wide = (batch.column(k)[i].as_py() for k in range(6))
                ids = _ids(wide, sum(lengths))
                frame = encode_block(ids, np.array([d or 0 for d in doc_ids], np.int64), np.array(lengths, np.int64), table, np.array([d is None for d in doc_ids], bool))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([frame], pa.binary())], ["part", "block", "start_in_part", "n_tokens", "frame"])

    raw.mapInArrow(frames, "part int, block int, start_in_part long, n_tokens long, frame binary").write.option("compression", "none").parquet(f"{path}/frames")
    C.discard(raw)


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of each document, from the files."""
    frames = spark.read.schema("part int, block int, start_in_part long, n_tokens long, frame binary").parquet(f"{path}/frames")
    packed = spark.read.schema("freq binary").parquet(f"{path}/table").first()[0]
    shared = spark.sparkContext.broadcast(packed)
    # One row for each part of the writer's range partitioning.
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, at = {}, 0
    for part, n in sorted(map(tuple, parts)):
        starts[part], at = at, at + n
    firsts = spark.sparkContext.broadcast(starts)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, frame = (batch.column(k)[i].as_py() for k in range(3))
                ids, doc_ids, nulls, lengths = decode_block(frame, table)
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                raw = ids.astype("<u4").tobytes()
                texts = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=nulls), pa.array(begins + start + firsts.value[part]), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(b) for b in texts], pa.int64()), pa.array(texts if with_ids else [None] * len(texts), pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    out = frames.select("part", "start_in_part", "frame").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")
