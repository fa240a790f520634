"""Best-fit packing of tokenised documents after Martello-Toth reduction.

A document's ids and one end id are cut into pieces of at most ``capacity`` ids, and pieces are packed into as few sequences as
possible. Pieces of equal length are interchangeable, so the instance is a histogram of at most ``capacity`` counts, whatever the
number of documents. On it the plan is made: the longest piece is fixed together with a small set that provably dominates every
other set it could share a sequence with (nothing else fits; one piece fills the rest exactly; no feasible set sums to more than
the largest single piece; or a pair that majorises every other pair), the instance shrinks, and this repeats until no length
reduces. The remainder is packed best-fit in descending order, all copies of a length at a time. The plan is a list of runs:
(length, first rank, last rank, first sequence, copies in a sequence, offset). A piece finds its place by its rank among the pieces
of its length; ranks come from per-task counters and a prefix sum over tasks, so no length, however frequent, meets in one task.

Edge cases: a null or empty text is one piece with the end id alone; ids of repeated rows are packed as often as they occur;
an empty table gives no rows. Other columns are ignored.

With ``with_ids`` a piece carries its ids, so the sequences of ids are there, not only the plan of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: part, rank (among those of its length in its part), doc_id, piece, start, length, ids_crc32; and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        tail = np.array([end_id], "<u4").tobytes()
        # Ids take as much room as their text, so fewer rows are held with them.
        for batch in C.slices(batches, 128) if with_ids else batches:
            rows: list[tuple] = []
            held: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part_ids = ids[at : at + 4 * capacity]
                    n = len(part_ids) // 4
                    rows.append((part, seen[n], doc_id, piece, at // 4, n, zlib.crc32(part_ids)))
                    seen[n] += 1
                if with_ids:
                    held.append(ids)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays, names = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.append(0, np.cumsum(np.array(cols[5], np.int64))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        if with_ids:
            coder.words.clear()  # words of all tasks together would stay in the worker
            C.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- the plan


class Instance:
    """How many pieces there are of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.count[size] = n

    def sizes(self) -> np.ndarray:
        """Lengths that are left, ascending."""
        return np.flatnonzero(self.count)

    def times(self, bin_: tuple[int, ...]) -> int:
        """How many sequences of these lengths can be made."""
        return min(int(self.count[s]) // k for s, k in Counter(bin_).items())

    def take(self, bin_: tuple[int, ...], n: int) -> None:
        for s, k in Counter(bin_).items():
            self.count[s] -= k * n


def dominating(inst: Instance, w: int) -> tuple[int, ...] | None:
    """A set with ``w`` that dominates every feasible set with ``w`` while copies of it are left, or None."""
    rest = inst.capacity - w
    inst.count[w] -= 1
    try:
        small = np.flatnonzero(inst.count[: rest + 1])
        if not len(small):
            return (w,)
        best = int(small[-1])
        if best == rest:
            return (w, best)
        least = [int(s) for s in small[:3] for _ in range(min(3, int(inst.count[s])))][:3]
        if len(least) < 2 or least[0] + least[1] > rest:
            return (w, best)  # no two pieces fit beside it
        if len(least) > 2 and sum(least) <= rest:
            return None
        # At most two fit. The feasible pairs x >= y:
        x = small[:, None]
        ok = (small[None, :] <= x) & (x + small[None, :] <= rest) & ((x != small[None, :]) | (inst.count[small] > 1)[None, :])
        i, j = np.nonzero(ok)
        xs, ys = small[i], small[j]
        if (xs + ys).max() <= best:
            return (w, best)
        mates = ys[xs == best]
        if len(mates):
            y = int(mates.max())  # (best, y): best majorises every x, y every second piece unless both fit under best
            if not ((ys > y) & (xs + ys > best)).any():
                return (w, best, y)
        return None
    finally:
        inst.count[w] += 1


def reduce_instance(inst: Instance) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that some best packing has, with their numbers; the instance keeps the rest."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for w in inst.sizes()[::-1].tolist():
            while inst.count[w] and (bin_ := dominating(inst, w)):
                n = inst.times(bin_)
                inst.take(bin_, n)
                fixed.append((bin_, n))
                again = True
    return fixed


def best_fit(inst: Instance) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit in descending order, all pieces of a length and all sequences with equal contents at a time."""
    open_: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    for w in inst.sizes()[::-1].tolist():
        left = int(inst.count[w])
        inst.count[w] = 0
        for room in sorted(r for r in open_ if r >= w):
            while left and open_.get(room):
                bin_, n = open_[room].pop()
                per = room // w  # the fullest sequence that has room stays the fullest
                whole = min(n, left // per)
                if whole:
                    _put(open_, done, room - per * w, (*bin_, *[w] * per), whole)
                    left -= whole * per
                if whole < n and left:
                    _put(open_, done, room - left * w, (*bin_, *[w] * left), 1)
                    left = 0
                    whole += 1
                if whole < n:
                    open_[room].append([bin_, n - whole])
        per = inst.capacity // w
        if left // per:
            _put(open_, done, inst.capacity - per * w, (w,) * per, left // per)
        if left % per:
            _put(open_, done, inst.capacity - left % per * w, (w,) * (left % per), 1)
    return done + [(b, n) for groups in open_.values() for b, n in groups]


def _put(open_: dict[int, list[list]], done: list, room: int, bin_: tuple[int, ...], n: int) -> None:
    if room:
        open_.setdefault(room, []).append([bin_, n])
    else:
        done.append((bin_, n))


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, end rank, first sequence, copies in a sequence, offset), sorted, and the number of sequences."""
    inst = Instance(counts, capacity)
    bins = reduce_instance(inst) + best_fit(inst)
    used: Counter[int] = Counter()
    runs, sequence = [], 0
    for bin_, n in bins:
        offset = 0
        for size, k in sorted(Counter(bin_).items(), reverse=True):
            runs.append((size, used[size], used[size] + k * n, sequence, k, offset))
            used[size] += k * n
            offset += k * size
        sequence += n
    if dict(used) != {s: n for s, n in counts.items() if n}:
        raise RuntimeError("the plan does not hold every piece once")
    return np.array(sorted(runs), np.int64).reshape(-1, 6), sequence


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False, read: Callable[[], None] = lambda: None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text); and its ids if asked for.

    ``read`` is called once ``docs`` has been read for the last time.
    """
    spark = docs.sparkSession
    pieces = C.materialise(cut(docs, tokenizer or tokens.default_tokenizer(), end_id, capacity, with_ids), "packing-pieces", 1 << 20 if with_ids else None)
    read()
    by_part = C.materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most ``capacity`` rows.
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(runs)
    more = ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(keys, (batch.column(3).to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * run[:, 0]), *batch.columns[6:]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more],
            )

    # A row for each task and length: it grows with the table, so both sides are shuffled.
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"), *more)
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
