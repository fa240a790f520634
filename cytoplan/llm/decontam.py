"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters, digits and non-ASCII characters in lower case; shingles are runs of five words (an item of fewer words
is one shingle). A shingle weighs ln(1 + items / items that have it), in whole 2**-20ths. For an item of m words every window of m
words of a text, cut off at the text's ends, that shares any shingle with any item of that length is given a 64-bit weighted SimHash
from running sums; windows without a common shingle have similarity 0 and are passed over. A multi-index finds the items near a
window: fingerprints are cut into ``BLOCKS`` blocks, and a pair within ``RADIUS`` bits differs by ``RADIUS // BLOCKS`` or fewer in
one block at least, so the items listed under the block values that near make up the candidates. Those within ``RADIUS`` bits are
verified by exact weighted Jaccard similarity of shingle multisets (sum of weights times the smaller counts over that of the larger
counts), kept up from window to window; ``threshold`` or more is a match.

At similarity 0.8 fingerprints differ by about 10 of 64 bits with a deviation of 3, so a few similar windows lie beyond ``RADIUS``. These
are found exactly: an item lists its heaviest shingles, so many that a window without any of them cannot be similar; windows that hold a
listed one are verified too where the weight of their hits allows ``threshold``. No similar pair is missed.

Distribution: documents are read once and never shuffled. Items are sent to the tasks in groups of at most ``ITEM_BYTES`` of text;
a larger benchmark takes several passes. A task holds a chunk of text, and work grows with its words, not with an item's length.

Edge cases: items of a null text and wordless ones match nothing, null texts hold nothing; items without an id cannot be reported, but
:func:`clean` removes what holds them; equal items are all reported, of rows with one item_id
the best match; of windows with equal similarity the first is reported; repeated rows are judged alike; an empty benchmark or table
gives no matches. Other columns are ignored, or kept by :func:`clean`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, RADIUS, THRESHOLD, BLOCKS = 5, 15, 0.8, 4
SCALE = 1 << 20
#: Windows that are compared at once.
WINDOWS = 4096
ITEM_BYTES = 16 << 20
_U = np.uint64
#: Bytes that separate words: ASCII but letters and digits.
SEPARATES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, bytes, row offsets, word starts and ends, each row's first word, and word hashes, a chunk at a time."""
    for i, _, data, offsets in C.text_chunks(pc.utf8_lower(column)):
        starts, ends, first = C.word_spans(data, offsets, SEPARATES)
        yield i, data, offsets, starts, ends, first, C.span_hash(C.prefix_hash(data), starts, ends)


def _near_masks(bits: int, most: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``most`` or fewer ones."""
    every = np.arange(1 << bits)
    return every[np.bitwise_count(every) <= most].astype(np.uint16)


class Block:
    """Items by one block of their fingerprints."""

    def __init__(self, values: np.ndarray):
        self.values, at, counts = np.unique(values, return_inverse=True, return_counts=True)
        self.items = np.argsort(at, kind="stable")
        self.starts = np.append(0, np.cumsum(counts))

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items listed under a block value near a window's."""
        masks = _near_masks(64 // BLOCKS, RADIUS // BLOCKS)
        if len(self.values) <= len(masks):
            window, listed = np.nonzero(np.bitwise_count(values[:, None] ^ self.values[None, :]) <= RADIUS // BLOCKS)
        else:  # fewer values are near a window than there are
            probe = (values[:, None] ^ masks[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.values, probe), len(self.values) - 1)
            hit = np.flatnonzero(self.values[at] == probe)
            window, listed = hit // len(masks), at[hit]
        n = self.starts[listed + 1] - self.starts[listed]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(window, n), self.items[np.repeat(self.starts[listed], n) + nth]


@dataclass
class Group:
    """Items of one number of words."""

    words: int
    shingle: int
    ids: np.ndarray
    hashes: np.ndarray  # item by place of the shingle
    prints: np.ndarray
    own: np.ndarray  # the shingles of its items, as places among all
    blocks: list[Block]
    heads: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within RADIUS bits, by window and then item."""
        parts = prints.view(np.uint16).reshape(len(prints), BLOCKS)
        keys = [window * len(self.ids) + item for b, block in enumerate(self.blocks) for window, item in [block.near(parts[:, b])]]
        window, item = np.divmod(np.unique(np.concatenate(keys)), len(self.ids))
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Index:
    """All items, by their number of words, and the shingles that any of them has."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        column = pa.array(texts, pa.large_string())
        for at, _, _, _, _, first, words in word_hashes(column):
            for k in range(len(first) - 1):
                own = words[first[k] : first[k + 1]]
                if len(own):
                    by_size.setdefault(len(own), []).append((ids[at + k], C.window_hash(own, min(WORDS, len(own)))))
        every = [h for group in by_size.values() for _, h in group]
        self.keys, seen = np.unique(np.concatenate([np.unique(h) for h in every] or [np.zeros(0, _U)]), return_counts=True)
        self.default = round(float(np.log1p(len(every) or 1)) * SCALE)
        self.weights = np.round(np.log1p(len(every) / np.maximum(seen, 1)) * SCALE).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> _U(44)] = True
        self.groups = []
        for m, group in sorted(by_size.items()):
            hashes = np.stack([h for _, h in group])
            ends = np.arange(1, len(group) + 1) * hashes.shape[1]
            prints = fingerprints(hashes.ravel(), self.weigh(self.find(hashes.ravel())), ends - hashes.shape[1], ends)
            blocks = prints.view(np.uint16).reshape(len(group), BLOCKS)
            self.groups.append(Group(m, min(WORDS, m), np.array([i for i, _ in group]), hashes, prints, np.unique(self.find(hashes.ravel())), [Block(blocks[:, b]) for b in range(BLOCKS)]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the items' shingles, or -1."""
        out = np.full(len(hashes), -1)
        at = np.flatnonzero(self.maybe[hashes >> _U(44)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[place] == hashes[at]
            out[at[hit]] = place[hit]
        return out

    def weigh(self, place: np.ndarray) -> np.ndarray:
        """Weights of shingles by their place; those that no item has weigh as one that a single item of many has."""
        return np.where(place >= 0, self.weights[place], self.default) if len(self.weights) else np.full(len(place), self.default)

    def similarity(self, a: dict[int, int], b: dict[int, int]) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        names = sorted(a.keys() | b.keys())
        weights = self.weigh(self.find(np.array(names, _U))).tolist()
        low = sum(w * min(a.get(s, 0), b.get(s, 0)) for s, w in zip(names, weights, strict=True))
        high = sum(w * max(a.get(s, 0), b.get(s, 0)) for s, w in zip(names, weights, strict=True))
        return low / high if high else 0.0

    def matches(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, start, end) of the best window of each row and item; places in characters."""
        for at, data, offsets, starts, ends, first, words in word_hashes(column):
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for shingle in sorted({g.shingle for g in self.groups}):
                hashes = C.window_hash(words, shingle)
                index, row = C.rows_of_windows(first, shingle)
                place = self.find(hashes)
                hit = place[index] >= 0
                if not hit.any():
                    continue
                weights = self.weigh(place)
                for group in self.groups:
                    if group.shingle == shingle:
                        mine = np.isin(place[index[hit]], group.own)
                        if mine.any():
                            self._windows(group, hashes, place, weights, first, index[hit][mine], row[hit][mine], threshold, best)
            chars = None
            for (row, item), (value, a, b) in sorted(best.items()):
                if chars is None:
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = chars[offsets[row]]
                yield at + row, item, value, int(chars[starts[a]] - zero), int(chars[ends[b - 1]] - zero)

    def _heads(self, group: Group, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of shingles, ascending, and an item that each is listed for, and the items' weights: a window without a listed shingle of an item is not similar to it.

        An item lists its heaviest shingles, until those left weigh less than ``threshold`` of it.
        """
        if threshold not in group.heads:
            place = self.find(group.hashes.ravel()).reshape(group.hashes.shape)
            order = np.argsort(-self.weights[place], axis=1, kind="stable")
            place = np.take_along_axis(place, order, 1)
            weight = self.weights[place]
            total = weight.sum(1)
            item, column = np.nonzero(np.cumsum(weight, 1) - weight <= (1 - threshold) * total[:, None] * (1 + 1e-9) + 1)
            listed, item = np.divmod(np.unique(place[item, column] * len(place) + item), len(place))
            group.heads[threshold] = listed, item, total
        return group.heads[threshold]

    def _missed(self, group: Group, place: np.ndarray, weights: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) of all pairs that can be similar by the weights of the windows' hits, however far their fingerprints are."""
        listed, item, sought = self._heads(group, threshold)
        place = place[at]
        begin, end = np.searchsorted(listed, place, "left"), np.searchsorted(listed, place, "right")
        n = end - begin
        hit = np.repeat(np.arange(len(at)), n)
        item = item[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(hit))]
        order = np.argsort(item, kind="stable")
        hit, item = hit[order], item[order]
        total = np.append(0, np.cumsum(weights))
        for part in np.split(np.arange(len(item)), np.flatnonzero(item[1:] != item[:-1]) + 1):
            if not len(part):
                continue
            own = at[hit[part]]
            # Windows that hold one of these hits, each once.
            first, last = np.searchsorted(high, own, "right"), np.searchsorted(low, own, "right")
            first[1:] = np.maximum(first[1:], last[:-1])
            n = np.maximum(last - first, 0)
            w = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            if len(w):
                name = int(item[part[0]])
                near = slice(*np.searchsorted(at, [low[w[0]], high[w[-1]]]))
                shared = np.where(np.isin(place[near], self.find(group.hashes[name])), weights[at[near]], 0)
                shared = np.append(0, np.cumsum(shared))
                most = shared[np.searchsorted(at[near], high[w])] - shared[np.searchsorted(at[near], low[w])]
                w = w[most >= threshold * (total[high[w]] - total[low[w]] + sought[name] - most) * (1 - 1e-9)]
                yield w, np.full(len(w), name)

    def _windows(self, group: Group, hashes: np.ndarray, place: np.ndarray, weights: np.ndarray, first: np.ndarray, at: np.ndarray, row: np.ndarray, threshold: float, best: dict) -> None:
        """Windows of the group's size that hold a hit; ``at`` has the hits' first words, in order."""
        m, k = group.words, group.shingle
        # Windows begin up to m - k words before a hit; each once.
        begin = at - (m - k)
        same = row[1:] == row[:-1]
        begin[1:] = np.where(same, np.maximum(begin[1:], at[:-1] + 1), begin[1:])
        n = at - begin + 1
        row = np.repeat(row, n)
        begin = np.repeat(begin, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.maximum(begin, first[row]), np.minimum(begin + m, first[row + 1]) - k + 1  # of the shingles
        some = high > low
        low, high, row = low[some], high[some], row[some]
        prints = fingerprints(hashes, weights, low, high)
        windows, items = [], []
        for s in range(0, len(prints), WINDOWS):
            w, i = group.near(prints[s : s + WINDOWS])
            windows.append(w + s)
            items.append(i)
        for w, i in self._missed(group, place, weights, at, low, high, threshold):
            windows.append(w)
            items.append(i)
        w, i = np.concatenate([np.zeros(0, np.int64), *windows]), np.concatenate([np.zeros(0, np.int64), *items])
        w, i = np.divmod(np.unique(w * len(group.ids) + i), len(group.ids))
        order = np.lexsort((w, row[w], i))
        w, i = w[order], i[order]
        cuts = np.flatnonzero((i[1:] != i[:-1]) | (row[w][1:] != row[w][:-1])) + 1
        for part in np.split(np.arange(len(w)), cuts):
            if len(part):
                own = w[part]
                name = (int(row[own[0]]), int(group.ids[i[part[0]]]))
                value, a, b = _best(group.hashes[i[part[0]]], self.weigh(self.find(group.hashes[i[part[0]]])), hashes, weights, low[own], high[own])
                if value >= threshold and value > best.get(name, (0.0,))[0]:
                    best[name] = (value, a, b + k - 1)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Weighted SimHash of each run hashes[low:high]."""
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    used = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    place = np.searchsorted(used, np.stack([low, high]))
    own, weight = hashes[used], weights[used]
    sums = np.zeros(len(used) + 1, np.int64)

    def of_runs(value: np.ndarray) -> np.ndarray:
        np.cumsum(value, out=sums[1:])
        return sums[place[1]] - sums[place[0]]

    total = of_runs(weight)
    out = np.zeros(len(low), _U)
    for b in range(64):
        out |= (2 * of_runs(weight * ((own >> _U(b)) & _U(1)).astype(np.int64)) > total).astype(_U) << _U(b)
    return out


def _best(item: np.ndarray, item_weights: np.ndarray, hashes: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, int, int]:
    """Highest weighted Jaccard similarity of ``item`` and a run hashes[low:high], and the first run that has it. Runs come in order."""
    want = Counter(item.tolist())
    sought = int(item_weights.sum())
    have: Counter[int] = Counter()
    shared = total = 0
    start = end = int(low[0])
    best = (0.0, start, start)
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if a >= end:
            have.clear()
            shared = total = 0
            start = end = a
        for s, w in zip(hashes[end:b].tolist(), weights[end:b].tolist(), strict=True):
            shared += w * (have[s] < want[s])
            total += w
            have[s] += 1
        for s, w in zip(hashes[start:a].tolist(), weights[start:a].tolist(), strict=True):
            have[s] -= 1
            shared -= w * (have[s] < want[s])
            total -= w
        start, end = a, b
        value = shared / (total + sought - shared)
        if value > best[0]:
            best = (value, a, b)
    return best


def indexes(benchmark: DataFrame, named: bool = True) -> list[Index]:
    """Indexes over all items, each of at most about ITEM_BYTES of text. Unless they are to be ``named``, items without an id are among them."""
    name = F.col("item_id").cast("long")
    items = benchmark.select((name if named else F.coalesce(name, F.lit(-1))).alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-int(size) // ITEM_BYTES) or 1
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        out.append(Index([r["item_id"] for r in part], [r["text"] for r in part]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start and end (characters of the best window) of each document and item that match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(shared.value.matches(batch.column(1), threshold))
                cols = list(zip(*hits, strict=True)) if hits else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["doc_id", "item_id", "similarity", "start", "end"],
                )

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text matches no item."""
    place = docs.columns.index("text")
    for index in indexes(benchmark, named=False):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in shared.value.matches(batch.column(place), threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
