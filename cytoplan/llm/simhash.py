"""SimHash near-duplicates by a Gray-ordered hierarchical index.

A text (A-Z in lower case) is cut into words ``[^\\x20\\x09-\\x0D]+`` and their runs of ``shingle`` words, repeats included; the
64-bit XXH64 values of the runs vote on the bits of the fingerprint. Fingerprints link at ``radius`` or fewer differing bits.

Distribution: the 64 bits are cut into ``radius + 1`` blocks, so two linked fingerprints agree in at least one whole block. Each
distinct fingerprint goes once per block to the group of that block's value. Within a group the fingerprints are sorted by Gray
rank, which puts those with long shared bit patterns together; leaves hold a few neighbours, upper nodes the bits on which all
below them agree (a mask and a pattern). Two nodes are compared by the differences of the bits that both fix, counted over the
levels from the top; a pair with more than ``radius`` is dropped with everything below it. Groups beyond ``GROUP_LIMIT`` are cut
into ranges of Gray ranks, which are those of equal leading bits; two ranges whose leading bits differ by more than ``radius`` are dropped
before a row is sent, and ranges that are still too large are cut by hash. Each pair of tiles left is a group of its own, so no task
holds an unbounded group and no link is lost.
A group emits a spanning star of each of its components, never all pairs.

Edge cases: null or wordless texts have fingerprint zero; shorter texts are one shingle. Rows with a null ``doc_id`` take part,
``component_id`` is the smallest non-null id reached. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import connected_components

GROUP_LIMIT, LEAF, FAN = 8192, 16, 8
#: Most leading bits that tell ranges of a large group apart.
RANGE_BITS = 12
_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42, longest: int = 512) -> np.ndarray:
    """XXH64 of byte spans, all spans of one length at a time."""
    out = np.empty(len(starts), _U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths.astype(np.uint16), kind="stable") if len(lengths) and lengths.max() < 65536 else np.argsort(lengths, kind="stable")
    values, cuts = np.unique(lengths[order], return_index=True)
    cuts = np.append(cuts, len(order))
    for i, size in enumerate(values.tolist()):
        rows = order[cuts[i] : cuts[i + 1]]
        at = starts[rows]
        if size > longest:
            raw = data.tobytes() if len(rows) > 4 else None
            out[rows] = [xxhash.xxh64_intdigest(raw[a : a + size] if raw else data[a : a + size].tobytes(), seed) for a in at.tolist()]
            continue
        left = size
        if size >= 32:
            v = [np.full(len(at), x & (1 << 64) - 1, _U) for x in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
            while left >= 32:
                for k in range(4):
                    v[k] = _rot(v[k] + wide[at] * _P2, 31) * _P1
                    at = at + 8
                left -= 32
            h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                h = (h ^ (_rot(x * _P2, 31) * _P1)) * _P1 + _P4
        else:
            h = np.full(len(at), seed + int(_P5) & (1 << 64) - 1, _U)
        h += _U(size)
        while left >= 8:
            h = _rot(h ^ (_rot(wide[at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at = at + 8
            left -= 8
        if left >= 4:
            h = _rot(h ^ ((wide[at] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at = at + 4
            left -= 4
        while left:
            h = _rot(h ^ (padded[at].astype(_U) * _P5), 11) * _P1
            at = at + 1
            left -= 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        out[rows] = h ^ (h >> _U(32))
    return out


def vote(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the hashes of each row; ``first`` has each row's first hash, and the end."""
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), _U)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[full][owner] + nth * 255
    planes = np.empty((8, len(at)), _U)
    ones = _U(0x0101010101010101)
    for k in range(8):
        planes[k] = np.add.reduceat((hashes >> _U(k)) & ones, at)
    sums = planes.view(np.uint8).reshape(8, len(at), 8).astype(np.int32)
    per_row = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=1)
    bits = per_row * 2 > counts[full][None, :, None]
    value = np.zeros(len(full), _U)
    for k in range(8):
        for byte in range(8):
            value |= bits[k, :, byte].astype(_U) << _U(8 * byte + k)
    out[full] = value
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Fingerprints of the rows of a UTF-8 buffer."""
    data = C.fold_ascii(data)
    inside = ~C.IS_BLANK[data]
    starts, ends, first = C.word_spans(data, offsets)
    keep = inside.copy()
    keep[ends[ends < len(data)]] = True  # one separator after each word
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    squeezed = data[keep]
    squeezed[place[ends[ends < len(data)]]] = 32
    if len(ends):  # rows that touch have no separator between them: that byte belongs to the next row's word
        touching = ends[(ends < len(data))]
        touching = touching[inside[touching]]
        squeezed[place[touching]] = data[touching]
    starts, ends = place[starts], place[ends]
    counts = np.diff(first)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    head = np.cumsum(n) - n
    at = np.arange(len(row)) - head[row] + first[:-1][row]
    to = at + np.minimum(shingle, counts[row]) - 1
    return vote(xxh64_spans(squeezed, starts[at], ends[to]), np.append(head, len(row)))


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long with the 64 bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(data, offsets, shingle) for _, _, data, offsets in C.text_chunks(batch.column(1))]
            value = np.concatenate(parts) if parts else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(s))
    return x


def hamming_join(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, visit) -> None:
    """Calls ``visit(i, j)`` with index arrays of pairs of one group within ``radius``; if a group has sides 0 and 1, of different sides.

    Two trees, or one with itself, are walked from the top; see the module's description.
    """
    order = np.lexsort((gray_rank(fps), side, group))
    fps, tree = fps[order], group[order].astype(np.int64) * 2 + side[order]
    # Leaves, and the levels above until each tree has one node.
    new = np.append(True, tree[1:] != tree[:-1])
    begin = np.flatnonzero(new)
    place = np.arange(len(fps)) - np.repeat(begin, np.diff(np.append(begin, len(fps))))
    cut = np.flatnonzero(place % LEAF == 0)
    levels = [(np.bitwise_and.reduceat(fps, cut), np.bitwise_or.reduceat(fps, cut), cut)]
    owner = tree[cut]
    while len(np.unique(owner)) < len(owner):
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        cut = np.flatnonzero(place % FAN == 0)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], cut), np.bitwise_or.reduceat(levels[-1][1], cut), cut))
        owner = owner[cut]
    # One node for each tree at the top now. A tree meets itself, or side 0 of its group meets side 1.
    two = np.flatnonzero((owner[:-1] % 2 == 0) & (owner[1:] == owner[:-1] + 1))
    alone = np.setdiff1d(np.arange(len(owner)), np.concatenate([two, two + 1]))
    work = [(len(levels) - 1, np.concatenate([alone, two]), np.concatenate([alone, two + 1]))]
    while work:
        level, a, b = work.pop()
        if len(a) > 1 << 15:
            half = len(a) // 2
            work += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        low, high, cut = levels[level]
        fixed = ~((low[a] ^ high[a]) | (low[b] ^ high[b]))
        near = np.bitwise_count((low[a] ^ low[b]) & fixed) <= radius
        a, b = a[near], b[near]
        if not len(a):
            continue
        end = np.append(cut[1:], len(levels[level - 1][0]) if level else len(fps))
        if level:
            na, nb = end[a] - cut[a], end[b] - cut[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = cut[a][pair] + nth // nb[pair], cut[b][pair] + nth % nb[pair]
            keep = (a[pair] != b[pair]) | (x <= y)
            work.append((level - 1, x[keep], y[keep]))
            continue
        for s in range(0, len(a), 4096):
            p, q = a[s : s + 4096], b[s : s + 4096]
            i = np.minimum(cut[p][:, None] + np.arange(LEAF), len(fps) - 1)
            j = np.minimum(cut[q][:, None] + np.arange(LEAF), len(fps) - 1)
            hit = np.bitwise_count(fps[i][:, :, None] ^ fps[j][:, None, :]) <= radius
            hit &= (cut[p][:, None] + np.arange(LEAF) < end[p][:, None])[:, :, None] & (cut[q][:, None] + np.arange(LEAF) < end[q][:, None])[:, None, :]
            hit &= (p != q)[:, None, None] | (np.arange(LEAF)[:, None] < np.arange(LEAF))
            n, u, v = np.nonzero(hit)
            if len(n):
                visit(order[i[n, u]], order[j[n, v]])


class Forest:
    """Union-find on array indices by vectorised min-label propagation with pointer jumping."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _tiles(rows: DataFrame, bounds: list[int], radius: int, most: int) -> DataFrame:
    """route, key, i, j, side and fp of rows (route, key, bits, fp) of large groups, once for each tile within reach of their own."""
    head = F.lit(0).cast("long")
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        # The bits outside the route's block, and the leading ones of those.
        rest = F.col("fp").bitwiseAND(F.lit((1 << lo) - 1))
        if hi < 64:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", hi), lo))
        head = F.when(F.col("route") == k, _leading(rest, 64 - (hi - lo))).otherwise(head)
    rows = C.materialise(rows.select("route", "key", "bits", "fp", head.alias("head")), "simhash-heads")
    tiles = C.materialise(rows.groupBy("route", "key", "bits", "head").agg(F.ceil(F.count("*") / GROUP_LIMIT).cast("int").alias("parts")), "simhash-tiles")
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in range(1 << b) if m.bit_count() <= radius]) for b in range(most + 1)])
    near = tiles.select("route", "key", "head", "parts", F.explode(F.element_at(masks, F.col("bits") + 1)).alias("mask"))
    near = near.select("route", "key", "head", "parts", F.col("head").bitwiseXOR(F.col("mask")).alias("other"))
    near = near.join(tiles.select("route", "key", F.col("head").alias("other"), F.col("parts").alias("of_other")), ["route", "key", "other"])
    near = near.groupBy("route", "key", "head", "parts").agg(F.collect_list(F.struct("other", "of_other")).alias("near"))
    name = lambda head, part: F.shiftleft(head, 32) + part
    out = rows.join(near, ["route", "key", "head"]).withColumn("own", name(F.col("head"), F.pmod(F.xxhash64("fp"), F.col("parts"))))
    out = out.select("route", "key", "own", "fp", F.inline("near")).select("route", "key", "own", "fp", "other", F.explode(F.sequence(F.lit(0), F.col("of_other") - 1)).alias("part"))
    out = out.withColumn("there", name(F.col("other"), F.col("part").cast("long")))
    return out.select("route", "key", F.least("own", "there").alias("i"), F.greatest("own", "there").alias("j"), (F.col("own") > F.col("there")).cast("int").alias("side"), "fp")


def _leading(rest: Column, width: int) -> Column:
    """The first ``bits`` of a pattern of ``width`` bits."""
    out = F.lit(0).cast("long")
    for b in range(1, min(RANGE_BITS, width) + 1):
        out = F.when(F.col("bits") == b, F.shiftrightunsigned(rest, width - b)).otherwise(out)
    return out


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within ``radius`` bits. Takes distinct ``fp``."""
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    n = radius + 1
    bounds = [64 * k // n for k in range(n + 1)]
    routes = F.array(*[F.struct(F.lit(k).alias("route"), F.shiftrightunsigned("fp", bounds[k]).bitwiseAND(F.lit((1 << (bounds[k + 1] - bounds[k])) - 1 if n > 1 else -1)).alias("key")) for k in range(n)])
    sent = C.materialise(fps.select("fp", F.inline(routes)), "simhash-routes")
    most = min(RANGE_BITS, 64 - max(hi - lo for lo, hi in zip(bounds, bounds[1:])))
    bits = F.least(F.lit(most), F.ceil(F.log2(F.col("count") / GROUP_LIMIT)).cast("int") + 1)
    hot = C.materialise(sent.groupBy("route", "key").count().where(F.col("count") > GROUP_LIMIT).select("route", "key", bits.alias("bits")), "simhash-hot")
    keys = ["route", "key", "i", "j"]
    tiled = sent.join(hot, ["route", "key"], "left_anti").select("route", "key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "fp")
    if not hot.isEmpty():
        tiled = tiled.unionByName(_tiles(sent.join(hot, ["route", "key"]), bounds, radius, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            cols = [np.concatenate([h[k] for h in held]) for k in range(6)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1 if len(cols[0]) > 1 else np.zeros(0, np.int64)
            end = len(cols[0]) if last else (int(change[-1]) if len(change) else 0)
            held, size = ([[c[end:] for c in cols]], len(cols[0]) - end) if end < len(cols[0]) else ([], 0)
            if end:
                fp = cols[5][:end].view(_U)
                group = np.zeros(end, np.int64)
                group[change[change < end]] = 1
                forest = Forest(end)
                hamming_join(fp, np.cumsum(group), cols[4][:end].astype(np.int64), radius, forest.union)
                linked = np.flatnonzero(forest.root != np.arange(end))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[forest.root[linked]].view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)])
                size += batch.num_rows
            if size >= 1 << 17:
                yield from flush(False)
        if size:
            yield from flush(True)

    edges = tiled.repartition(C.parallelism(fps.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
    return edges.where("a <> b").distinct()


def components(prints: DataFrame, radius: int) -> DataFrame:
    """fp and component_id (smallest doc_id of the component) of each distinct fp of prints (doc_id, fp)."""
    nodes = C.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the component) of each row of ``docs`` (doc_id, text)."""
    prints = C.materialise(with_fingerprints(docs, shingle), "simhash-prints")
    return prints.join(components(prints, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, but of each component only one: that of the smallest doc_id (nulls last)."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(data, offsets, shingle) for _, _, data, offsets in C.text_chunks(batch.column(1))]
            value = np.concatenate([np.zeros(0, _U), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(value.view(np.int64)), batch.column(2)], ["doc_id", "number", "fp", "row"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("number", T.LongType()), T.StructField("fp", T.LongType()), numbered.schema["row"]])
    # Written once: from then on a row's number is fixed.
    rows = C.materialise(numbered.mapInArrow(run, schema), "simhash-rows")
    owned = rows.select("doc_id", "number", "fp").join(components(rows.select("doc_id", "fp"), radius), "fp")
    winners = owned.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")).alias("first")).select(F.col("first.number").alias("number"))
    return rows.join(winners, "number", "left_semi").select("row.*")
