"""Repeated passages by an enhanced suffix array and its common-prefix intervals.

A byte is removed if a string of ``least`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
text. Matches never cross texts and are judged on the input.

Candidates. Every string of ``least`` bytes belongs to its anchor, the leftmost of its ``GRAM``-byte grams with the smallest hash;
equal strings have equal anchors at equal places. Strings with one anchor stand side by side, and their text is a window of
``least`` to ``2 * least - GRAM`` bytes. Windows are sent as numbers (hashes of the anchor and of the window, document, place) to
their anchor's bucket, after each task has folded windows that it saw before. There, a window that equals an earlier one is removed as a
whole; windows with one anchor and different text are fetched from their documents. Buckets grow in number with the bytes of the
table and are read one at a time, in sorted order.

Very common anchors. An anchor with more than ``HOT`` different windows is not gathered: each string of those windows becomes its own
anchor, is sent by the hash of all its bytes, and all but the first of equal strings are removed. A task that holds ``MOST`` windows
of a bucket sends such anchors on at once, so no bucket need fit in memory, whatever its commonest anchor.

Suffix arrays, for all other anchors. The suffixes of those windows of ``least`` or more bytes whose first ``least`` bytes occur twice in an anchor's
group are sorted, with the lengths of the prefixes that neighbours share. A stack scan lists the common-prefix intervals of
``least`` or more bytes. An interval whose suffixes follow different bytes (or a window's beginning) cannot be extended to the left
and is a maximal repeat group; the others lie within one that can. All occurrences of a maximal repeat but the first are removed.

Distribution: texts are joined by document with the few windows or spans they have; no text is collected, and no pairs are listed.
Buckets hold numbers only; a group of suffixes has at most ``HOT`` of an anchor and one head (its first bytes) each, and larger runs
of groups are cut between heads, which never parts a repeat.

Edge cases: null texts are empty; rows with equal doc_id and text are one document and have equal results, rows with one doc_id
and different texts follow each other by hash of the text; a null doc_id comes before all others; texts below ``least`` bytes are
kept whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST, GRAM = 100, 32
#: Windows that a task gathers before it sends them to their buckets.
HELD = 200_000
#: Different windows of an anchor that are gathered in one task; windows of a bucket that are held at once; windows whose suffixes are sorted at once.
HOT, MOST, WINDOWS = 256, 1 << 20, 12_000
#: Suffixes that are sorted at once.
SUFFIXES = 1 << 14
#: Bytes of the table for each task that buckets are dealt to, and buckets a task.
TASK_BYTES, PER_TASK = 2 << 20, 2
#: Bytes of text whose windows are found at once.
PIECE = 1 << 19
_U = np.uint64
_PLACE = _U((1 << 22) - 1)
_NONE = np.iinfo(np.int64).min
FIELDS = ("anchor", "window", "doc", "mark", "start", "size")
KINDS = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i4")
SPANS = "doc long, mark long, start long, size int"
FOUND = "bucket int, n int, anchor binary, window binary, doc binary, mark binary, start binary, size binary"


def windows(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, window hash, row, start in the row and size of every window of the rows of a buffer of up to 4 MB."""
    reach = least - gram + 1
    n = len(data) - least + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(_U), empty.astype(_U), empty, empty, empty
    prefix = C.prefix_hash(data)
    grams = len(data) - gram + 1
    h = C.mix64((prefix[gram:] - prefix[:-gram]) * C._power(C._BASE_INV, grams))
    low = (h & ~_PLACE) | np.arange(grams, dtype=_U)
    have = 1
    while have * 2 <= reach:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < reach:
        low = np.minimum(low[: len(low) - (reach - have)], low[reach - have :])
    counts = np.maximum(np.diff(offsets) - least + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    s = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    if not len(s):
        return empty.astype(_U), empty.astype(_U), empty, empty, empty
    place = (low[s] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    a, b = s[new], s[np.append(new[1:], len(s)) - 1] + least
    return h[place[new]], C.span_hash(prefix, a, b), row[new], a - offsets[row[new]], b - a


def repeated(keys: np.ndarray) -> np.ndarray:
    """Indices of entries whose key occurs more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def fold(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows as FIELDS: indices of those that equal an earlier one, and whether each index is not among them."""
    anchor, window, doc, mark, start, _ = cols
    some = repeated(window ^ (anchor * _U(0x9E3779B97F4A7C15)))
    if not len(some):
        return some, np.ones(len(anchor), bool)
    order = some[np.lexsort((start[some], mark[some], doc[some], window[some], anchor[some]))]
    equal = np.append(False, (anchor[order][1:] == anchor[order][:-1]) & (window[order][1:] == window[order][:-1]))
    again = equal & np.append(False, (doc[order][1:] == doc[order][:-1]) & (mark[order][1:] == mark[order][:-1]) & (start[order][1:] == start[order][:-1]))
    first = np.ones(len(anchor), bool)
    first[order[equal]] = False
    return order[equal & ~again], first  # a row that is there twice is no repeat of itself


def merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans with those that touch or overlap in one document joined."""
    if not len(doc):
        return doc, mark, start, end
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    owner = np.append(0, np.cumsum((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))
    far = np.maximum.accumulate(end + owner * (1 << 40)) - owner * (1 << 40)
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > far[:-1]))
    at = np.flatnonzero(new)
    return doc[at], mark[at], start[at], far[np.append(at[1:], len(doc)) - 1]


def _spans(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    doc, mark, start, end = merged(doc, mark, start, start + size)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(mark), pa.array(start), pa.array((end - start).astype(np.int32))], ["doc", "mark", "start", "size"])


def _blobs(cols: list[np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    values, cut = np.unique(bucket[order], return_index=True)
    ends = np.append(cut[1:], len(order))
    arrays = [pa.array(values.astype(np.int32)), pa.array((ends - cut).astype(np.int32))]
    for col, kind in zip(cols, KINDS, strict=True):
        col = col[order].astype(kind)
        arrays.append(pa.array([col[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "n", *FIELDS])


# ---------------------------------------------------------------- suffix arrays


def suffix_array(buffer: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes buffer[at:end] within their groups, and the bytes each shares with the one before it."""
    wide = int((end - at).max())
    cell = at[:, None] + np.arange(wide)
    inside = cell < end[:, None]
    rows = np.where(inside, buffer[np.minimum(cell, len(buffer) - 1)], np.uint8(0))
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), rows, (end - at).astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    rows, inside = rows[order], inside[order]
    same = (rows[1:] == rows[:-1]) & inside[1:] & inside[:-1]
    shared = np.where(same.all(1), wide, np.argmin(same, axis=1))
    shared[group[order][1:] != group[order][:-1]] = 0
    return order, np.append(0, shared)


def intervals(shared: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, bytes) of the maximal repeats: intervals that share ``least`` or more bytes and follow different bytes.

    ``left``: the byte before each suffix, or a number of its own below 0 where none is known.
    """
    stack: list[list] = []  # [bytes, first, left byte or None if several]

    def join(a, b):
        return a if a == b and a is not None else None

    n = len(shared)
    for i in range(1, n + 1):
        now = int(shared[i]) if i < n else 0
        first, seen = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            size, first, byte = stack.pop()
            byte = join(byte, seen)
            if byte is None:
                yield first, i - 1, size
            seen = byte
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = join(stack[-1][2], seen)
            else:
                stack.append([now, first, seen])


def removals(anchor: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, texts: list[bytes], least: int = LEAST) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans to remove among windows of different text, grouped by anchor."""
    # Rows that are there twice count once.
    once = np.lexsort((start, mark, doc, anchor))
    once = once[np.append(True, np.any([c[once][1:] != c[once][:-1] for c in (anchor, doc, mark, start)], axis=0))]
    anchor, doc, mark, start, texts = anchor[once], doc[once], mark[once], start[once], [texts[k] for k in once.tolist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(sizes) - sizes
    counts = sizes - least + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + base[owner]
    head = C.span_hash(C.prefix_hash(buffer), at, at + least) ^ C.mix64(anchor[owner].view(_U))
    some = repeated(head)
    some = some[np.argsort(head[some], kind="stable")]
    i = 0
    while i < len(some):
        j = min(i + SUFFIXES, len(some))
        if j < len(some):  # never part suffixes with equal first bytes
            k = j
            while k > i and head[some[k]] == head[some[k - 1]]:
                k -= 1
            j = k if k > i else int(np.searchsorted(head[some], head[some[i]], side="right"))
        part = some[i:j]
        i = j
        w, a = owner[part], at[part]
        order, shared = suffix_array(buffer, a, base[w] + sizes[w], head[part])
        w, a = w[order], a[order]
        left = np.where(a > base[w], buffer[np.maximum(a - 1, 0)].astype(np.int64), -1 - np.arange(len(a)))
        rank = np.empty(len(a), np.int64)
        rank[np.lexsort((start[w] + a - base[w], mark[w], doc[w]))] = np.arange(len(a))
        hit: list[np.ndarray] = []
        long: list[np.ndarray] = []
        edges = np.flatnonzero(shared < least)
        last = np.append(edges[1:], len(shared))
        two = last - edges == 2
        e = edges[two]
        e = e[left[e] != left[e + 1]]
        hit.append(np.where(rank[e] > rank[e + 1], e, e + 1))
        long.append(shared[e + 1])
        for x, y in zip(edges[last - edges > 2].tolist(), last[last - edges > 2].tolist(), strict=True):
            inner = shared[x:y].copy()
            inner[0] = 0
            for p, q, size in intervals(inner, left[x:y].tolist(), least):
                own = np.arange(x + p, x + q + 1)
                own = np.delete(own, np.argmin(rank[own]))
                hit.append(own)
                long.append(np.full(len(own), size))
        k, size = np.concatenate(hit), np.concatenate(long)
        if len(k):
            yield doc[w[k]], mark[w[k]], start[w[k]] + a[k] - base[w[k]], size


# ---------------------------------------------------------------- the plan


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


MET = "anchor long, hot boolean, " + SPANS


def _met(anchor: np.ndarray | None, hot: np.ndarray | None, doc: pa.Array, mark: pa.Array, start: pa.Array, size: pa.Array) -> pa.RecordBatch:
    """Windows to fetch, or spans to remove (no anchor)."""
    name = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
    flag = pa.nulls(len(doc), pa.bool_()) if hot is None else pa.array(hot)
    return pa.RecordBatch.from_arrays([name, flag, doc, mark, start, size], ["anchor", "hot", "doc", "mark", "start", "size"])


def meeting(pieces: DataFrame, n: int, least: int, gram: int) -> DataFrame:
    """MET rows of all windows of ``pieces`` (doc, mark, base, text); a piece stands at byte ``base`` of its document."""
    buckets = n * PER_TASK
    most, hot_size = MOST, HOT

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            later, first = fold(cols)
            if len(later):  # to be removed as they stand: bucket -1 - n
                doc, mark, start, end = merged(*(cols[k][later] for k in (2, 3, 4)), cols[4][later] + cols[5][later])
                zero = np.zeros(len(doc), _U)
                for s in range(0, len(doc), 1 << 16):
                    e = s + (1 << 16)
                    yield _blobs([zero[s:e], zero[s:e], doc[s:e], mark[s:e], start[s:e], (end - start)[s:e]], (C.mix64(doc[s:e].view(_U)) % _U(n)).astype(np.int64) - n)
            cols = [c[first] for c in cols]
            yield _blobs(cols, (C.mix64(cols[0]) % _U(buckets)).astype(np.int64))

        for batch in batches:
            doc, mark, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, j, data, offsets in C.text_chunks(batch.column(3), PIECE):
                step = PIECE
                parts = [(0, data, offsets)] if len(data) <= step else [(p, data[p : p + step + least - 1], np.array([0, min(step + least - 1, len(data) - p)])) for p in range(0, len(data), step)]
                for at, part, cut in parts:
                    anchor, window, row, start, length = windows(part, cut, least, gram)
                    for s in range(0, len(anchor), HELD):
                        e = s + HELD
                        held.append([anchor[s:e], window[s:e], doc[i:j][row[s:e]], mark[i:j][row[s:e]], start[s:e] + at + base[i:j][row[s:e]], length[s:e]])
                        size += len(held[-1][0])
                        if size >= HELD:
                            yield from flush()
                            held.clear()
                            size = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, limit, bucket = 0, most, None
        gone = np.zeros(0, _U)  # anchors of the bucket whose windows are sent on

        def folded() -> tuple[list[np.ndarray], pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            later, first = fold(cols)
            return [c[first] for c in cols], _met(None, None, *_spans(*(cols[k][later] for k in (2, 3, 4)), cols[5][later].astype(np.int64)).columns)

        def sent(cols: list[np.ndarray], rows: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(rows), 1 << 16):
                r = rows[s : s + (1 << 16)]
                yield _met(cols[0][r], hot[s : s + (1 << 16)], *(pa.array(cols[k][r]) for k in (2, 3, 4)), pa.array(cols[5][r].astype(np.int32)))

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            if not len(gone):  # windows of anchors that occur once are of no use
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                some = repeated(cols[0])
                held[:] = [[c[some] for c in cols]]
            cols, spans = folded()
            yield spans
            some = repeated(cols[0])
            _, which, count = np.unique(cols[0][some], return_inverse=True, return_counts=True)
            yield from sent(cols, some, count[which] > hot_size)

        def shrink() -> Iterator[pa.RecordBatch]:
            """Fold the held windows, and send on those of very common anchors."""
            nonlocal held, size, limit, gone
            cols, spans = folded()
            yield spans
            if len(cols[0]) > limit // 2 and gram < least:
                names, which, count = np.unique(cols[0], return_inverse=True, return_counts=True)
                hot = count > hot_size
                gone = np.union1d(gone, names[hot])
                rows = np.flatnonzero(hot[which])
                yield from sent(cols, rows, np.ones(len(rows), bool))
                cols = [c[~hot[which]] for c in cols]
            held, size = [cols], len(cols[0])
            limit = max(most, 2 * size)

        for batch in batches:
            names = batch.column("bucket").to_numpy()
            for k, name in enumerate(names.tolist()):
                cols = [np.frombuffer(batch.column(f)[k].as_py(), kind) for f, kind in zip(FIELDS, KINDS, strict=True)]
                if name < 0:  # what tasks have removed already passes through
                    yield _met(None, None, *_spans(*cols[2:5], cols[5].astype(np.int64)).columns)
                    continue
                if name != bucket:
                    yield from finish()
                    held, size, limit, bucket, gone = [], 0, most, name, np.zeros(0, _U)
                if len(gone):
                    out = np.isin(cols[0], gone)
                    yield from sent(cols, np.flatnonzero(out), np.ones(int(out.sum()), bool))
                    cols = [c[~out] for c in cols]
                held.append(cols)
                size += len(cols[0])
                if size > limit:
                    yield from shrink()
        yield from finish()

    blobs = pieces.select("doc", "mark", "base", "text").mapInArrow(find, FOUND)
    return blobs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, MET)


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc (doc_id, or the least long for null), mark (hash of the text), start and size of spans of bytes to remove; they may overlap."""
    if least < 2 * GRAM:
        raise ValueError(f"least must be {2 * GRAM} or more")
    n = C.partitions_of(docs, TASK_BYTES)
    rows = _rows(docs)
    met = C.materialise(meeting(rows.withColumn("base", F.lit(0).cast("long")), n, least, GRAM), "suffix-met")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                flat, offsets = C.text_buffer(part.column(2))
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                fields = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
                begin = offsets[owner] + fields[2]
                texts = [flat[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + fields[3]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fields[0]), pa.array(fields[1].astype(bool)), *[part.column(k).take(pa.array(owner)) for k in (0, 1)], pa.array(fields[2]), pa.array(texts, pa.binary())],
                    ["anchor", "hot", "doc", "mark", "start", "text"],
                )

    wanted = met.where("anchor is not null").groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "hot", "start", "size")).alias("windows"))
    texts = rows.repartition(n, "doc", "mark").join(wanted.repartition(n, "doc", "mark"), ["doc", "mark"]).select("doc", "mark", "text", "windows").mapInArrow(fetch, "anchor long, hot boolean, doc long, mark long, start long, text binary")
    spans = met.where("anchor is null").select("doc", "mark", "start", "size")
    if not met.where("hot").isEmpty():
        texts = C.materialise(texts, "suffix-texts")
        strings = meeting(texts.where("hot").select("doc", "mark", F.col("start").alias("base"), "text"), n, least, least)
        spans = spans.unionByName(strings.select("doc", "mark", "start", "size"))
        texts = texts.where("not hot")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for doc, mark, start, length in removals(*(table.column(k).to_numpy() for k in range(4)), table.column(4).to_pylist(), least):
                yield _spans(doc, mark, start, length)

        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                held.append(whole.slice(i, 4096))
                size += held[-1].num_rows
                if size > WINDOWS:  # whole anchors only: rows come sorted by anchor
                    table = pa.Table.from_batches(held)
                    name = table.column(0).to_numpy()
                    end = int(np.searchsorted(name, name[-1]))
                    if end:
                        yield from run(table.slice(0, end))
                        rest = table.slice(end).combine_chunks()
                        held, size = rest.to_batches(), rest.num_rows
        if held:
            yield from run(pa.Table.from_batches(held))

    sorted_ = texts.select("anchor", "doc", "mark", "start", "text").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(sort, SPANS)
    return spans.unionByName(sorted_)


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the maximal removed runs, in bytes) and kept (the remaining bytes) of each row."""
    found = C.materialise(repeats(docs, least), "suffix-spans").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "size")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            ids, texts, found = (batch.column(k) for k in range(3))
            spans, kept, sizes = [], [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py().encode()
                at, parts, runs = 0, [], []
                own = found[k].values
                if own is not None and len(own):
                    start = own.field("start").to_numpy()
                    zero = np.zeros(len(start), np.int64)
                    _, _, begin, end = merged(zero, zero, start, start + own.field("size").to_numpy())
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        parts.append(text[at:a])
                        at = b
                        runs.append({"start": a, "end": b})
                spans.append(runs)
                sizes.append(len(text))
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    n = C.partitions_of(docs, TASK_BYTES)  # small tasks: each sorts its texts
    rows = _rows(docs).repartition(n, "doc", "mark").join(found.repartition(n, "doc", "mark"), ["doc", "mark"], "left").select("doc_id", "text", "found")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(result: DataFrame) -> DataFrame:
    """The digest columns of :func:`dedup`'s rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
