"""Cross-tokenizer alignment by segments: distinct pieces of text are tokenised and aligned once, and documents composed of them.

A text (with a space before it) is cut before each run of blanks that begins with a space or a line feed after a letter, digit or mark,
wherever neither vocabulary can merge across: no entry of either holds that mark and blank in a row, nor the space that the second tokenizer adds and a line
feed. The first one's pre-tokenizer cuts there anyway. So the segments' tokens are those of the whole text.

1. Texts are gathered into chunks of about CHUNK bytes. A chunk numbers its distinct segments; a document becomes those numbers.
2. The segments of all chunks are shuffled by their text, so equal ones stand together: each is tokenised by both and aligned once, and
   the alignment goes back to every chunk that has it. A key has at most one row a chunk, however common the segment.
3. A chunk composes its documents from the alignments, and counts for each linked id pair the documents that have it. Counts of pairs
   are added up over the chunks (again one row a chunk), ranked within each id, sent back to the chunks and summed over the documents' links.

Each step's table is written to the shared folder. A task holds a chunk, never a group of documents or a key's rows.

A segment's alignment is text: ids of the first tokenizer, ``|``, ids of the second, groups separated by ``;``.

Edge cases. Null and empty texts, and texts whose tokens of either kind do not spell the text (such as one that holds U+2581), have no tokens: zeros and an empty digest. Repeated rows
are documents of their own, also in the counts; a null doc_id stays null; an empty table gives no rows. Other columns are ignored.
Texts of any length are read whole; a text without blanks is one segment.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import byte_letters

#: Bytes of text in a chunk; bounds what a task of the compose step holds.
CHUNK = 8 << 20
#: Segments that are tokenised at once, and alignments that are held to be packed by chunk.
BATCH, HELD = 4096, 1 << 18
_DIGIT = np.ones(256, bool)
_DIGIT[48:58] = False


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        self.a_bytes = {i: bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode() for entry, i in self.a.get_vocab().items()}
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.lone_space = self.b.piece_to_id("▁")
        self.a_list = [self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_list, self.b_bytes))
        #: Ids as they are written, with what may follow them.
        self.a_shown, self.b_shown = (np.array([[f"{i}{mark}" for i in range(len(x))] for mark in marks], object) for x, marks in ((self.a_list, ",|"), (self.b_bytes, ",;\n")))
        self.before: dict[str, regex.Pattern] = {}
        self.cut = self._cuts()
        self.cuts_after = _Cuts(self.before.get(" "))

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _cuts(self) -> regex.Pattern:
        """Matches the empty string where a text may be cut: neither vocabulary has an entry across."""
        entries = [*self.a_bytes.values(), *self.b_bytes]
        rules = []
        for blank in " \n":
            joined = {e[: at + 1].decode("utf-8", "replace")[-2:-1] for e in entries for at in range(1, len(e)) if e[at] == ord(blank)}
            # What stands before is no blank by anybody's reckoning; blanks before blanks are one run and are not cut.
            barred = "".join(regex.escape(c) for c in sorted(joined) if not c.isspace())
            if "\ufffd" in joined or (blank == "\n" and any(b" \n" in e for e in self.b_bytes)):
                continue
            before = rf"[\p{{L}}\p{{N}}\p{{P}}\p{{S}}--[▁{barred}]]"
            self.before[blank] = regex.compile(before, regex.V1)
            rules.append(rf"(?<={before})(?={regex.escape(blank)})")
        return regex.compile("|".join(rules) or r"(?!)", regex.V1)

    def segments(self, text: str) -> list[str]:
        """The segments of a space and ``text``: those of ``cut``, which looks at every character; here only what stands before a space is looked up."""
        parts = text.split(" ")
        after = [self.cuts_after[p[-1:]] for p in parts[:-1]]
        if all(after):
            out = [f" {p}" for p in parts]
        else:
            out, held = [], " " + parts[0]
            for p, cut in zip(parts[1:], after, strict=True):
                if cut:
                    out.append(held)
                    held = " " + p
                else:
                    held += " " + p
            out.append(held)
        return [x for s in out for x in (self.cut.split(s) if "\n" in s else (s,))] if "\n" in text else out

    def align(self, segments: list[str]) -> list[str | None]:
        """The alignment of each segment; None where tokens do not spell it."""
        firsts = self.a.encode_batch_fast(segments, add_special_tokens=False)
        # The second tokenizer adds a space: one that is there is left out, before a line feed it is a token of its own.
        seconds = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, segment in enumerate(segments):
            if segment == " ":  # an empty text gets no space
                seconds[k] = [self.lone_space]
            elif segment[0] != " ":
                if seconds[k][:1] != [self.lone_space]:
                    raise ValueError("the second tokenizer does not begin with a space of its own")
                seconds[k] = seconds[k][1:]
        data, a_lists = [s.encode() for s in segments], [x.ids for x in firsts]
        if self._spell(data, a_lists, self.a_list, self.a_size) and self._spell(data, seconds, self.b_bytes, self.b_size):
            return self._shown(a_lists, seconds)
        out: list[str | None] = [None] * len(segments)
        spelled = [k for k, (d, x, y) in enumerate(zip(data, a_lists, seconds, strict=True)) if self._spell([d], [x], self.a_list, self.a_size) and self._spell([d], [y], self.b_bytes, self.b_size)]
        for k, shown in zip(spelled, self._shown([a_lists[k] for k in spelled], [seconds[k] for k in spelled]), strict=True):
            out[k] = shown
        return out

    @staticmethod
    def _spell(data: list[bytes], lists: list[list[int]], entries: list[bytes], size: np.ndarray) -> bool:
        """Whether the tokens of each segment spell it."""
        if b"".join(map(entries.__getitem__, chain.from_iterable(lists))) != b"".join(data):
            return False
        if len(data) == 1:
            return True
        # The bytes of all are equal, and so those of each where segments end at the same places.
        ends = np.append(0, np.cumsum(size[np.fromiter(chain.from_iterable(lists), np.int64)]))
        return np.array_equal(ends[np.cumsum(list(map(len, lists)))], np.cumsum(list(map(len, data))))

    def _shown(self, a_lists: list[list[int]], b_lists: list[list[int]]) -> list[str]:
        """The alignments of segments that both spell, all at once: as if they were one text, whose groups end where tokens of both do."""
        if not len(a_lists):
            return []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_lists, b_lists))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if not (self.a_size[a].all() and self.b_size[b].all()):
            return [self._aligned(b"".join(map(self.a_list.__getitem__, x)), x, y) for x, y in zip(a_lists, b_lists, strict=True)]
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        closes_a, closes_b = ends[of_a] == a_end, (ends[of_b] == b_end).astype(np.int64)
        closes_b[np.cumsum(list(map(len, b_lists))) - 1] = 2
        shown = np.empty(len(a) + len(b), object)
        # A group's tokens of the first kind stand before those of the second.
        shown[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = self.a_shown[closes_a.astype(np.int64), a]
        shown[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = self.b_shown[closes_b, b]
        return "".join(shown.tolist()).split("\n")[:-1]

    def _aligned(self, spelled: bytes, a_ids: list[int], b_ids: list[int]) -> str | None:
        a_bytes, b_bytes = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        if b"".join(a_bytes) != spelled or b"".join(b_bytes) != spelled:
            return None
        if len(a_ids) == 1 or len(b_ids) == 1:
            return f"{','.join(map(str, a_ids))}|{','.join(map(str, b_ids))}"
        groups = []
        i = j = at_a = at_b = from_a = from_b = 0
        while i < len(a_ids):
            at_a += len(a_bytes[i])
            i += 1
            while at_b < at_a:
                at_b += len(b_bytes[j])
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a_ids[from_a:i]))}|{','.join(map(str, b_ids[from_b:j]))}")
                from_a, from_b = i, j
        return ";".join(groups)


class _Cuts(dict):
    """Whether a text may be cut between a character and a space."""

    def __init__(self, before: regex.Pattern | None):
        super().__init__({"": False})
        self.before = before

    def __missing__(self, key: str) -> bool:
        self[key] = out = self.before is not None and self.before.fullmatch(key) is not None
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(first: str, second: str) -> Pair:
    """The worker's tokenizers, kept between tasks."""
    if (first, second) not in _pairs:
        _pairs[first, second] = Pair(first, second)
    return _pairs[first, second]


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as bytes: planes of their lowest, second, ... bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


# ---------------------------------------------------------------- 1: chunks


def chunks(docs: DataFrame, first: str, second: str, size: int = CHUNK) -> DataFrame:
    """chunk, no, and either doc_id and data (a document's segment numbers) or segment (the text of number no)."""
    schema = pa.schema([("chunk", pa.int64()), ("no", pa.int64()), ("doc_id", pa.int64()), ("data", pa.binary()), ("segment", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pair_of(first, second).segments
        chunk, held, numbers, n = TaskContext.get().partitionId() << 32, 0, _Numbers(), 0

        def segments() -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            for i in range(0, len(names), 1 << 16):
                part = names[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(np.arange(i, i + len(part))), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary()), pa.array(part, pa.string())], schema=schema)

        for batch in C.slices(batches, 64):
            texts, data = batch.column(1).to_pylist(), []
            for text in texts:
                data.append(packed(np.array(list(map(numbers.__getitem__, split(text))) if text else [], np.uint32)))
                held += len(text or "")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), chunk)), pa.array(np.arange(n, n + len(texts))), batch.column(0), pa.array(data, pa.binary()), pa.nulls(len(texts), pa.string())], schema=schema)
            n += len(texts)
            if held >= size:
                yield from segments()
                chunk, held, numbers, n = chunk + 1, 0, _Numbers(), 0
        yield from segments()
        C.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk long, no long, doc_id long, data binary, segment string")


# ---------------------------------------------------------------- 2: alignments


def _aligned_batches(batches: Iterator[pa.RecordBatch], column: int, first: str, second: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches of rows sorted by segment with the alignment of each row; equal segments are tokenised once."""
    pair, last, known = pair_of(first, second), None, None
    for batch in C.slices(batches, BATCH):
        names = batch.column(column).to_pylist()
        new = [s for s, before in zip(names, [last, *names], strict=False) if s != before]
        found = iter(pair.align(new)) if new else iter(())
        out = []
        for s in names:
            if s != last:
                last, known = s, next(found)
            out.append(known)
        yield batch, out


def alignments(parts: DataFrame, first: str, second: str) -> DataFrame:
    """chunk and data: numbers of segments and their alignments (empty: none), many to a row; each distinct segment is tokenised and aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[str]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for i in range(0, len(names), 1024):
                part = names[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([_pack_links(*held[c]) for c in part], pa.binary())], ["chunk", "data"])
            held.clear()

        for batch, links in _aligned_batches(batches, 2, first, second):
            for chunk, no, link in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), links, strict=True):
                own = held.get(chunk)
                if own is None:
                    own = held[chunk] = ([], [])
                own[0].append(no)
                own[1].append(link or "")
            size += len(links)
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()
        C.release()

    rows = parts.where("segment is not null").select("chunk", "no", "segment")
    rows = rows.repartition(C.partitions_of(rows, 64 << 20), "segment").sortWithinPartitions("segment")
    return rows.mapInArrow(run, "chunk long, data binary")


def _pack_links(nos: list[int], links: list[str]) -> bytes:
    body = np.array(nos, "<u4").tobytes() + "\n".join(links).encode()
    return len(nos).to_bytes(4, "little") + zlib.compress(body, 1)


def _unpack_links(data: bytes) -> tuple[np.ndarray, list[str]]:
    n, body = int.from_bytes(data[:4], "little"), zlib.decompress(data[4:])
    return np.frombuffer(body, "<u4", n), body[4 * n :].decode().split("\n")


# ---------------------------------------------------------------- 3: documents


class Links:
    """The alignments of a chunk's segments as arrays by segment number."""

    def __init__(self, texts: list[str]):
        self.valid = np.array([t != "" for t in texts], bool)
        self.texts = texts
        data, offsets = C.text_buffer(pa.array(texts, pa.string()))
        starts, ends, _ = C.word_spans(data, offsets, _DIGIT)
        value, place = np.zeros(len(starts), np.int64), ends - 1
        for k in range(10):
            on = place - k >= starts
            if not on.any():
                break
            value[on] += (data[place[on] - k].astype(np.int64) - 48) * 10**k
        row = np.searchsorted(offsets, starts, side="right") - 1
        before = np.where(starts == offsets[row], ord(";"), data[np.maximum(starts - 1, 0)])
        group, bars = np.cumsum(before == ord(";")) - 1, np.cumsum(before == ord("|"))
        second = bars == group + 1
        n = int(group[-1]) + 1 if len(group) else 0
        a, b = value[~second], value[second]
        of_a, of_b = group[~second], group[second]
        n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        reach = n_b[of_a]
        at = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat((np.cumsum(n_b) - n_b)[of_a], reach)
        pair, link_row = np.repeat(a, reach) << 32 | b[at], np.repeat(row[~second], reach)
        rows = len(offsets) - 1
        self.n_a, self.n_b = np.bincount(row[~second], minlength=rows), np.bincount(row[second], minlength=rows)
        self.n_groups = np.bincount(row[before == ord(";")], minlength=rows)
        self.n_links = np.bincount(link_row, minlength=rows)
        self.pairs, self.local = np.unique(pair, return_inverse=True)
        self.from_ = np.append(0, np.cumsum(self.n_links))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pair numbers that a document of these segments links, ascending, and how often."""
        distinct, times = np.unique(numbers, return_counts=True)
        count = self.n_links[distinct]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.from_[distinct], count)
        pairs, where = np.unique(self.local[at], return_inverse=True)
        return pairs, np.bincount(where, np.repeat(times, count), len(pairs)).astype(np.int64)


_COMPOSED = pa.schema([("chunk", pa.int64()), ("no", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("data", pa.binary()), ("pair", pa.int64()), ("n_docs", pa.int64())])


def composed(parts: DataFrame, links: DataFrame, with_groups: bool = False) -> DataFrame:
    """Rows of documents (doc_id, sizes, digest, data: pair numbers and how often) and of the chunks' pairs (no, pair, n_docs)."""
    docs = parts.where("segment is null").select("chunk", F.lit(1).alias("kind"), "no", "doc_id", "data")
    rows = links.select("chunk", F.lit(0), F.lit(0).cast("long"), F.lit(None).cast("long"), "data").union(docs).toDF("chunk", "kind", "no", "doc_id", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, held, n_docs = None, [], None, None

        def pairs() -> Iterator[pa.RecordBatch]:
            if held is not None and len(held.pairs):
                own = np.flatnonzero(n_docs)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now)), pa.array(own), *[pa.nulls(n, t) for t in _COMPOSED.types[2:10]], pa.array(held.pairs[own]), pa.array(n_docs[own])], schema=_COMPOSED)

        for batch in batches:
            chunk, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            edge = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]))) if len(chunk) else []
            for i, j in zip(edge, [*edge[1:], len(chunk)], strict=True):
                if chunk[i] != now:
                    yield from pairs()
                    now, texts, held, n_docs = chunk[i], [], None, None
                if kind[i] == 0:
                    texts += map(_unpack_links, batch.column(4).slice(i, j - i).to_pylist())
                    continue
                if held is None:
                    names = [""] * sum(len(nos) for nos, _ in texts)
                    for nos, links in texts:
                        for no, link in zip(nos.tolist(), links, strict=True):
                            names[no] = link
                    texts, held = [], Links(names)
                    n_docs = np.zeros(len(held.pairs), np.int64)
                out: list[list] = [[] for _ in range(7)]
                for data in batch.column(4).slice(i, j - i).to_pylist():
                    numbers = unpacked(data)
                    if not len(numbers) or not held.valid[numbers].all():
                        numbers = numbers[:0]
                    own, times = held.of(numbers)
                    n_docs[own] += 1
                    shown = ";".join([held.texts[k] for k in numbers.tolist()])
                    sizes = [int(size[numbers].sum()) for size in (held.n_a, held.n_b, held.n_groups, held.n_links)]
                    for column, value in zip(out, [*sizes, hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown if with_groups else None, packed(np.concatenate([np.diff(own, prepend=0), times]))], strict=True):
                        column.append(value)
                n = j - i
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), batch.column(3).slice(i, n), *[pa.array(c, t) for c, t in zip(out, _COMPOSED.types[3:10], strict=True)], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_COMPOSED)
        yield from pairs()
        C.release()

    grouped = rows.repartition(C.partitions_of(parts, CHUNK), "chunk").sortWithinPartitions("chunk", "kind", "no")
    return grouped.mapInArrow(run, "chunk long, no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, data binary, pair long, n_docs long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (first id in the high half), n (documents of the corpus that hold it linked), best (whether its first id has none above)."""
    counts = rows.where("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n"))
    # A window holds at most the second vocabulary.
    of_first = Window.partitionBy(F.shiftrightunsigned("pair", 32))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_first))


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of :func:`composed` with n_best and count_sum."""
    known = rows.where("pair is not null").select("chunk", "no", "pair").join(counts, "pair").select("chunk", "no", "n", "best")
    docs = rows.where("pair is null").select("chunk", F.lit(1).alias("kind"), "no", F.lit(0).cast("long").alias("n"), F.lit(False).alias("best"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "data")
    nothing = [F.lit(None).cast(t) for t in ("long", "long", "long", "long", "long", "string", "string", "binary")]
    both = known.select("chunk", F.lit(0), "no", "n", "best", *nothing).union(docs).toDF(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nos, ns, bests, count, best = None, [], [], [], None, None
        for batch in batches:
            chunk, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            edge = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]))) if len(chunk) else []
            for i, j in zip(edge, [*edge[1:], len(chunk)], strict=True):
                if chunk[i] != now:
                    now, nos, ns, bests, count = chunk[i], [], [], [], None
                if kind[i] == 0:
                    for held, k in ((nos, 2), (ns, 3), (bests, 4)):
                        held.append(batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False))
                    continue
                if count is None:
                    no = np.concatenate([np.zeros(0, np.int64), *nos])
                    size = int(no.max()) + 1 if len(no) else 0
                    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                    count[no], best[no] = np.concatenate([np.zeros(0, np.int64), *ns]), np.concatenate([np.zeros(0, bool), *bests])
                    nos, ns, bests = [], [], []
                sums: list[list[int]] = [[], []]
                for data in batch.column(12).slice(i, j - i).to_pylist():
                    pairs, times = unpacked(data).reshape(2, -1)
                    pairs = np.cumsum(pairs)
                    sums[0].append(int((best[pairs] * times).sum()))
                    sums[1].append(int((count[pairs] * times).sum()))
                own = [batch.column(k).slice(i, j - i) for k in range(5, 12)]
                yield pa.RecordBatch.from_arrays([*own[:5], pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), *own[5:]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])
        C.release()

    grouped = both.repartition(C.partitions_of(rows, CHUNK), "chunk").sortWithinPartitions("chunk", "kind", "no")
    return grouped.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, chunk: int = CHUNK, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of each document.

    groups is the document's alignment, as that of a segment; it is null unless asked for, as it is longer than the text.
    """
    first, second = first or default_paths()[0], second or default_paths()[1]
    parts = C.materialise(chunks(docs, first, second, chunk), "align-chunks")
    rows = C.materialise(composed(parts, alignments(parts, first, second), with_groups), "align-composed")
    C.discard(parts)
    out = C.materialise(scored(rows, pair_counts(rows)), "align-scored")
    C.discard(rows)
    return out


def segment_table(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """segment and links (its alignment, null if its tokens do not spell it) of each distinct segment of the corpus."""
    first, second = first or default_paths()[0], second or default_paths()[1]
    parts = C.materialise(chunks(docs, first, second), "align-chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, links in _aligned_batches(batches, 0, first, second):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(links, pa.string())], ["segment", "links"])

    return parts.where("segment is not null").select("segment").distinct().mapInArrow(run, "segment string, links string")
