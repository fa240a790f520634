"""Quality rules: base counts of a text, and an n-gram perplexity band of its language.

Language model, of each language by itself, from three passes over all rows:

1. Spark counts every word that holds a letter or digit, case and marks kept. Words with a share of 1 / 2**``SHARE`` or more of
   their language's words (and ``LEAST`` or more in number) are the vocabulary, at most 2**``SHARE`` words by their definition.
2. Bigrams of words are counted over the whole corpus, words outside the vocabulary as one symbol; and the runs of four byte classes
   (``BYTE_CLASS``) in those words. Both give an interpolated modified Kneser-Ney model (three discounts an order; orders below the
   highest count distinct left neighbours). Seen n-grams of the highest order are kept as arrays sorted by hash with a directory on
   the leading bits, lower orders as dense arrays.
3. Each text is scored: a word costs -log of its bigram's probability, one outside the vocabulary its spelling's as well. The loss
   is the mean over the text's words.

A word's place in the vocabulary depends on its share only, so a few copies of a text change neither the model nor the verdict on
them. A language has at most 2**``SHARE`` + 1 contexts. Models go to the tasks together while they are below ``MODEL_BYTES``; beyond
it, languages are counted and scored in several passes, so any number of languages have models and bands of their own. A model of more
than ``MOST_GRAMS`` n-grams is whole too, but sent in parts by the n-grams' hashes: its language's texts are read once a part, each part adds
the costs of its own range of hashes, seen and unseen n-grams alike, and costs are added as whole numbers, so parts change no loss.

Verdict: the loss must lie within ``BELOW`` and ``ABOVE`` robust deviations (``FLOOR`` nats at least) of its language's median over
the documents that pass the base rules; texts of n words are allowed ``SHORT`` / sqrt(n) more on either side. The upper side rejects
tables, marked and shouted words and random characters, the lower side texts of little but the commonest words.

Edge cases: null texts have no words and fail the base rules; a null language is a language of its own; texts without a word that
holds a letter or digit are not kept; repeated rows are judged alike; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .decontam import SEPARATES

#: Bits of a byte class and of a word's number; lengths of their n-grams.
CLASS_BITS, SPELLING, WORD_BITS, WORDS = 6, 4, 14, 2
SHARE, LEAST = 13, 4
WORD_MASK = (1 << WORD_BITS) - 1
#: Bytes of text that are scored at once, and bytes of models that are sent at once.
PIECE = 1 << 19
MODEL_BYTES = 256 << 20
#: N-grams of a model that are sent at once, and bytes of one in its arrays and their directory.
MOST_GRAMS, GRAM_BYTES = 1 << 22, 28
#: A cost's unit: sums of whole numbers are the same in any order.
SCALE = 1 << 24
#: Robust deviations below and above the median and the least deviation; allowance for short texts.
BELOW, ABOVE, FLOOR, SHORT = 6.0, 5.0, 0.25, 8.0
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Symbols of the base rules: # * $ % & | < >
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_U = np.uint64


def _byte_classes() -> np.ndarray:
    out = np.full(256, 37, np.int32)  # control bytes and rare marks
    out[[9, 10, 11, 12, 13, 32]] = 0
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    out[48:58] = 27
    for i, mark in enumerate(b".,-'\"!?:"):
        out[mark] = 28 + i
    out[SYMBOLS] = 36
    out[0x80:0xC0] = 38 + np.arange(64) % 20
    out[0xC0:] = 58 + np.arange(64) % 6
    return out


BYTE_CLASS = _byte_classes()


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four-gram that ends at each byte; a text begins after three blanks."""
    pad = SPELLING - 1
    rows = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    line = np.zeros(len(data) + pad * len(offsets), np.int32)
    at = np.arange(len(data)) + pad * rows
    line[at] = BYTE_CLASS[data]
    full = line[pad:].copy()
    for k in range(1, SPELLING):
        full |= line[pad - k : len(line) - k] << (CLASS_BITS * k)
    return full[at - pad]


def spoken(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words that hold a letter or digit, and the index of each row's first."""
    starts, ends, first = C.word_spans(data, offsets)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SEPARATES[data], out=marks[1:])
    some = marks[ends] > marks[starts]
    before = np.append(0, np.cumsum(some))
    starts, ends = starts[some], ends[some]
    return C.span_hash(C.prefix_hash(data), starts, ends), starts, ends, before[first]


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words as rows of their own, each with a blank behind."""
    offsets = np.append(0, np.cumsum(ends - starts + 1))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts + 1)
    out = data[np.minimum(at, len(data) - 1)]
    out[offsets[1:] - 1] = 32
    return out, offsets


def bigrams(vocabulary: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bigram of each word and the one before it. Words outside the sorted ``vocabulary`` are 0; before a text's first word comes the highest number."""
    at = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
    own = np.where(vocabulary[at] == words, at + 1, 0) if len(vocabulary) else np.zeros(len(words), np.int64)
    before = np.append(len(vocabulary) + 1, own[:-1])[: len(own)]
    before[first[:-1][first[:-1] < first[1:]]] = len(vocabulary) + 1
    return before << WORD_BITS | own


class Sums:
    """Counts of 64-bit keys by language, added up within a task."""

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, keys: np.ndarray) -> None:
        self.put(lang, *np.unique(keys, return_counts=True))

    def put(self, lang: str, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.setdefault(lang, []).append((keys, n))
        self.size += len(keys)

    def full(self) -> bool:
        """Whether as many keys are held as a task should hold, also after merging them."""
        if self.size > 1_000_000:
            self.merge()
        return self.size > 600_000

    def merge(self) -> None:
        for lang, parts in self.held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            self.held[lang] = [(keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]
        self.size = sum(len(parts[0][0]) for parts in self.held.values())

    def packed(self, parts: int) -> Iterator[pa.RecordBatch]:
        """What is held, which goes: a row (``PACK``) for each of ``parts``, with the keys that belong there and their counts as arrays, by language."""
        self.merge()
        if self.size:
            names = list(self.held)
            keys, n = (np.concatenate([self.held[lang][0][k] for lang in names]).view(np.int64) for k in (0, 1))
            code = (C.mix64(keys.view(_U)) % _U(parts)).astype(np.int64) * len(names) + np.repeat(np.arange(len(names)), [len(self.held[lang][0][0]) for lang in names])
            self.held, self.size = {}, 0
            order = np.argsort(code)
            keys, n, code = keys[order], n[order], code[order]
            heads = np.flatnonzero(np.diff(code, prepend=-1))  # of a part's languages
            part, lang = np.divmod(code[heads], len(names))
            rows = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(heads))
            ends = np.append(heads, len(keys))
            bytes_ = pa.py_buffer((ends[rows] * 8).astype(np.int32))
            lists = [pa.ListArray.from_arrays(rows.astype(np.int32), x) for x in (pa.array(names).take(pa.array(lang)), pa.array(np.diff(ends)))]
            arrays = [pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, bytes_, pa.py_buffer(x)]) for x in (keys, n)]
            out = pa.RecordBatch.from_arrays([pa.array(part[rows[:-1]].astype(np.int32)), *lists, *arrays], ["part", "lang", "size", "gram", "n"])
            for i, j in C.row_slices(ends[rows] * 16, C.CHUNK_BYTES):
                yield out.slice(i, j - i)

    def unpack(self, batch: pa.RecordBatch) -> None:
        """Adds rows of :meth:`packed`."""
        for langs, sizes, gram, n in zip(*[batch.column(k).to_pylist() for k in range(1, 5)], strict=True):
            at = np.cumsum(sizes)[:-1]
            for lang, keys, counts in zip(langs, np.split(np.frombuffer(gram, np.int64), at), np.split(np.frombuffer(n, np.int64), at), strict=True):
                self.put(lang, keys, counts)

    def drain(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for lang, [(keys, n)] in self.held.items():
            for i in range(0, len(keys), 1 << 16):
                part = pa.array(keys[i : i + (1 << 16)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(part), np.int8))), part, pa.array(n[i : i + (1 << 16)])], ["lang", "gram", "n"])
        self.held, self.size = {}, 0


#: A part of a task's counts; gram and n hold 64-bit numbers, ``size`` of them for each language.
PACK = "part int, lang array<string>, size array<long>, gram binary, n binary"


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, row numbers, bytes and offsets of chunks of a batch; the text is a column or stands in the column ``row``."""
    langs = batch.column("lang").to_pylist()
    text = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text").cast(pa.string())
    places: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        places.setdefault(lang, []).append(k)
    for lang, rows in places.items():
        at = np.array(rows)
        texts = text if len(places) == 1 else text.take(pa.array(at))
        for i, j, data, offsets in C.text_chunks(texts, PIECE):
            yield lang, at[i:j], data, offsets


def _counted(docs: DataFrame, keys: Callable[[str, np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """lang, gram and n: how often each key occurs, over all rows of docs (lang, text).

    Keys cross the shuffle in packs, a row for each task and part: a row for each key would make the executors' heaps grow with rows and hash maps.
    """
    parts = C.partitions_of(docs, 8 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in C.slices(batches):
            for lang, _, data, offsets in _by_language(batch):
                if len(data):
                    for found in keys(lang, data, offsets):
                        sums.add(lang, found)
                if sums.full():
                    yield from sums.packed(parts)
        yield from sums.packed(parts)
        C.release()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most = Sums(), 1_000_000
        for batch in batches:
            sums.unpack(batch)
            if sums.size > most:
                sums.merge()
                most = max(most, 2 * sums.size)
        yield from sums.drain()
        C.release()

    return docs.select("lang", "text").mapInArrow(run, PACK).repartitionById(parts, F.col("part")).mapInArrow(added, "lang string, gram long, n long")


def count_words(docs: DataFrame) -> DataFrame:
    """lang, gram (the word's hash) and n of every word."""

    def keys(_lang: str, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        yield spoken(data, offsets)[0]

    return _counted(docs, keys)


def count_grams(docs: DataFrame, vocabularies: dict[str, np.ndarray]) -> DataFrame:
    """lang, gram and n of all bigrams of words (below 0: -1 - gram) and of the byte classes of words outside the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def keys(lang: str, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        words, starts, ends, first = spoken(data, offsets)
        pairs = bigrams(shared.value[lang], words, first)
        yield -1 - pairs
        strange = (pairs & WORD_MASK) == 0
        if strange.any():
            yield grams(*spelled(data, starts[strange], ends[strange])).astype(np.int64)

    return _counted(docs, keys)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 or more (Chen and Goodman), by how many counts are 1, 2, 3, 4; plain ones where these are too few."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.1, 0.15], [0, 1, 2, 3])


class Layer:
    """What a model needs to know of all n-grams of an order together; n-grams may be added in any number of parts."""

    def __init__(self, bits: int, order: int):
        self.bits, self.lower = bits, (1 << bits * (order - 1)) - 1
        self.total = np.zeros(self.lower + 1)
        #: By context, n-grams with counts 1, 2, and 3 or more.
        self.kinds = np.zeros((3, self.lower + 1), np.int64)
        self.counts = np.zeros(5, np.int64)
        #: Distinct left neighbours of each n-gram of the next order below.
        self.below = np.zeros(self.lower + 1, np.int64)
        self.size = 0

    def add(self, gram: np.ndarray, n: np.ndarray) -> Layer:
        context, full = gram >> self.bits, len(self.total)
        self.total += np.bincount(context, n, full)
        for k in (1, 2, 3):
            self.kinds[k - 1] += np.bincount(context[n == k] if k < 3 else context[n >= k], minlength=full)
        self.counts += np.bincount(n[n < 5].astype(np.int64), minlength=5)
        self.below += np.bincount(gram & self.lower, minlength=full)
        self.size += len(gram)
        return self

    def smoothed(self) -> tuple[np.ndarray, np.ndarray]:
        """Discounts, and the weight of the order below in each context."""
        d = _discounts(*self.counts[1:])
        return d, np.where(self.total > 0, d[1:] @ self.kinds / np.maximum(self.total, 1), 1.0)


class Model:
    """Modified Kneser-Ney over symbols of ``bits`` bits, from counts of n-grams of the highest order; or a part of such a model.

    ``whole`` tells of the n-grams of all ``parts``; those given are of this ``part`` only.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, bits: int = CLASS_BITS, order: int = SPELLING, symbols: int = 1 << CLASS_BITS, whole: Layer | None = None, part: int = 0, parts: int = 1):
        keys, count = gram.astype(np.int64), n.astype(np.float64)
        top = Layer(bits, order).add(keys, count) if whole is None else whole
        self.bits, self.lower, self.part, self.parts = bits, top.lower, part, parts
        layers = [top]
        for k in range(order - 1, 0, -1):
            there = np.flatnonzero(layers[-1].below)
            layers.append(Layer(bits, k).add(there, layers[-1].below[there].astype(np.float64)))
        p = np.full(1, 1 / symbols)
        for k, (above, layer) in zip(range(1, order), reversed(list(zip(layers, layers[1:]))), strict=True):
            d, weight = layer.smoothed()
            every = np.arange(1 << bits * k)
            p = weight[every >> bits] * p[every & (len(p) - 1)]
            there = np.flatnonzero(above.below)
            left = above.below[there]
            p[there] += (left - d[np.minimum(left, 3)]) / layer.total[there >> bits]
        d, weight = top.smoothed()
        seen = (count - d[np.minimum(count, 3).astype(int)]) / top.total[keys >> bits] + weight[keys >> bits] * p[keys & self.lower]
        self.log_lower, self.log_weight = np.log(p).astype(np.float32), np.log(weight).astype(np.float32)
        hashed = self.hash(keys.astype(np.uint32))
        order_ = np.argsort(hashed)
        self.hashes, self.log_p = hashed[order_], np.log(seen[order_]).astype(np.float32)
        self.directory: np.ndarray | None = None

    @staticmethod
    def hash(gram: np.ndarray) -> np.ndarray:
        """A bijection of 32-bit numbers that spreads grams evenly. :func:`_in_part` does the same."""
        x = gram * np.uint32(0x9E3779B1)
        return x ^ (x >> np.uint32(15))

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log p of each n-gram's last symbol after those before it; 0 for n-grams of other parts."""
        h = self.hash(gram.astype(np.uint32))
        if self.parts == 1:
            return self._scored(gram, h)
        own = np.flatnonzero(h.astype(_U) * _U(self.parts) >> _U(32) == self.part)
        out = np.zeros(len(gram), np.float32)
        out[own] = self._scored(gram[own], h[own])
        return out

    def _scored(self, gram: np.ndarray, h: np.ndarray) -> np.ndarray:
        if self.directory is None:
            self.lead = max(8, int(len(self.hashes)).bit_length() + 2)
            self.directory = np.searchsorted(self.hashes, np.arange(1 << self.lead, dtype=np.uint64) << np.uint64(32 - self.lead)).astype(np.int32)
            self.padded = np.append(self.hashes, np.zeros(1, np.uint32))
        at = self.directory[h >> np.uint32(32 - self.lead)]
        found = (self.padded[at] == h) & (at < len(self.hashes))
        open_ = np.flatnonzero(~found & (at < len(self.hashes)))
        open_ = open_[self.padded[at[open_]] < h[open_]]
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hashes)]
            value = self.padded[at[open_]]
            found[open_] = value == h[open_]
            open_ = open_[value < h[open_]]
        out = self.log_p[np.minimum(at, len(self.log_p) - 1)] if len(self.log_p) else np.zeros(len(gram), np.float32)
        miss = np.flatnonzero(~found)
        g = gram[miss]
        out[miss] = self.log_weight[g >> self.bits] + self.log_lower[g & self.lower]
        return out


class Whole:
    """The highest orders of a language's two models, from all its n-grams."""

    def __init__(self) -> None:
        self.words, self.spelling = Layer(WORD_BITS, WORDS), Layer(CLASS_BITS, SPELLING)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        pairs = keys < 0
        self.words.add(-1 - keys[pairs], n[pairs].astype(np.float64))
        self.spelling.add(keys[~pairs], n[~pairs].astype(np.float64))


class Language:
    """Vocabulary, bigram and spelling models of one language, or part number ``part`` of ``parts`` of them."""

    def __init__(self, vocabulary: np.ndarray, keys: np.ndarray, n: np.ndarray, whole: Whole | None = None, part: int = 0, parts: int = 1):
        if whole is None:
            whole = Whole()
            whole.add(keys, n)
        self.vocabulary = vocabulary
        pairs = keys < 0
        self.words = Model(-1 - keys[pairs], n[pairs], WORD_BITS, WORDS, len(vocabulary) + 1, whole.words, part, parts)
        self.spelling = Model(keys[~pairs], n[~pairs], whole=whole.spelling, part=part, parts=parts) if whole.spelling.size else None

    def cost(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of -log p of each row's words, in units of 1 / SCALE, as far as this part has them; and the number of words."""
        words, starts, ends, first = spoken(data, offsets)
        pairs = bigrams(self.vocabulary, words, first)
        cost = _whole_numbers(self.words.score(pairs)) if len(words) else np.zeros(0, np.int64)
        strange = np.flatnonzero((pairs & WORD_MASK) == 0)
        if len(strange):
            out, at = spelled(data, starts[strange], ends[strange])
            cost[strange] += np.add.reduceat(_whole_numbers(self.spelling.score(grams(out, at))), at[:-1])
        total = np.append(0, np.cumsum(cost))
        return total[first[1:]] - total[first[:-1]], np.diff(first)


def _whole_numbers(log_p: np.ndarray) -> np.ndarray:
    return np.rint(log_p * np.float32(-SCALE)).astype(np.int64)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row (rows by columns)."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)

    def per_row(marks: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    starts, ends, first = C.word_spans(data, offsets)
    out[:, 0] = np.diff(first)
    out[:, 1] = per_row(~C.IS_BLANK[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = per_row(SYMBOLS[data])
    prefix = C.prefix_hash(data)
    # Lines with a word: between line feeds, each row ending its last line.
    feeds = np.flatnonzero(data == 10)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    line_end = np.sort(np.concatenate([feeds, offsets[1:][filled]]))
    line_row = np.searchsorted(offsets, np.minimum(line_end, len(data) - 1), side="right") - 1 if len(data) else np.zeros(0, np.int64)
    is_tail = np.isin(line_end, offsets[1:][filled]) & ~np.isin(line_end, feeds)
    if len(line_end):
        # A feed at the first byte of a row and the end of the row before it stand at the same place.
        both = np.flatnonzero(np.append(False, line_end[1:] == line_end[:-1]))
        is_tail[both - 1] = True
        is_tail[both] = False
        line_row = np.where(is_tail, np.searchsorted(offsets, line_end - 1, side="right") - 1, line_row)
        begin = np.concatenate([[0], np.where(is_tail[:-1], line_end[:-1], line_end[:-1] + 1)])
        worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, begin)
        h = C.span_hash(prefix, begin[worded], line_end[worded])
        for k in np.flatnonzero(line_end[worded] - begin[worded] >= 1024).tolist():  # long lines can be made to share such a hash
            line = data[begin[worded][k] : line_end[worded][k]].tobytes()
            h[k] = int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")
        rows = line_row[worded]
        order = np.lexsort((h, rows))
        same = (h[order][1:] == h[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        out[:, 3] = np.bincount(rows[order][1:][same], minlength=n)
    words = C.span_hash(prefix, starts, ends)
    at, row = C.rows_of_windows(first, WINDOW)
    if len(at):
        h = C.window_hash(words, WINDOW)[at] + C.mix64(row.astype(_U))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        out[:, 4] = per_row(np.cumsum(cover[:-1]) > 0, first)
    return out


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], T.StructField("loss", T.DoubleType())])


def scored(docs: DataFrame, models: dict[str, Language], last: bool = True) -> DataFrame:
    """Base counts and loss of each row of docs (doc_id, lang and text, or row, a struct with the text that is carried along).

    Where models come in parts, rows pass through this once a part: all but the ``last`` return docs and cost, which the next takes up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    carry = "row" in docs.columns
    began = "cost" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            base, n = np.zeros((batch.num_rows, 5), np.int64), np.zeros(batch.num_rows, np.int64)
            cost = batch.column("cost").to_numpy().copy() if began else n.copy()
            for lang, at, data, offsets in _by_language(batch):
                if last:
                    base[at] = base_counts(data, offsets)
                if lang in shared.value and len(data):
                    more, n[at] = shared.value[lang].cost(data, offsets)
                    cost[at] += more
            if last:
                loss = pa.array(cost / (np.maximum(n, 1) * float(SCALE)), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *[pa.array(base[:, k]) for k in range(5)], loss, *([batch.column("row")] if carry else [])],
                    ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "loss", *["row"] * carry],
                )
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cost)], [*batch.schema.names[:3], "cost"])
        C.release()

    if last:
        return docs.mapInArrow(run, T.StructType([*SCORED.fields, *([docs.schema["row"]] if carry else [])]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:3], T.StructField("cost", T.LongType())]))


def vocabularies(words: DataFrame, totals: dict[str, int]) -> dict[str, np.ndarray]:
    """Sorted hashes of the words of the vocabulary of each language of ``totals`` (its number of words)."""
    spark = words.sparkSession
    least = spark.createDataFrame([(lang, max(LEAST, -(-n // (1 << SHARE)))) for lang, n in totals.items()], "lang string, least long")
    table = words.join(F.broadcast(least), "lang").where("n >= least").select("lang", "gram").toArrow()
    langs, grams_ = np.array(table.column(0).to_pylist(), object), table.column(1).to_numpy().view(_U)
    return {lang: np.sort(grams_[langs == lang]) for lang in totals}


def train(docs: DataFrame) -> Iterator[tuple[dict[str, Language], int, int, bool]]:
    """Models by language, in groups that may be broadcast together, and which part of how many they are; whether it is the last group, of
    whole models or none. The parts of a language's model follow each other. docs: lang and text."""
    words = C.materialise(count_words(docs), "quality-words")
    totals = {r["lang"]: int(r["n"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    vocabulary = 8 << SHARE  # bytes of a language's, at most
    groups = _sized(dict.fromkeys(totals, vocabulary))
    for number, group in enumerate(groups, 1):
        known = vocabularies(words, {lang: totals[lang] for lang in group})
        some = docs if len(group) == len(totals) else docs.where(F.col("lang").isin(group))
        counts = C.materialise(count_grams(some, known), "quality-grams")
        parts = _parts(counts)
        for lang in group:
            whole, n = Whole(), parts.get(lang, 1)
            for k in range(n if n > 1 else 0):
                whole.add(*_arrays(counts, lang, k, n))
            for k in range(n if n > 1 else 0):
                yield {lang: Language(known[lang], *_arrays(counts, lang, k, n), whole, k, n)}, k, n, False
        _, size = _cuts(counts, [lang for lang in group if parts.get(lang, 1) == 1])
        together = _sized(size)
        for langs in together:
            out = {lang: Language(known[lang], *_arrays(counts, lang)) for lang in langs}
            last = langs is together[-1]
            if last:
                C.discard(counts, *([words] if number == len(groups) else []))
            if out or (last and number == len(groups)):
                yield out, 0, 1, last and number == len(groups)


def _parts(counts: DataFrame) -> dict[str, int]:
    """Parts that each language's model is sent in, MOST_GRAMS n-grams in each."""
    return {r["lang"]: -(-r["n"] // MOST_GRAMS) for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}


def _in_part(part: int, parts: int) -> Column:
    """Whether the n-gram's hash (:meth:`Model.hash`) lies in the part's range."""
    gram = F.when(F.col("gram") < 0, -1 - F.col("gram")).otherwise(F.col("gram"))
    x = (gram * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(parts), 32) == part


def _arrays(counts: DataFrame, lang: str, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A language's n-grams, or a part of them, and their counts."""
    rows = counts.where(F.col("lang") == lang)
    table = (rows.where(_in_part(part, parts)) if parts > 1 else rows).select("gram", "n").toArrow()
    return table.column("gram").to_numpy(), table.column("n").to_numpy()


def _sized(size: dict[str, int]) -> list[list[str]]:
    """Languages in order, in groups of at most MODEL_BYTES together; an empty one if there are none."""
    groups: list[list[str]] = [[]]
    held = 0
    for lang, n in size.items():
        if groups[-1] and held + n > MODEL_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(lang)
        held += n
    return groups


def _cuts(counts: DataFrame, langs: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Least count of the n-grams of a language's that MOST_GRAMS hold, and the bytes of their arrays.

    The n-grams are counted first, so a large vocabulary's bigrams cannot be underrated. Languages with more than MOST_GRAMS go in parts
    (:func:`_parts`) and are not asked for, so that none of their n-grams go.
    """
    top = 1 << 16
    table = counts.groupBy("lang", F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("kinds")).collect()
    least, size = {}, {}
    for lang in langs:
        kinds, kept = {r["n"]: r["kinds"] for r in table if r["lang"] == lang}, 0
        cut = top + 1
        for n in sorted(kinds, reverse=True):
            if kept + kinds[n] > MOST_GRAMS:
                break
            kept, cut = kept + kinds[n], n
        if kinds and cut > top:
            raise ValueError(f"{lang[1:]!r} has {kinds[max(kinds)]} n-grams that occur {top} times or more; {MOST_GRAMS} can be sent")
        least[lang], size[lang] = cut, (4 << 20) + kept * GRAM_BYTES
    return least, size


def judge(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, loss, its band and kept, for each row of ``docs`` (doc_id, text, lang).

    ``carry`` adds ``row``, a struct of all columns.
    """
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    key = [F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang")]
    rows = docs.select(*key, F.struct("*").alias("row") if carry else F.col("text").cast("string").alias("text"))
    done: list[str] = []
    parts: list[DataFrame] = []
    passed = None
    for models, part, of, last in train(docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))):
        if passed is not None:
            source = passed
        elif not last:
            source = rows.where(F.col("lang").isin(list(models)))
        else:  # Languages whose texts have no words have no model and go with the last group.
            source = rows.where(~F.col("lang").isin(done)) if done else rows
        out = C.materialise(scored(source, models, part == of - 1), "quality-scores")
        if passed is not None:
            C.discard(passed)
        passed = None if part == of - 1 else out
        if passed is None:
            parts.append(out)
            done += models
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    bins = found.where(~F.col("base_failed") & F.col("loss").isNotNull()).groupBy("lang", F.round("loss", 3).alias("bin")).agg(F.count("*").alias("n"))
    band = bins.groupBy("lang").agg(F.expr("percentile(bin, array(0.25D, 0.5D, 0.75D), n)").alias("q"))
    band = band.select("lang", F.col("q")[1].alias("middle"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(FLOOR)).alias("spread"))
    short = SHORT / F.sqrt(F.greatest("n_words", F.lit(1)))
    out = found.join(F.broadcast(band), "lang", "left").withColumn("low", F.col("middle") - BELOW * F.col("spread") - short).withColumn("high", F.col("middle") + ABOVE * F.col("spread") + short)
    kept = ~F.col("base_failed") & F.coalesce(F.col("loss").between(F.col("low"), F.col("high")), F.lit(False))
    name = F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), name.alias("lang"), "loss", "low", "high", *["row"] * carry)


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    return judge(docs, carry=True).where("kept").select("row.*")
