"""Vectorised kernels against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cytoplan.llm import common as C
from cytoplan.llm import decontam, packing, quality, rans, secrets, simhash, suffix, tokens

WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", None, "\n", "\n\n", " lead", "tail ", "a", "a b", "a b c", "Ä b\tc\rd", "\nfoo", "x" * 700 + " y z", "é ü # & <", "a b c d e f g h " * 3, "x y\nx y\r\nx y\n"]


def texts(seed, n=80, alphabet="abD é#\n", longest=300):
    rng = np.random.default_rng(seed)
    return ODD + ["".join(rng.choice(list(alphabet), rng.integers(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_fingerprints(limit):
    rows = texts(1)

    def plain(t):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = np.concatenate([simhash.fingerprints_of(d, o) for _, _, d, o in C.text_chunks(pa.array(rows), limit)])
    assert got.tolist() == [plain(t) for t in rows]


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_hamming_join_is_complete(radius):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    near = base[:300].copy()
    for _ in range(radius):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    group = rng.integers(0, 3, len(fps))
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)) if i < j and group[i] == group[j]}
    found = set()
    simhash.hamming_join(fps, group, np.zeros(len(fps), int), radius, lambda i, j: found.update(map(tuple, np.sort(np.stack([i, j], 1)).tolist())))
    assert found == want
    side, cross = np.arange(len(fps)) % 2, set()
    simhash.hamming_join(fps, group, side, radius, lambda i, j: cross.update(map(tuple, np.sort(np.stack([i, j], 1)).tolist())))
    assert cross == {(i, j) for i, j in want if side[i] != side[j]}


@pytest.mark.parametrize("limit", [1 << 20, 50])
def test_base_counts(limit):
    rows = texts(3)

    def plain(t):
        t = t or ""
        w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)]

    got = np.concatenate([quality.base_counts(d, o) for _, _, d, o in C.text_chunks(pa.array(rows), limit)])
    assert got.tolist() == [plain(t) for t in rows]


def test_language_model_is_a_distribution():
    data = np.frombuffer(b"the cat sat on the mat. the dog sat on the log. " * 5, np.uint8)
    grams, n = np.unique(quality.grams(data, np.array([0, len(data)])), return_counts=True)
    model = quality.Model(grams, n)
    for context in [*{int(g) >> 6 for g in grams[:20]}, 4000]:
        assert abs(np.exp(model.score(np.arange(64) + (context << 6)).astype(float)).sum() - 1) < 1e-5
    # Against direct lookup.
    table = dict(zip(model.hashes.tolist(), model.log_p.tolist()))
    assert np.allclose(model.score(grams), [table[int(h)] for h in model.hash(grams.astype(np.uint32))])


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 300_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_407).astype(np.uint16)
    table = rans.Table.from_bytes(rans.Table.of_counts(np.bincount(ids, minlength=49_408)).to_bytes())
    assert int(table.freq.sum()) == 1 << rans.SCALE
    frame = rans.encode_block(ids, np.array([5, 7]), np.array([n // 2, n - n // 2]), table, np.array([False, True]))
    out, docs, nulls, lengths = rans.decode_block(frame, table)
    assert (out == ids).all() and docs.tolist() == [5, 7] and nulls.tolist() == [False, True] and lengths.sum() == n
    if n > 290_000:  # from a checkpoint, without what is before it
        part, *_ = rans.decode_block(frame, table, 270_001, 280_000)
        assert (part == ids[270_001:280_000]).all()
        with pytest.raises(ValueError):
            rans.decode_block(frame[:9000] + b"xxxx" + frame[9004:], table)


def test_tokens_equal_the_library():
    coder = tokens.Encoder(tokens.default_tokenizer())
    rows = ["Étion It's don't <|endoftext|> x<|ENDOFTEXT|>. foo.,bar İstanbul ŒUVRE ǅ ŉ ß ÿ áb é. naïve... ÷ x÷ ª º µ 12.5a b_c_ ¡hola! “q” \x1c \x85 　z ΑΣ ΣΑΣ. ſecret Kelvin", "", "  ", "\n\n a\tb\x0bc", "'s 't 'S x'S ''s", "Hello, world! 3.14 a-b|c é. x́"]
    assert coder.by_word
    for text in rows:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_is_close_to_best(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(4096, rng.exponential(700, 3000).astype(int) + 1)
    counts = dict(Counter(sizes.tolist()))
    runs, n = packing.plan(counts, 4096)
    assert n <= -(-int(sizes.sum()) // 4096) + 1
    used = Counter()
    for size, first, last, sequence, per, offset in runs.tolist():
        for k in range(last - first):
            used[sequence + k // per] += size
            assert offset + k % per * size + size <= 4096
    assert max(used.values()) <= 4096 and len(used) == n


def test_reduction_keeps_the_best_number_of_bins():
    rng = np.random.default_rng(7)

    def best(items):
        items = sorted(items, reverse=True)
        found = [len(items)]

        def go(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(items):
                found[0] = len(bins)
                return
            for k in sorted(set(bins)):
                if k >= items[i]:
                    rest = list(bins)
                    rest.remove(k)
                    go(i + 1, [*rest, k - items[i]])
            go(i + 1, [*bins, 20 - items[i]])

        go(0, [])
        return found[0]

    for _ in range(60):
        items = rng.integers(1, 21, rng.integers(1, 9)).tolist()
        inst = packing.Instance(dict(Counter(items)), 20)
        fixed = packing.reduce_instance(inst)
        rest = [s for s in inst.sizes().tolist() for _ in range(int(inst.count[s]))]
        assert sum(n for _, n in fixed) + best(rest) == best(items)


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    steps = rng.normal(size=(3, 3))
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 3))
        score = lambda y: sum(e[t, y[t]] for t in range(n)) + sum(steps[a, b] for a, b in zip(y, y[1:])) + steps[0, y[0]] + steps[y[-1], 0]
        assert secrets.viterbi(e, steps, True, True) == list(max(itertools.product(range(3), repeat=n), key=score))


def test_base_spans():
    text = 'x PASSWORD = "abcdef", token:abc secret=\'Zz9_/+=.-\' api-key: nope apikey:123456 AKIA' + "B" * 16 + " AKIAXX " + "0123456789abcdef" * 2 + " ſecret=abcdefgh"
    base = secrets.base_spans(text)
    plain = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    plain += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert base == sorted(plain) and len(base) == 5


def test_intervals_are_maximal_repeats():
    text = b"abcabdabcabe" * 2
    at = np.arange(len(text))
    buffer = np.frombuffer(text, np.uint8)
    order, shared = suffix.suffix_array(buffer, at, np.full(len(text), len(text)), np.zeros(len(text), np.uint64))
    assert [text[i:] for i in order] == sorted(text[i:] for i in at)
    left = [int(text[i - 1]) if i else -1 for i in order]
    got = {text[order[a] : order[a] + n]: sorted(order[a : b + 1].tolist()) for a, b, n in suffix.intervals(shared, left, 2)}
    want = {}
    for i in range(len(text)):
        for j in range(i + 2, len(text) + 1):
            s = text[i:j]
            places = [k for k in range(len(text)) if text.startswith(s, k)]
            lefts, rights = {text[k - 1 : k] if k else None for k in places}, {text[k + len(s) : k + len(s) + 1] or None for k in places}
            if len(places) > 1 and len(lefts) > 1 and len(rights) > 1:
                want[s] = places
    assert got == want


def test_decontamination_finds_what_brute_force_finds():
    rng = np.random.default_rng(4)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (1, 3, 5, 12, 30, 31)] + [None, ""]
    docs = [" ".join(rng.choice(vocabulary, 80)) for _ in range(10)] + [None, "", items[4], items[3][: len(items[3]) // 2]]
    for item in items[:6]:
        for cut in (0, 1, 3):
            words = item.split()
            docs.append(" ".join(rng.choice(vocabulary, 20)) + " " + " ".join(words[cut:]).upper() + ", " + " ".join(rng.choice(vocabulary, 9)))
    index = decontam.Index(list(range(len(items))), items)
    got = {(row, item): value for row, item, value, _, _ in index.matches(pa.array(docs, pa.string()), 0.8)}
    hashes = lambda t: next(decontam.word_hashes(pa.array([t])), [0] * 7)[6] if t else np.zeros(0, np.uint64)
    want = {}
    for r, doc in enumerate(docs):
        w = hashes(doc)
        for i, item in enumerate(items):
            own = hashes(item)
            m, k = len(own), min(5, len(own))
            if not m:
                continue
            ask = Counter(C.window_hash(own, k).tolist())
            for s in range(-m, len(w)):
                part = w[max(s, 0) : max(0, min(s + m, len(w)))]
                value = index.similarity(Counter(C.window_hash(part, k).tolist()), ask)
                if value >= 0.8:
                    want[r, i] = max(want.get((r, i), 0), value)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
