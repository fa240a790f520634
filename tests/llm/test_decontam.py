"""Decontamination as a query against brute force, the recall of its radius, and very long items."""

import math
import re
import resource
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from cytoplan.llm import decontam, queries

SF = "/root/testdata/sf0.001"


def shingles(words, k):
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def words_of(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def plain(docs, items, threshold=0.8):
    """Best similarity by (document, item), of all windows of the item's size, with weights as documented."""
    items = [(i, words_of(t)) for i, t in items if i is not None and words_of(t)]
    bags = [(i, len(w), shingles(w, min(5, len(w)))) for i, w in items]
    seen = Counter(s for _, _, b in bags for s in b)
    weight = lambda s: round(math.log1p(len(bags) / seen[s] if s in seen else len(bags)) * 2**20)
    out = {}
    for d, text in docs:
        words = words_of(text)
        for i, m, ask in bags:
            k = min(5, m)
            if not shingles(words, k).keys() & ask.keys():
                continue
            for s in range(-m + 1, len(words)):
                own = shingles(words[max(s, 0) : s + m], k)
                low = sum(weight(x) * n for x, n in (own & ask).items())
                if low:
                    value = low / sum(weight(x) * n for x, n in (own | ask).items())
                    if value >= threshold:
                        out[d, i] = max(out.get((d, i), 0), value)
    return out


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = plain(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op4_simhash_decontamination(spark, SF).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    vocabulary = ["w%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(20, 120))))) for i in range(150)]
    docs = []
    for i, text in items:
        words = text.split()
        for share in (0.01, 0.02, 0.03):
            own = [w if rng.random() > share else str(rng.choice(vocabulary)) for w in words]
            docs.append((len(docs), " ".join([*rng.choice(vocabulary, 30), *own, *rng.choice(vocabulary, 30)])))
    want = plain(docs, items)
    index = decontam.Index([i for i, _ in items], [t for _, t in items])
    got = {(row, item) for row, item, *_ in index.matches(pa.array([t for _, t in docs]), 0.8)}
    near = {k for k, v in want.items() if v < 0.9}
    print(f"recall {len(got & want.keys()) / len(want):.3f} of {len(want)}, {len(got & near) / len(near):.3f} of {len(near)} between 0.8 and 0.9")
    assert len(near) > 50 and len(got & near) >= 0.9 * len(near) and got <= want.keys()


def test_windows_beyond_the_radius_are_found_exactly(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(3, 40))))) for i in range(60)]
    items += [(i + 60, text + " more words") for i, text in items[:20]]
    docs = []
    for i, text in items:
        own = text.split()
        own[-1] = "new"
        docs.append((len(docs), " ".join([*rng.choice(vocabulary, 20), *own, *own[:9], *rng.choice(vocabulary, 20)])))
    want = plain(docs, items)
    for radius in (decontam.RADIUS, 0):
        monkeypatch.setattr(decontam, "RADIUS", radius)
        index = decontam.Index([i for i, _ in items], [t for _, t in items])
        got = {(row, item): value for row, item, value, *_ in index.matches(pa.array([t for _, t in docs]), 0.8)}
        assert len(want) > 30 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_blocks_list_few_pairs_and_all_near_ones():
    rng = np.random.default_rng(6)
    for n in (300, 6000):  # by comparison of values, and by probes
        prints = rng.integers(0, 1 << 63, n).astype(np.uint64)
        asked = prints[:200].copy()
        for _ in range(decontam.RADIUS):
            asked ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        parts = prints.view(np.uint16).reshape(n, decontam.BLOCKS)
        group = decontam.Group(5, 5, np.arange(n), prints[:, None], prints, np.zeros(0), [decontam.Block(parts[:, b]) for b in range(decontam.BLOCKS)])
        got = set(zip(*map(np.ndarray.tolist, group.near(asked)), strict=True))
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(asked[:, None] ^ prints[None]) <= decontam.RADIUS)), strict=True))
        listed = sum(len(block.near(asked.view(np.uint16).reshape(-1, decontam.BLOCKS)[:, b])[0]) for b, block in enumerate(group.blocks))
        assert listed < 0.06 * n * len(asked)


def test_very_long_items():
    rng = np.random.default_rng(7)
    words = ["w%d" % i for i in rng.integers(0, 5000, 10_000)]
    index = decontam.Index([1, 2], [" ".join(words), "a b"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = " ".join([*["x"] * 50, *words[:4000], "new", *words[4000:], *["y"] * 2000])
    got = list(index.matches(pa.array([text, "a b", None, ""]), 0.8))
    assert [(r, i) for r, i, *_ in got] == [(0, 1), (1, 2)] and got[0][2] > 0.99
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
