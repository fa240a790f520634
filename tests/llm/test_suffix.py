"""Suffix-array deduplication with anchors that very many different windows share."""

import hashlib

import numpy as np
import pytest

from cytoplan.llm import common as C
from cytoplan.llm import suffix


def brute(table):
    """n_removed, n_spans and the kept bytes' hash by document, of 100-byte strings that also start earlier."""
    seen, out = set(), {}
    for d, b in sorted(table):
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            h = hash(b[s : s + 100])
            if h in seen:
                cover[s : s + 100] = True
            seen.add(h)
        runs = int((np.diff(np.concatenate([[False], cover, [False]]).astype(int)) == 1).sum())
        out[d] = (int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return out


def common_gram(rng):
    """A gram whose hash is so small that it is the anchor of nearly all strings that hold it."""
    data = rng.integers(97, 123, 1 << 18).astype(np.uint8)
    prefix = C.prefix_hash(data)
    h = C.mix64((prefix[suffix.GRAM :] - prefix[: -suffix.GRAM]) * C._power(C._BASE_INV, len(data) - suffix.GRAM + 1))
    at = int(np.argmin(h))
    return data[at : at + suffix.GRAM].tobytes()


def got(spark, table, parts=5):
    df = spark.createDataFrame([(d, b.decode()) for d, b in table], "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(suffix.dedup(df)).collect()}


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_common_anchors_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "HOT", 4)
    monkeypatch.setattr(suffix, "MOST", most)
    rng = np.random.default_rng(3)
    gram = common_gram(rng)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    sides = [word(70) for _ in range(12)]
    table = [(i, word(int(rng.integers(0, 200))) + sides[rng.integers(12)] + gram + sides[rng.integers(12)] + word(int(rng.integers(0, 99)))) for i in range(300)]
    table += [(300 + i, table[int(rng.integers(0, 300))][1] * 2) for i in range(20)]
    want = brute(table)
    assert sum(n > 0 for n, _, _ in want.values()) > 100 and got(spark, table) == want


def test_one_anchor_of_very_many_windows(spark):
    rng = np.random.default_rng(4)
    gram = common_gram(rng)
    sides = rng.integers(97, 123, (200_000, 2, 42)).astype(np.uint8)
    table = [(i, a.tobytes() + gram + b.tobytes()) for i, (a, b) in enumerate(sides)]
    table += [(len(table) + i, table[i][1] + b"!") for i in range(0, 200_000, 40_000)]
    want = brute(table)
    assert sum(n for n, _, _ in want.values()) == 5 * 116 and got(spark, table) == want
