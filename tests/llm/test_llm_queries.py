"""The registered queries over whole small tables against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from cytoplan.llm import queries, tokens

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def run(spark, number):
    name = next(n for n in queries.queries() if n.startswith(f"op{number}_"))
    return queries.queries()[name](spark, SF).collect()


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op2(spark, texts):
    fps = {}
    for d, t in texts.items():
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, 2)} == {d: (f"{f:016x}", find(d)) for d, f in fps.items()}


def test_op5(spark, ids):
    want, at = {}, 0
    for d, own in ids.items():
        want[d] = (at, len(own) + 1, crc([*own, 2]))
        at += len(own) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, 5)} == want


def test_op6(spark, ids):
    want = {}
    for d, own in ids.items():
        own = [*own, 1]
        for k in range(0, len(own), 4096):
            want[d, k // 4096] = (k, len(own[k : k + 4096]), crc(own[k : k + 4096]))
    got = run(spark, 6)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(v[1] for v in want.values()) // 4096) + 1


def test_op7(spark, texts):
    for r in run(spark, 7):
        t = texts[r.doc_id]
        w = re.findall(WORD, t)
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeat = len({k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)})
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op8(spark, texts):
    seen, want = set(), {}
    for d, t in texts.items():
        b = t.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        want[d] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, 8)} == want


def test_op9(spark, texts):
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in run(spark, 9):
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans = sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        kinds = [k for _, k, _ in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in range(3)) and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(",")) or not text


def test_op1_and_op3_equal_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_op10_covers_all_documents(spark, texts):
    got = run(spark, 10)
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(0 <= r.severity <= 3 for r in got)
