"""Alignment of two tokenizers: segments against whole texts, and the query's columns against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cytoplan.llm import align

ODD = [
    None, "", " ", "  ", "\n", "a", "abc ", " abc", "  abc  def ", "one two\nthree\n\n four\t five \n six", "x\r\ny);\r\nz\r", "\u00a0 a \u00a0b\u3000 c", "a\u2581b c", "<|endoftext|> <s> </s> <0x41> <unk>",
    "é e\u0301 ﬁ 😀 \U0001f468\u200d\U0001f469 ok", "日本語 テキスト。\n次", "don't we'll I'M 12,345.67 -- ... !? \x00 \x1c\x1f z", "word " * 300, "x" * 5000, "  \n\n  \n", "the the the", "the the the",
]


def brute(texts):
    """The columns of each text: whole texts, every link in turn."""
    first, second = align.default_paths()
    a = Tokenizer.from_file(first)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=second)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    docs = []
    for text in texts:
        spelled = (" " + (text or "")).encode()
        e = a.encode(" " + (text or ""), add_special_tokens=False)
        a_ids, a_bytes = e.ids, [bytes(byte_of[c] for c in t) for t in e.tokens]
        b_ids = b.encode(text or "", num_threads=1)
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
        if not text or b"".join(a_bytes) != spelled or b"".join(b_bytes) != spelled:
            docs.append([])
            continue
        ends = [{sum(map(len, parts[: i + 1])) for i in range(len(parts))} if len(parts) < 600 else set(__import__("itertools").accumulate(map(len, parts))) for parts in (a_bytes, b_bytes)]
        cuts = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in cuts]
        for k, (ids, parts) in enumerate(((a_ids, a_bytes), (b_ids, b_bytes))):
            at = g = 0
            for i, part in zip(ids, parts, strict=True):
                at += len(part)
                groups[g][k].append(i)
                g += at == cuts[g]
        docs.append(groups)
    counts = Counter(p for groups in docs for p in {(x, y) for xs, ys in groups for x in xs for y in ys})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("size", [1, 2000, align.CHUNK])
def test_odd_texts(spark, size):
    docs = spark.createDataFrame([(i, t, t, "x") for i, t in enumerate(ODD)], "doc_id int, text string, segment string, chunk string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.aligned(docs.repartition(3), chunk=size).collect()}
    assert [got[i] for i in range(len(ODD))] == brute(ODD)


def test_query(spark):
    from cytoplan.llm import queries

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_segment_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute([t for _, t in rows]), strict=True)}


def test_segments_spell_the_text_and_are_aligned_once(spark):
    pair = align.pair_of(*align.default_paths())
    assert all("".join(pair.segments(t)) == " " + t for t in ODD if t)
    assert pair.segments("a  b\nc \n d.\n\ne") == [" a", "  b", "\nc", " \n d.", "\n\ne"]
    docs = spark.createDataFrame([(i, "one two one") for i in range(40)], "doc_id long, text string").repartition(4)
    assert sorted(r.segment for r in align.segment_table(docs).collect()) == [" one", " two"]


def test_groups_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "the cat"), (7, None)], "doc_id long, text string")
    rows = sorted(align.aligned(docs, with_groups=True).collect(), key=lambda r: r.n_a)
    assert (rows[0].doc_id, rows[0].groups_sha256, rows[1].doc_id) == (7, "", None)
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert align.aligned(docs.limit(0)).collect() == []


def test_segments_and_alignments_all_at_once_equal_those_of_each(monkeypatch):
    """Cuts looked up by the character before a space are those of the pattern; segments aligned together are as if aligned alone."""
    pair = align.pair_of(*align.default_paths())
    rng = np.random.default_rng(5)
    letters = list("abcXYZ09.,;'\"()-_  \n\n\t\r#▁é中🙂 　​�\x00")
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(400)] + [" ", "\n", " \n ", "a", "a \n b", "word word\nline  two \n"]
    found = [pair.segments(t) for t in texts]
    assert found == [pair.cut.split(" " + t) for t in texts]
    names = sorted({s for x in found for s in x})
    together = pair.align(names)
    assert None in together and sum(x is not None for x in together) > len(names) / 2
    assert together == [pair.align([s])[0] for s in names]
    # One by one in plain Python, as it was before: many at once make no call.
    seen = []
    plain = pair._aligned
    monkeypatch.setattr(pair, "_aligned", lambda *x: seen.append(1) or plain(*x))
    assert pair.align(names) == together and not seen
    firsts = pair.a.encode_batch(names, add_special_tokens=False)
    for s, first, got in zip(names, firsts, together):
        b_ids = [pair.lone_space] if s == " " else pair.b.encode(s[1:] if s[0] == " " else s)[0 if s[0] == " " else 1 :]
        assert plain(s.encode(), first.ids, b_ids) == got
