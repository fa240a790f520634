"""The operators on small tables with nulls, ties, repeats, odd columns and no rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytoplan.llm import chat, decontam, licenses, packing, quality, queries, rans, secrets, simhash, suffix, tokens, toxicity
from cytoplan.llm.common import work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and runs through the long green meadow while the sun slowly sets behind the distant blue hills of home"


def rows():
    words = PROSE.split()
    rng = np.random.default_rng(0)
    out = [(i, " ".join(rng.choice(words, 60)), "en", "s", 1) for i in range(30)]
    out += [(40, None, None, None, None), (41, "", "en", "s", 0), (42, "tiny", "en", "s", 4), (43, out[3][1], "en", "s", 9), (43, out[3][1], "en", "s", 9), (None, out[5][1], "en", "s", 9)]
    out += [(44, "z " * 40_000, "de", "s", 80_000), (45, out[7][1].replace("fox", "Fox") + " extra", "en", "s", 9), (46, 'my password = "hunter2hunter2" and AKIA' + "Q" * 16, "en", "s", 60)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that the operators use themselves.
    return spark.createDataFrame(rows(), SCHEMA).withColumns({"fp": F.lit("x"), "row": F.lit(1), "part": F.lit(2), "number": F.lit(3), "kept": F.lit(4), "low": F.lit(5)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_components(docs, none, monkeypatch):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    fps = {(r.doc_id, r.fp) for r in got}
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    assert all(r.component_id == least.get(find(r.fp)) for r in got)
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 2)  # tiles
    assert sorted(simhash.near_duplicates(docs).collect(), key=str) == sorted(got, key=str)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(f) for _, f in fps})


def test_token_files(spark, docs, none):
    path = work_dir(spark, "test")
    rans.write_tokens(docs, path, tokens.default_tokenizer(), 2)
    got = sorted(rans.read_tokens(spark, path).collect(), key=lambda r: r.start)
    coder = tokens.encoder(tokens.default_tokenizer())
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows()], key=lambda d: (d is not None, d))
    at = 0
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        want = coder.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and (r.start, r.n_tokens) == (at, len(want)) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    path = work_dir(spark, "test")
    rans.write_tokens(none, path, tokens.default_tokenizer(), 2)
    assert rans.read_tokens(spark, path).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    coder = tokens.encoder(tokens.default_tokenizer())
    n = [len(coder.encode(r[1])) // 4 + 1 for r in rows()]
    assert sum(r.length for r in got) == sum(n) and len(got) == sum(-(-x // 4096) for x in n)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(n) // 4096) + 1
    assert packing.pack(none).count() == 0


def test_quality(docs, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[40].base_failed and by[41].base_failed and by[42].base_failed and by[44].base_failed
    assert all(by[i].kept for i in range(30))
    assert quality.judge(none).count() == 0
    kept = quality.clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_scores_languages_in_passes(docs, monkeypatch):
    want = sorted(quality.judge(docs).collect(), key=str)
    monkeypatch.setattr(quality, "MODEL_BYTES", 1)
    assert sorted(quality.judge(docs).collect(), key=str) == want


def test_suffix_dedup(spark, docs, none):
    a = PROSE + " one"
    small = [(1, a), (2, "x" + a + "y"), (3, PROSE[:99]), (4, PROSE[:100]), (5, "ab" * 300), (6, None), (7, "é" * 90 + a), (7, a), (None, a), (8, a), (8, a)]

    def brute(table):
        seen, out = set(), []
        for d, t in table:
            b = (t or "").encode()
            cover = bytearray(len(b))
            for s in range(len(b) - 99):
                if b[s : s + 100] in seen:
                    cover[s : s + 100] = b"\1" * 100
                seen.add(b[s : s + 100])
            runs = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
            out.append((d, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
        return out

    df = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    marks = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(set(small), key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1]]))
    want = brute(order)
    want += [w for w, r in zip(want, order) if r == (8, a)]
    got = suffix.digest(suffix.dedup(df)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert suffix.dedup(none).count() == 0 and suffix.digest(suffix.dedup(docs)).count() == len(rows())


def test_suffix_dedup_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HELD", 50)
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefgh "), 1_300_000))
    df = spark.createDataFrame([(1, long), (2, "q" + long[1_048_000:1_049_300] + "q")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.digest(suffix.dedup(df)).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans) == (1300, 1)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (None, "x"), (3, PROSE)], "item_id long, text string")
    planted = docs.unionByName(spark.createDataFrame([(90, "Well: " + PROSE.upper() + "!", "en", "s", 5)], SCHEMA), allowMissingColumns=True)
    got = decontam.contaminated(planted, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(90, 1), (90, 3)} and all(r.similarity == 1 and r.start == 6 for r in got)
    kept = decontam.clean(planted, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_secrets(docs, none):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert (got[46].n_assign, got[46].n_access, got[46].n_hex) == (1, 1, 0)
    assert got[40].spans == "" and got[40].base_sha256 == hashlib.sha256(b"").hexdigest()
    cut = secrets.redact(docs)
    assert cut.columns == docs.columns
    text, n = cut.where("doc_id = 46").select("text", "n_chars").first()
    assert "hunter2" not in text and "AKIA" not in text and n == len(text)
    assert secrets.scan(none).count() == 0


def test_field_finds_unseen_secrets_and_leaves_prose():
    field = secrets.train([])
    found = secrets.joined(secrets.all_spans('here auth = "9fK2mQ7xL0pZrT4bN8" end', field)[1])
    assert found == "crf:13:31"
    for plain in (PROSE, "call +1 (980) 555-6268 now", "write to ann.7@mail.example.com", "see https://www.abc.org/x/y-12.html", "card 4401553578478930 ok"):
        assert secrets.all_spans(plain, field)[1] == []


def test_toxicity_on_held_out_labels(spark, none):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~held))
    assert (np.diff(model.thresholds) >= 0).all()
    scored = toxicity.score(docs, model)
    table = scored.join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id").groupBy("label", "toxic").count().collect()
    count = {(r.label, r.toxic): r["count"] for r in table}
    # About a third of the toxic labels are of texts without a toxic word.
    assert count[0, False] / (count[0, False] + count.get((0, True), 0)) > 0.98
    assert count[1, True] / (count[1, True] + count[1, False]) > 0.6
    assert scored.where("severity < 0 or severity > 3 or p1 < p2 or p2 < p3").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels.limit(0)).weights.size == 0


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "first"), (None, 0, "cy", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit(9)).repartition(3)
    got = {(r.conv_id, r.speaker): r for r in chat.perspectives(df).collect()}
    assert got.keys() == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy")}
    r = got[1, "ann"]
    assert r.text == "<|user name=unknown|>\nfirst<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\n<|end|>\n" * 2
    a, b = map(int, r.mask.split(":"))
    assert r.text[a:b] == "hi<|end|>\n" and r.n_turns == 5
    assert len(got[1, "bob"].mask.split(",")) == 2
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_chunks_of_a_long_conversation(spark):
    df = spark.range(2000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.perspectives(df, chunk=300).where("speaker = 'a'").orderBy("chunk").collect()
    assert [r.chunk for r in got] == list(range(7)) and sum(r.n_turns for r in got) == 2000
    assert "".join(r.text for r in got).count("<|assistant|>") == 1000


def test_licences(spark, docs, none):
    mit = licenses.TEMPLATES["mit"]
    df = docs.unionByName(spark.createDataFrame([(91, mit.upper() + "\nCopyright me", "en", "s", 1), (92, PROSE + "\n  released under the MIT license!\n", "en", "s", 1)], SCHEMA), allowMissingColumns=True)
    got = {(r.doc_id, r.unit): (r.license_id, r.dice) for r in licenses.scan(df).collect()}
    assert got[91, 1] == ("mit", 1.0) and got[91, 0][0] == "mit" and got[92, 2] == ("mit-notice", 1.0) and len(got) == 3
    assert licenses.scan(none).count() == 0
    share = 0.8 / 1.2
    known = {n: licenses.bigrams(t) for n, t in licenses.TEMPLATES.items()}
    told = set(licenses.telling_words(known, share))
    assert all(sum(not told & set(p.split()) for p in pairs) < share * len(pairs) for pairs in known.values())


def test_pipeline(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    sizes = [at.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "/root/testdata/sf0.001")
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(at.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
