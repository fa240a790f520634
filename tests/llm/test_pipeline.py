"""The pipeline against a brute-force version of every stage, and odd tables."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontam import plain
from test_quality import plain_losses
from tokenizers import Tokenizer

import corpus_pipeline
from cytoplan.llm import quality, secrets, tokens
from cytoplan.llm.common import read_table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    kept = []
    for lang in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == lang]
        losses = plain_losses([r["text"] or "" for r in own])
        passes = []
        for r in own:
            w = WORD.findall(r["text"] or "")
            places = {}
            for i in range(len(w) - 7):
                places.setdefault(tuple(w[i : i + 8]), []).append(i)
            repeat = len({k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)})
            passes.append(len(w) >= 20 and 100 * repeat <= 30 * len(w))
        seen = [round(v, 3) for v, ok in zip(losses, passes, strict=True) if ok and v is not None]
        if not seen:
            continue
        low, middle, high = np.quantile(seen, [0.25, 0.5, 0.75])
        spread = max((high - low) / 1.349, quality.FLOOR)
        for r, v, ok in zip(own, losses, passes, strict=True):
            short = quality.SHORT / math.sqrt(max(1, len(WORD.findall(r["text"] or ""))))
            if ok and v is not None and middle - quality.BELOW * spread - short <= v <= middle + quality.ABOVE * spread + short:
                kept.append(r)
    return sorted(kept, key=lambda r: r["doc_id"])


def plain_dedup(rows):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [r for k, r in enumerate(rows) if find(k) == k]  # rows come by doc_id


def test_pipeline_equals_brute_force(spark):
    secret = F.concat("text", F.lit('\npassword = "hunter2hunter2" by AKIA' + "Q" * 16))
    docs = read_table(spark, SF, "documents").withColumn("text", F.when(F.col("doc_id") % 9 == 0, secret).otherwise(F.col("text")))
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    sizes = [len(rows)]
    rows = plain_quality(rows)
    sizes.append(len(rows))
    rows = plain_dedup(rows)
    sizes.append(len(rows))
    leaked = {d for d, _ in plain([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in leaked]
    sizes.append(len(rows))
    field = secrets.fit(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], docs.schema))
    coder = Tokenizer.from_file(tokens.default_tokenizer())
    want, touched = {}, 0
    for r in rows:
        _, spans = secrets.all_spans(r["text"], field)
        cover = np.zeros(len(r["text"]) + 1, int)
        for a, _, b in spans:
            cover[a:b] = 1
        text, at = "", 0
        for a, _, b in sorted(spans):
            if a >= at:
                text += r["text"][at:a] + "[SECRET]"
            at = max(at, b)
        text += r["text"][at:]
        touched += bool(spans)
        ids = [*coder.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert sizes[0] > sizes[1] > sizes[2] > 0 and touched
    got = corpus_pipeline.run_on(spark, docs, SF).collect()
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


PROSE = "the quick brown fox jumps over the lazy dog and runs through the long green meadow while the sun slowly sets behind the distant blue hills of home"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(0)
    table = [(i, " ".join(rng.choice(PROSE.split(), 60)), "en", "s", 1) for i in range(30)]
    table += [(40, None, None, None, None), (41, "", "en", "s", 0), (42, "tiny", "en", "s", 4), (43, table[3][1], "en", "s", 9), (43, table[3][1], "en", "s", 9), (None, table[5][1], "en", "s", 9)]
    table += [(44, " ".join(rng.choice(PROSE.split(), 30_000)), "en", "s", 1), (45, table[7][1] + " token = abcdef123456", None, "s", 1)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "number": F.lit("x"), "sid": F.lit(2), "h": F.lit(3), "loss": F.lit(4), "kept": F.lit(5), "windows": F.lit(6)}).repartition(3)


def test_odd_tables(spark, odd):
    at = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == odd.columns
    ids = sorted((r.doc_id for r in at.collect()), key=str)
    assert set(range(30)) - {3, 5, 7} <= set(ids) and 44 in ids and not {40, 41, 42, 43, None} & set(ids)
    assert ids.count(3) == ids.count(5) == 1 and (7 in ids) != (45 in ids) or 7 in ids
    got = corpus_pipeline.run_on(spark, odd, SF).collect()
    assert {r.doc_id for r in got} == set(ids) and sum(r.doc_id == 44 for r in got) > 1
    assert corpus_pipeline.run_on(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.run_on(spark, odd.where("doc_id in (40, 41, 42)"), SF).count() == 0


def test_an_empty_benchmark_removes_nothing(spark, odd, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontamination(spark, odd, f"file://{tmp_path}").count() == odd.count()


def test_what_stages_wrote_is_deleted(spark, odd):
    from cytoplan.llm import common as C

    mark = C.materialised()
    out = corpus_pipeline.run_on(spark, odd, SF)
    assert C.materialised() == mark + 1 and out.count() > 0


def test_packed_sequences_hold_their_ids(spark, odd):
    docs = odd.where("doc_id in (1, 2, 41, 44)")
    coder = Tokenizer.from_file(tokens.default_tokenizer())
    sequences, texts = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.best_fit_packing(spark, docs, SF).collect():
        whole = [*coder.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.ids == whole[r.start : r.start + 4096] and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, {})[r["offset"]] = r.ids
    for own in sequences.values():
        assert [at for at in sorted(own)] == np.append(0, np.cumsum([len(own[at]) for at in sorted(own)]))[:-1].tolist()
    assert sum(len(ids) for own in sequences.values() for ids in own.values()) > 30_000


def test_items_without_an_id_are_removed_as_well(spark, odd, tmp_path):
    text = odd.where("doc_id = 8").first().text
    spark.createDataFrame([(None, text), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r.doc_id for r in corpus_pipeline.decontamination(spark, odd, f"file://{tmp_path}").collect()]
    assert 8 not in left and len(left) == odd.count() - 1


def test_no_part_of_a_secret_is_left_beside_a_base_match():
    class Tags:
        def tag(self, words, text):
            return [(k, k + 1) for k, w in enumerate(words) if w.startswith("ghp_")]

    found = "abcdef0123456789" * 2
    assert secrets.redacted(f"use ghp_Zk{found}Qx9Lm today", Tags(), "[SECRET]") == "use [SECRET] today"
    assert secrets.redacted(f"use {found} today", Tags(), "[SECRET]") == "use [SECRET] today" and secrets.redacted(None, Tags(), "x") is None
