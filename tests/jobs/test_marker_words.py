"""The marker job: two runs over growing input, batches that are run again, odd rows, brute force."""

import math
from collections import Counter

import pytest
import regex

from jobs import marker_words as job

DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, least, top):
    """Rows of the profile from (text, lang, source)."""
    words, members = {}, Counter()
    for text, lang, source in rows:
        members[lang, source] += 1
        words.setdefault((lang, source), Counter()).update(w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w)
    overall, total = sum(words.values(), Counter()), sum(members.values())
    out = []
    for group, own in words.items():
        n = members[group]
        scored = sorted((-round(math.log2((s / n + 1e-6) / (overall[w] / total + 1e-6)), 9), -s, w) for w, s in own.items() if s >= least)
        out += [(*group, k + 1, w, n, -s, round(-s / n, 6), round(-e, 6)) for k, (e, s, w) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def found(spark, out, settings):
    rows = job.output(spark, out, settings).select("lang", "source", "rank", "word", "n_documents", "n_words", "mean_count", "log2_enrichment").collect()
    return sorted((tuple(x + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture
def settings():
    return {**job.settings_of(), "least": 2, "top": 5}


def rows_of(first, n):
    names = ["alpha beta", "Beta, gamma; gamma!", "delta\ndelta été Été", "", None, "x1 x1 the the", "the beta"]
    return [(i, names[i % 7] if i % 7 in (3, 4) else f"{names[i % 7]} {names[(i * 3) % 7] or ''} the", ["en", "fr", None][i % 3], ["a", "b"][i % 2]) for i in range(first, first + n)]


def test_second_run_counts_only_new_files(spark, tmp_path, settings):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows_of(0, 40), DOCS).repartition(3).write.parquet(f"{where}/documents.parquet")
    assert job.run(spark, where, out, settings)["documents"] == 40
    first = found(spark, out, settings)
    assert first == brute([r[1:] for r in rows_of(0, 40)], 2, 5)
    assert job.run(spark, where, out, settings)["documents"] == 0 and found(spark, out, settings) == first
    spark.createDataFrame(rows_of(40, 23), DOCS).write.mode("append").parquet(f"{where}/documents.parquet")
    assert job.run(spark, where, out, settings)["documents"] == 23
    assert found(spark, out, settings) == brute([r[1:] for r in rows_of(0, 63)], 2, 5) != first


def test_small_batches_give_the_same_profile(spark, tmp_path, settings):
    where = str(tmp_path / "in")
    spark.createDataFrame(rows_of(0, 60), DOCS).repartition(5).write.parquet(f"{where}/documents.parquet")
    for k in (1, 64):
        job.run(spark, where, str(tmp_path / f"out{k}"), {**settings, "files_per_batch": k})
    assert found(spark, str(tmp_path / "out1"), settings) == found(spark, str(tmp_path / "out64"), settings)
    assert spark.read.parquet(str(tmp_path / "out1/counts")).select("batch").distinct().count() > 1


def test_a_batch_that_is_run_again_replaces_its_counts(spark, tmp_path, settings):
    """As after a run that was lost between writing a batch and marking it as done."""
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows_of(0, 30), DOCS).write.parquet(f"{where}/documents.parquet")
    job.run(spark, where, out, settings)
    before = found(spark, out, settings)
    for commit in (tmp_path / "out/checkpoint/commits").iterdir():
        commit.unlink()
    job.run(spark, where, out, settings)
    assert found(spark, out, settings) == before


def test_empty_table_and_a_single_file(spark, tmp_path, settings):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], DOCS).write.parquet(f"{where}/documents.parquet")
    assert job.run(spark, where, out, settings)["rows"] == 0 and job.output(spark, out, settings).count() == 0
    one = tmp_path / "one"
    spark.createDataFrame(rows_of(0, 9), DOCS).coalesce(1).write.parquet(str(one / "folder"))
    next((one / "folder").glob("*.parquet")).rename(one / "documents.parquet")
    assert job.run(spark, str(one), str(tmp_path / "out1"), settings)["documents"] == 9


def test_whole_table(spark, tmp_path):
    out, settings = str(tmp_path / "out"), job.settings_of()
    where = "/root/testdata/sf0.001"
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    job.run(spark, where, out, settings)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before
    rows = spark.read.parquet(f"{where}/documents.parquet").select("text", "lang", "source").collect()
    assert found(spark, out, settings) == brute([tuple(r) for r in rows], settings["least"], settings["top"])
