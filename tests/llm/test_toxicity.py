"""The ordinal model against plain formulas, its training, and odd tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.llm import common as C
from cytoplan.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def toy(seed=0, n=60, words=12):
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.6, (n, words)).astype(float)
    row, column = np.nonzero(x)
    return x, row, column, x[row, column], rng.integers(0, 4, n)


def plain_loss(x, grade, w, b):
    """Mean of -log P(grade) by the definition."""
    out = 0.0
    for own, g in zip(x, grade, strict=True):
        over = [1.0, *[1 / (1 + math.exp(t - float(own @ w))) for t in b], 0.0]
        out -= math.log(over[g] - over[g + 1])
    return out / len(grade)


def test_likelihood_and_slopes():
    x, row, column, value, grade = toy()
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=12) * 0.3, np.array([-0.5, 0.4, 1.3])
    loss, gw, gb = toxicity.likelihood(row, column, value, grade, w, b)
    assert abs(loss - plain_loss(x, grade, w, b)) < 1e-9
    for k in range(12):
        d = np.eye(12)[k] * 1e-5
        assert abs((plain_loss(x, grade, w + d, b) - plain_loss(x, grade, w - d, b)) / 2e-5 - gw[k]) < 1e-6
    for k in range(3):
        d = np.eye(3)[k] * 1e-5
        assert abs((plain_loss(x, grade, w, b + d) - plain_loss(x, grade, w, b - d)) / 2e-5 - gb[k]) < 1e-6


def test_fit_is_a_minimum_with_ordered_thresholds():
    x, row, column, value, grade = toy(n=300)
    grade = np.digitize(x[:, 0] + x[:, 1] - x[:, 2] + np.random.default_rng(2).normal(0, 0.5, 300), [0, 1, 2])
    model = toxicity.fit_ordinal(row, column, value, grade, rounds=3000, penalty=1e-3)
    w = np.zeros(12)
    w[model.features] = model.weights
    assert (np.diff(model.thresholds) >= 0).all() and w[0] > 0 and w[1] > 0 and w[2] < 0
    goal = lambda w, b: plain_loss(x, grade, w, b) + 1e-3 * np.abs(w).sum()
    best = goal(w, model.thresholds)
    rng = np.random.default_rng(3)
    assert all(goal(w + rng.normal(0, 0.02, 12), np.sort(model.thresholds + rng.normal(0, 0.02, 3))) > best - 1e-6 for _ in range(100))


def test_query_equals_plain_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in queries.op10_ordinal_toxicity(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts = {}
        for word in words:
            data = np.frombuffer(word.encode(), np.uint8)
            f = int(C.span_hash(C.prefix_hash(data), np.array([0]), np.array([len(data)]))[0]) >> (64 - toxicity.BITS)
            counts[f] = counts.get(f, 0) + 1
        total = sum(weight.get(f, 0) * (1 + math.log(n)) for f, n in counts.items())
        p = [1 / (1 + math.exp(b - total)) for b in model.thresholds]
        r = got[d]
        assert np.allclose([r.p1, r.p2, r.p3], p, atol=1e-9) and abs(r.severity - sum(p)) < 1e-9
        assert abs(r.severity - sum(k * (hi - lo) for k, (hi, lo) in enumerate(zip([1, *p], [*p, 0], strict=True)))) < 1e-9
        assert r.grade == sum(x >= 0.5 for x in p) and r.toxic == (r.grade > 0)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~held))
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "told").join(labels.where(held), "doc_id").select("toxic", "told", "severity", "grade").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    above = np.mean([(t.severity > c.severity) + (t.severity == c.severity) / 2 for t in toxic for c in clean])
    print(f"area under the curve {above:.3f}, toxic told {sum(r.told for r in toxic)} of {len(toxic)}, others left {sum(not r.told for r in clean)} of {len(clean)}, grades {[sum(r.grade == g for r in toxic) for g in range(4)]}")
    assert above >= 0.93 and sum(r.told for r in toxic) >= 0.5 * len(toxic) and sum(not r.told for r in clean) >= 0.98 * len(clean)
    assert np.mean([r.severity for r in toxic]) > 10 * np.mean([r.severity for r in clean])


def test_odd_tables(spark):
    bad, good = "you awful grumblefish rotten", "the calm sea and the green hill"
    table = [(i, f"{bad} {good} {i}" if i % 6 == 1 else f"{good} w{i} w{i + 1}") for i in range(90)] + [(100, None), (101, ""), (102, "..."), (None, bad), (103, bad * 20_000), (104, good), (104, good)]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({"toxic": F.lit(9), "h": F.lit("x"), "features": F.lit(1), "severity": F.lit(2), "p1": F.lit(0)})
    labels = spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(90)] + [(None, 1), (7, None), (3, 0), (999, 1), (1, 0)], "doc_id long, toxic int").withColumn("text", F.lit("?"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(table)
    by = {r.doc_id: r for r in got}
    assert by[1].toxic and not by[2].toxic and by[103].toxic and by[None].toxic
    assert by[100].severity == by[101].severity == by[102].severity
    assert len({r.severity for r in got if r.doc_id == 104}) == 1
    empty = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert len(empty) == len(table) and not any(r.toxic for r in empty)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


@pytest.mark.parametrize("grades", [[], [0, 0, 0]])
def test_nothing_to_learn(grades):
    model = toxicity.fit_ordinal(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.array(grades, int))
    assert len(model.features) == 0 and (model.probabilities(np.zeros(2)) < 0.01).all()
