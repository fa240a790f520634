"""Batch correction against the same rounds in numpy, and the mixing of samples."""

import numpy as np
import pytest

from cytoplan.operators import harmony


def plain(sample, z, start, theta, sigma, penalty, rounds, passes):
    """The rounds on whole arrays; the ridge regressions by solving their normal equations."""
    names = np.unique(sample)
    phi = (sample[:, None] == names).astype(float)
    share = phi.mean(0)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    y, press, observed, now = unit(start), np.ones((len(names), len(start))), None, z.copy()

    def soft():
        d = -2 * (1 - unit(now) @ y.T) / sigma
        r = np.exp(d - d.max(1, keepdims=True)) * (phi @ press)
        return r / r.sum(1, keepdims=True)

    for _ in range(rounds):
        for _ in range(passes):
            r = soft()
            y = unit(r.T @ unit(now))
            found = phi.T @ r
            observed = found if observed is None else (found + observed) / 2
            press = ((observed.sum(0) * share[:, None] + 1) / (observed + 1)) ** theta
        r, after = soft(), z.copy()
        design = np.column_stack([np.ones(len(z)), phi])
        for k in range(len(start)):
            left = design.T @ (design * r[:, k : k + 1]) + np.diag([0, *[penalty] * len(names)])
            w = np.linalg.solve(left, design.T @ (z * r[:, k : k + 1]))
            w[0] = 0
            after -= r[:, k : k + 1] * (design @ w)
        now = after
    return now


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(2)
    kinds = np.array([[5.0, 0, 0, 1], [0, 5, 0, 1], [0, 0, 5, 1]])
    sample, kind = np.repeat([3, 5, 9], [150, 200, 90]), rng.integers(0, 3, 440)
    shift = {3: np.zeros(4), 5: np.array([1.5, 1.5, 0, 0]), 9: np.array([0, 1.5, 1.5, -1])}
    return sample, kind, kinds[kind] + rng.normal(0, 0.4, (440, 4)) + np.stack([shift[s] for s in sample])


def run(spark, sample, z, **more):
    df = spark.createDataFrame([(int(s), i, [float(v) for v in x]) for i, (s, x) in enumerate(zip(sample, z))], "sample_id long, cell_id long, features array<double>").repartition(3)
    return np.array([r.features for r in sorted(harmony.corrected(df, **more).collect(), key=lambda r: r.cell_id)])


def between(sample, kind, z):
    """Mean distance of a kind's centres by sample."""
    centres = [[z[(sample == s) & (kind == k)].mean(0) for s in np.unique(sample)] for k in range(3)]
    return np.mean([np.sqrt(((a - b) ** 2).sum()) for c in centres for i, a in enumerate(c) for b in c[:i]])


@pytest.mark.parametrize("span", [harmony.SPAN, 17])
def test_equals_numpy(spark, cohort, monkeypatch, span):
    monkeypatch.setattr(harmony, "SPAN", span)
    sample, _, z = cohort
    start = z[[0, 7, 11, 200, 401]]
    got = run(spark, sample, z, start=start, rounds=2, passes=2)
    assert np.allclose(got, plain(sample, z, start, 2.0, 0.1, 1.0, 2, 2), atol=1e-8)


def test_samples_mix_and_kinds_stay_apart(spark, cohort):
    sample, kind, z = cohort
    got = run(spark, sample, z, clusters=6)
    assert between(sample, kind, got) < 0.35 * between(sample, kind, z)
    centres = np.stack([got[kind == k].mean(0) for k in range(3)])
    assert (((got[:, None] - centres) ** 2).sum(2).argmin(1) == kind).mean() > 0.97


def test_one_sample_nulls_and_no_rows(spark):
    z = np.random.default_rng(0).random((20, 3))
    assert np.array_equal(run(spark, np.ones(20, int), z), z)
    df = spark.createDataFrame([(1, 1, None), (2, 2, [1.0, 2.0]), (1, 3, [2.0, 1.0])], "sample_id long, cell_id long, features array<double>")
    assert {r.cell_id for r in harmony.corrected(df, rounds=1, passes=1).collect()} == {2, 3} and harmony.corrected(df.limit(0)).collect() == []
