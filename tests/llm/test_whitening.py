"""Whitening against numpy over all vectors at once."""

import math

import numpy as np
import pytest

from siltstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string, x0 string, v string"


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(1.0, 0.1, 12)) + rng.normal(size=12)
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    good += [(None, good[0][1]), (5, good[5][1]), (5, good[5][1])]  # no id, and repeats
    bad = [(900, None), (901, []), (902, [1.0] * 11), (903, [float("nan")] * 12), (904, [1.0] * 11 + [float("inf")]), (905, [None] + [1.0] * 11), (906, [-math.inf] + [0.0] * 11)]
    return good, bad


def test_whitening_equals_numpy(spark, monkeypatch):
    good, bad = vectors()
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in good + bad], SCHEMA).repartition(4)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in good], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(((n * row - sums) ** 2).sum()) for row in x]
    centred = (x - sums / n).astype(float)
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    want = centred @ directions / np.sqrt(values)
    for pairs in (whitening.PAIRS, 10):
        monkeypatch.setattr(whitening, "PAIRS", pairs)
        got = whitening.whiten(df).collect()
        assert len(got) == 8 * n and {r["n"] for r in got} == {n}
        for k in range(8):
            rows = [r for r in got if r["component"] == k + 1]
            assert rows[0]["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
            ours = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in rows)
            sign = np.sign(sum(r[3] * w for r, w in zip(ours, [w for _, w in sorted(zip([(i is None, i or 0, d) for (i, _), d in zip(good, deviation, strict=True)], want[:, k], strict=True))], strict=True)))
            theirs = sorted((i is None, i or 0, d, sign * w) for (i, _), d, w in zip(good, deviation, want[:, k], strict=True))
            assert [r[:3] for r in ours] == [r[:3] for r in theirs]
            assert np.allclose([r[3] for r in ours], [r[3] for r in theirs], atol=1e-8)
        assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_flat_directions_and_nothing(spark):
    one = spark.createDataFrame([(1, [0.5, 0.5], "", "", "", "")], SCHEMA)
    assert whitening.whiten(one).count() == 0  # no variance
    line = spark.createDataFrame([(i, [float(i), 1.0], "", "", "", "") for i in range(4)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    assert sorted(r["whitened"] for r in got) == pytest.approx([-1.5 / 1.25**0.5, -0.5 / 1.25**0.5, 0.5 / 1.25**0.5, 1.5 / 1.25**0.5])
    assert whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA)).columns == whitening.whiten(line).columns


def test_huge_entries(spark):
    rows = [(i, [x, float(i)], "", "", "", "") for i, x in enumerate([3e38, -3e38, 1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and all(r["deviation"] is None for r in got if r["vec_id"] < 2)
