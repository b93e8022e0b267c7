"""Whitening against exact sums and an eigenvalue decomposition."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tallybeam.llm import queries, whitening
from tests.conftest import SF_DIR
from tests.llm.samples import collected

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("vector", T.StringType()), T.StructField("n", T.StringType()), T.StructField("blob", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "v", "n", "b") for k, v in rows], SCHEMA)


def usable(rows):
    fine = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) and abs(c * 64) < 2**40 for c in v)]
    lengths = [len(v) for _, v in fine]
    common = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    return [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in fine if len(v) == common]


def check(spark, rows, components=32):
    found = collected(whitening.whiten(frame(spark, rows), components), "vec_id", "component", "deviation", "whitened")
    kept = usable(rows)
    n, size = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(size)]
    deviations = sorted((sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in kept))
    width = min(components, size)
    assert len(found) == n * width
    assert sorted(found.deviation[found.component == 1]) == deviations
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for _, x in kept])
    variances, vectors = np.linalg.eigh(centred.T @ centred / n)
    variances, vectors = variances[::-1], vectors[:, ::-1]
    for k in range(width):
        own = found[found.component == k + 1]
        if variances[k] < 1e-9:
            assert own.whitened.isna().all()
            assert (own.explained == 0).all()
            continue
        assert np.allclose(own.explained, variances[k] / variances.sum(), rtol=1e-9)
        apart = min(abs(variances[k] - v) for m, v in enumerate(variances) if m != k) if size > 1 else 1
        if apart > 1e-6 * variances[0]:
            expected = np.sort(centred @ vectors[:, k] / np.sqrt(variances[k]))
            assert np.allclose(np.sort(own.whitened), expected, atol=1e-7) or np.allclose(np.sort(own.whitened), np.sort(-expected), atol=1e-7)
    errors = found.identity_error.unique()
    assert len(errors) == 1
    assert np.isnan(errors[0]) == (variances[0] < 1e-9)
    assert not errors[0] > 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    check(spark, rows)
    assert queries.op11_whitening(spark, SF_DIR).count() == len(rows) * 32


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in row]) for k, row in enumerate(rng.normal(size=(60, 5)) * [1, 2, 4, 8, 0.5])]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [1.0] * 3)]
    odd += [(105, [1.0, 2.0, 3.0, 4.0, float("inf")]), (106, [3e38] * 5), (None, [1.0, -2.0, 0.5, 9.0, 0.0]), rows[3], rows[3]]
    check(spark, rows + odd, 3)


@pytest.mark.parametrize("kind", ["dependent", "few", "one", "equal"])
def test_dimensions_without_variance(spark, kind):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(40, 4)) * 640) / 64
    rows = {
        "dependent": [(k, [*map(float, r), float(r[0] + r[1]), 7.0]) for k, r in enumerate(x)],
        "few": [(k, list(map(float, r))) for k, r in enumerate(x[:3])],
        "one": [(1, [0.5, 1.5])],
        "equal": [(k, [0.25] * 3) for k in range(5)],
    }[kind]
    check(spark, rows)


def test_large_entries_stay_exact(spark):
    check(spark, [(k, [float(2**33 + 2**14 * k), float(k * k)]) for k in range(40)])


def test_empty(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_triangular_solve_and_factor():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 6))
    r = whitening.factor(x.T @ x, 0.0)
    assert np.allclose(np.triu(r), r)
    q = whitening.triangular_solve(x, r)
    assert np.allclose(q.T @ q, np.eye(6))
    assert np.allclose(q @ r, x)
    singular = whitening.factor(np.ones((3, 3)), 0.0)
    assert np.isfinite(singular).all()
    assert np.allclose(singular.T @ singular, np.ones((3, 3)), atol=1e-12)


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(k, [float(k % 7), float(k % 3)]) for k in range(90)]
    table = frame(spark, rows).repartition(9)
    total = whitening._summed(table.selectExpr("embedding AS vector"), 2, lambda x: (len(x), x.sum(axis=0)))
    assert total[0] == 90
    assert total[1].tolist() == [sum(x[j] for _, x in usable(rows)) for j in range(2)]


def test_ill_conditioned(spark):
    """Directions whose variances are apart by ten orders: one factoring alone would lose the small one."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 3))
    rows = [(k, [float(c) for c in (1e5 * r[0], 1e5 * r[0] + r[1], r[2])]) for k, r in enumerate(base)]
    found = whitening.whiten(frame(spark, rows)).toPandas()
    assert found.identity_error.max() < 1e-4
