"""Embedding whitening against NumPy's symmetric eigensolver and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import bidiagonal, queries, whitening

from .conftest import SF


def shapes():
    rng = np.random.RandomState(3)
    orthogonal = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    repeated = rng.standard_normal((80, 20))
    repeated[:, 10:] = repeated[:, :10]
    yield "one", np.array([[-2.5]])
    yield "zero", np.zeros((4, 4))
    yield "unit", np.eye(6)
    for n in (2, 3, 64):
        yield f"random {n}", rng.standard_normal((n, n))
        yield f"graded {n}", rng.standard_normal((n, n)) * 10.0 ** -np.linspace(0, 7, n)
        yield f"orthogonal {n}", orthogonal(n)
        yield f"near equal {n}", orthogonal(n) @ np.diag(1 + 1e-8 * rng.rand(n)) @ orthogonal(n)
    yield "of half rank", np.linalg.qr(repeated, mode="r")
    yield "one row", np.outer(np.eye(12)[0], rng.standard_normal(12))


@pytest.mark.parametrize("name,matrix", list(shapes()), ids=[n for n, _ in shapes()])
def test_singular_vectors(name, matrix):
    values, vectors = bidiagonal.right_singular(matrix)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-11
    assert np.abs(matrix.T @ matrix @ vectors - vectors * values).max() <= 1e-12 * top


def test_small_singular_values_are_accurate():
    # a bidiagonal matrix with entries of 20 magnitudes: its determinant, the product of its diagonal, is kept by dqds
    a, b = 10.0 ** -np.arange(0.0, 20.0), 10.0 ** -np.arange(1.0, 20.0)
    values = bidiagonal.squared_singular_values(a, b)
    assert math.isclose(np.log(values).sum(), 2 * np.log(a).sum(), rel_tol=1e-13)


def brute(rows, components=4):
    """By the contract's words, with Python integers and numpy.linalg.eigh."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in kept]
    listed = sorted({tuple(v) for _, v in x})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = np.array(listed, dtype=float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = (np.array([v for _, v in x], dtype=float) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
    return n, {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x}, {i: w for (i, _), w in zip(x, white)}, values / (centred**2).sum() * n


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, white, explained = brute(rows)
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 4 * len(deviation) and {r.component for r in got} == {1, 2, 3, 4}
    sign = {}
    for r in got:
        w = white[r.vec_id][r.component - 1]
        s = sign.setdefault(r.component, math.copysign(1, w * r.whitened))
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(s * r.whitened - w) < 1e-8 and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert r.identity_error < 1e-9


def test_odd_rows(spark):
    rng = np.random.RandomState(5)
    vectors = [(i, [float(c) for c in np.float32(rng.standard_normal(5))]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0])]
    table = spark.createDataFrame(vectors + vectors[:20] + odd + [(None, vectors[0][1])], "vec_id long, embedding array<float>").withColumn("component", F.lit("x")).withColumn("n", F.lit(1))
    n, deviation, white, _ = brute(vectors)
    got = whitening.whiten(table).collect()
    assert n == 60 and len(got) == 4 * 81 and {r.vec_id for r in got} == {*range(60), None}
    assert all(r.n == 60 and r.identity_error < 1e-9 for r in got)
    assert all(r.deviation == deviation[r.vec_id or 0] for r in got)
    again = whitening.whiten(table.repartition(7)).collect()
    close = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(abs(abs(close[r.vec_id, r.component]) - abs(r.whitened)) < 1e-9 for r in again)


def test_no_spread_and_nothing(spark):
    schema = "vec_id int, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0, 5.0]), (2, [1.0, 3.0, 5.0]), (3, [2.0, 5.0, 5.0])], schema)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(math.isclose(r.explained, 1.0 if r.component == 1 else 0.0, abs_tol=1e-12) for r in line)
    for rows in ([], [(1, None)], [(1, [])]):
        empty = whitening.whiten(spark.createDataFrame(rows, schema))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.5, 2.0]), (4, [2.0**31, 3.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    assert len(got) == 8 and got[1, 1].deviation is None and got[1, 1].n == 4 and got[1, 1].identity_error < 1e-6
    small = [(i, [float(i * 2**40), 1.0 * i]) for i in range(3)]
    _, deviation, _, _ = brute(small)
    want = {i: d if d < 2**63 else None for i, d in deviation.items()}
    assert {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(small, "vec_id int, embedding array<double>")).collect()} == want


def test_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.RandomState(8)
    rows = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    _, deviation, white, _ = brute(rows, 3)
    monkeypatch.setattr(whitening, "ROWS", 16)
    listed = whitening.fit_list(table.select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")).repartition(9), 3)
    model = whitening.fit(listed.repartition(9), 3)
    y = np.abs(model.project(np.floor(np.array([v for _, v in rows]) * 256).astype(np.int64)))
    assert np.abs(y - np.abs(np.array([white[i] for i, _ in rows]))).max() < 1e-9
