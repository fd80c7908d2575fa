"""Whitening against exact arithmetic and a dense eigensolver."""

from fractions import Fraction

import numpy as np
import pytest

from veilframe.llm import feast, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors):
    """n, sums, eigenvalues, eigenvectors and trace of the distinct integer vectors, by plain means."""
    rows = sorted({tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors})
    n, d = len(rows), len(rows[0])
    sums = [sum(r[j] for r in rows) for j in range(d)]
    centred = [[Fraction(r[j]) - Fraction(sums[j], n) for j in range(d)] for r in rows]
    z = np.array([[float(c) for c in r] for r in centred])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, sums, values[::-1], vectors[:, ::-1], values.sum()


def check(rows, by_id, components=4):
    n, sums, values, vectors, trace = brute([v for v in by_id.values() if v is not None])
    assert {r.component for r in rows} == set(range(1, components + 1))
    for r in rows:
        x = [int(np.floor(256 * float(c))) for c in by_id[r.vec_id]]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        want = sum((a - s / n) * c for a, s, c in zip(x, sums, vectors[:, r.component - 1]))
        assert abs(r.whitened) == pytest.approx(abs(want) / values[r.component - 1] ** 0.5, abs=1e-8)
        assert r.identity_error < 1e-10
    assert len({r.identity_error for r in rows}) == 1


def test_query_equals_brute_force(spark):
    rows = whitening.query(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    by_id = {r.vec_id: r.embedding for r in table}
    assert len(rows) == 4 * len(table)
    check(rows, by_id)
    first = {}
    for r in rows:  # a component has one sign for all rows
        first.setdefault(r.component, []).append((r.vec_id, r.whitened))
    n, sums, values, vectors, _ = brute(by_id.values())
    for k, got in first.items():
        want = {i: sum((int(np.floor(256 * float(c))) - s / n) * e for c, s, e in zip(v, sums, vectors[:, k - 1]))
                for i, v in by_id.items()}
        assert len({np.sign(w * want[i]) for i, w in got if abs(want[i]) > 1e-6}) == 1


def test_same_for_any_partitioning(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = [whitening.fit(df.repartition(k), 4)[0] for k in (1, 7)]
    assert got[0].sums == got[1].sums and (got[0].vectors == got[1].vectors).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [-2.0, 3.0]),
            (7, [0.5, 1.0]), (None, [1.5, 1.0]), (8, [9.0]), (9, []), (1, [0.25, -0.001]), (10, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string")
    got = whitening.whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted(
        (i or 0, c) for i in (1, 6, 7, None, 8, 9, 1) for c in (1, 2))
    equal = {r.vec_id: r.whitened for r in got if r.vec_id == 7 and r.component == 1}
    assert {r.n for r in got} == {6} and equal[7] in {r.whitened for r in got if r.vec_id == 1}
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.filter("vec_id = 7")).count() == 0  # one vector has no spread
    with pytest.raises(ValueError):
        whitening.whitened(df, id_col="component")


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(2 ** 40, 1), (-2 ** 40, 5), (3, 2 ** 30), (7, 7)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    n, sums, *_ = brute([v for _, v in rows])
    for r in got:
        exact = sum((n * int(256 * c) - s) ** 2 for c, s in zip(rows[r.vec_id][1], sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("values", [
    [1.0] * 12, [4, 4, 3, 3, 2, 2, 1, 1], [5, 3, 0, 0, 0], [10, 9, 8, 7 + 1e-9, 7] + [1] * 20, [0.8 ** k for k in range(60)],
    [0.0] * 4, [2.0]])
def test_largest_pairs(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, x = feast.largest(v, 4)
    assert len(e) == min(4, sum(a > 0 for a in values))
    assert np.allclose(e, sorted(values, reverse=True)[:len(e)], atol=1e-12 * max(values))
    assert np.abs(v @ x - x * e).max(initial=0) <= 1e-12 * max(values) and np.allclose(x.T @ x, np.eye(len(e)), atol=1e-12)


def test_many_pairs_and_inertia():
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((64, 64)))
    values = np.sort(np.random.default_rng(6).random(64))[::-1]
    v = (q * values) @ q.T
    e, x = feast.largest((v + v.T) / 2, 40)
    assert np.allclose(e, values[:40]) and np.allclose(x.T @ x, np.eye(40), atol=1e-9)
    inertia = feast.Inertia(v)
    assert all(inertia.over(s) == (values > s).sum() for s in np.linspace(-0.1, 1.1, 50))
