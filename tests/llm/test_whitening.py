"""Whitening against NumPy: exact sums, inertia, components of hard spectra, odd rows."""

import numpy as np
import pytest

from auditloom.llm import whitening as w
from auditloom.llm.queries import op13_feast_whitening

gen = np.random.default_rng(9)


def turned(values):
    q, _ = np.linalg.qr(gen.standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


CASES = [turned(np.linspace(1, 2, 64)), turned([9, 8, 7, 6, 5, 4, 3, 2 + 1e-12, 2, *np.ones(30)]), turned(10.0 ** -np.arange(40.0)), turned([3] * 5 + [0] * 20), np.diag(np.r_[[5.0] * 12, np.ones(20)]), np.eye(1) * 4, np.array([[2.0, 1], [1, 2]]), np.ones((6, 6)), turned(np.r_[1e9, np.ones(20)])]


@pytest.mark.parametrize("v", CASES)
def test_components(v):
    v = (v + v.T) / 2
    values, vectors = w.components(v)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    want = want[want > 1e-12 * want[0]]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-11 * np.abs(v).sum(axis=1).max()
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)


def test_no_components():
    assert len(w.components(np.zeros((3, 3)))[0]) == 0 and len(w.components(np.zeros((0, 0)))[0]) == 0


def test_inertia_and_slices():
    for _ in range(100):
        n = int(gen.integers(1, 20))
        a = gen.standard_normal((n, n)) * (gen.random((n, n)) < 0.5)
        a, s = a + a.T, float(gen.standard_normal() * 0.3)
        assert w.inertia_above(a, s) == (np.linalg.eigvalsh(a) > s).sum()
    v = turned(np.linspace(1, 2, 64))
    parts, values = w.slices(v, 20), np.linalg.eigvalsh(v)
    assert sum(c for *_, c in parts) == 20 and len(parts) == 3 and all(((values > a) & (values < b)).sum() == c for a, b, c in parts)


def brute(rows):
    own = [(i, np.floor(1024 * np.array(v, float)).astype(object).astype(int) + 100_000) for i, v in rows]
    x = np.array([v for _, v in own], float)
    n, exact = len(own), np.array([list(map(int, v)) for _, v in own], object)
    total = exact.sum(axis=0)
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return n, [int(sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True))) for r in exact], centred @ u[:, :8] / np.sqrt(e[:8]), e[:8] / np.trace(cov)


def test_rows(spark):
    rows = [(i, (gen.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(300)]
    rows += [rows[7], (None, rows[3][1])]
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, rows[0][1][:5]), (905, []), (906, [2.0**41, *rows[0][1][1:]])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, component string").repartition(3)
    got = w.whitened(df).collect()
    n, deviation, white, explained = brute(rows)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = None
    for j, (i, _) in enumerate(rows):
        for c in range(8):
            r = by[i, c + 1][0]
            assert r["deviation"] == deviation[j] == int(r["deviation_exact"]) and abs(r["explained"] - explained[c]) < 1e-9
            if j == 0:
                sign = (sign or []) + [1 if r["whitened"] * white[0, c] > 0 else -1]
            assert abs(sign[c] * r["whitened"] - white[j, c]) < 1e-7
    assert len(by[7, 1]) == 2


def test_degenerate(spark):
    kind = "vec_id long, embedding array<float>"
    assert w.whitened(spark.createDataFrame([], kind)).count() == 0
    assert w.whitened(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    assert w.whitened(spark.createDataFrame([(1, []), (2, None)], kind)).count() == 0
    assert w.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    two = w.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    large = w.whitened(spark.createDataFrame([(1, [2.0**39, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None and int(r["deviation_exact"]) == (2**49) ** 2 and abs(abs(r["whitened"]) - 1) < 1e-9 for r in large)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, white, explained = brute(rows)
    got = {(r["vec_id"], r["component"]): r for r in op13_feast_whitening(spark, sf).collect()}
    assert len(got) == 8 * n
    for c in range(8):
        a = np.array([got[i, c + 1]["whitened"] for i, _ in rows])
        assert min(np.abs(a - white[:, c]).max(), np.abs(a + white[:, c]).max()) < 1e-6
        assert all(abs(got[i, c + 1]["explained"] - explained[c]) < 1e-9 and got[i, c + 1]["deviation"] == d for (i, _), d in zip(rows, deviation, strict=True))
    assert max(r["identity_error"] for r in got.values()) < 1e-9
