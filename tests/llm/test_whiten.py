"""Spectra against full decompositions, whitening against plain numpy, and odd inputs."""

import math

import numpy as np
import pytest

from callgrain.llm import whiten
from callgrain.llm.queries import op11_whiten


def plainly(vectors):
    """n, sums, eigenvalues (falling), eigenvectors and centred rows, from the whole covariance."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    return n, sums, e[::-1], q[:, ::-1], y, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]


def scatter(s):
    return (s.vectors * s.values) @ s.vectors.T


@pytest.mark.parametrize("rows", [1, 2, 5, 40, 300])
@pytest.mark.parametrize("kind", ["plain", "graded", "ties", "flat"])
def test_updates_equal_the_decomposition_of_all_rows(rows, kind):
    rng = np.random.default_rng(rows)
    x = rng.integers(-900, 900, (rows, 12))
    if kind == "graded":
        x = (x * 10.0 ** -np.arange(12) * 1e4).astype(np.int64)
    if kind == "ties":
        x = x[rng.integers(0, max(1, rows // 10), rows)]
    if kind == "flat":
        x[:, 3:] = 7
    x = x + 100_000
    block, whiten.BLOCK = whiten.BLOCK, 7
    try:
        parts = [whiten.Spectrum.empty(12) for _ in range(3)]
        for k, s in enumerate(parts):
            s.add_rows(x[k::3])
        joined = parts[0]
        for s in parts[1:]:
            joined.join(s)
    finally:
        whiten.BLOCK = block
    y = x - x.mean(0)
    want = y.T @ y
    assert joined.n == rows and joined.sums == [int(v) for v in x.sum(0)]
    assert np.abs(scatter(joined) - want).max() <= 1e-11 * max(1, np.abs(want).max())
    assert np.abs(joined.vectors.T @ joined.vectors - np.eye(12)).max() < 1e-12


def test_roots_lie_between_the_poles():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 30):
        for spread in (1.0, 1e-9):
            poles, z = np.cumsum(rng.uniform(0.1, 1, k) * np.where(rng.random(k) < 0.3, spread, 1)), rng.normal(size=k) + 0.01
            at, offset = whiten.secular(poles, z)
            want = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
            assert np.allclose(poles[at] + offset, want, rtol=1e-13, atol=1e-13)
            assert (poles[at] + offset >= poles).all()


def agree(rows, vectors, components=8):
    """``rows`` by id against the plain way; ``vectors`` by id."""
    n, sums, e, q, y, far = plainly(vectors.values())
    for k, key in enumerate(vectors):
        for r in rows[key]:
            c = r["component"] - 1
            assert r["n"] == n and r["deviation"] == far[k]
            w = y @ q[:, c] / math.sqrt(e[c])
            assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-7
            assert abs(r["explained"] - e[c] / e.sum()) < 1e-12 and r["identity_error"] < 1e-8
    return e


def by_id(df, key="vec_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_query_equals_the_plain_way(spark, sf):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = by_id(op11_whiten(spark, sf))
    assert {len(v) for v in got.values()} == {8} and set(got) == set(table)
    agree(got, table)
    w = np.array([[r["whitened"] for r in sorted(v, key=lambda r: r["component"])] for v in got.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(8)).max() < 1e-8


def test_many_tasks_combine_in_rounds(spark):
    rng = np.random.default_rng(0)
    data = {k: (rng.normal(size=6) * [5, 3, 1, 0.5, 0.2, 0.1]).tolist() for k in range(400)}
    df = spark.createDataFrame([*data.items()], "vec_id long, embedding array<double>").repartition(40)
    agree(by_id(whiten.whiten(df)), data)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=3).tolist()) for k in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in good + odd], "vec_id long, embedding array<double>, n int, whitened double")
    got = by_id(whiten.whiten(df))
    assert set(got) == {*range(20), None} and len(got[3]) == 6
    n, _, e, *_ = plainly([v for _, v in good + odd[-2:]])
    assert all(r["n"] == n == 22 for rows in got.values() for r in rows) and abs(got[0][0]["explained"] - e[0] / e.sum()) < 1e-12


def test_too_few_directions(spark):
    def run(vectors):
        return whiten.whiten(spark.createDataFrame([*enumerate(vectors)], "vec_id int, embedding array<float>")).collect()

    assert run([]) == [] and run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 9) == []
    line = run([[float(k), 2.0 * k, 0.0] for k in range(5)])
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_large_numbers_stay_exact(spark):
    data = {k: [1e9 * k, -3e9 * k * k, 5.0] for k in range(9)}
    got = by_id(whiten.whiten(spark.createDataFrame([*data.items()], "vec_id int, embedding array<double>")))
    far = plainly(data.values())[-1]
    assert [int(got[k][0]["deviation"]) for k in data] == far and max(far) > 2**63


def test_vectors_of_different_lengths_or_too_large_are_refused(spark):
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e200]), (2, [1.0])]):
        with pytest.raises(Exception, match="vectors"):
            whiten.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>").coalesce(1)).collect()
