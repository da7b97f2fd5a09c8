"""Whitening against exact integers and numpy, and in odd cases."""

from fractions import Fraction

import numpy as np
import pytest

from pagemill.llm import queries, whitening


def rows_of(df):
    return [(r[0], r[1]) for r in df.collect()]


def brute(rows, most=32):
    """n, deviations, variances, components and whitened rows, by exact centring."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]
    z = np.array([[float(Fraction(c, n)) for c in row] for row in off])
    v = z.T @ z / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    return n, [sum(c * c for c in row) for row in off], e, c, z @ c / np.sqrt(e), np.trace(v)


def test_against_brute_force(spark, sf_dir):
    got = queries.op11_whitening(spark, sf_dir).toPandas()
    rows = rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    n, deviation, e, _, y, trace = brute(rows)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    sign = np.sign((table * y).sum(0))
    assert np.abs(table * sign - y).max() < 1e-6  # either sign, the same for all rows
    assert set(got["n"]) == {n} and got.groupby("vec_id")["deviation"].first().to_dict() == {i: d for (i, _), d in zip(rows, deviation, strict=True)}
    assert np.allclose(got.groupby("component")["explained"].first(), e / trace, rtol=1e-4)
    own = table.T @ table / n
    assert got["identity_error"].nunique() == 1 and abs(got["identity_error"][0] - np.abs(own - np.eye(len(e))).max()) < 1e-9 and got["identity_error"][0] < 1e-4


def test_far_from_zero(spark):
    """A mean far larger than the spread: centred exactly, nothing cancels."""
    rng = np.random.default_rng(2)
    rows = [(i, (1e9 + rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist()) for i in range(300)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    n, deviation, e, _, y, trace = brute(rows)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(table) - np.abs(y)).max() < 1e-6 and got["identity_error"][0] < 1e-9
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (2, [3.0, -1.0], "c"), (None, [0.5, 0.25], "d"), (3, None, "e"), (4, [nan, 1.0], "f"), (5, [inf, 1.0], "g"), (6, [1.0, None], "h"), (7, [], "i"), (8, [1.0], "j"), (9, [1e300, 0.0], "k"), (10, [-0.001, 0.001], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whitened(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((r.vec_id, r.component, r.n) for r in got.collect() if r.vec_id is not None) == sorted((i, k, 5) for i in (1, 1, 2, 10) for k in (1, 2))
    assert got.where("vec_id IS NULL").count() == 2
    assert whitening.whitened(df.where("false")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whitened(same).count() == 0  # no variance, no components
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    found = whitening.whitened(line).toPandas()
    assert set(found["component"]) == {1} and found["identity_error"].max() < 1e-9 and abs(found["explained"][0] - 1) < 1e-9


@pytest.mark.parametrize("big", [2**20, 2**33, 2**39])
def test_deviation_is_exact_or_null(spark, big):
    rows = [(i, [float(i * big), 0.5]) for i in range(3)]
    want = brute(rows)[1]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1")
    assert {r.vec_id: r.deviation for r in got.collect()} == {i: d if d < 2**63 else None for i, d in enumerate(want)}
