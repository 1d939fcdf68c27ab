"""Whitening against dense eigenvectors and plain sums."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from evalloom.llm import whitening as wh


def plain(rows, wanted=8):
    """Rows as integers, n, exact deviations, whitened values, shares."""
    width = max((len(v) for _, v in rows), default=0)
    x = [[math.floor(1024 * float(c)) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in rows]
    n, sums = len(x), [sum(r[j] for r in x) for j in range(width)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    c = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    keep = e > 1e-12 * max(e[0], 1e-300)
    return n, deviation, c @ u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(c.T @ c / n)


def compare(spark, rows, tolerance=1e-8):
    """Rows are told apart by their ids."""
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, component string, whitened double").repartition(3)
    got = wh.whiten(df).collect()
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, white, share = plain(usable)
    assert len(got) == len(usable) * white.shape[1]
    place = {i: p for p, (i, _) in enumerate(usable)}
    made = np.zeros(white.shape)
    for r in got:
        made[place[r["id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == deviation[place[r["id"]]]
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-8 and r["identity_error"] < 1e-9
    signs = np.sign((made * white).sum(axis=0))
    assert np.abs(made - white * signs).max() < tolerance
    assert np.abs(made.T @ made / n - np.eye(white.shape[1])).max() < 1e-9


def test_embeddings(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(spark, rows)


def test_odd_rows(spark):
    """Null vectors and entries, non-finite ones, unequal lengths, an empty vector, repeated and large rows."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(11).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf")]), (104, [0.5] * 4), (105, []), (None, [0.25] * 11)]
    rows += [(106, [2.0] * 11), (107, [2.0] * 11), (108, [-300.0] + [0.0] * 10)]
    compare(spark, rows)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [None]])
def test_nothing_to_whiten(spark, vectors):
    """No rows, one row, equal rows: there is no component."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert wh.whiten(df).collect() == []


def test_fewer_components_than_asked_for(spark):
    compare(spark, [(i, [float(i % 3), float(i % 5), 1.0, float(i % 3)]) for i in range(30)])


def test_equal_variances(spark):
    """Components of equal variance are any basis; the result is white all the same."""
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    made = np.zeros((4, 2))
    for r in got:
        made[r["id"], r["component"] - 1] = r["whitened"]
    assert np.abs(made.T @ made / 4 - np.eye(2)).max() < 1e-12 and {round(r["explained"], 12) for r in got} == {0.5}


def test_entries_without_exact_sums_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(PySparkException, match="too large"):
        wh.whiten(df).collect()


def test_deviations_beyond_64_bits():
    """Exact also where n times the spread, or its square, leaves 64 bits."""
    x = np.array([[3, 1 << 39], [100, -5]], np.int64)
    for n in (10, 1 << 20, 1 << 40):
        sums = [7 * n, 12345]
        fit = wh.Whitening(n, sums, 0, 1 << 40, np.zeros((2, 0)), np.zeros(0), np.zeros(0), 0.0)
        off = fit.deviations(2, x.tobytes())
        want = [[n * int(a) - s for a, s in zip(r, sums)] for r in x]
        assert [[int(v) for v in r] for r in off] == want
        assert fit.squares(off) == [sum(v * v for v in r) for r in want]


def test_leading_pairs_of_flat_and_steep_spectra():
    for d, top in ((64, 1.0), (150, 1e6), (3, 1.0)):
        rng = np.random.default_rng(d)
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        e = np.sort(top ** rng.random(d) + rng.random(d))[::-1]
        v = (q * e) @ q.T
        values, vectors, images = wh.leading_pairs(lambda t: v @ t, d, 8)
        assert np.abs(values - e[:8][: len(values)]).max() < 1e-12 * e[0]
        assert np.linalg.norm(images - vectors * values, axis=0).max() <= 4 * max(64, 4 * d) * np.finfo(float).eps * e[0]
