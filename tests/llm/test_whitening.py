import math

import numpy as np
import pytest

from tidewell.llm.whitening import fit_whitening, minus_mean, solve_right, squares, whiten, whole_numbers


def brute(rows, components=16):
    """Eigenvectors of the covariance of the distinct integer vectors, in exact sums."""
    ok = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    low = np.array([[n * x[j] - sums[j] for j in range(dims)] for x in fit], float) / n
    e, v = np.linalg.eigh(low.T @ low / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    trace = float((low**2).sum() / n)
    out = []
    for i, x in ok:
        c = [n * x[j] - sums[j] for j in range(dims)]
        w = np.array(c, float) / n @ v
        out += [(i, k + 1, n, sum(a * a for a in c), w[k], e[k], e[k] / trace) for k in range(len(e))]
    return out


def compare(df, want):
    got = {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert len(got) == len(want) == len({w[:2] for w in want})
    sign = {}
    for i, k, n, deviation, w, e, share in sorted(want, key=lambda r: -abs(r[4])):
        r = got[i, k]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        s = sign.setdefault(k, math.copysign(1, r["whitened"] * w))
        assert s * r["whitened"] == pytest.approx(w / math.sqrt(e), abs=1e-7)
    assert max(r["identity_error"] for r in got.values()) < 1e-10


def test_equals_eigenvectors_of_the_covariance(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(out, brute([(r["vec_id"], r["embedding"]) for r in df.collect()]))


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(6, 6)))[0] * [30000, 1000, 300, 20, 3, 1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 6)) @ basis.T)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    compare(whiten(df), brute(rows))


def test_copies_nulls_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    base = [[float(c) for c in v] for v in rng.normal(size=(50, 4))]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(3000)]
    bad = [(1, None), (2, [1.0, None, 0.0, 0.0]), (3, [float("nan")] * 4), (4, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<float>, x int, n int")
    single = [(i, np.float32(v).tolist()) for i, v in rows]
    compare(whiten(df), brute(single))
    twice = spark.createDataFrame([(None, base[0]), (7, base[1]), (7, base[1]), (8, base[2]), (9, base[3])], "vec_id long, embedding array<double>")
    out = whiten(twice, components=2).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in out) == sorted([("None", 1), ("None", 2)] + [(str(i), k) for i in (7, 7, 8, 9) for k in (1, 2)])
    assert {r["n"] for r in out} == {4}


def test_directions_without_variance(spark):
    rows = [(i, [float(i), float(2 * i), 5.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r["vec_id"], r["component"]): r for r in whiten(df).collect()}
    assert len(out) == 30
    assert all((r["whitened"] is None) == (k > 1) for (_, k), r in out.items())
    assert out[0, 1]["explained"] == pytest.approx(1) and out[0, 2]["explained"] == 0 and out[0, 1]["identity_error"] < 1e-10
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in whiten(same).orderBy("vec_id", "component").collect()] == [(i, k, 1, 0, None, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]


def test_lengths_extremes_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    short = spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 2.0]), (4, [-0.5, 1.0]), (5, [2.0, 0.0])], schema)
    compare(whiten(short), brute([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0]), (4, [-0.5, 1.0]), (5, [2.0, 0.0])]))
    huge = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [1e16]), (4, [-0.001])], schema)
    most = 1 << 52
    assert [r[0] for r in huge.orderBy("vec_id").select(whole_numbers(huge.embedding)).collect()] == [[most + 1_000_000], [1_000_000 - most], [most + 1_000_000], [999_999]]
    assert {r["deviation"] for r in whiten(huge).collect()} == {None, (3 * 999_999 - 2_999_999) ** 2}


def test_pieces():
    x = np.array([[1 << 52, 3], [-(1 << 52), 5]])
    assert minus_mean(x, 4000, [7, 8]).tolist() == [[4000 * (1 << 52) - 7, 11992], [-4000 * (1 << 52) - 7, 19992]]
    assert squares(np.array([[3, 4]])) == [25] and squares(np.array([[1 << 40, 0], [1 << 31, 1]])) == [None, (1 << 62) + 1]
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5)
    a = rng.normal(size=(20, 5))
    assert np.allclose(solve_right(a, r) @ r, a)


def test_several_gram_passes_are_made(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(whole_numbers("embedding").alias("x"))
    model = fit_whitening(df)
    assert model.passes >= 2 and model.rank == 16 and model.dims == 64
