import numpy as np
import pytest

from ranklake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def brute(vectors, k=4):
    """numpy on the whole list: n, the fit list's sums, and its largest eigenpairs."""
    x = np.array([[int(np.floor(256.0 * float(np.float32(c)))) for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    c = ((n * fit - sums) / n).astype(float)
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    rows = ((n * x - sums) / n).astype(float)
    return n, ((n * x - sums) ** 2).sum(axis=1), rows @ q / np.sqrt(e), e / np.trace(v), v


def compare(spark, vectors, k=4):
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    got = whitening.whitened(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained, _ = brute(vectors, k)
    assert len(got) == k * len(vectors) and (got.n == n).all()
    assert got.deviation.tolist() == np.repeat(deviation.astype(object), k).tolist()
    own = got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((own * white).sum(axis=0))
    np.testing.assert_allclose(own * sign, white, atol=1e-9)
    np.testing.assert_allclose(got.explained.to_numpy()[:k], explained, rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize("spectrum", ["flat", "steep", "low rank beside noise"])
def test_against_numpy(spark, spectrum):
    r = np.random.default_rng(3)
    v = r.standard_normal((500, 40))
    if spectrum == "steep":
        v *= 2.0 ** -np.arange(40)[None, :] * 50
    if spectrum == "low rank beside noise":
        v = v * 0.01 + r.standard_normal((500, 4)) @ r.standard_normal((4, 40)) * [[3.0]]
    v = np.float32(v).tolist()
    compare(spark, v + v[:50] + [v[0]] * 200)  # repeats count once in the fit


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(4)
    compare(spark, np.float32(r.standard_normal((60, 5)) * 1e4).tolist())


def test_range_expands_only_where_residuals_fail(spark):
    r = np.random.default_rng(5)
    steep = r.standard_normal((800, 60)) * 3.0 ** -np.arange(60)[None, :] * 1e6
    flat = r.standard_normal((800, 60))
    for v, columns in ((steep, 16), (flat, 60)):
        fit = spark.createDataFrame([([int(c) for c in np.floor(256 * row)],) for row in v], "x array<long>")
        n, sums = whitening._sums(fit)
        x = np.floor(256 * v)
        assert (n, sums) == (800, x.astype(np.int64).sum(axis=0).tolist())
        e, q, trace, width = whitening.components(fit, n, sums)
        assert width == columns
        c = x - x.mean(axis=0)
        cov = c.T @ c / n
        want = np.linalg.eigvalsh(cov)[::-1][:4]
        np.testing.assert_allclose(e, want, rtol=1e-9)
        np.testing.assert_allclose(trace, np.trace(cov), rtol=1e-9)
        assert np.abs(cov @ q - q * e).max() < 1e-9 * e[0]


def test_awkward_rows(spark):
    rows = [
        (1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [INF, 0.0], 0), (5, [NAN, 0.0], 0), (6, [], 0),
        (None, [0.0, -1.0], 0), (7, [-0.001, 3.0], None), (8, [1.0, 2.0, 3.0], 0), (9, [-INF, 1.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whitened(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1"] * 4 + ["7"] * 2 + ["None"] * 2)
    assert {r.n for r in got} == {3} and {r.component for r in got} == {1, 2}
    twice = [r for r in got if r.vec_id == 1]
    assert len(set(twice)) == 2
    wide = df
    for i, c in enumerate(("n", "x", "component", "whitened", "deviation", "count", "d", "dim", "v")):
        wide = wide.withColumn(c, df.label + i)
    assert sorted(map(str, whitening.whitened(wide).collect())) == sorted(map(str, got))
    assert whitening.whitened(df.limit(0)).collect() == []
    assert whitening.whitened(df.filter("vec_id in (2, 3, 4, 5, 6, 9)")).collect() == []


def test_no_variance(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, None)] * 4
    line = whitening.whitened(spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)).collect()
    first = [r for r in line if r.component == 1]
    assert sorted(round(r.whitened, 12) for r in first) == [-1.0, 1.0] and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in first)
    assert all(r.whitened is None for r in line if r.component == 2)


def test_entries_beyond_long_stop_at_its_ends(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 0.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    x = {r.vec_id: list(r.x) for r in whitening.integers(df).collect()}
    assert x == {1: [2**63 - 1, 0], 2: [-(2**63), 0], 3: [0, 256]}
    got = whitening.whitened(df).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id != 3} == {None}
