import numpy as np
import pytest

from rillflow.llm.whitening import Whitening, fit_whitening, one_sided_jacobi, op12_whitening, pivoted_cholesky, whiten

SCHEMA = "vec_id long, embedding array<double>, n string, x int, c string"


def plain(rows, k=4):
    """(vec_id, component) to the contract's figures, by numpy's own eigenvectors."""
    kept = [(i, np.floor(256 * np.array(e, float)).astype(np.int64)) for i, e in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        out += [(i, j + 1, n, deviation, float((x - sums / n) @ vectors[:, j] / np.sqrt(values[j])), values[j] / values.sum()) for j in range(k)]
    return out


def same(found, want):
    """Equal but for each component's sign."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3], abs(r[4]))
    found, want = sorted((tuple(r)[:6] for r in found), key=key), sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want] and found
    for j in sorted({r[1] for r in want}):
        a, b = (np.array([r[4:] for r in rows if r[1] == j]) for rows in (found, want))
        sign = 1 if (a[:, 0] * b[:, 0]).sum() > 0 else -1
        assert np.allclose(sign * a[:, 0], b[:, 0], atol=1e-8) and np.allclose(a[:, 1], b[:, 1], rtol=1e-9)


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, r in ((7, 7), (12, 5), (33, 33), (1, 1)):
        b = rng.standard_normal((d, r)) * np.logspace(0, -4, r)
        a = b @ b.T
        factor = pivoted_cholesky(a)
        assert factor.shape == (d, r) and np.allclose(factor @ factor.T, a)
        assert sorted((factor != 0).sum(1).tolist())[: min(d, r)] == list(range(1, r + 1))  # triangular up to the rows' order
        values, vectors = one_sided_jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:r], rtol=1e-9)
        assert np.allclose(vectors.T @ vectors, np.eye(r), atol=1e-12) and np.allclose(a @ vectors, vectors * values)
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


@pytest.mark.parametrize("hot", [0, 400])
def test_against_numpy(spark, hot):
    rng = np.random.default_rng(2)
    made = (rng.standard_normal((300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + 40).tolist()
    rows = [*enumerate(made), *[(7, made[7])] * 2, *[(1000 + i, made[3]) for i in range(hot)], (None, made[5]), (5, made[9])]
    odd = [(400, None), (401, [1.0] * 5 + [None]), (402, [float("nan")] * 6), (403, [1.0] * 5 + [float("inf")])]
    frame = spark.createDataFrame([(*r, "?", 3, "?") for r in rows + odd], SCHEMA).repartition(5)
    found = whiten(frame).collect()
    same(found, plain(rows))
    assert {r["identity_error"] for r in found} and max(r["identity_error"] for r in found) < 1e-9
    other = frame.unionByName(spark.createDataFrame([(500, [1.0], "?", 1, "?"), (501, [], "?", 1, "?"), (502, [1e300] * 6, "?", 1, "?")], SCHEMA))
    same(whiten(other).collect(), plain(rows))


def test_the_query_against_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(op12_whitening(spark, "/root/testdata/sf0.001").collect(), plain(rows))


def test_little_or_no_variance(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "?", 3, "?") for r in rows], SCHEMA)
    assert whiten(frame([])).count() == 0 and whiten(frame([(1, [])])).count() == 0
    assert whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whiten(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    assert whiten(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits():
    x = np.array([[0, 0], [1 << 40, 3], [-(1 << 40), 5]])
    model = Whitening(3, [0, 8], np.ones(1), np.ones((2, 1)), 1.0, np.zeros(2))
    assert model.deviations(x) == [64, None, None]
    assert model.deviations(x // (1 << 12)) == [64, (3 << 28) ** 2 + 64, (3 << 28) ** 2 + 64]


def test_a_fit_of_nothing(spark):
    assert fit_whitening(spark.createDataFrame([], "x array<long>")) is None
