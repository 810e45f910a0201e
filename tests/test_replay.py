import numpy as np
import pytest

from rillflow.operators.replay import replay


def plain(rows, start, width, alpha, ratio):
    out = []
    for key, (mu, delta) in start.items():
        mu = np.array(mu)
        mine = [(at // width, v) for k, at, v in rows if k == key and at is not None]
        for step in sorted({s for s, _ in mine}):
            window = [v for s, v in mine if s == step]
            scores = [((np.array(v) - mu) ** 2).sum() if v and None not in v and len(v) == len(mu) else np.inf for v in window]
            used = [v for v, s in zip(window, scores, strict=True) if s <= delta and s < ratio * delta]
            new = np.mean(used, 0) if used else mu
            new = new if alpha is None else alpha * mu + (1 - alpha) * new
            out.append((key, step, len(window), sum(s > delta for s in scores), len(used), float(np.sqrt(((new - mu) ** 2).sum())), new.tolist()))
            mu = new
    return out


@pytest.mark.parametrize(("window_rows", "span", "alpha"), [(10**6, None, None), (10**6, 3, 0.9), (25, None, 0.9), (25, 4, None), (0, None, None)])
def test_sensors_against_numpy(spark, window_rows, span, alpha):
    rng = np.random.default_rng(9)
    names = ["a", "b", None, "only rows"]
    rows = [(names[int(rng.integers(0, 4))], int(rng.integers(-30, 100)), (rng.standard_normal(3) * 0.4).tolist()) for _ in range(200)]
    rows += [("a", 55, (rng.standard_normal(3) * 0.4).tolist()) for _ in range(60)] + [("a", None, [0.0] * 3), ("b", 7, None), ("b", 7, [0.1]), ("b", 7, [0.1, None, 0.2])]
    start = {"a": ([0.1, 0.0, 0.0], 0.8), "b": ([0.0, 0.0, 0.0], 0.6), None: ([0.0, 0.2, 0.0], 0.7), "only a baseline": ([0.0] * 3, 1.0)}
    frame = spark.createDataFrame([(*r, "?") for r in rows], "key string, at long, v array<double>, step string").repartition(3)
    base = spark.createDataFrame([(k, *v) for k, v in start.items()], "key string, mu array<double>, delta double")
    got = replay(frame, base, 10, ("key",), alpha, 0.8, window_rows, span).collect()
    order = lambda r: (repr(r[0]), r[1])
    want = plain(rows, start, 10, alpha, 0.8)
    assert [r[:5] for r in sorted(map(tuple, got), key=order)] == [r[:5] for r in sorted(want, key=order)] and len(want) > 25
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert np.allclose(a[5], b[5]) and np.allclose(a[6], b[6])


def test_no_baseline_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 1, [0.0])], "key string, at long, v array<double>")
    base = spark.createDataFrame([("a", [0.0], 1.0)], "key string, mu array<double>, delta double")
    assert replay(rows, base.where("false"), 10, ("key",)).count() == 0
    assert replay(rows.where("false"), base, 10, ("key",)).count() == 0
    assert replay(rows, base, 10, ("key",)).columns == ["key", "step", "flows", "anomalies", "used", "drift", "mu"]
