import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import baseline as bl
from rillflow.operators import encoders
from rillflow.operators import scoring as sc
from rillflow.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def test_network_folds_batch_norm(spark):
    rng = np.random.default_rng(1)
    dims = [(5, 4), (4, 3), (3, 2)]
    layers = []
    for i, (a, b) in enumerate(dims):
        layer = {"weight": rng.standard_normal((b, a)), "bias": rng.standard_normal(b)}
        if i < 2:
            layer |= {"gamma": rng.standard_normal(b), "beta": rng.standard_normal(b), "mean": rng.standard_normal(b), "var": rng.random(b) + 0.1}
        layers.append(layer)
    x = rng.standard_normal((7, 5))
    h = x
    for layer in layers:
        h = h @ layer["weight"].T + layer["bias"]
        if "gamma" in layer:
            h = np.maximum((h - layer["mean"]) / np.sqrt(layer["var"] + 1e-5) * layer["gamma"] + layer["beta"], 0)
    expected = h / np.linalg.norm(h, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, z array<double>")
    got = encoders.encode_mlp(df, encoders.Network.folded(layers)).orderBy("i").collect()
    assert np.allclose([r["v"] for r in got], expected, atol=1e-5)


def test_replay_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3)) * 0.3
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "at long, v array<double>")
    steps = bl.replay(df, [0.0] * 3, 0.8, 20, alpha=None, ratio=0.5)
    mu = np.zeros(3)
    for k, step in enumerate(steps):
        part = x[20 * k : 20 * k + 20]
        score = ((part - mu) ** 2).sum(1)
        used = part[(score <= 0.8) & (score < 0.4)]
        assert step[2] == (score > 0.8).sum() and step[3] == len(used)
        mu = used.mean(0) if len(used) else mu
        assert np.allclose(step[5], mu)


def test_replay_by_spans(spark):
    rng = np.random.default_rng(4)
    rows = [(i, row.tolist()) for i, row in enumerate(rng.standard_normal((120, 3)) * 0.3)] + [(None, [0.0] * 3), (-5, [0.1] * 3), (7, None), (7, [0.1]), (7, [0.1, None, 0.1])]
    df = spark.createDataFrame(rows, "at long, v array<double>")
    by_one, by_four = ([tuple(r) for r in bl.replay_versions(df, [0.0] * 3, 0.8, 10, alpha=0.9, span=n).orderBy("step").collect()] for n in (1, 4))
    assert by_one == by_four == bl.replay(df, [0.0] * 3, 0.8, 10, alpha=0.9)
    assert [r[:2] for r in by_four] == [(-1, 1), (0, 13)] + [(k, 10) for k in range(1, 12)]


def test_a_replay_job_serves_many_windows(spark):
    df = spark.createDataFrame([(i, [0.1, 0.2]) for i in range(90)], "at long, v array<double>")
    spark.sparkContext.setJobGroup("replay", "")
    try:
        assert len(bl.replay(df, [0.0, 0.0], 1.0, 1)) == 90
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("replay")) < 30


def test_baseline_table_problems(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bl.load_baseline(spark, str(tmp_path / "none"), 3)
    spark.createDataFrame([(1, [1.0, 2.0])], "version long, mu array<double>").write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError):
        bl.load_baseline(spark, str(tmp_path / "b"), 3)
    assert bl.load_baseline(spark, str(tmp_path / "b"), 2).first()["version"] == 1


def test_update_without_normal_vectors_keeps_the_baseline(spark):
    rows = spark.createDataFrame([([3.0, 4.0], 25.0, True, 1.0)], "v array<double>, score double, is_anomaly boolean, delta double")
    base = spark.createDataFrame([([1.0, 2.0],)], "mu array<double>")
    got = bl.updated(rows, base, 2).first()
    assert got["mu"] == [1.0, 2.0] and got["n_used"] == 0


def test_approximate_threshold(spark):
    scores = spark.range(1000).select((F.col("id") / 10).alias("score"))
    exact, rough = sc.threshold(scores, 0.95).first()["delta"], sc.threshold(scores, 0.95, exact=False).first()["delta"]
    assert abs(exact - rough) < 0.2


def test_model_folder_problems(spark, tmp_path):
    scaler = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 2.0)], "feature string, mean double, scale double")
    versions = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "version long, mu array<double>")
    with pytest.raises(FileNotFoundError):
        bl.load_model(spark, str(tmp_path / "none"), ["a", "b"])
    bl.save_model(scaler, versions, str(tmp_path / "m"), 2, 3)
    rows, base = bl.load_model(spark, str(tmp_path / "m"), ["a", "b"])
    assert rows.count() == 2 and base.first()["mu"] == [1.0, 2.0, 3.0]
    for names in (["a", "c"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            bl.load_model(spark, str(tmp_path / "m"), names)
    bl.save_model(scaler, versions, str(tmp_path / "n"), 2, 4)
    with pytest.raises(ValueError):
        bl.load_model(spark, str(tmp_path / "n"), ["a", "b"])


@pytest.mark.parametrize("name", ["update_baseline_ema", "update_baseline_replace"])
def test_updates_by_no_vector_match_sql(spark, tmp_path, name):
    # all lie at distance 1 of their centroid 0, so none is clearly normal
    rows = [(2 * i + j, [sign if k == i else 0.0 for k in range(64)], i % 10) for i in range(64) for j, sign in enumerate((1.0, -1.0))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    here, there, wrong = differences(registry.QUERIES[name](spark, str(tmp_path)), registry.SQL[name], str(tmp_path))
    assert here == there == 64 and not wrong, wrong


@pytest.mark.parametrize("name", ["update_baseline_replace", "update_baseline_ema"])
def test_updates_by_odd_vectors_match_sql(spark, tmp_path, name):
    # nulls, and positions that a vector has too few or too many of, are left out; the vector's others count
    rng = np.random.default_rng(5)
    unit = [(v / np.linalg.norm(v)).tolist() for v in rng.standard_normal((300, 64))]
    odd = [[None, *unit[0][1:]], [None] * 64, [0.0] * 63 + [None], unit[1][:32], [*unit[2], 0.1], [], None, [float("nan")] + [0.0] * 63]
    for part, more in {"finite": odd[:-1], "nan": odd}.items():
        rows = [(i, v, i % 10) for i, v in enumerate([*unit, *more])]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / part / "embeddings.parquet"))
        here, there, wrong = differences(registry.QUERIES[name](spark, str(tmp_path / part)), registry.SQL[name], str(tmp_path / part))
        assert here == there == 64 and not wrong, wrong
