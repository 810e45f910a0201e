import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import calibration as cal
from rillflow.operators import scoring as sc
from rillflow.schema import FEATURES

HOUR = cal.HOUR_US


def flows_at(spark, times):
    rng = np.random.default_rng(3)
    rows = [(f"f{i}", t, None if t is None else t - 5, *(float(x) for x in rng.random(len(FEATURES)))) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "flow_id string, close_us long, start_us long, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.mark.parametrize(("start", "end"), [(23 * HOUR + 5, 25 * HOUR), (0, 1), (5 * HOUR, 5 * HOUR + 300_000_000), (-HOUR, 2 * HOUR), (20 * HOUR, 80 * HOUR)])
def test_a_period_reads_its_hours_alone(spark, tmp_path_factory, start, end):
    times = [*range(-3 * HOUR, 90 * HOUR, HOUR // 3), 25 * HOUR - 1, 25 * HOUR, 23 * HOUR + 5, 0, None]
    store = str(tmp_path_factory.mktemp("store") / "flows")
    cal.write_flow_store(flows_at(spark, times), store)
    got = cal.read_period(spark, store, start, end)
    assert sorted(r["close_us"] for r in got.select("close_us").collect()) == sorted(t for t in times if t is not None and start <= t < end)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(close_us)" in plan
    hours = {(t // HOUR) for t in times if t is not None and start // HOUR <= t // HOUR <= (end - 1) // HOUR}
    assert len({f.rsplit("/", 1)[0] for f in got.inputFiles()}) >= len(hours)
    scanned = spark.read.parquet(store).where(F.col("day") * 24 + F.col("hour") >= start // HOUR).where(F.col("day") * 24 + F.col("hour") <= (end - 1) // HOUR)
    assert scanned.select("day", "hour").distinct().count() == len(hours)


def test_recalibration_against_numpy(spark, tmp_path):
    times = [HOUR + i * 1_000_000 for i in range(900)]
    flows = flows_at(spark, times)
    cal.write_flow_store(flows, str(tmp_path / "s"))
    scaler = sc.fit_scaler(flows)
    got = cal.recalibrated_from(spark, str(tmp_path / "s"), scaler, HOUR + 200_000_000).first()
    x = np.array([[r[f] for f in FEATURES] for r in flows.orderBy("close_us").collect()])
    z = (x - x.mean(0)) / x.std(0)
    v = (z / np.linalg.norm(z, axis=1, keepdims=True))[200:500]
    score = ((v - v.mean(0)) ** 2).sum(1)
    assert got["n_flows"] == 300 and np.allclose(got["mu"], v.mean(0)) and np.isclose(got["delta"], np.quantile(score, 0.99))
    empty = cal.recalibrated_from(spark, str(tmp_path / "s"), scaler, 50 * HOUR).first()
    assert empty["n_flows"] == 0 and empty["mu"] is None and empty["delta"] is None


def test_thresholds_of_periods_from_sketches(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.gamma(2.0, 1.0, 30_000), np.full(5_000, 3.0), rng.random(5_000) * 40])
    times = rng.integers(0, 60 * 60_000_000, len(values))
    rows = spark.createDataFrame(list(zip(times.tolist(), values.tolist(), ["x" if t % 2 else "y" for t in times.tolist()], strict=True)), "close_us long, score double, sensor string")
    odd = spark.createDataFrame([(None, 1.0, "x"), (5, None, "x")], rows.schema)
    minutes = cal.score_sketches(rows.unionByName(odd).repartition(7), by=("sensor",))
    assert minutes.count() == 120
    for start, end, p in ((0, 60, 0.95), (0, 60, 0.99), (7, 12, 0.5), (30, 31, 0.99)):
        found = cal.period_threshold(minutes, start * 60_000_000, end * 60_000_000, p).first()
        inside = values[(times >= start * 60_000_000) & (times < end * 60_000_000)]
        assert found["n"] == len(inside)
        below, not_above = (inside < found["delta"]).mean(), (inside <= found["delta"]).mean()
        assert below <= p + 0.005 + 1 / len(inside) and not_above >= p - 0.005 - 1 / len(inside)
    by_sensor = cal.period_threshold(minutes, 0, 60 * 60_000_000, 0.9, ("sensor",)).collect()
    assert {r["sensor"] for r in by_sensor} == {"x", "y"} and sum(r["n"] for r in by_sensor) == len(values)
    assert cal.period_threshold(minutes, -10, 0).count() == 0
