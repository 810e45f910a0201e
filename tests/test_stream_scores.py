import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import decisions as dc
from rillflow.operators import encoders
from rillflow.operators import flows as fl
from rillflow.operators import scoring as sc
from rillflow.operators.rollups import bucket
from rillflow.sources import packets as src
from rillflow.streaming import jobs
from rillflow.streaming.tracker import track_in_order
from tests.test_streams import packets_at
from tests.test_streams_in_order import made, write_triggers


@pytest.mark.parametrize("every", [None, "1 second"])
def test_encoded_and_scored_in_the_stream_as_in_the_batch(spark, tmp_path, every):
    rows = made(150, 11)
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    write_triggers(spark, [rows[:70], rows[70:], [(900, 86_400, 9, "A")], [(901, 86_401, 9, "A")]], folder)
    network = encoders.Network.seeded((20, 16, 8), 4)
    flows = fl.extract(src.with_micros(packets_at(spark, rows)))
    scaler = sc.fit_scaler(flows)
    vectors = encoders.encode_mlp(sc.scaled(flows, scaler), network).withColumn("v", F.col("v").cast("array<double>"))
    base = sc.centroid(vectors, 8).crossJoin(sc.threshold(sc.scored(vectors, sc.centroid(vectors, 8)), 0.7)).persist()
    jobs.use_rocksdb(spark)
    stream = track_in_order(src.read_stream(spark, folder, late="1 minute", bytes_per_trigger=1))
    jobs.score_flows(stream, scaler, base, path, network, (1_000_000, 60_000_000), every)
    batch = sc.classified(sc.scored(vectors, base.select("mu")), base.select("delta"))
    for width in (1_000_000, 60_000_000):
        want = batch.groupBy(bucket(F.col("close_us"), width)).agg(F.count("*"), F.count_if("is_anomaly")).collect()
        got = jobs.window_counts(spark, path).where(F.col("width") == width).drop("width").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["anomalies"] for r in got) > 3
    assert len(spark.read.parquet(f"{path}/decisions").select("batch").distinct().collect()) > 1
    records = dc.read_decisions(spark, f"{path}/records/*")
    want = dc.decision_records(batch).orderBy("flow_id", "ts").collect()
    got = records.orderBy("flow_id", "ts").collect()
    assert [(r["flow_id"], r["ts"], r["is_anomaly"], r["packet_count"], r["duration_s"]) for r in got] == [(r["flow_id"], r["ts"], r["is_anomaly"], r["packet_count"], r["duration_s"]) for r in want]
    assert all(len(r["top_features"]) == 5 for r in got)


def test_alerts_from_now_on(spark, tmp_path):
    folder = str(tmp_path / "records")
    one = lambda i, odd: spark.createDataFrame([(float(i), f"a-b-{i}-2-6", 0.5, 0.4, odd, 2, 1.0)], "ts double, flow_id string, score double, delta_effective double, is_anomaly boolean, packet_count long, duration_s double")
    for i in range(3):
        dc.write_decisions(one(i, True), folder)
    time.sleep(1.1)
    now = spark.sql("select cast(current_timestamp() as string)").first()[0]
    time.sleep(0.1)
    for i in range(3, 7):
        dc.write_decisions(one(i, i != 4), folder)
    got = {}
    for name, since in (("all", None), ("new", now)):
        jobs.to_files(jobs.alerts(spark, folder, since), str(tmp_path / name))
        got[name] = sorted(r["ts"] for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert got == {"all": [0, 1, 2, 3, 5, 6], "new": [3, 5, 6]}


def test_a_growing_log_of_baselines(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((80, 3)) * 0.3
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(8):
        spark.createDataFrame([(i, x[i].tolist()) for i in range(10 * k, 10 * k + 10)], "at long, v array<double>").coalesce(1).write.mode("append").parquet(folder)
    first = spark.createDataFrame([([0.0] * 3, 0.5)], "mu array<double>, delta double")
    stream = spark.readStream.schema("at long, v array<double>").option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.adapt_batches(stream, first, path, 3, alpha=0.9, ratio=0.8, segment=2)
    got = jobs.versions(spark, path).orderBy("version").collect()
    mu = np.zeros(3)
    for k, row in enumerate(got):
        part = x[10 * k : 10 * k + 10]
        score = ((part - mu) ** 2).sum(1)
        used = part[(score <= 0.5) & (score < 0.4)]
        mu = 0.9 * mu + 0.1 * used.mean(0) if len(used) else mu
        assert row["n_used"] == len(used) and np.allclose(row["mu"], mu)
    assert len(got) == 8
    assert sorted(p.name for p in (tmp_path / "out" / "versions").iterdir()) == ["4", "5", "6", "7"]
    assert sorted(p.name for p in (tmp_path / "out" / "segments").iterdir()) == ["0", "1"]


def test_a_missing_version_is_an_error(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, [0.1])], "at long, v array<double>")
    first = spark.createDataFrame([([0.0], 0.5)], "mu array<double>, delta double")
    run = lambda: jobs.adapt_batches(spark.readStream.schema(rows.schema).parquet(folder), first, path, 1)
    rows.write.mode("append").parquet(folder)
    run()
    (tmp_path / "out" / "versions" / "0" / "_SUCCESS").unlink()
    rows.write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="version 0 of the baseline"):
        run()
