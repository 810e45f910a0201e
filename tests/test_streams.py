import numpy as np
from pyspark.sql import functions as F

from rillflow.operators import flows as fl
from rillflow.schema import FEATURES, PACKET
from rillflow.sources import packets as src
from rillflow.streaming import jobs
from rillflow.streaming.tracker import flows_of, late_rows, track


def packets_at(spark, rows):
    """(seq, seconds, pair, flags) as packets with their time as a timestamp."""
    made = [(q, int(s * 1_000_000), f"10.0.0.{pair}", "10.0.0.9", 5, 6, 6, 50 + q, 40, flags) for q, s, pair, flags in rows]
    columns = "pkt_seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, pkt_len int, header_len int, flags string"
    return src.with_timestamp(spark.createDataFrame(made, columns))


def test_flows_that_cross_triggers_and_a_late_row(spark, tmp_path):
    triggers = [
        [(0, 1, 1, "S"), (1, 2, 2, "A"), (2, 5, 1, "A")],
        [(3, 8, 1, "A"), (4, 9, 2, "FA"), (5, 10, 3, "A")],
        [(6, 7, 1, "A"), (7, 30, 1, "RA"), (8, 31, 3, "A")],
        [(9, 86_400, 4, "A")],
    ]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in triggers:
        packets_at(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    jobs.use_rocksdb(spark)
    jobs.to_files(track(src.read_stream(spark, folder, late="1 hour", files_per_trigger=1)), out)
    done = spark.read.parquet(out)
    # row 6 comes a trigger after row 3 of its flow, which is a second younger
    assert [tuple(r) for r in late_rows(done).select("lo_ip", "rows").collect()] == [("10.0.0.1", 1)]
    inside = [r for rows in triggers for r in rows if r[0] != 6]
    want = fl.extract(src.with_micros(packets_at(spark, inside))).select("lo_ip", "start_us", "end_us", *FEATURES).collect()
    got = flows_of(done).select("lo_ip", "start_us", "end_us", *FEATURES).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(0, 100, 1, "A"), (1, 101, 1, "A")], [(2, 9_000, 1, "A")], [(3, 9_001, 1, "A")], [(4, 102, 1, "A")], [(5, 86_400, 2, "A")]):
        packets_at(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    dropped = jobs.to_files(jobs.summaries(src.read_stream(spark, folder, late="1 minute", files_per_trigger=1)), out)
    assert dropped == 1 and spark.read.parquet(out).agg(F.sum("packets")).first()[0] == 4


def test_adaptive_batches_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3)) * 0.3
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        part = spark.createDataFrame([(i, x[i].tolist()) for i in range(20 * k, 20 * k + 20)], "at long, v array<double>")
        part.coalesce(1).write.mode("append").parquet(folder)
    first = spark.createDataFrame([([0.0] * 3, 0.5)], "mu array<double>, delta double")
    stream = spark.readStream.schema("at long, v array<double>").option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.adapt_batches(stream, first, path, 3, alpha=0.9, ratio=0.8)
    got = spark.read.parquet(f"{path}/versions/*").orderBy("version").collect()
    mu = np.zeros(3)
    for k, row in enumerate(got):
        part = x[20 * k : 20 * k + 20]
        score = ((part - mu) ** 2).sum(1)
        used = part[(score <= 0.5) & (score < 0.4)]
        mu = 0.9 * mu + 0.1 * used.mean(0) if len(used) else mu
        assert row["n_used"] == len(used) and np.allclose(row["mu"], mu)
    assert len(got) == 3


def test_batch_metrics_count_all_flows(spark):
    from rillflow.plans import registry

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["batch_metrics"](spark, sf).first()
    assert got["n_rows"] == registry.QUERIES["extract_features"](spark, sf).count() and got["batches"] == 2 and got["mean_size"] == got["n_rows"] / 2


def test_packet_schema_of_the_helper(spark):
    assert packets_at(spark, [(0, 1, 1, "A")]).schema.fieldNames() == PACKET.fieldNames()
    assert packets_at(spark, [(0, 1, 1, "A")]).where(F.unix_micros("ts") == 1_000_000).count() == 1
