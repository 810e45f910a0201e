import pytest

from rillflow.operators import rollups

M = rollups.MINUTE


def frames(spark):
    packets = spark.createDataFrame([(t,) for t in (1, 2, M + 5, 19 * M)], "ts_us long")
    flows = spark.createDataFrame([(1, 18 * M + 7, True), (2, M + 5, False)], "start_us long, close_us long, is_anomaly boolean")
    return packets, flows


def test_silent_minutes_have_rows(spark):
    packets, flows = frames(spark)
    drops = spark.createDataFrame([(3 * M + 1, 4), (3 * M + 2, 6)], "ts_us long, n int")
    batches = spark.createDataFrame([(M, 10, 5.0), (M + 1, 20, 7.0)], "at_us long, n_rows long, duration_ms double")
    got = {r["window_start_us"] // M: r for r in rollups.summary(packets, flows, drops=drops, batches=batches).collect()}
    assert sorted(got) == list(range(20))
    assert [got[i]["active_flows"] for i in range(20)] == [2, *[1] * 17, 0, 0]
    assert [got[i]["packets_total"] for i in range(20)] == [2, 1, *[0] * 17, 1] and got[7]["packets_per_sec"] == 0 and got[7]["anomaly_rate"] == 0
    assert [got[i]["dropped"] for i in (2, 3, 4)] == [0, 10, 0]
    assert (got[1]["n_batches"], got[1]["avg_batch_size"], got[1]["avg_latency_ms"]) == (2, 15.0, 6.0) and got[2]["n_batches"] == 0
    assert got[18]["anomaly_count"] == 1 and got[18]["flows_closed"] == 1


def test_open_flows_of_every_minute(spark):
    got = rollups.active_flows(frames(spark)[1]).orderBy("bucket_us").collect()
    assert [r["active"] for r in got] == [2, *[1] * 17, 0]


@pytest.mark.parametrize("width", [M, 7 * M, 1_000_000_007, 3 * rollups.DAY])
def test_every_bucket_over_days(spark, width):
    at = [k * width for k in (-3, 0, 1 + 5 * rollups.DAY // width)]
    per = spark.createDataFrame([(t, 1) for t in at], "bucket_us long, n long")
    got = rollups.dense(per, width).orderBy("bucket_us").collect()
    assert [r["bucket_us"] for r in got] == list(range(at[0], at[-1] + 1, width)) and sum(r["n"] for r in got) == 3
    assert rollups.dense(per.where("false"), width).count() == 0
