import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import flows as fl
from rillflow.schema import FEATURES
from rillflow.sources import packets as src
from rillflow.streaming import jobs, tracker
from rillflow.streaming.tracker import from_state, open_flows, opened, to_state, track_in_order
from tests.test_streams import packets_at

COLUMNS = ["lo_ip", "start_us", "end_us", *FEATURES]


def made(n=150, seed=1):
    """Packets of four pairs over ten minutes, some ended by FIN or RST."""
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, 600) for _ in range(n))
    return [(i, round(t, 6), rng.choice([1, 1, 2, 3]), rng.choice(["A", "A", "A", "S", "AP", "FA", "R", ""])) for i, t in enumerate(times)]


def batch_flows(spark, rows, **options):
    return sorted(map(tuple, fl.extract(src.with_micros(packets_at(spark, rows)), **options).select(*COLUMNS).collect()))


def write_triggers(spark, triggers, folder):
    for rows in triggers:
        packets_at(spark, rows).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("options", [{}, {"timeout_us": 5_000_000, "max_packets": 3}])
def test_shuffled_files_give_the_flows_of_the_batch(spark, tmp_path, options):
    rows, rng = made(), random.Random(2)
    # rows come up to two minutes late and in any order; the watermark is three minutes behind
    arriving = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 120))
    triggers = [arriving[i : i + 25] for i in range(0, len(arriving), 25)] + [[(900, 86_400, 9, "A")], [(901, 86_401, 9, "A")]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_triggers(spark, triggers, folder)
    jobs.use_rocksdb(spark)
    sums = jobs.counted(track_in_order(src.read_stream(spark, folder, late="3 minutes", files_per_trigger=1), **options), out)
    got = sorted(map(tuple, spark.read.parquet(out).select(*COLUMNS).collect()))
    assert got == batch_flows(spark, rows, **options) and len(got) > 15
    assert sums[jobs.BEHIND] == 0 and sums["triggers"] >= len(triggers)


def test_only_rows_behind_the_watermark_are_counted_out(spark, tmp_path):
    rows = made(60, 3)
    behind = [r for r in rows if r[0] % 10 == 4]
    ahead = [r for r in rows if r[0] % 10 != 4]
    triggers = [ahead, [(900, 50_000, 9, "A")], [(901, 50_001, 9, "A")], behind, [(902, 86_400, 9, "A")]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_triggers(spark, triggers, folder)
    jobs.use_rocksdb(spark)
    sums = jobs.counted(track_in_order(src.read_stream(spark, folder, late="1 minute", files_per_trigger=1)), out)
    got = spark.read.parquet(out).where("lo_ip <> '10.0.0.9'").select(*COLUMNS)
    assert sums[jobs.BEHIND] == len(behind) == 6
    assert sorted(t for t in map(tuple, got.collect()) if t[1] < 1e9) == batch_flows(spark, ahead)


def test_stop_and_go_on_from_the_checkpoint(spark, tmp_path):
    rows = made(120, 5)
    folder, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    jobs.use_rocksdb(spark)
    stream = lambda: track_in_order(src.read_stream(spark, folder, late="30 seconds", files_per_trigger=1))
    write_triggers(spark, [rows[:30], rows[30:60]], folder)
    jobs.counted(stream(), out, checkpoint=checkpoint)
    halfway = {tuple(r) for r in spark.read.parquet(out).select(*COLUMNS).collect()}
    still = open_flows(spark, checkpoint).collect()
    # what is open was begun before the watermark, by packets up to whole seconds, and hasn't been idle for a minute then
    edge = int(rows[59][1] - 30) * 1_000_000
    seen = batch_flows(spark, [r for r in rows if r[1] * 1e6 < edge], min_packets=1)
    last = {}
    for r in rows:
        if r[1] * 1e6 < edge:
            last[r[2]] = r
    alive = {f"10.0.0.{p}" for p, r in last.items() if not set("FR") & set(r[3]) and r[1] * 1e6 + fl.TIMEOUT_US >= edge}
    assert {r["lo_ip"] for r in still} == alive and alive
    for r in still:
        flow = next(f for f in reversed(seen) if f[0] == r["lo_ip"])
        assert (r["first_us"], r["last_us"], r["n"]) == (flow[1], flow[2], flow[4])
    write_triggers(spark, [rows[60:90], rows[90:], [(900, 86_400, 9, "A")], [(901, 86_401, 9, "A")]], folder)
    jobs.counted(stream(), out, checkpoint=checkpoint)
    got = sorted(map(tuple, spark.read.parquet(out).select(*COLUMNS).collect()))
    assert got == batch_flows(spark, rows) and halfway < set(got)


def test_totals_over_more_triggers_than_reports_are_kept(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        triggers = [[(0, 9_000, 1, "A")], [(1, 9_001, 1, "A")], *[[(2 + i, 100 + i, 1, "A")] for i in range(12)], [(99, 86_400, 2, "A")]]
        write_triggers(spark, triggers, folder)
        raw = src.read_stream(spark, folder, late="1 minute", files_per_trigger=1).withColumn("ip_version", F.when(F.col("pkt_seq") % 4 == 0, 6).otherwise(4))
        sums = jobs.counted(jobs.summaries(jobs.transport_counted(raw)), out)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    # of the twelve late rows those of IP version 6 (4, 8 and 12) are left out before
    assert sums[jobs.BEHIND] == 9 and sums["not_ipv4"] == 4 and sums["other_protocol"] == 0 and sums["triggers"] >= 15


def test_long_timeouts(spark):
    rows = [(0, 0, 1, "A"), (1, 7_100, 1, "A"), (2, 7_101, 1, "A")]
    flow = fl.extract(src.with_micros(packets_at(spark, rows)), timeout_us=7_200_000_000).first()
    assert flow["packet_count"] == 3 and abs(flow["flow_iat_std"] - 3549.5) < 1e-6
    state = opened(5) | {"gap_squares": 3 * 7_100_000_000**2 * 10**6}
    assert from_state(to_state(state)) == state and max(to_state(state)) < 1 << 63


def test_state_is_touched_by_buckets_and_blocks_not_by_pairs(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, round(rng.uniform(0, 3_000), 6), i % 1_000, rng.choice(["A", "A", "FA"])) for i in range(6_000)]
    rng.shuffle(rows)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_triggers(spark, [rows[:3_000], rows[3_000:], [(9_900, 86_400, 1_000, "A")]], folder)
    jobs.use_rocksdb(spark)
    stream = track_in_order(src.read_stream(spark, folder, late="1 hour", files_per_trigger=1), buckets=16)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert max(o.numRowsUpdated for p in query.recentProgress for o in p.stateOperators) < 500
    got = sorted(map(tuple, spark.read.parquet(out).select(*COLUMNS).collect()))
    assert got == batch_flows(spark, rows)


class Held(dict):
    """Map state of one key."""

    containsKey, getValue, removeKey, updateValue = dict.__contains__, dict.__getitem__, dict.__delitem__, dict.__setitem__  # noqa: N815


def test_blocks_are_merged_in_order_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(tracker, "BLOCK", 8)
    one, rng = tracker.OrderedTracker(1, 1, 1), random.Random(11)
    one.held = Held()
    want = []
    for batch in range(6):
        one._begin()
        rows = np.zeros(50, tracker.HELD)
        # many equal times, of blocks of the same trigger too
        rows["us"], rows["seq"] = [rng.randrange(batch * 20, batch * 20 + 40) for _ in range(50)], range(batch * 50, batch * 50 + 50)
        pairs = [rng.choice("abc") for _ in range(50)]
        rows["pair"] = one._coded(f'["{p}", "z", "1", "2", "6"]' for p in pairs)
        want += [(us, seq, p) for us, seq, p in zip(rows["us"].tolist(), rows["seq"].tolist(), pairs, strict=True)]
        one._hold(rows)
        edge = batch * 20 + 10 if batch < 5 else 1_000
        one._begin()
        got = [(r["us"], r["seq"], one.keys[r["pair"]][0]) for part in one._complete(edge) for r in part]
        assert got == sorted(r for r in want if r[0] < edge)
        want = [r for r in want if r[0] >= edge]
    assert not want and not one.held
