import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillflow.operators import flows as fl
from rillflow.schema import FEATURES
from rillflow.sources import packets as src

#: Fixed values that results must equal: rows of (seconds, size, forward, flags, header), and their features in order.
GOLDEN = [
    ([(0.0, 100, True, "S", 20), (1.0, 200, True, "A", 20)], [1.0, 2, 300, 2, 0, 300, 0, 150, 150, 0, 1.0, 0, 1.0, 0, 40, 0, 1, 0, 0, 1]),
    (
        [(0.0, 60, True, "S", 40), (0.1, 60, False, "SA", 40), (0.2, 54, True, "A", 20), (0.5, 200, True, "A", 20), (0.6, 54, False, "FA", 20)],
        [0.6, 5, 428, 3, 2, 314, 114, 85.6, 314 / 3, 57, 0.25, 0.5, 0.15, math.sqrt(0.03 / 4), 80, 60, 2, 1, 0, 4],
    ),
    (
        [(0.0, 500, True, "SA", 40), (0.5, 500, False, "A", 20), (1.5, 300, True, "A", 20), (1.8, 100, False, "A", 20)],
        [1.8, 4, 1400, 2, 2, 800, 600, 350, 400, 300, 1.5, 1.3, 0.6, math.sqrt(0.26 / 3), 60, 40, 1, 0, 0, 4],
    ),
]
PACKET = "pkt_seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, pkt_len int, header_len int, flags string"


def as_packets(spark, rows):
    ends = [("10.0.0.1", "10.0.0.9", 10, 20), ("10.0.0.9", "10.0.0.1", 20, 10)]
    return spark.createDataFrame([(i, round(t * 1e6), *ends[not f], 6, size, h, flags) for i, (t, size, f, flags, h) in enumerate(rows)], PACKET)


@pytest.mark.parametrize("rows, expected", GOLDEN)
def test_golden(spark, rows, expected):
    got = fl.extract(as_packets(spark, rows)).select(*FEATURES).collect()
    assert len(got) == 1
    assert list(got[0]) == pytest.approx(expected, abs=1e-5)


def test_single_properties(spark):
    same = fl.extract(as_packets(spark, [(5.0, 100, True, "S", 20), (5.0, 200, True, "A", 20)])).first()
    assert same["duration"] == pytest.approx(1e-6)
    reset = fl.extract(as_packets(spark, [(0.0, 54, True, "S", 20), (0.1, 54, False, "RA", 20)])).first()
    assert (reset["rst_flag_count"], reset["ack_flag_count"], reset["reason"]) == (1, 1, "fin_rst")
    spread = fl.extract(as_packets(spark, [(0.0, 100, True, "S", 20), (1.0, 100, True, "A", 20), (4.0, 100, True, "A", 20)])).first()
    assert spread["flow_iat_std"] == pytest.approx(1.0)


def test_directions(spark):
    rows = as_packets(spark, GOLDEN[1][0])
    assert fl.extract(rows, direction="all_forward").first()["bwd_packet_count"] == 0


def loop(packets, timeout, cap):
    """The close rules as a plain loop: the flow number of each packet."""
    open_flow, number, out = {}, 0, {}
    for seq, us, key, flags in sorted(packets, key=lambda p: (p[1], p[0])):
        at = open_flow.get(key)
        if at and us - at["last"] > timeout:
            at = None
        if not at:
            number += 1
            at = open_flow[key] = {"id": number, "n": 0, "last": us}
        at["n"] += 1
        at["last"] = us
        out[seq] = at["id"]
        if "F" in flags or "R" in flags or at["n"] >= cap:
            del open_flow[key]
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([0, 1, 60, 61, 5]), st.sampled_from(["", "S", "A", "FA", "R"]), st.booleans()), min_size=1, max_size=40), st.sampled_from([1, 2, 3, 2000]))
def test_sessions_follow_the_rules(spark, steps, cap):
    at, rows, plain = 0, [], []
    for i, (pair, gap, flags, back) in enumerate(steps):
        at += gap * 1_000_000
        a, b = (f"10.0.0.{pair}", 5), ("10.0.0.9", 6)
        s, d = (b, a) if back else (a, b)
        rows.append((i, at, s[0], d[0], s[1], d[1], 6, 50, 40, flags))
        plain.append((i, at, pair, flags))
    got = fl.sessions(fl.keyed(spark.createDataFrame(rows, PACKET)), max_packets=cap).collect()
    expected = loop(plain, 60_000_000, cap)
    groups = {}
    for r in got:
        groups.setdefault((r["lo_ip"], r["seg"], r["chunk"]), set()).add(r["pkt_seq"])
    wanted = {}
    for seq, n in expected.items():
        wanted.setdefault(n, set()).add(seq)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_shuffle_from_packets_to_features(spark):
    packets = src.packets_from_events(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fl.extract(packets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1


def test_no_packets(spark):
    assert fl.extract(spark.createDataFrame([], PACKET)).count() == 0


def test_reason_and_closing_time_follow_the_given_rules(spark):
    rows = [(i, i * 1_000_000, "10.0.0.1", "10.0.0.9", 5, 6, 6, 50, 40, "A") for i in range(6)]
    packets = spark.createDataFrame(rows, PACKET)
    got = fl.extract(packets, max_packets=4, timeout_us=10_000_000).orderBy("chunk").collect()
    assert [(r["reason"], r["end_us"], r["close_us"]) for r in got] == [("cap", 3_000_000, 3_000_000), ("end", 5_000_000, 15_000_000)]
    assert fl.extract(packets).first()["close_us"] == 65_000_000


def test_windows_count_flows_at_their_close(spark):
    from rillflow.operators import rollups

    rows = [(0, 0, "10.0.0.1", "10.0.0.9", 5, 6, 6, 50, 40, "A"), (1, 1_000_000, "10.0.0.1", "10.0.0.9", 5, 6, 6, 50, 40, "A"), (2, 130_000_000, "10.0.0.2", "10.0.0.9", 5, 6, 6, 50, 40, "A"), (3, 131_000_000, "10.0.0.2", "10.0.0.9", 5, 6, 6, 50, 40, "FA")]
    packets = spark.createDataFrame(rows, PACKET)
    got = {r["window_start_us"] // 60_000_000: (r["packets_total"], r["flows_closed"], r["active_flows"]) for r in rollups.summary(packets, fl.extract(packets)).collect()}
    assert got == {0: (2, 0, 1), 1: (0, 1, 0), 2: (2, 1, 0)}


@pytest.mark.parametrize("slice_us", [1_000_000, 7_000_000, 3_600_000_000])
def test_slices_give_the_same_flows(spark, slice_us):
    import random

    rng = random.Random(slice_us)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([0, 1, 1, 3, 12]) * 1_000_000
        rows.append((i, at, f"10.0.0.{rng.randint(1, 3)}", "10.0.0.9", 5, 6, 6, 50, 40, rng.choice(["", "A", "A", "A", "FA"])))
    keyed = fl.keyed(spark.createDataFrame(rows, PACKET))
    names = ["pkt_seq", "seg", "chunk", "place", "gap_us", "next_us"]
    whole, cut = (sorted(map(tuple, d.select(names).collect())) for d in (fl.sessions(keyed, 10_000_000, 7), fl.sessions_by_slices(keyed, slice_us, 10_000_000, 7)))
    assert whole == cut
    packets = spark.createDataFrame(rows, PACKET)
    whole, cut = (sorted(map(tuple, fl.extract(packets, timeout_us=10_000_000, slice_us=s).collect()), key=str) for s in (None, slice_us))
    assert whole == cut


def test_frames_with_header_options(spark):
    import struct

    def frame(ihl, offset, proto, flags, kind=0x0800, version=4):
        ip = struct.pack("!BBHHHBBH4B4B", version << 4 | ihl, 0, 99, 0, 0, 64, proto, 0, 10, 0, 0, 1, 192, 168, 1, 2) + bytes(4 * (ihl - 5))
        l4 = struct.pack("!HHIIBBHHH", 5000, 443, 0, 0, offset << 4, flags, 0, 0, 0) + bytes(4 * (offset - 5)) if proto == 6 else struct.pack("!HHHH", 53, 5353, 8, 0)
        return bytes(12) + struct.pack("!H", kind) + ip + l4

    frames = [frame(5, 5, 6, 0x02), frame(7, 8, 6, 0x12), frame(15, 15, 6, 0x11), frame(9, 5, 17, 0), frame(5, 5, 1, 0), frame(5, 5, 6, 0, kind=0x86DD), frame(5, 5, 6, 0, version=6)]
    table = spark.createDataFrame([(i, 10 * i, bytearray(f)) for i, f in enumerate(frames)], "pkt_seq long, ts_us long, frame binary")
    got = [tuple(r[c] for c in ("pkt_seq", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "pkt_len", "header_len", "flags")) for r in src.decode_frames(table).orderBy("pkt_seq").collect()]
    ends = ("10.0.0.1", "192.168.1.2")
    assert got == [(0, *ends, 5000, 443, 6, 99, 40, "S"), (1, *ends, 5000, 443, 6, 99, 60, "SA"), (2, *ends, 5000, 443, 6, 99, 120, "AF"), (3, *ends, 53, 5353, 17, 99, 44, "")]
