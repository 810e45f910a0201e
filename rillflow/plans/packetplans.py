"""Queries on packets and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.packets import FLAG_LETTERS, flow_id, header_length, part_of_flow_id, tcp_flags
from rillflow.operators import flows as fl
from rillflow.plans import sqltext as s
from rillflow.schema import FEATURES
from rillflow.sources import packets as src
from rillflow.sources.scratch import scratch_path

KEY_SQL = s.KEY


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.packets_from_events(spark, sf_dir)


def _flows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return fl.extract(_packets(spark, sf_dir), **options)


def read_packets(spark, sf_dir):
    """Write the packets as a packet table and scan it with its schema."""
    path = scratch_path(spark, "packets")
    src.with_timestamp(_packets(spark, sf_dir)).write.parquet(path)
    return src.read_table(spark, path)


def decode_frames(spark, sf_dir):
    return src.decode_frames(src.encode_frames(_packets(spark, sf_dir)))


def filter_transport(spark, sf_dir):
    raw = _packets(spark, sf_dir).withColumn("ip_version", F.when(F.col("pkt_seq") % 11 == 0, 6).otherwise(4)).withColumn("proto", F.when(F.col("pkt_seq") % 13 == 0, 1).otherwise(F.col("proto")))
    return src.transport_only(raw).select("pkt_seq", "proto", "ip_version")


def decode_tcp_flags(spark, sf_dir):
    raw = F.when(F.col("pkt_seq") % 7 == 0, None).otherwise(F.concat(F.reverse("flags"), F.lit("EC")))
    return _packets(spark, sf_dir).select("pkt_seq", tcp_flags(raw).alias("flags"))


def header_length_query(spark, sf_dir):
    ihl, offset = (F.col("pkt_seq") % 3 + 5).cast("int"), (F.col("pkt_seq") % 5 + 5).cast("int")
    return _packets(spark, sf_dir).select("pkt_seq", header_length(F.col("proto"), ihl, offset).cast("long").alias("header_len"))


def normalize_flow_key(spark, sf_dir):
    return fl.keyed(_packets(spark, sf_dir)).select("pkt_seq", *fl.KEY)


def packet_direction(spark, sf_dir):
    """The direction of each packet in both modes, the second one on the first one's rows."""
    lo = fl.keyed(_packets(spark, sf_dir)).withColumn("lo_mode", F.col("is_fwd").cast("int")).drop("is_fwd", *fl.KEY[:4])
    return fl.keyed(lo, "all_forward").select("pkt_seq", "lo_mode", F.col("is_fwd").cast("int").alias("all_forward_mode"))


def flow_id_query(spark, sf_dir):
    return fl.keyed(_packets(spark, sf_dir)).groupBy(flow_id().alias("flow_id")).agg(F.count("*").alias("packets"))


def parse_flow_id(spark, sf_dir):
    ids = fl.keyed(_packets(spark, sf_dir)).select("pkt_seq", F.when(F.col("pkt_seq") % 9 == 0, F.substring_index(flow_id(), "-", 2)).otherwise(flow_id()).alias("flow"))
    return ids.select("pkt_seq", part_of_flow_id(F.col("flow"), 1).alias("hi_ip"), part_of_flow_id(F.col("flow"), 3).alias("hi_port"))


def _sessions(spark, sf_dir, **options):
    return fl.sessions(fl.keyed(_packets(spark, sf_dir)), **options)


def sessionize_flows(spark, sf_dir):
    return _sessions(spark, sf_dir).select("pkt_seq", *fl.FLOW)


def sessionize_flows_sliced(spark, sf_dir):
    """The same flows, found in slices of ten minutes of each pair."""
    return fl.sessions_by_slices(fl.keyed(_packets(spark, sf_dir)), 600_000_000).select("pkt_seq", *fl.FLOW)


def flows_idle_timeout(spark, sf_dir):
    """The idle rule alone, by session windows; a gap of exactly the timeout stays inside."""
    rows = fl.keyed(_packets(spark, sf_dir)).withColumn("ts", F.timestamp_micros("ts_us"))
    # windows end one timeout after their last row, exclusively
    gap = F.session_window("ts", "60 seconds 1 microsecond")
    got = rows.groupBy(*fl.KEY, gap).agg(F.count("*").alias("packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return got.select(*fl.KEY, "packets", "start_us", "end_us")


def flows_packet_cap(spark, sf_dir):
    """The cap of four packets, and why and when each flow was closed under it."""
    return _flows(spark, sf_dir, max_packets=4, min_packets=1).select(*fl.FLOW, F.col("packet_count").cast("long").alias("packets"), "start_us", "reason", "close_us")


def packet_iat(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _sessions(spark, sf_dir)
    side = F.lag("ts_us").over(W.partitionBy(*fl.KEY, "seg", "chunk", "is_fwd").orderBy("ts_us", "pkt_seq"))
    return rows.select("pkt_seq", "gap_us", (F.col("ts_us") - side).alias("side_gap_us"))


def _feature_query(*names):
    def run(spark, sf_dir):
        return _flows(spark, sf_dir).select("flow_id", "seg", "chunk", *names)

    return run


def extract_features(spark, sf_dir):
    return _flows(spark, sf_dir).select("flow_id", "seg", "chunk", "start_us", "end_us", "reason", *FEATURES)


def min_packets_filter(spark, sf_dir):
    return _flows(spark, sf_dir, min_packets=3).select("flow_id", "seg", "chunk", "packet_count")


def assemble_features(spark, sf_dir):
    from rillflow.operators.scoring import assembled

    rows = _flows(spark, sf_dir).select("flow_id", "seg", "chunk", F.posexplode(assembled()).alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("long")).withColumn("value", F.col("value").cast("double"))


def discard_counts(spark, sf_dir):
    """What is left out and why, in two passes that each count before any shuffle of rows."""
    raw = _packets(spark, sf_dir).withColumn("ip_version", F.when(F.col("pkt_seq") % 11 == 0, 6).otherwise(4)).withColumn("proto2", F.when(F.col("pkt_seq") % 13 == 0, 1).otherwise(F.col("proto")))
    left = raw.agg(F.count_if(F.col("ip_version") != 4).alias("not_ipv4"), F.count_if((F.col("ip_version") == 4) & ~F.col("proto2").isin(6, 17)).alias("other_protocol"))
    every = _flows(spark, sf_dir, min_packets=1).agg(F.count_if(F.col("packet_count") < 2).alias("short_flows"))
    both = left.crossJoin(F.broadcast(every))
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).alias("n")) for c in ("not_ipv4", "other_protocol", "short_flows")])))


def _flow_sql(*names: str) -> str:
    return f"{s.FLOWS} select flow_id, seg, chunk, {', '.join(names)} from flows"


DIRECTIONAL = ["fwd_packet_count", "bwd_packet_count", "fwd_byte_count", "bwd_byte_count", "avg_fwd_packet_size", "avg_bwd_packet_size"]
GROUPS = {
    "flow_totals": ["duration", "packet_count", "byte_count", "avg_packet_size"],
    "flow_direction_stats": DIRECTIONAL,
    "flow_iat_mean": ["fwd_iat_mean", "bwd_iat_mean", "flow_iat_mean"],
    "flow_iat_std": ["flow_iat_std"],
    "flow_header_bytes": ["fwd_header_len", "bwd_header_len"],
    "flow_flag_counts": ["syn_flag_count", "fin_flag_count", "rst_flag_count", "ack_flag_count"],
}
QUERIES = {
    "read_packets": read_packets,
    "decode_frames": decode_frames,
    "filter_transport": filter_transport,
    "decode_tcp_flags": decode_tcp_flags,
    "header_length": header_length_query,
    "normalize_flow_key": normalize_flow_key,
    "packet_direction": packet_direction,
    "flow_id": flow_id_query,
    "parse_flow_id": parse_flow_id,
    "sessionize_flows": sessionize_flows,
    "sessionize_flows_sliced": sessionize_flows_sliced,
    "flows_idle_timeout": flows_idle_timeout,
    "flows_packet_cap": flows_packet_cap,
    "packet_iat": packet_iat,
    "extract_features": extract_features,
    "min_packets_filter": min_packets_filter,
    "assemble_features": assemble_features,
    "discard_counts": discard_counts,
    **{k: _feature_query(*v) for k, v in GROUPS.items()},
}
_COLUMNS = ", ".join(src.COLUMNS)
_ID = f"concat_ws('-', {KEY_SQL})"
SQL = {
    "read_packets": f"{s.PACKETS} select {_COLUMNS} from packets",
    "decode_frames": f"{s.PACKETS} select {_COLUMNS} from packets",
    "filter_transport": f"{s.PACKETS}, v as (select pkt_seq, case when pkt_seq % 13 = 0 then 1 else proto end as proto, case when pkt_seq % 11 = 0 then 6 else 4 end as ip_version from packets) select * from v where ip_version = 4 and proto in (6, 17)",
    "decode_tcp_flags": f"{s.PACKETS} select pkt_seq, " + " || ".join(f"case when pkt_seq % 7 <> 0 and contains(flags, '{c}') then '{c}' else '' end" for c in FLAG_LETTERS) + " as flags from packets",
    "header_length": f"{s.PACKETS} select pkt_seq, ((pkt_seq % 3 + 5) * 4 + case when proto = 6 then (pkt_seq % 5 + 5) * 4 else 8 end)::bigint as header_len from packets",
    "normalize_flow_key": f"{s.KEYED} select pkt_seq, {KEY_SQL} from keyed",
    "packet_direction": f"{s.KEYED} select pkt_seq, is_fwd::int as lo_mode, 1 as all_forward_mode from directed",
    "flow_id": f"{s.KEYED} select {_ID} as flow_id, count(*) as packets from keyed group by 1",
    "parse_flow_id": f"{s.KEYED} select pkt_seq, hi_ip, case when pkt_seq % 9 = 0 then '?' else hi_port::varchar end as hi_port from keyed",
    "sessionize_flows": f"{s.SESSIONS} select pkt_seq, {KEY_SQL}, seg, chunk from sess",
    "sessionize_flows_sliced": f"{s.SESSIONS} select pkt_seq, {KEY_SQL}, seg, chunk from sess",
    "flows_idle_timeout": f"{s.KEYED}, g as (select *, case when ts_us - lag(ts_us) over (partition by {KEY_SQL} order by ts_us, pkt_seq) <= 60000000 then 0 else 1 end as opens from keyed), n as (select *, sum(opens) over (partition by {KEY_SQL} order by ts_us, pkt_seq rows unbounded preceding) as part from g) select {KEY_SQL}, count(*) as packets, min(ts_us) as start_us, max(ts_us) as end_us from n group by {KEY_SQL}, part",
    "flows_packet_cap": f"{s.flows(cap=4)} select {KEY_SQL}, seg, chunk, packet_count::bigint as packets, start_us, reason, {s.CLOSE} as close_us from every_flow",
    "packet_iat": f"{s.SESSIONS} select pkt_seq, gap_us, ts_us - lag(ts_us) over (partition by {KEY_SQL}, seg, chunk, is_fwd order by ts_us, pkt_seq) as side_gap_us from sess",
    "extract_features": _flow_sql("start_us", "end_us", "reason", *FEATURES),
    "min_packets_filter": f"{s.FLOWS} select flow_id, seg, chunk, packet_count from flows where packet_count >= 3",
    "assemble_features": f"{s.FLOWS}, lists as (select flow_id, seg, chunk, [{', '.join(f + '::float' for f in FEATURES)}] as x from flows) select flow_id, seg, chunk, (i - 1)::bigint as pos, x[i]::double as value from (select *, unnest(range(1, {len(FEATURES) + 1})) as i from lists)",
    "discard_counts": f"{s.FLOWS}, v as (select pkt_seq % 11 = 0 as six, pkt_seq % 13 = 0 as other from packets) select 'not_ipv4' as reason, count(*) filter (where six) as n from v union all select 'other_protocol', count(*) filter (where not six and other) from v union all select 'short_flows', count(*) filter (where packet_count < 2) from every_flow",
    **{k: _flow_sql(*v) for k, v in GROUPS.items()},
}
