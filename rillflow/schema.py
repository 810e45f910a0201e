"""Record schemas and the fixed feature order."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("pkt_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("pkt_len", T.IntegerType()),
        T.StructField("header_len", T.IntegerType()),
        T.StructField("flags", T.StringType()),
    ]
)

DECISION = "ts double, flow_id string, score double, delta_effective double, is_anomaly boolean, packet_count long, duration_s double, top_features map<string,double>"
SUMMARY = "window_start_us long, window_end_us long, packets_total long, flows_closed long, packets_per_sec double, flows_per_sec double, anomaly_count long, anomaly_rate double, active_flows long, dropped long"
AUDIT = "update_id long, valid_from long, n_flows_used long, drift double, alpha double"
STATE = "updated_at string, total_flows long, total_anomalies long, scores array<double>, is_anomaly array<boolean>, timestamps array<string>"

#: The model's features in the order of its input.
FEATURES = [
    "duration",
    "packet_count",
    "byte_count",
    "fwd_packet_count",
    "bwd_packet_count",
    "fwd_byte_count",
    "bwd_byte_count",
    "avg_packet_size",
    "avg_fwd_packet_size",
    "avg_bwd_packet_size",
    "fwd_iat_mean",
    "bwd_iat_mean",
    "flow_iat_mean",
    "flow_iat_std",
    "fwd_header_len",
    "bwd_header_len",
    "syn_flag_count",
    "fin_flag_count",
    "rst_flag_count",
    "ack_flag_count",
]
