"""Packets to flows: direction, sessions, and the twenty features.

A flow of an endpoint pair ends with a packet that carries F or R, with its ``max_packets``-th packet, before a packet that
comes more than ``timeout_us`` after the one before, and at the end of the input. The rules are windows over one
partitioning by the pair, which the feature aggregation reuses: one shuffle from packets to features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.functions.packets import flow_id, high_endpoint, low_endpoint
from rillflow.schema import FEATURES

KEY = ["lo_ip", "hi_ip", "lo_port", "hi_port", "proto"]
FLOW = [*KEY, "seg", "chunk"]
TIMEOUT_US = 60_000_000
MAX_PACKETS = 2000


def keyed(packets: DataFrame, direction: str = "lo") -> DataFrame:
    """Packets with their flow key and ``is_fwd``: from the low endpoint, or always with ``all_forward``."""
    forward = F.lit(True) if direction == "all_forward" else (F.col("src_ip") == F.col("lo_ip")) & (F.col("src_port") == F.col("lo_port"))
    ends = packets.withColumn("lo", low_endpoint()).withColumn("hi", high_endpoint())
    ends = ends.withColumns({"lo_ip": F.col("lo.ip"), "hi_ip": F.col("hi.ip"), "lo_port": F.col("lo.port"), "hi_port": F.col("hi.port")})
    return ends.drop("lo", "hi").withColumn("is_fwd", forward)


def sessions(packets: DataFrame, timeout_us: int = TIMEOUT_US, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Keyed packets with their flow (seg, chunk), place in it, the gap before them, and what follows on the pair."""
    order = W.partitionBy(*KEY).orderBy("ts_us", "pkt_seq")
    rows = packets.withColumns({"prev_us": F.lag("ts_us").over(order), "prev_flags": F.lag("flags").over(order), "next_us": F.lead("ts_us").over(order)})
    opens = F.col("prev_us").isNull() | (F.col("ts_us") - F.col("prev_us") > timeout_us) | F.col("prev_flags").rlike("[FR]")
    rows = rows.withColumn("seg", F.sum(opens.cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    place = F.row_number().over(W.partitionBy(*KEY, "seg").orderBy("ts_us", "pkt_seq")) - 1
    rows = rows.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / max_packets).cast("long"))
    return rows.withColumn("gap_us", F.when(F.col("place") % max_packets > 0, F.col("ts_us") - F.col("prev_us")))


def sessions_by_slices(packets: DataFrame, slice_us: int, timeout_us: int = TIMEOUT_US, max_packets: int = MAX_PACKETS) -> DataFrame:
    """The same as ``sessions``, for endpoint pairs too busy for one task: their time is cut into slices of ``slice_us``.

    Breaks and counts are taken inside each slice; what a slice carries over to the next (its last packet, its number of
    breaks, the packets of the flow that goes on) is summed over one row per slice. No window holds more than a slice of a
    pair, or its rows of slices. It costs three more shuffles than ``sessions``.
    """
    part = [*KEY, "slice"]
    inside = W.partitionBy(*part).orderBy("ts_us", "pkt_seq")
    rows = packets.withColumn("slice", F.floor(F.col("ts_us") / slice_us))
    rows = rows.withColumns({"prev_us": F.lag("ts_us").over(inside), "prev_flags": F.lag("flags").over(inside), "next_us": F.lead("ts_us").over(inside)})
    breaks = (F.col("ts_us") - F.col("prev_us") > timeout_us) | F.col("prev_flags").rlike("[FR]")
    rows = rows.withColumn("opens", F.when(F.col("prev_us").isNull(), 0).otherwise(breaks.cast("long")))
    order = F.struct("ts_us", "pkt_seq")
    ends = rows.groupBy(*part).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max_by("flags", order).alias("last_flags"), F.sum("opens").alias("opened"))
    slices = W.partitionBy(*KEY).orderBy("slice")
    ends = ends.withColumns({"before_us": F.lag("last_us").over(slices), "before_flags": F.lag("last_flags").over(slices), "after_us": F.lead("first_us").over(slices)})
    opens = F.col("before_us").isNull() | (F.col("first_us") - F.col("before_us") > timeout_us) | F.col("before_flags").rlike("[FR]")
    ends = ends.withColumn("opens_first", opens.cast("long"))
    so_far = F.coalesce(F.sum(F.col("opens_first") + F.col("opened")).over(slices.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*part, "before_us", "after_us", (so_far + F.col("opens_first")).alias("base"))
    rows = rows.join(ends, part)
    rows = rows.withColumn("seg", F.col("base") + F.sum("opens").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumns({"prev_us": F.coalesce("prev_us", "before_us"), "next_us": F.coalesce("next_us", "after_us")})
    counts = rows.groupBy(*part, "seg").agg(F.count("*").alias("n"))
    carried = F.coalesce(F.sum("n").over(W.partitionBy(*KEY, "seg").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*part, "seg", carried.alias("carried"))
    place = F.col("carried") + F.row_number().over(W.partitionBy(*part, "seg").orderBy("ts_us", "pkt_seq")) - 1
    rows = rows.join(counts, [*part, "seg"]).withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / max_packets).cast("long"))
    rows = rows.withColumn("gap_us", F.when(F.col("place") % max_packets > 0, F.col("ts_us") - F.col("prev_us")))
    return rows.drop("slice", "opens", "before_us", "after_us", "base", "carried")


def _exact_std(gap: str) -> F.Column:
    """Population deviation of whole numbers, from exact sums."""
    g = F.col(gap).cast("decimal(19,0)")  # wide before it is squared: two hours in microseconds pass 64 bits
    m = F.count(gap)
    top = m.cast("decimal(38,0)") * F.sum((g * g).cast("decimal(38,0)")) - F.sum(g).cast("decimal(38,0)") * F.sum(g).cast("decimal(38,0)")
    return F.coalesce(F.when(m > 0, F.sqrt(top.cast("double")) / (m * 1e6)), F.lit(0.0))


def aggregate(rows: DataFrame, by: list[str], max_packets: int = MAX_PACKETS) -> DataFrame:
    """The features of each group of rows with ts_us, gap_us, pkt_len, header_len, is_fwd and flags."""
    fwd, back = F.col("is_fwd"), ~F.col("is_fwd")
    total = lambda c, side: F.sum(F.when(side, F.col(c)).otherwise(0)).cast("double")
    n, nf, nb = F.count("*"), F.count_if(fwd), F.count_if(back)
    span = lambda side: F.max(F.when(side, F.col("ts_us"))) - F.min(F.when(side, F.col("ts_us")))
    mean_gap = lambda k, s: F.when(k > 1, s / ((k - 1) * 1e6)).otherwise(0.0)
    every = F.lit(True)
    size = F.sum("pkt_len").cast("double")
    at_least_one = lambda k: F.greatest(k, F.lit(1))
    got = rows.groupBy(*by).agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.max_by("flags", F.struct("ts_us", "pkt_seq")).alias("last_flags"),
        F.max_by("next_us", F.struct("ts_us", "pkt_seq")).alias("next_us"),
        F.greatest(span(every) / 1e6, F.lit(1e-6)).alias("duration"),
        n.cast("double").alias("packet_count"),
        size.alias("byte_count"),
        nf.cast("double").alias("fwd_packet_count"),
        nb.cast("double").alias("bwd_packet_count"),
        total("pkt_len", fwd).alias("fwd_byte_count"),
        total("pkt_len", back).alias("bwd_byte_count"),
        (size / at_least_one(n)).alias("avg_packet_size"),
        (total("pkt_len", fwd) / at_least_one(nf)).alias("avg_fwd_packet_size"),
        (total("pkt_len", back) / at_least_one(nb)).alias("avg_bwd_packet_size"),
        mean_gap(nf, span(fwd)).alias("fwd_iat_mean"),
        mean_gap(nb, span(back)).alias("bwd_iat_mean"),
        mean_gap(n, span(every)).alias("flow_iat_mean"),
        _exact_std("gap_us").alias("flow_iat_std"),
        total("header_len", fwd).alias("fwd_header_len"),
        total("header_len", back).alias("bwd_header_len"),
        *[F.count_if(F.contains("flags", F.lit(c))).cast("double").alias(f"{name}_flag_count") for c, name in (("S", "syn"), ("F", "fin"), ("R", "rst"), ("A", "ack"))],
    )
    return got.withColumn("reason", _reason(max_packets))


def _reason(max_packets: int) -> F.Column:
    """Why the flow ended; of two reasons the first that the rules name."""
    return F.when(F.col("last_flags").rlike("[FR]"), "fin_rst").when(F.col("packet_count") >= max_packets, "cap").when(F.col("next_us").isNotNull(), "idle").otherwise("end")


def close_us(timeout_us: int = TIMEOUT_US) -> F.Column:
    """When a flow is closed: with its last packet by FIN, RST or the cap, else when it has been idle for the timeout."""
    return F.when(F.col("reason").isin("fin_rst", "cap"), F.col("end_us")).otherwise(F.col("end_us") + timeout_us)


def features(rows: DataFrame, min_packets: int = 2, timeout_us: int = TIMEOUT_US, max_packets: int = MAX_PACKETS) -> DataFrame:
    """A row per flow of at least ``min_packets``: id, key, times, reason, and the features in their order."""
    flows = aggregate(rows, FLOW, max_packets).where(F.col("packet_count") >= min_packets)
    return flows.select(flow_id().alias("flow_id"), *FLOW, "start_us", "end_us", close_us(timeout_us).alias("close_us"), "reason", *FEATURES)


def extract(packets: DataFrame, direction: str = "lo", timeout_us: int = TIMEOUT_US, max_packets: int = MAX_PACKETS, min_packets: int = 2, slice_us: int | None = None) -> DataFrame:
    """From packets to the feature table; with ``slice_us`` in slices of time, for pairs too busy for one task."""
    rows = keyed(packets, direction)
    rows = sessions_by_slices(rows, slice_us, timeout_us, max_packets) if slice_us else sessions(rows, timeout_us, max_packets)
    return features(rows, min_packets, timeout_us, max_packets)
