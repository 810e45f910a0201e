"""Column expressions on packets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the flag letters that count, in their order.
FLAG_LETTERS = "SAFRPU"


def tcp_flags(raw: Column) -> Column:
    """The known letters of ``raw`` in their order; null is empty."""
    return F.concat(*[F.when(F.contains(raw, F.lit(c)), c).otherwise("") for c in FLAG_LETTERS])


def header_length(proto: Column, ihl: Column, data_offset: Column) -> Column:
    """Bytes of the IP header and the transport header (UDP's is always 8)."""
    return ihl * 4 + F.when(proto == 6, data_offset * 4).otherwise(8)


def endpoint(ip: str, port: str) -> Column:
    return F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))


def low_endpoint() -> Column:
    """The endpoint that sorts first: addresses as text, then ports as numbers."""
    return F.least(endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port"))


def high_endpoint() -> Column:
    return F.greatest(endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port"))


def flow_id() -> Column:
    return F.concat_ws("-", "lo_ip", "hi_ip", "lo_port", "hi_port", "proto")


def part_of_flow_id(flow: Column, i: int) -> Column:
    """Part ``i`` of a flow id, ``?`` where it is missing."""
    return F.coalesce(F.get(F.split(flow, "-"), F.lit(i)), F.lit("?"))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up by the binary value, alike in every engine."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)
