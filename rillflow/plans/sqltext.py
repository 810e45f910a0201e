"""SQL that the oracles share: the same tables as the plans, as common table expressions."""

from __future__ import annotations

from rillflow.schema import FEATURES

RAW = """raw as (select event_id as pkt_seq, (epoch_us(ts) // 1000)::bigint as ts_us,
  case when event_id % 3 = 0 then '10.0.0.5' else '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) end as src_ip,
  case when event_id % 3 = 0 then '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) else '10.0.0.5' end as dst_ip,
  (case when event_id % 3 = 0 then 443 else 40000 + user_id % 20000 end)::int as src_port,
  (case when event_id % 3 = 0 then 40000 + user_id % 20000 else 443 end)::int as dst_port,
  (case when user_id % 5 = 0 then 17 else 6 end)::int as proto,
  (40 + floor(value * 2.5))::int as pkt_len,
  (case when user_id % 5 = 0 then 28 else 40 end)::int as header_len,
  case when user_id % 5 = 0 then '' when event_type = 'signup' then 'S' when event_type = 'purchase' and event_id % 4 = 0 then 'AF'
    when event_type = 'error' and event_id % 4 = 0 then 'AR' when event_type = 'view' then 'AP' else 'A' end as flags
  from events)"""
PACKETS = f"with {RAW}, packets as (select * from raw)"
KEYED = f"""{PACKETS}, ends as (select *, (src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port)) as src_low from packets),
keyed as (select *, case when src_low then src_ip else dst_ip end as lo_ip, case when src_low then dst_ip else src_ip end as hi_ip,
  case when src_low then src_port else dst_port end as lo_port, case when src_low then dst_port else src_port end as hi_port from ends),
directed as (select *, (src_ip = lo_ip and src_port = lo_port) as is_fwd from keyed)"""
KEY = "lo_ip, hi_ip, lo_port, hi_port, proto"


def sessions(timeout_us: int = 60_000_000, cap: int = 2000) -> str:
    return f"""{KEYED}, s1 as (select *, lag(ts_us) over w as prev_us, lag(flags) over w as prev_flags, lead(ts_us) over w as next_us from directed window w as (partition by {KEY} order by ts_us, pkt_seq)),
s2 as (select *, (sum(case when prev_us is null or ts_us - prev_us > {timeout_us} or regexp_matches(prev_flags, '[FR]') then 1 else 0 end) over (partition by {KEY} order by ts_us, pkt_seq rows between unbounded preceding and current row))::bigint as seg from s1),
s3 as (select *, row_number() over (partition by {KEY}, seg order by ts_us, pkt_seq) - 1 as place from s2),
sess as (select *, (place // {cap})::bigint as chunk, case when place % {cap} > 0 then ts_us - prev_us end as gap_us from s3)"""


SESSIONS = sessions()
_SPAN = "max(ts_us) {f} - min(ts_us) {f}"


def _mean(side: str) -> str:
    f = f"filter (where {side})" if side else ""
    n = f"count(*) {f}"
    return f"(case when {n} > 1 then ({_SPAN.format(f=f)}) / (({n} - 1) * 1e6) else 0.0 end)::double"


def aggregates() -> str:
    fwd, back = "filter (where is_fwd)", "filter (where not is_fwd)"
    total = lambda c, f: f"coalesce(sum({c}) {f}, 0)::double"
    n, nf, nb = "count(*)", f"count(*) {fwd}", f"count(*) {back}"
    values = {
        "duration": "greatest((max(ts_us) - min(ts_us)) / 1e6, 1e-6)::double",
        "packet_count": f"({n})::double",
        "byte_count": "sum(pkt_len)::double",
        "fwd_packet_count": f"({nf})::double",
        "bwd_packet_count": f"({nb})::double",
        "fwd_byte_count": total("pkt_len", fwd),
        "bwd_byte_count": total("pkt_len", back),
        "avg_packet_size": f"sum(pkt_len)::double / greatest({n}, 1)",
        "avg_fwd_packet_size": f"{total('pkt_len', fwd)} / greatest({nf}, 1)",
        "avg_bwd_packet_size": f"{total('pkt_len', back)} / greatest({nb}, 1)",
        "fwd_iat_mean": _mean("is_fwd"),
        "bwd_iat_mean": _mean("not is_fwd"),
        "flow_iat_mean": _mean(""),
        "flow_iat_std": "(case when count(gap_us) > 0 then sqrt((count(gap_us)::hugeint * sum(gap_us::hugeint * gap_us) - sum(gap_us)::hugeint * sum(gap_us)::hugeint)::double) / (count(gap_us) * 1e6) else 0.0 end)::double",
        "fwd_header_len": total("header_len", fwd),
        "bwd_header_len": total("header_len", back),
        **{f"{name}_flag_count": f"(count(*) filter (where contains(flags, '{c}')))::double" for c, name in (("S", "syn"), ("F", "fin"), ("R", "rst"), ("A", "ack"))},
    }
    return ", ".join(f"{values[f]} as {f}" for f in FEATURES)


def flows(timeout_us: int = 60_000_000, cap: int = 2000) -> str:
    return f"""{sessions(timeout_us, cap)}, every_flow as (select concat_ws('-', {KEY}) as flow_id, {KEY}, seg, chunk, min(ts_us) as start_us, max(ts_us) as end_us,
  case when regexp_matches(arg_max(flags, (ts_us, pkt_seq)), '[FR]') then 'fin_rst' when count(*) >= {cap} then 'cap' when count(*) filter (where next_us is null) = 0 then 'idle' else 'end' end as reason,
  {aggregates()} from sess group by {KEY}, seg, chunk),
flows as (select * from every_flow where packet_count >= 2)"""


FLOWS = flows()
CLOSE = "(case when reason in ('fin_rst', 'cap') then end_us else end_us + 60000000 end)"


def rnd(x: str, digits: int = 4) -> str:
    return f"floor({x} * {float(10**digits)}::double + 0.5::double) / {float(10**digits)}::double"


#: Flows' standardised and L2-normalised features, and their centroid and threshold.
SCALER = f"""{FLOWS}, scaler as (select {', '.join(f"avg({f}) as mean_{f}, case when stddev_pop({f}) = 0 then 1.0 else stddev_pop({f}) end as scale_{f}" for f in FEATURES)} from flows)"""
EMBEDDED = f"""{SCALER}, scaled as (select flows.*, [{', '.join(f'({f} - mean_{f}) / scale_{f}' for f in FEATURES)}]::double[] as z from flows, scaler),
embedded as (select *, list_transform(z, lambda x: x / greatest(sqrt(list_sum(list_transform(z, lambda y: y * y))), 1e-12)) as v from scaled),
center as (select [{', '.join(f'avg(v[{i + 1}])' for i in range(len(FEATURES)))}] as mu from embedded)"""
DISTANCE = "list_sum(list_transform(range(1, len({v}) + 1), lambda i: ({v}[i] - {mu}[i]) * ({v}[i] - {mu}[i])))"
SCORED = f"""{EMBEDDED}, distances as (select embedded.*, {DISTANCE.format(v='v', mu='mu')} as score from embedded, center),
delta as (select quantile_cont(score, 0.95) as delta from distances), scored as (select *, score > delta as is_anomaly from distances, delta)"""
