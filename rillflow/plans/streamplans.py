"""Queries that run the streaming jobs over a table's packets to the end, and return what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.packets import rounded
from rillflow.operators import decisions as dc
from rillflow.operators import flows as fl
from rillflow.operators import scoring as sc
from rillflow.plans.scoringplans import DIM, _flows, _predicted, _vectors
from rillflow.schema import FEATURES
from rillflow.sources import packets as src
from rillflow.sources.scratch import scratch_path, written
from rillflow.streaming import jobs
from rillflow.streaming.tracker import flows_of, track_in_order

FAR = 86_400_000_000


#: Rows of a span of time that a replay hands over at once, and the least number of spans.
SPAN_ROWS, SPANS = 5_000_000, 3
#: Packets of ``_shuffled`` arrive up to so much after their time.
JITTER_US = 300_000_000


def _files(spark: SparkSession) -> int:
    """Files of a span: as many as the session has cores to write and read them."""
    return spark.sparkContext.defaultParallelism


def _in_order(rows: DataFrame, at: str, path: str) -> None:
    """Write rows by spans of about ``SPAN_ROWS`` rows, in order of ``at`` and each in as many files as cores, as a live source would.

    Rows are dealt to their spans in one pass. The stream takes its files in the order in which they were written, so a
    trigger of ``_files`` files is a span.
    """
    spark = rows.sparkSession
    spans = max(SPANS, -(-rows.count() // SPAN_ROWS))
    cuts = rows.agg(F.percentile_approx(at, [i / spans for i in range(1, spans)], 100_000).alias("cuts")).first()["cuts"]
    if cuts is None:
        rows.write.parquet(path)
        return
    dealt = scratch_path(spark, "spans")
    rows.withColumn("span__", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(at)))).write.partitionBy("span__").parquet(dealt)
    for i in range(spans):
        span = spark.read.parquet(dealt).where(F.col("span__") == i).drop("span__")
        span.repartition(_files(spark)).write.mode("append").parquet(path)


def _last(packets: DataFrame, path: str, after_us: int = FAR) -> None:
    """A last packet a day later, which moves the watermark past all others."""
    last = packets.agg(F.max("ts_us").alias("ts_us"), F.max("pkt_seq").alias("pkt_seq")).where("ts_us is not null")
    end = last.select((F.col("pkt_seq") + 1).alias("pkt_seq"), (F.col("ts_us") + after_us).alias("ts_us"), F.lit("0.0.0.0").alias("src_ip"), F.lit("0.0.0.0").alias("dst_ip"), *[F.lit(0).alias(c) for c in ("src_port", "dst_port", "proto", "pkt_len", "header_len")], F.lit("").alias("flags"))
    src.with_timestamp(end).coalesce(1).write.mode("append").parquet(path)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The packets as a folder of files, and a last packet."""
    path = scratch_path(spark, "packet-stream")
    packets = src.packets_from_events(spark, sf_dir)
    _in_order(src.with_timestamp(packets).withColumn("us__", F.unix_micros("ts")), "us__", path)
    _last(packets, path)
    return path


def _shuffled(packets: DataFrame, path: str) -> None:
    """Packets in the order of their arrival, which is up to ``JITTER_US`` after their time."""
    rows = src.with_timestamp(packets).withColumn("us__", F.unix_micros("ts") + F.pmod(F.xxhash64("pkt_seq"), F.lit(JITTER_US)))
    _in_order(rows, "us__", path)


def _stream(spark, sf_dir):
    return src.read_stream(spark, _folder(spark, sf_dir), late="1 hour", files_per_trigger=_files(spark))


def stream_packets(spark, sf_dir):
    path = scratch_path(spark, "stream")
    jobs.to_files(_stream(spark, sf_dir).where("proto > 0"), path)
    return src.with_micros(spark.read.parquet(path))


def _tracked_flows(spark, path):
    got = flows_of(spark.read.parquet(path)).where("proto > 0").withColumn("flow_id", F.concat_ws("-", *fl.KEY))
    return got.select("flow_id", "start_us", "end_us", *FEATURES)


def stream_flows(spark, sf_dir):
    """Flows of packets that arrive out of order, up to five minutes late."""
    jobs.use_rocksdb(spark)
    folder, path = scratch_path(spark, "packet-stream"), scratch_path(spark, "stream")
    packets = src.packets_from_events(spark, sf_dir)
    _shuffled(packets, folder)
    _last(packets, folder)
    jobs.to_files(track_in_order(src.read_stream(spark, folder, late="10 minutes", files_per_trigger=_files(spark))), path)
    return _tracked_flows(spark, path)


def stream_resumed_flows(spark, sf_dir):
    """The same flows by a job that is stopped halfway, with flows open, and goes on from its checkpoint."""
    jobs.use_rocksdb(spark)
    folder, path = scratch_path(spark, "packet-stream"), scratch_path(spark, "stream")
    packets = src.packets_from_events(spark, sf_dir)
    middle = packets.agg(F.percentile_approx("ts_us", 0.5).alias("at")).first()["at"] or 0
    first = packets.where(F.col("ts_us") <= middle)
    for part in (first, packets.where(F.col("ts_us") > middle)):
        _shuffled(part, folder)
        if part is first:
            jobs.to_files(track_in_order(src.read_stream(spark, folder, late="10 minutes", files_per_trigger=_files(spark))), path)
    _last(packets, folder)
    jobs.to_files(track_in_order(src.read_stream(spark, folder, late="10 minutes", files_per_trigger=_files(spark))), path)
    return _tracked_flows(spark, path)


def stream_discards(spark, sf_dir):
    """What a stream leaves out and why: by the reports of all triggers, and flows that end with one packet.

    Every 97th packet comes a day late, after the first run has ended, and falls behind the watermark of the second.
    """
    jobs.use_rocksdb(spark)
    folder, path = scratch_path(spark, "packet-stream"), scratch_path(spark, "stream")
    packets = src.packets_from_events(spark, sf_dir)
    behind = F.col("pkt_seq") % 97 == 0

    def run():
        raw = src.read_stream(spark, folder, late="1 hour", files_per_trigger=_files(spark))
        odd = raw.withColumns({"ip_version": F.when(F.col("pkt_seq") % 11 == 0, 6).otherwise(4), "proto": F.when(F.col("pkt_seq") % 13 == 0, 1).otherwise(F.col("proto"))})
        # the last packet of a replay is of no protocol and moves the watermark as TCP
        odd = odd.withColumns({"proto": F.when(F.col("src_ip") == "0.0.0.0", 6).otherwise(F.col("proto")), "ip_version": F.when(F.col("src_ip") == "0.0.0.0", 4).otherwise(F.col("ip_version"))})
        return jobs.counted(track_in_order(jobs.transport_counted(odd), min_packets=1), path)

    _in_order(src.with_timestamp(packets.where(~behind)).withColumn("us__", F.unix_micros("ts")), "us__", folder)
    _last(packets, folder)
    sums = run()
    src.with_timestamp(packets.where(behind)).repartition(_files(spark)).write.mode("append").parquet(folder)
    sums += run()
    short = spark.read.parquet(path).where("lo_ip <> '0.0.0.0' and packet_count < 2").agg(F.lit("short_flows").alias("reason"), F.count("*").alias("n"))
    return spark.createDataFrame([(c, sums[c]) for c in ("not_ipv4", "other_protocol", jobs.BEHIND)], "reason string, n long").unionByName(short)


def stream_session_flows(spark, sf_dir):
    path = scratch_path(spark, "stream")
    jobs.to_files(jobs.session_flows(_stream(spark, sf_dir)), path)
    return spark.read.parquet(path).where("proto > 0")


def stream_summary(spark, sf_dir):
    """Two streams by minute: packets by their time, and scored flows by the time at which they were closed."""
    path = scratch_path(spark, "stream")
    jobs.to_files(jobs.summaries(_stream(spark, sf_dir)), path)
    packets = spark.read.parquet(path).where("bytes > 0")
    flows = _predicted(spark, sf_dir).select("close_us", "is_anomaly")
    folder, done = scratch_path(spark, "closed-flows"), scratch_path(spark, "stream")
    _in_order(flows, "close_us", folder)
    last = flows.agg(F.max("close_us").alias("close_us")).where("close_us is not null").select((F.col("close_us") + FAR).alias("close_us"), F.lit(None).cast("boolean").alias("is_anomaly"))
    last.coalesce(1).write.mode("append").parquet(folder)
    closed = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", _files(spark)).parquet(folder)
    jobs.to_files(jobs.closed_flows(closed), done)
    both = packets.join(spark.read.parquet(done), "window_start_us", "full")
    return both.select("window_start_us", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("packets", "bytes", "flows", "anomalies")])


def _score_stream(spark: SparkSession, sf_dir: str) -> str:
    flows = _flows(spark, sf_dir)
    scaler = written(sc.fit_scaler(flows), "scaler")
    vectors = sc.embedded(flows, scaler)
    mu = written(sc.centroid(vectors, len(FEATURES)), "centroid")
    base = scratch_path(spark, "base")
    mu.crossJoin(F.broadcast(sc.threshold(sc.scored(vectors, mu)))).write.parquet(base)
    folder = scratch_path(spark, "flow-stream")
    # two triggers
    flows.repartition(2 * _files(spark)).write.parquet(folder)
    path = scratch_path(spark, "scores")
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", _files(spark)).parquet(folder)
    jobs.score_batches(stream, scaler, spark.read.parquet(base), path)
    return path


def stream_scores(spark, sf_dir):
    got = spark.read.parquet(f"{_score_stream(spark, sf_dir)}/decisions")
    return got.select("flow_id", "seg", "chunk", rounded(F.col("score")).alias("score"), rounded(F.col("delta")).alias("delta"), F.col("is_anomaly").cast("int").alias("is_anomaly"))


def batch_sizes(spark, sf_dir):
    """How many batches the two triggers made, and of how many flows."""
    got = spark.read.parquet(f"{_score_stream(spark, sf_dir)}/metrics")
    return got.agg(F.count("*").alias("batches"), F.sum("n_rows").alias("n_rows"), F.avg("n_rows").alias("mean_size"))


def batch_metrics(spark, sf_dir):
    got = spark.read.parquet(f"{_score_stream(spark, sf_dir)}/metrics")
    return got.agg(F.count("*").alias("batches"), F.sum("n_rows").alias("n_rows"), F.avg("n_rows").alias("mean_size"), F.avg("duration_ms").alias("mean_ms"), F.percentile_approx("duration_ms", 0.95).alias("p95_ms"))


def stream_scored_windows(spark, sf_dir):
    """Packets out of order to flows, scores and counts per second and per minute, in one stream with bytes and time per trigger."""
    jobs.use_rocksdb(spark)
    flows = _flows(spark, sf_dir)
    scaler = written(sc.fit_scaler(flows), "scaler")
    vectors = sc.embedded(flows, scaler)
    mu = written(sc.centroid(vectors, len(FEATURES)), "centroid")
    base = written(mu.crossJoin(F.broadcast(sc.threshold(sc.scored(vectors, mu)))), "baseline")
    folder, path = scratch_path(spark, "packet-stream"), scratch_path(spark, "scored")
    packets = src.packets_from_events(spark, sf_dir)
    _shuffled(packets, folder)
    _last(packets, folder)
    stream = src.read_stream(spark, folder, late="10 minutes", bytes_per_trigger=64 << 20)
    jobs.score_flows(track_in_order(stream), scaler, base, path, every="1 second")
    return jobs.window_counts(spark, path)


def stream_adaptive(spark, sf_dir):
    """Five runs of one job, each over the next fifth of the vectors, from the checkpoint of the one before."""
    v = _vectors(spark, sf_dir)
    folder, path = scratch_path(spark, "vector-stream"), scratch_path(spark, "adaptive")
    last = v.agg(F.max("vec_id").alias("last")).first()["last"] or 0
    mu = sc.centroid(v, DIM)
    first = mu.crossJoin(F.broadcast(sc.threshold(sc.scored(v, mu))))
    for i in range(5):
        v.where(F.floor(F.col("vec_id") * 5 / (last + 1)) == i).repartition(_files(spark)).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1_000_000).parquet(folder)
        jobs.adapt_batches(stream, first, path, DIM)
    size = F.aggregate("mu", F.lit(0.0), lambda a, x: a + x * x)
    return jobs.versions(spark, path).select("version", "n_used", rounded(F.col("delta"), 6).alias("delta"), rounded(size, 6).alias("mu_norm2"))


def stream_alerts(spark, sf_dir):
    folder, path = scratch_path(spark, "decisions"), scratch_path(spark, "alerts")
    dc.write_decisions(dc.decision_records(_predicted(spark, sf_dir)), folder)
    jobs.to_files(jobs.alerts(spark, folder), path)
    return spark.read.parquet(path).select("flow_id", "hi_ip", "hi_port", rounded(F.col("score")).alias("score"))


_ALL = (stream_packets, stream_flows, stream_resumed_flows, stream_discards, stream_session_flows, stream_summary, stream_scores, batch_sizes, batch_metrics, stream_scored_windows, stream_adaptive, stream_alerts)
QUERIES = {f.__name__: f for f in _ALL}


def _sql() -> dict[str, str]:
    from rillflow.plans import packetplans, scoringplans
    from rillflow.plans import sqltext as s

    return {
        "stream_packets": packetplans.SQL["read_packets"],
        "stream_flows": f"{s.FLOWS} select flow_id, start_us, end_us, {', '.join(FEATURES)} from flows",
        "stream_resumed_flows": f"{s.FLOWS} select flow_id, start_us, end_us, {', '.join(FEATURES)} from flows",
        "stream_discards": s.FLOWS.replace("packets as (select * from raw)", "packets as (select * from raw where pkt_seq % 11 <> 0 and pkt_seq % 13 <> 0 and pkt_seq % 97 <> 0)") + """, v as (select pkt_seq % 11 = 0 as six, pkt_seq % 13 = 0 as other, pkt_seq % 97 = 0 as behind from raw)
select 'not_ipv4' as reason, count(*) filter (where six) as n from v union all select 'other_protocol', count(*) filter (where not six and other) from v union all select 'behind_watermark', count(*) filter (where not six and not other and behind) from v
  union all select 'short_flows', count(*) filter (where packet_count < 2) from every_flow""",
        "stream_session_flows": packetplans.SQL["flows_idle_timeout"],
        "stream_summary": f"{s.SCORED}, p as (select (ts_us // 60000000 * 60000000)::bigint as window_start_us, count(*) as packets, sum(pkt_len)::bigint as bytes from packets group by 1), f as (select ({s.CLOSE} // 60000000 * 60000000)::bigint as window_start_us, count(*) as flows, count(*) filter (where is_anomaly) as anomalies from scored group by 1) select window_start_us, coalesce(packets, 0) as packets, coalesce(bytes, 0) as bytes, coalesce(flows, 0) as flows, coalesce(anomalies, 0) as anomalies from p full join f using (window_start_us)",
        "batch_sizes": f"{s.FLOWS} select 2::bigint as batches, count(*) as n_rows, count(*) / 2.0::double as mean_size from flows",
        "stream_scores": scoringplans.SQL["predict_batch"],
        "stream_scored_windows": f"{s.SCORED}, w as (select {s.CLOSE} as close_us, is_anomaly, unnest([1000000, 60000000])::bigint as width from scored) select width, (close_us // width * width)::bigint as window_start_us, count(*) as flows, count(*) filter (where is_anomaly) as anomalies from w group by all",
        "stream_adaptive": scoringplans.replayed(scoringplans.EMB + ", one as (select *, 0 as sensor, (vec_id * 5 // (select max(vec_id) + 1 from vecs))::bigint as fifth from vecs)", "one", "select 0 as sensor, mu, delta from center, t", "sensor", "fifth", DIM, 0.99, 0.97, f"step as version, used as n_used, {s.rnd('delta', 6)} as delta, {s.rnd('list_sum(list_transform(mu, lambda x: x * x))', 6)} as mu_norm2"),
        "stream_alerts": f"{s.SCORED} select flow_id, hi_ip, hi_port::varchar as hi_port, {s.rnd(s.rnd('score', 6))} as score from scored where is_anomaly",
    }


SQL = _sql()
