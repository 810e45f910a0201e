"""Streaming jobs: summaries, sessions, scoring in micro-batches, adaptive baselines, alerts."""

from __future__ import annotations

import threading
import time
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rillflow.operators import baseline as bl
from rillflow.operators import scoring as sc
from rillflow.operators.decisions import anomalies, decision_records
from rillflow.operators.encoders import Network, encode_mlp
from rillflow.operators.flows import KEY, close_us, keyed
from rillflow.functions.packets import flow_id, part_of_flow_id
from rillflow.schema import DECISION
from rillflow.sources.packets import transport_only
from rillflow.sources.scratch import exists, remove, written

BEHIND = "behind_watermark"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk with incremental checkpoints; the flow tracker needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Totals(StreamingQueryListener):
    """What all triggers of a query report, added up: rows behind the watermark, and the whole numbers that ``observe`` counts.

    A query keeps only its last reports; a listener gets every one, and the end of the query after the last.
    """

    def __init__(self) -> None:
        self.sums: dict[str, Counter] = {}
        self.ended: dict[str, threading.Event] = {}

    def _of(self, run: object) -> tuple[Counter, threading.Event]:
        return self.sums.setdefault(str(run), Counter()), self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._of(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        sums, _ = self._of(event.progress.runId)
        sums["triggers"] += 1
        sums[BEHIND] += sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        for row in event.progress.observedMetrics.values():
            sums.update({k: v for k, v in row.asDict().items() if isinstance(v, int)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._of(event.runId)[1].set()

    def of(self, run: object, seconds: float = 60) -> Counter:
        """The sums of a query that has ended."""
        sums, ended = self._of(run)
        if not ended.wait(seconds):
            raise TimeoutError(f"the end of query {run} was not reported")
        return sums


def counted(stream: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", checkpoint: str | None = None) -> Counter:
    """Run over all that is there, into files, and end: what its triggers counted, ``BEHIND`` among them.

    With the same ``checkpoint`` (by default beside ``path``) a later run goes on where this one stopped.
    """
    spark, totals = stream.sparkSession, Totals()
    spark.streams.addListener(totals)
    try:
        query = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start(path)
        query.awaitTermination()
        return totals.of(query.runId)
    finally:
        spark.streams.removeListener(totals)


def to_files(stream: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> int:
    """Run over all that is there, into files, and end: how many rows came behind the watermark."""
    return counted(stream, path, fmt, mode)[BEHIND]


def transport_counted(raw: DataFrame) -> DataFrame:
    """``transport_only`` of a stream of frames' headers; each trigger reports what is left out and why."""
    other = (F.col("ip_version") == 4) & ~F.col("proto").isin(6, 17)
    return transport_only(raw.observe("left_out", F.count_if(F.coalesce(F.col("ip_version") != 4, F.lit(True))).alias("not_ipv4"), F.count_if(F.coalesce(other, F.col("ip_version") == 4)).alias("other_protocol")))


def session_flows(packets: DataFrame, gap: str = "60 seconds 1 microsecond") -> DataFrame:
    """Idle-only flows by session windows, without Python state."""
    rows = keyed(packets.withColumn("ts_us", F.unix_micros("ts")))
    got = rows.groupBy(*KEY, F.session_window("ts", gap)).agg(F.count("*").alias("packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return got.select(*KEY, "packets", "start_us", "end_us")


def summaries(packets: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Packets and bytes of each window, once it is over."""
    return packets.groupBy(F.window("ts", width)).agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes")).select(F.unix_micros("window.start").alias("window_start_us"), "packets", "bytes")


def closed_flows(flows: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Flows and anomalies of each window, by the time of closing: (window_start_us, flows, anomalies), once it is over."""
    rows = flows.withColumn("closed", F.timestamp_micros("close_us")).withWatermark("closed", "1 hour")
    got = rows.groupBy(F.window("closed", width)).agg(F.count("*").alias("flows"), F.count_if("is_anomaly").alias("anomalies"))
    return got.select(F.unix_micros("window.start").alias("window_start_us"), "flows", "anomalies")


def score_batches(flows: DataFrame, scaler: DataFrame, base: DataFrame, path: str) -> None:
    """Score each micro-batch of flows against a baseline; decisions and batch metrics are appended under ``path``.

    Files of a batch that is run again replace themselves, because they lie in a folder of its number.
    """

    def one(batch: DataFrame, number: int) -> None:
        begun = time.time()
        scored = sc.classified(sc.scored(sc.embedded(batch, scaler), base.select("mu")), base.select("delta"))
        out = f"{path}/decisions/batch={number}"
        scored.drop("v").write.mode("overwrite").parquet(out)
        n = batch.sparkSession.read.parquet(out).count()
        metrics = batch.sparkSession.createDataFrame([(number, n, (time.time() - begun) * 1000)], "batch_id long, n_rows long, duration_ms double")
        metrics.write.mode("overwrite").parquet(f"{path}/metrics/batch={number}")

    flows.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def score_flows(tracked: DataFrame, scaler: DataFrame, base: DataFrame, path: str, encoder: Network | None = None, widths: tuple[int, ...] = (1_000_000, 60_000_000), every: str | None = None) -> None:
    """From tracked flows to decisions and counts per window, in one query over all that is there.

    Each trigger's flows are standardised, encoded (or only brought to length 1), classified against ``base`` (mu, delta) and
    appended under ``path``/decisions, and as JSON Lines with the features that stand out under ``path``/records; their numbers
    per window of closing go to ``path``/counts, to be added up by ``window_counts``. A trigger that is run again replaces its
    own folders. With ``every`` a trigger starts by the clock.
    """

    def one(batch: DataFrame, number: int) -> None:
        flows = batch.withColumn("close_us", close_us())
        vectors = sc.embedded(flows, scaler) if encoder is None else encode_mlp(sc.scaled(flows, scaler), encoder).withColumn("v", F.col("v").cast("array<double>")).drop("z")
        out = f"{path}/decisions/batch={number}"
        sc.classified(sc.scored(vectors, base.select("mu")), base.select("delta")).drop("v").write.mode("overwrite").parquet(out)
        done = batch.sparkSession.read.parquet(out)
        decision_records(done.withColumn("flow_id", flow_id())).write.mode("overwrite").json(f"{path}/records/batch={number}")
        each = done.select("close_us", "is_anomaly", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])).alias("width"))
        counts = each.groupBy("width", F.expr("(close_us div width - if(close_us % width < 0, 1, 0)) * width").alias("window_start_us")).agg(F.count("*").alias("flows"), F.count_if("is_anomaly").alias("anomalies"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    writer = tracked.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint")
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.trigger(processingTime=every).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """(width, window_start_us, flows, anomalies) of all triggers of ``score_flows``."""
    rows = spark.read.schema("width long, window_start_us long, flows long, anomalies long").parquet(f"{path}/counts")
    return rows.groupBy("width", "window_start_us").agg(F.sum("flows").alias("flows"), F.sum("anomalies").alias("anomalies"))


VERSION = "version long, mu array<double>, delta double, n_used long"
#: Versions of a baseline that share a segment of its log.
SEGMENT = 100


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions in the log of ``adapt_batches``."""
    parts = [spark.read.schema(VERSION).parquet(f"{path}/{kind}/*") for kind in ("versions", "segments") if exists(spark, f"{path}/{kind}")]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["version"])


def _compact(spark: SparkSession, path: str, number: int, segment: int) -> None:
    """Put the versions of the segment before the last into one folder; those that a running batch may need stay as they are."""
    k = number // segment - 2
    if number % segment or k < 0:
        return
    single = [f"{path}/versions/{i}" for i in range(k * segment, (k + 1) * segment)]
    if not exists(spark, f"{path}/segments/{k}/_SUCCESS"):
        spark.read.schema(VERSION).parquet(*single).coalesce(1).write.mode("overwrite").parquet(f"{path}/segments/{k}")
    for folder in single:
        remove(spark, folder)


def adapt_batches(vectors: DataFrame, first: DataFrame, path: str, dim: int, alpha: float = 0.99, ratio: float = 0.97, segment: int = SEGMENT) -> None:
    """Score each micro-batch against the newest baseline, then append the next version; a repeated batch changes nothing.

    Batch n makes version n from version n - 1, which is found by its number: no batch lists or reads older versions. They
    are gathered in segments as the log grows.
    """
    spark = vectors.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        before = f"{path}/versions/{number - 1}"
        if number and not exists(spark, f"{before}/_SUCCESS"):
            raise FileNotFoundError(f"version {number - 1} of the baseline at {path} is missing")
        base = written((spark.read.schema(VERSION).parquet(before) if number else first).select("mu", "delta"), "baseline")
        scored = sc.classified(sc.scored(batch, base.select("mu")), base.select("delta"))
        out = f"{path}/scores/batch={number}"
        scored.write.mode("overwrite").parquet(out)
        new = bl.updated(spark.read.parquet(out), base, dim, alpha, ratio).crossJoin(F.broadcast(base.select("delta")))
        new.select(F.lit(number).cast("long").alias("version"), "mu", "delta", "n_used").write.mode("overwrite").parquet(f"{path}/versions/{number}")
        _compact(spark, path, number, segment)

    vectors.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def alerts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Anomalies of the decision files that appear in a folder; with ``since`` (a timestamp) only of files written from then on."""
    records = spark.readStream.schema(DECISION).option("mode", "DROPMALFORMED").json(path)
    if since is not None:
        records = records.where(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
    return anomalies(records).select("ts", "flow_id", part_of_flow_id(F.col("flow_id"), 1).alias("hi_ip"), part_of_flow_id(F.col("flow_id"), 3).alias("hi_port"), "score")
