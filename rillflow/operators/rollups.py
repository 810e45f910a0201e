"""Counts over time. Ordered windows run over time buckets, never over packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.sources.scratch import written

MINUTE = 60_000_000
DAY = 1440 * MINUTE


def bucket(us: Column, width: int) -> Column:
    return F.floor(us / width).cast("long") * width


def throughput(packets: DataFrame, flows: DataFrame, width: int = 1_000_000, drops: DataFrame | None = None) -> DataFrame:
    """(bucket_us, packets, opened, flows, anomalies, dropped): packets and ``drops`` (ts_us, n) by their time, flows by their opening and by their close."""
    anomaly = F.count_if("is_anomaly") if "is_anomaly" in flows.columns else F.lit(0).cast("long")
    parts = [
        (packets, "ts_us", {"packets": F.count("*")}),
        (flows, "start_us", {"opened": F.count("*")}),
        (flows, "close_us", {"flows": F.count("*"), "anomalies": anomaly}),
    ]
    parts += [(drops, "ts_us", {"dropped": F.sum("n").cast("long")})] if drops is not None else []
    names = ("packets", "opened", "flows", "anomalies", "dropped")
    each = [rows.groupBy(bucket(F.col(at), width).alias("bucket_us")).agg(*[got.get(n, F.lit(0).cast("long")).alias(n) for n in names]) for rows, at, got in parts]
    return reduce(DataFrame.unionByName, each).groupBy("bucket_us").agg(*[F.sum(n).alias(n) for n in names])


def dense(per_bucket: DataFrame, width: int) -> DataFrame:
    """``per_bucket`` with a row for every bucket between its first and its last; counts of the added ones are 0.

    The buckets are made by day, so that a long time is spread over tasks.
    """
    ends = per_bucket.agg(F.min("bucket_us").alias("lo"), F.max("bucket_us").alias("hi")).where("lo is not null")
    days = ends.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / DAY), F.floor(F.col("hi") / DAY))).alias("day")).repartition("day")
    begins = lambda day: F.ceil(day * DAY / width).cast("long") * width
    days = days.select(F.greatest("lo", begins(F.col("day"))).alias("a"), F.least("hi", begins(F.col("day") + 1) - width).alias("b")).where("a <= b")
    every = days.select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bucket_us"))
    counts = [c for c in per_bucket.columns if c != "bucket_us"]
    return every.join(per_bucket, "bucket_us", "left").select("bucket_us", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def summary(packets: DataFrame, flows: DataFrame, width: int = MINUTE, drops: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
    """Every window from the first event to the last, silent ones too: packets, flows closed in it, anomalies among them, drops, rates, flows open at its end.

    With ``batches`` (at_us, n_rows, duration_ms) also their number, mean size and mean time in the window (null without any).
    """
    seconds = width / 1e6
    per = dense(written(throughput(packets, flows, width, drops), "per-window"), width).withColumn("change", F.col("opened") - F.col("flows"))
    got = cumulative(per, "change").select(
        F.col("bucket_us").alias("window_start_us"),
        (F.col("bucket_us") + width).alias("window_end_us"),
        F.col("packets").alias("packets_total"),
        F.col("flows").alias("flows_closed"),
        (F.col("packets") / seconds).alias("packets_per_sec"),
        (F.col("flows") / seconds).alias("flows_per_sec"),
        F.col("anomalies").alias("anomaly_count"),
        (F.col("anomalies") / F.greatest("flows", F.lit(1))).alias("anomaly_rate"),
        F.col("total_change").alias("active_flows"),
        F.col("dropped"),
    )
    if batches is None:
        return got
    of = batches.groupBy(bucket(F.col("at_us"), width).alias("window_start_us")).agg(F.count("*").alias("n_batches"), F.avg("n_rows").alias("avg_batch_size"), F.avg("duration_ms").alias("avg_latency_ms"))
    return got.join(of, "window_start_us", "left").withColumn("n_batches", F.coalesce("n_batches", F.lit(0)))


def cumulative(per_bucket: DataFrame, *columns: str) -> DataFrame:
    """``per_bucket`` with running totals total_<c> over bucket_us: first inside each of many spans, then over span sums."""
    span = F.floor(F.col("bucket_us") / DAY)
    inside = W.partitionBy("span__").orderBy("bucket_us").rowsBetween(W.unboundedPreceding, 0)
    rows = per_bucket.withColumn("span__", span)
    spans = rows.groupBy("span__").agg(*[F.sum(c).alias(f"sum__{c}") for c in columns])
    before = W.partitionBy(F.lit(0)).orderBy("span__").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.select("span__", *[F.coalesce(F.sum(f"sum__{c}").over(before), F.lit(0)).alias(f"before__{c}") for c in columns])
    joined = rows.join(offsets, "span__")
    return joined.select(*per_bucket.columns, *[(F.col(f"before__{c}") + F.sum(c).over(inside)).alias(f"total_{c}") for c in columns])


def active_flows(flows: DataFrame, width: int = MINUTE) -> DataFrame:
    """Flows open at the end of every bucket from the first opening to the last close: opened at the first packet, closed at close_us."""
    opens = flows.select(bucket(F.col("start_us"), width).alias("bucket_us"), F.lit(1).alias("change"))
    closes = flows.select(bucket(F.col("close_us"), width).alias("bucket_us"), F.lit(-1).alias("change"))
    per = opens.unionByName(closes).groupBy("bucket_us").agg(F.sum("change").alias("change"))
    return cumulative(dense(written(per, "changes"), width), "change").select("bucket_us", F.col("total_change").alias("active"))


def last_n(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The ``n`` last rows, of all or of each key."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("place__", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place__") <= n).drop("place__")
