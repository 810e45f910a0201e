"""Calibration over periods of time: a flow store by day and hour, and sketches of scores by the minute.

The store answers for any period from the folders of its hours. The sketches answer for the threshold of any period from one small
row per minute, without the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.rollups import MINUTE, bucket
from rillflow.operators.scoring import centroid, embedded, scored, threshold
from rillflow.schema import FEATURES
from rillflow.sources.scratch import written

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: The period, and the percentile of its scores, that a recalibration takes.
PERIOD_US, PERCENTILE = 300_000_000, 0.99
#: Files for each hour, so that a busy hour has more than one writer.
WRITERS = 8
#: Size of a quantile sketch; ranks are off by about 0.3 % at this size.
SKETCH = 1000


def _day(us: Column) -> Column:
    return F.floor(us / DAY_US).cast("int")


def _hour(us: Column) -> Column:
    return F.pmod(F.floor(us / HOUR_US), F.lit(24)).cast("int")


def write_flow_store(flows: DataFrame, path: str, time: str = "close_us") -> None:
    """Append flows in folders by day (since 1970) and hour of their closing. Flows without that time have a folder of their own."""
    rows = flows.withColumns({"day": _day(F.col(time)), "hour": _hour(F.col(time))})
    dealt = F.pmod(F.xxhash64("flow_id", "start_us"), F.lit(WRITERS))
    rows.repartition("day", "hour", dealt).write.mode("append").partitionBy("day", "hour").parquet(path)


def read_period(spark: SparkSession, path: str, start_us: int, end_us: int, time: str = "close_us") -> DataFrame:
    """The stored flows of a period (its end excluded); only folders of its hours are read."""
    first, last = (start_us // DAY_US, start_us // HOUR_US % 24), ((end_us - 1) // DAY_US, (end_us - 1) // HOUR_US % 24)
    day, hour = F.col("day"), F.col("hour")
    folders = day.between(first[0], last[0]) & ((day > first[0]) | (hour >= first[1])) & ((day < last[0]) | (hour <= last[1]))
    return spark.read.parquet(path).where(folders & (F.col(time) >= start_us) & (F.col(time) < end_us)).drop("day", "hour")


def recalibrated_from(spark: SparkSession, store: str, scaler: DataFrame, start_us: int, duration_us: int = PERIOD_US, p: float = PERCENTILE, exact: bool = True) -> DataFrame:
    """One row (n_flows, mu, delta) from a period of the store; mu and delta are null if it has no flows."""
    vectors = written(embedded(read_period(spark, store, start_us, start_us + duration_us), scaler).select("v"), "period")
    mu = written(centroid(vectors, len(FEATURES)), "centroid")
    delta = threshold(scored(vectors, mu), p, exact)
    return vectors.agg(F.count("*").alias("n_flows")).crossJoin(F.broadcast(mu)).crossJoin(F.broadcast(delta)).select("n_flows", F.when(F.col("n_flows") > 0, F.col("mu")).alias("mu"), "delta")


def score_sketches(scores: DataFrame, time: str = "close_us", by: tuple[str, ...] = (), width: int = MINUTE, size: int = SKETCH) -> DataFrame:
    """(``by``, minute_us, n, sketch): a quantile sketch of each minute's scores; rows without a time or a score are in none."""
    rows = scores.where(F.col(time).isNotNull() & F.col("score").isNotNull())
    return rows.groupBy(*by, bucket(F.col(time), width).alias("minute_us")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("score", size).alias("sketch"))


def merged(sketches: DataFrame, by: list[Column], size: int = SKETCH) -> DataFrame:
    """Sketches of longer periods from those of minutes: (``by``, n, sketch)."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def period_threshold(sketches: DataFrame, start_us: int, end_us: int, p: float = PERCENTILE, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, n, delta): the percentile of the scores of whole minutes from ``start_us`` on and before ``end_us``."""
    rows = sketches.where((F.col("minute_us") >= start_us) & (F.col("minute_us") < end_us))
    found = merged(rows, [F.col(c) for c in by]) if by else merged(rows, [F.lit(0).alias("all__")]).drop("all__")
    return found.select(*by, "n", F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("delta"))
