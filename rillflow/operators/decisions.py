"""Decision records, their features that stand out, and what reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.packets import part_of_flow_id, rounded
from rillflow.schema import DECISION, FEATURES, STATE


def top_n(values: Sequence[Column], names: Sequence[str] = FEATURES, n: int = 5) -> Column:
    """Array of (name, value) of the ``n`` greatest by size; ties keep the features' order."""
    each = F.array(*[F.struct(F.abs(v).alias("size"), F.lit(-i).alias("place"), F.lit(f).alias("name"), v.alias("value")) for i, (f, v) in enumerate(zip(names, values, strict=True))])
    return F.transform(F.slice(F.sort_array(each, asc=False), 1, n), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))


def top_features(n: int = 5) -> Column:
    return top_n([F.col(f) for f in FEATURES], FEATURES, n)


def decision_records(predicted: DataFrame) -> DataFrame:
    """Records as the log holds them; duration is the plain span, not the feature."""
    return predicted.select(
        (F.col("end_us") / 1e6).alias("ts"),
        "flow_id",
        rounded(F.col("score"), 6).alias("score"),
        rounded(F.col("delta"), 6).alias("delta_effective"),
        "is_anomaly",
        F.col("packet_count").cast("long").alias("packet_count"),
        rounded((F.col("end_us") - F.col("start_us")) / 1e6, 4).alias("duration_s"),
        F.map_from_entries(top_features()).alias("top_features"),
    )


def write_decisions(records: DataFrame, path: str) -> None:
    """Append records as JSON Lines."""
    records.write.mode("append").json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Records of a decision log; lines that aren't whole JSON objects are left out."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", DECISION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").alias("j")).where("j is not null and r is not null").select("r.*")


def write_summary(summary: DataFrame, path: str) -> None:
    """Replace the summary; it is a single file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def anomalies(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce("is_anomaly", F.lit(False)))


def alert_rows(records: DataFrame) -> DataFrame:
    """Local time, high endpoint, score and id of each anomaly."""
    return anomalies(records).select(
        F.date_format(F.timestamp_seconds("ts"), "HH:mm:ss").alias("at"), part_of_flow_id(F.col("flow_id"), 1).alias("hi_ip"), part_of_flow_id(F.col("flow_id"), 3).alias("hi_port"), F.col("score"), "flow_id"
    )


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A pipeline state document's parallel arrays as rows (pos, score, is_anomaly, at)."""
    state = spark.read.schema(STATE).option("multiLine", True).json(path)
    return state.select(F.posexplode(F.arrays_zip("scores", "is_anomaly", "timestamps"))).select("pos", F.col("col.scores").alias("score"), F.col("col.is_anomaly").alias("is_anomaly"), F.col("col.timestamps").alias("at"))
