"""Baselines: versions of the normal centroid and its threshold, and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rillflow.functions.vectors import all_close, blended, mean_by_position, norm, squared_distance
from rillflow.operators.replay import replay as replay_by_sensor
from rillflow.operators.scoring import centroid, clearly_normal, scored, threshold
from rillflow.schema import FEATURES


def load_baseline(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """The newest version of a baseline table, as one row; fails if there is none or its length isn't ``dim``."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as problem:
        raise FileNotFoundError(f"no baseline table at {path}") from problem
    newest = table.orderBy(F.col("version").desc()).limit(1)
    found = newest.select(F.size("mu").alias("n")).first()
    if found is None or found["n"] != dim:
        raise ValueError(f"the baseline at {path} has {found and found['n']} numbers, not {dim}")
    return newest


def save_model(scaler: DataFrame, versions: DataFrame, folder: str, input_dim: int, embed_dim: int) -> None:
    """Write a model's tables under ``folder``: the scaler (feature, mean, scale), its baselines, and its dimensions."""
    scaler.write.parquet(f"{folder}/scaler")
    versions.write.parquet(f"{folder}/baseline")
    scaler.sparkSession.range(1).select(F.lit(input_dim).alias("input_dim"), F.lit(embed_dim).alias("embed_dim")).write.json(f"{folder}/config")


def load_model(spark: SparkSession, folder: str, names: list[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """The scaler and the newest baseline of a model folder.

    Fails if one of its tables is missing, if the scaler isn't for ``names``, or if lengths differ from the configuration's.
    """
    try:
        config = spark.read.schema("input_dim int, embed_dim int").json(f"{folder}/config").first()
        scaler = spark.read.parquet(f"{folder}/scaler")
    except AnalysisException as problem:
        raise FileNotFoundError(f"no whole model at {folder}") from problem
    found = {r["feature"] for r in scaler.select("feature").limit(10 * len(names)).collect()}
    if config is None or config["input_dim"] != len(names) or found != {*names}:
        raise ValueError(f"the scaler at {folder} is for {sorted(found)}, the configuration is {config}")
    return scaler, load_baseline(spark, f"{folder}/baseline", config["embed_dim"])


def with_validity(versions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Append-only versions with valid_to, the next one's valid_from. Versions are few, one per update."""
    return versions.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("version")))


def with_drift(versions: DataFrame) -> DataFrame:
    """Versions with drift, the distance to the centroid before; 0 for the first."""
    before = F.lag("mu").over(W.partitionBy(F.lit(0)).orderBy("version"))
    return versions.withColumn("before__", before).withColumn("drift", F.when(F.col("before__").isNull(), 0.0).otherwise(norm(F.zip_with("mu", "before__", lambda a, b: a - b)))).drop("before__")


def updated(classified: DataFrame, baseline: DataFrame, dim: int, alpha: float | None = None, ratio: float = 0.5) -> DataFrame:
    """One row (mu, n_used) after the clearly normal vectors: their mean, or its blend with weight 1 - alpha.

    Without any the baseline stays.
    """
    normal = classified.where(clearly_normal(ratio)).agg(mean_by_position(F.col("v"), dim).alias("new__"), F.count("*").alias("n_used"))
    both = normal.crossJoin(F.broadcast(baseline.select("mu")))
    mu = F.col("new__") if alpha is None else blended(F.col("mu"), F.col("new__"), alpha)
    return both.select(F.when(F.col("n_used") > 0, mu).otherwise(F.col("mu")).alias("mu"), "n_used")


def recalibrated(vectors: DataFrame, dim: int, p: float = 0.99) -> DataFrame:
    """One row (mu, delta) from a quiet period's vectors."""
    mu = centroid(vectors, dim)
    return mu.crossJoin(F.broadcast(threshold(scored(vectors, mu), p)))


def validated(old: DataFrame, new: DataFrame, low: float, high: float) -> DataFrame:
    """One row: the new delta, whether it lies in range, whether mu changed, and whether both hold."""
    both = old.select(F.col("mu").alias("old__")).crossJoin(F.broadcast(new.select("mu", "delta")))
    checks = both.select("delta", F.col("delta").between(low, high).alias("in_range"), (~all_close(F.col("old__"), F.col("mu"))).alias("changed"))
    return checks.withColumn("valid", F.col("in_range") & F.col("changed"))


#: Windows that are folded before their end is written.
SPAN = 100


def replay(vectors: DataFrame, start: list[float], delta: float, width: int, alpha: float | None = None, ratio: float = 0.5) -> list[tuple]:
    """The rows of ``replay_versions`` in order, for few windows."""
    return [tuple(r) for r in replay_versions(vectors, start, delta, width, alpha, ratio).orderBy("step").collect()]


def replay_versions(vectors: DataFrame, start: list[float], delta: float, width: int, alpha: float | None = None, ratio: float = 0.5, span: int = SPAN) -> DataFrame:
    """The update loop of one baseline: (step, flows, anomalies, used, drift, mu) of each window that has rows of (at, v)."""
    base = vectors.sparkSession.createDataFrame([(list(start), float(delta))], "mu array<double>, delta double")
    return replay_by_sensor(vectors, base, width, (), alpha, ratio, span=span)
