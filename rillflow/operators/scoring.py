"""Standardise, embed, score and classify flows against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.vectors import l2_normalized, mean_by_position, squared_distance
from rillflow.operators.asof import as_of
from rillflow.schema import FEATURES
from rillflow.sources.scratch import written


def fit_scaler(flows: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """One row: mean_<f> and scale_<f> of each feature; a constant feature has scale 1."""
    return flows.agg(*[F.avg(f).alias(f"mean_{f}") for f in names], *[F.when(F.stddev_pop(f) == 0, 1.0).otherwise(F.stddev_pop(f)).alias(f"scale_{f}") for f in names])


def scaler_rows(scaler: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """The scaler as (feature, mean, scale) rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"), F.col(f"scale_{f}").alias("scale")) for f in names])
    return scaler.select(F.inline(pairs))


def scaled(flows: DataFrame, scaler: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """``flows`` with z, the standardised features in order. The scaler is one row."""
    z = F.array(*[(F.col(f) - F.col(f"mean_{f}")) / F.col(f"scale_{f}") for f in names])
    return flows.crossJoin(F.broadcast(scaler)).withColumn("z", z).select(*flows.columns, "z")


def assembled(names: Sequence[str] = FEATURES) -> Column:
    """The model's input: features in order, single precision."""
    return F.array(*[F.col(f).cast("float") for f in names])


def embedded(flows: DataFrame, scaler: DataFrame) -> DataFrame:
    """``flows`` with v, the identity encoder's embedding: standardised, then of length 1."""
    return scaled(flows, scaler).withColumn("v", l2_normalized(F.col("z"))).drop("z")


def centroid(vectors: DataFrame, dim: int, column: str = "v") -> DataFrame:
    """One row: mu, by ``dim`` partial averages."""
    return vectors.agg(mean_by_position(F.col(column), dim).alias("mu"))


def scored(vectors: DataFrame, baseline: DataFrame, column: str = "v") -> DataFrame:
    """``vectors`` with score, the squared distance to the baseline's mu. The baseline is one row."""
    joined = vectors.crossJoin(F.broadcast(baseline))
    return joined.withColumn("score", squared_distance(F.col(column), F.col("mu"))).drop("mu")


def threshold(scores: DataFrame, p: float = 0.95, exact: bool = True) -> DataFrame:
    """One row: delta, the percentile of score. The approximate form takes bounded memory at any size."""
    return scores.agg((F.percentile("score", p) if exact else F.percentile_approx("score", p, 10000)).alias("delta"))


def classified(scores: DataFrame, delta: DataFrame, kappa: float = 1.0) -> DataFrame:
    """With delta (times kappa) and is_anomaly: strictly above it."""
    joined = scores.crossJoin(F.broadcast(delta)).withColumn("delta", F.col("delta") * kappa)
    return joined.withColumn("is_anomaly", F.col("score") > F.col("delta"))


def clearly_normal(ratio: float = 0.5) -> Column:
    return ~F.col("is_anomaly") & (F.col("score") < ratio * F.col("delta"))


def score_as_of(vectors: DataFrame, versions: DataFrame, time: str = "at", by: tuple[str, ...] = ()) -> DataFrame:
    """Each vector against the version (of its ``by``) that was in force at its time; see ``as_of``."""
    joined = as_of(vectors, versions.select(*by, "version", "valid_from", "mu"), time, by)
    return joined.withColumn("score", squared_distance(F.col("v"), F.col("mu"))).drop("mu")


def predict(flows: DataFrame, p: float = 0.95, kappa: float = 1.0, exact: bool = True) -> DataFrame:
    """The whole chain with the identity encoder, fitted on the flows themselves: v, score, delta, is_anomaly.

    The fits (a row each) and the scored flows are written as they are made, so that flows are read once for each of them
    and none is computed again by what follows. With ``exact`` false the threshold takes bounded memory at any size.
    """
    vectors = embedded(flows, written(fit_scaler(flows), "scaler"))
    scores = written(scored(vectors, written(centroid(vectors, len(FEATURES)), "centroid")), "scores")
    return classified(scores, threshold(scores, p, exact), kappa)
