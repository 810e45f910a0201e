"""The update loop over past vectors: each sensor's windows of time, in order, against a baseline that every window changes.

A window's scores depend on the update before it, so a sensor's windows follow one another; sensors don't depend on each other and
are folded side by side, each in one task that streams its rows batch by batch. Sensors that have a window of more than
``window_rows`` rows are too much for that: their windows are aggregated by all tasks, one window after the other for all such
sensors together. With ``span``, windows are folded in spans of so many, and each span's end is written before the next
begins, which bounds what a task reads when a single sensor has a long past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.vectors import blended, mean_by_position, norm, squared_distance
from rillflow.sources.scratch import scratch_path, written

WINDOW_ROWS = 200_000
STEPS = "sensor string, step long, flows long, anomalies long, used long, drift double, mu array<double>"
STATE = "sensor string, mu array<double>, delta double"
KINDS = [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.list_(pa.float64())]
NAMES = [c.split()[0] for c in STEPS.split(", ")]
#: Rows that a task hands out at once.
OUT = 512


def _sensor(by: tuple[str, ...]) -> Column:
    """A sensor's key columns as one text."""
    return F.to_json(F.struct(*by)) if by else F.lit("{}")


def _folded(alpha: float | None, ratio: float):
    """Batches of (sensor, kind, step, v, delta) in order, each sensor's baseline (kind 0) first, to a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensor, step, mu, delta, n, bad, used, total = None, None, np.zeros(0), 0.0, 0, 0, 0, np.zeros(0)
        out: list[tuple] = []

        def close() -> None:
            nonlocal mu, step
            if step is not None:
                new = total / used if used else mu
                new = new if alpha is None else alpha * mu + (1 - alpha) * new
                out.append((sensor, step, n, bad, used, float(np.sqrt(((mu - new) ** 2).sum())), new.tolist()))
                mu, step = new, None

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(KINDS)], names=NAMES)
            out.clear()
            return made

        for b in batches:
            if not b.num_rows:
                continue
            names, kinds, steps = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1]) | (steps[1:] != steps[:-1]), [True]]))
            for i, j in zip(edges, edges[1:], strict=False):
                v = b.column(3).slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                if kinds[i] == 0:
                    close()
                    sensor, mu, delta = names[i], v.copy(), b.column(4)[int(i)].as_py()
                    continue
                if names[i] != sensor:  # a sensor without a baseline
                    continue
                if steps[i] != step:
                    close()
                    step, n, bad, used, total = int(steps[i]), 0, 0, 0, np.zeros(len(mu))
                v = v.reshape(-1, len(mu))
                score = ((v - mu) ** 2).sum(1)
                odd = (score > delta) | np.isnan(score)
                normal = ~odd & (score < ratio * delta)
                n, bad, used, total = n + int(j - i), bad + int(odd.sum()), used + int(normal.sum()), total + v[normal].sum(0)
            if len(out) >= OUT:
                yield handed()
        close()
        yield handed()

    return run


def _large_windows(rows: DataFrame, state: DataFrame, dim: int, alpha: float | None, ratio: float, table: str) -> None:
    """Append the steps of sensors with large windows to ``table``: an aggregation per window, for all of them together."""
    spark = rows.sparkSession
    source, place = scratch_path(spark, "large-windows"), scratch_path(spark, "large-baselines")
    rows.write.partitionBy("step").parquet(source)
    found = spark.read.schema("sensor string, v array<double>, step long").parquet(source)
    now = written(state, "large-baselines")
    for i, r in enumerate(found.select("step").distinct().orderBy("step").toLocalIterator()):
        one = found.where(F.col("step") == r["step"]).join(F.broadcast(now), "sensor")
        scored = one.withColumn("score", squared_distance(F.col("v"), F.col("mu")))
        odd = F.coalesce(F.col("score") > F.col("delta"), F.lit(True))
        scored = scored.withColumns({"odd": odd, "normal": ~odd & (F.col("score") < ratio * F.col("delta"))})
        new = scored.groupBy("sensor").agg(F.count("*").alias("flows"), F.count_if("odd").alias("anomalies"), F.count_if("normal").alias("used"), mean_by_position(F.when(F.col("normal"), F.col("v")), dim).alias("new"))
        both = now.join(F.broadcast(new), "sensor", "left")
        mean = F.when(F.col("used") > 0, F.col("new")).otherwise(F.col("mu"))
        both = both.withColumn("after", mean if alpha is None else F.when(F.col("used").isNotNull(), blended(F.col("mu"), mean, alpha)).otherwise(F.col("mu")))
        both = both.withColumn("drift", norm(F.zip_with("mu", "after", lambda a, b: a - b))).withColumn("step", F.lit(r["step"]))
        both.write.parquet(f"{place}/{i}")
        done = spark.read.schema(both.schema).parquet(f"{place}/{i}")
        done.where("used is not null").select("sensor", "step", "flows", "anomalies", "used", "drift", F.col("after").alias("mu")).coalesce(1).write.mode("append").parquet(table)
        now = done.select("sensor", F.col("after").alias("mu"), "delta")


def replay(vectors: DataFrame, start: DataFrame, width: int, by: tuple[str, ...] = (), alpha: float | None = None, ratio: float = 0.5, window_rows: int = WINDOW_ROWS, span: int | None = None) -> DataFrame:
    """(``by``, step, flows, anomalies, used, drift, mu): each sensor's windows of ``width`` that have rows, and the baseline after each.

    ``vectors`` has ``by``, at and v; ``start`` has a row (``by``, mu, delta) for each sensor, or one row without ``by``. A
    window's clearly normal vectors (not above delta, and below ``ratio`` of it) become the new mu, or are blended into it with
    weight 1 - ``alpha``; without any mu stays. Rows without ``at`` are in no window, sensors without a baseline have no steps;
    vectors with nulls or of another length have no score and are counted as anomalies.
    """
    spark = vectors.sparkSession
    first = start.select(F.size("mu").alias("d")).first()
    if first is None:
        return vectors.limit(0).select(*by, *[F.lit(None).cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in STEPS.split(", ")[1:]])
    dim = first["d"]
    whole = F.coalesce((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    missing = F.array_repeat(F.lit(float("nan")), dim)
    step = F.floor(F.col("at") / width).cast("long").alias("step")
    rows = vectors.select(_sensor(by).alias("sensor"), step, "at", F.when(whole, F.col("v").cast("array<double>")).otherwise(missing).alias("v")).where("step is not null")
    rows = written(rows, "replay-vectors")
    state = written(start.select(_sensor(by).alias("sensor"), F.col("mu").cast("array<double>").alias("mu"), F.col("delta").cast("double").alias("delta")), "baselines")
    large = written(rows.groupBy("sensor", "step").count().where(F.col("count") > window_rows).select("sensor").distinct(), "large-sensors")
    table = scratch_path(spark, "replay-steps")
    spark.createDataFrame([], STEPS).write.parquet(table)
    spans = [None] if span is None else [r["s"] for r in rows.select(F.floor(F.col("step") / span).alias("s")).distinct().orderBy("s").toLocalIterator()]
    for i, s in enumerate(spans):
        part = rows if s is None else rows.where((F.col("step") >= s * span) & (F.col("step") < (s + 1) * span))
        done = f"{table}/{i}"
        small = part.join(large, "sensor", "left_anti")
        based = state.join(large, "sensor", "left_anti").select("sensor", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("step"), F.col("mu").alias("v"), "delta", F.lit(None).cast(rows.schema["at"].dataType).alias("at"))
        both = based.unionByName(small.select("sensor", F.lit(1).alias("kind"), "step", "v", F.lit(None).cast("double").alias("delta"), "at"))
        # rows in one order, so that a task run again, and other spans, add up to the same last digit
        both.repartition("sensor").sortWithinPartitions("sensor", "kind", "step", "at", "v").mapInArrow(_folded(alpha, ratio), STEPS).write.parquet(done)
        if not large.isEmpty():
            _large_windows(part.join(large, "sensor", "left_semi").select("sensor", "v", "step"), state.join(large, "sensor", "left_semi"), dim, alpha, ratio, done)
        if s is not None:
            ends = spark.read.schema(STEPS).parquet(done).groupBy("sensor").agg(F.max_by("mu", "step").alias("after"))
            state = written(state.join(ends, "sensor", "left").select("sensor", F.coalesce("after", "mu").alias("mu"), "delta"), "baselines")
    steps = spark.read.option("recursiveFileLookup", True).schema(STEPS).parquet(table)
    kinds = T.StructType([vectors.schema[c] for c in by])
    return steps.withColumn("key__", F.from_json("sensor", kinds)).select(*[F.col(f"key__.{c}").alias(c) for c in by], *NAMES[1:]) if by else steps.drop("sensor")
