"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.storage import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    moved = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    drop(least)
    return moved


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    drop(least)
    return moved


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has two long columns; their order, self links, repeats and nulls don't matter. Each round is two
    aggregations with map-side minima and two equi-joins. A node with very many links is combined before the shuffle;
    the minima are written, so that the join shuffles both sides for itself and adaptive execution may split the node's
    partition. Rounds end when the edge table stops changing.
    """
    x, y = (F.col(c) for c in edges.columns[:2])
    state = materialize(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(),
        "edges",
    )
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    seen = state.agg(F.count("*").alias("n"), mark).first()
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        large = _large_star(state)
        new = _small_star(large)
        drop(state)
        drop(large)
        state, now = new, new.agg(F.count("*").alias("n"), mark).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    roots = state.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
