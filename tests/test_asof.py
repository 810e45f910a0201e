import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators.asof import as_of
from rillflow.operators.scoring import score_as_of


def plain(rows, versions):
    out = []
    for key, at, name in rows:
        held = [(f, v, m) for k, f, v, m in versions if k == key and f is not None and at is not None and f <= at]
        if held:
            best = max(held, key=lambda x: x[:2])
            out.append((key, at, name, best[1], best[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("buckets", "per_part"), [(4096, 1_000_000), (7, 5), (1, 40)])
def test_against_plain_search(spark, buckets, per_part):
    rng = np.random.default_rng(6)
    key = lambda: [None, "a", "b", "c"][int(rng.integers(0, 4))]
    rows = [(key(), int(rng.integers(-50, 500)), f"r{i}") for i in range(300)] + [("a", 77, f"hot{i}") for i in range(150)] + [("a", None, "no time"), ("d", 5, "no version")]
    rows += [("a", 77, "hot1")] * 3
    versions = [(key(), int(rng.integers(-300, 600)), i, f"m{i}") for i in range(200)] + [("a", 77, 900, "same time"), ("a", 77, 901, "same time, later"), ("a", None, 902, "never")]
    frame = spark.createDataFrame(rows, "key string, at long, name string").repartition(3)
    table = spark.createDataFrame(versions, "key string, valid_from long, version long, mark string")
    got = as_of(frame, table, by=("key",), buckets=buckets, rows_per_part=per_part)
    assert sorted(map(tuple, got.select("key", "at", "name", "version", "mark").collect()), key=repr) == plain(rows, versions)


def test_without_key_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 5.0)], "id int, at double")
    table = spark.createDataFrame([(10.0, 1, "x"), (15.0, 2, "y")], "valid_from double, version int, mark string")
    assert sorted((r["id"], r["mark"]) for r in as_of(rows, table).collect()) == [(1, "x"), (2, "y")]
    assert as_of(rows.where("false"), table).count() == 0 and as_of(rows, table.where("false")).count() == 0


def test_a_million_versions_without_comparing_pairs(spark):
    versions = spark.range(1_000_000).select(F.col("id").alias("version"), (F.col("id") * 3).alias("valid_from"), F.array(F.col("id").cast("double")).alias("mu"))
    rows = spark.range(50_000).select("id", (F.col("id") * 59 + 1).alias("at"), F.array((F.col("id") % 7).cast("double")).alias("v"))
    got = score_as_of(rows, versions)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wrong = got.where((F.col("version") != F.expr("(id * 59 + 1) div 3")) | (F.abs(F.col("score") - F.pow(F.col("version") - F.col("id") % 7, F.lit(2))) > 1e-3))
    assert got.count() == 50_000 and wrong.count() == 0
