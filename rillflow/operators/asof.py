"""As-of join by one order of time: each row with the version that was in force at its time.

Time is cut into equal buckets. What was in force when a bucket begins is carried over from the buckets before it, on one row per
bucket; inside a bucket, versions and rows are put in one order and a running window hands the newest version on. Nothing is
compared pair by pair, so the number of versions may grow with the rows. A bucket of many rows is dealt to several parts, each
with the bucket's versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.sources.scratch import written

BUCKETS = 4096
ROWS_PER_PART = 1_000_000


def as_of(rows: DataFrame, versions: DataFrame, time: str = "at", by: tuple[str, ...] = (), buckets: int = BUCKETS, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``rows`` with the columns of the version of their ``by`` that has the greatest valid_from not after ``time``.

    ``versions`` has valid_from, version (the greatest of those that begin together counts), ``by`` and what is to be carried.
    ``time`` and valid_from are numbers. Rows before the first version, and rows or versions without a time, are left out;
    null ``by`` values match each other.
    """
    ends = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    width = (hi - lo) / buckets or 1
    within = lambda t: F.least(F.floor((t - F.lit(lo)) / F.lit(width)), F.lit(buckets)).cast("int")
    keys = [F.col(c).alias(f"key{i}__") for i, c in enumerate(by)]
    part = [*(f"key{i}__" for i in range(len(by))), "bucket__"]
    carried = [c for c in versions.columns if c not in by]

    known = versions.where(F.col("valid_from") <= F.lit(hi))
    # all that began before the first row matters only by its last version
    known = known.select(*keys, F.when(F.col("valid_from") < F.lit(lo), -1).otherwise(within(F.col("valid_from"))).alias("bucket__"), F.struct("valid_from", "version", *[F.col(c).alias(f"v{i}__") for i, c in enumerate(carried)]).alias("v__"))
    placed = rows.where(F.col(time).isNotNull()).select(*keys, within(F.col(time)).alias("bucket__"), F.col(time).alias("t__"), F.struct(*rows.columns).alias("row__"))
    sizes = placed.groupBy(*part).agg(F.ceil(F.count("*") / F.lit(rows_per_part)).cast("int").alias("parts__"))
    last = known.groupBy(*part).agg(F.max_by("v__", F.struct("v__.valid_from", "v__.version")).alias("v__"))
    grid = sizes.unionByName(last, allowMissingColumns=True).groupBy(*part).agg(F.max("parts__").alias("parts__"), F.first("v__", ignorenulls=True).alias("v__"))
    before = W.partitionBy(*(part[:-1] or [F.lit(0)])).orderBy("bucket__").rowsBetween(W.unboundedPreceding, -1)
    grid = written(grid.select(*part, "parts__", F.last("v__", ignorenulls=True).over(before).alias("v__")).where("parts__ is not null"), "as-of-buckets")

    same = lambda other: [F.col(f"a.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in part]
    of_part = [F.col(f"a.{c}").alias(c) for c in part]
    every = F.explode(F.sequence(F.lit(0), F.col("g.parts__") - 1)).alias("part__")
    none = F.lit(None)
    carry = grid.alias("g").select(*part, every, none.cast("double").alias("t__"), "v__", none.cast(placed.schema["row__"].dataType).alias("row__"))
    changes = known.where("bucket__ >= 0").alias("a").join(grid.select(*part, "parts__").alias("g"), same("g")).select(*of_part, every, F.col("a.v__.valid_from").cast("double").alias("t__"), F.col("a.v__").alias("v__"), none.cast(placed.schema["row__"].dataType).alias("row__"))
    dealt = F.pmod(F.xxhash64(F.to_json("a.row__")), F.col("g.parts__").cast("long")).cast("int")
    dealt = F.when(F.col("g.parts__") > 1, dealt).otherwise(0).alias("part__")
    asked = placed.alias("a").join(grid.select(*part, "parts__").alias("g"), same("g")).select(*of_part, dealt, F.col("a.t__").cast("double").alias("t__"), none.cast(known.schema["v__"].dataType).alias("v__"), F.col("a.row__").alias("row__"))

    order = W.partitionBy(*part, "part__").orderBy(F.col("t__").asc_nulls_first(), F.col("row__").isNotNull(), "v__.valid_from", "v__.version")
    merged = carry.unionByName(changes).unionByName(asked).withColumn("v__", F.last("v__", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = merged.where(F.col("row__").isNotNull() & F.col("v__").isNotNull())
    return found.select(*[F.col(f"row__.`{c}`").alias(c) for c in rows.columns], *[F.col(f"v__.v{i}__").alias(c) for i, c in enumerate(carried) if c not in rows.columns])
