"""Intermediate tables in the folder that the cluster shares.

A materialized table cuts lineage: a lost executor costs a re-read of Parquet files, never a recomputation of the whole
plan. The folder is the one named by ``spark.checkpoint.dir``; only a local session without that setting gets one here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Once the next job has begun nothing refers to the shuffles below, so Spark's cleaner can free their files. Reading the
    schema from the files is that job; the collection that lets the cleaner notice is asked for here, because a driver
    that only plans seldom collects by itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return written


def numbered(df: DataFrame, added: str = "") -> tuple[DataFrame, T.StructType]:
    """``df`` with its columns named by their place, and its schema with ``added`` ones (a DDL text, or no more).

    Whatever the columns are called, and the fields inside them, functions over Arrow batches can then tell them apart.
    """
    plain = df.toDF(*map(str, range(len(df.columns))))
    more = T.StructType.fromDDL(added).fields if added else []
    return plain, T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema.fields] + more)


BATCH_ROWS = 2000


def map_texts(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches that leave room for long texts: whole documents, two tasks to a small executor.

    The session's batch size is lowered for this, never raised.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file:").lstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in path:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
