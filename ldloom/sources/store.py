"""Places that the driver and all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where none is set, a folder of our own. On a cluster a local folder would
    be one on each machine, so there its absence raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder := tempfile.mkdtemp(prefix="ldloom-"))
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch path and read back, so that later steps read columns of it instead of redoing it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows that the driver knows. They go by Arrow: a list would go through Python workers, of a daemon of their own in each executor."""
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    frame(spark, [(json.dumps(value),)], pa.schema([("value", pa.string())])).coalesce(1).write.mode("overwrite").text(path)
