"""Session helpers that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that shared_path() has named, and tables that bucketed() has.
_made: list[str] = []
_tables: list[str] = []

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see. Where it is unset, a local master
    (tests) gets a folder of this machine; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pagelake-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/pagelake/{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder. Results that read it must be written before."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost
    executor costs a re-read, not a re-computation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As staged(), dealt out by a key once: joins and groups on the key read it without another shuffle."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = f"{name}_{uuid.uuid4().hex}"
    _tables.append(called)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(called)
    return spark.table(called)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked for a broadcast if it has no more rows than that; beyond, joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
