"""The shared folder for tables that a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without that setting gets one temporary folder for
    its application; on a cluster an unset folder is an error, since executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="newsloom-")
        base = _LOCAL[app]
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage and outlives lost executors."""
    path = f"{folder(df.sparkSession)}/newsloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written intermediate tables: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/newsloom-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
