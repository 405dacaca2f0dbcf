"""Keyed state in hash buckets: a batch rewrites the buckets that it touches, and a manifest says where each bucket is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, batch long"


class Buckets:
    """Rows of ``schema`` under ``folder``, in ``many`` buckets by a hash of ``keys``.

    Batch n writes its buckets to data/batch=n, then manifest/batch=n: for each bucket the batch that wrote it last. Until the manifest
    is there the state is that of the batch before; a batch that is run again reads that one and overwrites what it wrote. So
    a failure at any point leaves a whole state, and a rerun gives the same one."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], many: int = 256):
        self.spark, self.folder, self.schema, self.keys, self.many = spark, folder.rstrip("/"), schema, keys, many

    def bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*(keys or map(F.col, self.keys))), F.lit(self.many)).cast("int")

    def manifest(self, batch: int) -> dict[int, int]:
        """The batch that wrote each bucket, as of a batch; none before the first. At most ``many`` rows."""
        if batch < 0:
            return {}
        return {r.bucket: r.batch for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/batch={batch}").collect()}

    def read(self, batch: int, buckets: set[int] | None = None) -> DataFrame:
        """The rows as of a batch, of some buckets or of all."""
        paths = [f"{self.folder}/data/batch={n}/bucket={b}" for b, n in sorted(self.manifest(batch).items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/data").parquet(*paths).select(*[c.split()[0] for c in self.schema.split(", ")])

    def write(self, batch: int, rows: DataFrame, buckets: set[int]) -> None:
        """Makes ``rows`` all that ``buckets`` hold; rows of other buckets are an error of the caller's."""
        rows = rows.withColumn("bucket", self.bucket())
        rows.repartition(max(1, min(len(buckets), self.many)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/data/batch={batch}")
        held = {r.bucket for r in self.spark.read.parquet(f"{self.folder}/data/batch={batch}").select("bucket").distinct().collect()} if not rows.isEmpty() else set()
        if not held <= buckets:
            raise ValueError("rows of buckets that aren't written")
        now = {b: n for b, n in self.manifest(batch - 1).items() if b not in buckets} | dict.fromkeys(held, batch)
        self.spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")

    def touched(self, keys: DataFrame) -> set[int]:
        """The buckets of the rows of ``keys``, which has the key columns. At most ``many``."""
        return {r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()}

    def collect_garbage(self, batch: int, keep: int = 2) -> list[int]:
        """Deletes what no manifest of the last ``keep`` batches names, and older manifests; returns the batches whose data went."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        fs = path(self.folder).getFileSystem(conf)
        last = range(max(0, batch - keep + 1), batch + 1)
        used = {n for k in last for n in self.manifest(k).values()} | set(last)
        gone = []
        for kind in ("data", "manifest"):
            for s in fs.listStatus(path(f"{self.folder}/{kind}")):
                n = int(s.getPath().getName().removeprefix("batch="))
                if n < batch and n not in (used if kind == "data" else last):
                    fs.delete(s.getPath(), True)
                    gone += [n] if kind == "data" else []
        return sorted(gone)
