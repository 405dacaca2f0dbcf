"""What several of the operators use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import Scratch
from newsloom.operators.graph import components  # noqa: F401


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: Catalyst may copy a column's expression to each of
    its uses, and inside a lambda it would then be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Lists of ids or keys up to this many rows are broadcast (some 16 MB); longer ones are shuffled.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (a written table of one or two narrow columns) marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def partitions(df: DataFrame) -> int:
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_key(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows that are alike in the first ``n`` columns, from batches sorted by them: (key, rows)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*[b.column(k).to_pylist() for k in range(n)], strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(b.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)


def first_by_hash(df: DataFrame, rows: int, *key: str, by: str | None = None, seed: int = 0) -> DataFrame:
    """Of the distinct ``key`` values of ``df`` (rows that repeat one count once) the ``rows`` that are first by a hash of
    all of them, with ``by`` as many for each of its values: a sample of bounded size that is the same in any
    partitioning. Counts set a bound on the hash, under which half as many again are expected, so that few rows
    reach the sort; where that leaves too few, all rows are sorted, so the bound never changes the sample."""
    df = df.select(*key, (F.col(by) if by else F.lit(0)).alias("_by"), F.xxhash64(*key, F.lit(seed)).alias("_h"))
    scratch = Scratch(df.sparkSession, "sample")
    counts = broadcast_if_small(scratch.save(df.groupBy("_by").agg(F.approx_count_distinct("_h").alias("_n")).withColumnRenamed("_by", "_c")))
    span = float(1 << 64)
    under = F.col("_h").cast("double") + span / 2 < F.lit(span * 1.5 * rows) / F.greatest(F.col("_n"), F.lit(1))
    sample = df.join(counts, F.col("_by").eqNullSafe(F.col("_c"))).where(under | (F.col("_n") <= 2 * rows)).drop("_n", "_c")
    got = sample.groupBy("_by").agg(F.countDistinct("_h").alias("_got"))
    both = counts.join(got, F.col("_by").eqNullSafe(F.col("_c")), "left")
    if not both.where(F.coalesce("_got", F.lit(0)) < F.least(F.lit(float(rows)), F.col("_n") * 0.9)).isEmpty():
        sample = df
    order = F.row_number().over(Window.partitionBy("_by").orderBy("_h", *key))
    first = sample.dropDuplicates(["_h", "_by"]).withColumn("_r", order).where(F.col("_r") <= rows)
    return scratch.save(first.select(*key, *([F.col("_by").alias(by)] if by else [])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
