"""Feeds that arrive as files, canonicalized batch by batch."""

from __future__ import annotations

from newsloom.functions import text as t
from newsloom.functions.scratch import written
from newsloom.sources import articles, canonical
from newsloom.sources.state import Buckets
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = "source_id string, external_id string, url string, content_hash string, title string, published_at timestamp, revision int"
OWNERS = "url string, source_id string, external_id string"


def stores(spark: SparkSession, folder: str, many: int = 256) -> tuple[Buckets, Buckets]:
    """Current items by source and external id, and the index of their URLs. An entry of the index can be out of date, its item
    having moved to another URL; it then only makes a batch read an item in vain."""
    return Buckets(spark, f"{folder}/current", CURRENT, ["source_id", "external_id"], many), Buckets(spark, f"{folder}/urls", OWNERS, ["url"], many)


def current(spark: SparkSession, folder: str, batch: int, many: int = 256) -> DataFrame:
    """All current items that a batch left; none before the first."""
    return stores(spark, folder, many)[0].read(batch)


def candidates(payloads: DataFrame) -> DataFrame:
    """Parsed entries of ``payloads(source_id, final_url, body, fetched_at)`` as versions for ``persist_canonical``; of entries that
    repeat a key in a payload the first counts."""
    at = payloads.groupBy("source_id").agg(F.max("fetched_at").alias("fetched_at"))
    p = articles.parse_feeds(payloads).dropDuplicates(["source_id", "external_id", "title", "content"]).join(at, "source_id")
    return p.select("source_id", "external_id", articles.canonical_url(F.col("url")).alias("url"), t.semantic_hash(F.col("title"), F.col("content")).alias("content_hash"), "title", "published_at", "fetched_at")


def take_in(spark: SparkSession, versions: DataFrame, folder: str, n: int, many: int = 256) -> dict[str, DataFrame]:
    """Batch ``n`` of versions into the state under ``folder``: what ``persist_canonical`` gives, ``current`` being that of the buckets
    that are rewritten: those of the versions' keys and of the items whose URLs they have."""
    items, urls = stores(spark, folder, many)
    versions = written(versions)
    named = versions.where("url is not null").select("url").distinct()
    url_buckets = urls.touched(named)
    index = urls.read(n - 1, url_buckets)
    owners = index.join(named, "url", "left_semi")
    buckets = items.touched(versions.select("source_id", "external_id").unionByName(owners.select("source_id", "external_id")))
    out = canonical.persist_canonical(items.read(n - 1, buckets), versions)
    out["current"] = written(out["current"])
    items.write(n, out["current"], buckets)
    now = out["current"].join(named, "url", "left_semi").select("url", "source_id", "external_id")
    urls.write(n, index.join(named, "url", "left_anti").unionByName(now), url_buckets)
    return out


def canonicalize(payloads: DataFrame, folder: str, checkpoint: str, many: int = 256):
    """A stream of payloads into ``folder``: the state in buckets, and each batch's revisions and conflicts. A batch that is run
    again after a failure overwrites what it wrote, from the state before it; data that no later batch needs are deleted."""
    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        out = take_in(spark, candidates(batch), folder, n, many)
        for name in ("revisions", "conflicts"):
            out[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
        for store in stores(spark, folder, many):
            store.collect_garbage(n)

    return payloads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
