"""Domain views over the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Topic catalog keys, markets, and the time at which registered queries look at the data.
TOPICS = ["travel", "markets", "technology", "career", "health", "sports", "entertainment", "products"]
MARKETS = ["VN", "GLOBAL", "US", "CN", "JP", "KR", "SG", "TH", "ID", "MY", "PH", "IN", "DE", "FR", "GB", "BR"]
#: Markets of the queries on all pairs: with these, and importance by tier alone, every reason is met more often.
FEW_MARKETS = MARKETS[:4]
AS_OF = "2024-01-05 00:00:00"


#: Tables of texts: one that is a single file can be a single row group, which only one task reads, so it is dealt out anew.
TEXTS = ("documents", "pages")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if name in TEXTS and len(df.inputFiles()) == 1 else df


def pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def contents(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """``whole``: four markets, and importance by tier alone."""
    names = FEW_MARKETS if whole else MARKETS
    d = load(spark, sf_dir, "documents").where("doc_id is not null")
    i = F.col("doc_id")
    tier = (F.lit(1) + F.pmod(i, F.lit(3))).cast("int")
    d = d.select(
        i.alias("content_id"), F.col("source").alias("publisher"), "lang", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + i * 420).alias("published_at"), tier.alias("tier"), (1.0 - 0.25 * (tier - 1)).alias("authority"),
        F.array_distinct(F.array(pick(TOPICS, i), pick(TOPICS, i * 3 + 1))).alias("topics"), F.array_distinct(F.array(pick(names, i), pick(names, i * 5 + 2))).alias("markets"),
    )
    own = F.when(F.col("tier") == 1, F.col("authority")).otherwise(F.col("authority") * 0.75)
    return d.withColumn("importance", own if whole else own * F.when(F.col("content_id") % 7 == 0, 1.0).otherwise(0.75))


#: Words that users watch; a blank one watches nothing.
WATCHED = ["mentai", "Worthless", "LICENSE", "password", "thionthe", " "]


def published(spark: SparkSession, sf_dir: str, days: int = 28, whole: bool = False) -> tuple[DataFrame, str]:
    """Contents as they are published over ``days``, whatever the table's size, and the time of the last of them. With
    entities, provenance, cluster, and the earliest content of the same text as duplicate_of_id."""
    c = contents(spark, sf_dir, whole)
    last = c.agg(F.max("content_id")).first()[0]
    span = days * 86400
    now = AS_OF if last is None else dt.datetime.fromtimestamp(1704067200 + last * span // (last + 1), dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
    i = F.col("content_id")
    c = c.withColumns({
        "published_at": F.timestamp_seconds(F.expr(f"1704067200 + content_id * {span} div {(last or 0) + 1}")), "entities": F.array(F.col("publisher"), F.concat(F.lit("Org"), (i % 7).cast("string"))),
        "provenance_status": F.when(i % 13 == 0, "NEEDS_REVIEW").otherwise("VERIFIED"), "cluster_id": F.when(i % 4 != 0, F.concat(F.lit("c"), F.floor(i / 5).cast("string"))), "_text": F.md5("content"),
    })
    first = c.groupBy("_text").agg(F.min("content_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_text", "_first")
    c = c.join(first, "_text", "left").withColumn("duplicate_of_id", F.when(F.col("_first") < i, F.col("_first")))
    return c.drop("_text", "_first"), now


def localizations(c: DataFrame) -> DataFrame:
    """Two attempts at each content in each of two locales; some are rejected, some have no time of verification."""
    i = F.col("content_id")
    rows = c.select("content_id", "title", "published_at", F.explode(F.array(F.lit("vi"), F.lit("en"))).alias("locale"), F.lit(0).alias("_z")).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    second = (F.col("locale") == "vi").cast("long")
    return rows.select(
        (i * 10 + F.col("attempt") * 2 + second).alias("localization_id"), "content_id", "locale", F.when((i + F.col("attempt") + second) % 3 != 0, "VERIFIED").otherwise("REJECTED").alias("status"),
        F.when((i + F.col("attempt")) % 7 != 0, F.col("published_at") + F.make_interval(hours=F.col("attempt"))).alias("verified_at"), F.concat("locale", F.lit(":"), "title").alias("title"),
    )


def users(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    names = FEW_MARKETS if whole else MARKETS
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return load(spark, sf_dir, "customer").select(
        k.alias("user_id"), F.when(n % 2 == 0, "vi").otherwise("en").alias("locale"), pick(names, n).alias("home_market"),
        F.array_distinct(F.array(pick(names, n + 1), pick(names, n + 2))).alias("followed_markets"), F.array_distinct(F.array(pick(TOPICS, k), pick(TOPICS, k * 5 + 3))).alias("interests"),
        F.array(F.concat(F.lit("SRC"), (k % 4).cast("string")), F.concat(F.lit(" org"), (k % 4 + 3).cast("string"))).alias("entities"), F.array(pick(WATCHED, k), pick(WATCHED, k + 2)).alias("keywords"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_pick(values, index) -> str:
    return f"{_sql_list(values)}[CAST(({index}) % {len(values)} AS INT) + 1]"


def _uniq(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN [{a}] ELSE [{a}, {b}] END"


CONTENTS = f"""contents AS (SELECT *, CASE WHEN tier = 1 THEN authority ELSE authority * 0.75::DOUBLE END * CASE WHEN content_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS importance FROM (
SELECT doc_id AS content_id, source AS publisher, lang, split_part(text, chr(10), 1) AS title, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 420) AS published_at, CAST(1 + doc_id % 3 AS INT) AS tier, 1.0::DOUBLE - 0.25::DOUBLE * (doc_id % 3) AS authority,
  {_uniq(_sql_pick(TOPICS, 'doc_id'), _sql_pick(TOPICS, 'doc_id * 3 + 1'))} AS topics,
  {_uniq(_sql_pick(MARKETS, 'doc_id'), _sql_pick(MARKETS, 'doc_id * 5 + 2'))} AS markets FROM documents WHERE doc_id IS NOT NULL))"""
USERS = f"""users AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 2 = 0 THEN 'vi' ELSE 'en' END AS locale, {_sql_pick(MARKETS, 'c_nationkey')} AS home_market,
  {_uniq(_sql_pick(MARKETS, 'c_nationkey + 1'), _sql_pick(MARKETS, 'c_nationkey + 2'))} AS followed_markets,
  {_uniq(_sql_pick(TOPICS, 'c_custkey'), _sql_pick(TOPICS, 'c_custkey * 5 + 3'))} AS interests,
  ['SRC' || (c_custkey % 4), ' org' || (c_custkey % 4 + 3)] AS entities, [{_sql_pick(WATCHED, 'c_custkey')}, {_sql_pick(WATCHED, 'c_custkey + 2')}] AS keywords FROM customer)"""
PUBLISHED = """published AS (SELECT *, CASE WHEN first < content_id THEN first END AS duplicate_of_id FROM (SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:00' + to_seconds(content_id * 2419200 // (SELECT max(content_id) + 1 FROM contents)) AS published_at),
  [publisher, 'Org' || (content_id % 7)] AS entities, CASE WHEN content_id % 13 = 0 THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END AS provenance_status,
  CASE WHEN content_id % 4 <> 0 THEN 'c' || (content_id // 5) END AS cluster_id, min(content_id) OVER (PARTITION BY md5(content)) AS first FROM contents))"""
LOCALIZATIONS = """localizations AS (SELECT content_id * 10 + a * 2 + v AS localization_id, content_id, l AS locale, CASE WHEN (content_id + a + v) % 3 <> 0 THEN 'VERIFIED' ELSE 'REJECTED' END AS status,
  CASE WHEN (content_id + a) % 7 <> 0 THEN published_at + to_hours(a) END AS verified_at, l || ':' || title AS title FROM published, (VALUES ('vi', 1), ('en', 0)) x(l, v), (VALUES (1), (2)) y(a))"""


def whole(sql: str) -> str:
    """A query's SQL over the views with four markets, and importance by tier alone."""
    for at in ("doc_id", "doc_id * 5 + 2", "c_nationkey", "c_nationkey + 1", "c_nationkey + 2"):
        sql = sql.replace(_sql_pick(MARKETS, at), _sql_pick(FEW_MARKETS, at))
    return sql.replace(" * CASE WHEN content_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS importance", " AS importance")
