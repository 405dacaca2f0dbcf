"""The source registry and the topic catalog as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources (fixed values): slug, name, feed, language, markets, topics, tier, authority, requests a minute, selection.
#: The VnExpress ones differ by topic alone.
_VN = [
    ("travel", "Du lịch", "du-lich"), ("markets", "Kinh doanh", "kinh-doanh"), ("technology", "Khoa học Công nghệ", "khoa-hoc-cong-nghe"), ("career", "Giáo dục", "giao-duc"),
    ("health", "Sức khỏe", "suc-khoe"), ("sports", "Thể thao", "the-thao"), ("entertainment", "Giải trí", "giai-tri"), ("latest", "Tin mới nhất", "tin-moi-nhat"),
]
PROFILES = [
    ("openai-newsroom-rss", "OpenAI Newsroom", "https://openai.com/news/rss.xml", "en", ["GLOBAL", "US"], ["openai", "technology"], 1, 1.0, 20, "ALL_ITEMS"),
    ("apple-newsroom-rss", "Apple Newsroom", "https://www.apple.com/newsroom/rss-feed.rss", "en", ["GLOBAL", "US"], ["apple", "technology", "products"], 1, 1.0, 20, "ALL_ITEMS"),
    ("coindesk-rss", "CoinDesk", "https://www.coindesk.com/arc/outboundfeeds/rss", "en", ["GLOBAL", "US"], ["bitcoin", "markets"], 2, 0.85, 20, "MATCH_TOPIC_TERMS"),
    *[(f"vnexpress-{t}-rss", f"VnExpress · {n}", f"https://vnexpress.net/rss/{p}.rss", "vi", ["VN", "GLOBAL"] if t == "technology" else ["VN"], ["technology", "products"] if t == "technology" else [t], 2, 0.85, 30, "MATCH_TOPIC_TERMS") for t, n, p in _VN],
]
_SCHEMA = ["slug", "name", "feed_url", "language", "markets", "topics", "tier", "authority", "rate_limit_per_minute", "selection_policy"]
#: The source that a topic had before sources had topics; any other topic has the fallback (fixed values).
DEFAULT_SOURCE = {
    "openai": "openai-newsroom-rss", "apple": "apple-newsroom-rss", "bitcoin": "coindesk-rss", "products": "vnexpress-technology-rss",
    **{t: f"vnexpress-{t}-rss" for t, *_ in _VN if t != "latest"},
}
FALLBACK = "vnexpress-latest-rss"
#: Topics of the catalog: key, type, category, symbol, names (fixed values).
CATALOG = [
    ("travel", "TOPIC", "travel", "airplane", "Du lịch", "Travel"), ("markets", "TOPIC", "investments", "chart.line.uptrend.xyaxis", "Thị trường & đầu tư", "Markets & investing"),
    ("technology", "TECHNOLOGY", "work", "cpu", "Công nghệ", "Technology"), ("career", "JOB", "work", "briefcase", "Sự nghiệp", "Career"), ("health", "TOPIC", "health", "heart", "Sức khỏe", "Health"),
    ("sports", "SPORTS_TEAM", "sports", "sportscourt", "Thể thao", "Sports"), ("entertainment", "MOVIE", "entertainment", "film", "Giải trí", "Entertainment"), ("products", "PRODUCT", "purchases", "bag", "Sản phẩm muốn mua", "Products to buy"),
]
CATEGORIES = {
    "investments": ("Đầu tư", "Investments"), "work": ("Công việc", "Work"), "sports": ("Thể thao", "Sports"), "entertainment": ("Giải trí", "Entertainment"),
    "travel": ("Du lịch", "Travel"), "purchases": ("Mua sắm", "Purchases"), "health": ("Sức khỏe", "Health"), "other": ("Khác", "Other"),
}


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of fixed values, made without a Python worker."""
    value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[value(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def profiles(spark: SparkSession) -> DataFrame:
    """All sources; enabled, and fetched every quarter of an hour."""
    return literal_table(spark, _SCHEMA, PROFILES).withColumns({"enabled": F.lit(True), "update_interval_s": F.lit(900), "license_policy": F.lit("EXCERPT_ONLY")})


def _key(topic: str) -> Column:
    return F.lower(F.trim(topic))


def for_topics(topics: DataFrame, sources: DataFrame, topic: str = "topic") -> DataFrame:
    """Rows of ``topics`` with each enabled source of their topic."""
    by = sources.where("enabled").withColumn("_t", F.explode("topics"))
    return topics.join(by, _key(topic) == F.col("_t")).drop("_t")


def default_source(topics: DataFrame, sources: DataFrame, topic: str = "topic") -> DataFrame:
    """Rows of ``topics`` with the one source that stands for their topic, the fallback if none does."""
    known = F.create_map(*[F.lit(x) for kv in DEFAULT_SOURCE.items() for x in kv])
    return topics.withColumn("slug", F.coalesce(F.try_element_at(known, _key(topic)), F.lit(FALLBACK))).join(sources, "slug")


def catalog(spark: SparkSession, locale: str = "en") -> DataFrame:
    """(topic, type, category, symbol, name, category_label) in a locale."""
    at = 0 if locale == "vi" else 1
    rows = [(k, t, c, s, (vi, en)[at], CATEGORIES.get(c, (c, c))[at]) for k, t, c, s, vi, en in CATALOG]
    return literal_table(spark, ["topic", "type", "category", "symbol", "name", "category_label"], rows)


def bounded_tier(tier: Column) -> Column:
    return F.when(tier.isin(1, 2, 3), tier.cast("int")).otherwise(F.lit(3))


def bounded_authority(score: Column) -> Column:
    return F.when(score.between(0.0, 1.0), score).otherwise(F.lit(0.0))


#: What a topic is also called, and words that say nothing (fixed values).
ALIASES = {
    "travel": ["Du lịch", "Travel"], "markets": ["Kinh doanh", "Thị trường", "Đầu tư", "Markets"], "technology": ["Công nghệ", "Technology"], "career": ["Giáo dục", "Việc làm", "Sự nghiệp", "Career"],
    "health": ["Sức khỏe", "Health"], "sports": ["Thể thao", "Sports"], "entertainment": ["Giải trí", "Entertainment"], "products": ["Sản phẩm", "Công nghệ", "Products"],
}
GENERIC = ["market", "development", "topic", "news", "today"]


def term_keywords(interests: DataFrame) -> DataFrame:
    """Distinct (interest_id, keyword) of ``interests(interest_id, name, topic_key, refinements)``: the ASCII words of three
    letters or more, accents folded, of its name, its topic's other names and its refinements."""
    from newsloom.functions.text import fold_accents

    other = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    none = F.array().cast("array<string>")
    terms = F.concat(F.array("name"), F.coalesce(F.try_element_at(other, F.col("topic_key")), none), F.coalesce("refinements", none))
    t = interests.select("interest_id", F.explode(terms).alias("term")).where("trim(term) <> ''")
    w = t.select("interest_id", F.explode(F.split(fold_accents(F.col("term")), "[^a-z0-9]+")).alias("keyword"))
    return w.where((F.length("keyword") >= 3) & ~F.col("keyword").isin(GENERIC)).distinct()


def matching_items(items: DataFrame, interests: DataFrame) -> DataFrame:
    """(interest_id, item_id) of ``items(item_id, title, content, selection_policy)``: all of a source that gives all items, else
    those whose text, accents folded, holds a keyword."""
    from newsloom.functions.automaton import containing
    from newsloom.functions.text import fold_accents

    k = term_keywords(interests)
    text = items.where("selection_policy <> 'ALL_ITEMS'").select("item_id", fold_accents(F.concat_ws(" ", "title", "content")).alias("text"))
    found = containing(k.select(F.col("keyword").alias("token")).distinct(), text, "item_id")
    some = k.join(found, F.col("keyword") == F.col("token")).select("interest_id", "item_id").distinct()
    every = interests.select("interest_id").join(items.where("selection_policy = 'ALL_ITEMS'").select("item_id"), F.lit(True))
    return some.unionByName(every)
