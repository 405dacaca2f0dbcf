"""The user-centric content graph: insights, their feedback, and topics by it."""

from __future__ import annotations

from newsloom.operators.matching import GLOBAL_IMPORTANCE, clamp, keyword_hits, keywords_found, publishable, ranking_score
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Older interest keys and the catalog topics that they became (fixed values).
LEGACY_TOPICS = {"openai": "technology", "apple": "technology", "bitcoin": "markets"}


def bucket(kind: Column, importance: Column) -> Column:
    return F.when((kind == "ALERT") & (importance >= 0.8), "actionRequired").when((kind == "ALERT") | (importance >= 0.65), "important").otherwise("informational")


def importance_by_age(age_hours: Column) -> Column:
    return F.when(age_hours <= 6, 0.82).when(age_hours <= 24, 0.72).otherwise(0.58)


def visible(user_insights: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """User insights that aren't dismissed, have an interest, and whose insight has a processed event."""
    good = links.join(events.where("status = 'PROCESSED'").select("event_id"), "event_id", "left_semi").select("insight_id").distinct()
    return user_insights.where((F.col("status") != "DISMISSED") & F.col("interest_id").isNotNull()).join(good, "insight_id", "left_semi")


def of_interest(user_insights: DataFrame, insights: DataFrame, interest_id) -> DataFrame:
    """Insights of one interest, newest first."""
    return user_insights.where(F.col("interest_id") == interest_id).join(insights, "insight_id").orderBy(F.col("generated_at").desc_nulls_last(), "insight_id")


def freshness(published: Column, as_of: Column) -> Column:
    """(age_hours to one place, within 48 hours, fallback window)."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(published)) / 3.6e9)
    return F.struct(F.round(age, 1).alias("age_hours"), (age <= 48).alias("within_48_hours"), F.when(age > 48, "7d").alias("fallback_window"))


def project(rows: DataFrame, localizations: DataFrame, locale: str, as_of: str) -> DataFrame:
    """What a client shows of ``rows(id, insight_id, type, importance, title, content, language, published_at, reason,
    interest_name)``: the text in the asked locale, else the original with its language and the mark of a fallback."""
    loc = localizations.where(F.col("locale") == locale).select("insight_id", F.col("title").alias("_t"), F.col("content").alias("_c"), F.col("reason").alias("_r"), F.lit(True).alias("_has"))
    j = rows.join(loc, "insight_id", "left")
    prose = F.when(~F.rlike("reason", F.lit("^(?i)[a-z0-9_]+$")), F.col("reason"))
    name = F.col("interest_name")
    default = F.concat(F.lit("Tin này liên quan đến chủ đề "), F.coalesce(name, F.lit("anh đang theo dõi")), F.lit(".")) if locale == "vi" else F.concat(F.lit("This update is relevant to "), F.coalesce(name, F.lit("a topic you track")), F.lit("."))
    return j.select(
        "id", "insight_id", bucket(F.col("type"), F.col("importance")).alias("bucket"), F.coalesce("_t", "title").alias("title"), F.coalesce("_c", "content").alias("summary"), F.coalesce("_r", prose, default).alias("relevance_reason"),
        F.lit(locale).alias("requested_locale"), F.when(F.col("_has"), F.lit(locale)).otherwise(F.coalesce("language", F.lit("unknown"))).alias("served_locale"), F.col("_has").isNull().alias("fallback"), freshness(F.col("published_at"), F.lit(as_of).cast("timestamp")).alias("freshness"),
    )


def fold_feedback(user_insights: DataFrame, feedback: DataFrame) -> DataFrame:
    """User insights after their feedback ``(id, ts, status, useful, saved)``: the last given status, usefulness and saving count;
    reading sets read_at to its last time, seen_at to its first unless it was set."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    read = F.when(F.col("status") == "READ", F.col("ts"))
    f = feedback.groupBy("id").agg(last("status").alias("_s"), last("useful").alias("_u"), last("saved").alias("_v"), F.max(read).alias("_r"), F.min(read).alias("_f"))
    j = user_insights.join(f, "id", "left")
    new = {"status": F.coalesce("_s", "status"), "useful": F.coalesce("_u", "useful"), "saved": F.coalesce("_v", "saved"), "read_at": F.coalesce("_r", "read_at"), "seen_at": F.coalesce("seen_at", "_f")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in user_insights.columns])


def without_both_locales(insights: DataFrame, localizations: DataFrame, locales: list[str]) -> DataFrame:
    """Insights that lack a localization in any of ``locales``."""
    have = localizations.where(F.col("locale").isin(locales)).groupBy("insight_id").agg(F.count_distinct("locale").alias("_n"))
    return insights.join(have, "insight_id", "left").where(F.coalesce("_n", F.lit(0)) < len(locales)).drop("_n")


def catalog_topic(key: Column, catalog: list[str]) -> Column:
    k = F.lower(F.trim(key))
    old = F.create_map(*[F.lit(x) for kv in LEGACY_TOPICS.items() for x in kv])
    return F.when(k.isin(catalog), k).otherwise(F.try_element_at(old, k))


def reclassify(contents: DataFrame, event_links: DataFrame, user_insights: DataFrame, interests: DataFrame, catalog: list[str]) -> DataFrame:
    """Contents whose topics, by the interests of those who got them, differ from what they have: content -> event -> insight ->
    user insight -> interest. An insight's topics are gathered first, however many users got it."""
    by = user_insights.select("insight_id", "interest_id").distinct().join(interests.select("interest_id", "topic_key"), "interest_id")
    by = by.select("insight_id", catalog_topic(F.col("topic_key"), catalog).alias("topic")).where("topic is not null").distinct()
    by = event_links.join(by.groupBy("insight_id").agg(F.collect_set("topic").alias("_t")), "insight_id").select("event_id", "_t").distinct()
    t = contents.select("content_id", "event_id").join(by, "event_id").groupBy("content_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_t")))).alias("new_topics"))
    return contents.join(t, "content_id").where(F.sort_array("topics") != F.col("new_topics")).select("content_id", "topics", "new_topics")


def prepared_relevance(topic_hits: Column, refinements: Column, market_hits: Column, important: Column) -> Column:
    """Relevance of the prepared variant."""
    return clamp(0.4 * topic_hits + 0.35 * refinements + 0.2 * market_hits + 0.25 * important.cast("int"))


def prepared_matches(users: DataFrame, selections: DataFrame, contents: DataFrame, localizations: DataFrame, as_of: str, affected: DataFrame | None = None) -> DataFrame:
    """(user_id, content_id, relevance, score): publishable contents of the topics of ``selections(user_id, topic, refinements)`` that have a
    verified localization in the user's locale; with ``affected(user_id, topic)`` only those that also have one of these topics.
    Refinements, of all of a user's topics, count where the text holds them. Contents meet users by topics, texts meet
    distinct refinements once."""
    none = F.array().cast("array<string>")
    per = selections.groupBy("user_id").agg(F.collect_set("topic").alias("_topics"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("refinements", none)))).alias("keywords"))
    u = users.select("user_id", "locale", "home_market", F.coalesce("followed_markets", none).alias("followed_markets")).join(per, "user_id")
    c = publishable(contents)
    by = c.select("content_id", F.explode(F.array_distinct("topics")).alias("topic"))
    first = (selections if affected is None else affected).select("user_id", "topic").distinct().join(by, "topic").select("user_id", "content_id").distinct()
    shown = localizations.where("status = 'VERIFIED'").select("content_id", "locale").distinct()
    cols = c.select("content_id", "topics", "markets", "authority", "importance", "published_at")
    j = first.join(u, "user_id").join(cols, "content_id").join(shown, ["content_id", "locale"], "left_semi")
    topics = F.size(F.array_intersect("topics", "_topics"))
    places = F.size(F.array_intersect("markets", F.array_union(F.array("home_market"), "followed_markets")))
    j = j.where(topics > 0).join(keyword_hits(u.join(first.select("user_id").distinct(), "user_id", "left_semi"), c.join(first.select("content_id").distinct(), "content_id", "left_semi")), ["user_id", "content_id"], "left")
    j = j.withColumn("relevance", F.round(prepared_relevance(topics, F.coalesce("keyword_hits", F.lit(0)), places, F.coalesce(F.col("importance") >= GLOBAL_IMPORTANCE, F.lit(False))), 6))
    none_yet = F.lit(False)
    r = ranking_score(F.col("relevance"), F.lit(0), F.col("authority"), F.col("importance"), F.col("published_at"), F.lit(as_of).cast("timestamp"), F.col("markets"), F.col("home_market"), F.col("followed_markets"), none_yet, none_yet)
    return j.select("user_id", "content_id", "relevance", r["score"].alias("score"))


def maintain_matches(matches: DataFrame, users: DataFrame, selections: DataFrame, affected: DataFrame, contents: DataFrame, localizations: DataFrame, as_of: str) -> DataFrame:
    """The next ``matches(user_id, content_id, relevance, score, status)`` after users' selections have become ``selections``, ``affected(user_id,
    topic)`` being the topics that were added, removed or refined: contents of these topics are matched again, those that match no more
    expire, all other matches stay. What was only refined counts for the contents of its topic, as in the stored state."""
    new = prepared_matches(users, selections, contents, localizations, as_of, affected).select("user_id", "content_id", F.struct("relevance", "score").alias("_new"))
    by = contents.select("content_id", F.explode(F.array_distinct("topics")).alias("topic"))
    again = affected.select("user_id", "topic").distinct().join(by, "topic").select("user_id", "content_id").distinct().withColumn("_again", F.lit(True))
    j = matches.join(again, ["user_id", "content_id"], "left").join(new, ["user_id", "content_id"], "full")
    v = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c)
    return j.select("user_id", "content_id", v("relevance"), v("score"), F.when(F.col("_new").isNotNull(), "ACTIVE").when(F.col("_again"), "EXPIRED").otherwise(F.col("status")).alias("status"))


def alike(contents: DataFrame, texts: DataFrame, localizations: DataFrame, keywords: DataFrame) -> DataFrame:
    """(content_id, like): the smallest id of the contents that have the same topics, markets, importance and authority, hold the same of
    ``keywords(k)`` in their ``texts(content_id, title, content)`` and have verified localizations in the same locales. In ``prepared_matches``
    and ``maintain_matches`` contents of one ``like`` have the same users, relevance and status; only the score depends on their time too."""
    held = keywords_found(keywords, texts).groupBy("content_id").agg(F.sort_array(F.collect_set("token")).alias("_w"))
    shown = localizations.where("status = 'VERIFIED'").groupBy("content_id").agg(F.sort_array(F.collect_set("locale")).alias("_l"))
    c = contents.select("content_id", "topics", "markets", "importance", "authority").join(held, "content_id", "left").join(shown, "content_id", "left")
    c = c.select("content_id", F.md5(F.to_json(F.struct("topics", "markets", "importance", "authority", "_w", "_l"))).alias("_class"))
    return c.join(c.groupBy("_class").agg(F.min("content_id").alias("like")), "_class").select("content_id", "like")


def latest_ready_brief(briefs: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.col("brief_date").desc_nulls_last(), "brief_id")
    return briefs.where("status = 'READY'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def insight_users(user_insights: DataFrame) -> DataFrame:
    """Each user of an insight once: those whose briefs a new localization touches."""
    return user_insights.select("insight_id", "user_id").dropDuplicates()


def shadow_feeds(legacy: DataFrame, contents: DataFrame, localizations: DataFrame, newest: tuple[int, int] = (500, 1000)) -> DataFrame:
    """Both feeds for their comparison: v1 from the newest of ``legacy(id, content_id, url, publisher, published_at, created_at,
    relevance, localized, content_hash)``; v2 from the newest publishable contents that v1 has too and that have a verified
    localization of ``localizations(content_id, status, failure_codes)``; one that isn't verified without saying why blocks."""
    old = legacy.orderBy(F.col("created_at").desc(), "id").limit(newest[0])
    v1 = old.select(F.lit("v1").alias("feed"), F.col("id").cast("string").alias("id"), "url", "publisher", "published_at", "relevance", "localized", F.lit(False).alias("blocking_error"), F.col("content_hash").alias("duplicate_key"))
    new = contents.orderBy(F.col("published_at").desc(), "content_id").limit(newest[1]).join(old.select("content_id").distinct(), "content_id", "left_semi")
    bad = (F.col("status") != "VERIFIED") & (F.coalesce(F.size("failure_codes"), F.lit(0)) <= 0)
    loc = localizations.groupBy("content_id").agg(F.max(F.col("status") == "VERIFIED").alias("localized"), F.max(bad).alias("blocking_error"))
    v2 = new.join(loc.where("localized"), "content_id")
    return v1.unionByName(v2.select(F.lit("v2").alias("feed"), F.col("content_id").cast("string").alias("id"), "url", "publisher", "published_at", F.col("authority").alias("relevance"), "localized", "blocking_error", F.col("content_hash").alias("duplicate_key")))


def category_counts(user_insights: DataFrame, interests: DataFrame, categories: list[str]) -> DataFrame:
    """(user_id, category, n): a user's visible insights by the category of their interest (``interests(interest_id, category)``; other
    without one), every one of ``categories`` for each user, and ``all``: those of every category, listed or not."""
    of = user_insights.where("interest_id is not null").groupBy("user_id", "interest_id").agg(F.count("*").alias("n"))
    by = of.join(interests.select("interest_id", "category"), "interest_id", "left").groupBy("user_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.sum("n").alias("n"))
    total = by.groupBy("user_id").agg(F.sum("n").alias("n")).select("user_id", F.lit("all").alias("category"), "n")
    every = user_insights.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(c) for c in ["all", *categories]])).alias("category"))
    listed = by.where(F.col("category").isin(categories)).unionByName(total)
    return every.join(listed, ["user_id", "category"], "left").select("user_id", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
