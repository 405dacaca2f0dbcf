"""Audience matching, ranking, feeds and briefs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.automaton import containing
from newsloom.functions.scratch import written
from newsloom.functions.text import unicode_form

#: Weights of the ranking policy and of relevance (fixed values).
RANKING = {
    "interest_relevance": 0.22, "entity_relevance": 0.12, "source_authority": 0.13, "importance": 0.14, "freshness": 0.11, "home_market": 0.09,
    "followed_market": 0.05, "novelty": 0.08, "duplicate": -0.18, "stale": -0.12, "already_seen": -0.15,
}
RELEVANCE = {"topics": 0.25, "entities": 0.3, "keywords": 0.35, "markets": 0.2, "important": 0.4}
GLOBAL_IMPORTANCE = 0.8


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def token_hits(left: DataFrame, left_key: str, left_tokens: str, right: DataFrame, right_key: str, right_tokens: str, name: str) -> DataFrame:
    """Pairs whose token arrays overlap, with the number of shared tokens: both sides explode to
    tokens, meet in a hash join, and a pair's hits are counted."""
    a = left.select(left_key, F.explode(F.array_distinct(left_tokens)).alias("token"))
    b = right.select(right_key, F.explode(F.array_distinct(right_tokens)).alias("token"))
    return a.join(b, "token").groupBy(left_key, right_key).agg(F.count("*").alias(name))


def _normal(c: Column) -> Column:
    return F.trim(F.lower(unicode_form(c, "NFKC")))


def entity_hits(users: DataFrame, contents: DataFrame) -> DataFrame:
    """(user_id, content_id, entity_matches, first_entity): the content's entities that are among the user's, names and
    aliases, in normal form, and the first of them in the content's order."""
    a = users.select("user_id", F.explode("entities").alias("e")).where("e is not null").select("user_id", _normal(F.col("e")).alias("token")).distinct()
    b = contents.select("content_id", F.posexplode(F.array_distinct("entities")).alias("at", "e")).where("e is not null").select("content_id", "at", "e", _normal(F.col("e")).alias("token"))
    return a.join(b, "token").groupBy("user_id", "content_id").agg(F.count("*").alias("entity_matches"), F.min_by("e", "at").alias("first_entity"))


def keyword_hits(users: DataFrame, contents: DataFrame) -> DataFrame:
    """(user_id, content_id, keyword_hits): the user's watched keywords that the content's title or text contains, in
    normal form. Texts meet distinct keywords, not users."""
    a = users.select("user_id", F.explode(F.array_distinct("keywords")).alias("k")).where("trim(k) <> ''")
    return a.select("user_id", "k", _normal(F.col("k")).alias("token")).join(keywords_found(a, contents), "token").groupBy("user_id", "content_id").agg(F.count("*").alias("keyword_hits"))


def keywords_found(keywords: DataFrame, contents: DataFrame) -> DataFrame:
    """(token, content_id): the normal forms of ``keywords(k)`` that are not blank, and the contents whose title or text holds them."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    words = keywords.where("trim(k) <> ''").select(_normal(F.col("k")).alias("token")).distinct()
    return containing(words, contents.select("content_id", _normal(text).alias("text")), "content_id")


#: Profiles up to which a side of a join goes to all tasks; users in a block of one profile.
EVERYWHERE, BLOCK = 100_000, 2048


def everywhere(df: DataFrame, most: int = EVERYWHERE) -> DataFrame:
    """``df``, sent to all tasks if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _watching(users: DataFrame) -> DataFrame:
    """(user_id, _e, _k): the normal forms of a user's entities, and of each of their keywords."""
    parts = []
    if "entities" in users.columns:
        parts.append(users.select("user_id", F.explode("entities").alias("e")).where("e is not null").select("user_id", _normal(F.col("e")).alias("e"), F.lit(None).cast("string").alias("k")))
    if "keywords" in users.columns:
        parts.append(users.select("user_id", F.explode(F.array_distinct("keywords")).alias("k")).where("trim(k) <> ''").select("user_id", F.lit(None).cast("string").alias("e"), _normal(F.col("k")).alias("k")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("user_id").agg(F.collect_set("e").alias("_e"), F.collect_list("k").alias("_k"))


def _mentioned(contents: DataFrame, texts: DataFrame | None, watching: DataFrame) -> DataFrame | None:
    """(content_id, _named, _words): a content's entities (place, name, normal form) and the keywords that its text contains, of those
    that anyone watches."""
    none = F.lit(None).cast("struct<at:int,e:string,token:string>")
    parts = []
    if "entities" in contents.columns:
        wanted = watching.select(F.explode("_e").alias("token")).distinct()
        e = contents.select("content_id", F.posexplode(F.array_distinct("entities")).alias("at", "e")).where("e is not null").select("content_id", "at", "e", _normal(F.col("e")).alias("token"))
        parts.append(e.join(wanted, "token", "left_semi").select("content_id", F.struct("at", "e", "token").alias("x"), F.lit(None).cast("string").alias("w")))
    if texts is not None:
        text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
        found = containing(watching.select(F.explode("_k").alias("token")).distinct(), texts.select("content_id", _normal(text).alias("text")), "content_id")
        parts.append(found.select("content_id", none.alias("x"), F.col("token").alias("w")))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("content_id").agg(F.array_sort(F.collect_set("x")).alias("_named"), F.collect_set("w").alias("_words"))


def candidates_any(users: DataFrame, contents: DataFrame, texts: DataFrame | None = None, carry: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> DataFrame:
    """Content that any one reason gives a user: a shared topic, entity, keyword or market, or importance to all.
    (user_id, content_id, hits of each kind, relevance, first_entity). Entities and keywords are read where both tables have them
    (``entities``; ``keywords`` and the content's ``title`` and ``content``, or those of ``texts``, which can be another table of the contents).
    ``carry`` names columns of users and of contents to keep.

    What a content mentions becomes part of its row; contents that mention the same are one class. Classes meet users by the keys of all
    kinds, a pair of them being formed at the first key that both have, and contents are joined to the result. So no pair of a user and a
    content is shuffled, joined or summed again."""
    full = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    both = lambda name: name in users.columns and name in contents.columns
    words = "keywords" in users.columns and {"title", "content"} <= set((contents if texts is None else texts).columns)
    u = users.select("user_id", full(F.col("interests")).alias("_i"), full(F.array_distinct(F.concat(F.array("home_market"), F.coalesce("followed_markets", none)))).alias("_w"), *carry[0])
    c = contents.select("content_id", full(F.col("topics")).alias("_t"), full(F.col("markets")).alias("_m"), F.coalesce(F.col("importance") >= GLOBAL_IMPORTANCE, F.lit(False)).alias("globally_important"), *carry[1])
    if both("entities") or words:
        watching = _watching(users.select("user_id", *[x for x, on in (("entities", both("entities")), ("keywords", words)) if on]))
        mentioned = _mentioned(contents if both("entities") else contents.select("content_id"), (contents if texts is None else texts) if words else None, watching)
        u, c = u.join(watching, "user_id", "left"), c.join(mentioned, "content_id", "left")
    else:
        u = u.withColumns({"_e": none, "_k": none})
        c = c.withColumns({"_named": F.array().cast("array<struct<at:int,e:string,token:string>>"), "_words": none})
    u = u.withColumns({"_e": full(F.col("_e")), "_k": full(F.col("_k"))})
    c = c.withColumn("_named", F.coalesce("_named", F.array().cast("array<struct<at:int,e:string,token:string>>"))).withColumn("_words", F.array_sort(full(F.col("_words"))))
    reasons = ["_t", "_m", "globally_important", "_named", "_words"]
    c = written(c.withColumn("_class", F.md5(F.to_json(F.struct(*reasons)))))
    spark = c.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # classes are few rows that become many
    hits = _class_hits(u, c.select("_class", *reasons).dropDuplicates(["_class"]).repartition(tasks), carry[0])
    return c.select("content_id", "_class", *carry[1]).join(hits, "_class").select("user_id", "content_id", "topic_hits", "market_hits", "globally_important", "entity_matches", "keyword_hits", "relevance", "first_entity", *carry[0], *carry[1])


def _class_hits(u: DataFrame, c: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Hits of users and classes of contents that mention the same."""
    key = lambda kind, xs: F.transform(xs, lambda x: F.xxhash64(F.lit(kind), x))
    u = u.withColumn("_uk", F.array_distinct(F.concat(key("t", "_i"), key("m", "_w"), key("e", "_e"), key("k", "_k"), F.array(F.xxhash64(F.lit("all"))))))
    important = F.when(F.col("globally_important"), F.array(F.xxhash64(F.lit("all")))).otherwise(F.array().cast("array<bigint>"))
    c = c.withColumn("_ck", F.array_distinct(F.concat(key("t", "_t"), key("m", "_m"), key("e", F.transform("_named", lambda x: x.token)), key("k", "_words"), important)))
    pairs = c.withColumn("_key", F.explode("_ck")).join(everywhere(u).withColumn("_key", F.explode("_uk")), "_key").where(F.col("_key") == F.get(F.array_intersect("_uk", "_ck"), F.lit(0)))
    named = F.filter("_named", lambda x: F.array_contains(F.col("_e"), x.token))
    pairs = pairs.withColumns({
        "topic_hits": F.size(F.array_intersect("_i", "_t")).cast("long"), "market_hits": F.size(F.array_intersect("_w", "_m")).cast("long"), "_hit": named,
        "keyword_hits": F.size(F.filter("_k", lambda k: F.array_contains(F.col("_words"), k))).cast("long"),
    }).withColumn("entity_matches", F.size("_hit").cast("long"))
    # keys are digests: a pair that only equal digests made has no reason
    pairs = pairs.where((F.col("topic_hits") + F.col("market_hits") + F.col("entity_matches") + F.col("keyword_hits") > 0) | F.col("globally_important"))
    w = RELEVANCE
    score = w["topics"] * F.col("topic_hits") + w["entities"] * F.col("entity_matches") + w["keywords"] * F.col("keyword_hits") + w["markets"] * F.col("market_hits") + w["important"] * F.col("globally_important").cast("int")
    return pairs.select("_class", "user_id", "topic_hits", "market_hits", "globally_important", "entity_matches", "keyword_hits", F.round(F.least(F.lit(1.0), score), 6).alias("relevance"), F.get("_hit", F.lit(0)).e.alias("first_entity"), *carry)


#: What a user's candidates and scores depend on.
PROFILE = ["locale", "interests", "home_market", "followed_markets", "entities", "keywords"]


def profiles(users: DataFrame) -> DataFrame:
    """The distinct profiles of users, with a hash of the profile as user_id. Users of one profile match and rank alike,
    so that matching and ranking are done once a profile, and users joined to the result."""
    cols = [c for c in PROFILE if c in users.columns]
    return users.select(*cols).distinct().withColumn("user_id", F.xxhash64(*cols))


def to_users(result: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of ``result(user_id of a profile, ...)`` for each user of the profile."""
    cols = [c for c in PROFILE if c in users.columns]
    return result.withColumnRenamed("user_id", "_p").join(users.select("user_id", F.xxhash64(*cols).alias("_p")), "_p").drop("_p")


def pairs_to_users(result: DataFrame, users: DataFrame, most: int = 8_000_000, size: int = BLOCK) -> DataFrame:
    """As ``to_users``, for results of many rows a profile and content_id: the users of a profile come as blocks of up to about ``size`` ids,
    which go to all tasks up to ``most`` users, so that no pair of a user is shuffled. Rows of a profile (once a block) are brought together
    first: what spreads them is a stage of its own, however much made them, and a file that it writes has the ids of few blocks, which
    repeat in one order."""
    cols = [c for c in PROFILE if c in users.columns]
    u = users.select("user_id", F.xxhash64(*cols).alias("_p"))
    few = u.limit(most + 1).count() <= most
    n = u.groupBy("_p").agg(F.ceil(F.count("*") / size).alias("_n"))
    blocks = u.join(F.broadcast(n) if few else n, "_p").groupBy("_p", F.pmod(F.xxhash64("user_id"), F.col("_n")).alias("_x")).agg(F.collect_list("user_id").alias("_users"))
    out = result.withColumnRenamed("user_id", "_p")
    if few:
        spark = result.sparkSession
        blocks = written(blocks)
        tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        out = out.join(F.broadcast(blocks.select("_p", "_x")), "_p").repartitionByRange(tasks, "_p", "_x", "content_id").sortWithinPartitions("_p", "_x")
        out = out.join(F.broadcast(blocks), ["_p", "_x"])
    else:
        out = out.join(blocks, "_p")
    return out.withColumn("user_id", F.explode("_users")).drop("_p", "_x", "_users")


def latest_localization(localizations: DataFrame) -> DataFrame:
    """The verified localization of each content and locale that was verified last (without a time first), ties by id."""
    order = Window.partitionBy("content_id", "locale").orderBy(F.col("verified_at").desc_nulls_first(), "localization_id")
    return localizations.where("status = 'VERIFIED'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def publishable(contents: DataFrame) -> DataFrame:
    """Verified contents that are no duplicates."""
    return contents.where((F.col("provenance_status") == "VERIFIED") & F.col("duplicate_of_id").isNull())


def first_of_cluster(ranked: DataFrame) -> DataFrame:
    """Each user's best item of a cluster; an item without cluster stands for itself."""
    key = F.coalesce("cluster_id", F.concat(F.lit("content:"), F.col("content_id").cast("string")))
    order = Window.partitionBy("user_id", key).orderBy(F.col("score").desc(), "content_id")
    return ranked.withColumn("_c", F.row_number().over(order)).where("_c = 1").drop("_c")


def best(ranked: DataFrame, depth: int) -> DataFrame:
    """Each user's ``depth`` best items by score, then content_id. Items are counted by user and thousandth of the score first; only those
    of the thousandths that hold the best are ordered."""
    step = F.floor(F.col("score") * 1000)
    n = ranked.groupBy("user_id", step.alias("_s")).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("user_id").orderBy(F.col("_s").desc()))
    cut = n.withColumn("_above", above - F.col("_n")).where(F.col("_above") < depth).groupBy("user_id").agg(F.min("_s").alias("_cut"))
    order = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "content_id")
    near = ranked.join(everywhere(cut), "user_id").where(step >= F.col("_cut")).drop("_cut")
    return near.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= depth).drop("_b")


def showable(contents: DataFrame, localizations: DataFrame) -> DataFrame:
    """Publishable contents with ``shown``: the latest verified localization by locale. Those without any go."""
    loc = latest_localization(localizations).groupBy("content_id").agg(F.map_from_entries(F.collect_list(F.struct("locale", "localization_id"))).alias("shown"))
    return publishable(contents).join(loc, "content_id")


def selected(ranked: DataFrame, depth: int) -> DataFrame:
    """Of ranked (user, content) pairs with ``locale`` of the user, ``shown`` (see ``showable``) and ``cluster_id`` of the content those with a
    localization in the user's locale; the ``depth`` best of a user, then one a cluster. With localization_id."""
    r = ranked.withColumn("localization_id", F.try_element_at("shown", F.col("locale"))).where("localization_id is not null").drop("shown", "breakdown")
    return first_of_cluster(best(r, depth))


def cluster_sizes(contents: DataFrame) -> DataFrame:
    """(cluster_id, cluster_size)."""
    return contents.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))

def ranking_score(relevance: Column, entity_matches: Column, authority: Column, importance: Column, published_at: Column, as_of: Column, markets: Column, home: Column, followed: Column, duplicate: Column, seen: Column) -> Column:
    """Eleven weighted components and the score, as one struct. The score has six places; what is halfway but for
    the error of doubles rounds up."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(published_at)) / 3.6e9)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = {
        "interest_relevance": clamp(relevance), "entity_relevance": F.least(F.lit(1.0), entity_matches / 2), "source_authority": clamp(authority), "importance": clamp(importance),
        "freshness": F.greatest(F.lit(0.0), 1 - age / 72), "home_market": one(F.array_contains(markets, home)), "followed_market": one(F.arrays_overlap(markets, followed)),
        "novelty": one(~seen), "duplicate": one(duplicate), "stale": one(age > 168), "already_seen": one(seen),
    }
    plus = sum((v * RANKING[k] for k, v in parts.items() if RANKING[k] > 0), F.lit(0.0))
    minus = sum((v * -RANKING[k] for k, v in parts.items() if RANKING[k] < 0), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in parts.items()], F.round(F.greatest(F.lit(0.0), plus - minus) + 1e-9, 6).alias("score"))


#: What ranking reads of a user and of a content; matches that carry these columns aren't joined again.
RANKED_BY = (("home_market", "followed_markets"), ("publisher", "topics", "markets", "authority", "importance", "published_at"))


def rank(matches: DataFrame, users: DataFrame, contents: DataFrame, as_of: str) -> DataFrame:
    """Scores of (user, content) matches; nothing is duplicate or seen unless a column says so."""
    need = [[c for c in cols if c not in matches.columns] for cols in (RANKED_BY[1], RANKED_BY[0])]
    m = matches.join(contents.select("content_id", *need[0]), "content_id") if need[0] else matches
    m = m.join(users.select("user_id", *need[1]), "user_id") if need[1] else m
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in matches.columns else F.lit(False)
    entities = F.col("entity_matches") if "entity_matches" in matches.columns else F.lit(0)
    r = ranking_score(F.col("relevance"), entities, F.col("authority"), F.col("importance"), F.col("published_at"), F.lit(as_of).cast("timestamp"), F.col("markets"), F.col("home_market"), F.col("followed_markets"), flag("duplicate"), flag("already_seen"))
    return m.withColumn("breakdown", r).withColumn("score", F.col("breakdown.score"))


def diversify(ranked: DataFrame, limit: int, per_publisher: int, per_topic: int, depth: int, user: str = "user_id") -> DataFrame:
    """Greedy top-k of each user: by score, then content_id; an item is skipped if its publisher or
    topic (``other`` without one) has its number already. The ``depth`` best of a user are looked at, sorted within partitions and
    read once, with counters of one user at a time."""
    order = Window.partitionBy(user).orderBy(F.col("score").desc(), "content_id")
    top = ranked.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= depth)
    top = top.select(user, F.col("content_id").cast("long").alias("content_id"), F.col("score").cast("double").alias("score"), F.col("publisher").cast("string").alias("publisher"), F.coalesce(F.col("topic").cast("string"), F.lit("other")).alias("topic"), "_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, who, n, seen = True, None, 0, {}
        for b in batches:
            keep, places = [], []
            for i, (u, publisher, topic) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if first or u != who:
                    first, who, n, seen = False, u, 0, {}
                p, t = ("p", publisher), ("t", topic)
                if n < limit and seen.get(p, 0) < per_publisher and seen.get(t, 0) < per_topic:
                    keep.append(i)
                    places.append(n)
                    n += 1
                    seen[p], seen[t] = seen.get(p, 0) + 1, seen.get(t, 0) + 1
            at = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([at.column(0), pa.array(places, pa.int32()), *[at.column(k) for k in range(1, 5)]], names=[user, "position", "content_id", "score", "publisher", "topic"])

    kind = ranked.schema[user].dataType.simpleString()
    return top.repartition(user).sortWithinPartitions(user, "_place").mapInArrow(run, f"{user} {kind}, position int, content_id long, score double, publisher string, topic string")


def app_category(topics: Column) -> Column:
    """First rule that fits; the pattern rules ignore case, the others don't."""
    any_of = lambda words: F.exists(topics, lambda t: F.rlike(t, F.lit(f"(?i)^({'|'.join(words)})$")))
    has = lambda w: F.array_contains(topics, w)
    return (
        F.when(any_of(["economy", "finance", "investments"]), "investments").when(any_of(["technology", "work", "jobs"]), "work")
        .when(has("health"), "health").when(has("sports"), "sports").when(has("travel"), "travel").when(any_of(["entertainment", "movies"]), "entertainment").otherwise("other")
    )


def relevance_sentence(first_entity: Column, first_topic: Column, locale: Column) -> Column:
    what = F.coalesce(first_entity, first_topic)
    vi = F.when(what.isNotNull(), F.concat(F.lit("Phù hợp vì anh theo dõi "), what, F.lit("."))).otherwise("Nội dung quan trọng toàn cầu.")
    en = F.when(what.isNotNull(), F.concat(F.lit("Relevant because you follow "), what, F.lit("."))).otherwise("Globally important content.")
    return F.when(locale == "vi", vi).otherwise(en)


def feed_items(feed: DataFrame, contents: DataFrame, users: DataFrame, localizations: DataFrame, as_of: str) -> DataFrame:
    """Feed rows ``(user_id, position, content_id, score, publisher, first_entity, localization_id)`` with what a client
    shows: localized title, category, type, age, staleness, cluster size, and why: the first entity that matched, else the
    item's first topic that the user follows, if any."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("published_at")) / 3.6e9
    out = feed.join(contents.select("content_id", "topics", "importance", "published_at", "cluster_id"), "content_id").join(users.select("user_id", "locale", "interests"), "user_id")
    out = out.join(localizations.select("localization_id", "title"), "localization_id").join(cluster_sizes(contents), "cluster_id", "left")
    said = F.get(F.array_intersect("topics", "interests"), F.lit(0))
    return out.select(
        "user_id", "position", "content_id", "score", "publisher", F.coalesce(F.get("topics", F.lit(0)), F.lit("")).alias("topic_name"), app_category(F.col("topics")).alias("category"),
        F.when(F.col("importance") >= GLOBAL_IMPORTANCE, "important").otherwise("informational").alias("type"), "title", F.coalesce("cluster_size", F.lit(1)).cast("long").alias("sources"),
        F.round(F.greatest(F.lit(0.0), age), 1).alias("age_hours"), (age > 168).alias("stale"), relevance_sentence(F.col("first_entity"), said, F.col("locale")).alias("reason"),
    )


def encode_cursor(content_id: Column, score: Column) -> Column:
    """Base64url JSON of the row that a page ends with."""
    text = F.concat(F.lit('{"id":"'), content_id.cast("string"), F.lit('","score":'), F.call_function("format_number", score, F.lit("0.######")), F.lit("}"))
    return F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/", "-_"), "[=\r\n]", "")


def page_after(feed: DataFrame, cursors: DataFrame, size: int) -> DataFrame:
    """The page of each (user_id, cursor_id, cursor_score): rows after the one with the same id and score;
    null ids start at the top; a cursor that is no row of the feed gives error INVALID_CURSOR."""
    c = cursors.select("user_id", "cursor_id", "cursor_score")
    at = feed.select("user_id", F.col("content_id").alias("cursor_id"), F.col("score").alias("cursor_score"), F.col("position").alias("at"))
    found = c.join(at, ["user_id", "cursor_id", "cursor_score"], "left")
    found = found.withColumn("error", F.when(F.col("cursor_id").isNotNull() & F.col("at").isNull(), "INVALID_CURSOR")).withColumn("at", F.coalesce("at", F.lit(-1)))
    rows = found.where("error is null").join(feed, "user_id").where((F.col("position") > F.col("at")) & (F.col("position") <= F.col("at") + size))
    return rows.select("user_id", "position", "content_id", "score", F.lit(None).cast("string").alias("error")).unionByName(
        found.where("error is not null").select("user_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("long").alias("content_id"), F.lit(None).cast("double").alias("score"), "error")
    )


def decode_cursor(cursor: Column) -> Column:
    """(cursor_id, cursor_score) of a cursor; nulls for what isn't one."""
    text = F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8")
    x = F.from_json(text, "struct<id:string,score:double>")
    return F.struct(x.id.try_cast("bigint").alias("id"), x.score.alias("score"))


def rebuilt_briefs(items: DataFrame, built: DataFrame, versions: DataFrame) -> DataFrame:
    """Items of the briefs whose input version isn't that of ``built(user_id, input_version)``: these replace the older ones
    whole, the others stay as they are. ``versions`` is ``brief_version`` of the items."""
    new = versions.select("user_id", "input_version").join(built.select("user_id", "input_version"), ["user_id", "input_version"], "left_anti")
    return items.join(new, "user_id")


def brief_version(items: DataFrame, user: str = "user_id") -> DataFrame:
    """SHA-256 over a user's sorted ``id:score:updated`` texts, so that an unchanged brief isn't rebuilt."""
    text = F.concat_ws(":", F.col("content_id").cast("string"), F.call_function("format_number", F.col("score"), F.lit("0.######")), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
    return items.groupBy(user).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "|"), 256).alias("input_version"), F.count("*").alias("n_items"))


def newest_of_interest(items: DataFrame, n: int = 80) -> DataFrame:
    """Of ``items(interest, content_id, published_at)`` each interest's ``n`` newest; of equal times the smaller content_id first."""
    order = Window.partitionBy("interest").orderBy(F.col("published_at").desc(), "content_id")
    return items.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= n).drop("_i")


def round_robin(items: DataFrame, as_of: str, limit: int = 10, candidates: int = 80) -> DataFrame:
    """The older brief: each user's newest ``candidates`` items in buckets by interest; a bucket with an item of
    the last 48 hours keeps only such; buckets give one item in turn, in the order of their newest item."""
    newest = Window.partitionBy("user_id").orderBy(F.col("published_at").desc(), "content_id")
    top = items.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= candidates)
    fresh = F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr("interval 48 hours")
    bucket = Window.partitionBy("user_id", "interest")
    top = top.withColumn("_fresh", fresh).withColumn("_any", F.max(F.col("_fresh").cast("int")).over(bucket)).withColumn("_b", F.min("_n").over(bucket))
    top = top.where((F.col("_any") == 0) | F.col("_fresh"))
    top = top.withColumn("_r", F.row_number().over(bucket.orderBy("_n")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("_r", "_b"))
    return top.withColumn("position", place).where(F.col("position") <= limit).select("user_id", "position", "interest", "content_id", "published_at")


def sections(items: DataFrame, version: str = "v2") -> DataFrame:
    """Items of briefs by ``position`` (from 0) with their place and section: v2 counts from 0, the first three are important; v1
    counts from 1, important is what has an importance of .75 or more, else other."""
    if version == "v1":
        return items.withColumns({"section": F.when(F.col("importance") >= 0.75, "important").otherwise("other"), "position": F.col("position") + 1})
    return items.withColumn("section", F.when(F.col("position") < 3, "important").otherwise("more"))
