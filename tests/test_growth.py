"""Steps that must not grow faster than their input, on small cases."""

import datetime as dt
import math
import random
import re

import pandas as pd
import pyarrow as pa
from newsloom.functions import text as t
from newsloom.operators import insights, ledger, matching, metrics, resolve
from newsloom.plans import audience, views
from newsloom.sources import articles, canonical
from pyspark.sql import functions as F
from test_operators import _brute_duplicates, _hashes, _item


def test_lunar_days_meet_one_row_of_the_calendar(spark):
    """As by going through the whole calendar: later on the same day, before its start, beyond its end, no day listed."""
    first = dt.date(2026, 2, 1)
    days = [(first + dt.timedelta(days=k), "Z", k % 29 + 1) for k in range(90)]
    cal = spark.createDataFrame(days, "date date, zone string, lunar_day int")
    t = lambda *a: dt.datetime(2026, *a)
    rules = [
        (1, [1], "Z", t(12, 1), t(2, 1, 8), t(2, 1, 9)), (2, [1], "Z", t(12, 1), t(2, 1, 9), t(2, 1, 9)), (3, [3, 2], "Z", t(12, 1), t(1, 2), t(1, 2)), (4, [5], "Z", t(12, 1), t(6, 1), t(6, 1)),
        (5, [], "Z", t(12, 1), t(2, 1), t(2, 1)), (6, [1], "other", t(12, 1), t(2, 1), t(2, 1)), (7, [15, 1], "Z", t(2, 10), t(2, 2), t(2, 2)), (8, [29], "Z", t(12, 1), t(4, 28, 23, 30), t(1, 1, 5)), (9, [2], "Z", t(12, 1), None, t(2, 1)),
    ]
    df = spark.createDataFrame(rules, "rule_id int, lunar_days array<int>, zone string, until timestamp, after timestamp, preferred timestamp")
    def plain(lunar, zone, until, after, preferred):
        at = [dt.datetime.combine(d, preferred.time()) for d, z, n in days if z == zone and n in lunar]
        later = min((x for x in at if after is not None and x > after), default=None)
        return later if later is not None and later <= until else None

    out = ledger.next_lunar(df, cal)
    assert {r.rule_id: r.next_at for r in out.collect()} == {r[0]: plain(*r[1:]) for r in rules}


def test_rounds_of_the_older_brief_are_made_once_for_equal_interests(spark):
    c = spark.range(2000).select(F.col("id").alias("content_id"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 3) * 60).alias("published_at"), F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))).alias("topics"))
    u = spark.range(40).select(F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("t0"), F.lit("t1"))).otherwise(F.array(F.lit("t2"))).alias("interests"))
    now = "2024-01-01 12:00:00"
    pairs = u.select("user_id", F.explode("interests").alias("interest")).join(c.select("content_id", "published_at", F.get("topics", F.lit(0)).alias("interest")), "interest")
    key = lambda df: sorted((r.user_id, r.position, r.content_id, r.interest) for r in df.collect())
    assert key(audience.older_brief(u, c, now)) == key(matching.round_robin(pairs, now))
    assert matching.newest_of_interest(c.select("content_id", "published_at", F.get("topics", F.lit(0)).alias("interest"))).count() == 240


def test_what_contents_mention_is_matched_once_a_class(spark):
    """As one by one: two contents that mention the same, one without anything, entities and keywords that normalise alike."""
    u = spark.createDataFrame([(1, "VN", ["US"], ["health"], ["ACME", "acme "], ["Rate", "rate"]), (2, None, None, None, None, None)], "user_id long, home_market string, followed_markets array<string>, interests array<string>, entities array<string>, keywords array<string>")
    rows = [(1, ["health"], ["CN"], 0.1, ["Acme"], "t", "a RATE"), (2, ["health"], ["CN"], 0.1, ["Acme"], "other", "rate"), (3, [], [], 0.1, [], "t", "x"), (4, [], [], 0.9, None, None, None)]
    c = spark.createDataFrame(rows, "content_id long, topics array<string>, markets array<string>, importance double, entities array<string>, title string, content string")
    got = sorted((r.user_id, r.content_id, r.topic_hits, r.entity_matches, r.keyword_hits, r.relevance, r.first_entity) for r in matching.candidates_any(u, c).collect())
    assert got == [(1, 1, 1, 1, 2, 1.0, "Acme"), (1, 2, 1, 1, 2, 1.0, "Acme"), (1, 4, 0, 0, 0, 0.4, None), (2, 4, 0, 0, 0, 0.4, None)]


def test_best_orders_only_what_can_be_among_the_best(spark):
    r = spark.range(3000).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("content_id"), (F.floor(F.col("id") / 7) % 400 / 400).alias("score"))
    plain = {u: sorted(((-x.score, x.content_id) for x in r.collect() if x.user_id == u))[:50] for u in (0, 1)}
    got = {u: sorted((-x.score, x.content_id) for x in matching.best(r, 50).collect() if x.user_id == u) for u in (0, 1)}
    assert got == plain and matching.best(r, 5000).count() == 3000


def test_pairs_reach_each_user_of_a_profile(spark):
    u = spark.range(100).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, "vi").otherwise("en").alias("locale"))
    pairs = matching.profiles(u).withColumn("content_id", F.explode(F.array(F.lit(1), F.lit(2))))
    for most in (1000, 10):
        assert sorted(tuple(x) for x in matching.pairs_to_users(pairs.select("user_id", "content_id"), u, most).select("user_id", "content_id").collect()) == sorted((k, c) for k in range(100) for c in (1, 2))


def test_topics_by_insights_that_many_users_got(spark):
    c = spark.createDataFrame([(1, 1, ["health"]), (2, 2, ["health"]), (3, 3, ["travel"])], "content_id int, event_id int, topics array<string>")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "event_id int, insight_id int")
    got = spark.range(200_000).select((F.col("id") % 2 + 10).cast("int").alias("insight_id"), F.when(F.col("id") % 2 == 0, 5).otherwise(6).cast("int").alias("interest_id"))
    q = spark.createDataFrame([(5, " Health"), (6, "openai"), (7, "none")], "interest_id int, topic_key string")
    out = {r.content_id: r.new_topics for r in insights.reclassify(c, links, got, q, ["health", "technology"]).collect()}
    assert out == {1: ["health", "technology"]}


def test_pair_queries_have_the_markets_and_importance_they_had(spark):
    c, u = views.contents(spark, "/root/testdata/sf0.001", True), views.users(spark, "/root/testdata/sf0.001", True)
    assert {r[0] for r in c.select(F.explode("markets")).distinct().collect()} == {r[0] for r in u.select("home_market").distinct().collect()} == {"VN", "GLOBAL", "US", "CN"}
    assert c.where("tier = 1 and importance <> 1.0").count() == 0
    for name in ("match_candidates", "rank_breakdown", "feed_v2", "rollout_matches"):
        assert "'BR'" not in audience.ORACLE_SQL[name] and "content_id % 7 = 0 THEN 1.0" not in audience.ORACLE_SQL[name]


def test_freshness_of_feeds_rounds_as_doubles(spark):
    seconds = [522, 1026, 2034, 3600]
    for s in seconds:
        i = spark.range(1).select(F.lit("v1").alias("feed"), F.lit("1").alias("id"), F.lit("https://a.org/1").alias("url"), F.lit("p").alias("publisher"), (F.lit("2024-03-01").cast("timestamp") - F.make_interval(secs=F.lit(s).cast("decimal(18,6)"))).alias("published_at"), F.lit(0.5).alias("relevance"), F.lit(True).alias("localized"), F.lit(False).alias("blocking_error"), F.lit("k").alias("duplicate_key"))
        assert metrics.compare_feeds(i, "2024-03-01 00:00:00").first().v1_freshness_hours == math.floor(s / 3600 * 100 + 0.5) / 100


def test_cluster_keys_dont_multiply_titles_by_entities(spark):
    """Long titles and many entities, most of them had by one item alone; whatever counts as common, alike items share a key."""
    g = random.Random(3)
    rows = []
    for k in range(60):
        title = g.sample([f"title{n}" for n in range(400)], 150) if k % 2 else [f"title{n}" for n in range(40 + k % 5)]
        entities = ["Hot", *(g.sample([f"E{n}" for n in range(300)], 100) if k % 2 else [f"E{n}" for n in range(12)])]
        rows.append((str(k), "2026-01-01", entities, ["a", "b"], title))
    f = spark.createDataFrame(rows, "features string, day string, entities array<string>, topics array<string>, title_tokens array<string>")
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    alike = [(a[0], b[0]) for a in rows for b in rows if a < b and 0.45 * share(a[2], b[2]) + 0.2 + 0.35 * share(a[4], b[4]) >= resolve.CLUSTER]
    assert len(alike) > 100
    for common in (0, 3, 100):
        keys = {r.features: set(r["keys"]) for r in resolve.cluster_keys(f, common).collect()}
        assert all(keys[a] & keys[b] for a, b in alike)
    assert max(map(len, keys.values())) < 150 + 101  # 40 * 150 and more when each entity met each title token


def test_facts_are_sought_where_they_can_be(spark, monkeypatch):
    """The same facts as by looking for every kind everywhere; nothing is sought in texts that can't hold it."""
    g = random.Random(5)
    bits = ["12/08/2026", "2026-08-14T07:00Z", "$5 million", "usd 7", "9 TỶ đồng", "25 %", "+1,5%", "gpt-4.1", "IPHONE 14 Pro", "ios 1", "İOS 2", "v1.2", "Version\n3.4", "12", "7.5", "a1", "1b", "__3", "x", "Ủy 4", "đ5", ".", " ", "\n", "-", "$", "%"]
    texts = [(k, "".join(g.choice(bits) + g.choice(["", " ", ", "]) for _ in range(g.randrange(12)))) for k in range(400)] + [(400, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    now = dict(df.select("id", t.facts(F.col("text"))).collect())
    monkeypatch.setattr(t, "NEEDS", dict.fromkeys(t.NEEDS, ""))
    monkeypatch.setattr(t, "FIRST", {})
    every = dict(df.select("id", t.facts(F.concat("text", F.lit(" zz 99")))).collect())
    assert now[400] is None and {f.kind for x in now.values() for f in x or []} == {k for k, _ in t.FACTS}
    assert all([f for f in x if f.start < len(s)] == now[k] for (k, s), x in zip(texts, (every[k] for k, _ in texts), strict=True) if s is not None and not re.search(r"[\w$%]\s*$|\d\s*$|[+-]$", s))


def test_trimming_and_blanks_equal_patterns(spark):
    """What is trimmed by characters and what runs become, against the plain patterns."""
    g = random.Random(9)
    rows = [(k, "".join(g.choice(["a", "ủ", " ", " ", "\t", "\n", "\xa0", " ", "​", "　", "﻿", "\x0b", "\r"]) for _ in range(g.randrange(14)))) for k in range(500)]
    c = F.col("text")
    df = spark.createDataFrame([*rows, (500, None)], "id long, text string")
    old = lambda x: F.regexp_replace(x, f"^{t.JS_S}+|{t.JS_S}+$", "")
    got = df.select(t.js_trim(c).alias("a"), old(c).alias("b"), t.compact(c).alias("c"), old(F.regexp_replace(c, f"{t.JS_S}+", " ")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


def test_a_text_with_many_variants_has_few_keys_a_row(spark):
    """A text that returns daily, with another variant of it each day: a row has the keys of variants near it in time."""
    words = [f"word{chr(97 + k)}" for k in range(26)]
    first, rows = dt.datetime(2026, 1, 1), []
    for k in range(80):
        more = f"more{chr(97 + k // 26)}{chr(97 + k % 26)}"
        rows += [_item(2 * k + n, first + dt.timedelta(days=k, hours=n), " ".join(w), title="") for n, w in enumerate((words, [*words, more]))]
    df = spark.createDataFrame(pd.DataFrame(rows))
    keys = resolve.near_keys(resolve._features(df, True)).distinct().groupBy("id").count().collect()
    assert len(keys) == 160 and max(r["count"] for r in keys) <= 6  # up to 80 when rows had the keys of all variants
    got = {r.id: r.duplicate_of_id is not None and (r.duplicate_of_id, r.duplicate_kind) or None for r in resolve.resolve_duplicates(df).collect()}
    assert got == _brute_duplicates(rows, _hashes(df))


def test_an_arrival_asks_survivors_in_its_span_only():
    """Survivors of one key that lie days apart: the work of an arrival doesn't grow with their number."""
    def asked(n):
        fold, count = resolve.Arrivals(), [0]

        class Key(dict):
            def __getitem__(self, name):
                count[0] += name == "kind"
                return super().__getitem__(name)

        for k in range(n):
            fold.row(k, k * 4 * resolve.DAY, [{"key": "x", "side": -1, "span": 3 * resolve.DAY, "kind": 2, "score": 1.0}], {"old": True, "place": {"p": k * 4 * resolve.DAY, "c": 0, "i": k}})
        at = 4 * resolve.DAY * (n // 2) + 5
        fold.row(n, at, [Key(key="x", side=-1, span=3 * resolve.DAY, kind=2, score=1.0)], {"old": False, "place": {"p": at, "c": 0, "i": n}})
        assert fold.rest() == [(n, n // 2, 2, 1.0)]
        fold.row(n + 1, at - 10, [{"key": "x", "side": -1, "span": 3 * resolve.DAY, "kind": 2, "score": 1.0}], {"old": False, "place": {"p": at - 10, "c": 0, "i": n + 1}})
        assert dict((x[0], x[1]) for x in fold.rest())[n // 2] == n + 1
        return fold, count[0]

    assert asked(400)[1] == asked(20)[1]


def test_versions_are_read_without_datetimes():
    """Times pass as numbers and come back as the same times."""
    at = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999, tzinfo=dt.UTC), None, dt.datetime(2026, 8, 14, 7, 0, 0, 1, tzinfo=dt.UTC)]
    b = pa.RecordBatch.from_arrays([pa.array(at, pa.timestamp("us", "UTC")), pa.array(["a", "b", None])], names=["at", "x"])
    rows = list(canonical._rows(b))
    assert [type(r["at"]) for r in rows] == [int, type(None), int]
    assert pa.RecordBatch.from_pylist(rows, b.schema).equals(b)


def test_feeds_pass_python_once(spark):
    """Entries go through Python for their URL once, however many columns and conditions use it; no text is cleaned for two columns."""
    item = lambda k, link: f"<item><title>T &amp;amp; {k}</title><link>{link}</link><pubDate>Fri, 14 Aug 2026 06:00:00 GMT</pubDate><description>&lt;p&gt;a{k}&lt;/p&gt;  b</description></item>"
    body = "<rss><channel><title>P</title>" + item(1, "/n/1") + item(2, "https://q.org/2") + item(3, "http://[bad") + item(4, "//[bad") + item(5, "") + "</channel></rss>"
    df = spark.createDataFrame([("s", "https://p.org/all.xml", bytearray(body.encode()))], "source_id string, final_url string, body binary")
    for v1 in (False, True):
        p = articles.parse_feeds(df, v1)
        got = [(r.i, r.url, r.external_id, r.title, r.content, r.publisher) for r in p.orderBy("i").collect()]
        who = "Unknown" if v1 else "P"
        assert got == [(0, "https://p.org/n/1", "https://p.org/n/1", "T & 1", "a1 b", who), (1, "https://q.org/2", "https://q.org/2", "T & 2", "a2 b", who), (2, "http://[bad", "http://[bad", "T & 3", "a3 b", who)]
        plan = p.select("url", "external_id", "publisher", F.md5("content"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count(".description") == 1


def test_cleaning_equals_patterns(spark):
    """Tags, entities and runs, with and without each, against the plain patterns."""
    g = random.Random(4)
    bits = ["a", "ủ", "é", " ", "  ", "\t", "\n", "\xa0", " ", "​", "　", "﻿", "<", ">", "<b>", "< ", "&nbsp;", "&amp;", "&amp;lt;", "&quot;", "&#39;", "&lt;", "&gt;", "&", "\x85", "😀"]
    texts = ["", " ", "a", "a b", *("".join(g.choice(bits[: g.choice([6, 12, 26])]) for _ in range(g.randrange(12))) for _ in range(800)), None]
    def plain(x):
        for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
            x = F.replace(x if a != "&nbsp;" else F.regexp_replace(x, "<[^>]+>", " "), F.lit(a), F.lit(b))
        return F.regexp_replace(F.regexp_replace(x, f"{t.JS_S}+", " "), f"^{t.JS_S}+|{t.JS_S}+\\z", "")

    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select(t.clean_html(F.col("text")).alias("a"), plain(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) > 300
