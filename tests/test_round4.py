"""What round 4's findings name, on small cases."""

import datetime as dt
import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
from newsloom.functions import text as t
from newsloom.operators import insights, matching, metrics
from newsloom.plans import registry
from oracle import same
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def _folder(path, **tables):
    """A folder of some tables of SMALL, cut or changed."""
    for name, change in tables.items():
        pq.write_table(change(pq.read_table(f"{SMALL}/{name}.parquet")), f"{path}/{name}.parquet")
    return str(path)


def test_ratios_of_feeds_round_as_doubles(spark):
    rows = [("v1", str(k), "https://a.org/1", "p", dt.datetime(2024, 1, 1), 0.5, k < 57, False, "k") for k in range(800)]
    df = spark.createDataFrame(rows, "feed string, id string, url string, publisher string, published_at timestamp, relevance double, localized boolean, blocking_error boolean, duplicate_key string")
    assert metrics.compare_feeds(df, "2024-03-01 00:00:00").first().v1_localized_rate == 0.0712


def test_feeds_are_compared_only_where_both_have_items(spark, tmp_path):
    """As their SQL: no row without items of either feed."""
    folder = _folder(tmp_path, documents=lambda t: t, events=lambda t: t.slice(0, 0), pages=lambda t: t.slice(0, 0))
    for name in ("feeds_shadow", "feeds_compared"):
        same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], folder)
        assert registry.QUERIES[name](spark, folder).count() == 0


def test_pairs_of_a_profile_lie_together(spark):
    """What a task writes has the users of few blocks, each once a content and always in the same order; no profile's users are one task's alone."""
    u = spark.range(6000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, "vi").otherwise("en").alias("locale"))
    pairs = matching.profiles(u).withColumn("content_id", F.explode(F.sequence(F.lit(1), F.lit(60)))).repartition(4)
    out = matching.pairs_to_users(pairs.select("user_id", "content_id"), u, size=500).withColumn("part", F.spark_partition_id())
    assert out.count() == out.select("user_id", "content_id").distinct().count() == 6000 * 60
    users = {r.part: (r.n, r.kinds) for r in out.groupBy("part").agg(F.count_distinct("user_id").alias("n"), F.count_distinct(F.col("user_id") % 3 == 0).alias("kinds")).collect()}
    assert len(users) >= 8 and max(n for n, _ in users.values()) < 2500 and sum(kinds == 2 for _, kinds in users.values()) <= 1
    rows = [(r.content_id, r.user_id) for r in out.where(F.col("part") == min(users)).collect()]
    runs = [[x[1] for x in g] for _, g in itertools.groupby(rows, lambda x: x[0])]
    assert len({frozenset(r) for r in runs}) <= 4 and all(r == next(s for s in runs if set(s) == set(r)) for r in runs)


def test_feeds_keep_documents_without_title_text_or_plain_source(spark, tmp_path):
    """As their SQL: no row is lost to a blank first line, a missing text, the text "null", or another row's source."""
    texts = [None, "", " \n ", "\nabc", "<b>\nabc", "&nbsp;", "null", "null\nnull", "a & b", "(none)", "(untitled)\n<b>", "<a\nb>"]
    sources = ["src0", "src0", None, "", "a&b", "a<b", " s  p ", "null", "<i>x</i>", "中"]

    def change(table):
        n = table.num_rows
        odd = {"text": [texts[k % len(texts)] for k in range(n)], "source": [sources[k % len(sources)] for k in range(n)]}
        for name, values in odd.items():
            table = table.set_column(table.column_names.index(name), name, pa.array(values, pa.string()))
        return table

    folder = _folder(tmp_path, documents=change)
    for name in ("feeds_parsed", "feeds_parsed_v1"):
        same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], folder)


def test_contents_that_are_alike_match_as_one(spark):
    """As one by one: alike contents have the same users, relevance and status; what differs in a word, locale or market isn't alike."""
    words, places = [["Rate"], ["rate", "oil"], ["oil"], [" "]], ["VN", "US"]
    u = spark.createDataFrame([(k, "vi" if k % 2 else "en", places[k % 2], ["US"]) for k in range(8)], "user_id long, locale string, home_market string, followed_markets array<string>")
    rows = lambda topics: [(k, t, words[k % 4]) for k in range(8) for t in topics(k)]
    before, after = (spark.createDataFrame(rows(f), "user_id long, topic string, refinements array<string>") for f in (lambda k: ["a", "b"], lambda k: ["a"] if k % 3 else ["a", "c"]))
    c = spark.createDataFrame(
        [(k, [["a"], ["b"], ["a", "c"]][k % 3], [places[k % 2]], 0.9 if k % 5 else 0.1, 0.5, dt.datetime(2024, 1, 1 + k % 20), "VERIFIED", None, "t", ["RATE", "oil", ""][k % 3] + f" {k % 2}") for k in range(120)],
        "content_id long, topics array<string>, markets array<string>, importance double, authority double, published_at timestamp, provenance_status string, duplicate_of_id long, title string, content string",
    )
    loc = spark.createDataFrame([(k, x, "VERIFIED" if k % 7 or x == "en" else "REJECTED") for k in range(120) for x in ("vi", "en")], "content_id long, locale string, status string")
    affected = spark.createDataFrame([(k, t) for k in range(8) for t in (["b"] if k % 3 else ["b", "c"])], "user_id long, topic string")
    like = dict(map(tuple, insights.alike(c, c.select("content_id", "title", "content"), loc, before.select(F.explode("refinements").alias("k"))).collect()))

    def maintained(some):
        state = insights.prepared_matches(u, before, some, loc, "2024-02-01 00:00:00").withColumn("status", F.lit("ACTIVE"))
        return insights.maintain_matches(state, u, after, affected, some, loc, "2024-02-01 00:00:00").collect()

    every = {(r.user_id, r.content_id): (r.relevance, r.status) for r in maintained(c)}
    once = {(r.user_id, r.content_id): (r.relevance, r.status) for r in maintained(c.where(F.col("content_id").isin(list(set(like.values())))))}
    assert len(like) == 120 and len(set(like.values())) < 60 and {s for _, s in every.values()} == {"ACTIVE", "EXPIRED"}
    assert every == {(a, k): v for k, x in like.items() for (a, y), v in once.items() if y == x}


def test_long_runs_of_capitalised_words_and_numbers(spark):
    """Runs that overflowed the stack of the JVM; the same matches as by the plain patterns."""
    g = random.Random(7)
    bits = ["Word", "WORD", "Ủy", "Aa", "a", "A1", " ", "  ", "\n", "1", "12", "1234", "56789", ".", ",", "-", "/", ":", "%", "_"]
    rows = [(k, "".join(g.choice(bits) for _ in range(g.randrange(40)))) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, text string")
    plain = F.sort_array(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(t.NUMBERS), F.lit(0)), F.regexp_extract_all("text", F.lit(t.CAPITALISED), F.lit(0)))))
    assert all(r.a == r.b for r in df.select(t.invariants(F.col("text")).alias("a"), plain.alias("b")).collect())
    words, numbers = " ".join(["Worda"] * 50_000), "1234," * 50_000
    long = spark.createDataFrame([(1, words), (2, numbers)], "id long, text string")
    assert {r.id: r.v for r in long.select("id", t.invariants(F.col("text")).alias("v")).collect()} == {1: [words], 2: [numbers]}
