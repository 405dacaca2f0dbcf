"""Sources, jobs, localization requests and the feed stream on small cases."""

import json

import pytest
from newsloom.operators import jobs, localize
from newsloom.sources import articles, registry
from newsloom.streaming import canonicalize
from pyspark.sql import functions as F


def test_registry(spark):
    s = registry.profiles(spark)
    assert s.count() == 11 and "Python" not in s._jdf.queryExecution().executedPlan().toString()
    t = spark.createDataFrame([(" Technology",), ("gardening",), ("BITCOIN",), (None,)], "topic string")
    assert {r.topic: r.slug for r in registry.default_source(t, s).collect()} == {" Technology": "vnexpress-technology-rss", "gardening": registry.FALLBACK, "BITCOIN": "coindesk-rss", None: registry.FALLBACK}
    assert {r.slug for r in registry.for_topics(t, s).where("topic = ' Technology'").collect()} == {"openai-newsroom-rss", "apple-newsroom-rss", "vnexpress-technology-rss"}


def test_canonical_urls(spark):
    cases = {"HTTPS://A.org:443": "https://a.org/", "http://a.org:80/x y?q#f": "http://a.org/x%20y?q#f", "http://a.org:443/": "http://a.org:443/", "a.org/x": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    assert {r.u: r.c for r in df.select("u", articles.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_payload_errors(spark):
    good = {"version": 1, "type": "FETCH_SOURCE", "correlationId": "c", "pipelineRunId": "p", "attempt": 0, "sourceId": "s", "subscriptionId": "x", "scheduleBucket": "b"}
    cases = [
        (good, None), (good | {"version": 2}, "JOB_VERSION_UNSUPPORTED"), (good | {"version": "1"}, "JOB_VERSION_UNSUPPORTED"), (good | {"sourceId": 5}, "JOB_PAYLOAD_INVALID"), (good | {"attempt": 1.5}, "JOB_PAYLOAD_INVALID"), (good | {"attempt": -1}, "JOB_PAYLOAD_INVALID"),
        (good | {"type": "BUILD_BRIEFS", "dateBucket": "d"}, None), (good | {"type": "BUILD_BRIEFS", "dateBucket": "d", "locale": "fr"}, "JOB_PAYLOAD_INVALID"), (good | {"type": "BACKFILL_CONTENT", "batchSize": 0}, "JOB_PAYLOAD_INVALID"), (good | {"type": "BACKFILL_CONTENT", "batchSize": 9}, None), ([], "JOB_VERSION_UNSUPPORTED"),
    ]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in enumerate(cases)] + [(90, "{"), (91, None)], "k int, p string")
    got = {r.k: r.e for r in df.select("k", jobs.payload_error(F.col("p")).alias("e")).collect()}
    assert got == {**{k: e for k, (_, e) in enumerate(cases)}, 90: "JOB_VERSION_UNSUPPORTED", 91: "JOB_VERSION_UNSUPPORTED"}
    v = F.try_parse_json(F.lit('{"a": ["x", 1, null, "y"], "n": "5", "m": 5}'))
    assert spark.range(1).select(jobs.text_array_field(v, "a"), jobs.number_field(v, "n"), jobs.number_field(v, "m"), jobs.text_array_field(v, "n")).first()[:] == (["x", "y"], None, 5.0, [])


def test_localization_request(spark):
    c = spark.createDataFrame([(1, "OpenAI ships GPT-5", "OpenAI may rise 25% today. According to Reuters, the model is new.", "en", ["technology"]), (2, "x", None, "vi", [])], "content_id long, title string, content string, language string, topics array<string>")
    g = spark.createDataFrame([("en", "vi", "v1", "technology", "Model", "mô hình", False), ("en", "vi", "v1", "health", "model", "no", False), ("en", "vi", "v2", "technology", "today", "no", False), ("en", "vi", "v1", "general-news", "openai", "OpenAI", True)], "source_language string, target_locale string, version string, domain string, source_term string, preferred_term string, protected boolean")
    r = {x.content_id: x.request for x in localize.requests(c, g, "vi", "v1", "p").collect()}
    assert [(x.sourceTerm, x.protected) for x in r[1].glossary] == [("openai", True), ("Model", False)]
    assert {"25%", "rise", "may", "Reuters", "GPT-5"} <= set(r[1].preservedValues) and {"OpenAI", "openai", "Reuters"} <= set(r[1].preservedTerms)
    assert r[1].sourceClaims[0].evidence == [r[1].sourceClaims[0].text] and r[2].glossary == [] and r[2].sourceContent == ""


def test_feeds_are_canonicalized_as_they_arrive(spark, tmp_path):
    def feed(title):
        return f"<rss><channel><title>P</title><item><title>{title}</title><link>/a/1</link><guid>g1</guid><pubDate>Fri, 14 Aug 2026 06:00:00 GMT</pubDate><description>d</description></item></channel></rss>"

    schema = "source_id string, final_url string, body binary, fetched_at timestamp"
    for n, title in enumerate(["one", "one", "two"]):
        df = spark.createDataFrame([("s", "https://p.org/feed", bytearray(feed(title).encode()))], "source_id string, final_url string, body binary").withColumn("fetched_at", F.timestamp_seconds(F.lit(1786687200 + n)))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = canonicalize.canonicalize(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    now = canonicalize.current(spark, str(tmp_path / "out"), 2).collect()
    assert [(r.title, r.revision, r.url) for r in now] == [("two", 2, "https://p.org/a/1")]
    assert [r.title for r in spark.read.parquet(str(tmp_path / "out/revisions/batch=2")).collect()] == ["one"]


@pytest.mark.parametrize("most", [None, 100, 33])
def test_words_in_texts_by_one_automaton_or_several(spark, most):
    from newsloom.functions.automaton import containing

    words = spark.createDataFrame([(w,) for w in ("a", "ab", "abc", "abcd", "xyz", "năm", "z z", "", None, "ab")], "token string")
    rows = [(1, "xxabcdxx"), (2, "ab"), (3, "b a"), (4, ""), (5, None), (6, "một năm z z"), (7, "abcabcabd"), (None, "xyz")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = sorted((w, i or 0) for w in {r.token for r in words.collect()} - {None} for i, x in rows if x is not None and w in x)
    assert sorted((r.token, r.id or 0) for r in containing(words, texts, "id", most).collect()) == want
    assert containing(words.limit(0), texts, "id", most).count() == containing(words, texts.limit(0), "id", most).count() == 0


def test_time_of_many_words_is_that_of_the_texts(spark):
    """20,000 words: as many pairs as Spark's own search finds, on a part of the texts."""
    from newsloom.functions.automaton import containing

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = d.select(F.explode(F.split("text", " ")).alias("token")).distinct().where("length(token) > 2").orderBy("token").limit(20_000)
    few = d.where("doc_id < 10")
    want = F.broadcast(words).join(few, F.contains("text", "token")).select("token", "doc_id")
    got = containing(words, few, "doc_id")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def _version(k, url=None, h="h", at=0):
    import datetime as dt

    return ("s", f"e{k}", url or f"u{k}", h, "t", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1) + dt.timedelta(minutes=at))


VERSIONS = "source_id string, external_id string, url string, content_hash string, title string, published_at timestamp, fetched_at timestamp"


def test_a_batch_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    """Ten keys into a large state; a rerun, also of a batch that failed before its manifest, gives the same state."""
    folder, n, many = str(tmp_path / "s"), 200_000, 64
    first = spark.range(n).select(F.lit("s").alias("source_id"), F.concat(F.lit("e"), "id").alias("external_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("h").alias("content_hash"), F.lit("t").alias("title"), F.lit("2026-01-01").cast("timestamp").alias("published_at"), F.lit("2026-01-02").cast("timestamp").alias("fetched_at"))
    canonicalize.take_in(spark, first, folder, 0, many)
    assert canonicalize.current(spark, folder, 0, many).count() == n
    batch = spark.createDataFrame([_version(k, h="new") for k in range(5)] + [_version(n + 1, url="u77", h="new"), _version(n + 2)], VERSIONS)
    state = lambda k: sorted(map(str, canonicalize.current(spark, folder, k, many).where("content_hash = 'new' or external_id = 'e200002' or url = 'u77'").collect()))
    before = state(0)
    canonicalize.take_in(spark, batch, folder, 1, many)
    items = canonicalize.stores(spark, folder, many)[0]
    assert sum(k == 1 for k in items.manifest(1).values()) <= 8 and set(items.manifest(1).values()) == {0, 1}
    after = state(1)
    assert len(after) == 7 and state(0) == before and any("e200001" in x and "u77" in x and "revision=2" in x for x in after)
    assert canonicalize.current(spark, folder, 1, many).count() == n + 1
    canonicalize.take_in(spark, batch, folder, 1, many)  # again
    assert state(1) == after
    canonicalize.take_in(spark, spark.createDataFrame([], VERSIONS), folder, 2, many)
    assert state(2) == after
    moved = spark.createDataFrame([_version(0, url="fresh", h="x"), _version(n + 9, url="u0", h="y", at=1)], VERSIONS)
    canonicalize.take_in(spark, moved, folder, 3, many)
    got = {r.url: r.external_id for r in canonicalize.current(spark, folder, 3, many).where("url in ('fresh', 'u0')").collect()}
    assert got == {"fresh": "e0", "u0": f"e{n + 9}"}
    assert items.collect_garbage(3, keep=1) == [2] and canonicalize.current(spark, folder, 3, many).count() == n + 2


def test_quantiles_are_those_of_sorted_values(spark):
    import numpy as np
    from newsloom.operators import metrics

    g = np.random.default_rng(2)
    rows = [("big", float(x)) for x in g.normal(size=30_000).round(2)] + [("big", None)] * 40 + [("few", 3.0), ("few", None), ("one", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for p in (0.0, 0.001, 0.5, 0.95, 1.0):
        want = {}
        for k in {k for k, _ in rows}:
            vs = sorted((v for kk, v in rows if kk == k), key=lambda v: (v is not None, v))
            want[k] = vs[min(int(len(vs) * p), len(vs) - 1)]
        assert {r.k: r.percentile for r in metrics.index_percentile(df, "v", p, "k").collect()} == want


def test_masking_at_every_level(spark):
    from newsloom.sources import canonical

    rows = ['{"a":{"Cookie":1,"b":[null,{"api_key":{"x":1}}]},"n":1.5}', "[null]", "not json", None, "5"]
    got = [r.m for r in spark.createDataFrame([(x,) for x in rows], "x string").select(canonical.masked(F.col("x")).alias("m")).collect()]
    assert got == ['{"a":{"Cookie":"[REDACTED]","b":["[NULL]",{"api_key":"[REDACTED]"}]},"n":1.5}', '["[NULL]"]', None, None, "5"]


def test_a_glossary_is_imported_whole_or_not_at_all(spark):
    from newsloom.sources import canonical

    good = {"sourceLanguage": "en", "targetLocale": "vi", "sourceTerm": " Interest   Rate ", "preferredTerm": "lãi suất", "protected": True, "domain": "economy-finance", "version": "v1"}
    docs = [(1, json.dumps([good, good | {"sourceTerm": "interest rate", "preferredTerm": "lãi vay", "protected": False}])), (2, json.dumps([good, good | {"protected": "yes"}, good | {"targetLocale": "xx"}])), (3, json.dumps([good | {"targetLocale": "fr"}])), (4, "{"), (5, json.dumps(good)), (6, "[]"), (7, json.dumps([good | {"domain": " "}])), (8, None), (9, json.dumps([5]))]
    entries, errors = canonical.glossary_import(spark.createDataFrame(docs, "document_id int, json string"))
    assert {r.document_id for r in entries.collect()} == {1}
    assert {r.document_id: (r.position, r.error) for r in errors.collect()} == {2: (1, canonical.BAD_ENTRY), 3: (0, canonical.BAD_LOCALE), 4: (0, canonical.BAD_JSON), 5: (0, canonical.BAD_JSON), 7: (0, canonical.BAD_ENTRY), 8: (0, canonical.BAD_JSON), 9: (0, canonical.BAD_ENTRY)}
    won, conflicts = canonical.glossary_winners(entries)
    assert [(r.term, r.preferred_term) for r in won.collect()] == [("interest rate", "lãi suất")] and conflicts.first().conflicts == 1
    assert json.loads(canonical.glossary_export(won).first().json) == good | {"sourceTerm": "Interest   Rate"}


def test_the_older_gate_on_its_known_cases(spark):
    from newsloom.operators import quality

    source = ("XRP falls 5.5% after Senate delay", "XRP fell 5.5% while Bitcoin remained stable.")
    rows = [(1, *source, "XRP giảm 5.5% sau khi Thượng viện trì hoãn", "XRP giảm 5.5% trong khi Bitcoin giữ ổn định."), (2, *source, "XRP falls 4% after Senate delay", "XRP fell 4% while Bitcoin remained stable."), (3, *source, " ", None), (4, *source, *source)]
    df = spark.createDataFrame([(*r, "en", "vi") for r in rows], "id int, source_title string, source_content string, title string, summary string, source_language string, target_locale string")
    got = {r.id: r for r in quality.gate_v2(df).collect()}
    assert got[1].passed and got[1].score == 1.0 and got[1].evidence[0].source_text == source[0]
    assert got[2].failure_codes == ["NUMBER_CHANGED", "LOCALE_FALLBACK_LEAK"] and not got[2].passed
    assert got[3].failure_codes == ["NUMBER_CHANGED", "ENTITY_CORRUPTED", "EMPTY_OUTPUT"] and got[4].failure_codes == ["LOCALE_FALLBACK_LEAK"] * 2


def test_a_session_without_the_setting_makes_one_folder(spark):
    """Nothing is set on the session; the folder stays the same."""
    from newsloom.functions import scratch

    class Plain:
        sparkContext = spark.sparkContext
        conf = type("C", (), {"get": staticmethod(lambda key, other=None: other)})()

    a, b = scratch.folder(Plain()), scratch.folder(Plain())
    assert a == b and "newsloom-" in a
