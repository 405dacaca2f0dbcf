"""Matching, selection and text forms on small cases."""

import sys
import unicodedata

from newsloom.functions import text as t
from newsloom.operators import matching
from newsloom.plans import registry
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


def test_every_document_is_matched(spark):
    want = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id is not null").select("doc_id").distinct().count()
    for name in ("match_candidates", "rank_breakdown"):
        assert registry.QUERIES[name](spark, SMALL).where("user_id <= 40").select("content_id").distinct().count() == want


def test_any_one_reason_ranks(spark):
    """One content for each reason alone, one for none."""
    u = spark.createDataFrame([(1, "VN", ["US"], ["health"], ["ACME Corp"], ["Lãi Suất", " "])], "user_id long, home_market string, followed_markets array<string>, interests array<string>, entities array<string>, keywords array<string>")
    rows = [
        (1, ["health", "sports"], ["CN"], 0.1, [], "t", "x"), (2, ["sports"], ["US", "CN"], 0.1, [], "t", "x"), (3, ["sports"], ["CN"], 0.8, [], "t", "x"),
        (4, ["sports"], ["CN"], 0.1, ["acme corp", "Ａcme Corp "], "t", "x"), (5, ["sports"], ["CN"], 0.1, [], "Tin", "về LÃI SUẤT mới"), (6, ["sports"], ["CN"], 0.1, [], "t", "x"), (7, None, None, None, None, None, None),
        (8, ["health"], ["VN", "US"], 0.9, [], "t", "lãi suất"),
    ]
    c = spark.createDataFrame([(*r, "p", 0.5) for r in rows], "content_id long, topics array<string>, markets array<string>, importance double, entities array<string>, title string, content string, publisher string, authority double")
    c = c.selectExpr("*", "timestamp'2024-01-04' as published_at")
    got = {r.content_id: r for r in matching.rank(matching.candidates_any(u, c), u, c, "2024-01-05 00:00:00").collect()}
    assert {k: r.relevance for k, r in got.items()} == {1: 0.25, 2: 0.2, 3: 0.4, 4: 0.6, 5: 0.35, 8: 1.0}
    assert got[4].breakdown.entity_relevance == 1.0 and got[4].first_entity == "acme corp"


def test_items_without_topic_or_publisher_have_their_caps(spark):
    rows = [(1, k, 1.0 - k / 100, None if k % 2 else "p", None) for k in range(8)]
    df = spark.createDataFrame(rows, "user_id int, content_id long, score double, publisher string, topic string")
    assert [r.content_id for r in matching.diversify(df, 10, 2, 3, 200).orderBy("position").collect()] == [0, 1, 2]
    assert [r.content_id for r in matching.diversify(df, 10, 2, 9, 200).orderBy("position").collect()] == [0, 1, 2, 3]


def test_cursors_come_back(spark):
    df = spark.createDataFrame([(7, 0.123457), (8, 0.5)], "id long, score double")
    assert all((r.c.id, r.c.score) == (r.id, r.score) for r in df.select("id", "score", matching.decode_cursor(matching.encode_cursor(F.col("id"), F.col("score"))).alias("c")).collect())


def test_characters_that_forms_leave_alone():
    """The fixed ranges hold no character that changes or that composes with another of them."""
    import re

    for form, ranges in t.STABLE.items():
        member = re.compile(f"[{ranges}]")
        chars = [c for c in map(chr, range(sys.maxunicode + 1)) if member.match(c)]
        assert len(chars) > 20_000 and all(unicodedata.normalize(form, c) == c and not unicodedata.combining(c) for c in chars)
        composed = [unicodedata.decomposition(c).split() for c in map(chr, range(sys.maxunicode + 1))]
        seconds = {chr(int(d[1], 16)) for d in composed if len(d) == 2 and not d[0].startswith("<")}
        assert not seconds & set(chars)


def test_unicode_forms(spark):
    rows = ["plain", "Café ﬁ ½", "tăng 2%…", "ＡＢＣ", None, "", "đồng – “x”"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    for form in ("NFC", "NFKC", "NFD"):
        got = [r[0] for r in df.select(t.unicode_form(F.col("x"), form)).collect()]
        assert got == [None if r is None else unicodedata.normalize(form, r) for r in rows]
