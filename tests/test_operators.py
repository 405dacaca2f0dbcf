"""Cases with known results: the inputs and expected values of FIXTURES.md in table form."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from newsloom.functions import text as t
from newsloom.operators import ledger, matching, metrics, quality, resolve
from newsloom.sources import articles, canonical
from newsloom.streaming import circuit
from pyspark.sql import functions as F


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_semantic_text_and_hash(spark):
    assert one(spark, "  Café\r\n  tăng\t2%  ", t.semantic_text) == "Café\ntăng 2%"
    h = lambda x: one(spark, x, lambda c: t.semantic_hash(F.lit("t"), c))
    assert h("a  b") == h("a b ") and h("2%") != h("3%")


def test_word_boundaries_are_ascii(spark):
    assert one(spark, "Đông Nam vàĐông ăNam OpenAI", lambda c: F.regexp_extract_all(c, F.lit(t.JS_B + r"\p{Lu}\p{L}{2,}"), F.lit(0))) == ["Nam", "Nam", "OpenAI"]


def test_facts_keep_kinds_apart(spark):
    got = one(spark, "On 14/08/2026 GPT-5 cost $5 million, up 25% from 12", t.facts)
    assert [(f.kind, f.raw) for f in got] == [("DATE_TIME", "14/08/2026"), ("PRODUCT_VERSION", "GPT-5"), ("CURRENCY", "$5 million"), ("PERCENTAGE", "25%"), ("NUMBER", "12")]
    assert got[0].normalized == "2026-08-14T00:00:00.000Z"


def test_entities_directions_certainty(spark):
    assert one(spark, "According to Reuters, OpenAI may rise", t.entities) == ["OpenAI"] or "OpenAI" in one(spark, "According to Reuters, OpenAI may rise", t.entities)
    assert one(spark, "Giá tăng, then fell and FELL", t.directions) == ["tăng", "fell"]
    assert one(spark, "It may be", t.certainty) == "may" and one(spark, "none", t.certainty) is None


def test_sentences_have_spans(spark):
    got = one(spark, " One two. Three?\nFour", t.sentences)
    assert [(s.text, s.start, s.end) for s in got] == [("One two.", 1, 9), ("Three?", 10, 16), ("Four", 17, 21)]


def test_jaccard_of_empty_sets_is_one(spark):
    e = F.array().cast("array<string>")
    assert spark.range(1).select(resolve.jaccard(e, e)).first()[0] == 1.0


def test_greedy_selection_and_caps(spark):
    rows = [(1, 10, 0.9, "p", "x"), (1, 11, 0.8, "p", "x"), (1, 12, 0.7, "p", "y"), (1, 13, 0.6, "q", "x"), (1, 14, 0.5, "r", "y")]
    df = spark.createDataFrame(rows, "user_id long, content_id long, score double, publisher string, topic string")
    got = matching.diversify(df, 10, 2, 3, 200).orderBy("position").collect()
    assert [r.content_id for r in got] == [10, 11, 13, 14]


def test_cursor_not_in_feed_is_an_error(spark):
    feed = spark.createDataFrame([(1, 0, 5, 0.5)], "user_id long, position int, content_id long, score double")
    cur = spark.createDataFrame([(1, 9, 0.5)], "user_id long, cursor_id long, cursor_score double")
    assert matching.page_after(feed, cur, 2).first().error == "INVALID_CURSOR"


def _item(i, when, content, **kw):
    return {"id": i, "source_id": "s", "external_id": str(i), "url": f"u{i}", "title": "T", "content": content, "published_at": when, "created_at": when} | kw


def test_duplicates_follow_the_earliest(spark):
    day = dt.datetime(2026, 8, 14)
    h = lambda n: day + dt.timedelta(hours=n)
    words = " ".join(f"word{chr(97 + k)}" for k in range(26))
    rows = [_item(2, h(7), "same body"), _item(3, h(8), "same body"), _item(1, h(6), "same body"), _item(4, h(9), words), _item(5, h(10), words + " updated"), _item(6, h(11), words + " 25%"), _item(7, h(6 + 24 * 5), "same body")]
    got = {r.id: (r.duplicate_of_id, r.duplicate_kind) for r in resolve.resolve_duplicates(spark.createDataFrame(pd.DataFrame(rows))).collect()}
    assert got[1] == (None, None) and got[2][0] == 1 and got[3] == (1, "EXACT_CONTENT_HASH")
    assert got[5] == (4, "NEAR_EXACT") and got[6][0] is None and got[7][0] is None


def _brute_duplicates(rows, hashes):
    """The rule, one row after the other."""
    order = sorted(rows, key=lambda r: (r["published_at"], r["created_at"], r["id"]))
    leads, out = [], {}
    for r in order:
        best = None
        for o in leads:
            apart = r["published_at"] - o["published_at"]
            if apart > dt.timedelta(days=3):
                continue
            a, b = hashes[r["id"]], hashes[o["id"]]
            near = len(a.tok & b.tok) / max(1, len(a.tok | b.tok)) if a.tok or b.tok else 1.0
            kinds = [(r["source_id"], r["external_id"]) == (o["source_id"], o["external_id"]), r["url"] == o["url"], a.h == b.h, a.inv == b.inv and a.fp == b.fp, a.inv == b.inv and apart <= dt.timedelta(days=1) and near >= 0.9]
            hit = [k for k, ok in enumerate(kinds) if ok]
            if hit:
                m = (hit[0], -(near if hit[0] == 4 else 1.0), (o["published_at"], o["created_at"], o["id"]))
                best = m if best is None else min(best, m)
        if best is None:
            leads.append(r)
        out[r["id"]] = best and (best[2][2], resolve.KINDS[best[0]])
    return out


def _random_items(seed=4, n=160, hours=200):
    g = np.random.default_rng(seed)
    words = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(5)]
    rows = []
    for k in range(n):
        w = list(words)
        for at in g.choice(30, int(g.integers(0, 3)), replace=False):
            w[at] = f"other{chr(97 + int(g.integers(0, 4)))}"
        body = ["", "same body", " ".join(w), " ".join(w).upper().lower() + ".", f"plain {k}"][int(g.choice(5, p=[0.05, 0.2, 0.45, 0.2, 0.1]))]
        when = dt.datetime(2026, 8, 1) + dt.timedelta(hours=int(g.integers(0, hours)))
        rows.append(_item(k, when, body, title="", external_id=str(int(g.integers(0, 120))), url=f"u{int(g.integers(0, 120))}"))
    return rows


def _hashes(df):
    c = df.select("id", t.semantic_hash(F.col("title"), F.col("content")).alias("h"), t.fingerprint(F.concat("title", F.lit("\n"), "content")).alias("fp"), t.tokens(F.concat("title", F.lit("\n"), "content")).alias("tok"), t.invariants(F.concat("title", F.lit("\n"), "content")).alias("inv"))
    return {r.id: SimpleNamespace(h=r.h, fp=r.fp, tok=set(r.tok), inv=r.inv) for r in c.collect()}


def test_duplicates_equal_brute_force(spark):
    """Chains over several days, ties of time, equal keys of each kind, texts alike and texts without words."""
    rows = _random_items()
    df = spark.createDataFrame(pd.DataFrame(rows))
    want = _brute_duplicates(rows, _hashes(df))
    got = {r.id: r.duplicate_of_id is not None and (r.duplicate_of_id, r.duplicate_kind) or None for r in resolve.resolve_duplicates(df).collect()}
    assert got == want and len({k for v in want.values() if v for k in v[1:]}) >= 4


def _tables(spark, days):
    """Tables that one text makes that comes back daily, with a variant of it."""
    from newsloom.functions import scratch

    words = " ".join(f"word{chr(97 + k)}" for k in range(26))
    rows = [_item(k, dt.datetime(2026, 1, 1) + dt.timedelta(days=k // 2, hours=k % 2), words + (" more" if k % 2 else "")) for k in range(2 * days)]
    made = []
    save, write = scratch.Scratch.save, resolve.written
    scratch.Scratch.save = lambda self, df: (made.append(1), save(self, df))[1]
    resolve.written = lambda df: (made.append(1), write(df))[1]
    try:
        out = resolve.resolve_duplicates(spark.createDataFrame(pd.DataFrame(rows))).collect()
    finally:
        scratch.Scratch.save, resolve.written = save, write
    leads = sorted(r.id for r in out if r.duplicate_of_id is None)
    assert leads[:3] == [0, 7, 8][: len(leads)] or leads[0] == 0
    return len(made)


def test_jobs_dont_grow_with_the_days_that_a_text_returns(spark):
    assert _tables(spark, 6) == _tables(spark, 120)


ARRIVING = "id long, source_id string, external_id string, url string, title string, content string, published_at timestamp, created_at timestamp"
RESOLVED = ARRIVING + ", duplicate_of_id long, duplicate_kind string, duplicate_score double"


def _brute_arrivals(rows, hashes):
    """Each arrival against all that survives, as it comes."""
    place = lambda r: (r["published_at"], r["created_at"], r["id"])
    seen, of = {}, {}
    for r in rows:
        best = None
        for o in sorted((x for i, x in seen.items() if i not in of), key=place):
            apart = abs(r["published_at"] - o["published_at"])
            a, b = hashes[r["id"]], hashes[o["id"]]
            near = len(a.tok & b.tok) / len(a.tok | b.tok) if a.tok or b.tok else 1.0
            kinds = [(r["source_id"], r["external_id"]) == (o["source_id"], o["external_id"]), r["url"] == o["url"], a.h == b.h, a.inv == b.inv and a.fp == b.fp, a.inv == b.inv and apart <= dt.timedelta(days=1) and near >= 0.9]
            hit = next((k for k, ok in enumerate(kinds) if ok), None)
            if hit is not None and apart <= dt.timedelta(days=3) and (best is None or (hit, -(near if hit == 4 else 1.0)) < best[:2]):
                best = (hit, -(near if hit == 4 else 1.0), o)
        seen[r["id"]] = r
        if best:
            lost, won = (r, best[2]) if place(best[2]) < place(r) else (best[2], r)
            of = {i: (won["id"] if x[0] == lost["id"] else x[0], x[1]) for i, x in of.items()}
            of[lost["id"]] = (won["id"], resolve.KINDS[best[0]])
    return of


def test_late_arrivals_take_over_what_followed(spark):
    """Arrivals of 07, 08 and 06 o'clock: the last one is the first by its time."""
    body = "The same exact policy content with figures 2% and date 14/08/2026."
    at = {i: dt.datetime(2026, 8, 14, h) for i, h in ((1, 7), (2, 8), (3, 6))}
    state = spark.createDataFrame([], RESOLVED)
    row = lambda i: (i, f"s{i}", f"policy-{i}", f"https://p{i}.test/a", "Shared policy", body, at[i], at[i])
    seen = []
    for i in (1, 2, 3):
        batch = spark.createDataFrame([(*row(i), i)], ARRIVING + ", arrival long")
        got = resolve.resolve_arrivals(state, batch).collect()
        seen.append({r.id: r.duplicate_of_id for r in got})
        state = spark.createDataFrame([(*row(r.id), r.duplicate_of_id, r.duplicate_kind, r.duplicate_score) for r in got], RESOLVED)
    assert seen == [{1: None}, {1: None, 2: 1}, {1: 3, 2: 3, 3: None}]
    assert {r.id: r.duplicate_kind for r in got} == {1: "EXACT_CONTENT_HASH", 2: "EXACT_CONTENT_HASH", 3: None}


@pytest.mark.parametrize("ordered", [True, False])
def test_arrivals_in_batches(spark, ordered):
    """In the order of place, batch by batch, the result of the whole; in any order that of brute force."""
    rows = _random_items(7, 90, 150)
    rows.sort(key=lambda r: (r["published_at"], r["created_at"], r["id"]) if ordered else (r["id"] * 37) % 90)
    frame = lambda rs: [tuple(r[c.split()[0]] for c in ARRIVING.split(", ")) for r in rs]
    df = spark.createDataFrame(frame(rows), ARRIVING)
    state = spark.createDataFrame([], RESOLVED)
    by = {r["id"]: x for r, x in zip(rows, frame(rows), strict=True)}
    for lo in range(0, 90, 30):
        batch = spark.createDataFrame([(*x, k) for k, x in enumerate(frame(rows[lo : lo + 30]))], ARRIVING + ", arrival long")
        got = resolve.resolve_arrivals(state, batch).collect()
        state = spark.createDataFrame([(*by[r.id], r.duplicate_of_id, r.duplicate_kind, r.duplicate_score) for r in got], RESOLVED)
    found = {r.id: (r.duplicate_of_id, r.duplicate_kind) for r in got if r.duplicate_of_id is not None}
    assert found == _brute_arrivals(rows, _hashes(df)) and len(got) == 90 and len(found) > 20
    if ordered:
        assert found == {r.id: (r.duplicate_of_id, r.duplicate_kind) for r in resolve.resolve_duplicates(df).collect() if r.duplicate_of_id is not None}


VERSION = "source_id string, external_id string, url string, content_hash string, title string, published_at timestamp, provenance_status string"


def _brute_persist(current, batch):
    """One version after the other."""
    items, revisions, bad = [dict(x) for x in current], [], []
    for v in sorted(batch, key=lambda v: (v["fetched_at"], v["content_hash"], v["external_id"], v["url"] is not None, v["url"])):
        at, v = v["fetched_at"], {k: x for k, x in v.items() if k != "fetched_at"}
        mine = next((x for x in items if (x["source_id"], x["external_id"]) == (v["source_id"], v["external_id"])), None)
        owner = next((x for x in items if v["url"] is not None and x["url"] == v["url"]), None)
        if owner and owner["source_id"] != v["source_id"]:
            bad.append((v["source_id"], v["external_id"], v["url"], at, canonical.CONFLICT))
        elif not (mine or owner):
            items.append(v | {"revision": 1})
        else:
            x = mine or owner
            if x["content_hash"] == v["content_hash"]:
                x["provenance_status"] = v["provenance_status"] or x["provenance_status"]
            elif owner and owner is not x:
                bad.append((v["source_id"], v["external_id"], v["url"], at, canonical.TAKEN))
            else:
                revisions.append(dict(x))
                x |= v | {"published_at": x["published_at"], "provenance_status": v["provenance_status"] or x["provenance_status"], "revision": x["revision"] + 1}
    return items, revisions, bad


def test_items_are_known_by_either_key(spark):
    """An item's URL under another external id, an URL of another source in current and in the batch, a moved URL, a refresh."""
    day = lambda n: dt.datetime(2026, 8, n)
    current = spark.createDataFrame([("s1", "e1", "u1", "h1", "one", day(1), "PENDING", 1), ("s9", "e9", "u8", "h8", "far", day(1), "VERIFIED", 3)], VERSION + ", revision int")
    rows = [("s1", "e2", "u1", "h2", "two", day(2), None, day(2)), ("s2", "x", "u9", "h3", "first", day(3), "VERIFIED", day(3)), ("s3", "y", "u9", "h3", "second", day(3), "VERIFIED", day(4)), ("s2", "x", "u9", "h3", "again", day(5), "REJECTED", day(5)), ("s1", "e2", "u7", "h4", "moved", day(6), None, day(6)), ("s4", "z", "u1", "h1", "free", day(7), None, day(7))]
    out = canonical.persist_canonical(current, spark.createDataFrame(rows, VERSION + ", fetched_at timestamp"))
    now = {(r.source_id, r.external_id): r for r in out["current"].collect()}
    assert set(now) == {("s1", "e2"), ("s2", "x"), ("s4", "z"), ("s9", "e9")}
    x = now["s1", "e2"]
    assert (x.url, x.title, x.revision, x.published_at, x.provenance_status) == ("u7", "moved", 3, day(1), "PENDING") and now["s2", "x"].title == "first" and now["s2", "x"].provenance_status == "REJECTED"
    old = sorted((r.revision, r.external_id, r.url, r.content_hash, r.title, r.published_at, r.provenance_status) for r in out["revisions"].collect())
    assert old == [(1, "e1", "u1", "h1", "one", day(1), "PENDING"), (2, "e2", "u1", "h2", "two", day(1), "PENDING")]
    assert [(r.source_id, r.url, r.error) for r in out["conflicts"].collect()] == [("s3", "u9", canonical.CONFLICT)]


def test_versions_equal_brute_force(spark):
    g = np.random.default_rng(11)
    pick = lambda xs: xs[int(g.integers(len(xs)))]
    names = [c.split()[0] for c in VERSION.split(", ")]

    def version(k):
        return dict(zip(names, (pick("ab"), f"e{g.integers(25)}", pick([None, *(f"u{j}" for j in range(40))]), f"h{g.integers(4)}", f"t{k}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=k), pick([None, "VERIFIED", "PENDING"])), strict=True))

    current = [version(k) | {"source_id": "ab"[k % 2], "external_id": f"e{k}", "url": f"u{k}", "revision": 1 + k % 3} for k in range(12)]
    batch = [version(k) | {"fetched_at": dt.datetime(2026, 2, 1) + dt.timedelta(minutes=int(k))} for k in range(150)]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    out = canonical.persist_canonical(frame(current, VERSION + ", revision int"), frame(batch, VERSION + ", fetched_at timestamp").repartition(5))
    items, revisions, bad = _brute_persist(current, batch)
    rows = lambda xs: sorted(str(sorted(x.items(), key=str)) for x in xs)
    assert rows(r.asDict() for r in out["current"].collect()) == rows(items)
    assert rows(r.asDict() for r in out["revisions"].collect()) == rows(revisions) and revisions
    assert sorted(map(str, ((r.source_id, r.external_id, r.url, r.fetched_at, r.error) for r in out["conflicts"].collect()))) == sorted(map(str, bad)) and {b[4] for b in bad} == {canonical.CONFLICT, canonical.TAKEN}
    empty = canonical.persist_canonical(frame([], VERSION + ", revision int"), frame([], VERSION + ", fetched_at timestamp"))
    assert all(x.count() == 0 for x in empty.values())


def test_leaders_are_no_components(spark):
    rows = [("k", 0, 1, 1), ("k", 1, 2, 2), ("l", 0, 2, 2), ("l", 1, 3, 3)]
    alike = spark.createDataFrame([(k, s, 0, 0.9, i, p * 10, p) for k, s, i, p in rows], "key string, side int, kind int, score double, id long, at long, place int")
    nodes = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, place int")
    got = {r.id: r.leader_id for r in resolve.leaders(nodes, alike.drop("side").limit(0), alike).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_facts_stand_in_the_order_of_the_text(spark):
    df = spark.createDataFrame([("On 2026-08-14 GPT-5 rose 25% to $3.5 million, 12 of 7; according to Reuters, it may fall.",), ("n 1, " * 3000,), (None,)], "content string").withColumn("content_id", F.lit(1))
    got = [[(f.kind, f.raw, f.start, f.end) for f in r[0]] for r in df.where("content is not null").select(t.facts(F.col("content"))).collect()]
    line = df.first().content
    assert [k for k, *_ in got[0]] == ["DATE_TIME", "PRODUCT_VERSION", "PERCENTAGE", "CURRENCY", "NUMBER", "NUMBER"]
    assert all(line[a:b] == raw for _, raw, a, b in got[0]) and [x[2] for x in got[1]] == list(range(2, 15000, 5))
    claims = t.claim_rows(df.limit(1)).collect()
    assert "Reuters" in claims[0].entities and claims[0].attribution == "Reuters"


def test_cluster_rows_and_rebuild(spark):
    day = dt.datetime(2026, 8, 14, 6)
    rows = [_item(k, day + dt.timedelta(hours=k), "OpenAI grew 25% today", title="OpenAI revenue grows", topics=["technology"], provenance_status="VERIFIED" if k < 4 else "REJECTED", duplicate_of_id=None) for k in (1, 2, 3, 4)]
    schema = "id long, source_id string, external_id string, url string, title string, content string, published_at timestamp, created_at timestamp, topics array<string>, provenance_status string, duplicate_of_id long"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    stored = spark.createDataFrame([(9, "older", "ACTIVE"), (8, resolve.POLICY, "ACTIVE")], "cluster_id long, policy string, status string")
    kept, members = resolve.rebuild_clusters(stored, df)
    assert {r.cluster_id: r.status for r in kept.collect()} == {9: "ARCHIVED", 8: "ACTIVE"}
    got = {r.id: r for r in resolve.cluster_rows(df, members).collect()}
    assert set(got) == {1, 2, 3} and got[3].size == 3 and len(got[1].cluster_key) == 64 and [got[k].reason for k in (1, 2)] == ["FIRST_MEMBER", "EVENT_SIMILARITY"]


def _brute_clusters(f):
    """Each item against all leaders."""
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    leads, out = [], {}
    for x in sorted(f, key=lambda x: x.place):
        found = []
        for n, y in enumerate(leads):
            score = round(0.45 * share(x.entities, y.entities) + 0.2 * share(x.topics, y.topics) + 0.35 * share(x.title_tokens, y.title_tokens), 9)
            if x.day == y.day and score >= 0.65 and not (x.vals and y.vals and x.vals != y.vals):
                found.append((-score, n))
        if found:
            out[x.id] = (leads[min(found)[1]].id, -min(found)[0])
        else:
            leads.append(x)
            out[x.id] = (x.id, None)
    return out


def test_clusters_equal_brute_force(spark):
    """With one entity that most items have, few topics, items without entities, topics or titles, and ties of score."""
    g = np.random.default_rng(21)
    pick = lambda xs, k: " ".join(g.choice(xs, k, replace=False))
    names, words = ["Hot", "Acme Corp", "Beta Works", "Gamma"], [f"word{chr(97 + k)}" for k in range(8)]
    rows = []
    for k in range(250):
        said = " said. ".join(["Hot"] * int(g.random() < 0.7) + list(g.choice(names[1:], int(g.integers(0, 3)), replace=False))) + " said."
        value = ["", " 5%", " 7%"][int(g.choice(3, p=[0.7, 0.2, 0.1]))]
        rows.append((k, pick(words, int(g.integers(0, 5))), "x. " + said + value, dt.datetime(2026, 8, 1) + dt.timedelta(hours=int(g.integers(0, 60))), sorted(set(g.choice(["a", "b", "c"], int(g.integers(0, 3)))))))
    df = spark.createDataFrame(rows, "id long, title string, content string, published_at timestamp, topics array<string>")
    want = _brute_clusters(resolve.cluster_features(df).collect())
    got = {r.id: (r.cluster_id, r.score) for r in resolve.clusters(df).collect()}
    assert got == want and 20 < len({c for c, _ in want.values()}) < 200


def test_many_items_of_a_hot_entity_are_clustered_in_linear_time(spark):
    """Items of one day with one common entity and few topics: their clusters, without a pair of them being formed."""
    n = 20_000
    i = F.col("id")
    df = spark.range(n).select("id", F.concat(F.lit("title"), F.regexp_replace(F.conv(i, 10, 5), "[0-9]", "x"), F.lit(" "), F.translate(F.sha2(i.cast("string"), 256), "0123456789", "ghijklmnop")).alias("title"), F.lit("x. Hot said.").alias("content"), (F.lit("2026-08-01").cast("timestamp") + F.make_interval(secs=i.cast("decimal(18,6)"))).alias("published_at"), F.array((i % 4).cast("string")).alias("topics"))
    got = resolve.clusters(df)
    assert got.count() == n and got.select("cluster_id").distinct().count() == 4


def test_clusters_need_equal_values_and_day(spark):
    day = dt.datetime(2026, 8, 14, 6)
    base = {"topics": ["technology"], "content": "OpenAI grew 25% today"}
    rows = [_item(k, day + dt.timedelta(hours=k), base["content"], title="OpenAI revenue grows", topics=base["topics"]) for k in (1, 2, 3)]
    rows += [_item(4, day, "OpenAI grew 30% today", title="OpenAI revenue grows", topics=base["topics"]), _item(5, day + dt.timedelta(days=1), base["content"], title="OpenAI revenue grows", topics=base["topics"])]
    got = {r.id: r.cluster_id for r in resolve.clusters(spark.createDataFrame(pd.DataFrame(rows))).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == 5


def test_gate_names_each_change(spark):
    df = spark.createDataFrame([("a", "OpenAI tăng 25%", "OpenAI tăng 25%", "OpenAI tăng 25%", "OpenAI tăng 25% hôm nay"), ("b", "OpenAI tăng 25%", "x", "OpenAI giảm 26%", "y")], "id string, source_title string, source_content string, title string, summary string")
    df = df.withColumns({"claims": F.array(F.struct(F.col("title").alias("text"), F.array(F.col("source_title")).alias("evidence"))), "source_language": F.lit("vi"), "target_locale": F.lit("vi"), "glossary": F.lit(None).cast("array<struct<source_term:string,preferred_term:string,protected:boolean>>")})
    got = {r.id: r for r in quality.gate_v3(df).collect()}
    assert got["a"].passed and got["a"].score == 1.0
    assert {"NUMBER_CHANGED", "DIRECTION_REVERSED"} <= set(got["b"].failure_codes)


def test_article_paragraphs_once_without_boilerplate(spark):
    p = "A long enough paragraph about the news of the day, told once more."
    html = f"<article><p>{p}</p><p>{p}</p><p>Advertisement: buy this thing now, it is really good</p><p>Another paragraph that is long enough to be counted here.</p></article>"
    ld = '<script type="application/ld+json">{"@graph":[{"articleBody":"' + "body " * 40 + '"}]}</script>'
    df = spark.createDataFrame([(1, html, "f"), (2, ld, "f"), (3, None, "f")], "id int, html string, fallback string")
    got = {r.id: r for r in articles.extract_articles(df).collect()}
    assert got[1].content.count(p) == 1 and "Advertisement" not in got[1].content and got[1].origin == "article-html"
    assert got[2].origin == "json-ld" and got[3].content == "f"


def test_feeds_rss_atom_and_malformed(spark):
    rss = b"<rss><channel><title>P</title><item><title>A &amp; B</title><link>/a/1</link><pubDate>Fri, 14 Aug 2026 06:00:00 GMT</pubDate><description>&lt;b&gt;Hi&lt;/b&gt;</description></item><item><title>no date</title><link>/x</link></item></channel></rss>"
    atom = b'<feed><title>Q</title><entry><title>E</title><link rel="enclosure" href="https://q.org/e.mp3"/><link href="https://q.org/e"/><published>2026-08-14T06:00:00Z</published><summary>S</summary></entry></feed>'
    df = spark.createDataFrame([("r", "https://p.org/feed", bytearray(rss)), ("a", "https://q.org/feed", bytearray(atom)), ("m", "https://m.org", bytearray(b"<rss><channel>"))], "source_id string, final_url string, body binary")
    got = {r.source_id: r for r in articles.parse_feeds(df).collect()}
    assert set(got) == {"r", "a"} and got["r"].url == "https://p.org/a/1" and got["r"].title == "A & B" and got["r"].publisher == "P"
    assert got["a"].url == "https://q.org/e" and got["a"].path == "feed.entry[0]"


def test_provenance_status(spark):
    text = "Technology companies report growing revenue this quarter across many markets and regions of the world today"
    c = spark.createDataFrame([(k, u, "P", "Technology companies report growing revenue", text, dt.datetime(2026, 1, 1), 1, pol, "en", "en", "p.org") for k, u, pol in ((1, "https://p.org/news/1", "FULL_TEXT"), (2, "https://p.org/news/2", "FULL_TEXT"), (3, "https://p.org/news/3", "NONE"), (4, "https://p.org/news/4", "FULL_TEXT"))], "id int, url string, publisher string, title string, content string, published_at timestamp, tier int, license_policy string, language string, profile_language string, expected_host string")
    p = spark.createDataFrame([(1, 200, "https://www.p.org/news/1", f"<p>{text}</p>"), (2, 403, "https://p.org/news/2", ""), (3, 200, "https://p.org/news/3", text), (4, 200, "https://p.org/news/4", "<p>other</p>")], "id int, status int, final_url string, html string")
    got = {r.id: (r.provenance_status, r.provenance_errors) for r in articles.provenance(c, p).collect()}
    assert got[1] == ("VERIFIED", []) and got[2] == ("REJECTED", ["HTTP_403"]) and got[3][1] == ["LICENSE_POLICY_MISSING"] and got[4] == ("NEEDS_REVIEW", ["DETAIL_CONTENT_MISMATCH"])


LOG = "subscription_id long, ts timestamp, seq long, kind string, error_code string, rejected boolean"


def _log(rows, subscription=1):
    return [(subscription, dt.datetime(2026, 8, 14) + dt.timedelta(minutes=m), i, k, c, r) for i, (m, k, c, r) in enumerate(rows)]


def _circuits(spark, rows):
    """States after events, and how often time released a circuit."""
    got = circuit.circuit_states(spark.createDataFrame(_log(rows), LOG)).orderBy("seq").collect()
    return [r for r in got if r.seq is not None], [r for r in got if r.seq is None]


def test_circuit_opens_probes_and_closes(spark):
    got, timed = _circuits(spark, [(i, "failure", "NET", None) for i in range(5)] + [(30, "success", None, None)])
    assert [r.circuit for r in got] == ["CLOSED"] * 4 + ["OPEN", "CLOSED"]
    assert got[4].next_probe == dt.datetime(2026, 8, 14, 0, 19) and [(r.ts, r.circuit) for r in timed] == [(got[4].next_probe, "HALF_OPEN")]
    got, timed = _circuits(spark, [(i, "failure", "HTTP_403", None) for i in range(4)] + [(5, "pause", None, None), (600, "success", None, None), (601, "resume", None, None), (602, "odd", None, None)])
    assert [r.circuit for r in got] == ["CLOSED"] * 3 + ["OPEN", "MANUAL_PAUSED", "MANUAL_PAUSED", "CLOSED", "CLOSED"] and not timed
    assert _circuits(spark, [(i, "parse", None, i >= 6) for i in range(10)])[0][-1].circuit == "OPEN"
    got, timed = _circuits(spark, [(0, "failure", "NET", None)] * 5 + [(20, "failure", "NET", None), (49, "failure", "NET", None), (51, "failure", "NET", None)])
    assert [(r.ts - dt.datetime(2026, 8, 14)).seconds // 60 for r in timed] == [15] and got[5].next_probe == dt.datetime(2026, 8, 14, 0, 50)
    rows = _log([(0, "success", None, None)]) + [(None, dt.datetime(2026, 8, 14), 7, "failure", None, None), (2, None, 8, "failure", None, None)]
    assert circuit.circuit_states(spark.createDataFrame(rows, LOG)).count() == 2 and circuit.circuit_states(spark.createDataFrame([], LOG)).count() == 0


def test_circuit_state_is_carried_over_batches(spark):
    """A subscription's log that spans many batches and one that begins within a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        log = spark.createDataFrame([x for s in range(5) for x in _log([(i * 6, "failure" if i % 5 else "success", "NET", None) for i in range(60)], s)], LOG)
        small = circuit.circuit_states(log).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, small)) == sorted(map(str, circuit.circuit_states(log).collect())) and len({r.subscription_id for r in small}) == 5


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", circuit.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _streamed(spark, folder, log, name, **how):
    return circuit.circuit_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), **how).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").outputMode("append").start()


def test_circuit_stream_equals_batch(spark, tmp_path, rocks):
    """In two files; releases before a later event of the subscription are those of the batch."""
    log = spark.createDataFrame([x for s in (1, 2, 3) for x in _log([(i // 6 * 9 * s + (s * 7 if i % 6 == 5 else i % 6), "success" if i % 12 == 11 else "failure", "NET", None) for i in range(40)], s)], LOG)
    log.where("ts < '2026-08-14 00:30:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = _streamed(spark, tmp_path, log, "circuit2", clock="event")
    q.processAllAvailable()
    log.where("ts >= '2026-08-14 00:30:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("circuit2").collect(), circuit.circuit_states(log).collect()
    text = lambda rows: sorted(map(str, rows))
    assert text(r for r in got if r.seq is not None) == text(r for r in want if r.seq is not None)
    assert set(text(r for r in want if r.seq is None)) <= set(text(r for r in got if r.seq is None)) and any(r.seq is None for r in want)


@pytest.mark.parametrize("clock", ["event", "processing"])
def test_time_alone_opens_the_probe(spark, tmp_path, rocks, clock):
    """No event of the subscription follows: the watermark, moved by another one's events, or the time of day releases it."""
    log = spark.createDataFrame(_log([(0, "failure", "NET", None)] * 5, 1), LOG)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = _streamed(spark, tmp_path, log, f"timed_{clock}", clock=clock)
    q.processAllAvailable()
    if clock == "event":
        for minute in (60, 61):
            spark.createDataFrame(_log([(minute, "success", None, None)], 2), LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
    import time

    end = time.time() + 60
    while time.time() < end and not spark.table(f"timed_{clock}").where("circuit = 'HALF_OPEN'").count():
        time.sleep(1)
    q.stop()
    (r,) = spark.table(f"timed_{clock}").where("circuit = 'HALF_OPEN'").collect()
    assert (r.subscription_id, r.seq, r.ts) == (1, None, dt.datetime(2026, 8, 14, 0, 15))


def test_deliveries_once_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("a", dt.datetime(2026, 1, 1, 0, 1)), ("b", dt.datetime(2026, 1, 1))], "identity string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = circuit.distinct_deliveries(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == circuit.distinct_deliveries(df).count() == 2


def test_recurrence(spark):
    when = lambda s: dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([("DAILY", 2, [], when("2026-08-09")), ("WEEKLY", 1, [3], when("2026-08-09")), ("NONE", 1, [], when("2026-08-09"))], "type string, n int, days array<int>, after timestamp")
    nxt = ledger.next_occurrence(F.col("type"), F.col("n"), F.col("days"), F.lit("UTC"), F.lit("2026-12-31").cast("timestamp"), F.col("after"), F.col("after"))
    assert [r[0] for r in df.select(nxt).collect()] == [when("2026-08-11"), when("2026-08-12"), None]
    cal = ledger.lunar_calendar(spark, "2026-02-01", 60, "Asia/Ho_Chi_Minh")
    rules = spark.createDataFrame([(1, [1], "Asia/Ho_Chi_Minh", when("2026-12-31"), when("2026-02-10"), when("2026-02-10")), (2, [15], "Asia/Ho_Chi_Minh", when("2026-12-31"), when("2026-02-18"), when("2026-02-18"))], "rule_id int, lunar_days array<int>, zone string, until timestamp, after timestamp, preferred timestamp")
    assert {r.rule_id: r.next_at for r in ledger.next_lunar(rules, cal).collect()} == {1: when("2026-02-17"), 2: when("2026-03-03")}


def test_upsert_twice_changes_nothing(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    once = canonical.upsert(state, batch, ["k"])
    assert {r.k: r.change for r in once.collect()} == {1: "kept", 2: "updated", 3: "created"}
    twice = canonical.upsert(once.select("k", "v"), batch, ["k"])
    assert {r.k: r.change for r in twice.collect()} == {1: "kept", 2: "unchanged", 3: "unchanged"}


def test_alerts_in_order(spark):
    s = spark.createDataFrame([(1, 0.5, 400_000, 3, 10, 5, 10)], "stale_tier1 int, vi_coverage double, queue_age_ms int, n_429 int, requests int, rejections int, verified int")
    assert [r.code for r in metrics.alerts(s).orderBy("place").collect()] == ["TIER1_SOURCE_STALE", "VI_COVERAGE_LOW", "QUEUE_AGE_HIGH", "HTTP_429_SPIKE", "QUALITY_REJECTION_SPIKE"]


def test_land_and_retain(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * (articles.LARGE + 1))
    (tmp_path / "b.bin").write_bytes(b"y" * 10)
    got = {r.received_bytes: (len(r.body), r.truncated) for r in articles.land_payloads(spark, str(tmp_path)).collect()}
    assert got == {articles.LARGE + 1: (articles.CUT, True), 10: (10, False)}
    p = spark.createDataFrame([("FULL_TEXT", bytearray(b"z")), ("odd", bytearray(b"z"))], "policy string, body binary")
    r = {x.policy: x.body for x in articles.retain(p, "2026-01-01").collect()}
    assert r["FULL_TEXT"] == bytearray(b"z") and r["METADATA_ONLY"] is None


def test_retry_after(spark):
    f = lambda x: one(spark, x, lambda c: metrics.retry_after_ms(c, F.lit("2026-08-14 06:00:00").cast("timestamp")))
    assert f("120") == 120_000 and f("Fri, 14 Aug 2026 06:01:00 GMT") == 60_000 and f("soon") is None


def test_contract_names_the_first_error(spark):
    import json

    good = {"title": "t", "summary": "s", "claims": [{"text": "c", "evidence": ["src"]}], "preservedValues": ["1"], "preservedTerms": [], "sourceLanguage": "en", "targetLocale": "vi"}
    cases = [good, good | {"extra": 1}, good | {"claims": []}, good | {"targetLocale": "en"}, good | {"claims": [{"text": "c", "evidence": []}]}, good | {"claims": [{"text": "c", "evidence": ["other"]}]}, good | {"preservedValues": ["2"]}, good | {"preservedTerms": ["x"]}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(8, "no json")], "i int, o string")
    e = quality.contract_error(F.col("o"), F.lit("a src b"), F.array(F.lit("1")), F.array().cast("array<string>"), F.lit("en"), F.lit("vi"))
    got = [r.e for r in df.select("i", e.alias("e")).orderBy("i").collect()]
    assert got == [None, "LOCALIZATION_SCHEMA_INVALID", "LOCALIZATION_SCHEMA_INVALID", "LOCALIZATION_LOCALE_MISMATCH", "LOCALIZATION_EVIDENCE_REQUIRED", "LOCALIZATION_EVIDENCE_NOT_IN_SOURCE", "LOCALIZATION_VALUES_NOT_PRESERVED", "LOCALIZATION_TERMS_NOT_PRESERVED", "LOCALIZATION_SCHEMA_INVALID"]


def test_insights(spark):
    from newsloom.operators import insights

    base = spark.createDataFrame([(1, "NEW", None, None, None, None), (2, "NEW", None, None, None, dt.datetime(2026, 1, 1))], "id int, status string, useful boolean, saved boolean, read_at timestamp, seen_at timestamp")
    fb = spark.createDataFrame([(1, dt.datetime(2026, 1, 2), "READ", None, None), (1, dt.datetime(2026, 1, 3), None, True, None), (2, dt.datetime(2026, 1, 4), "READ", None, True)], "id int, ts timestamp, status string, useful boolean, saved boolean")
    got = {r.id: r for r in insights.fold_feedback(base, fb).collect()}
    assert got[1].status == "READ" and got[1].useful and got[1].seen_at == dt.datetime(2026, 1, 2) and got[2].seen_at == dt.datetime(2026, 1, 1) and got[2].saved
    rows = spark.createDataFrame([(1, 10, "ALERT", 0.9, "t", "c", "en", dt.datetime(2026, 1, 1), "a_code", "AI"), (2, 11, "NOTE", 0.7, "t", "c", None, dt.datetime(2026, 1, 4), "It is so.", None)], "id int, insight_id int, type string, importance double, title string, content string, language string, published_at timestamp, reason string, interest_name string")
    loc = spark.createDataFrame([(10, "vi", "T", "C", None)], "insight_id int, locale string, title string, content string, reason string")
    out = {r.id: r for r in insights.project(rows, loc, "vi", "2026-01-05").collect()}
    assert out[1].title == "T" and not out[1].fallback and out[1].bucket == "actionRequired" and out[1].freshness.fallback_window == "7d"
    assert out[2].served_locale == "unknown" and out[2].fallback and out[2].relevance_reason == "It is so."
