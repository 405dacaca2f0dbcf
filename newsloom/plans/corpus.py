"""Duplicates, clusters, persistence and account jobs over the views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.operators import insights
from newsloom.operators import resolve as r
from newsloom.plans import texts
from newsloom.plans.views import CONTENTS, PUBLISHED, TOPICS, USERS, contents, load, published, users
from newsloom.sources import canonical as k


def _items(spark, d):
    c = contents(spark, d)
    return c.select(
        F.col("content_id").alias("id"), F.col("publisher").alias("source_id"), F.col("content_id").cast("string").alias("external_id"), F.concat(F.lit("https://news.example.org/a/"), F.col("content_id").cast("string")).alias("url"),
        "title", "content", "published_at", F.col("published_at").alias("created_at"), "topics", "tier", "authority",
    )


def duplicates_resolved(spark, d):
    return r.resolve_duplicates(_items(spark, d))


def duplicates_arriving(spark, d):
    """The last third of the items arrives after the rest has been resolved; the state is that of all at once."""
    c = _items(spark, d).drop("topics", "tier", "authority")
    late = c.agg(F.percentile_approx("published_at", 2 / 3).alias("t"))
    c = c.join(F.broadcast(late), F.lit(True)).withColumn("_late", F.col("published_at") > F.col("t")).drop("t")
    early = c.where("not _late").drop("_late")
    stored = early.join(r.resolve_duplicates(early), "id")
    return r.resolve_arrivals(stored, c.where("_late").drop("_late").withColumn("arrival", F.unix_micros("published_at")))


def clusters_built(spark, d):
    return r.clusters(_items(spark, d))


def clusters_primary(spark, d):
    """Primaries of the groups of one publisher and day."""
    c = contents(spark, d)
    m = c.select(F.concat_ws("/", "publisher", F.to_date("published_at").cast("string")).alias("cluster_id"), F.col("content_id").alias("id"), "tier", "authority", F.lit(False).alias("all_items"), "published_at", F.length("content").alias("length"), (F.col("content_id") % 10 != 0).alias("verified"))
    return r.primary(m, "2024-01-10 00:00:00").where("is_primary").select("cluster_id", "id", "primary_score")


def _versions(spark, d):
    """Orders as versions of a customer's item: its first order is what is current. Some come under another external id of
    the same source and URL, some from another source, which may not have the URL."""
    o = load(spark, d, "orders").where("o_orderkey is not null")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = o.select(
        F.concat(F.lit("s"), (c % 5).cast("string")).alias("source_id"), c.cast("string").alias("external_id"), F.concat(F.lit("u"), c.cast("string")).alias("url"), F.col("o_orderstatus").alias("content_hash"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=(k % 86400).cast("decimal(18,6)"))).alias("fetched_at"), "o_orderkey",
    )
    v = v.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "o_orderkey")))
    late = F.col("_r") > 1
    return v.withColumns({
        "external_id": F.when(late & (k % 11 == 0), F.concat("external_id", F.lit("b"))).otherwise(F.col("external_id")),
        "source_id": F.when(late & (k % 13 == 0), F.lit("s9")).otherwise(F.col("source_id")),
    })


def _persisted(spark, d):
    v = _versions(spark, d)
    current = v.where("_r = 1").select("source_id", "external_id", "url", "content_hash", "title", "published_at", F.lit(1).alias("revision"))
    return k.persist_canonical(current, v.where("_r > 1").drop("_r", "o_orderkey"))


def canonical_persisted(spark, d):
    return _persisted(spark, d)["current"]


def canonical_revisions(spark, d):
    """What later versions replaced, whole."""
    return _persisted(spark, d)["revisions"]


def canonical_conflicts(spark, d):
    """Versions whose URL another source owns."""
    return _persisted(spark, d)["conflicts"].groupBy("source_id", "url", "error").agg(F.count("*").alias("n"), F.max("fetched_at").alias("last"))


def upserted(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    state = c.where("c_custkey % 3 <> 0")
    batch = c.where("c_custkey % 2 = 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return k.upsert(state, batch, ["c_custkey"])


def selection_changes(spark, d):
    u = users(spark, d)
    old = u.select("user_id", F.explode("interests").alias("topic")).withColumn("refinements", F.array("topic"))
    new = u.select("user_id", F.explode(F.array(F.get("interests", F.lit(0)), F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("user_id") % 7 + 1).cast("int")))).alias("topic")).distinct()
    new = new.withColumn("refinements", F.when(F.col("user_id") % 2 == 0, F.array("topic")).otherwise(F.array(F.lit("other"))))
    return k.affected_topics(old, new)


def account_purge(spark, d):
    gone = load(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"))
    tables = {"orders": load(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "events": load(spark, d, "events").select("user_id")}
    return k.purge_users(tables, gone)[1]


def status_audit(spark, d):
    c = contents(spark, d).select(F.col("content_id").alias("id"), F.when(F.col("tier") == 1, "VERIFIED").otherwise("NEEDS_REVIEW").alias("status"))
    bad = load(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return k.set_status(c, bad, "REJECTED", "toxic")[1]


def glossary_chosen(spark, d):
    """Words of the benchmark as terms of a glossary, with their conflicts."""
    b = load(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("source_term"))
    e = b.select(F.lit("en").alias("source_language"), F.lit("vi").alias("target_locale"), "source_term", F.concat(F.lit("t"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("preferred_term"), F.lit(None).cast("string").alias("short_term"), (F.col("item_id") % 3 == 0).alias("protected"), F.lit("default").alias("domain"), F.lit("v1").alias("version"))
    return k.glossary_winners(e)[0].select("term", "preferred_term", "protected")


def topic_interest_counts(spark, d):
    """Users by interest, with the total of all."""
    u = users(spark, d).select(F.explode("interests").alias("topic"))
    return u.rollup("topic").agg(F.count("*").alias("n")).select(F.coalesce("topic", F.lit("all")).alias("topic"), "n")


def importance_by_age(spark, d):
    """Importance and bucket of items by age."""
    c, now = published(spark, d)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("published_at")) / 3.6e9
    imp = insights.importance_by_age(age)
    kind = F.when(imp >= 0.75, "ALERT").otherwise("INSIGHT")
    return c.select("content_id", imp.alias("importance"), kind.alias("type"), insights.bucket(kind, imp).alias("bucket"))


VERSIONS = """n AS (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS fetched_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate + to_seconds(o_orderkey % 86400), o_orderkey) AS r FROM orders),
v AS (SELECT CASE WHEN r > 1 AND o_orderkey % 13 = 0 THEN 's9' ELSE 's' || (o_custkey % 5) END AS source_id, CAST(o_custkey AS VARCHAR) || CASE WHEN r > 1 AND o_orderkey % 11 = 0 THEN 'b' ELSE '' END AS external_id, 'u' || o_custkey AS url, o_orderstatus AS content_hash,
  o_orderstatus || ' ' || o_orderpriority AS title, CAST(o_orderdate AS TIMESTAMP) AS published_at, fetched_at, r FROM n),
l AS (SELECT *, lag(content_hash) OVER w AS before, row_number() OVER w AS k FROM v WHERE source_id <> 's9' WINDOW w AS (PARTITION BY url ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, fetched_at, content_hash, external_id)),
m AS (SELECT source_id, external_id, url, content_hash, title, CAST(row_number() OVER (PARTITION BY url ORDER BY k) AS INT) AS revision, min(published_at) FILTER (r = 1) OVER (PARTITION BY url) AS published_at FROM (SELECT *, coalesce(before <> content_hash, true) AS new, published_at AS p FROM l) WHERE new)"""
_SEMANTIC = f"sha256({texts.SEM('title')} || chr(10) || {texts.SEM('content')})"
_J = lambda c: f"CASE WHEN len(x.{c}) + len(y.{c}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x.{c}, y.{c}))::DOUBLE / len(list_distinct(list_concat(x.{c}, y.{c}))) END"
_DATE = r"CASE WHEN regexp_full_match(x, '\d{1,2}[/-]\d{1,2}[/-]\d{4}') THEN regexp_replace(strftime(strptime(replace(x, '-', '/'), '%d/%m/%Y'), '%Y-%m-%d'), '$', 'T00:00:00.000Z') WHEN regexp_full_match(x, '\d{4}-\d{2}-\d{2}') THEN coalesce(strftime(try_cast(x AS TIMESTAMP), '%Y-%m-%dT00:00:00.000Z'), x) ELSE x END"
_VALUES = ", ".join(f"r{i + 1} AS (SELECT n, regexp_replace(c, '{texts.RE2(q)}', chr(1), 'g') AS c, list_concat(v, list_transform(regexp_extract_all(c, '{texts.RE2(q)}'), lambda x: {_DATE if kind == 'DATE_TIME' else f"regexp_replace(regexp_replace(x, '{texts.S}+', ' ', 'g'), '^ | $', '', 'g')"})) AS v FROM r{i})" for i, (kind, q) in enumerate(t.FACTS))
_ENTITIES = f"""list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(b, '{texts.RE2(t.PRODUCT_IDS)}'), regexp_extract_all(b, '{texts.RE2(t.NAMES)}')), lambda x: regexp_replace(x, '^{texts.S}+|{texts.S}+$', '', 'g')),
  lambda x: NOT regexp_matches(lower(x), '^(?:{"|".join(t.LEAD_WORDS)})(?: |$)') AND NOT regexp_matches(x, '(?i)\\b{t.PRODUCT}\\b.*\\s|\\s.*\\b{t.PRODUCT}\\b')))"""
ORACLE_SQL = {
    "duplicates_resolved": f"""WITH RECURSIVE {CONTENTS}, b AS (SELECT content_id AS id, row_number() OVER (ORDER BY published_at, content_id) AS n, published_at AS at, {_SEMANTIC} AS h, {texts.FP("title || chr(10) || content")} AS fp,
  list_sort(list_distinct(list_concat(regexp_extract_all(title || chr(10) || content, '{texts.RE2(t.NUMBERS)}'), regexp_extract_all(title || chr(10) || content, '{texts.RE2(t.CAPITALISED)}')))) AS inv FROM contents),
k AS (SELECT *, list_distinct(list_filter(string_split(fp, ' '), lambda x: length(x) >= 2)) AS tok FROM b),
p AS (SELECT x.n AS early, y.n AS late, 2 AS kind, 1.0::DOUBLE AS score FROM k x JOIN k y ON x.h = y.h AND x.n < y.n AND y.at - x.at <= INTERVAL 3 DAY
  UNION ALL SELECT x.n, y.n, CASE WHEN x.fp = y.fp THEN 3 ELSE 4 END, CASE WHEN x.fp = y.fp THEN 1.0::DOUBLE ELSE len(list_intersect(x.tok, y.tok))::DOUBLE / len(list_distinct(list_concat(x.tok, y.tok))) END FROM k x JOIN k y ON x.inv = y.inv AND x.n < y.n AND y.at - x.at <= INTERVAL 3 DAY
  WHERE x.fp = y.fp OR (y.at - x.at <= INTERVAL 1 DAY AND len(x.tok) >= 0.9 * len(y.tok) AND len(y.tok) >= 0.9 * len(x.tok) AND 10 * len(list_intersect(x.tok, y.tok)) >= 9 * len(list_distinct(list_concat(x.tok, y.tok))))),
w AS (SELECT late, list(early) AS es FROM p GROUP BY late),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS led UNION ALL SELECT g.n + 1, CASE WHEN list_has_any(coalesce(es, CAST([] AS BIGINT[])), led) THEN led ELSE list_append(led, g.n + 1) END FROM g LEFT JOIN w ON late = g.n + 1 WHERE g.n < (SELECT count(*) FROM b)),
l AS (SELECT unnest(led) AS n FROM g WHERE n = (SELECT count(*) FROM b)),
best AS (SELECT late, min_by(struct_pack(early := early, kind := kind, score := score), (kind, -score, early)) AS m FROM p WHERE early IN (SELECT n FROM l) AND late NOT IN (SELECT n FROM l) GROUP BY late)
SELECT y.id, x.id AS duplicate_of_id, {r.KINDS}[m.kind + 1] AS duplicate_kind, m.score AS duplicate_score FROM b y LEFT JOIN best ON late = y.n LEFT JOIN b x ON x.n = m.early""",
    "clusters_built": f"""WITH RECURSIVE {CONTENTS}, n AS (SELECT content_id AS id, row_number() OVER (ORDER BY published_at, content_id) AS n, strftime(published_at, '%Y-%m-%d') AS day, title || chr(10) || content AS b, list_sort(topics) AS topics, title FROM contents),
r0 AS (SELECT n, b AS c, CAST([] AS VARCHAR[]) AS v FROM n), {_VALUES},
m AS (SELECT n.*, list_sort(list_distinct(v)) AS vals, {_ENTITIES} AS ents, list_distinct(list_filter(string_split({texts.FP('title')}, ' '), lambda x: length(x) >= 3)) AS words FROM n JOIN r{len(t.FACTS)} USING (n)),
j AS (SELECT x.n AS early, y.n AS late, round(0.45::DOUBLE * {_J('ents')} + 0.2::DOUBLE * {_J('topics')} + 0.35::DOUBLE * {_J('words')}, 9) AS score FROM m x JOIN m y ON x.day = y.day AND x.n < y.n AND (len(x.vals) = 0 OR len(y.vals) = 0 OR x.vals = y.vals)),
p AS (SELECT * FROM j WHERE score >= 0.65), w AS (SELECT late, list(early) AS es FROM p GROUP BY late),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS led UNION ALL SELECT g.n + 1, CASE WHEN list_has_any(coalesce(es, CAST([] AS BIGINT[])), led) THEN led ELSE list_append(led, g.n + 1) END FROM g LEFT JOIN w ON late = g.n + 1 WHERE g.n < (SELECT count(*) FROM n)),
l AS (SELECT unnest(led) AS n FROM g WHERE n = (SELECT count(*) FROM n)),
best AS (SELECT late, min_by(struct_pack(early := early, score := score), (-score, early)) AS m FROM p WHERE early IN (SELECT n FROM l) AND late NOT IN (SELECT n FROM l) GROUP BY late)
SELECT y.id, coalesce(x.id, y.id) AS cluster_id, best.m.score AS score FROM n y LEFT JOIN best ON late = y.n LEFT JOIN n x ON x.n = best.m.early""",
    "clusters_primary": f"""WITH {CONTENTS}, s AS (SELECT publisher || '/' || CAST(CAST(published_at AS DATE) AS VARCHAR) AS cluster_id, content_id AS id, round(0.25::DOUBLE * (4 - tier) / 3 + 0.25::DOUBLE * authority + 0.15::DOUBLE * CASE WHEN tier = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
  + 0.15::DOUBLE * greatest(0.0::DOUBLE, 1 - (epoch_us(TIMESTAMP '2024-01-10') - epoch_us(published_at)) / 3.6e9::DOUBLE / 72) + 0.2::DOUBLE * least(1.0::DOUBLE, length(content) / 1500.0::DOUBLE) - CASE WHEN content_id % 10 <> 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END, 6) AS primary_score FROM contents)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY primary_score DESC, id) = 1""",
    "canonical_persisted": f"WITH {VERSIONS} SELECT * FROM m QUALIFY revision = max(revision) OVER (PARTITION BY url)",
    "canonical_revisions": f"WITH {VERSIONS} SELECT * FROM m QUALIFY revision < max(revision) OVER (PARTITION BY url)",
    "canonical_conflicts": f"WITH {VERSIONS} SELECT source_id, url, '{k.CONFLICT}' AS error, count(*) AS n, max(fetched_at) AS last FROM v WHERE source_id = 's9' GROUP BY ALL",
    "upserted": """WITH s AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, coalesce(b.c_mktsegment, s.c_mktsegment) AS c_mktsegment, coalesce(b.c_nationkey, s.c_nationkey) AS c_nationkey,
  CASE WHEN s.c_mktsegment IS NULL THEN 'created' WHEN b.c_mktsegment IS NULL THEN 'kept' WHEN s.c_nationkey = b.c_nationkey THEN 'unchanged' ELSE 'updated' END AS change FROM s FULL JOIN b USING (c_custkey)""",
    "selection_changes": f"""WITH {USERS}, o AS (SELECT user_id, unnest(interests) AS topic FROM users), n AS (SELECT DISTINCT user_id, topic FROM (SELECT user_id, interests[1] AS topic FROM users UNION ALL SELECT user_id, ['{"', '".join(TOPICS)}'][user_id % 7 + 1] FROM users)),
j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.topic, n.topic) AS topic, CASE WHEN o.topic IS NULL THEN 'added' WHEN n.topic IS NULL THEN 'removed' WHEN n.user_id % 2 <> 0 THEN 'changed' END AS change FROM o FULL JOIN n ON o.user_id = n.user_id AND o.topic = n.topic)
SELECT * FROM j WHERE change IS NOT NULL""",
    "account_purge": "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)",
    "status_audit": f"WITH {CONTENTS} SELECT content_id AS id, CASE WHEN tier = 1 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS old_status, 'REJECTED' AS new_status, 'toxic' AS reason FROM contents WHERE content_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "topic_interest_counts": f"WITH {USERS}, u AS (SELECT unnest(interests) AS topic FROM users) SELECT topic, count(*) AS n FROM u GROUP BY topic UNION ALL SELECT 'all', count(*) FROM u",
    "importance_by_age": f"""WITH {CONTENTS}, {PUBLISHED}, a AS (SELECT content_id, (epoch_us((SELECT max(published_at) FROM published)) - epoch_us(published_at)) / 3.6e9::DOUBLE AS age FROM published)
SELECT content_id, CASE WHEN age <= 6 THEN 0.82::DOUBLE WHEN age <= 24 THEN 0.72::DOUBLE ELSE 0.58::DOUBLE END AS importance, CASE WHEN age <= 6 THEN 'ALERT' ELSE 'INSIGHT' END AS type, CASE WHEN age <= 6 THEN 'actionRequired' WHEN age <= 24 THEN 'important' ELSE 'informational' END AS bucket FROM a""",
    "glossary_chosen": """WITH b AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), e AS (SELECT trim(regexp_replace(lower(w), '\\s+', ' ', 'g')) AS term, 't' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS preferred_term, item_id % 3 = 0 AS protected FROM b)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY term ORDER BY protected DESC, preferred_term) = 1""",
}
ORACLE_SQL["duplicates_arriving"] = ORACLE_SQL["duplicates_resolved"]
QUERIES = {f.__name__: f for f in (duplicates_resolved, duplicates_arriving, clusters_built, clusters_primary, canonical_persisted, canonical_revisions, canonical_conflicts, upserted, selection_changes, account_purge, status_audit, glossary_chosen, topic_interest_counts, importance_by_age)}
