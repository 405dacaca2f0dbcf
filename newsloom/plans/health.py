"""Reliability, metrics and the circuit breaker over events and views."""

from pyspark.sql import functions as F

from newsloom.operators import metrics as m
from newsloom.plans.views import CONTENTS, LOCALIZATIONS, PUBLISHED, TOPICS, USERS, contents, load, localizations, published, users
from newsloom.streaming import circuit

AS_OF = "2024-01-20 00:00:00"
CODES = ["HTTP_403", "HTTP_429", "HTTP_500", "PARSER_INVALID_PAYLOAD"]


def _attempts(spark, d):
    e = load(spark, d, "events")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("event_id") % 4 + 1).cast("int"))
    bad = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("subscription_id"), "ts", F.col("event_id").alias("seq"), (~bad).alias("success"), F.when(bad, code).alias("error_code"), F.lit(86400).alias("interval_s"), F.col("value").alias("duration_ms"), "event_type", "props")


def health_runs(spark, d):
    r = _attempts(spark, d).select(F.col("event_type").alias("pipeline"), F.when(F.col("success"), "SUCCESS").otherwise("FAILED").alias("status"), F.col("ts").alias("started_at"), "duration_ms")
    return m.pipeline_health(r, AS_OF)


def health_sources(spark, d):
    return m.source_metrics(_attempts(spark, d), AS_OF).select("subscription_id", "attempts", "successes", F.round("success_rate", 6).alias("success_rate"), "stale")


def health_errors(spark, d):
    return m.error_totals(m.source_metrics(_attempts(spark, d), AS_OF))


def health_alerts(spark, d):
    a = _attempts(spark, d)
    labels = load(spark, d, "labels")
    one = a.agg(F.count("*").alias("requests"), F.count_if(F.col("error_code") == "HTTP_429").alias("n_429"))
    q = labels.agg(F.count_if(F.col("toxic") == 1).alias("rejections"), F.count_if(F.col("quality") == 1).alias("verified"), F.count("*").alias("all"))
    s = one.join(q, F.lit(True)).select("requests", "n_429", "rejections", "verified", F.lit(1).alias("stale_tier1"), (F.col("verified") / F.col("all")).alias("vi_coverage"), F.lit(400_000).alias("queue_age_ms"))
    return m.alerts(s).select("place", "code", "severity", F.round("value", 6).alias("value"), "threshold")


def health_latency(spark, d):
    return m.index_percentile(_attempts(spark, d).select("event_type", "duration_ms"), "duration_ms", 0.95, "event_type")


def health_retries(spark, d):
    a = _attempts(spark, d).where("not success")
    status = F.regexp_extract("error_code", "^HTTP_([0-9]+)$", 1).try_cast("int")
    r = m.retry_decision(F.col("error_code"), status, F.when(F.col("seq") % 3 == 0, F.lit(120_000)), (F.col("seq") % 7).cast("int"))
    return a.select("seq", r.alias("r")).select("seq", "r.*")


def health_before_stop(spark, d):
    a = _attempts(spark, d).withColumnRenamed("subscription_id", "source_id")
    return m.first_long_run(a, ["HTTP_403", "HTTP_429", "FETCH_FAILED"], 2).groupBy("source_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def health_next_sync(spark, d):
    a = _attempts(spark, d).groupBy("subscription_id").agg(F.max("ts").alias("ts"))
    return a.select("subscription_id", m.jittered_next_sync(F.col("subscription_id"), F.date_trunc("second", "ts"), F.lit(3600)).alias("next_sync_at"))


def health_due(spark, d):
    a = _attempts(spark, d).groupBy("subscription_id").agg(F.max("ts").alias("next_sync_at"))
    s = a.select("subscription_id", "next_sync_at", F.lit("ACTIVE").alias("status"), F.when(F.col("subscription_id") % 5 == 0, "PAUSED").otherwise("ACTIVE").alias("source_status"), F.when(F.col("subscription_id") % 3 == 0, F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("lease_expires_at"))
    return m.due_subscriptions(s, "2024-01-30 12:00:00", 50).select("subscription_id", "next_sync_at")


def health_props(spark, d):
    """Health of sources as JSON, some of it odd: what is no count doesn't count."""
    n, t = F.col("event_id"), F.col("event_id").cast("string")
    odd = F.element_at(F.array(*[F.lit(x) for x in ('"7"', "-3", "2.9", "null", "[1]")]), (n % 5 + 1).cast("int"))
    text = F.when(n % 13 == 0, "not json").otherwise(F.concat(F.lit('{"attempts":'), t, F.lit(',"successes":'), odd, F.lit(',"errors":{"HTTP_403":'), odd, F.lit(',"HTTP_429":'), t, F.lit('},"lastAttemptAt":'), F.when(n % 2 == 0, '"2024"').otherwise("5"), F.lit("}")))
    e = load(spark, d, "events").select("event_id", m.parsed_metrics(text).alias("h"))
    return e.select("event_id", "h.attempts", "h.successes", "h.parserAttempts", F.try_element_at("h.errors", F.lit("HTTP_403")).alias("e403"), F.try_element_at("h.errors", F.lit("HTTP_429")).alias("e429"), "h.lastAttemptAt")


def health_data(spark, d):
    """Runs of the last day, insights that wait for a locale, events that were rejected."""
    c = contents(spark, d)
    n = F.col("insight_id")
    i = c.select(F.col("content_id").alias("insight_id"))
    loc = i.select("insight_id", F.explode(F.when(n % 3 == 0, F.array(F.lit("vi"))).when(n % 3 == 1, F.array(F.lit("en"), F.lit("vi"), F.lit("vi"))).otherwise(F.array(F.lit("fr")))).alias("locale"))
    e = load(spark, d, "events")
    runs = _attempts(spark, d).select(F.col("event_type").alias("pipeline"), F.when(F.col("success"), "SUCCESS").otherwise("FAILED").alias("status"), F.col("ts").alias("started_at"), "duration_ms")
    events = e.select(F.when(F.col("event_id") % 3 == 0, "REJECTED").otherwise("PROCESSED").alias("status"), F.col("ts").alias("updated_at"))
    return m.data_health(runs, i, e.select((F.col("event_id") * 2).alias("insight_id")), loc, events, AS_OF)


def _snapshot(spark, d):
    a, (c, _) = _attempts(spark, d), published(spark, d)
    s = m.source_metrics(a, AS_OF).select("subscription_id", "interval_s", "last_success", "attempts", "successes", "errors", (F.col("subscription_id") % 3 + 1).alias("tier"))
    n = F.col("content_id")
    c = c.withColumn("provenance_status", F.when(n % 11 == 0, "REJECTED").otherwise(F.col("provenance_status"))).withColumn("duplicate_kind", F.when(n % 2 == 0, "EXACT_CONTENT_HASH"))
    loc = localizations(c).join(c.select("content_id", "published_at"), "content_id")
    i = F.col("localization_id")
    loc = loc.select("locale", F.when(i % 17 == 0, "FAILED").otherwise(F.col("status")).alias("status"), F.col("published_at").alias("generated_at"), "verified_at", F.when(F.col("status") == "VERIFIED", F.array().cast("array<string>")).otherwise(F.array(F.lit("NUMBER_CHANGED"), F.lit("EMPTY_OUTPUT"))).alias("failure_codes"), F.when(i % 5 != 0, (i % 8 * 0.25)).alias("cost_usd"))
    u = users(spark, d)
    matches = u.select("user_id", F.explode("interests").alias("topic"))
    return m.snapshot(s, c, c.where("cluster_id is not null").select("cluster_id"), loc, matches, u, AS_OF)


def content_snapshot(spark, d):
    """Content metrics as one row."""
    row = _snapshot(spark, d)[0]
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


def content_kinds(spark, d):
    return _snapshot(spark, d)[1]


def topics_inventory(spark, d):
    """Of the last time of publication."""
    c, now = published(spark, d)
    return m.topic_inventory(c, TOPICS, now)


def topics_available(spark, d):
    return m.available_topics(topics_inventory(spark, d), 60)


def feeds_compared(spark, d):
    c, p = contents(spark, d), load(spark, d, "pages")
    one = lambda f, keep: c.join(p.withColumnRenamed("page_id", "content_id"), "content_id").where(keep).select(F.lit(f).alias("feed"), F.col("content_id").cast("string").alias("id"), "url", "publisher", "published_at", F.col("importance").alias("relevance"), (F.col("lang") == "en").alias("localized"), F.lit(False).alias("blocking_error"), "title")
    items = one("v1", F.col("tier") >= 1).unionByName(one("v2", F.col("tier") == 1)).withColumn("duplicate_key", F.md5("title")).drop("title")
    return m.both_feeds(m.compare_feeds(items, "2024-03-01 00:00:00"))


def _log(spark, d):
    a = _attempts(spark, d)
    kind = F.when(~F.col("success"), "failure").when(F.col("event_type") == "signup", "parse").otherwise("success")
    return a.select("subscription_id", "ts", "seq", kind.alias("kind"), "error_code", (F.col("seq") % 3 == 0).alias("rejected"))


def circuit_batch(spark, d):
    """Circuits after each attempt, and their releases by time."""
    return circuit.circuit_states(_log(spark, d))


def fetch_buckets(spark, d):
    return circuit.logical_fetches(_log(spark, d), "1 hour").select("subscription_id", "bucket", "ts", "seq")


ATT = f"""att AS (SELECT user_id AS subscription_id, ts, event_id AS seq, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN ['{"', '".join(CODES)}'][event_id % 4 + 1] END AS error_code, value AS duration_ms, event_type, props FROM events)"""
NOW = f"TIMESTAMP '{AS_OF}'"
_SNAP = f"""{ATT}, {CONTENTS}, {USERS}, {PUBLISHED}, {LOCALIZATIONS}, p AS (SELECT * REPLACE (CASE WHEN content_id % 11 = 0 THEN 'REJECTED' ELSE provenance_status END AS provenance_status) FROM published),
g AS (SELECT subscription_id, count(*) AS attempts, count(*) FILTER (success) AS successes, max(ts) FILTER (success) AS ls FROM att GROUP BY ALL), s AS (SELECT *, ls IS NULL OR floor(epoch({NOW})) - floor(epoch(ls)) > 3 * 86400 AS stale FROM g),
c AS (SELECT count(*) FILTER (provenance_status = 'VERIFIED' AND duplicate_of_id IS NULL) AS accepted, count(*) FILTER (provenance_status = 'REJECTED') AS rejected, count(duplicate_of_id) AS duplicates, count(cluster_id) AS cluster_members, count(DISTINCT cluster_id) AS clusters FROM p),
lo AS (SELECT l.locale, l.status AS was, CASE WHEN localization_id % 17 = 0 THEN 'FAILED' ELSE l.status END AS status, epoch_ms(l.verified_at) - epoch_ms(p.published_at) AS ms, CASE WHEN localization_id % 5 <> 0 THEN localization_id % 8 * 0.25::DOUBLE END AS cost FROM localizations l JOIN published p USING (content_id)),
l AS (SELECT count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'VERIFIED' AND locale = 'vi') AS vi, count(*) FILTER (status = 'FAILED') AS provider_errors, coalesce(avg(ms) FILTER (status = 'VERIFIED'), 0) AS latency_ms, sum(cost) AS cost_usd, 2 * count(*) FILTER (was <> 'VERIFIED') AS rejections FROM lo),
u AS (SELECT CAST(sum(len(interests)) AS BIGINT) AS matches, count(*) AS users FROM users)"""
_OPENS = "(circuit_now = 'HALF_OPEN' OR failures + 1 >= 5 OR (attempts + 1 >= 4 AND greatest(e403 + is403, e429 + is429) >= 0.5 * (attempts + 1)))"
_SPIKE = "(parses + 1 >= 10 AND rejects + rejected >= 0.4 * (parses + 1))"
CIRCUIT = f"""WITH RECURSIVE {ATT}, log AS (SELECT subscription_id, ts, seq, CASE WHEN NOT success THEN 'failure' WHEN event_type = 'signup' THEN 'parse' ELSE 'success' END AS kind,
  CAST(coalesce(error_code, '') = 'HTTP_403' AS INT) AS is403, CAST(coalesce(error_code, '') = 'HTTP_429' AS INT) AS is429, CAST(seq % 3 = 0 AS INT) AS rejected, row_number() OVER (PARTITION BY subscription_id ORDER BY ts, seq) AS k FROM att),
g AS (SELECT DISTINCT subscription_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS seq, 'CLOSED' AS circuit, 0 AS failures, 0 AS attempts, 0 AS parses, 0 AS rejects, 0 AS e403, 0 AS e429, CAST(NULL AS TIMESTAMP) AS probe, CAST(NULL AS TIMESTAMP) AS released FROM log
UNION ALL SELECT subscription_id, k, ts, seq, CASE WHEN kind = 'success' THEN 'CLOSED' WHEN kind = 'failure' AND {_OPENS} OR kind = 'parse' AND {_SPIKE} THEN 'OPEN' ELSE circuit_now END,
  CASE kind WHEN 'success' THEN 0 WHEN 'failure' THEN failures + 1 ELSE failures END, attempts + CAST(kind <> 'parse' AS INT), parses + CAST(kind = 'parse' AS INT), rejects + CASE WHEN kind = 'parse' THEN rejected ELSE 0 END,
  e403 + CASE WHEN kind = 'failure' THEN is403 ELSE 0 END, e429 + CASE WHEN kind = 'failure' THEN is429 ELSE 0 END,
  CASE WHEN kind = 'success' THEN NULL WHEN kind = 'failure' AND {_OPENS} THEN ts + to_minutes(15 * CAST(least(8, pow(2, greatest(0, failures - 4))) AS INT)) WHEN kind = 'parse' AND {_SPIKE} THEN ts + INTERVAL 15 MINUTE ELSE probe END,
  CASE WHEN circuit_now <> circuit THEN probe END
  FROM (SELECT g.* EXCLUDE (k, ts, seq), l.* EXCLUDE (subscription_id), CASE WHEN g.circuit = 'OPEN' AND l.ts >= g.probe THEN 'HALF_OPEN' ELSE g.circuit END AS circuit_now FROM g JOIN log l ON l.subscription_id = g.subscription_id AND l.k = g.k + 1)),
before AS (SELECT *, lag(failures) OVER (PARTITION BY subscription_id ORDER BY k) AS was FROM g)
SELECT subscription_id, ts, seq, circuit, failures, probe AS next_probe FROM g WHERE k > 0
UNION ALL SELECT subscription_id, released, NULL, 'HALF_OPEN', was, released FROM before WHERE released IS NOT NULL"""
ORACLE_SQL = {
    "circuit_batch": CIRCUIT,
    "health_runs": f"WITH {ATT} SELECT event_type AS pipeline, CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END AS status, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms FROM att WHERE ts > {NOW} - INTERVAL 24 HOUR AND ts <= {NOW} GROUP BY ALL",
    "health_sources": f"""WITH {ATT}, g AS (SELECT subscription_id, count(*) AS attempts, count(*) FILTER (success) AS successes, max(ts) FILTER (success) AS ls FROM att GROUP BY ALL)
SELECT subscription_id, attempts, successes, round(successes::DOUBLE / attempts, 6) AS success_rate, ls IS NULL OR floor(epoch({NOW})) - floor(epoch(ls)) > 3 * 86400 AS stale FROM g""",
    "health_errors": f"WITH {ATT} SELECT error_code, count(*) AS n FROM att WHERE NOT success GROUP BY ALL",
    "health_alerts": f"""WITH {ATT}, s AS (SELECT (SELECT count(*) FROM att) AS requests, (SELECT count(*) FROM att WHERE error_code = 'HTTP_429') AS n429,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS rej, (SELECT count(*) FROM labels WHERE quality = 1) AS ver, (SELECT count(*) FROM labels) AS al),
r AS (SELECT 1 AS o, 'TIER1_SOURCE_STALE' AS code, 'critical' AS severity, 1.0::DOUBLE AS value, 0.0::DOUBLE AS threshold, true AS ok FROM s UNION ALL
SELECT 2, 'VI_COVERAGE_LOW', 'critical', ver::DOUBLE / al, 0.8, ver::DOUBLE / al < 0.8 FROM s UNION ALL SELECT 3, 'QUEUE_AGE_HIGH', 'warning', 400000, 300000, true FROM s UNION ALL
SELECT 4, 'HTTP_429_SPIKE', 'warning', n429::DOUBLE / greatest(1, requests), 0.2, n429::DOUBLE / greatest(1, requests) > 0.2 FROM s UNION ALL
SELECT 5, 'QUALITY_REJECTION_SPIKE', 'critical', rej::DOUBLE / greatest(1, rej + ver), 0.2, rej::DOUBLE / greatest(1, rej + ver) > 0.2 FROM s)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS place, code, severity, round(value, 6) AS value, threshold FROM r WHERE ok""",
    "health_latency": f"WITH {ATT}, n AS (SELECT event_type, duration_ms, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY duration_ms) AS r FROM att) SELECT event_type, duration_ms AS percentile FROM n WHERE r = least(floor(n * 0.95), n - 1) + 1",
    "health_retries": f"""WITH {ATT}, a AS (SELECT seq, error_code AS c, CASE WHEN seq % 3 = 0 THEN 120000 END AS ra, power(2, greatest(0, seq % 7 - 1)) AS p FROM att WHERE NOT success)
SELECT seq, c <> 'PARSER_INVALID_PAYLOAD' AS retry, CAST(CASE c WHEN 'PARSER_INVALID_PAYLOAD' THEN 0 WHEN 'HTTP_429' THEN greatest(coalesce(ra, 0), least(900000, 60000 * p)) WHEN 'HTTP_500' THEN least(120000, 5000 * p) ELSE least(300000, 10000 * p) END AS BIGINT) AS delay_ms, c AS error_code FROM a""",
    "health_before_stop": f"""WITH {ATT}, h AS (SELECT *, coalesce(error_code IN ('HTTP_403', 'HTTP_429'), false) AS hit, row_number() OVER (PARTITION BY subscription_id ORDER BY ts, seq) AS i FROM att),
p AS (SELECT *, hit AND lag(hit, 1, false) OVER (PARTITION BY subscription_id ORDER BY i) AS two FROM h), s AS (SELECT *, min(i) FILTER (two) OVER (PARTITION BY subscription_id) AS stop FROM p)
SELECT subscription_id AS source_id, count(*) AS n, max(seq) AS last_seq FROM s WHERE stop IS NULL OR i <= stop GROUP BY ALL""",
    "health_next_sync": f"WITH {ATT}, g AS (SELECT subscription_id, date_trunc('second', max(ts)) AS ts FROM att GROUP BY ALL) SELECT subscription_id, ts + INTERVAL 1 HOUR + to_milliseconds(CAST(floor(3600 * 50 * (('0x' || substr(sha256(CAST(subscription_id AS VARCHAR)), 1, 4))::INT / 65535.0::DOUBLE)) AS BIGINT)) AS next_sync_at FROM g",
    "health_due": f"WITH {ATT}, g AS (SELECT subscription_id, max(ts) AS next_sync_at FROM att GROUP BY ALL) SELECT * FROM g WHERE subscription_id % 5 <> 0 AND subscription_id % 3 <> 0 AND next_sync_at <= TIMESTAMP '2024-01-30 12:00:00' ORDER BY next_sync_at, subscription_id LIMIT 50",
    "health_props": """WITH o AS (SELECT event_id, event_id % 13 <> 0 AS ok, CASE WHEN event_id % 5 = 2 THEN 2 END AS k FROM events)
SELECT event_id, CASE WHEN ok THEN event_id ELSE 0 END AS attempts, CASE WHEN ok THEN coalesce(k, 0) ELSE 0 END AS successes, 0 AS "parserAttempts", CASE WHEN ok THEN k END AS e403, CASE WHEN ok THEN event_id END AS e429, CASE WHEN ok AND event_id % 2 = 0 THEN '2024' END AS "lastAttemptAt" FROM o""",
    "health_data": f"""WITH {ATT} SELECT event_type AS what, CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END AS status, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms FROM att WHERE ts > {NOW} - INTERVAL 24 HOUR AND ts <= {NOW} GROUP BY ALL
UNION ALL SELECT 'pendingLocalizations', NULL, count(*), NULL FROM documents WHERE doc_id IN (SELECT event_id * 2 FROM events) AND doc_id % 3 <> 1
UNION ALL SELECT 'rejectedEvents', NULL, count(*), NULL FROM events WHERE event_id % 3 = 0 AND ts >= {NOW} - INTERVAL 24 HOUR AND ts <= {NOW}""",
    "content_snapshot": f"""WITH {_SNAP} SELECT sum(attempts) AS requests, sum(successes) AS _s, count(*) FILTER (subscription_id % 3 = 0 AND stale) AS stale_tier1, (SELECT count(*) FROM att WHERE error_code = 'HTTP_429') AS n_429, any_value(c.accepted) AS accepted, any_value(c.rejected) AS rejected, any_value(c.duplicates) AS duplicates,
  any_value(c.cluster_members) AS cluster_members, any_value(c.clusters) AS clusters, any_value(l.verified) AS verified, any_value(l.provider_errors) AS provider_errors, round(any_value(l.latency_ms), 6) AS latency_ms, round(any_value(l.cost_usd), 6) AS cost_usd, any_value(l.rejections) AS rejections,
  any_value(u.matches) AS matches, any_value(u.users) AS users, round(sum(successes) / sum(attempts), 6) AS success_rate, round(any_value(c.rejected) / (any_value(c.accepted) + any_value(c.rejected)), 6) AS rejection_rate, round(any_value(c.clusters) / any_value(c.cluster_members), 6) AS compression,
  round(any_value(l.vi) / any_value(c.accepted), 6) AS vi_coverage, round(any_value(u.matches) / any_value(u.users), 6) AS matches_per_user FROM s, c, l, u""".replace("sum(successes) AS _s, ", ""),
    "content_kinds": f"""WITH {_SNAP} SELECT 'duplicate' AS "group", CASE WHEN content_id % 2 = 0 THEN 'EXACT_CONTENT_HASH' ELSE 'UNKNOWN' END AS kind, count(*) AS n FROM p WHERE duplicate_of_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'error', error_code, count(*) FROM att WHERE NOT success GROUP BY ALL UNION ALL SELECT 'failure', k, count(*) FROM lo, (VALUES ('NUMBER_CHANGED'), ('EMPTY_OUTPUT')) x(k) WHERE was <> 'VERIFIED' GROUP BY k""",
    "topics_inventory": f"WITH {CONTENTS}, {PUBLISHED}, t AS (SELECT unnest(topics) AS topic, publisher, published_at FROM published) SELECT topic, count(*) AS items, count(*) FILTER (published_at >= (SELECT max(published_at) FROM published) - INTERVAL 7 DAY) AS fresh, max(published_at) AS latest, count(DISTINCT publisher) AS publishers FROM t GROUP BY topic",
    "topics_available": f"WITH {CONTENTS}, {PUBLISHED}, t AS (SELECT unnest(topics) AS topic, published_at FROM published) SELECT topic FROM t GROUP BY topic HAVING count(*) >= 60 AND count(*) FILTER (published_at >= (SELECT max(published_at) FROM published) - INTERVAL 7 DAY) >= 1",
    "feeds_compared": f"""WITH {CONTENTS}, j AS (SELECT c.*, p.url FROM contents c JOIN pages p ON p.page_id = c.content_id), i AS (SELECT 'v1' AS feed, * FROM j UNION ALL SELECT 'v2', * FROM j WHERE tier = 1),
g AS (SELECT feed, count(*) AS coverage, round(greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-03-01') - epoch(max(published_at))) / 3600), 2) AS fh, round((count(*) - count(DISTINCT title))::DOUBLE / count(*), 4) AS dr,
  round(count(*) FILTER (NOT regexp_matches(url, '^(?i)https?://[^/\\s]+'))::DOUBLE / count(*), 4) AS br, round(count(*) FILTER (lang = 'en')::DOUBLE / count(*), 4) AS lr, round(avg(importance), 4) AS rel, round(count(DISTINCT publisher)::DOUBLE / count(*), 4) AS sd FROM i GROUP BY feed)
SELECT a.coverage AS v1_coverage, a.fh AS v1_freshness_hours, a.dr AS v1_duplicate_rate, a.br AS v1_broken_url_rate, a.lr AS v1_localized_rate, a.rel AS v1_relevance, a.sd AS v1_source_diversity,
  b.coverage AS v2_coverage, b.fh AS v2_freshness_hours, b.dr AS v2_duplicate_rate, b.br AS v2_broken_url_rate, b.lr AS v2_localized_rate, b.rel AS v2_relevance, b.sd AS v2_source_diversity,
  array_to_string(list_filter([CASE WHEN b.br > a.br THEN 'BROKEN_URL_RATE_INCREASED' END, CASE WHEN b.dr > a.dr THEN 'DUPLICATE_RATE_INCREASED' END, CASE WHEN b.coverage < least(a.coverage, 10) THEN 'VI_COVERAGE_INSUFFICIENT' END], lambda x: x IS NOT NULL), ',') AS blockers,
  CASE WHEN b.br > a.br OR b.dr > a.dr OR b.coverage < least(a.coverage, 10) THEN 'NO_GO' ELSE 'GO' END AS decision FROM g a JOIN g b ON a.feed = 'v1' AND b.feed = 'v2'""",
    "fetch_buckets": f"WITH {ATT} SELECT subscription_id, date_trunc('hour', ts) AS bucket, min(ts) AS ts, min_by(seq, (ts, seq)) AS seq FROM att GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (health_runs, health_sources, health_errors, health_alerts, health_latency, health_retries, health_before_stop, health_next_sync, health_due, health_props, health_data, content_snapshot, content_kinds, topics_inventory, topics_available, feeds_compared, circuit_batch, fetch_buckets)}
