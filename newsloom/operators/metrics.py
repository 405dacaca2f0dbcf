"""Pipeline health, source reliability, inventories, alerts and comparisons."""

from __future__ import annotations

from functools import reduce

from newsloom.functions.scratch import written
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the alert rules, the retry rules and the circuit.
NON_RETRYABLE = ["PARSER_INVALID_PAYLOAD", "VALIDATION_REJECTED", "PROVENANCE_REJECTED", "JOB_VERSION_UNSUPPORTED", "JOB_PAYLOAD_INVALID"]
ALERTS = {"coverage": 0.8, "queue_age_ms": 300_000, "rate_429": 0.2, "quality_rejection": 0.2}


def ratio(n: Column, d: Column, default: float) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def topic_inventory(contents: DataFrame, catalog: list[str], as_of: str) -> DataFrame:
    """Items, fresh items (7 days), latest time and publishers of each catalog topic."""
    now = F.lit(as_of).cast("timestamp")
    t = contents.select(F.explode("topics").alias("topic"), "publisher", "published_at").where(F.col("topic").isin(catalog))
    return t.groupBy("topic").agg(F.count("*").alias("items"), F.count_if(F.col("published_at") >= now - F.expr("interval 7 days")).alias("fresh"), F.max("published_at").alias("latest"), F.count_distinct("publisher").alias("publishers"))


def available_topics(inventory: DataFrame, items: int = 5) -> DataFrame:
    return inventory.where((F.col("items") >= items) & (F.col("fresh") >= 1)).select("topic")


def pipeline_health(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Runs of the last day: count and mean duration by pipeline and status."""
    now = F.lit(as_of).cast("timestamp")
    r = runs.where((F.col("started_at") > now - F.make_interval(hours=F.lit(hours))) & (F.col("started_at") <= now))
    return r.groupBy("pipeline", "status").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


def source_metrics(attempts: DataFrame, as_of: str) -> DataFrame:
    """Per subscription: attempts, successes, success rate, error totals as a map, staleness (never
    succeeded, or longer ago than three intervals of at least a minute)."""
    a = attempts.groupBy("subscription_id").agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"), F.max("interval_s").alias("interval_s"),
    )
    errors = attempts.where(~F.col("success")).groupBy("subscription_id", "error_code").agg(F.count("*").alias("n"))
    errors = errors.groupBy("subscription_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_code", "n")))).alias("errors"))
    now = F.lit(as_of).cast("timestamp")
    age = F.unix_seconds(now) - F.unix_seconds(F.col("last_success").cast("timestamp"))
    stale = F.col("last_success").isNull() | (age > 3 * F.greatest(F.lit(60), F.col("interval_s")))
    return a.join(errors, "subscription_id", "left").withColumns({"success_rate": ratio(F.col("successes"), F.col("attempts"), 1.0), "stale": stale})


def parsed_metrics(text: Column) -> Column:
    """(attempts, successes, parserAttempts, parserRejected, errors, lastAttemptAt) of a source's health as JSON: counts are numbers cut off towards 0,
    and 0 for what is none or negative; errors without such a count go; a time that is no text is null."""
    v = F.try_parse_json(text)
    number = lambda x: F.when(F.rlike(F.schema_of_variant(x), F.lit("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")), F.try_variant_get(x, "$", "double"))
    good = lambda x: F.when(number(x) >= 0, F.floor(number(x)).cast("long"))
    of = lambda c: F.try_variant_get(v, f"$.{c}", "variant")
    count = lambda c: F.coalesce(good(of(c)), F.lit(0)).alias(c)
    errors = F.coalesce(F.try_variant_get(v, "$.errors", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    errors = F.map_filter(F.transform_values(errors, lambda _, x: good(x)), lambda _, x: x.isNotNull())
    at = F.when(F.schema_of_variant(of("lastAttemptAt")) == "STRING", F.try_variant_get(v, "$.lastAttemptAt", "string"))
    return F.struct(*[count(c) for c in ("attempts", "successes", "parserAttempts", "parserRejected")], errors.alias("errors"), at.alias("lastAttemptAt"))


def data_health(runs: DataFrame, insights: DataFrame, user_insights: DataFrame, localizations: DataFrame, events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Rows (what, status, n, mean_ms): runs by pipeline and status, the insights that some user has and that lack one of the two
    locales, and the events that were rejected in the last ``hours``."""
    now = F.lit(as_of).cast("timestamp")
    have = localizations.where(F.col("locale").isin("vi", "en")).groupBy("insight_id").agg(F.count_distinct("locale").alias("_l"))
    used = insights.join(user_insights.select("insight_id"), "insight_id", "left_semi").join(have, "insight_id", "left")
    pending = used.agg(F.count_if(F.coalesce("_l", F.lit(0)) < 2).alias("n"))
    rejected = events.agg(F.count_if((F.col("status") == "REJECTED") & (F.col("updated_at") >= now - F.make_interval(hours=F.lit(hours))) & (F.col("updated_at") <= now)).alias("n"))
    one = lambda df, what: df.select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("status"), "n", F.lit(None).cast("double").alias("mean_ms"))
    by = pipeline_health(runs, as_of, hours).withColumnRenamed("pipeline", "what")
    return by.unionByName(one(pending, "pendingLocalizations")).unionByName(one(rejected, "rejectedEvents"))


def snapshot(subscriptions: DataFrame, contents: DataFrame, members: DataFrame, localizations: DataFrame, matches: DataFrame, users: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """One row of content metrics, and the counts by kind: (group, kind, n) of duplicates, source errors and quality failures.

    ``subscriptions(tier, interval_s, last_success, attempts, successes, errors map)``, ``contents(provenance_status, duplicate_of_id,
    duplicate_kind)``, ``members(cluster_id)``, ``localizations(locale, status, generated_at, verified_at, failure_codes, cost_usd)``. Rates without a
    denominator are 1 (success, compression, coverage) or 0. Each table is read once, combined on the map side."""
    now = F.lit(as_of).cast("timestamp")
    age = F.unix_seconds(now) - F.unix_seconds(F.col("last_success").cast("timestamp"))
    stale = F.col("last_success").isNull() | (age > 3 * F.greatest(F.lit(60), F.col("interval_s")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = subscriptions.agg(zero(F.sum("attempts")).alias("requests"), zero(F.sum("successes")).alias("_ok"), F.count_if((F.col("tier") == 1) & stale).alias("stale_tier1"), zero(F.sum(F.try_element_at("errors", F.lit("HTTP_429")))).cast("long").alias("n_429"))
    lone = F.col("duplicate_of_id").isNull()
    c = contents.agg(F.count_if((F.col("provenance_status") == "VERIFIED") & lone).alias("accepted"), F.count_if(F.col("provenance_status") == "REJECTED").alias("rejected"), F.count("duplicate_of_id").alias("duplicates"))
    m = members.agg(F.count("*").alias("cluster_members"), F.count_distinct("cluster_id").alias("clusters"))
    good = F.col("status") == "VERIFIED"
    took = F.when(good, F.unix_millis(F.col("verified_at").cast("timestamp")) - F.unix_millis(F.col("generated_at").cast("timestamp")))
    codes = zero(F.sum(F.greatest(F.lit(0), F.size("failure_codes"))))
    l = localizations.agg(F.count_if(good).alias("verified"), F.count_if(good & (F.col("locale") == "vi")).alias("_vi"), F.count_if(F.col("status") == "FAILED").alias("provider_errors"), F.coalesce(F.avg(took), F.lit(0.0)).alias("latency_ms"), zero(F.sum("cost_usd")).cast("double").alias("cost_usd"), codes.alias("rejections"))  # noqa: E741
    row = reduce(lambda x, y: x.join(y, F.lit(True)), [s, c, m, l, matches.agg(F.count("*").alias("matches")), users.agg(F.count("*").alias("users"))])
    n = F.col
    row = row.withColumns({
        "success_rate": ratio(n("_ok"), n("requests"), 1.0), "rejection_rate": ratio(n("rejected"), n("accepted") + n("rejected"), 0.0), "compression": ratio(n("clusters"), n("cluster_members"), 1.0),
        "vi_coverage": ratio(n("_vi"), n("accepted"), 1.0), "matches_per_user": ratio(n("matches"), n("users"), 0.0),
    }).drop("_ok", "_vi")
    kinds = contents.where(~lone).groupBy(F.coalesce("duplicate_kind", F.lit("UNKNOWN")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("group"), "kind", "n")
    errors = subscriptions.select(F.explode("errors").alias("kind", "n")).groupBy("kind").agg(F.sum("n").cast("long").alias("n")).select(F.lit("error").alias("group"), "kind", "n")
    failures = localizations.select(F.explode("failure_codes").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("failure").alias("group"), "kind", "n")
    return row, kinds.unionByName(errors).unionByName(failures)


def error_totals(metrics: DataFrame) -> DataFrame:
    """Sums over the sources' error maps."""
    return metrics.select(F.explode("errors").alias("error_code", "n")).groupBy("error_code").agg(F.sum("n").alias("n"))


def alerts(snapshot: DataFrame) -> DataFrame:
    """Alert rows of ``snapshot(stale_tier1, vi_coverage, queue_age_ms, n_429, requests, rejections, verified)``, in the
    order of the rules."""
    a = ALERTS
    rate = F.col("n_429") / F.greatest(F.lit(1), F.col("requests"))
    rejected = F.col("rejections") / F.greatest(F.lit(1), F.col("rejections") + F.col("verified"))
    one = lambda cond, code, severity, value, threshold: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold")))
    rules = F.array(
        one(F.col("stale_tier1") > 0, "TIER1_SOURCE_STALE", "critical", F.col("stale_tier1"), 0), one(F.col("vi_coverage") < a["coverage"], "VI_COVERAGE_LOW", "critical", F.col("vi_coverage"), a["coverage"]),
        one(F.col("queue_age_ms") > a["queue_age_ms"], "QUEUE_AGE_HIGH", "warning", F.col("queue_age_ms"), a["queue_age_ms"]), one(rate > a["rate_429"], "HTTP_429_SPIKE", "warning", rate, a["rate_429"]),
        one(rejected > a["quality_rejection"], "QUALITY_REJECTION_SPIKE", "critical", rejected, a["quality_rejection"]),
    )
    return snapshot.select(F.posexplode(F.array_compact(rules)).alias("place", "a")).select("place", "a.*")


def compare_feeds(items: DataFrame, as_of: str) -> DataFrame:
    """One row comparing feeds v1 and v2 of ``items(feed, id, url, publisher, published_at, relevance, localized,
    blocking_error, duplicate_key)``: measures of both, blockers, decision."""
    now = F.lit(as_of).cast("timestamp")
    n = F.count("*")
    # rounded as doubles, not by their decimal digits: 522 s are 0.14 h, not 0.15 h, and 57 of 800 are 0.0712
    places = lambda x, k: F.floor(x * 10**k + 0.5) / 10**k
    r4 = lambda x: places(F.when(n > 0, x / n).otherwise(0.0), 4)
    hours = F.greatest(F.lit(0.0), (F.unix_seconds(now) - F.unix_seconds(F.max("published_at"))) / 3600)
    by = items.groupBy("feed").agg(
        n.alias("coverage"), places(hours, 2).alias("freshness_hours"),
        r4(n - F.count_distinct("duplicate_key")).alias("duplicate_rate"), r4(F.count_if(~F.coalesce(F.rlike("url", F.lit("^(?i)https?://[^/\\s]+")), F.lit(False)))).alias("broken_url_rate"),
        r4(F.count_if("localized")).alias("localized_rate"), places(F.avg("relevance"), 4).alias("relevance"), r4(F.count_distinct(F.when(F.col("publisher") != "", F.col("publisher")))).alias("source_diversity"),
        F.max("blocking_error").alias("blocking"), F.count_if(F.col("id").isNull()).alias("no_id"),
    )
    names = [c for c in by.columns if c != "feed"]
    pick = lambda f, c: F.coalesce(F.max(F.when(F.col("feed") == f, F.col(c))), F.lit(False) if c == "blocking" else F.lit(0))
    row = by.agg(*[pick(f, c).alias(f"{f}_{c}") for f in ("v1", "v2") for c in names])
    c = F.col
    blockers = F.array_compact(F.array(
        F.when(c("v2_broken_url_rate") > c("v1_broken_url_rate"), "BROKEN_URL_RATE_INCREASED"), F.when(c("v2_duplicate_rate") > c("v1_duplicate_rate"), "DUPLICATE_RATE_INCREASED"),
        F.when(c("v2_blocking"), "BLOCKING_LOCALIZATION_ERROR_LEAKED"), F.when(c("v2_coverage") < F.least(c("v1_coverage"), F.lit(10)), "VI_COVERAGE_INSUFFICIENT"),
        F.when(c("v2_no_id") > 0, "PAGINATION_COMPATIBILITY_FAILED")))
    return row.withColumn("blockers", F.array_join(blockers, ",")).withColumn("decision", F.when(F.col("blockers") == "", "GO").otherwise("NO_GO")).drop("v1_blocking", "v2_blocking", "v1_no_id", "v2_no_id")


def both_feeds(compared: DataFrame) -> DataFrame:
    """The comparison if both feeds have items, else no row."""
    return compared.where((F.col("v1_coverage") > 0) & (F.col("v2_coverage") > 0))


#: Rows of which a sketch leaves 4 in ACCURACY undecided; keys of fewer rows are decided as a whole.
ACCURACY = 10_000


def index_percentile(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The value at index floor(n * p) of each key's sorted values, nulls first; exact.

    A sketch of each key, combined on the map side, gives two values that the wanted one lies between. What is below is counted, what is
    between is counted by value, and only the distinct values between, some 4 in ACCURACY of a key's rows, are put in order."""
    v = F.col(value)
    ends = F.percentile_approx(v, [max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)], ACCURACY)
    own = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(v).alias("_m"), F.min(v).alias("_min"), F.max(v).alias("_max"), ends.alias("_e"))
    rank = F.least(F.floor(F.col("_n") * p), F.col("_n") - 1) + 1 - (F.col("_n") - F.col("_m"))
    few = F.col("_m") <= ACCURACY
    own = written(own.select(*keys, rank.alias("_rank"), F.when(few, F.col("_min")).otherwise(F.col("_e")[0]).alias("_lo"), F.when(few, F.col("_max")).otherwise(F.col("_e")[1]).alias("_hi")))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
    j = df.select(*keys, value).join(own, same(df, own)).select(*[own[k] for k in keys], v, "_rank", "_lo", "_hi")
    place = F.when(v < F.col("_lo"), F.lit(None)).otherwise(v)
    counts = j.where(v.isNotNull() & (v <= F.col("_hi"))).groupBy(*keys, "_rank", place.alias("_v")).agg(F.count("*").alias("_c"))
    running = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    found = counts.withColumn("_to", F.sum("_c").over(running)).where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank")) & (F.col("_rank") > 0))
    nulls = own.where("_rank <= 0").select(*keys, F.lit(None).cast(df.schema[value].dataType).alias("percentile"))
    return found.select(*keys, F.col("_v").alias("percentile")).unionByName(nulls)


def retry_decision(code: Column, status: Column, retry_after_ms: Column, attempts: Column) -> Column:
    """(retry, delay_ms, error_code) of a failed job."""
    name = F.coalesce(code, F.when(status.isNotNull(), F.concat(F.lit("HTTP_"), status.cast("string"))), F.lit("NETWORK_ERROR"))
    power = F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1))
    limited = (status == 429) | (name == "HTTP_429")
    delay = (
        F.when(name.isin(NON_RETRYABLE), F.lit(0.0)).when(limited, F.greatest(F.coalesce(retry_after_ms, F.lit(0)).cast("double"), F.least(F.lit(900_000.0), 60_000.0 * power)))
        .when(status >= 500, F.least(F.lit(120_000.0), 5_000.0 * power)).otherwise(F.least(F.lit(300_000.0), 10_000.0 * power))
    )
    shown = F.when(F.coalesce(limited, F.lit(False)) & ~name.isin(NON_RETRYABLE), "HTTP_429").otherwise(name)
    return F.struct((~name.isin(NON_RETRYABLE)).alias("retry"), delay.cast("long").alias("delay_ms"), shown.alias("error_code"))


def retry_after_ms(header: Column, as_of: Column) -> Column:
    """Retry-After as milliseconds: seconds, or an HTTP date."""
    when = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3},\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(header.try_cast("double") * 1000, F.when(when.isNotNull(), F.greatest(F.lit(0), F.unix_millis(when) - F.unix_millis(as_of))).cast("double")).cast("long")


def stable_code(message: Column) -> Column:
    """The message's part before the first colon if it is a stable code, else UNCLASSIFIED_ERROR."""
    head = F.substring(F.trim(F.substring_index(message, ":", 1)), 1, 80)
    return F.when(F.rlike(head, F.lit("^[A-Z][A-Z0-9_]{2,79}$")), head).otherwise("UNCLASSIFIED_ERROR")


def due_subscriptions(subs: DataFrame, as_of: str, limit: int) -> DataFrame:
    """Active subscriptions of active sources that are due and not leased, the most overdue first."""
    now = F.lit(as_of).cast("timestamp")
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    due = subs.where((F.col("status") == "ACTIVE") & (F.col("source_status") == "ACTIVE") & (F.col("next_sync_at") <= now) & free)
    return due.orderBy(F.col("next_sync_at").asc_nulls_first(), "subscription_id").limit(max(1, min(limit, 500)))


def jittered_next_sync(subscription_id: Column, now: Column, interval_s: Column) -> Column:
    """Now + interval + up to a twentieth of it, by the id's hash."""
    h = F.conv(F.substring(F.sha2(subscription_id.cast("string"), 256), 1, 4), 16, 10).cast("double") / 65535
    return F.timestamp_millis(F.unix_millis(now) + interval_s * 1000 + F.floor(interval_s * 50 * h))


def first_long_run(attempts: DataFrame, codes: list[str], length: int = 3) -> DataFrame:
    """Rows of each source before its first run of ``length`` consecutive errors among ``codes``: gaps and islands."""
    order = Window.partitionBy("source_id").orderBy("ts", "seq")
    hit = F.coalesce(F.col("error_code").isin(codes), F.lit(False))
    a = attempts.withColumn("_hit", hit).withColumn("_i", F.row_number().over(order)).withColumn("_g", F.col("_i") - F.sum(F.col("_hit").cast("int")).over(order))
    inside = Window.partitionBy("source_id", "_g", "_hit").orderBy("_i")
    a = a.withColumn("_run", F.when(F.col("_hit"), F.row_number().over(inside)).otherwise(0))
    stop = F.min(F.when(F.col("_run") >= length, F.col("_i"))).over(Window.partitionBy("source_id"))
    return a.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop"))).drop("_hit", "_i", "_g", "_run", "_stop")
