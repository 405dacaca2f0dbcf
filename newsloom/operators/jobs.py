"""Job logs: payload checks and the triage of failed jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text fields that a payload of each type must have (fixed values).
FIELDS = {
    "DISCOVER_DUE_SOURCES": ["scheduleBucket"], "FETCH_SOURCE": ["sourceId", "subscriptionId", "scheduleBucket"], "NORMALIZE_PAYLOAD": ["sourceId", "rawPayloadId"],
    "VALIDATE_CONTENT": ["sourceId", "canonicalContentId"], "CLUSTER_CONTENT": ["canonicalContentId", "policyVersion"],
    "LOCALIZE_CONTENT": ["canonicalContentId", "sourceContentHash", "policyVersion", "glossaryVersion"], "MATCH_USERS": ["canonicalContentId", "policyVersion"],
    "BUILD_BRIEFS": ["dateBucket"], "BACKFILL_CONTENT": [], "REPLAY_PAYLOAD": ["sourceId", "rawPayloadId", "reason"],
}
VERSION = 1
LOCALES = ["vi", "en", "zh-Hans"]
#: Errors that a retry mends only under another policy (fixed values).
NEEDS_POLICY = ["VALIDATION_REJECTED", "PROVENANCE_REJECTED", "LOCALIZATION_QUALITY_REJECTED", "LOCALIZATION_SCHEMA_INVALID"]


def text_field(v: Column, name: str) -> Column:
    """A field of a variant if it is text, else null."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def number_field(v: Column, name: str) -> Column:
    """A field of a variant if it is a finite number, else null: no text that looks like one."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    n = F.try_variant_get(v, f"$.{name}", "double")
    return F.when(~F.coalesce(F.schema_of_variant(x).isin("STRING", "BOOLEAN", "VOID"), F.lit(True)) & ~F.isnan(n) & (F.abs(n) < float("inf")), n)


def text_array_field(v: Column, name: str) -> Column:
    """The text members of an array field; empty for anything else."""
    xs = F.try_variant_get(v, f"$.{name}", "array<variant>")
    return F.coalesce(F.transform(F.filter(xs, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string")), F.array().cast("array<string>"))


def payload_error(payload: Column) -> Column:
    """Code of the check that a job's JSON payload fails, or null."""
    v = F.try_parse_json(payload)
    said = lambda f: F.coalesce(text_field(v, f) != "", F.lit(False))
    whole = lambda f: F.coalesce(number_field(v, f) == F.floor(number_field(v, f)), F.lit(False))
    kind = text_field(v, "type")
    locale = text_field(v, "locale")
    given = F.try_variant_get(v, "$.locale", "variant").isNotNull()
    ok = said("correlationId") & said("pipelineRunId") & whole("attempt") & (number_field(v, "attempt") >= 0)
    rules = F.lit(False)
    for name, fields in FIELDS.items():
        good = F.lit(True)
        for f in fields:
            good = good & said(f)
        if name == "LOCALIZE_CONTENT":
            good = good & F.coalesce(locale.isin(LOCALES), F.lit(False))
        if name == "BUILD_BRIEFS":
            good = good & (~given | F.coalesce(locale.isin(LOCALES), F.lit(False)))
        if name == "BACKFILL_CONTENT":
            good = good & whole("batchSize") & (number_field(v, "batchSize") > 0)
        rules = F.when(kind == name, good).otherwise(rules)
    version = F.coalesce(number_field(v, "version") == VERSION, F.lit(False))
    return F.when(~version, "JOB_VERSION_UNSUPPORTED").when(~F.coalesce(ok & rules, F.lit(False)), "JOB_PAYLOAD_INVALID")


def triage(failed: DataFrame, subscriptions: DataFrame, limit: int, policy_changed: bool = False, **only: str) -> DataFrame:
    """The first ``limit`` of ``failed(job_id, type, source_id, error_code, failed_at)``, the newest first, of the asked type,
    source or error; ``action`` is RETRY, or why not: an error that only another policy mends, or a source of which a
    circuit of ``subscriptions(source_id, circuit)`` is open or paused."""
    for column, value in only.items():
        failed = failed.where(F.col(column) == value)
    first = failed.orderBy(F.col("failed_at").desc(), "job_id").limit(limit)
    shut = subscriptions.where(F.col("circuit").isin("OPEN", "MANUAL_PAUSED")).select("source_id").distinct().withColumn("_shut", F.lit(True))
    j = first.join(shut, "source_id", "left")
    policy = F.col("error_code").isin(NEEDS_POLICY) & F.lit(not policy_changed)
    return j.withColumn("action", F.when(policy, "POLICY_CHANGE_REQUIRED").when(F.col("_shut"), "SOURCE_CIRCUIT_OPEN").otherwise("RETRY")).drop("_shut")
