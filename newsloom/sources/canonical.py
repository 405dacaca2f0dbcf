"""Keyed sinks: upserts, revisions, backfill, selections, purges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from newsloom.functions.scratch import Scratch, written
from newsloom.operators.graph import components
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: rows of ``batch`` replace those of ``state`` with their key, others stay; ``change`` says created,
    updated, unchanged or kept. ``batch`` has each key once."""
    values = [c for c in state.columns if c not in keys]
    s = state.select(*keys, F.struct(*values).alias("_s"), F.lit(True).alias("_in"))
    b = batch.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_new"))
    j = s.join(b, keys, "full_outer")
    change = F.when(F.col("_in").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_s").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    v = F.when(F.col("_new"), F.col("_b")).otherwise(F.col("_s"))
    return j.select(*keys, *[v[c].alias(c) for c in values], change.alias("change"))


CONFLICT, TAKEN = "CANONICAL_URL_SOURCE_CONFLICT", "CANONICAL_URL_TAKEN"
#: What a version with the hash of the one before refreshes, where it gives a value; all else stays until the text changes.
REFRESHED = ("raw_payload_id", "verified_at", "provenance_status", "updated_from_source", "metadata")
#: What a revision doesn't replace.
FIRST = ("published_at",)


class Store:
    """The items of one component, by (source, external id) and by URL, as versions are taken in one after the other. Small."""

    def __init__(self):
        self.items: list[dict] = []
        self.by_id: dict[tuple, dict] = {}
        self.by_url: dict[str, dict] = {}

    def _index(self, x: dict) -> None:
        self.by_id[x["source_id"], x["external_id"]] = x
        if x["url"] is not None:
            self.by_url[x["url"]] = x

    def hold(self, x: dict) -> None:
        self.items.append(x)
        self._index(x)

    def take(self, v: dict) -> tuple[dict | None, str | None]:
        """What a version replaces, as it was, or why it can't be taken in."""
        mine, owner = self.by_id.get((v["source_id"], v["external_id"])), self.by_url.get(v["url"])
        if owner is not None and owner["source_id"] != v["source_id"]:
            return None, CONFLICT
        x = mine or owner
        if x is None:
            self.hold(v | {"revision": 1})
            return None, None
        if x["content_hash"] == v["content_hash"]:
            x |= {c: v[c] for c in REFRESHED if v.get(c) is not None}
            return None, None
        if owner is not None and owner is not x:
            return None, TAKEN
        old = dict(x)
        self.by_id.pop((x["source_id"], x["external_id"]))
        self.by_url.pop(x["url"], None)
        kept = {c: x[c] for c in FIRST} | {c: x[c] for c in ("raw_payload_id", "verified_at", "provenance_status") if c in x and v.get(c) is None}
        x |= v | kept | {"revision": x["revision"] + 1}
        self._index(x)
        return old, None


def _keys() -> tuple[Column, Column]:
    """An item's two keys as texts of their own; without a URL there is only the first."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
    one = F.concat(F.lit("i"), F.coalesce(part("source_id"), F.lit("-")), F.coalesce(part("external_id"), F.lit("-")))
    return one, F.coalesce(F.concat(F.lit("u"), F.col("url")), one)


def touched(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` with ``_hit``: whether an item has the source and external id, or the URL, of a version in ``batch``."""
    one, two = _keys()
    b = batch.select(F.explode(F.array_distinct(F.array(one, two))).alias("_k")).distinct()
    c = current.withColumn("_row", F.struct(*current.columns)).withColumn("_k", F.explode(F.array_distinct(F.array(one, two))))
    hits = c.join(b, "_k").select(one.alias("_i")).distinct().withColumn("_h", F.lit(True))
    return current.withColumn("_i", one).join(hits, "_i", "left").withColumn("_hit", F.coalesce("_h", F.lit(False))).drop("_i", "_h")


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows; times as whole numbers, which are cheaper than datetimes and fit where times are written."""
    columns = [(c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist() for c in b.columns]
    return (dict(zip(b.schema.names, r, strict=True)) for r in zip(*columns, strict=True))


def persist_canonical(current: DataFrame, batch: DataFrame) -> dict[str, DataFrame]:
    """Versions of ``batch(source_id, external_id, url, content_hash, title, published_at, fetched_at, ...)`` against
    ``current(the same but fetched_at, revision)``: the next ``current``, ``revisions`` (what versions replaced, whole, with its
    number), and ``conflicts`` (versions with an error).

    Versions follow each other by fetched_at (nulls first), then content_hash, external_id and url. One is the version of the item with its source and external
    id, else of the item with its URL: a new hash replaces it, but for the first published_at; the same hash only refreshes
    REFRESHED. A version whose URL another source's item has, in ``current`` or earlier in the batch, is a conflict
    (CONFLICT), and so is one that would take the URL of another item of its source (TAKEN).

    Items and versions that share a key, directly or through others, are one component; only those of ``current`` whose
    keys the batch has are looked at, the rest passes. A component's versions are sorted within a partition and read one
    after the other; a task holds a component's items, not its versions."""
    spark = current.sparkSession
    scratch = Scratch(spark, "canonical")
    values = [c for c in current.columns if c != "revision"]
    batch = scratch.save(batch)
    marked = scratch.save(touched(current, batch))
    one, two = _keys()
    rows = marked.where("_hit").select(*values, F.lit(None).cast("timestamp").alias("fetched_at"), F.col("revision").cast("int").alias("revision")).unionByName(batch.select(*values, "fetched_at", F.lit(None).cast("int").alias("revision")))
    keyed = rows.withColumn("_i", one).withColumn("_u", two)
    part = scratch.save(components(keyed.select(F.col("_i").alias("a"), F.col("_u").alias("b")).distinct(), scratch))
    keyed = keyed.join(part, F.col("_i") == part.id, "left").withColumn("_part", F.coalesce("component", "_i"))
    order = ["_part", F.col("revision").isNull(), F.col("fetched_at").asc_nulls_first(), "content_hash", "external_id", "url"]
    keyed = keyed.repartition("_part").sortWithinPartitions(*order).select(*values, "fetched_at", "revision", "_part")
    out = T.StructType([*[f for f in keyed.schema.fields if f.name != "_part"], T.StructField("_kind", T.StringType())])

    def run(batches):
        part, store, first = None, Store(), True
        names = [f.name for f in out.fields]
        for b in batches:
            done = []
            schema = pa.schema([b.schema.field(c) for c in names[:-1]]).append(pa.field("_kind", pa.string()))
            for r in _rows(b):
                key, at, revision = r.pop("_part"), r.pop("fetched_at"), r.pop("revision")
                if first or key != part:
                    done += [x | {"fetched_at": None, "_kind": "current"} for x in store.items]
                    first, part, store = False, key, Store()
                if revision is not None:
                    store.hold(r | {"revision": revision})
                    continue
                old, error = store.take(r)
                if old is not None:
                    done.append(old | {"fetched_at": None, "_kind": "revision"})
                if error is not None:
                    done.append(r | {"fetched_at": at, "revision": None, "_kind": error})
            yield pa.RecordBatch.from_pylist(done, schema)
        if not first:
            yield pa.RecordBatch.from_pylist([x | {"fetched_at": None, "_kind": "current"} for x in store.items], schema)

    made = scratch.save(keyed.mapInArrow(run, out))
    of = lambda k: made.where(F.col("_kind") == k)
    now = marked.where("not _hit").select(*current.columns).unionByName(of("current").select(*current.columns))
    bad = made.where(~F.col("_kind").isin("current", "revision")).select(*values, "fetched_at", F.col("_kind").alias("error"))
    return {"current": now, "revisions": of("revision").select(*values, "revision"), "conflicts": bad}


def backfill(events: DataFrame, canonical: DataFrame, localizations: DataFrame, after: str | None = None, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Processed events without a canonical row, by URL or by source and external id, in the order of id from ``after`` on; and
    the first localization of each for every locale."""
    e = events.where("status = 'PROCESSED'")
    e = e.where(F.col("id") > after) if after is not None else e
    e = e.join(canonical.select("url"), "url", "left_anti").join(canonical.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    e = e.orderBy("id").limit(limit)
    first = F.row_number().over(Window.partitionBy("event_id", "locale").orderBy("generated_at", "localization_id"))
    loc = localizations.join(e.select(F.col("id").alias("event_id")), "event_id", "left_semi").withColumn("_f", first).where("_f = 1").drop("_f")
    return e, loc


def backfill_report(events: DataFrame, canonical: DataFrame, localizations: DataFrame, size: int) -> DataFrame:
    """What a backfill in batches of ``size`` processed events would do, without doing it: (batch, scanned, created, reused,
    localizations, next_cursor), localizations being those of ``localizations(event_id, locale)`` of created rows. Batches are
    cut from the ids in their order; next_cursor is the last id of a batch, after which the next one begins."""
    e = events.where("status = 'PROCESSED'")
    known = lambda *on: canonical.select(*on).distinct().withColumn("_k", F.lit(True))
    e = e.join(known("url").withColumnRenamed("_k", "_u"), "url", "left").join(known("source_id", "external_id"), ["source_id", "external_id"], "left")
    many = localizations.groupBy("event_id").agg(F.count("*").alias("_n"))
    e = e.select("id", F.coalesce("_u", "_k", F.lit(False)).alias("_old")).join(many, F.col("id") == F.col("event_id"), "left")
    # places over the sorted partitions: the counts of those before, and the place in one's own
    e = written(e.select("id", "_old", F.coalesce("_n", F.lit(0)).alias("_n")).orderBy("id").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = e.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    e = e.join(first, "_part").withColumn("batch", F.floor(place / size))
    return e.groupBy("batch").agg(F.count("*").alias("scanned"), F.count_if(~F.col("_old")).alias("created"), F.count_if("_old").alias("reused"), F.coalesce(F.sum(F.when(~F.col("_old"), F.col("_n"))), F.lit(0)).cast("long").alias("localizations"), F.max("id").alias("next_cursor"))


def persist_events(batch: DataFrame) -> DataFrame:
    """The older store: the events of ``batch(source_id, url, title, content, published_at, fetched_at)``, one a source and
    external id (SHA-256 of the URL), as they stand after all versions in the order of fetching. A version whose content
    hash is another adds the one before to ``revisions``, oldest first."""
    v = batch.withColumns({"external_id": F.sha2("url", 256), "content_hash": F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))), 256)})
    w = Window.partitionBy("source_id", "external_id").orderBy("fetched_at", "content_hash")
    v = v.withColumn("_next", F.lead("content_hash").over(w)).withColumn("_at", F.lead("fetched_at").over(w))
    last = F.struct("fetched_at", "content_hash", "title", "content", "published_at", "url")
    old = F.when(F.col("_next") != F.col("content_hash"), F.struct(F.col("_at").alias("corrected_at"), "url", "content_hash"))
    e = v.groupBy("source_id", "external_id").agg(F.max(last).alias("l"), F.sort_array(F.collect_list(old)).alias("revisions"))
    return e.select("source_id", "external_id", "l.url", "l.title", "l.content", "l.content_hash", "l.published_at", F.lit("PROCESSED").alias("status"), F.lit(None).cast("string").alias("reason"), "revisions")


def reject_events(events: DataFrame, rejects: DataFrame, as_of: str) -> DataFrame:
    """``events`` where those of ``rejects(source_id, url, errors)`` that aren't rejected yet are: with the reason, and a
    revision of what stood."""
    r = rejects.groupBy("source_id", "url").agg(F.min(F.array_join("errors", ",")).alias("_why"))
    j = events.join(r, ["source_id", "url"], "left")
    hit = F.col("_why").isNotNull() & (F.col("status") != "REJECTED")
    was = F.array(F.struct(F.lit(as_of).cast("timestamp").alias("corrected_at"), F.col("url"), F.col("content_hash")))
    new = {"status": F.when(hit, "REJECTED").otherwise(F.col("status")), "reason": F.when(hit, F.col("_why")).otherwise(F.col("reason")), "revisions": F.when(hit, F.concat("revisions", was)).otherwise(F.col("revisions"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def set_status(contents: DataFrame, ids: DataFrame, status: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Contents with the status of the listed ids changed, and an audit row for each change."""
    hit = contents.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    out = hit.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")
    audit = hit.where("_hit").select("id", F.col("status").alias("old_status"), F.lit(status).alias("new_status"), F.lit(reason).alias("reason"))
    return out, audit


def affected_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """(user_id, topic, change): added, removed or with other refinements."""
    j = old.select("user_id", "topic", F.sort_array("refinements").alias("a"), F.lit(True).alias("_o")).join(new.select("user_id", "topic", F.sort_array("refinements").alias("b"), F.lit(True).alias("_n")), ["user_id", "topic"], "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("user_id", "topic", change.alias("change")).where("change is not null")


def replace_selection(old: DataFrame, new: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next selections (missing ones archived, given ones active) and rejects: repeated or unavailable topics."""
    w = Window.partitionBy("user_id", "topic")
    n = new.withColumn("_n", F.count("*").over(w)).join(available.select("topic", F.lit(True).alias("_ok")), "topic", "left")
    error = F.when(F.col("_n") > 1, "TOPIC_DUPLICATED").when(F.col("_ok").isNull(), "TOPIC_UNAVAILABLE")
    n = n.withColumn("error", error)
    bad_users = n.where("error is not null").select("user_id").distinct()
    good = n.join(bad_users, "user_id", "left_anti").select("user_id", "topic", "refinements")
    touched = good.select("user_id").distinct().withColumn("_t", F.lit(True))
    j = old.select("user_id", "topic", "refinements").withColumnRenamed("refinements", "_r").join(good.withColumn("_g", F.lit(True)), ["user_id", "topic"], "full_outer").join(touched, "user_id", "left")
    status = F.when(F.col("_g") | F.col("_t").isNull(), "ACTIVE").otherwise("ARCHIVED")
    return j.select("user_id", "topic", F.coalesce("refinements", "_r").alias("refinements"), status.alias("status")), n.where("error is not null").select("user_id", "topic", "error")


def purge_users(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of the given users, and how many went from each."""
    ids = users.select("user_id").distinct()
    kept = {n: df.join(ids, "user_id", "left_anti") for n, df in tables.items()}
    gone = [df.join(ids, "user_id", "left_semi").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in tables.items()]
    return kept, reduce(DataFrame.unionByName, gone)


#: Keys whose values aren't shown (fixed value).
SENSITIVE = "(?i)password|secret|token|authorization|cookie|api_?key|credential"


def redact(metadata: Column) -> Column:
    """Values of sensitive keys are masked, null values shown as [NULL]."""
    secret = lambda k: F.rlike(k, F.lit(SENSITIVE))
    return F.transform_values(metadata, lambda k, v: F.when(secret(k), "[REDACTED]").otherwise(F.coalesce(v, F.lit("[NULL]"))))


def masked(text: Column) -> Column:
    """JSON text with the values of sensitive keys masked and nulls shown as [NULL], in objects and arrays at any depth. Null stays
    null; what isn't JSON gives null."""
    secret = re.compile(SENSITIVE[4:], re.I)

    def walk(x):
        if x is None:
            return "[NULL]"
        if isinstance(x, dict):
            return {k: "[REDACTED]" if secret.search(k) else walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    def one(s):
        try:
            return None if s is None else json.dumps(walk(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def mask(s: pd.Series) -> pd.Series:
        return s.map(one)

    return mask(text)


def normal_term(term: Column) -> Column:
    """NFKC, lower case, runs of white space as one blank, trimmed."""
    from newsloom.functions import text as t

    return t.js_trim(F.regexp_replace(F.lower(t.unicode_form(term, "NFKC")), f"{t.JS_S}+", " "))


#: What an entry of a glossary must give as a text that isn't blank, and the locales that are known (fixed values).
REQUIRED = {"sourceLanguage": "source_language", "targetLocale": "target_locale", "sourceTerm": "source_term", "preferredTerm": "preferred_term", "domain": "domain", "version": "version"}
LOCALES = ["vi", "en", "zh-Hans"]
BAD_JSON, BAD_ENTRY, BAD_LOCALE = "GLOSSARY_JSON_INVALID", "GLOSSARY_ENTRY_INVALID", "GLOSSARY_LOCALE_INVALID"


def glossary_import(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of ``documents(document_id, json)``, each an array of entries as one JSON text, that are valid as a whole; and
    (document_id, position, error) of the first thing that is wrong with each of the others, of which nothing is imported."""
    from newsloom.functions import text as t

    whole = F.try_parse_json("json")
    ok = F.coalesce(F.schema_of_variant(whole).startswith("ARRAY"), F.lit(False))
    d = documents.select("document_id", ok.alias("_ok"), F.posexplode_outer(F.when(ok, F.from_json("json", "array<string>"))).alias("position", "_e"))
    d = d.withColumn("_v", F.try_parse_json("_e"))
    of = lambda key: F.try_variant_get(F.col("_v"), f"$.{key}", "variant")
    is_text = lambda key: F.schema_of_variant(of(key)) == "STRING"
    text = lambda key: F.when(is_text(key), t.js_trim(F.try_variant_get(F.col("_v"), f"$.{key}", "string")))
    d = d.withColumns({c: text(key) for key, c in REQUIRED.items()})
    flag = F.when(F.schema_of_variant(of("protected")) == "BOOLEAN", F.try_variant_get(F.col("_v"), "$.protected", "boolean"))
    d = d.withColumns({"protected": flag, "short_term": F.nullif(text("shortTerm"), F.lit(""))})
    blank = F.lit(False)
    for c in REQUIRED.values():
        blank = blank | (F.coalesce(c, F.lit("")) == "")
    empty = F.col("_ok") & F.col("position").isNull()
    error = F.when(~F.col("_ok"), BAD_JSON).when(empty, None).when(blank, BAD_ENTRY).when(~F.col("source_language").isin(LOCALES) | ~F.col("target_locale").isin(LOCALES), BAD_LOCALE).when(F.col("protected").isNull(), BAD_ENTRY)
    d = d.withColumn("error", error)
    bad = d.where("error is not null").groupBy("document_id").agg(F.min(F.struct(F.coalesce("position", F.lit(0)).alias("position"), "error")).alias("e")).select("document_id", "e.position", "e.error")
    good = d.where("position is not null").join(bad.select("document_id"), "document_id", "left_anti")
    return good.select("document_id", *REQUIRED.values(), "short_term", "protected"), bad


def glossary_export(entries: DataFrame) -> DataFrame:
    """Entries as JSON texts, sorted by languages, domain, term and version."""
    fields = [F.col(c).alias(key) for key, c in REQUIRED.items() if key not in ("domain", "version")]
    row = F.struct(*fields, F.col("short_term").alias("shortTerm"), "protected", "domain", "version")
    return entries.withColumn("_t", normal_term(F.col("source_term"))).orderBy("source_language", "target_locale", "domain", "_t", "version").select(F.to_json(row).alias("json"))


def glossary_winners(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One entry a term: protected first, then preferred term, then short term; and the number of conflicts."""
    key = ["source_language", "target_locale", "term", "domain", "version"]
    e = entries.withColumn("term", normal_term(F.col("source_term")))
    order = Window.partitionBy(*key).orderBy(F.col("protected").desc(), F.collate("preferred_term", "vi"), F.col("short_term").asc_nulls_first(), "source_term")
    e = e.withColumn("_r", F.row_number().over(order))
    return e.where("_r = 1").drop("_r"), e.groupBy(*key).agg((F.count("*") - 1).alias("conflicts")).where("conflicts > 0")


def glossary_resolve(entries: DataFrame, domains: list[str]) -> DataFrame:
    """The entry of each term by the caller's domain order, the default domain last."""
    place = F.array_position(F.array(*[F.lit(d) for d in [*domains, "default"]]), F.col("domain"))
    e = entries.withColumn("_d", place).where("_d > 0")
    order = Window.partitionBy("source_language", "target_locale", "source_term").orderBy("_d", F.col("protected").desc(), "preferred_term")
    return e.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_d")
