"""Localization requests: matched glossary entries and what a translation must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions.automaton import containing

#: Domains that every text has besides its topics (fixed values).
DOMAINS = ["general-news", "organization-product"]


def glossary_matches(contents: DataFrame, entries: DataFrame, locale: str, version: str) -> DataFrame:
    """(content_id, domain, source_term, preferred_term, protected): entries of ``entries(source_language, target_locale, version,
    domain, source_term, preferred_term, protected)`` for the content's language and a target locale and version, of one of its
    topics or of DOMAINS, whose term occurs in title or content, in any case. Each text is read once for all terms; what is found
    meets the entries of its language and domains by keys, without the text."""
    e = entries.where((F.col("target_locale") == locale) & (F.col("version") == version)).select("source_language", "domain", "source_term", "preferred_term", "protected", F.lower("source_term").alias("token"))
    c = contents.select("content_id", F.lower(F.concat_ws("\n", "title", F.coalesce("content", F.lit("")))).alias("text"))
    found = containing(e.select("token"), c, "content_id")
    places = contents.select("content_id", F.col("language").alias("source_language"), F.explode(F.array_distinct(F.concat("topics", F.array(*[F.lit(d) for d in DOMAINS])))).alias("domain"))
    out = found.join(places, "content_id").join(e, ["source_language", "domain", "token"])
    return out.select("content_id", "domain", "source_term", "preferred_term", "protected")


def requests(contents: DataFrame, entries: DataFrame, locale: str, version: str, policy: str) -> DataFrame:
    """One request a content of ``contents(content_id, title, content, language, topics)``, as a struct of what is exported as JSON:
    claims with their evidence, values to keep (facts, directions, certainty, attribution), terms to keep (entities, protected
    terms) and the matched glossary by domain and term."""
    c = contents.withColumn("_both", F.concat_ws("\n", "title", F.coalesce("content", F.lit(""))))
    claims = t.claim_rows(c, "content_id", "_both")
    kept = F.array_compact(F.concat(F.transform("facts", lambda f: f.raw), "directions", F.array("certainty"), F.array("attribution")))
    claim = F.struct("position", F.struct("text", F.array("text").alias("evidence")).alias("claim"), kept.alias("kept"), F.col("entities"))
    per = claims.groupBy("content_id").agg(F.sort_array(F.collect_list(claim)).alias("cs"))
    g = glossary_matches(contents, entries, locale, version).withColumn("_term", F.lower("source_term"))
    g = g.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("domain", "_term", "source_term", "preferred_term", "protected"))).alias("gs"))
    none = F.array().cast("array<struct<domain:string,_term:string,source_term:string,preferred_term:string,protected:boolean>>")
    j = c.join(per, "content_id", "left").join(g, "content_id", "left").withColumn("gs", F.coalesce("gs", none))
    distinct = lambda xs: F.array_distinct(F.coalesce(xs, F.array().cast("array<string>")))
    request = F.struct(
        F.col("title").alias("sourceTitle"), F.coalesce("content", F.lit("")).alias("sourceContent"), F.transform("cs", lambda x: x.claim).alias("sourceClaims"), distinct(F.flatten(F.transform("cs", lambda x: x.kept))).alias("preservedValues"),
        distinct(F.concat(F.coalesce(F.flatten(F.transform("cs", lambda x: x.entities)), F.array().cast("array<string>")), F.transform(F.filter("gs", lambda x: x.protected), lambda x: x.source_term))).alias("preservedTerms"),
        F.transform("gs", lambda x: F.struct(x.source_term.alias("sourceTerm"), x.preferred_term.alias("preferredTerm"), x.protected.alias("protected"))).alias("glossary"),
        F.col("language").alias("sourceLanguage"), F.lit(locale).alias("targetLocale"), F.lit(policy).alias("policyVersion"), F.lit(version).alias("glossaryVersion"),
    )
    return j.select("content_id", request.alias("request"))
