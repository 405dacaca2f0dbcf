"""Gates for localised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as t

#: English words by which untranslated text shows (fixed values).
MARKERS = ["the", "and", "as", "while", "with", "from", "this", "that", "was", "were", "has", "have", "after", "before", "fell", "falls", "rose", "rises", "remained", "stable"]
#: Words by which the older gate knows untranslated text, its numbers with units, and the names that it protects (fixed values).
MARKERS_V2 = [*MARKERS, "delay"]
NUMBERS_V2 = rf"(?iu)\d+(?:[.,]\d+)*(?:%|{t.JS_S}?(?:USD|VND|BTC|ETH))?"
PROTECTED_V2 = rf"{t.JS_B}(?:[A-Z]{{2,8}}|Bitcoin|Ethereum|OpenAI|Apple|Google|Microsoft|XRP){t.JS_B}"
HIGH_STAKES = r"(?iu)^(health|medicine|finance|economy|legal)$"
UP, DOWN = ["tăng", "rise", "rises", "rose", "increase", "increased"], ["giảm", "fall", "falls", "fell", "decrease", "decreased"]
CERTAIN = {"POSSIBLE": "may|might|could|dự kiến|có thể", "LIKELY": "likely|nhiều khả năng", "UNLIKELY": "unlikely|khó có khả năng", "CONFIRMED": "confirmed|xác nhận"}


def folded(text: Column) -> Column:
    return t.js_trim(F.regexp_replace(F.lower(t.unicode_form(text, "NFKC")), f"{t.JS_S}+", " "))


def direction_concepts(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(t.directions(text), lambda d: F.when(d.isin(UP), "UP").when(d.isin(DOWN), "DOWN").otherwise("UNCHANGED"))))


def certainty_concepts(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(rf"(?iu)(?<!\p{{L}})(?:{w})(?!\p{{L}})")), k) for k, w in CERTAIN.items()]))


def english_leak(text: Column, markers: list[str] = MARKERS) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ỹ]+"), F.lit(0))
    hits = F.size(F.filter(words, lambda w: F.lower(w).isin(markers)))
    return F.when(F.size(words) < 8, 0.0).otherwise(hits / F.greatest(F.lit(1.0), F.size(words) / 8))


def gate_v3(pairs: DataFrame) -> DataFrame:
    """``pairs(id, source_title, source_content, title, summary, claims array<struct<text,evidence>>, source_language,
    target_locale, glossary array<struct<source_term,preferred_term,protected>>)`` with failure codes, score and passed.
    Facts, entities, directions and the like are taken once from either side."""
    claims = F.coalesce(F.col("claims"), F.array().cast("array<struct<text:string,evidence:array<string>>>"))
    p = pairs.withColumns({
        "_c": claims, "_s": F.concat(F.coalesce("source_title", F.lit("")), F.lit("\n"), F.coalesce("source_content", F.lit(""))),
        "_l": F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n"), F.array_join(F.transform(claims, lambda c: c.text), "\n")),
    })
    p = p.withColumns({"_fs": t.facts(F.col("_s")), "_fl": t.facts(F.col("_l")), "_es": t.entities(F.col("_s")), "_ns": folded(F.col("_s")), "_nl": folded(F.col("_l")), "_nt": folded(F.col("source_title")), "_nc": folded(F.col("source_content"))})
    kinds = lambda c, ks: F.sort_array(F.array_distinct(F.transform(F.filter(c, lambda f: f.kind.isin(ks)), lambda f: F.concat(f.kind, F.lit(":"), f.normalized))))
    differ = lambda *ks: kinds(F.col("_fs"), list(ks)) != kinds(F.col("_fl"), list(ks))
    has = lambda x: F.contains(F.col("_nl"), x)
    low = lambda x: F.lower(F.regexp_replace(x, f"{t.JS_S}+", " "))
    said = F.regexp_extract_all(F.col("_s"), F.lit(r"(?iu)(?:according to|theo)\s+([^,.;:\n]{2,120})"), F.lit(1))
    blank = lambda c: t.js_trim(F.coalesce(F.col(c), F.lit(""))) == ""
    leak = ((F.col("source_language") != F.col("target_locale")) & has(F.col("_nt")) & has(F.col("_nc"))) | ((F.col("target_locale") == "vi") & (english_leak(F.col("_l")) > 0.82))
    terms = F.coalesce("glossary", F.array().cast("array<struct<source_term:string,preferred_term:string,protected:boolean>>"))
    bad_term = F.exists(terms, lambda g: F.contains(F.col("_ns"), low(g.source_term)) & ~has(low(F.when(g.protected, g.source_term).otherwise(g.preferred_term))))
    codes = {
        "EMPTY_OUTPUT": blank("title") | blank("summary") | (F.size("_c") == 0), "NUMBER_CHANGED": differ("NUMBER", "PRODUCT_VERSION", "PERCENTAGE"), "CURRENCY_CHANGED": differ("CURRENCY"),
        "DATE_CHANGED": differ("DATE_TIME"), "ENTITY_CORRUPTED": F.exists("_es", lambda e: ~has(low(e))), "DIRECTION_REVERSED": direction_concepts(F.col("_s")) != direction_concepts(F.col("_l")),
        "CERTAINTY_CHANGED": certainty_concepts(F.col("_s")) != certainty_concepts(F.col("_l")), "ATTRIBUTION_DROPPED": F.exists(said, lambda a: ~has(low(t.js_trim(a)))),
        "MISSING_EVIDENCE": F.exists("_c", lambda c: F.coalesce(F.size(c.evidence), F.lit(0)) < 1), "EVIDENCE_NOT_IN_SOURCE": F.exists(F.flatten(F.transform("_c", lambda c: F.coalesce(c.evidence, F.array().cast("array<string>")))), lambda e: ~F.contains(F.col("_s"), e)),
        "LOCALE_FALLBACK_LEAK": leak, "GLOSSARY_VIOLATION": bad_term,
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), k) for k, x in codes.items()]))
    p = p.withColumn("failure_codes", failed)
    p = p.withColumns({"score": F.greatest(F.lit(0.0), 1 - F.size("failure_codes") * 0.25), "passed": F.size("failure_codes") == 0})
    return p.select(*pairs.columns, "failure_codes", "score", "passed")


def gate_v2(pairs: DataFrame) -> DataFrame:
    """``pairs(source_title, source_content, title, summary, source_language, target_locale)`` with failure_codes, score, passed and
    evidence: numbers, with their units, and protected names of the source stay; nothing is blank; the text isn't the source's own, and into
    Vietnamese not English. The last two share a code, which can stand twice and then counts twice. Nulls are empty texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    p = pairs.withColumns({"_s": F.concat(text("source_title"), F.lit(" "), text("source_content")), "_l": F.concat(text("title"), F.lit(" "), text("summary"))})
    found = lambda c, pattern: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0)))
    blank = lambda c: t.js_trim(text(c)) == ""
    own = (F.col("source_language") != F.col("target_locale")) & (t.js_trim(F.col("_s")) == t.js_trim(F.col("_l")))
    codes = F.array_compact(F.array(
        F.when(F.size(F.array_except(found("_s", NUMBERS_V2), found("_l", NUMBERS_V2))) > 0, "NUMBER_CHANGED"), F.when(F.exists(found("_s", PROTECTED_V2), lambda x: ~F.contains(F.col("_l"), x)), "ENTITY_CORRUPTED"),
        F.when(blank("title") | blank("summary"), "EMPTY_OUTPUT"), F.when(own, "LOCALE_FALLBACK_LEAK"),
        F.when((F.col("target_locale") == "vi") & (english_leak(F.col("_l"), MARKERS_V2) > 0.82), "LOCALE_FALLBACK_LEAK")))
    p = p.withColumn("failure_codes", codes).withColumn("score", F.greatest(F.lit(0.0), 1 - F.size("failure_codes") * 0.25))
    evidence = F.array(*[F.struct(F.lit(k).alias("claim"), F.col(c).alias("source_text")) for k, c in (("title", "source_title"), ("summary", "source_content"))])
    return p.withColumn("passed", (F.size("failure_codes") == 0) & (F.col("score") >= 0.9)).withColumn("evidence", evidence).drop("_s", "_l")


#: The code of a translation that the semantic verifier doesn't pass, fails on, or isn't asked about.
UNVERIFIED = "SEMANTIC_VERIFIER_FAILED"


def high_stakes(topics: Column, metadata: Column | None = None) -> Column:
    """Whether a topic is one of high stakes, in any case, or the JSON metadata says so by a true ``highImportance``."""
    by_topic = F.coalesce(F.exists(topics, lambda x: F.rlike(x, F.lit(HIGH_STAKES))), F.lit(False))
    if metadata is None:
        return by_topic
    value = F.try_variant_get(F.try_parse_json(metadata), "$.highImportance", "variant")
    return by_topic | F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & (F.to_json(value) == "true"), F.lit(False))


def publication(attempts: DataFrame, verdicts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Decision on each of ``attempts(id, title, summary, topics, passed, score, failure_codes, metadata if there)``: without title or summary it is
    EMPTY_OUTPUT; what the deterministic gate doesn't pass is rejected with its codes; the rest is published if ``verdicts(id, semantic_passed,
    semantic_score)`` passes it with .9 or more, else rejected (UNVERIFIED). With quality_score, high_stakes, and what the revision of
    the attempt holds: its number after those of ``previous(id, attempt_number)``, and the reason."""
    j = attempts.join(verdicts.select("id", "semantic_passed", "semantic_score", F.lit(True).alias("_asked")), "id", "left")
    empty = (F.coalesce("title", F.lit("")) == "") | (F.coalesce("summary", F.lit("")) == "")
    publish = ~empty & F.col("passed") & F.coalesce(F.col("semantic_passed") & (F.col("semantic_score") >= 0.9), F.lit(False))
    codes = F.when(empty, F.array(F.lit("EMPTY_OUTPUT"))).when(~F.col("passed"), F.col("failure_codes")).when(publish, F.array().cast("array<string>")).otherwise(F.array(F.lit(UNVERIFIED)))
    score = F.when(empty, 0.0).when(~F.col("passed"), F.col("score")).otherwise(F.coalesce("semantic_score", F.lit(0.0)))
    stakes = high_stakes(F.col("topics"), F.col("metadata") if "metadata" in attempts.columns else None)
    j = j.withColumns({"status": F.when(publish, "VERIFIED").otherwise("REJECTED"), "quality_score": score, "failure_codes": codes, "high_stakes": ~empty & stakes})
    last = F.lit(0) if previous is None else F.coalesce("_last", F.lit(0))
    j = j if previous is None else j.join(previous.groupBy("id").agg(F.max("attempt_number").alias("_last")), "id", "left")
    j = j.withColumns({"attempt_number": (last + 1).cast("int"), "correction_reason": F.when(F.col("status") == "REJECTED", F.left(F.array_join("failure_codes", ","), F.lit(120)))})
    return j.drop("_asked", "_last", "semantic_passed", "semantic_score", "score", "passed")


#: What tells translations of a content apart.
IDENTITY = ["id", "locale", "content_hash", "policy_version", "glossary_version"]


def work_list(contents: DataFrame, targets: DataFrame, done: DataFrame) -> DataFrame:
    """Eligible contents without a finished localization of their identity: verified, no duplicate; ``targets(locale, policy_version,
    glossary_version)`` are a few. One of ``done`` with title and summary counts for its own IDENTITY alone: another text, policy or glossary
    is wanted anew."""
    e = contents.where((F.col("provenance_status") == "VERIFIED") & F.col("duplicate_of_id").isNull())
    each = targets.select("locale", "policy_version", "glossary_version").distinct()
    wanted = e.select("id", "content_hash").join(F.broadcast(each) if each.count() <= 1000 else each, F.lit(True))
    ready = done.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("summary", F.lit("")) != "")).select(*IDENTITY)
    return wanted.join(ready, IDENTITY, "left_anti")


#: A contract output: its type, and its exact keys.
CONTRACT = "struct<title:string,summary:string,claims:array<struct<text:string,evidence:array<string>>>,preservedValues:array<string>,preservedTerms:array<string>,sourceLanguage:string,targetLocale:string>"
CONTRACT_KEYS = ["claims", "preservedTerms", "preservedValues", "sourceLanguage", "summary", "targetLocale", "title"]
LOCALES = ["vi", "en", "zh-Hans"]
OVERREACH = r"(?iu)(?<![\p{L}\p{N}_])(mua|bán|đầu tư ngay|buy|sell|diagnose|take medication)(?![\p{L}\p{N}_])"


def _blank(c: Column) -> Column:
    return F.coalesce(t.js_trim(c) == "", F.lit(True))


def contract_error(output: Column, source: Column, values: Column, terms: Column, language: Column, locale: Column) -> Column:
    """Code of the first check that a JSON output fails, or null."""
    x = F.from_json(output, CONTRACT)
    keys = lambda c: F.sort_array(F.json_object_keys(c))
    wrong = lambda c, k: F.coalesce(keys(c) != F.array(*[F.lit(v) for v in k]), F.lit(True))
    raw = F.from_json(F.get_json_object(output, "$.claims"), "array<string>")
    empty = lambda a: a.isNull() | F.exists(a, _blank)
    schema = (
        x.isNull() | wrong(output, CONTRACT_KEYS) | _blank(x.title) | _blank(x.summary) | x.claims.isNull() | (F.size(x.claims) == 0) | F.exists(x.claims, lambda c: _blank(c.text) | c.evidence.isNull() | F.exists(c.evidence, _blank))
        | F.exists(F.coalesce(raw, F.array().cast("array<string>")), lambda c: wrong(c, ["evidence", "text"])) | empty(x.preservedValues) | empty(x.preservedTerms)
        | ~F.coalesce(x.sourceLanguage.isin(LOCALES) & x.targetLocale.isin(LOCALES), F.lit(False))
    )
    same = lambda a, b: F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))
    return (
        F.when(F.coalesce(schema, F.lit(True)), "LOCALIZATION_SCHEMA_INVALID").when((x.sourceLanguage != language) | (x.targetLocale != locale), "LOCALIZATION_LOCALE_MISMATCH")
        .when(F.exists(x.claims, lambda c: F.size(c.evidence) == 0), "LOCALIZATION_EVIDENCE_REQUIRED").when(F.exists(F.flatten(x.claims.evidence), lambda e: ~F.contains(source, e)), "LOCALIZATION_EVIDENCE_NOT_IN_SOURCE")
        .when(~same(x.preservedValues, values), "LOCALIZATION_VALUES_NOT_PRESERVED").when(~same(x.preservedTerms, terms), "LOCALIZATION_TERMS_NOT_PRESERVED")
    )


def offline_pairs(pairs: DataFrame) -> DataFrame:
    """Offline check of ``pairs(source struct, localization struct, generation struct, preserved_values, preserved_terms,
    attribution_required)``: all error codes, warnings, score and validity."""
    s, l, g = F.col("source"), F.col("localization"), F.col("generation")
    corpus = F.concat_ws("\n", s.title, s.content)
    out = F.concat_ws("\n", l.title, l.summary, l.relevanceReason, l.suggestedAction)
    low = lambda c: t.js_trim(F.regexp_replace(F.lower(c), f"{t.JS_S}+", " "))
    need = lambda st, prefix, names: [F.when(_blank(st[n]), f"{prefix}_{n.upper()}_REQUIRED") for n in names]
    host = F.try_parse_url(s.canonicalUrl, F.lit("HOST"))
    fixed = F.array_compact(F.array(
        *need(s, "SOURCE", ["language", "publisher", "canonicalUrl", "publishedAt", "contentHash", "title", "content"]),
        F.when(host.isNull(), "SOURCE_URL_INVALID"), F.when(host.isNotNull() & ~F.startswith(F.lower(s.canonicalUrl), F.lit("https:")), "SOURCE_URL_NOT_HTTPS"), F.when(host.isin("example.com", "localhost", "127.0.0.1"), "SOURCE_URL_PLACEHOLDER"),
        F.when(F.try_to_timestamp(s.publishedAt).isNull(), "SOURCE_PUBLISHED_AT_INVALID"), F.when(~F.coalesce(l.locale.isin("vi", "en"), F.lit(False)), "LOCALIZATION_LOCALE_UNSUPPORTED"),
        *need(l, "LOCALIZATION", ["title", "summary", "relevanceReason", "suggestedAction"]), *need(g, "GENERATION", ["provider", "model", "promptVersion", "generatedAt"]),
        F.when(F.coalesce(F.size(l.claims), F.lit(0)) < 1, "CLAIMS_REQUIRED"), F.when(F.col("attribution_required") & ~F.contains(low(out), low(s.publisher)), "REQUIRED_ATTRIBUTION_MISSING"),
        F.when(F.rlike(l.suggestedAction, F.lit(OVERREACH)), "ACTION_OVERREACH")))
    name = lambda i, rest: F.concat(F.lit("CLAIM_"), i.cast("string"), F.lit(rest))
    claims = F.coalesce(l.claims, F.array().cast("array<struct<text:string,evidence:array<string>>>"))
    spans = lambda c, i: F.transform(F.coalesce(c.evidence, F.array().cast("array<string>")), lambda e, k: F.when(_blank(e) | ~F.contains(corpus, e), F.concat(name(i, "_EVIDENCE_"), k.cast("string"), F.lit("_NOT_IN_SOURCE"))))
    each = F.flatten(F.transform(claims, lambda c, i: F.concat(F.array(F.when(_blank(c.text), name(i, "_TEXT_REQUIRED")), F.when(F.coalesce(F.size(c.evidence), F.lit(0)) < 1, name(i, "_EVIDENCE_REQUIRED"))), spans(c, i))))
    missing = lambda text, v, code: F.when(~F.coalesce(F.contains(low(text), low(v)), F.lit(False)), F.concat(F.lit(f"{code}:"), F.coalesce(v, F.lit(""))))
    values = F.flatten(F.transform(F.coalesce("preserved_values", F.array().cast("array<string>")), lambda v: F.array(missing(corpus, v, "PRESERVED_VALUE_NOT_IN_SOURCE"), missing(out, v, "PRESERVED_VALUE_NOT_IN_OUTPUT"))))
    terms = F.flatten(F.transform(F.coalesce("preserved_terms", F.array().cast("array<struct<source:string,target:string>>")), lambda v: F.array(missing(corpus, v.source, "PRESERVED_TERM_NOT_IN_SOURCE"), missing(out, v.target, "PRESERVED_TERM_NOT_IN_OUTPUT"))))
    warn = F.array_compact(F.array(F.when(F.length(l.summary).between(1, 39), "SUMMARY_TOO_SHORT_FOR_REVIEW"), F.when(F.length(l.summary) > 1200, "SUMMARY_TOO_LONG")))
    p = pairs.withColumns({"errors": F.concat(fixed, F.array_compact(F.concat(each, values, terms))), "warnings": warn})
    p = p.withColumn("quality_score", F.greatest(F.lit(0.0), F.round(1 - F.size("errors") * 0.2 - F.size("warnings") * 0.05, 2)))
    return p.withColumn("valid", (F.size("errors") == 0) & (F.col("quality_score") >= 0.9))
