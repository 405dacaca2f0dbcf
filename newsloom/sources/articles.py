"""Articles, pages and feeds: landing, extraction, parsing, validation, provenance."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions import text as t

#: Limits of landing, retention and extraction.
LARGE, CUT = 2 * 1024 * 1024, 128 * 1024
HEADERS = ["content-type", "etag", "last-modified", "cache-control", "content-length"]
MAX_ARTICLE, MAX_DETAIL = 20_000, 1024 * 1024
BOILERPLATE = r"(?iu)^(advertisement|đăng ký|subscribe|read more|xem thêm)"
PLACEHOLDERS = ["example.com", "localhost", "127.0.0.1"]
LEAST_CONTENT, LEAST_WORDS = 80, 15


def land_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: SHA-256 of all bytes, size, and the body, cut to 128 KiB above 2 MiB."""
    f = spark.read.format("binaryFile").load(path)
    n = F.octet_length("content")
    body = F.when(n > LARGE, F.substring("content", 1, CUT)).otherwise(F.col("content"))
    return f.select("path", F.col("modificationTime").alias("fetched_at"), F.sha2("content", 256).alias("payload_hash"), n.cast("long").alias("received_bytes"), body.alias("body"), (n > LARGE).alias("truncated"))


def allowed_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(HEADERS))


def retain(payloads: DataFrame, as_of: str) -> DataFrame:
    """Body and expiry by license policy: full text stays, excerpts to 128 KiB for 30 days, else no body for 7."""
    now, p = F.lit(as_of).cast("timestamp"), F.col("policy")
    body = F.when(p == "FULL_TEXT", F.col("body")).when(p == "EXCERPT_ONLY", F.substring("body", 1, CUT))
    expires = F.when(p == "FULL_TEXT", None).when(p == "EXCERPT_ONLY", now + F.expr("interval 30 days")).otherwise(now + F.expr("interval 7 days"))
    known = F.when(p.isin("FULL_TEXT", "EXCERPT_ONLY"), p).otherwise("METADATA_ONLY")
    return payloads.withColumns({"policy": known, "body": body, "expires_at": expires})


def purge_expired(payloads: DataFrame, as_of: str) -> DataFrame:
    late = F.col("expires_at") <= F.lit(as_of).cast("timestamp")
    return payloads.withColumn("body", F.when(F.coalesce(late, F.lit(False)), None).otherwise(F.col("body")))


def replay_selection(payloads: DataFrame, as_of: str, source: str | None = None, since: str | None = None, limit: int = 500) -> DataFrame:
    """Unexpired payloads with a body, in the order of fetching."""
    p = payloads.where(F.col("body").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp"))))
    p = p.where(F.col("source_id") == source) if source else p
    p = p.where(F.col("fetched_at") >= F.lit(since).cast("timestamp")) if since else p
    return p.orderBy("fetched_at", "payload_id").limit(limit)


def _attribute(html: Column, tag: str, name: str) -> Column:
    return F.trim(F.regexp_extract(F.regexp_extract(html, tag, 0), rf"(?i){name}=[\"']([^\"']+)[\"']", 1))


@F.pandas_udf(StringType())
def _json_ld_body(html: pd.Series) -> pd.Series:
    import re

    def body(v):
        if isinstance(v, dict):
            if isinstance(v.get("articleBody"), str):
                return v["articleBody"]
            v = v.values()
        elif not isinstance(v, list):
            return None
        return next((b for b in map(body, v) if b), None)

    def first(text):
        for m in re.finditer(r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", text or ""):
            try:
                found = body(json.loads(m[1]))
            except ValueError:
                continue
            if found:
                return found
        return None

    return html.map(first)


def extract_articles(pages: DataFrame, html: str = "html", fallback: str = "fallback", json_ld: bool = True) -> DataFrame:
    """Adds content, origin and canonical_link: the JSON-LD article body of 120 characters or more, else the article's
    distinct paragraphs, else the description of 40 or more, else ``fallback``. Only pages with JSON-LD go
    through Python; ``json_ld=False`` leaves that branch out."""
    h = F.coalesce(F.col(html), F.lit(""))
    article = F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    paras = F.filter(F.transform(F.regexp_extract_all(article, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), t.clean_html), lambda p: F.length(p) >= 30)
    key = lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9À-ỹ]+", "")
    p = pages.withColumn("_p", paras).withColumn("_k", F.transform("_p", key))
    distinct = F.filter("_p", lambda x, i: (F.array_position("_k", F.get("_k", i)) == i + 1) & ~F.rlike(x, F.lit(BOILERPLATE)))
    p = p.withColumn("_a", F.array_join(distinct, "\n"))
    meta = t.clean_html(_attribute(h, r"(?i)<meta\b[^>]*(?:name|property)=[\"'](?:description|og:description)[\"'][^>]*>", "content"))
    has_ld = F.contains(h, F.lit("ld+json"))
    ld = F.when(has_ld, t.clean_html(_json_ld_body(F.when(has_ld, h)))) if json_ld else F.lit(None).cast("string")
    p = p.withColumns({"_ld": F.coalesce(ld, F.lit("")), "_m": meta, "canonical_link": _attribute(h, r"(?i)<link\b[^>]*rel=[\"']canonical[\"'][^>]*>", "href")})
    use = lambda a, b, c, d: F.when(F.length("_ld") >= 120, a).when(F.length("_a") >= 120, b).when(F.length("_m") >= 40, c).otherwise(d)
    content = use(F.substring("_ld", 1, MAX_ARTICLE), F.substring("_a", 1, MAX_ARTICLE), F.col("_m"), F.col(fallback) if fallback in pages.columns else F.lit(None).cast("string"))
    origin = use(F.lit("json-ld"), F.lit("article-html"), F.lit("meta-description"), F.lit("rss-description"))
    return p.withColumns({"content": content, "origin": origin}).drop("_p", "_k", "_a", "_ld", "_m")


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def same_domain(a: Column, b: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other; ``www.`` doesn't count."""
    x, y = (F.regexp_replace(F.lower(h), r"^www\.", "") for h in (a, b))
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def candidate_errors(url: Column, publisher: Column, title: Column, content: Column, published: Column, least_path: int = 2) -> Column:
    """Codes of all checks that a feed candidate fails."""
    host, path = url_part(url, "HOST"), F.coalesce(url_part(url, "PATH"), F.lit(""))
    empty = lambda c: c.isNull() | (c == "")
    return F.array_compact(F.array(
        F.when(host.isNull(), "URL_INVALID"), F.when(host.isNotNull() & (F.lower(url_part(url, "PROTOCOL")) != "https"), "URL_NOT_HTTPS"),
        F.when(host.isNotNull() & ((path == "/") | (F.length(path) < least_path)), "NOT_DETAIL_URL"), F.when(empty(publisher) | (publisher == "Unknown"), "PUBLISHER_UNKNOWN"),
        F.when(empty(title) | empty(content), "CONTENT_REQUIRED"), F.when(published.isNull(), "PUBLISHED_AT_INVALID")))


def canonical_url(url: Column) -> Column:
    """The URL's normal form: scheme and host in lower case, no default port, ``/`` for an empty path, blanks encoded; null
    for what is no absolute URL."""
    u = F.trim(url)
    part = lambda k: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(.*)$", k)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("$^"), F.lit(""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(part(2) != "", F.concat(scheme, F.lit("://"), host, F.replace(F.concat(path, part(4)), F.lit(" "), F.lit("%20"))))


def article_errors(url: Column, title: Column, content: Column, status: Column, final_url: Column, extracted: Column) -> Column:
    """The older check of a feed item: codes of its address and text, and only where none fails those of the fetched
    page, whose ``extracted`` text must have 80 characters and 15 words. A missing status is a failed fetch."""
    host, path = url_part(url, "HOST"), F.coalesce(url_part(url, "PATH"), F.lit(""))
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    early = F.array_compact(F.array(
        F.when(F.lower(url_part(url, "PROTOCOL")) != "https", "URL_NOT_HTTPS"), F.when(F.lower(host).isin(PLACEHOLDERS), "PLACEHOLDER_HOST"),
        F.when((path == "/") | (F.length(path) < 5), "NOT_ARTICLE_PATH"), F.when(empty(title) | empty(content), "CONTENT_REQUIRED")))
    ok = status.between(200, 299)
    late = F.array_compact(F.array(
        F.when(~ok, F.concat(F.lit("HTTP_"), status.cast("string"))), F.when(F.lower(url_part(final_url, "HOST")) != F.lower(host), "UNEXPECTED_FINAL_DOMAIN"),
        F.when(ok & (F.length(extracted) < LEAST_CONTENT), "CONTENT_TOO_SHORT"), F.when(ok & (F.regexp_count(extracted, F.lit(r"[\p{L}\p{N}]+")) < LEAST_WORDS), "CONTENT_LOW_INFORMATION")))
    one = lambda code: F.array(F.lit(code))
    return F.when(host.isNull(), one("URL_INVALID")).when(F.size(early) > 0, early).when(status.isNull(), one("FETCH_FAILED")).otherwise(late)


def url_audit(candidates: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """``candidates(url, expected_domain, status, final_url, content_type, published_at)`` with ``errors``, all that apply; the age
    counts where a time is given."""
    url, host, path = F.col("url"), url_part(F.col("url"), "HOST"), F.coalesce(url_part(F.col("url"), "PATH"), F.lit(""))
    final, domain = url_part(F.col("final_url"), "HOST"), F.col("expected_domain")
    kind = F.coalesce("content_type", F.lit(""))
    fetched = F.col("status").isNotNull() & host.isNotNull()
    late = F.col("published_at") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    errors = F.array_compact(F.array(
        F.when(host.isNull(), "URL_INVALID"), F.when(F.lower(url_part(url, "PROTOCOL")) != "https", "URL_NOT_HTTPS"), F.when(F.lower(host).isin([*PLACEHOLDERS, "www.example.com"]), "PLACEHOLDER_HOST"),
        F.when(host.isNotNull() & ((path == "/") | (F.length(path) < 5)), "NOT_ARTICLE_PATH"), F.when(F.col("status").isNull(), "FETCH_FAILED"), F.when(fetched & ~F.col("status").between(200, 299), F.concat(F.lit("HTTP_"), F.col("status").cast("string"))),
        F.when(fetched & (final != domain) & ~F.endswith(final, F.concat(F.lit("."), domain)), "UNEXPECTED_FINAL_DOMAIN"),
        F.when(fetched & ~F.contains(kind, F.lit("text/html")) & ~F.contains(kind, F.lit("application/json")), "UNEXPECTED_CONTENT_TYPE"), F.when(late, "OUTSIDE_FRESHNESS_WINDOW")))
    return candidates.withColumn("errors", errors)


def publication_audit(contents: DataFrame, as_of: str) -> DataFrame:
    """One row: how many of ``contents(id, url, status, provenance_status, published_at, content_hash)`` break each rule of
    the final audit, and how many there are."""
    now = F.lit(as_of).cast("timestamp")
    bad = {
        "placeholder_host": F.lower(url_part(F.col("url"), "HOST")).isin([*PLACEHOLDERS, "www.example.com"]), "no_provenance": F.col("provenance_status").isNull() | (F.col("provenance_status") != "VERIFIED"),
        "not_2xx": ~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "dated_later": F.col("published_at") > now,
    }
    return contents.agg(F.count("*").alias("items"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in bad.items()], (F.count("content_hash") - F.count_distinct("content_hash")).alias("repeated"))


def _searchable(html: Column) -> Column:
    x = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.regexp_replace(F.lower(F.regexp_replace(x, "<[^>]+>", " ")), r"[^\p{L}\p{N}%]+", " ")


def page_matches(html: Column, title: Column, content: Column) -> Column:
    """Two title tokens or more, of which 60 % stand in the page, and, with four content tokens or more, 35 % of the
    first twelve."""
    page = _searchable(html)
    toks = lambda c: F.array_distinct(F.filter(F.split(_searchable(c), " "), lambda x: F.length(x) >= 3))
    s = F.transform(F.array(F.struct(page.alias("p"), toks(title).alias("t"), F.slice(toks(content), 1, 12).alias("c"))), lambda v: F.struct(
        F.size(v.t).alias("nt"), F.size(F.filter(v.t, lambda x: F.contains(v.p, x))).alias("ht"), F.size(v.c).alias("nc"), F.size(F.filter(v.c, lambda x: F.contains(v.p, x))).alias("hc")))
    r = F.get(s, F.lit(0))
    return (r.nt >= 2) & (r.ht / r.nt >= 0.6) & ((r.nc < 4) | (r.hc / r.nc >= 0.35))


def provenance(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """``candidates(id, url, publisher, title, content, published_at, tier, license_policy, language, profile_language,
    expected_host)`` with provenance_errors and provenance_status. Pages ``(id, status, final_url, html)`` are looked at only
    where no hard check has failed; a missing page is a network error."""
    c = candidates.join(pages.select("id", F.col("status").alias("_s"), F.col("final_url").alias("_f"), F.col("html").alias("_h")), "id", "left")
    early = candidate_errors(F.col("url"), F.col("publisher"), F.lit("x"), F.lit("x"), F.col("published_at"), 5)
    more = F.array_compact(F.array(F.when(~F.coalesce(F.col("tier").isin(1, 2, 3), F.lit(False)), "SOURCE_TIER_INVALID"), F.when(~F.coalesce(F.col("license_policy").isin("FULL_TEXT", "EXCERPT_ONLY", "METADATA_ONLY"), F.lit(False)), "LICENSE_POLICY_MISSING")))
    c = c.withColumn("_early", F.concat(early, more))
    ok = F.col("_s").between(200, 299)
    late = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), "DETAIL_NETWORK_ERROR"), F.when(~ok, F.concat(F.lit("HTTP_"), F.col("_s").cast("string"))),
        F.when(~F.coalesce(same_domain(url_part(F.coalesce("_f", "url"), "HOST"), F.col("expected_host")), F.lit(False)) & F.col("_s").isNotNull(), "UNEXPECTED_FINAL_DOMAIN"),
        F.when(ok & (F.length("_h") > MAX_DETAIL), "DETAIL_BODY_TOO_LARGE")))
    c = c.withColumn("_hard", F.when(F.size("_early") > 0, F.col("_early")).otherwise(late))
    both = F.concat("title", F.lit("\n"), "content")
    weak = (t.language_confidence(both, F.col("language")) < 0.7) | (t.language(both) != F.col("profile_language"))
    seen = (F.size("_early") == 0) & ok & (F.length("_h") <= MAX_DETAIL)
    review = F.array_compact(F.array(F.when(weak, "LANGUAGE_CONFIDENCE_LOW"), F.when(seen & ~page_matches(F.col("_h"), F.col("title"), F.col("content")), "DETAIL_CONTENT_MISMATCH")))
    c = c.withColumn("_review", review)
    status = F.when(F.size("_hard") > 0, "REJECTED").when(F.size("_review") > 0, "NEEDS_REVIEW").otherwise("VERIFIED")
    return c.withColumns({"provenance_errors": F.array_distinct(F.concat("_hard", "_review")), "provenance_status": status}).select(*candidates.columns, "provenance_errors", "provenance_status")


_TEXT = "struct<_VALUE:string,_type:string>"
_LINK = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>"
_ENTRY = f"title:string,link:{_LINK},pubDate:string,published:string,updated:string,`content:encoded`:string,description:string,content:string,summary:string,source:string,author:struct<_VALUE:string,name:string>,guid:string,id:string"
RSS = f"channel struct<title:string,item:array<struct<{_ENTRY}>>>"
ATOM = f"title string, entry array<struct<{_ENTRY}>>"


def _when(raw: Column) -> Column:
    """RFC 822 (without its weekday) or ISO time."""
    plain = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    rfc = F.try_to_timestamp(F.regexp_replace(plain, r"\s*(GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(rfc, F.when(F.rlike(plain, F.lit(r"^\d{4}-")), F.try_to_timestamp(plain)))


def entry_link(links: Column) -> Column:
    """First plain text, else the first href that is no enclosure and no audio or video."""
    good = F.filter(links, lambda x: (F.trim(F.coalesce(x["_VALUE"], F.lit(""))) != "") | (
        (F.coalesce(x["_href"], F.lit("")) != "") & (F.lower(F.coalesce(x["_rel"], F.lit(""))) != "enclosure") & ~F.rlike(F.coalesce(x["_type"], F.lit("")), F.lit("(?i)^(audio|video)/"))))
    one = F.get(good, F.lit(0))
    return F.coalesce(F.nullif(F.trim(one["_VALUE"]), F.lit("")), one["_href"])


@F.pandas_udf(StringType())
def _resolve(url: pd.Series, base: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(u, b):
        try:
            return urljoin(b or "", u) if u else None
        except ValueError:
            return None

    return pd.Series([one(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


#: Else a condition on the URL would send every row through Python a second time.
_resolve = _resolve.asNondeterministic()


def _absolute(url: Column) -> Column:
    return F.rlike(url, F.lit("^(?i)https?://"))


def resolve_url(url: Column, base: Column) -> Column:
    """Absolute URLs stay as they are; only relative ones go through Python."""
    return F.when(_absolute(url), url).otherwise(_resolve(F.when(~_absolute(url), url), base))


def parse_feeds(payloads: DataFrame, v1: bool = False) -> DataFrame:
    """One row an RSS item or Atom entry of ``payloads(source_id, final_url, body)``; entries without title, URL or valid date go.
    Malformed XML gives no rows. ``v1`` reads no content:encoded, and takes the publisher from source or author alone. An entry without any
    text has its title as content, and false in ``has_body``."""
    x = payloads.withColumn("xml", F.col("body").cast("string"))
    options = {"mode": "PERMISSIVE", "nullValue": "\u0001"}  # else the text "null" were none; no XML holds this one
    rss = F.from_xml("xml", RSS, {**options, "rowTag": "rss"})
    atom = F.from_xml("xml", ATOM, {**options, "rowTag": "feed"})
    is_atom = F.rlike("xml", F.lit(r"<feed[\s>]"))
    x = x.withColumn("_is", is_atom).withColumns({"_a": F.when(F.col("_is"), atom), "_r": F.when(~F.col("_is"), rss)})
    x = x.select("source_id", "final_url", "_is", F.coalesce("_r.channel.title", "_a.title").alias("feed_title"), F.posexplode(F.coalesce("_r.channel.item", "_a.entry")).alias("i", "e"))
    c = lambda f: t.let(t.clean_html(f), lambda v: F.when(v != "", v))
    e = lambda n: F.col("e")[n]
    author = F.coalesce(c(e("author")["name"]), c(e("author")["_VALUE"]))
    body = [e("description"), e("content"), e("summary")] if v1 else [e("content:encoded"), e("description"), e("content"), e("summary")]
    publisher = F.coalesce(c(e("source")), author, F.lit("Unknown")) if v1 else F.coalesce(c(e("source")), c(F.col("feed_title")), author, F.lit("Unknown"))
    x = x.select(
        "source_id", "final_url", "i", "_is", c(e("title")).alias("title"), entry_link(e("link")).alias("_link"), F.coalesce(_when(e("pubDate")), _when(e("published")), _when(e("updated"))).alias("published_at"), _when(e("updated")).alias("updated_at"),
        F.coalesce(*[c(b) for b in body]).alias("_body"), publisher.alias("publisher"), author.alias("author"), F.coalesce(c(e("guid")), c(e("id"))).alias("_id"),
    )
    x = x.where(F.col("title").isNotNull() & F.col("_link").isNotNull() & F.col("published_at").isNotNull())
    x = x.withColumn("url", resolve_url(F.col("_link"), F.col("final_url"))).where(F.col("url").isNotNull())
    path = F.concat(F.when(F.col("_is"), "feed.entry[").otherwise("rss.channel.item["), F.col("i").cast("string"), F.lit("]"))
    out = x.select("source_id", "i", "title", "url", "published_at", "updated_at", F.coalesce("_body", "title").alias("content"), "publisher", "author", F.coalesce("_id", "url").alias("external_id"), path.alias("path"), F.col("_body").isNotNull().alias("has_body"))
    return out.withColumns({"excerpt": t.excerpt(F.col("content")), "language": t.language(F.concat("title", F.lit(" "), "content"))})
