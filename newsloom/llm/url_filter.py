"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Each URL is expanded into every (host suffix, path prefix) expression that a rule could have;
expressions meet rules by an equi-join on the first four bytes of SHA-256, the full digest confirms
them, and the longest confirmed rule wins. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path) of the registered query.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Rules up to this many (some 200 bytes each) are broadcast; more are shuffled.
BROADCAST_RULES = 200_000
#: Rows that no rule can fit are spread over so many values of the join's key.
SPREAD = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there
    up to ``? #`` or the end. A null URL or one without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as rows. A rule's path must begin and end with ``/``, so that path prefixes that end
    at a slash cover all of its matches."""
    for _, host, path in rules:
        if not (host and path.startswith("/") and path.endswith("/")):
            raise ValueError(f"not a rule: {host}{path}")
    names = ("action", "rule_host", "rule_path")
    none = F.array().cast("array<struct<action:string,rule_host:string,rule_path:string>>")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rules]) if rules else none
    return spark.range(1).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule (host and path together) wins, then the longer host, then ``block``. Rows that no rule
    fits get ``default``. Expansion goes as deep as the deepest rule: a longer suffix or prefix
    can't equal any rule, so long URLs cost no more. Null, empty and repeated rows keep one row
    each; columns of ``pages`` called host, path, rule or verdict are replaced; an empty table
    gives an empty result, and without rules every row gets ``default``.
    """
    host, path = host_and_path(F.col(url_col))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    deep = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes"),
        F.count("*").alias("n"),
    ).first()
    labels, slashes = deep["labels"] or 0, deep["slashes"] or 0
    keys = rules.select(
        F.concat("rule_host", "rule_path").alias("rule"), "action", F.length("rule_host").alias("host_len"),
        F.sha2(F.concat("rule_host", "rule_path"), 256).alias("digest"),
    ).withColumn("key", F.substring("digest", 1, 8))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(max(labels, 1))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(max(slashes, 1))), lambda i: i < F.size(F.split(F.col("path"), "/"))),
        lambda i: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/")),
    )
    distinct = pages.select("host", "path").where("path <> '' and host <> ''").distinct()
    expanded = (
        distinct.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
        .select("host", "path", F.explode(F.transform(prefixes, lambda p: F.concat(F.col("suffix"), p))).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("full"))
    )
    keys = F.broadcast(keys) if deep["n"] <= BROADCAST_RULES else keys
    hits = expanded.join(keys, F.substring(expanded.full, 1, 8) == keys.key).where("full = digest")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_len", "action", "rule")).alias("best")
    )
    # URLs without host or path, often null ones, meet nothing; as one key they would all go to one task
    spread = F.when((F.col("host") == "") | (F.col("path") == ""), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    judged = pages.withColumn("_spread", spread).join(best.withColumn("_spread", F.lit(0).cast("long")), ["host", "path", "_spread"], "left")
    return judged.select(*pages.columns, F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' ELSE 'allow' END AS verdict FROM q
"""
