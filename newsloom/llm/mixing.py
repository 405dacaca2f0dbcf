"""Mixing sources to target weights by entropy balancing. Only built-in functions are used.

The mix keeps document rates as near to 1 as their token totals allow: it minimises the
token-weighted entropy  sum size * (r ln r - r + 1)  under one token constraint a source. The dual is
convex, a document's rate is the exponential tilt  exp(lambda_source), and Newton steps on the dual
need, per source, the sum of the sizes alone: a constraint's gradient and curvature are both
size * exp(lambda). That sum is gathered once, by a partially combined aggregation over all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import Scratch, broadcast_if_small

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
NEWTON_STEPS = 40


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of ``totals(source, source_size)``: sources by code point, null last, take ``weights`` in
    turn and share ``share`` of all words; none gets more than ``cap`` times its own size, and what
    is above is shared again by weight until none is.

    That repeated sharing has a closed form: sources in the order of cap over weight, as many capped
    as lie below the level that the rest then gets. One row a source is windowed, no document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({
        "left": F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    w = w.withColumn("level", F.col("left") / F.col("left_weight"))
    w = w.withColumn("capped", F.col("ratio") < F.col("level"))
    # the first source that isn't capped sets the level of all after it
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(everything)["level"]
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("weight") * level, F.col("most"))).alias("target"))


def balance(targets: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds ``rate``: Newton steps on  source_size * exp(x) - target * x  from x = 0, damped to
    steps of at most 1. A source without words has rate 0."""
    step = lambda x, _: x - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("target") / (F.col("source_size") * F.exp(x))))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return targets.withColumn("rate", F.when(F.col("target") > 0, F.exp(solved)).otherwise(F.lit(0.0)))


def _plan(sized: DataFrame, weights, share: float, cap: float, scratch: Scratch) -> DataFrame:
    """One row a source: its size, target and rate, and the hash range in which the fractional copies end, with
    the words of the ranges before it. Made from sums over 4,096 ranges a source, gathered once over all documents."""
    ranges = scratch.save(sized.groupBy("source", "_range").agg(F.sum("size").alias("_words")))
    totals = ranges.groupBy("source").agg(F.sum("_words").alias("source_size"))
    # copies of rates that are whole numbers but for rounding have no fraction to place
    whole = F.floor(F.col("rate") + 1e-9)
    rates = balance(source_targets(totals, weights, share, cap), NEWTON_STEPS).withColumn("_whole", whole)
    rates = rates.withColumn("_quota", F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    ends = ranges.join(rates.select(F.col("source").alias("_s"), "_quota"), F.col("source").eqNullSafe(F.col("_s"))).where("_before + _words >= _quota")
    ends = ends.groupBy("source").agg(F.min(F.struct("_range", "_before")).alias("_end"))
    rates = rates.withColumnRenamed("source", "_t")
    out = rates.join(ends, F.col("source").eqNullSafe(F.col("_t")), "left").select("_t", "source_size", "target", "rate", "_whole", "_quota", "_end._range", "_end._before")
    return scratch.save(out.withColumnsRenamed({"_range": "_last", "_before": "_spent"}))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, rate, copies and taken.

    ``taken`` is the number of words that the mix takes. Each document gets floor(rate) whole
    copies; the rest of the source's target goes, as one more copy each, to the documents that come
    first in the order of a hash of doc_id and text, and the document where it ends gives only its first words, so
    a source's taken words equal its target, rounded, if the target is at most ``cap`` times its size
    (``cap`` a whole number). ``copies`` is taken over size. Sums over 4,096 hash ranges a source tell in which
    range the copies end; only that range's documents are ordered, in a window of some 1/4,096 of a source. All others
    are answered where they lie: no text is shuffled but that range's, and no source is sorted in one task.

    Null and empty texts have size 0 and take 0; a null source is a source of its own; repeated rows
    are documents of their own; rows alike in doc_id and text are alike in all that counts. Columns
    of ``docs`` with the names of results are replaced. An empty table gives an empty result. The table of sources (one
    row each) is broadcast up to a million of them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    names = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*names)
    order = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, 3))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    plan = _plan(keyed.select("source", "_range", size.alias("size")), weights, share, cap, scratch)
    met = keyed.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_t")))
    at_end = F.coalesce(F.col("_range") == F.col("_last"), F.lit(False))
    inside = Window.partitionBy("source").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = met.where(at_end).withColumn("size", size).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = last.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_quota") - F.col("_spent") - F.col("_inside"))))
    rest = met.where(~at_end).withColumn("size", size).withColumn("_inside", F.lit(0).cast("long"))
    rest = rest.withColumn("_more", F.when(F.col("_last").isNull() | (F.col("_range") < F.col("_last")), F.col("size")).otherwise(F.lit(0)))
    out = rest.unionByName(last).withColumn("taken", (F.col("_whole") * F.col("size") + F.col("_more")).cast("long"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))
    return out.select(*docs.columns, *names)


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The corpus that a mix makes: each row of ``mix``'s result as often as it is taken, ``copy`` from 0, the last one cut
    to its first words, a blank between them, if it isn't taken whole; rows that aren't taken go. n_chars, if there, follows the text."""
    rows = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    words = F.col("taken") - F.col("copy") * F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), words.cast("int")), " ")
    rows = rows.withColumn("text", F.when(words >= F.col("size"), F.col("text")).otherwise(head))
    return rows.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else rows


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM t),
x AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS whole, sum(weight) OVER () AS weights FROM w),
y AS (SELECT *, (whole - coalesce(sum(most) OVER o, 0)) / (weights - coalesce(sum(weight) OVER o, 0)) AS level FROM x
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (SELECT min_by(level, ratio) FROM y WHERE ratio >= level) AS lv FROM y),
g AS (SELECT source, source_size, CASE WHEN ratio < level THEN most ELSE least(weight * lv, most) END AS target FROM z),
r AS (SELECT *, CASE WHEN target > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM g),
e AS (SELECT d.*, r.source_size, r.target, CAST(r.whole AS BIGINT) AS whole, CAST(round(r.target) AS BIGINT) - CAST(r.whole AS BIGINT) * r.source_size AS quota,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '/' || md5(coalesce(d.text, ''))), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, quota - before)) AS BIGINT) AS taken FROM e
"""
