"""Benchmark decontamination with SimHash windows. Only built-in functions are used.

Windows of a document, as long as a benchmark item, get a 64-bit SimHash of their words. A multi-index
over four 16-bit blocks finds every item whose fingerprint is within Hamming distance 15: of four blocks
one then differs in three bits at most, and the index holds all block values that near. Candidates are
verified exactly by the similarity of their weighted five-word shingles, the weights being how often each
occurs.

All windows of an item's length count, at every word and cut at the document's ends. No fingerprint is made
of a window in which so few shingles occur in any benchmark item of its length that it can't reach the asked similarity: which
shingles do is a test of membership, while which item a window may hold is found by the index alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import Scratch, let

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
#: Values within this many bits of a block's value are indexed: a distance of RADIUS leaves one block so near.
BLOCK_RADIUS = RADIUS // BLOCKS
#: Benchmark shingles with the length of an item (8-byte hash, int) up to this many are broadcast, more are shuffled.
BROADCAST_SHINGLES = 500_000
#: (doc_id, hash) pairs of documents with such a shingle: the same.
BROADCAST_DOCUMENTS = 1_000_000

_MASKS = [sum(1 << b for b in bits) for k in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), k)]
_BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII blanks; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BLANK), "")


def shingles(ws: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words, in order; none if there are fewer words."""
    each = lambda w: lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), each(w))
    return let(ws, lambda w: F.when(F.size(w) >= size, run(w)).otherwise(F.array().cast("array<bigint>")))


def fingerprint(ws: Column) -> Column:
    """SimHash: bit b is set if more than half of the words' hashes have it."""
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    ones = lambda hs, b: F.aggregate(hs, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    bit = lambda hs: lambda acc, b: acc.bitwiseOR(F.when(ones(hs, b) * 2 > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return let(hashes, lambda hs: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit(hs)))


def _block(fp: Column, k: int) -> Column:
    """Value of block k with the block's number above it."""
    return F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) + F.lit(k << BLOCK_BITS)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of two arrays' elements."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    common = lambda p: F.aggregate(F.array_intersect(p.a, p.b), F.lit(0), lambda n, s: n + F.least(count(p.a, s), count(p.b, s)))
    ratio = lambda p: let(common(p), lambda both: both / (F.size(p.a) + F.size(p.b) - both))
    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def window_starts(similarity: float) -> Column:
    """Starts of the windows of ``w`` words, in a text of ``n``, that can be so similar to an item of ``w`` words; those
    before word 0 are cut there. ``places`` are the text's shingles that are in such items, in order.

    Two collections of a and b shingles of which c are common have similarity c / (a + b - c), so a window needs
    similarity * (a + b) / (1 + similarity) of its places, and that is at least similarity * b. A window is found with its
    first place, number k: it starts after the place before, and the last one that it needs lies in it.
    """
    size = F.col("w") - (SHINGLE - 1)
    enough = lambda shared: F.ceil(shared - F.lit(1e-6)).cast("int")
    nth = lambda k, needed: F.get("places", k + needed - 1)
    least = enough(size * similarity)
    cut = lambda s: F.least(s + size, F.col("n") - (SHINGLE - 1)) - F.greatest(s, F.lit(0))
    reaches = lambda k: lambda s: nth(k, enough((cut(s) + size) * (similarity / (1 + similarity)))) < s + size
    low = lambda k: F.greatest(nth(k, least) - size + 1, F.get("places", k - 1) + 1)
    near = lambda p, k: nth(k, least).isNotNull() & (low(k) <= p)
    spans = lambda p, k: F.when(near(p, k), F.filter(F.sequence(low(k), p), reaches(k))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform("places", spans))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, start_word, n_words, distance,
    similarity (of the best window; ties by the earliest).

    A document holds an item if a window of the item's length, at any of its words and cut at the document's ends, has
    a fingerprint within ``radius`` and a weighted shingle similarity of ``similarity`` or more. Whole texts are read. Null
    and empty texts or items, and items of fewer than five words, match nothing; repeated rows and doc_ids give one row, rows
    without doc_id none; other columns aren't read.

    Windows are compared by their content, once each, so a passage that fills many documents is
    fingerprinted once. Documents are never grouped by item or passage.
    """
    if radius != RADIUS:
        raise ValueError("the block index is made for the module's RADIUS")
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") >= SHINGLE)
    items = items.select("item_id", F.size("ws").alias("w"), shingles(F.col("ws")).alias("item_shingles"), fingerprint(F.col("ws")).alias("item_fp"))
    places = items.select("w", F.explode("item_shingles").alias("h")).distinct()
    if places.count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)
    # only hashes are exploded; texts are cut again where one of them is the benchmark's
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    each = docs.select("doc_id", "text_key", words(F.col("text")).alias("ws")).select("doc_id", "text_key", F.size("ws").alias("n"), F.posexplode(shingles(F.col("ws"))).alias("i", "h"))
    places_held = each.join(places, "h").groupBy("doc_id", "text_key", "n", "w").agg(F.sort_array(F.collect_set("i")).alias("places"))
    starts = scratch.save(places_held.select("doc_id", "text_key", "w", F.explode(window_starts(similarity)).alias("at")))
    held = starts.select("doc_id", "text_key").distinct()
    if held.count() <= BROADCAST_DOCUMENTS:
        held = F.broadcast(held)
    texts = scratch.save(docs.join(held, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", words(F.col("text")).alias("ws")))
    start = F.greatest(F.lit(0), F.col("at"))
    length = F.least(F.col("at") + F.col("w"), F.size("ws")) - start
    windows = texts.join(starts, ["doc_id", "text_key"]).select("doc_id", start.alias("start_word"), F.array_join(F.slice("ws", start + 1, length), " ").alias("window"))
    windows = scratch.save(windows.distinct())
    contents = windows.select("window").distinct().withColumn("ws", F.split("window", " ")).where(F.size("ws") >= SHINGLE)
    contents = contents.select("window", fingerprint(F.col("ws")).alias("fp"), shingles(F.col("ws")).alias("hs"))
    blocks = contents.select("window", "fp", "hs", F.explode(F.array(*[_block(F.col("fp"), k) for k in range(BLOCKS)])).alias("key"))
    masks = F.array(*[F.lit(m) for m in _MASKS])
    near = items.select("item_id", "item_fp", "item_shingles", F.explode(F.array(*[_block(F.col("item_fp"), k) for k in range(BLOCKS)])).alias("value"))
    near = near.select("item_id", F.col("item_fp"), F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m.cast("long")))).alias("key"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    found = blocks.select("window", "fp", "key").join(near, "key").where(distance <= radius).select("window", "item_id", distance.alias("distance")).distinct()
    sides = found.join(contents.select("window", "hs"), "window").join(items.select("item_id", "item_shingles"), "item_id")
    sides = sides.withColumn("similarity", weighted_similarity(F.col("hs"), F.col("item_shingles"))).where(F.col("similarity") >= similarity)
    hits = windows.join(sides.select("window", "item_id", "distance", "similarity"), "window")
    n_words = F.size(F.split("window", " "))
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("minus"), n_words.alias("n"), "distance")).alias("best"))
    return best.select(
        "doc_id", "item_id", (-F.col("best.minus")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"),
        F.col("best.distance").cast("long").alias("distance"), F.col("best.similarity").alias("similarity"),
    )
