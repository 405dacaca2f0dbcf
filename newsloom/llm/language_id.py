"""Language ID by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams; a text gets the language
whose profile is nearest to its own ranking by the out-of-place distance (Cavnar and Trenkle, 1994).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import first_by_hash, partitions

#: Length of a profile, and of a text's own ranking.
PROFILE = 300
#: n-grams of 1 to this many characters; a word is framed by blanks.
LONGEST = 3
#: Labelled texts that a language's profile is fitted on, at most: those first in the order of a hash of id and text.
FIT_ROWS = 2_000
UNKNOWN = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a character) and counts of the n-grams of a whole text, lower-cased, runs of
    other characters than letters taken as one blank. Both are empty if there is no letter."""
    plain = _NO_LETTER.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, plain)):  # a letter is of one of Unicode's categories L; ½ and Ⅷ are none
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    blank = c == 32
    parts = [c[~blank]]
    if LONGEST >= 2:
        parts.append((c[:-1] << 21) | c[1:])
    if LONGEST >= 3:
        inner = ~blank[1:-1]  # no n-gram spans two words
        parts.append(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Codes by falling count, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def held_out(doc_id):
    """Documents that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_profiles(docs: DataFrame, rows: int = FIT_ROWS, size: int = PROFILE) -> DataFrame:
    """``(lang, code, place)``: each language's n-grams by falling count, ties by code.

    Learns from text and lang of labelled documents that aren't held out, ``rows`` of each language at most
    (the bounded sample of a classifier), first in the order of a hash of doc_id and text. A rare language so has
    its profile in any corpus; rows that repeat one count once; null doc_ids are learned from as well.
    """
    sample = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = first_by_hash(sample.select("doc_id", "lang", "text"), rows, "doc_id", "text", by="lang")

    def count(batches):
        for batch in batches:
            langs, codes, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n = gram_counts(text)
                langs += [lang] * len(k)
                codes.append(k)
                counts.append(n)
            if langs:
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "code", "n"])

    from pyspark.sql import Window

    grams = sample.select("lang", "text").repartition(partitions(docs)).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    return grams.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", "place")


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score.

    lang_pred is ``und`` for a text that is null, has no letter, or if nothing was learned. A text's
    distance to a profile sums, over its own ranked n-grams, how many places each is off, ``size``
    for one that the profile lacks; score is 1 - distance / the largest possible. Equal distances go
    to the language that is first by code point. Long texts are ranked whole. Columns of ``docs`` named
    lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    known = [(lang, np.argsort(np.array(codes, np.int64), kind="stable"), np.sort(np.array(codes, np.int64))) for lang, codes in sorted(profiles) if codes]

    def judge(text):
        mine = ranking(*gram_counts(text), size)
        if not len(mine) or not known:
            return UNKNOWN, 0.0
        best = None
        for lang, places, codes in known:
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            off = np.where(codes[at] == mine, np.minimum(np.abs(places[at] - np.arange(len(mine))), size), size).sum()
            if best is None or off < best[0]:
                best = off, lang
        return best[1], 1.0 - best[0] / (size * len(mine))

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            got = [judge(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


def collect_profiles(profiles: DataFrame) -> list[tuple[str, list[int]]]:
    """At most ``PROFILE`` codes a language."""
    by: dict[str, list] = {}
    for r in profiles.orderBy("lang", "place").collect():
        by.setdefault(r.lang, []).append(r.code)
    return list(by.items())


def identify(docs: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Profiles fitted on the labelled rows of ``fit_on`` (``docs`` itself by default), then applied to
    every row of ``docs``; adds held_out, lang_pred, score."""
    profiles = collect_profiles(fit_profiles(docs if fit_on is None else fit_on))
    return predict(docs, profiles).withColumn("held_out", held_out(F.col("doc_id")))
