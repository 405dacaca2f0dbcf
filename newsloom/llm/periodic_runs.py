"""Periodic runs of words in texts.

A run is a stretch of consecutive words that repeats with a smallest period q, is at least LEAST words and EXPONENT periods
long, and can't be extended. Runs are found with multi-scale minimizers. At scale s (a power of two) grams of s words are
hashed, and the minima of all windows of s / 2 grams are kept. Inside a run with s / 2 < q <= s two grams are equal just
where they lie a multiple of q apart, and windows that lie q apart are equal and have their minima q apart; the run is
long enough to hold two such windows. So a minimum and the next equal one are a seed with distance q, which is extended to
both sides, word by word. Periods up to SHORT are found by comparing the text with itself at each lag.

Texts are worked on many at a time: their words' ids lie one text after the other, each text ended by an id of its own,
so that nothing matches across texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words and in periods.
LEAST, EXPONENT = 6, 4
#: Periods up to this many words are found by direct comparison; the first scale covers the next ones.
SHORT = 8
#: Words that are worked on at a time; one longer text is worked on alone.
WORDS = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def doubled(h: np.ndarray, s: int) -> np.ndarray:
    """Hashes of grams of 2 * s words from those of s words."""
    return mixed(h[:-s] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(h[s:]))


def extreme(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) of every ``width`` consecutive values, width being a power of two."""
    step = 1
    while step < width:
        x = of(x[:-step], x[step:])
        step *= 2
    return x


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of at least one window of ``width`` values."""
    if len(h) < width:
        return np.empty(0, np.int64)
    low = extreme(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.nonzero(extreme(np.concatenate([pad, low, pad]), width, np.maximum) == h)[0]


def reach(w: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from places a and b on are equal, going right (step 1) or left (-1)."""
    n, size = 0, 64
    while True:
        room = min(size, (len(w) - max(a, b) if step > 0 else min(a, b) + 1) - n)
        if room <= 0:
            return n
        if step > 0:
            x, y = w[a + n : a + n + room], w[b + n : b + n + room]
        else:
            x, y = w[a - n - room + 1 : a - n + 1][::-1], w[b - n - room + 1 : b - n + 1][::-1]
        unequal = x != y
        k = int(unequal.argmax())
        if unequal[k]:
            return n + k
        n += room
        size *= 4


def short_runs(w: np.ndarray, q: int) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches that repeat with lag q."""
    if len(w) <= q:
        return
    same = np.concatenate([[False], w[q:] == w[:-q], [False]])
    edge = np.nonzero(same[1:] != same[:-1])[0]
    start, end = edge[::2], edge[1::2]
    long = end - start + q >= max(LEAST, EXPONENT * q)
    yield from zip(start[long].tolist(), (end[long] + q).tolist(), strict=True)


def find_runs(w: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. ``w``: ids of texts one after the other, each followed by
    an id that occurs nowhere else; ``lengths``: of the texts, in descending order."""
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, q: int) -> None:
        found[start, end] = min(q, found.get((start, end), q))

    for q in range(1, SHORT + 1):
        for start, end in short_runs(w, q):
            add(start, end, q)
    s, h = 1, mixed(w.astype(np.uint64))
    ends = np.cumsum(lengths + 1)
    while len(lengths):
        # texts come in descending order of length: those that can hold a run of this scale are the first ones
        many = int(np.searchsorted(-lengths, -EXPONENT * (s // 2 + 1), side="right"))
        if not many or len(h) <= s:
            break
        size = int(ends[many - 1])
        if s > SHORT:
            at = minima(h[:size], s // 2)
            order = np.argsort(h[at], kind="stable")
            at = at[order]
            gap = at[1:] - at[:-1]
            seed = (h[at[1:]] == h[at[:-1]]) & (gap > s // 2) & (gap <= s)
            done: dict[int, int] = {}
            left, lag = at[:-1][seed], gap[seed]
            order = np.argsort(left, kind="stable")
            for m, q in zip(left[order].tolist(), lag[order].tolist(), strict=True):
                if m < done.get(q, -1):
                    continue
                end = m + reach(w, m, m + q, 1)
                start = m + 1 - reach(w, m, m + q, -1) if end > m else m
                done[q] = end
                if end - start + q >= EXPONENT * q:
                    add(start, end + q, q)
        h = doubled(h[:size], s) if size > s else h[:0]
        s *= 2
    rows = np.array([(a, b - a, q) for (a, b), q in found.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of texts, each followed by an id of its own, and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    words = pa.array([x for t in texts for x in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    w = np.empty(len(words) + len(texts), np.int64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = words, np.arange(len(texts)) + len(words)
    return w, lengths


def analyse(texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[str]]:
    """Number of words, runs, and what is left without repeats, of each text."""
    split = [t.split() for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(split[i]))
    w, lengths = _ids([split[i] for i in order])
    ends = np.cumsum(lengths + 1)
    runs = find_runs(w, lengths)
    owner = np.searchsorted(ends, runs[:, 0], side="right") if len(runs) else np.empty(0, np.int64)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: list = [None] * len(texts)
    left: list = [""] * len(texts)
    for k, i in enumerate(order):
        own = runs[first[k] : first[k + 1]] - np.array([ends[k] - lengths[k] - 1, 0, 0])
        out[i] = own
        if len(own):
            cover = np.zeros(len(split[i]) + 1, np.int64)
            np.add.at(cover, own[:, 0] + own[:, 2], 1)
            np.add.at(cover, own[:, 0] + own[:, 1], -1)
            kept = np.nonzero(np.cumsum(cover[:-1]) == 0)[0]
            left[i] = b" ".join([split[i][j] for j in kept.tolist()]).decode()
        else:
            left[i] = b" ".join(split[i]).decode()
    return [len(x) for x in split], out, left


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words (words are parted by ASCII white space), all runs of the text by start and period, and ``collapsed``, the
    words joined by one blank without those that a run contains after its first period.

    One pass without a shuffle; memory is that of WORDS words, or of one text if that is longer. A null or empty text has no
    words, no runs and an empty ``collapsed``. Rows are answered one by one, repeated ones and those without doc_id too; other
    columns of ``docs`` aren't read. Runs that overlap are all given; of periods of one stretch the smallest counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # a word takes two bytes at least, with its blank
        size = np.cumsum(np.array(batch.column(1).cast(pa.binary()).fill_null(b"").to_pandas().str.len(), np.int64) // 2 + 1)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + WORDS, side="right")))
            yield batch.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole) if whole.num_rows else ():
                n, runs, left = analyse(batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist())
                flat = np.concatenate(runs)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(schema.value_type))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows).cast(schema), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as test material: with h = crc32 of the decimal doc_id and g = h div 10, a text of n words, h being
    divisible by 10, is words 0 to a = g mod n of its own, then from a on the same 1 + (n - a) div (3 + g mod 8) words again and
    again, up to n words. Texts without words, or without doc_id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda x, i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"))
    return chosen.select("doc_id", F.when(F.size("_words") > 0, planted(F.col("_words"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: the number of runs, the longest (ties: smallest start, then period), and digests of all runs and of
    what is left."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    x = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    return x.select("doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), F.col("b.p").alias("period"), F.floor(1000 * length / F.col("b.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
