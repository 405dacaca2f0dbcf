"""Groups of spelling variants.

Two words are near if one inserted, deleted or replaced letter makes one the other. A replaced letter changes two letter
counts by one each (one up, one down), an inserted one changes one count: words that are near are at an L1 distance of two or
one as vectors of letter counts. For each pair of lengths (n, n) and (n, n + 1) the words of the first are sought in a k-d tree over the
count vectors of the second: the tree's boxes are pruned by how far a query can still move up and down, and of what is
left the order of letters is verified.

A length with many words has a tree of cells on top, built from a bounded sample: a word is stored in one cell and sought in all cells
that its moves reach, at most 1 + up + down + up * down of those on the way. Each cell is one task's work and has its own tree.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import Scratch, partitions

#: Letters of words (maximal runs), least length and least number of occurrences.
LETTERS, LEAST, TIMES = r"a-zÀ-ÿ", 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Words that a cell holds about, words of the sample for each cell that is wanted, and words of a leaf in a cell's tree.
CELL, SAMPLE, LEAF = 262_144, 1_024, 256
#: Cells of a length at most; beyond it cells grow and a task's memory with them (some 500 bytes a word).
CELLS = 256
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
ALPHABET = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
_AT = np.full(0x100, -1, np.int64)
_AT[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def runs_of(text: str) -> list[str]:
    """Maximal runs of letters of at least LEAST code points, only A-Z being lower-cased."""
    return re.findall(f"[{LETTERS}]{{{LEAST},}}", text.encode().lower().decode())


def misspelt(doc_id, run: str) -> str:
    """With h = crc32 of ``<doc_id>:<run>`` divisible by 31, the run without its code point h mod length."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % 31 == 0 else run


def word_counts(docs: DataFrame, changed=misspelt) -> DataFrame:
    """(word, n): the words of ``docs(doc_id, text)`` with their occurrences, those of LEAST code points and TIMES occurrences
    at least. ``changed(doc_id, run)`` gives the word that a run of a text stands for (None: the run). Occurrences are counted in
    each task before they are shuffled, so that a frequent word is no hot key. A null text has no words; a null doc_id is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                for r, n in Counter(runs_of(text)).items():
                    w = changed("" if doc_id is None else doc_id, r) if changed else r
                    if len(w) >= LEAST:
                        held[w] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row a word."""
    out = np.zeros((len(words), len(ALPHABET)), np.int16 if all(len(w) < 1 << 15 for w in words) else np.int32)
    if words:
        lengths = np.array([len(w) for w in words])
        letters = _AT[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        np.add.at(out, (np.repeat(np.arange(len(words)), lengths), letters), 1)
    return out


class Tree:
    """K-d tree over letter counts: a node parts its points at a letter's median count, ``count <= cut`` to the left. A node whose
    points are all equal, or few, is a leaf."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.cut: list[tuple[int, int, int, int] | None] = []
        self.leaves: list[np.ndarray | None] = []
        self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, own: np.ndarray, leaf: int) -> int:
        me = len(self.cut)
        self.cut.append(None)
        self.leaves.append(None)
        if len(own) > leaf:
            p = points[own]
            best = None
            for c in np.argsort(-p.var(axis=0), kind="stable")[:4].tolist():  # of the letters that vary most the one that parts best
                low = int(np.median(p[:, c]))
                for cut in (low - 1, low):
                    n = int((p[:, c] <= cut).sum())
                    if 0 < n < len(own) and (best is None or abs(2 * n - len(own)) < best[0]):
                        best = (abs(2 * n - len(own)), c, cut)
            if best is not None:
                _, c, cut = best
                left = p[:, c] <= cut
                a = self._build(points, own[left], leaf)
                b = self._build(points, own[~left], leaf)
                self.cut[me] = (c, cut, a, b)
                return me
        self.leaves[me] = own
        return me

    def reached(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries whose moves reach its box): up to ``up`` letters (0 or 1) may be one more, and ``down`` (0 or 1) one less,
        the one that falls standing before the one that rises in the alphabet. A query that crosses a cut has made its move."""
        n = len(queries)
        none = len(ALPHABET)
        stack = [(0, np.arange(n), np.full(n, none, np.int8), np.full(n, -1, np.int8))]  # letters that rose and fell
        while stack:
            node, q, rose, fell = stack.pop()
            if not len(q):
                continue
            cut = self.cut[node]
            if cut is None:
                yield node, q
                continue
            c, at, left, right = cut
            v = queries[q, c]
            inside = v <= at
            over = np.nonzero((v == at) & (rose == none) & (fell < c))[0] if up else []
            under = np.nonzero((v == at + 1) & (fell == -1) & (rose > c))[0] if down else []
            for side, here, crossed in ((left, inside, under), (right, ~inside, over)):
                if not len(crossed):
                    stack.append((side, q[here], rose[here], fell[here]))
                    continue
                now = np.full(len(crossed), c, np.int8)
                r, f = (now, fell[crossed]) if side == right else (rose[crossed], now)
                stack.append((side, np.concatenate([q[here], q[crossed]]), np.concatenate([rose[here], r]), np.concatenate([fell[here], f])))

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        for node, q in self.reached(points, 0, 0):
            out[q] = node
        return out


def letters(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, size)


_BIT = np.uint64(1) << (np.arange(len(ALPHABET), dtype=np.uint64) % np.uint64(64))


def sums(words: np.ndarray) -> np.ndarray:
    """The sum of 2 ** (letter mod 64) over the letters of each word: one more letter adds a power of two."""
    return _BIT[_AT[words]].sum(axis=-1, dtype=np.uint64)


def may_be_near(a: np.ndarray, b: np.ndarray, grown: int) -> np.ndarray:
    """Whether words of such sums can differ by one letter more in ``b`` (``grown``), or by one letter for another."""
    d = b - a
    if grown:
        return np.bitwise_count(d) == 1
    low = d & (~d + np.uint64(1))  # a power of two less another one is a run of ones
    return (np.bitwise_count(d + low) <= 1) | (np.bitwise_count(low - d) <= 1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each word of ``a`` becomes the word of ``b`` beside it: by one letter replaced by a later one, where words of
    both have one length, else by one letter inserted."""
    if a.shape[-1] == b.shape[-1]:
        differ = a != b
        return (differ.sum(axis=-1, dtype=np.int32) == 1) & ((a < b) & differ).any(axis=-1)
    # up to some place the letters stand as they were, from there on one further
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=-1).sum(axis=-1, dtype=np.int32)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=-1).sum(axis=-1, dtype=np.int32)
    return ahead + behind >= a.shape[-1]


#: Pairs of words that are compared at a time.
BLOCK = 1 << 15


class Searched:
    """A cell's words of ``size`` letters, with their tree."""

    def __init__(self, words: list[str], size: int):
        self.words, self.size = words, size
        self.points, self.tree = letters(words, size), Tree(vectors(words), LEAF)
        self.sums = sums(self.points)

    def near(self, asked: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): asked[i] becomes words[j] by one edit."""
        lengths = np.array([len(w) for w in asked])
        for grown in (0, 1):
            q = np.nonzero(lengths == self.size - grown)[0]
            if not len(q):
                continue
            own = [asked[i] for i in q.tolist()]
            a = letters(own, self.size - grown)
            s = sums(a)
            for node, hit in self.tree.reached(vectors(own), 1, 1 - grown):
                there = self.tree.leaves[node]
                for part in np.array_split(hit, len(hit) * len(there) // BLOCK + 1):
                    i, j = np.divmod(np.flatnonzero(may_be_near(s[part][:, None], self.sums[there][None], grown)), len(there))
                    i, j = part[i], there[j]
                    good = one_edit(a[i], self.points[j])
                    if good.any():
                        yield q[i[good]], j[good]


def cells(words: DataFrame) -> dict[int, tuple[Tree, dict[int, list[int]]]]:
    """For each length with more than CELL words a tree of about n / CELL cells over a sample of SAMPLE words a cell (first
    by hash), with the numbers of the cells of each leaf: more than one where words have equal counts. Bounded by CELLS a length."""
    large = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()
    out = {}
    for r in large:
        many = min(CELLS, -(-r.n // CELL))
        # a hash bound under which twice the sample is expected, so that few rows are sorted
        bound = -(1 << 63) + int((1 << 64) * min(1.0, 2.0 * many * SAMPLE / r.n)) - 1
        h = F.xxhash64("word", F.lit(7))
        rows = words.where((F.length("word") == r.size) & (h <= bound)).select("word", h.alias("h")).orderBy("h", "word").limit(many * SAMPLE).collect()
        points = vectors([x.word for x in rows])
        tree, numbers, k = Tree(points, SAMPLE), {}, 0
        for node, own in enumerate(tree.leaves):
            if own is not None:
                parts = max(1, len(own) // (2 * SAMPLE))
                numbers[node] = list(range(k, k + parts))
                k += parts
        out[r.size] = (tree, numbers)
    return out


def dealt(words: DataFrame, trees: dict[int, tuple[Tree, dict[int, list[int]]]]) -> DataFrame:
    """(size, cell, asked, word, n): each word once in its cell (asked 0), and once in each cell of its own length and of the
    next one that its moves reach (asked 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(0).to_pylist()
            lengths = np.array([len(x) for x in w])
            at, size, cell, asked = [], [], [], []

            def put(rows, s, c, a):
                at.append(rows)
                size.append(np.full(len(rows), s))
                cell.append(np.broadcast_to(c, len(rows)))
                asked.append(np.full(len(rows), a))

            for n in np.unique(lengths).tolist():
                q = np.nonzero(lengths == n)[0]
                v = vectors([w[i] for i in q.tolist()])
                for grown in (0, 1):
                    s = n + grown
                    if s not in trees:
                        if not grown:
                            put(q, s, 0, 0)
                        put(q, s, 0, 1)
                        continue
                    tree, numbers = trees[s]
                    if not grown:
                        node = tree.place(v)
                        for k in np.unique(node).tolist():
                            own, ids = q[node == k], np.array(numbers[k])
                            put(own, s, ids[np.array([zlib.crc32(w[i].encode()) % len(ids) for i in own.tolist()])], 0)
                    for node_, hit in tree.reached(v, 1, 1 - grown):
                        for c in numbers[node_]:
                            put(q[hit], s, c, 1)
            if at:
                rows = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(asked), pa.int64()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                ], names=["size", "cell", "asked", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "size bigint, cell bigint, asked bigint, word string, n bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of near words of ``words(word, n)`` once, with their occurrences."""
    rows = dealt(words, cells(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, counts, cell_words = None, [], [], None

        def search(asked: list[str], n: pa.Array) -> Iterator[pa.RecordBatch]:
            nonlocal cell_words
            if cell_words is None:
                cell_words = Searched(held, int(key[0]))
            found = list(cell_words.near(asked))
            if found:
                i, j = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(asked).take(i), n.take(i), pa.array(held).take(j), pa.array(counts, pa.int64()).take(j)], names=["a", "na", "b", "nb"])

        for batch in batches:
            size, cell, asked = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            change = np.nonzero((size[1:] != size[:-1]) | (cell[1:] != cell[:-1]) | (asked[1:] != asked[:-1]))[0] + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if key != (size[lo], cell[lo]):
                    key, held, counts, cell_words = (size[lo], cell[lo]), [], [], None
                w, n = batch.column(3).slice(lo, hi - lo).to_pylist(), batch.column(4).slice(lo, hi - lo)
                if not asked[lo]:
                    held += w
                    counts += n.to_pylist()
                elif held:
                    yield from search(w, n)

    by = rows.repartition(partitions(words), "size", "cell").sortWithinPartitions("size", "cell", "asked")
    return by.mapInArrow(run, "a string, na bigint, b string, nb bigint")


def spelling_groups(words: DataFrame) -> DataFrame:
    """Of ``words(word, n)``, distinct words of letters: word, form (its near word of largest n, ties by code points, if that is RATIO times
    its own n or more; else null), root (what the forms lead to; the word itself without one), n, n_near, form_n.

    Words of one letter count vector can't be near; they share a leaf, whose words are dealt to several cells by hash where
    they are many. No pair is formed but of words that a leaf's box doesn't part. An empty table gives an empty one; words must
    not repeat or be null."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words)
    pairs = scratch.save(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w")).alias("o"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.struct((-F.col("na")).alias("m"), F.col("a").alias("w")).alias("o")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("o").alias("o"), F.first("n").alias("_n"))
    fits = -F.col("o.m") >= RATIO * F.col("_n")
    near = scratch.save(near.select("word", "n_near", F.when(fits, F.col("o.w")).alias("form"), F.when(fits, -F.col("o.m")).alias("form_n")))
    # forms grow RATIO times at each step, so chains are short; each round doubles what a word has followed
    root = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        root = scratch.save(root)
        step = root.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = root.join(step, F.col("root") == F.col("_w"))
        if further.isEmpty():
            break
        root = root.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"))
    out = words.join(near, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
