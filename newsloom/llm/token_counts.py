"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold a pre-token's characters and tokens,
inner nodes the sums. An edit finds its leaves by descending on characters, cuts the touched region,
with boundary context on both sides, into pre-tokens again, encodes only pre-tokens that are new,
and updates the sums on the way up. The rest of the text isn't read again.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leaves gather up to this many pre-tokens.
LEAF = 64
#: Pre-tokens of context on either side of a touched region. The right edge is accepted where a new
#: pre-token ends with an old leaf, all text after it being unchanged; else the next leaf joins the region.
CONTEXT = 2
CACHE = 500_000


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Token counts of pre-tokens, with a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Segment tree over leaves of up to LEAF pre-tokens: sums of characters and tokens."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.encoded = encoder, 0
        pieces = encoder.split(text)
        self.leaves = [self._leaf(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        self._build()

    def _leaf(self, pieces: list[str]) -> list:
        self.encoded += len(pieces)
        return [pieces, sum(map(len, pieces)), sum(map(self.encoder.count, pieces))]

    def _build(self) -> None:
        self.size = 1
        while self.size < max(1, len(self.leaves)):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = leaf[1], leaf[2]
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _up(self, i: int) -> None:
        k = self.size + i
        self.chars[k], self.tokens[k] = self.leaves[i][1], self.leaves[i][2]
        k //= 2
        while k:
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    def find(self, pos: int) -> tuple[int, int]:
        """Leaf that holds character ``pos``, and where the leaf starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if pos >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return min(k - self.size, max(0, len(self.leaves) - 1)), start

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(leaf[0]) for leaf in self.leaves)

    def edit(self, pos: int, deleted: int, inserted: str) -> None:
        """Replaces ``deleted`` characters at ``pos`` by ``inserted``; both are cut to the text's ends."""
        pos = max(0, min(pos, self.length))
        deleted = max(0, min(deleted, self.length - pos))
        if not deleted and not inserted:
            return
        if not self.leaves:
            pieces = self.encoder.split(inserted)
            self.leaves = [self._leaf(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
            self._build()
            return
        lo, start = self.find(pos)
        hi, _ = self.find(pos + deleted)
        old = [p for leaf in self.leaves[lo : hi + 1] for p in leaf[0]]
        # the old region in pre-tokens: first touched one, with context, up to the end of the last leaf
        a, at = 0, start
        while a < len(old) - 1 and at + len(old[a]) < pos:
            at += len(old[a])
            a += 1
        a = max(0, a - CONTEXT)
        if a < CONTEXT and lo:  # context lies in the leaf before
            lo -= 1
            old = self.leaves[lo][0] + old
            a += len(self.leaves[lo][0]) - CONTEXT
            a = max(0, a)
            start -= self.leaves[lo][1]
        left = start + sum(map(len, old[:a]))
        while True:
            tail = "".join(old[a:])
            ahead = self.leaves[hi + 1][0] if hi + 1 < len(self.leaves) else []
            look = "".join(ahead[:CONTEXT])
            region = tail[: pos - left] + inserted + tail[pos - left + deleted :]
            new = self.encoder.split(region + look)
            p, cut = 0, None
            for k, piece in enumerate(new):
                p += len(piece)
                if p == len(region):
                    cut = k + 1
                    break
                if p > len(region):
                    break
            if cut is not None or hi + 1 >= len(self.leaves):
                new = new[:cut] if cut is not None else new
                break
            hi += 1
            old = old + self.leaves[hi][0]
        # pre-tokens before and after the changed ones are kept with their counts
        pieces = old[:a] + new
        same = 0
        while same < min(len(old), len(pieces)) and old[same] == pieces[same]:
            same += 1
        tail = 0
        while tail < min(len(old), len(pieces)) - same and old[-1 - tail] == pieces[-1 - tail]:
            tail += 1
        fresh = pieces[same : len(pieces) - tail]
        count = self.encoder.count
        self.encoded += len(fresh)
        change = sum(map(count, fresh)) - sum(map(count, old[same : len(old) - tail]))
        tokens = sum(leaf[2] for leaf in self.leaves[lo : hi + 1]) + change
        if lo == hi and 0 < len(pieces) <= 2 * LEAF:
            self.leaves[lo] = [pieces, sum(map(len, pieces)), tokens]
            self._up(lo)
        else:
            groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
            self.leaves[lo : hi + 1] = [[g, sum(map(len, g)), sum(map(count, g))] for g in groups]
            self._build()


def count_edited(docs: DataFrame, vocabulary: str = VOCABULARY, edits_col: str = "edits") -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_pretokens, n_encoded_after for each row of
    ``docs(doc_id, text, edits)``; edits is an array of structs (pos, deleted, inserted), applied in order,
    positions in characters of the text as the edits before left it.

    Null texts are empty, null edits none; an edit beyond the end is cut to it. The vocabulary is read
    once on the driver and sent to the workers (a fixed size, under 2 MB).
    """
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        encoder = Encoder(ranks.value)
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = Tree(encoder, text.as_py() or "")
                before, pieces = tree.total, tree.encoded
                tree.encoded = 0
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "")
                for o, v in zip(out, (before, tree.total, pieces, tree.encoded), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(o, pa.int64()) for o in out]], names=["doc_id", "n_tokens", "n_tokens_after", "n_pretokens", "n_encoded_after"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", edits_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_tokens_after long, n_pretokens long, n_encoded_after long")


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the edits of ``edits(doc_id, seq, pos, deleted, inserted)`` in the order of seq. A
    document's edits are gathered in one row, as its text is."""
    one = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "deleted", "inserted"))).alias("edits"))
    return docs.drop("edits").join(one, "doc_id", "left")


def derived_edits(text):
    """The registered query's edits: at a third of the text two characters go, in the middle a phrase is
    inserted, and the last character is doubled."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda pos, deleted, inserted: F.struct(pos.cast("int").alias("pos"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))
    return F.array(edit(F.floor(n / 3), 2, F.lit("")), edit(F.floor(n / 2), 0, F.lit(" as amended 2024,")), edit(n, 0, F.coalesce(F.right(text, F.lit(1)), F.lit(""))))
