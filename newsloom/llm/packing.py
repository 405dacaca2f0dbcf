"""Packing of tokenized documents into sequences of several lengths.

Hierarchical: a document's full windows of LENGTH tokens are sequences as they are; what is left is routed to the shortest tier
(context size, a power of two) that holds it. Tiers are packed from the longest to the shortest: a sequence begins with the tier's
longest piece, its gap is filled with the longest pieces of its own and shorter tiers that fit, and the last gap by cutting the
shortest one that doesn't. So sequences are full, and few documents are cut more than at their windows. What is left at the
end of a task is cut at powers of two, which need no padding. Step groups take sequences of one tier, as many as make
STEP tokens, so that steps are alike in tokens and in shape.

Documents are tokenized and packed where they lie; only the pieces' places are written and counted, to number sequences
over all tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import Scratch, broadcast_if_small
from newsloom.llm.token_counts import PATTERN

LENGTH, END = 2048, 1
#: Shortest tier; shorter sequences only hold what is left at the end of a task.
SHORTEST = 256
#: Tokens of a step group.
STEP = 16 * LENGTH
#: Tokens that are gathered before they are packed, and bytes of text that are tokenized at a time.
GATHER, CHARS = 1 << 20, 12 << 20
#: What a text is cut at blanks without: blanks next to white space or at the ends, and white space that engines tell apart
#: differently. Such texts are encoded whole.
UNSAFE = r"[ \t\n\r] | [ \t\n\r]|^ | $|[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver (some MB), so that executors need no copy of the file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token with its id, if the vocabulary's merges are in the order of their ids, so that the rank of a pair is
    the id of what it makes; else None. Byte-level vocabularies write the bytes that aren't printable as characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in added} if made == sorted(made) else None


class Encoder:
    """Ids of texts, as the tokenizer gives them for whole texts. A byte-level BPE parts a text into pre-tokens, and none of them goes
    over from a character that is no white space to a blank; so texts are cut at blanks, and of some MB of texts each distinct
    string is encoded once: all of them as one text, whose ids are told apart by their lengths in bytes. Texts with odd white
    space or the vocabulary's special strings are encoded whole by the tokenizer itself."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        ranks = byte_ranks(json.loads(spec))
        self.ranked = ranks and tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if ranks:
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            for t, i in ranks.items():
                self.width[i] = len(t)
        self.unsafe = "|".join([UNSAFE, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        unsafe = pc.match_substring_regex(texts, self.unsafe) if self.ranked else pa.array([True] * len(texts))
        cut = pc.split_pattern(texts.filter(pc.invert(unsafe)), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        first = offsets[:-1]
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary
        starts = [np.array(self.ranked.encode_ordinary(x), np.uint32) for x in cut.values.take(pa.array(first)).to_pylist()] if len(first) else []
        # what stands after a blank: one text of all distinct strings, each with its blank
        flat = np.array(self.ranked.encode_ordinary(" " + " ".join(names.to_pylist())) if len(names) else [], np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 1)) + 1 if len(names) else np.empty(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(names) else ends
        n = (ends - begins)[at]
        n[first] = 0  # a text's first string has no blank before it
        end = np.cumsum(n)
        # id k of all texts is id k - (end - n) of its string
        ids = flat[np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32) - np.repeat((end - n - begins[at]).astype(np.int32), n)] if len(at) else flat
        last = np.concatenate([[0], end])[offsets]
        rest = (np.concatenate([head, ids[last[i] : last[i + 1]]]) for i, head in enumerate(starts))
        return [self.whole(t.as_py()) if whole else next(rest) for t, whole in zip(texts, unsafe.to_pylist(), strict=True)]


class Packer:
    """Packs pieces (document, start, ids) into sequences."""

    def __init__(self):
        self.by_size: list[deque] = [deque() for _ in range(LENGTH)]
        self.sizes = 0  # bit k: there are pieces of k tokens
        self.held = 0
        self.out: list[tuple[int, list]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        full = len(ids) // LENGTH * LENGTH
        for a in range(0, full, LENGTH):
            self.out.append((LENGTH, [(doc, a, ids[a : a + LENGTH])]))
        if full < len(ids):
            self._put(doc, full, ids[full:])

    def _put(self, doc, start: int, ids: np.ndarray) -> None:
        self.by_size[len(ids)].append((doc, start, ids))
        self.sizes |= 1 << len(ids)
        self.held += len(ids)

    def _pop(self, size: int) -> tuple:
        q = self.by_size[size]
        x = q.popleft()
        if not q:
            self.sizes &= ~(1 << size)
        self.held -= size
        return x

    def _fill(self, size: int) -> list:
        """One sequence of ``size`` tokens; there are as many."""
        got, gap = [], size
        while gap:
            fits = self.sizes & ((1 << (gap + 1)) - 1)
            if fits:
                x = self._pop(fits.bit_length() - 1)
            else:  # the shortest piece that doesn't fit is cut
                doc, start, ids = self._pop((self.sizes & -self.sizes).bit_length() - 1)
                x = (doc, start, ids[:gap])
                self._put(doc, start + gap, ids[gap:])
            got.append(x)
            gap -= len(x[2])
        return got

    def pack(self, last: bool = False) -> list[tuple[int, list]]:
        """Full sequences (tier, pieces) of what is held, tier by tier; at the end all of it, the last tokens in powers of two."""
        tier = LENGTH
        while tier >= SHORTEST:
            # pieces that are routed here: longer than half of the tier
            while self.held >= tier and (self.sizes >> (tier // 2 + 1 if tier > SHORTEST else 0)):
                self.out.append((tier, self._fill(tier)))
            tier //= 2
        while last and self.held:
            size = min(LENGTH, 1 << (self.held.bit_length() - 1))
            self.out.append((size, self._fill(size)))
        done, self.out = self.out, []
        return done


PIECES = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, tier bigint, task bigint, number bigint, offset bigint"


def pieces(docs: DataFrame, spec: str) -> DataFrame:
    """The pieces of all documents with their sequence (tier, task and its number there) and place in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, counts, task = Encoder(spec), Packer(), {}, TaskContext.get().partitionId()

        def rows(done: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(9)]
            for tier, own in done:
                number, offset = counts.get(tier, 0), 0
                counts[tier] = number + 1
                for (doc_id, total), start, ids in own:
                    for c, v in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, tier, task, number, offset), strict=True):
                        c.append(v)
                    offset += len(ids)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[c.split()[0] for c in PIECES.split(", ")])

        doc_type, end = pa.int64(), np.array([END], np.uint32)
        for batch in batches:
            doc_type = batch.schema.field(0).type
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
                for doc_id, ids in zip(batch.column(0).slice(at, stop - at).to_pylist(), encoder.encode(texts.slice(at, stop - at)), strict=True):
                    ids = np.concatenate([ids, end])
                    packer.add((doc_id, len(ids)), ids)
                    if packer.held >= GATHER or len(packer.out) * LENGTH >= GATHER:
                        yield from rows(packer.pack())
                at = stop
        yield from rows(packer.pack(True))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind))


def pack(docs: DataFrame, spec: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    numbers), doc_tokens (with the end id), sequence_id (from 0, tier by tier), offset (in the sequence, without gaps), tier (the
    sequence's length, always a power of two of LENGTH at most, so that nothing is padded), step_group (of sequences of one tier, STEP tokens
    but for the tier's last one).

    A null or empty text is the end id alone. Rows are packed one by one, repeated ones and those without doc_id too; other columns
    of ``docs`` aren't read; an empty table gives no rows. The pieces depend on how the table is split into tasks; they are
    written once, so a result is consistent whatever is lost later."""
    spark = docs.sparkSession
    made = Scratch(spark, "packing").save(pieces(docs, spec or vocabulary()))
    many = made.groupBy("tier", "task").agg((F.max("number") + 1).alias("_n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row for each task and tier
    tiers = many.groupBy("tier").agg(F.sum("_n").alias("_all"))
    order = Window.orderBy(F.col("tier").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a dozen tiers
    groups = F.ceil(F.col("_all") / F.greatest(F.lit(1), F.floor(F.lit(STEP) / F.col("tier"))))
    tiers = tiers.select(F.col("tier").alias("_t"), F.coalesce(F.sum("_all").over(order), F.lit(0)).alias("_first"), F.coalesce(F.sum(groups).over(order), F.lit(0)).alias("_group"))
    at = broadcast_if_small(Scratch(spark, "packing").save(many.join(F.broadcast(tiers), F.col("tier") == F.col("_t")).select(F.col("tier").alias("_t"), F.col("task").alias("_k"), "_before", "_first", "_group")))
    j = made.join(at, (F.col("tier") == F.col("_t")) & (F.col("task") == F.col("_k")))
    number = F.col("_before") + F.col("number")
    group = F.col("_group") + F.floor(number / F.greatest(F.lit(1), F.floor(F.lit(STEP) / F.col("tier"))))
    return j.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + number).alias("sequence_id"), "offset", "tier", group.cast("bigint").alias("step_group"))
