"""MinHash-style near-duplicates from SetSketch registers.

A document's five-word shingles fill 127 SetSketch registers: per register the smallest of
exponentially spaced, truncated variates, kept as its floor on a logarithmic scale. Sketches of
parts merge by the maximum register. Runs of five registers are the bands; documents that agree in a
band are candidates. A candidate's similarity is first estimated from its registers, jointly by
likelihood, and is confirmed on the full shingle sets.

Reference: O. Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog" (2021).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import Scratch, broadcast_if_small, by_key, components, partitions

SHINGLE = 5
THRESHOLD = 85  # per cent
#: At similarity 0.85 a pair misses all bands with probability 4e-7, at 0.8 with 5e-5.
REGISTERS, BANDS, ROWS = 127, 25, 5
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Pairs whose estimate is so many standard errors under the threshold aren't looked up in full: by the binomial
#: distribution of equal registers, 3e-7 of the pairs right at the threshold.
MARGIN = 5.5
#: A worker's word cache is emptied at this many words.
CACHE_WORDS = 200_000
#: Members of a bucket that one task compares with as many others: sketches alone, and with full sets.
SKETCH_BLOCK, SET_BLOCK = 2048, 512

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text. Words are runs of characters
    other than the six ASCII blanks, A-Z lower-cased; bytes.lower and bytes.split do just that."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


_GAMMA = np.append(np.log1p(np.arange(REGISTERS) / (REGISTERS - np.arange(REGISTERS))) / RATE, np.inf)


def registers(items: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch of hashed items with m (a prime) registers: the j-th variate of an item is
    exponential, truncated to the j-th of m intervals of equal probability, and goes to the j-th
    register of the item's own order; later intervals can't lower a register once all lie below."""
    low = np.full(m, np.inf)
    first, step = items % _U(m), _U(1) + (items >> _U(32)) % _U(m - 1)
    for j in range(m):
        start, end = _GAMMA[j], _GAMMA[j + 1]
        if low.max() <= start:
            break
        u = ((_mix(items + _U((j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) >> _U(11)) + _U(1)).astype(np.float64) * 2.0**-53
        x = start - np.log1p(-u * -np.expm1(-RATE * (end - start))) / RATE if j < m - 1 else start - np.log(u) / RATE
        np.minimum.at(low, ((first + _U(j) * step) % _U(m)).astype(np.intp), x)
    return np.clip(np.floor(1.0 - np.log(low) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    bands = regs[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + bands[:, k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 30) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketched pairs (rows of a and b), given set sizes.

    With u = na/(na+nb) and v = nb/(na+nb) a register of a is the larger with probability p(u - v J),
    that of b with p(v - u J), p(x) = -log_B(1 - x (B-1)/B); the likelihood of the three counts is
    concave in J, and its slope is bisected.
    """
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - above - below
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * c) / np.log(BASE)
    slope = lambda x: c / (1 - np.maximum(x, 1e-12) * c) / np.log(BASE)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        j = (lo + hi) / 2
        x, y = u - v * j, v - u * j
        px, py = p(x), p(y)
        d = -above * v * slope(x) / px - below * u * slope(y) / py + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - px - py, 1e-12)
        lo, hi = np.where(d > 0, j, lo), np.where(d > 0, hi, j)
    return (lo + hi) / 2


def sketch(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, text replaced by n_shingles, digest (of the whole set; null if empty) and regs."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    at = docs.columns.index("text")

    def run(batches):
        words = _Words()
        for batch in batches:
            n, digest, regs = [], [], []
            for text in batch.column(at):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            new = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *new], names=[*[f.name for f in kept], "n_shingles", "digest", "regs"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    return docs.mapInArrow(run, f"{schema}n_shingles long, digest binary, regs binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node (digest of the set) and the sorted distinct shingle hashes of each row's text."""

    def run(batches):
        words = _Words()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select("text").mapInArrow(run, "node binary, items array<long>")


def _matrix(column, kind=np.uint16) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _keyed(classes: DataFrame) -> DataFrame:
    """(bucket, band, node): 25 rows a sketch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = np.stack([band_keys(r) for r in _matrix(b.column(1))])
                take = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), b.column(0).take(take)], names=["bucket", "band", "node"])

    return classes.select("node", "regs").mapInArrow(run, "bucket long, band int, node binary")


def _floor(share: float) -> float:
    return float(share - MARGIN * np.sqrt(share * (1 - share) / REGISTERS))


def _likely(same: np.ndarray, x, y, nx, ny, band, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mask of pairs (rows of x and y, whose equal registers are ``same``) that neither sizes nor registers rule out and
    whose first common band is ``band``; and the estimates of these. A pair so meets once, in one of its buckets."""
    least = _floor(share)
    ok = (same.sum(1) >= REGISTERS * least - 4) & ((1 + share) * np.minimum(nx, ny) >= share * (nx + ny) - 1e-6)
    at = np.flatnonzero(ok)
    first = same[at, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2).argmax(1)
    at = at[first == np.broadcast_to(band, ok.shape)[at]]
    est = estimate(x[at], y[at], nx[at].astype(float), ny[at].astype(float)) if len(at) else np.empty(0)
    return at[est >= least], est[est >= least]


def _star(rows: DataFrame, threshold: int) -> DataFrame:
    """Of rows (band, node, n, regs, leader, ln, lregs) the likely pairs (a, b)."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = _matrix(t.column(3)), _matrix(t.column(6))
                nx, ny, band = (t.column(k).to_numpy() for k in (2, 5, 0))
                at, _ = _likely(x == y, x, y, nx, ny, band, threshold / 100)
                yield pa.RecordBatch.from_arrays([t.column(1).take(pa.array(at)), t.column(4).take(pa.array(at))], names=["a", "b"])

    return rows.select("band", "node", "n", "regs", "leader", "ln", "lregs").mapInArrow(run, "a binary, b binary")


def _block_pairs(regs, n, band: int, label, side, share: float, tile: int = 64):
    """(i, j, estimate) of the likely pairs with different labels: all of one block, or across two sides."""
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    whole = side.min() == side.max()
    for k in range(0, len(left), tile):
        i = left[k : k + tile]
        same = regs[i][:, None, :] == regs[right][None, :, :]
        open_ = label[i][:, None] != label[right][None, :]
        if whole:
            open_ &= i[:, None] < right[None, :]
        p, q = np.nonzero(open_ & (same.sum(2) >= REGISTERS * _floor(share) - 4))
        at, est = _likely(same[p, q], regs[i[p]], regs[right[q]], n[i[p]], n[right[q]], band, share)
        if len(at):
            yield i[p[at]], right[q[at]], est


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """Deals members(bucket, ...) out to tasks so that any two of a bucket meet in one: a bucket is cut into blocks of
    about ``size`` rows, and each pair of blocks is a group (bucket, lo, hi) of its own; side is the row's block."""
    count = members.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    rows = members.join(count, "bucket").withColumn("side", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumns({"lo": F.least("side", "_o"), "hi": F.greatest("side", "_o")}).drop("_n", "_o")
    return rows.repartition(partitions(rows), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _with_likely_partner(rows: DataFrame, threshold: int) -> DataFrame:
    """(bucket, band, node) of the members that some other member of the bucket may link with."""

    def run(batches):
        for keys, t in by_key(batches, 3):
            regs, n, side = _matrix(t.column("regs")), t.column("n").to_numpy(), t.column("side").to_numpy()
            label, band, hit = np.array(t.column("label").to_pylist(), object), t.column("band")[0].as_py(), np.zeros(t.num_rows, bool)
            for i, j, _ in _block_pairs(regs, n, band, label, side, threshold / 100):
                hit[i] = hit[j] = True
            if hit.any():
                node = t.column("node").filter(pa.array(hit)).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), keys[0])), pa.array(np.full(len(node), band, np.int32)), node], names=["bucket", "band", "node"])

    return rows.select("bucket", "lo", "hi", "side", "band", "node", "label", "n", "regs").mapInArrow(run, "bucket long, band int, node binary")


def _linked(rows: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) between members whose full sets reach the threshold, as few as join what they join."""

    def run(batches):
        for _, t in by_key(batches, 3):
            regs, n, side = _matrix(t.column("regs")), t.column("n").to_numpy(), t.column("side").to_numpy()
            names, label, band = t.column("node").to_pylist(), np.array(t.column("label").to_pylist(), object), t.column("band")[0].as_py()
            sets = [np.asarray(x.values) for x in t.column("items")]
            pairs = [(e, i, j) for p, q, est in _block_pairs(regs, n, band, label, side, threshold / 100) for e, i, j in zip(est, p, q, strict=True)]
            up = {x: x for x in label}

            def root(x, up=up):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            edges = []
            for _, i, j in sorted(pairs, key=lambda p: -p[0]):
                a, b = root(label[i]), root(label[j])
                if a != b:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                        up[a] = b
                        edges.append((names[i], names[j]))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.select("bucket", "lo", "hi", "side", "band", "node", "label", "n", "regs", "items").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The shingle sets of ``nodes``, one row each, cut again from one text of each class; sets are never kept for the
    whole corpus."""
    wanted = scratch.save(classes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "row_key"))
    keys = broadcast_if_small(wanted.select("row_key"))
    sets = shingle_sets(docs.join(keys, "row_key", "left_semi"))
    return scratch.save(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def links(docs: DataFrame, classes: DataFrame, threshold: int, scratch: Scratch) -> DataFrame | None:
    """Edges (a, b) that join the classes as all links over the threshold do; None without any candidate."""
    keyed = _keyed(classes)
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = scratch.save(keyed.join(sizes, "bucket"))
    if buckets.isEmpty():
        return None
    fame = buckets.groupBy("node").agg(F.sum("members").alias("fame"))
    state = scratch.save(buckets.drop("members").join(classes.select("node", "n", "regs"), "node").join(fame, "node"))
    scratch.drop(buckets)
    lead = state.groupBy("bucket").agg(F.max(F.struct("fame", "node", "n", "regs")).alias("l"))
    met = state.join(lead, "bucket").where("node <> l.node").select("band", "node", "n", "regs", F.col("l.node").alias("leader"), F.col("l.n").alias("ln"), F.col("l.regs").alias("lregs"))
    pairs = scratch.save(_star(met, threshold))
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), scratch)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
    both = both.select("a", "b", F.size("ia").alias("na"), F.size("ib").alias("nb"), F.size(F.array_intersect("ia", "ib")).alias("common"))
    edges = scratch.save(both.where(100 * F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))
    scratch.drop(pairs, sets)
    # what a class is joined with so far: the smallest of its partners, then that one's own
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = scratch.save(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    label = near.join(near.select(F.col("a").alias("m"), F.col("m").alias("m2")), "m", "left").select(F.col("a").alias("node"), F.coalesce("m2", "m").alias("label"))
    marked = state.drop("fame").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    members = scratch.save(marked.join(open_, "bucket", "left_semi"))
    left = scratch.save(_with_likely_partner(_blocks(members, SKETCH_BLOCK), threshold).distinct())
    scratch.drop(state, near)
    if not left.isEmpty():
        full = left.join(members.select("bucket", "node", "label", "n", "regs"), ["bucket", "node"]).join(_sets(docs, classes, left, scratch), "node")
        edges = edges.unionByName(scratch.save(_linked(_blocks(full, SET_BLOCK), threshold)))
    scratch.drop(members, left)
    return edges


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept; and row_key, a hash of doc_id and text,
    and group, the same for all rows of a component (null for rows without shingles).

    Documents are linked if 100 * intersection >= threshold * union of their shingle sets. A text of
    fewer than five words is one shingle; null, empty and blank texts have none and link with nothing
    (component_id = doc_id, kept). Rows that repeat a doc_id are documents of their own, whatever their texts. A row
    without doc_id is compared like any other; component_id is the smallest doc_id that it reaches, null if there is
    none, and it is kept in that case. Other columns aren't read; an empty table gives an empty result.

    Equal sets become one class first, so exact copies cost nothing further. A band's bucket isn't
    expanded into pairs: each member first meets the bucket's leader, the member whose buckets hold most
    documents (a group's hub). What that leaves in several components is compared in blocks, sketches first; members
    without a likely partner go, the others bring their full sets. No link found by a band is lost. A bucket of m members
    that stay apart costs m * m / 2 comparisons of sketches, spread over tasks of bounded size.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "setsketch")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    every = scratch.save(sketch(docs))
    one = every.where("n_shingles > 0").groupBy(F.col("digest").alias("node"))
    classes = scratch.save(one.agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("regs").alias("regs"), F.min("row_key").alias("row_key")))
    edges = links(docs, classes, threshold, scratch)
    group = classes.select("node", "rep").withColumn("group", F.col("node"))
    if edges is not None and not edges.isEmpty():
        part = scratch.save(components(edges, scratch).select(F.col("id").alias("node"), "component"))
        low = part.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
        part = part.join(low, "component")
        group = group.drop("group").join(part, "node", "left").select("node", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("low")).alias("rep"), F.coalesce("component", "node").alias("group"))
    rows = every.select("doc_id", "n_shingles", "row_key", "digest").join(group.withColumnRenamed("node", "digest"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("rep"))
    rows = rows.withColumn("component_id", component)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key", "group")
