"""Near-duplicate embeddings by NN-descent.

Tight groups first shrink to balls: a ball's members lie within ``BALL`` degrees of its centre, so all of
them are linked to each other and need no pairs. NN-descent then runs on the centres: neighbour lists,
seeded by sorted random-hyperplane signatures, are refined by comparing neighbours of neighbours; a list
that is full of edges over the threshold (each pair's own, by the radii of its balls) grows with them; a brute-force audit of sampled centres, enlarged until
it meets enough edges, measures recall; more seeds and longer lists follow if it falls short, and at last a
comparison of all centres in blocks. Kept edges between
centres decide by the triangle inequality of angles whether all, none or some members are linked, and
the last are compared in double precision.

References: W. Dong et al., "Efficient k-nearest neighbor graph construction for generic similarity
measures" (2011).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from newsloom.llm.shared import Scratch, components

COSINE = 0.9
#: Largest angle, in degrees, between a ball's centre and a member: twice it stays under the link angle.
BALL = 10.0
#: First length of the neighbour lists; most reverse neighbours that join in a round.
NEIGHBOURS, REVERSE = 6, 12
#: Seeding: signatures, and how many rows after each are compared in their sorted order.
TABLES, AHEAD = 10, 5
ROUNDS, AUDITS = 4, 3
#: Centres compared with all others to measure recall, and the recall asked for.
AUDIT_QUERIES, RECALL = 512, 0.99
#: True edges that the audit must meet, else more centres are compared; most centres that one pass compares with all;
#: values of the hash by which they are taken.
AUDIT_EDGES, BLOCK, PLACES = 200, 4096, 1 << 31
SLACK = 1e-9
#: Rows of a pivot's neighbours that are compared with all of them at a time; edges that a worker gathers before it sends them.
ROWS, SENT = 1024, 200_000


def _reach(limit: float, r1, r2):
    """Least cosine of two centres whose balls, of the radii ``r1`` and ``r2``, can hold members within the angle
    ``limit``; a hair less, for what single precision loses."""
    return np.cos(np.minimum(np.pi, limit + r1 + r2)) - 1e-5


def _over(s: np.ndarray, limit: float, r1: np.ndarray, r2: np.ndarray, more: np.ndarray | None = None):
    """Places of the cosines ``s`` that reach far enough for their pair's radii, or are over ``more`` of their row; and
    which of them reach. Only what would reach the widest ball is looked at by pairs."""
    near = s >= _reach(limit, r1, r2.max())[:, None]
    i, j = np.nonzero(near if more is None else near | (s > more[:, None]))
    hit = s[i, j] >= _reach(limit, r1[i], r2[j])
    keep = hit if more is None else hit | (s[i, j] > more[i])
    return i[keep], j[keep], hit[keep]


def _edge_batch(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["src", "dst", "sim", "hit"])


EDGES = "src long, dst long, sim double, hit boolean"


def _unit(vectors: list, dim: int) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for v in vectors:
        a = None
        if v is not None and len(v) == dim and all(x is not None for x in v):
            a = np.asarray(v, np.float64)
            n = np.linalg.norm(a) if np.isfinite(a).all() else 0.0
            if not np.isfinite(n) and np.isfinite(a).all():  # the squares overflow
                a = a / np.abs(a).max()
                n = np.linalg.norm(a)
            a = a / n if n > 0 else None
        out.append(a)
    return out


def _units(rows: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for b in batches:
            units = _unit(b.column(1).to_pylist(), dim)
            blob = [None if u is None else u.tobytes() for u in units]
            digest = [None if x is None else xxhash.xxh3_128_digest(x) for x in blob]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blob, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "v", "digest"])

    return rows.mapInArrow(run, "vec_id long, v binary, digest binary")


def _matrix(blobs, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", _matrix(a), _matrix(b)) if len(a) else [], dtype="float64")


def _signatures(dim: int, bits: int, seed: int, tables: int = TABLES):
    planes = np.random.default_rng(seed).standard_normal((tables, bits + 1, dim))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1).to_pylist())
            y = np.einsum("tbd,nd->tnb", planes, x)
            sign = ((y[:, :, :bits] > 0) << np.arange(bits)[::-1]).sum(2)
            small = [r.tobytes() for r in x.astype(np.float32)]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(sign[t]), pa.array(y[t, :, bits]), pa.array(ids), pa.array(small, pa.binary()), b.column(2)], names=["t", "sign", "rest", "id", "x", "r"])

    return run, "t int, sign long, rest double, id long, x binary, r double"


def _sorted_neighbours(ahead: int, limit: float):
    """Edges between rows that are near in the sorted order; a partition's rows come in batches."""

    def run(batches):
        keep_t, keep_i, keep_r, keep_x = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), None
        for b in batches:
            if not b.num_rows:
                continue
            t, ids, r, x = b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(5).to_numpy(), _matrix(b.column(4).to_pylist(), np.float32)
            if keep_x is not None:
                t, ids, r, x = np.concatenate([keep_t, t]), np.concatenate([keep_i, ids]), np.concatenate([keep_r, r]), np.concatenate([keep_x, x])
            for k in range(1, min(ahead, len(ids) - 1) + 1):
                same = (t[k:] == t[:-k]) & (ids[k:] != ids[:-k])
                s = np.einsum("ij,ij->i", x[k:], x[:-k]).astype(np.float64)
                a, c, s, hit = ids[:-k][same], ids[k:][same], s[same], s[same] >= _reach(limit, r[:-k], r[k:])[same]
                yield _edge_batch([(a, c, s, hit), (c, a, s, hit)])
            keep_t, keep_i, keep_r, keep_x = t[-ahead:], ids[-ahead:], r[-ahead:], x[-ahead:]

    return run


def _seeds(points: DataFrame, dim: int, bits: int, seed: int, limit: float) -> DataFrame:
    run, schema = _signatures(dim, bits, seed)
    rows = points.select("id", "v", "r").mapInArrow(run, schema)
    n = max(4, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, "t", "sign", "rest").sortWithinPartitions("t", "sign", "rest", "id")
    return rows.mapInArrow(_sorted_neighbours(AHEAD, limit), EDGES)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each source, and beyond them every threshold edge (``hit``): a list that such
    edges saturate is enlarged to hold them all."""
    one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("hit").alias("hit"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst"))
    return one.withColumn("place", place).where((F.col("place") <= k) | F.col("hit"))


def _local_join(limit: float):
    """At every pivot: compares its neighbours with each other where one of the two is new, and
    proposes edges that reach the threshold or would enter a list. Rows come sorted by pivot; a pivot's are
    compared ROWS at a time."""

    def compare(ids, fresh, kth, r, x):
        for k in range(0, len(ids) if len(ids) > 1 else 0, ROWS):
            z = slice(k, k + ROWS)
            s = (x[z] @ x.T).astype(np.float64)
            s[~((fresh[z, None] | fresh[None, :]) & (ids[z, None] != ids[None, :]))] = -3.0
            i, j, hit = _over(s, limit, r[z], r, kth[z])
            yield ids[z][i], ids[j], s[i, j], hit

    def run(batches):
        held, out, n = None, [], 0

        def pivots():
            nonlocal held
            for b in batches:
                if not b.num_rows:
                    continue
                cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5)] + [_matrix(b.column(2).to_pylist(), np.float32)]
                if held is not None:
                    cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1])
                for a, z in zip(starts[:-1], starts[1:], strict=True):
                    yield [c[a:z] for c in cols[1:]]
                held = [c[starts[-1] :] for c in cols]
            if held is not None:
                yield held[1:]

        for pivot in pivots():
            for part in compare(*pivot):
                out.append(part)
                n += len(part[0])
                if n >= SENT:
                    yield _edge_batch(out)
                    out, n = [], 0
        if n:
            yield _edge_batch(out)

    return run


def _descend(lists: DataFrame, small: DataFrame, k: int, limit: float) -> DataFrame:
    """One round: candidate edges from neighbours of neighbours. A pivot is joined by its own list
    and by up to REVERSE of those that list it; threshold edges always join in."""
    back = F.row_number().over(Window.partitionBy("dst").orderBy(F.col("fresh").desc(), F.xxhash64("src", "dst")))
    reverse = lists.withColumn("_r", back).where((F.col("_r") <= REVERSE) | F.col("hit")).select(F.col("dst").alias("pivot"), F.col("src").alias("id"), "fresh")
    forward = lists.select(F.col("src").alias("pivot"), F.col("dst").alias("id"), "fresh")
    kth = lists.where(F.col("place") <= k).groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("kth"))
    sent = small.join(kth.withColumnRenamed("src", "id"), "id", "left").select("id", "x", F.coalesce("kth", F.lit(-2.0)).alias("kth"), "r")
    both = forward.unionByName(reverse).groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
    rows = both.join(sent, "id").select("pivot", "id", "x", "fresh", "kth", "r")
    n = max(4, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "pivot").sortWithinPartitions("pivot")
    return rows.mapInArrow(_local_join(limit), EDGES)


def neighbour_edges(points: DataFrame, limit: float, dim: int, scratch: Scratch, report: dict | None = None) -> DataFrame:
    """Edges ``(src, dst, sim)``, both ways, of ``points(id, v, r)`` whose angle is ``limit`` and both their radii ``r`` or
    less (single precision; a hair over is kept too)."""
    n = points.count()
    bits = max(3, min(30, int(np.ceil(np.log2(max(n, 2) / 8)))))
    small = scratch.save(points.select("id", _narrow("v").alias("x"), "r"))
    exact, place = _audit(points, limit, n, scratch)
    truth = exact.where("hit").select("src", "dst")
    if place >= PLACES and n > AUDIT_QUERIES:  # so few edges that all centres were compared
        if report is not None:
            report |= {"recall": 1.0, "audited_edges": truth.count(), "list_length": 0, "points": n, "exact": True, "edges": exact.count()}
        return exact.select("src", "dst", "sim")
    k, lists, recall = NEIGHBOURS, None, 0.0
    for attempt in range(AUDITS):
        seeds = _seeds(points, dim, bits, 1 + attempt, limit).withColumn("fresh", F.lit(True))
        if lists is not None:
            seeds = seeds.unionByName(lists.select("src", "dst", "sim", "hit", F.lit(False).alias("fresh")))
        lists = scratch.save(_lists(seeds, k))
        for _ in range(ROUNDS):
            before = lists.where("hit").count()
            found = _descend(lists, small, k, limit).withColumn("fresh", F.lit(True))
            old = lists.select("src", "dst", "sim", "hit", F.lit(False).alias("fresh"))
            new = scratch.save(_lists(found.unionByName(old), k))
            scratch.drop(lists)
            lists = new
            if lists.where("hit").count() == before:
                break
        met = truth.join(lists.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
        recall = met.hits / met.n if met.n else 1.0  # without an edge all centres have been compared
        if recall >= RECALL:
            break
        k *= 2
    short = recall < RECALL
    if short:
        while place < PLACES:
            block, place = _block(points, limit, n, place, BLOCK)
            exact = exact.unionByName(scratch.save(block))
    edges = exact if short else lists.where("hit")
    if report is not None:
        report |= {"recall": 1.0 if short else recall, "audited_edges": met.n, "list_length": k, "points": n, "exact": short, "edges": edges.count()}
    return edges.select("src", "dst", "sim")


def _narrow(col: str):
    @F.pandas_udf(BinaryType())
    def f(v: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in _matrix(v).astype(np.float32)] if len(v) else [], dtype=object)

    return f(col)


def _block(points: DataFrame, limit: float, n: int, place: int, rows: int) -> tuple[DataFrame, int]:
    """Edges ``(src, dst, sim, hit)`` that reach the threshold, ``hit`` where single precision can't miss that, from about ``rows`` points, those whose hash is at ``place`` or after,
    to all points, by brute force in double precision; and the place of the next block. So many vectors are
    sent to the workers, whatever the table's size."""
    spark = points.sparkSession
    end = min(PLACES, place + -(-PLACES * rows // max(n, 1)))
    at = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(PLACES))
    queries = points.where((at >= F.lit(place)) & (at < F.lit(end))).select("id", "v", "r").collect()
    sent = spark.sparkContext.broadcast((np.array([q.id for q in queries], np.int64), np.array([q.r for q in queries]), b"".join(bytes(q.v) for q in queries)))

    def run(batches):
        ids, radii, blob = sent.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            q, x, own, r = np.frombuffer(blob).reshape(len(ids), -1), _matrix(b.column(1).to_pylist()), b.column(0).to_numpy(), b.column(2).to_numpy()
            for k in range(0, len(own), ROWS):
                s = q @ x[k : k + ROWS].T
                s[ids[:, None] == own[None, k : k + ROWS]] = -3.0
                i, j, _ = _over(s, limit, radii, r[k : k + ROWS])
                yield _edge_batch([(ids[i], own[k + j], s[i, j], s[i, j] >= _reach(limit, radii[i], r[k + j]) + 2e-5)])

    return points.select("id", "v", "r").mapInArrow(run, EDGES), end


def _audit(points: DataFrame, limit: float, n: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Edges of a hashed sample of points, by brute force, and the place where the sample ends: AUDIT_QUERIES points,
    and more until they have AUDIT_EDGES edges or all points are in."""
    out, place, rows = None, 0, AUDIT_QUERIES
    while True:
        block, place = _block(points, limit, n, place, rows)
        block = scratch.save(block)
        out = block if out is None else out.unionByName(block)
        if place >= PLACES or out.where("hit").count() >= AUDIT_EDGES:
            return out, place
        rows = min(2 * rows, BLOCK)


def balls(points: DataFrame, dim: int, scratch: Scratch, degrees: float = BALL) -> DataFrame:
    """``(id, centre, cos)`` for every point. Sorted signatures propose pairs; points are taken in the order
    of a hash: one with no earlier neighbour left in the race becomes a centre, one near a centre joins
    the nearest. Those undecided after four rounds are centres of their own, which costs time, not
    results."""
    least = float(np.cos(np.radians(degrees)))
    n = points.count()
    bits = max(3, min(30, int(np.ceil(np.log2(max(n, 2) / 8)))))
    run, schema = _signatures(dim, bits, 0, 4)
    rank = lambda c: F.xxhash64(c, F.lit(5))
    rows = points.select("id", "v", F.lit(0.0).alias("r")).mapInArrow(run, schema)
    lead = rows.groupBy("t", "sign").agg(F.min(F.struct(rank("id").alias("h"), "id")).alias("m")).select("t", "sign", F.col("m.id").alias("to"))
    pairs = rows.select("t", "sign", "id").join(lead, ["t", "sign"]).where("id <> to").select("id", "to").distinct()
    v = points.select("id", "v")
    near = pairs.join(v, "id").join(v.select(F.col("id").alias("to"), F.col("v").alias("w")), "to")
    near = scratch.save(near.select("id", "to", cosine("v", "w").alias("cos")).where(F.col("cos") >= least))
    taken, centres, open_ = None, None, near
    for _ in range(4):
        if open_.isEmpty():
            break
        waiting = open_.select("id").distinct()
        # a centre: proposed, and itself with no proposal that is still open
        new = open_.select(F.col("to").alias("id")).distinct().join(waiting, "id", "left_anti")
        if taken is not None:
            new = new.join(taken.select("id"), "id", "left_anti")
        centres = new if centres is None else centres.unionByName(new).distinct()
        centres = scratch.save(centres)
        joined = open_.join(centres.withColumnRenamed("id", "to"), "to", "left_semi")
        joined = joined.groupBy("id").agg(F.max(F.struct("cos", "to")).alias("b")).select("id", F.col("b.to").alias("centre"), F.col("b.cos").alias("cos"))
        taken = scratch.save(joined if taken is None else taken.unionByName(joined))
        open_ = scratch.save(open_.join(taken.select("id"), "id", "left_anti").join(taken.select(F.col("id").alias("to")), "to", "left_anti"))
    own = points.select("id")
    if taken is None:
        return own.select("id", F.col("id").alias("centre"), F.lit(1.0).alias("cos"))
    rest = own.join(taken.select("id"), "id", "left_anti").select("id", F.col("id").alias("centre"), F.lit(1.0).alias("cos"))
    return scratch.save(taken.unionByName(rest))


def near_embeddings(vectors: DataFrame, threshold: float = COSINE, scratch: Scratch | None = None, report: dict | None = None) -> DataFrame:
    """One row for each row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Vectors are linked if the cosine of their embeddings, in double precision, is at least ``threshold``; n_links counts
    rows. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Those of
    different lengths have no cosine: each length is compared in itself, one after the other (a run for each length that
    occurs). Rows that repeat a vec_id are vectors of their own, with equal embeddings or not; so are rows without vec_id:
    their component_id is the smallest vec_id that they reach, null if there is none, in which case they are kept. An
    empty table gives an empty result; other columns aren't read. Equal vectors form one class before all else. ``report``
    receives the audit's recall, the number of edges between centres, and whether all centres were compared (of the last length).
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    size = F.coalesce(F.size("embedding"), F.lit(0))
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = alone(rows.where(size <= 0))
    for r in rows.where(size > 0).select(size.alias("d")).distinct().orderBy("d").collect():
        units = scratch.save(_units(rows.where(size == r.d), r.d))
        valid = units.where("v is not null")
        out = out.unionByName(alone(units.where("v is null")))
        if not valid.isEmpty():
            out = out.unionByName(_of_one_length(valid, r.d, threshold, scratch, report))
    return out


def _of_one_length(valid: DataFrame, dim: int, threshold: float, scratch: Scratch, report: dict | None) -> DataFrame:
    """The answer for unit vectors ``valid(vec_id, v, digest)`` of ``dim`` components."""
    classes = valid.groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"), F.first("v").alias("v"))
    # a number for each class, which doesn't depend on vec_ids: these can repeat or be null
    classes = scratch.save(classes.sortWithinPartitions("digest").withColumn("id", F.monotonically_increasing_id()))
    points = classes.select("id", "m", "v")
    ball = balls(points, dim, scratch)
    members = scratch.save(ball.join(points, "id"))
    size = members.groupBy("centre").agg(F.sum("m").alias("ball_m"), F.min("cos").alias("r"))
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    size = scratch.save(size.select("centre", "ball_m", angle(F.col("r")).alias("radius")))
    centres = scratch.save(points.join(size.select(F.col("centre").alias("id"), F.col("radius").alias("r")), "id").select("id", "v", "r"))
    limit = float(np.arccos(threshold))
    edges = neighbour_edges(centres, limit, dim, scratch, report)
    radius = size.select(F.col("centre").alias("src"), F.col("radius").alias("r1")), size.select(F.col("centre").alias("dst"), F.col("radius").alias("r2"), F.col("ball_m").alias("m2"))
    edges = edges.join(radius[0], "src").join(radius[1], "dst")
    edges = scratch.save(edges.where(angle(F.col("sim")) <= limit + F.col("r1") + F.col("r2") + 1e-3).select("src", "dst", "r2", "m2"))
    # members against the other centre: all of its ball, none of it, or each on its own
    met = members.select("id", "centre", F.col("v").alias("_v")).join(edges, F.col("centre") == F.col("src")).join(centres.select(F.col("id").alias("dst"), F.col("v").alias("_w")), "dst")
    met = met.select("id", "src", "dst", "r2", "m2", "_v", cosine("_v", "_w").alias("c"))
    met = scratch.save(met.withColumn("a", angle(F.col("c"))).where((F.col("a") - F.col("r2")) <= limit + SLACK).drop("c"))
    everything = (F.col("r2") > 0) & (F.col("a") + F.col("r2") <= limit - SLACK)
    sure = met.where(everything).select("id", "src", "dst", F.col("m2").alias("n"))
    each = met.where(~everything).join(members.select(F.col("centre").alias("dst"), F.col("m").alias("my"), F.col("v").alias("_y")), "dst")
    some = each.select("id", "src", "dst", "my", cosine("_v", "_y").alias("c")).where(F.col("c") >= threshold).groupBy("id", "src", "dst").agg(F.sum("my").alias("n"))
    linked = scratch.save(sure.unionByName(some))
    more = linked.groupBy("id").agg(F.sum("n").alias("more"))
    parts = components(linked.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch).select(F.col("id").alias("centre"), F.col("component").alias("part"))
    per = members.select("id", "centre", "m").join(size.select("centre", "ball_m"), "centre").join(more, "id", "left").join(parts, "centre", "left")
    per = scratch.save(per.select("id", F.coalesce("part", "centre").alias("part"), (F.col("ball_m") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links")))
    per = per.join(classes.select("id", "digest", "low"), "id")
    lowest = per.groupBy("part").agg(F.min("low").alias("component_id"))
    per = per.join(lowest, "part").select("digest", "n_links", "component_id")
    return valid.select("vec_id", "digest").join(per, "digest").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
