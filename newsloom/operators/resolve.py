"""Duplicate resolution and event clusters.

Both are greedy: rows in the order of (published, created, id) lead unless an earlier leader matches them. Rows that match
by an equal key, and rows of two alike texts, are never paired: rows that share keys are read in their order, once, with the last
leader of each key at hand."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.functions.scratch import Scratch, written
from newsloom.operators.graph import components

DAYS, NEAR = 3, 0.9
CLUSTER = 0.65


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


DAY = 86_400_000_000
#: A task forgets keys that no later row can match once it knows so many.
KNOWN = 100_000


def _parts(same: DataFrame, alike: DataFrame | None, spans: tuple[int, int]) -> DataFrame:
    """(id, at, place, keys): the keys of each row, with side (of ``same`` keys -1), span, kind and score; and the component of keys that rows share."""
    cols = ["key", "side", "span", "kind", "score", "id", "at", "place"]
    rows = same.withColumn("side", F.lit(-1)).withColumn("span", F.lit(spans[0]).cast("long")).select(cols)
    if alike is not None:
        rows = rows.unionByName(alike.withColumn("span", F.lit(spans[1]).cast("long")).select(cols))
    each = rows.groupBy("id").agg(F.first("at").alias("at"), F.first("place").alias("place"), F.collect_set(F.struct("key", F.col("side").cast("int").alias("side"), "span", F.col("kind").cast("int").alias("kind"), F.col("score").cast("double").alias("score"))).alias("keys"))
    scratch = Scratch(same.sparkSession, "leaders")
    each = scratch.save(each.withColumn("_first", F.array_min(F.transform("keys", lambda k: k.key))))
    edges = each.select(F.col("_first").alias("a"), F.explode(F.array_distinct(F.transform("keys", lambda k: k.key))).alias("b")).where("a <> b").distinct()
    part = components(edges, scratch)
    return each.join(part, F.col("_first") == part.id, "left").select(each.id, "at", "place", "keys", F.coalesce("component", "_first").alias("part"))


def _folded(rows: DataFrame, order: list, fold, columns: str) -> DataFrame:
    """``rows`` sorted by part and ``order`` within partitions, each part read in that order by a ``fold()`` of its own: its
    ``row(id, at, keys, stored)`` takes one row, ``rest()`` gives what is to be returned, and ``ready()`` what can be already."""
    id_type = rows.schema["id"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, None

        def batch(done: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            if done:
                types = [kind, kind, pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), types, strict=True)], names=names)

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            done: list[tuple] = []
            for i, at, keys, own, stored in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if state is None or own != part:
                    done += state.rest() if state is not None else []
                    part, state = own, fold()
                state.row(i, at, keys, stored)
            done += state.ready() if state is not None else []
            yield from batch(done, kind)
        if state is not None:
            yield from batch(state.rest(), kind)

    by = rows.repartition("part").sortWithinPartitions("part", *order).select("id", "at", "keys", "part", "stored")
    return by.mapInArrow(run, columns.format(id=id_type))


class Leaders:
    """Rows in the order of place. Rows of one key lead only where they are further apart than its span, so that of each key
    (and side) the last leader is all that a later row can match."""

    def __init__(self):
        self.last: dict[tuple, tuple] = {}
        self.n, self.done = 0, []

    def row(self, i, at, keys, stored) -> None:
        best = None
        for k in keys:
            x = self.last.get((k["key"], 1 - k["side"] if k["side"] >= 0 else -1))
            if x is not None and at - x[0] <= k["span"]:
                found = (k["kind"], -k["score"], x[1], x[2])
                best = found if best is None or found < best else best
        if best is None:
            self.n += 1
            for k in keys:
                self.last[k["key"], k["side"]] = (at, self.n, i)
            if len(self.last) > KNOWN and self.n % KNOWN == 0:
                self.last = {k: x for k, x in self.last.items() if at - x[0] <= DAYS * DAY}
        else:
            self.done.append((i, best[3], best[0], -best[1]))

    def ready(self) -> list[tuple]:
        done, self.done = self.done, []
        return done

    rest = ready


FOLLOWS = "id {id}, leader_id {id}, kind int, score double"


def leaders(nodes: DataFrame, same: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """Greedy leader assignment: ``nodes(id, place)`` in the order of place; a node leads unless an earlier leader
    matches it, else it follows its best. Nodes of one key of ``same(key, kind, score, id, at, place)`` match within DAYS; of
    ``alike(key, side, kind, score, id, at, place)`` those of different sides match within a day. The best leader has the smallest
    kind, then the largest score, then the earliest place. Returns (id, leader_id, kind, score); leaders have nulls for the last two.

    No pair is formed. Nodes that share keys, directly or through others, are one component; it is sorted by place within a
    partition and read once, with the last leader of each key at hand. So the number of jobs doesn't depend on the time that a
    text keeps returning, and a task's memory is that of the keys of DAYS days; a component of copies is one task's stream."""
    rows = _parts(same, alike, (DAYS * DAY, DAY)).withColumn("stored", F.lit(None).cast("boolean"))
    best = _folded(rows, ["place"], Leaders, FOLLOWS)
    out = nodes.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("leader_id", "id").alias("leader_id"), "kind", "score")


KINDS = ["SOURCE_EXTERNAL_ID", "CANONICAL_URL", "EXACT_CONTENT_HASH", "NORMALIZED_FINGERPRINT", "NEAR_EXACT"]


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key another row has too."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "key", "left_semi")


def same_keys(c: DataFrame) -> DataFrame:
    """(key, kind, score, id, at, place): what two rows must share to match with score 1: source and external id, URL, content
    hash, or invariants and fingerprint."""
    keys = [("source_id", "external_id"), ("url",), ("content_hash",), ("inv_key", "fp")]
    one = lambda k, cols: F.when(F.concat(*[F.col(x).isNull().cast("string") for x in cols]).contains("true"), None).otherwise(F.struct(F.md5(F.concat_ws("\u0001", F.lit(k), *cols)).alias("key"), F.lit(k).alias("kind")))
    rows = c.select("id", "place", F.unix_micros("published_at").alias("at"), F.explode(F.array_compact(F.array(*[one(k, cols) for k, cols in enumerate(keys)]))).alias("k"))
    return _shared(rows.select("k.key", "k.kind", F.lit(1.0).alias("score"), "id", "at", "place"))


def near_texts(c: DataFrame) -> DataFrame:
    """(a, b, score, days): fingerprints with equal invariants whose token sets have a Jaccard similarity of NEAR or more, among
    those that have rows within a day of each other; ``days`` are those that both have rows on, or on the day before. Equal fingerprints are one text here, whatever their number. Only texts
    that share a token of their prefixes meet: of n tokens, in a fixed order with long (rare) ones first, the first
    n - ceil(NEAR * n) + 1."""
    t_ = written(c.where(F.size("token_set") > 0).select(F.md5(F.concat_ws("\u0001", "inv_key", "fp")).alias("text"), "inv_key", "token_set", F.to_date("published_at").alias("day")))
    texts = t_.groupBy("text").agg(F.first("token_set").alias("token_set"), F.first("inv_key").alias("inv_key"))
    n = F.size("token_set")
    order = F.transform(F.array_sort(F.transform("token_set", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), lambda s: s.x)
    prefix = texts.select("text", "inv_key", n.alias("n"), F.explode(F.slice(order, F.lit(1), (n - F.ceil(n * NEAR - 1e-9) + 1).cast("int"))).alias("token"))
    days = t_.select("text", F.explode(F.array("day", F.date_add("day", 1))).alias("day")).distinct()
    keyed = prefix.join(days, "text")
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.inv_key") == F.col("b.inv_key")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.text") < F.col("b.text"))
    fits = (F.col("a.n") >= NEAR * F.col("b.n") - 1e-9) & (F.col("b.n") >= NEAR * F.col("a.n") - 1e-9)
    pairs = a.join(b, on & fits).groupBy(F.col("a.text").alias("a"), F.col("b.text").alias("b")).agg(F.collect_set("a.day").alias("days"))
    sets = texts.select("text", "token_set")
    both = pairs.join(sets.select(F.col("text").alias("a"), F.col("token_set").alias("sa")), "a").join(sets.select(F.col("text").alias("b"), F.col("token_set").alias("sb")), "b")
    return both.withColumn("score", jaccard(F.col("sa"), F.col("sb"))).where(F.col("score") >= NEAR).select("a", "b", "score", "days")


def near_keys(c: DataFrame) -> DataFrame:
    """(key, side, kind, score, id, at, place): the rows of two alike texts, on either side, where the other text has rows within
    a day: a text that returns all the time and has many variants doesn't have them all in each of its rows."""
    near = written(near_texts(c))
    key = F.md5(F.concat("a", "b"))
    side = lambda k, text: near.select(key.alias("key"), F.lit(k).alias("side"), F.col(text).alias("text"), "score", F.explode("days").alias("day"))
    day = F.to_date("published_at")
    rows = c.select("id", "place", F.unix_micros("published_at").alias("at"), F.md5(F.concat_ws("\u0001", "inv_key", "fp")).alias("text"), F.explode(F.array(day, F.date_add(day, 1))).alias("day"))
    return side(0, "a").unionByName(side(1, "b")).join(rows, ["text", "day"]).select("key", "side", F.lit(4).alias("kind"), "score", "id", "at", "place")


def _features(contents: DataFrame, form: bool) -> DataFrame:
    both = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    order = F.struct("published_at", "created_at", "id")
    more = [c for c in ("arrival", "stored") if c in contents.columns]
    return contents.withColumn("fp", t.fingerprint(both, form)).select(
        "id", order.alias("place"), "source_id", "external_id", "url", "published_at", t.semantic_hash(F.col("title"), F.col("content"), form).alias("content_hash"),
        "fp", t.token_set(F.col("fp"), 2).alias("token_set"), F.sha2(F.array_join(t.invariants(both), "\u0001"), 256).alias("inv_key"), *more,
    )


def _named(kind) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def resolve_duplicates(contents: DataFrame, form: bool = True) -> DataFrame:
    """(id, duplicate_of_id, duplicate_kind, duplicate_score): every row of
    ``contents(id, source_id, external_id, url, title, content, published_at, created_at)`` with its survivor, the
    earliest by (published, created, id); survivors have nulls. Rows are kept. The result is that of rows
    arriving in that order."""
    c = written(_features(contents, form))
    out = leaders(c.select("id", "place"), same_keys(c), near_keys(c))
    follows = F.col("leader_id") != F.col("id")
    return out.select("id", F.when(follows, F.col("leader_id")).alias("duplicate_of_id"), F.when(follows, _named(F.col("kind"))).alias("duplicate_kind"), F.when(follows, F.col("score")).alias("duplicate_score"))


#: The time of a survivor.
TIME = itemgetter(0)


class Arrivals:
    """Rows in the order of arrival, stored survivors first. An arrival is compared with the survivors of its keys that its span reaches,
    before and after it: of it and its best match the earlier one survives, and the other one's followers become its own."""

    def __init__(self):
        self.survivors: dict[tuple, list] = {}  # of each key and side, by time: (at, place, id)
        self.keys: dict = {}
        self.now: dict = {}  # of those that don't survive: (survivor, kind, score)

    def _lead(self, i, at, keys, place) -> None:
        self.keys[i] = (at, keys)
        for k in keys:
            insort(self.survivors.setdefault((k["key"], k["side"]), []), (at, place, i), key=TIME)

    def _follow(self, i, leader, kind, score) -> None:
        at, keys = self.keys.pop(i, (None, ()))
        for k in keys:
            own = self.survivors[k["key"], k["side"]]
            n = bisect_left(own, at, key=TIME)
            while own[n][2] != i:
                n += 1
            del own[n]
        self.now[i] = (leader, kind, score)

    def row(self, i, at, keys, stored) -> None:
        place = tuple(stored["place"].values())
        if stored["old"]:
            self._lead(i, at, keys, place)
            return
        best = None
        for k in keys:
            others = self.survivors.get((k["key"], 1 - k["side"] if k["side"] >= 0 else -1), [])
            for n in range(bisect_left(others, at - k["span"], key=TIME), bisect_right(others, at + k["span"], key=TIME)):
                _, other, j = others[n]
                if j != i:
                    found = (k["kind"], -k["score"], other, j)
                    best = found if best is None or found[:3] < best[:3] else best
        if best is None:
            self._lead(i, at, keys, place)
        elif best[2] <= place:
            self._follow(i, best[3], best[0], -best[1])
        else:
            self._lead(i, at, keys, place)
            self._follow(best[3], i, best[0], -best[1])

    def ready(self) -> list[tuple]:
        return []

    def rest(self) -> list[tuple]:
        def root(i):
            while i in self.now:
                i = self.now[i][0]
            return i

        return [(i, root(leader), kind, score) for i, (leader, kind, score) in self.now.items()]


def resolve_arrivals(stored: DataFrame, batch: DataFrame, form: bool = True) -> DataFrame:
    """(id, duplicate_of_id, duplicate_kind, duplicate_score) of all rows of ``stored(id, source_id, external_id, url, title, content,
    published_at, created_at, duplicate_of_id, duplicate_kind, duplicate_score)`` and ``batch(the same but the last three, arrival)``, after
    the batch's rows have come one after the other in the order of arrival, then id.

    An arrival meets the survivors within DAYS of it on either side, earlier or later ones. Its best match has the smallest kind,
    then the largest score, then the earliest place; of the two the one with the smaller (published, created, id) survives. A stored survivor that a
    late arrival comes before follows it from then on, and its followers do too, with the kind and score that they had. In the order of
    place the result is that of ``resolve_duplicates``. Only survivors near the batch in time are read, none of their followers."""
    cols = ["id", "source_id", "external_id", "url", "title", "content", "published_at", "created_at"]
    batch = written(batch)
    ends = batch.agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi")).first()
    near = stored.where("duplicate_of_id is null")
    if ends.lo is not None:
        near = near.where(F.col("published_at").between(F.lit(ends.lo) - F.expr(f"interval {DAYS} days"), F.lit(ends.hi) + F.expr(f"interval {DAYS} days")))
    rows = near.select(*cols, F.lit(None).cast("long").alias("arrival"), F.lit(True).alias("stored")).unionByName(batch.select(*cols, F.col("arrival").cast("long").alias("arrival"), F.lit(False).alias("stored")))
    c = written(_features(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id"), form))  # a batch can lie in few files
    parts = _parts(same_keys(c), near_keys(c), (DAYS * DAY, DAY)).join(c.select("id", "arrival", F.col("stored").alias("old")), "id")
    rank = F.struct(F.unix_micros("place.published_at").alias("p"), F.unix_micros("place.created_at").alias("c"), F.col("place.id").alias("i"))
    parts = parts.withColumn("stored", F.struct("old", rank.alias("place")))
    moved = written(_folded(parts, [F.col("arrival").asc_nulls_first(), "id"], Arrivals, FOLLOWS))
    every = stored.select("id", "duplicate_of_id", "duplicate_kind", "duplicate_score").unionByName(batch.select("id", F.lit(None).cast(stored.schema["duplicate_of_id"].dataType).alias("duplicate_of_id"), F.lit(None).cast("string").alias("duplicate_kind"), F.lit(None).cast("double").alias("duplicate_score")))
    own = moved.select("id", F.col("leader_id").alias("_l"), _named(F.col("kind")).alias("_k"), F.col("score").alias("_s"))
    again = moved.select(F.col("id").alias("duplicate_of_id"), F.col("leader_id").alias("_again"))
    j = every.join(own, "id", "left").join(again, "duplicate_of_id", "left")
    return j.select("id", F.coalesce("_l", "_again", "duplicate_of_id").alias("duplicate_of_id"), F.coalesce("_k", "duplicate_kind").alias("duplicate_kind"), F.coalesce("_s", "duplicate_score").alias("duplicate_score"))


def cluster_features(contents: DataFrame, form: bool = True) -> DataFrame:
    """Entities, topics, protected values, title tokens and day of each item."""
    both = F.concat("title", F.lit("\n"), F.coalesce("content", F.lit("")))
    return contents.select(
        "id", F.struct("published_at", "id").alias("place"), "topics", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.sort_array(t.entities(both)).alias("entities"),
        F.sort_array(F.array_distinct(F.transform(t.facts(both), lambda x: x.normalized))).alias("vals"), t.tokens(F.col("title"), 3, form).alias("title_tokens"),
    )


#: Weights of shared entities, topics and title tokens (fixed values).
WEIGHTS = (0.45, 0.2, 0.35)
NONE = "\u0001none"


#: An entity that so many sets of features of a day have, or fewer, is a key by itself; a commoner one only together with a title token.
COMMON = 100


def _rare_first(f: DataFrame, name: str) -> DataFrame:
    """(features, name): the tokens of each set of features as (n, token), n being the sets of its day that have it, rare ones first;
    NONE if there are none."""
    tokens = F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.lit(NONE)))
    each = f.select("features", "day", F.explode(tokens).alias("token"))
    n = each.groupBy("day", "token").agg(F.count("*").alias("n"))
    return each.join(n, ["day", "token"]).groupBy("features").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias(name))


def cluster_keys(f: DataFrame, common: int = COMMON) -> DataFrame:
    """(features, keys): of two sets of features of a day with a score of CLUSTER or more at least one key is shared.

    With J for the shares of common tokens the score is .45 J(entities) + .2 J(topics) + .35 J(title). Either J(title) is half or
    more: then a token is shared among the first n - ceil(n / 2) + 1 of each, in any one order; rare ones come first. Or it is less,
    but not 0: then J(entities) is over .61, a token of so long a beginning is shared, and one of the titles with it. Or it is 0: then entities
    and topics are the same. So neither an entity nor a topic that many items have is a key by itself. What only one set of a day
    has is shared by no two and is no key; an entity of up to ``common`` sets needs no title token, so that long titles aren't
    multiplied by long lists of entities."""
    sets = f.select("features", "day", "entities", "topics", "title_tokens").dropDuplicates(["features"])
    j = sets.select("features", "day", F.sort_array("entities").alias("_e"), F.sort_array("topics").alias("_t")).join(_rare_first(sets, "entities"), "features").join(_rare_first(sets, "title_tokens"), "features")
    most = (CLUSTER - WEIGHTS[1] - WEIGHTS[2] / 2) / WEIGHTS[0]
    begin = lambda c, share: F.slice(c, F.lit(1), (F.size(c) - F.ceil(F.size(c) * share - 1e-9) + 1).cast("int"))
    shared = lambda xs: F.filter(xs, lambda x: x.n > 1)
    digest = lambda *cols: F.md5(F.to_json(F.struct(*cols)))
    half = F.transform(shared(begin("title_tokens", 0.5)), lambda w: digest(F.col("day"), w.token.alias("w")))
    first, title = shared(begin("entities", most)), shared(F.col("title_tokens"))
    alone = F.transform(F.filter(first, lambda e: e.n <= common), lambda e: digest(F.col("day"), e.token.alias("e")))
    both = F.flatten(F.transform(F.filter(first, lambda e: e.n > common), lambda e: F.transform(title, lambda w: digest(F.col("day"), e.token.alias("e"), w.token.alias("w")))))
    return j.select("features", F.array_distinct(F.concat(half, alone, both, F.array(digest("day", "_e", "_t")))).alias("keys"))


class Events:
    """Items of a day in the order of place. Leaders are found by their keys, among those with the same protected values or none; their
    score is then made from the features. What a task holds are a component's leaders."""

    def __init__(self):
        self.leads: list[tuple] = []
        self.by_key: dict[str, dict[tuple, list[int]]] = {}
        self.done: list[tuple] = []

    @staticmethod
    def _share(a: frozenset, b: frozenset) -> float:
        n = len(a & b)
        return n / (len(a) + len(b) - n) if a or b else 1.0

    @staticmethod
    def _most(a: frozenset, b: frozenset) -> float:
        """What the share can be at most."""
        return min(len(a), len(b)) / max(len(a), len(b)) if a or b else 1.0

    def row(self, i, at, keys, stored) -> None:
        own = tuple(frozenset(stored[c]) for c in ("entities", "topics", "title_tokens"))
        vals = tuple(stored["vals"])
        found: set[int] = set()
        for k in keys:
            by = self.by_key.get(k)
            if by:
                for there in [vals, ()] if vals else list(by):
                    found.update(by.get(there, ()))
        best = None
        for n in found:
            there = self.leads[n][1]
            if sum(w * self._most(a, b) for w, a, b in zip(WEIGHTS, there, own, strict=True)) < CLUSTER - 1e-6:
                continue
            score = sum(w * self._share(a, b) for w, a, b in zip(WEIGHTS, there, own, strict=True))
            score = round(score, 9)
            if score >= CLUSTER and (best is None or (-score, n) < best):
                best = (-score, n)
        if best is None:
            n = len(self.leads)
            self.leads.append((i, own))
            for k in keys:
                self.by_key.setdefault(k, {}).setdefault(vals, []).append(n)
        else:
            self.done.append((i, self.leads[best[1]][0], 0, -best[0]))

    def ready(self) -> list[tuple]:
        done, self.done = self.done, []
        return done

    rest = ready


def clusters(contents: DataFrame, form: bool = True) -> DataFrame:
    """(id, cluster_id, score): the cluster id is its first member's id, whose features stay the cluster's; an item joins the cluster with the
    largest score of those whose first member has its day, no other protected values, and a score of CLUSTER or more; ties
    by the first member's place.

    No pair is formed: items whose features share keys, directly or through others, are one component, which is sorted by place
    and read once, each item being compared with the leaders that share a key. A component is one task's stream."""
    scratch = Scratch(contents.sparkSession, "clusters")
    f = cluster_features(contents, form)
    features = F.md5(F.to_json(F.struct("day", "entities", F.sort_array("topics").alias("topics"), "vals", "title_tokens")))
    f = scratch.save(f.withColumn("features", features).withColumn("at", F.unix_micros("place.published_at")))
    keys = scratch.save(cluster_keys(f).withColumn("_first", F.array_min("keys")))
    part = components(keys.select(F.col("_first").alias("a"), F.explode("keys").alias("b")).where("a <> b").distinct(), scratch)
    keyed = keys.join(part, F.col("_first") == part.id, "left").select("features", "keys", F.coalesce("component", "_first").alias("part"))
    rows = f.join(keyed, "features").withColumn("stored", F.struct("entities", "topics", "vals", "title_tokens"))
    out = f.select("id").join(_folded(rows.select("id", "at", "place", "keys", "part", "stored"), ["place"], Events, FOLLOWS), "id", "left")
    return out.select("id", F.coalesce("leader_id", "id").alias("cluster_id"), F.round("score", 9).alias("score"))


#: What clusters are stored under: the policy's version is part of a cluster's key.
POLICY = "event-cluster-v1"


def cluster_rows(contents: DataFrame, members: DataFrame, policy: str = POLICY) -> DataFrame:
    """One row a member: cluster_id, cluster_key (SHA-256 of the policy and the first member's features as JSON), size, and
    the reason of membership, leader or score."""
    f = cluster_features(contents)
    text = F.to_json(F.struct(F.lit(policy).alias("policy"), "day", "entities", "topics", "vals", "title_tokens"))
    keys = f.select(F.col("id").alias("cluster_id"), F.sha2(text, 256).alias("cluster_key"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    reason = F.when(F.col("id") == F.col("cluster_id"), "FIRST_MEMBER").otherwise("EVENT_SIMILARITY")
    return members.join(keys, "cluster_id").join(size, "cluster_id").select("cluster_id", "id", "cluster_key", "size", reason.alias("reason"), "score")


def rebuild_clusters(stored: DataFrame, contents: DataFrame, policy: str = POLICY) -> tuple[DataFrame, DataFrame]:
    """For a new policy: ``stored(cluster_id, policy, status)`` with clusters of other policies archived, and the new
    memberships of all verified contents that are no duplicates."""
    kept = stored.withColumn("status", F.when(F.col("policy") != policy, "ARCHIVED").otherwise(F.col("status")))
    good = contents.where((F.col("provenance_status") == "VERIFIED") & F.col("duplicate_of_id").isNull())
    return kept, clusters(good)


def primary(members: DataFrame, as_of: str) -> DataFrame:
    """Members of ``members(cluster_id, id, tier, authority, all_items, published_at, length, verified)`` with the primary's
    score and mark; ties by id."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("published_at")) / 3.6e9
    direct = F.when(F.col("all_items") | (F.col("tier") == 1), 1.0).otherwise(0.5)
    score = (
        0.25 * (4 - F.col("tier")) / 3 + 0.25 * F.col("authority") + 0.15 * direct + 0.15 * F.greatest(F.lit(0.0), 1 - age / 72)
        + 0.2 * F.least(F.lit(1.0), F.col("length") / 1500) - F.when(F.col("verified"), 0.0).otherwise(0.5)
    )
    m = members.withColumn("primary_score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("primary_score").desc(), "id"))
    return m.withColumn("is_primary", place == 1)
