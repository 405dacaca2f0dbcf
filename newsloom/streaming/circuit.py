"""Source circuit breaker over a log of fetch attempts, as a batch job and as a stream with timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Failures in a row, shares of 403 and 429, parser rejects, microseconds open.
FAILURES, RATE, RATE_ATTEMPTS = 5, 0.5, 4
PARSES, REJECTS = 10, 0.4
OPEN_US = 15 * 60 * 1_000_000
STATE = "subscription_id long, ts timestamp, seq long, circuit string, failures int, next_probe timestamp"


def fresh() -> dict:
    return {"circuit": "CLOSED", "failures": 0, "attempts": 0, "parses": 0, "rejects": 0, "e403": 0, "e429": 0, "probe": None}


def released(s: dict, now: int) -> dict | None:
    """The state after its probe's time has come by ``now`` (microseconds), if it has."""
    return s | {"circuit": "HALF_OPEN"} if s["circuit"] == "OPEN" and s["probe"] is not None and now >= s["probe"] else None


def step(s: dict, ts: int, kind: str, code: str | None, rejected: bool | None) -> dict:
    """The state after one event: success, failure, parse, pause or resume; any other kind changes nothing."""
    if kind == "resume":
        return fresh()
    if kind == "pause" or s["circuit"] == "MANUAL_PAUSED":
        return s | {"circuit": "MANUAL_PAUSED"}
    if kind == "success":
        return s | {"circuit": "CLOSED", "failures": 0, "attempts": s["attempts"] + 1, "probe": None}
    if kind == "failure":
        s = s | {"attempts": s["attempts"] + 1, "failures": s["failures"] + 1, "e403": s["e403"] + (code == "HTTP_403"), "e429": s["e429"] + (code == "HTTP_429")}
        often = s["attempts"] >= RATE_ATTEMPTS and max(s["e403"], s["e429"]) / s["attempts"] >= RATE
        if s["circuit"] == "HALF_OPEN" or s["failures"] >= FAILURES or often:
            return s | {"circuit": "OPEN", "probe": ts + OPEN_US * min(8, 2 ** max(0, s["failures"] - FAILURES))}
    elif kind == "parse":
        s = s | {"parses": s["parses"] + 1, "rejects": s["rejects"] + bool(rejected)}
        if s["parses"] >= PARSES and s["rejects"] / s["parses"] >= REJECTS:
            return s | {"circuit": "OPEN", "probe": ts + OPEN_US}
    return s


def fold(s: dict, events: Iterable[tuple], out: list[tuple]) -> dict:
    """The state after ``events`` (ts, seq, kind, code, rejected) in their order. ``out`` gets a row (ts, seq, circuit, failures, probe)
    for each, and one without seq, at the probe's time, for each release before an event."""
    for ts, seq, kind, code, rejected in events:
        half = released(s, ts)
        if half is not None:
            s = half
            out.append((s["probe"], None, s["circuit"], s["failures"], s["probe"]))
        s = step(s, ts, kind, code, rejected)
        out.append((ts, seq, s["circuit"], s["failures"], s["probe"]))
    return s


EVENT = ["ts", "seq", "kind", "error_code", "rejected"]


def circuit_states(log: DataFrame) -> DataFrame:
    """State after every event of ``log(subscription_id, ts, seq, kind, error_code, rejected)``, in the order of (ts, seq), and
    a row without seq for each open circuit that its probe's time released before the next event; rows without ts don't count.

    Subscriptions are sorted within partitions, and a task carries one subscription's small state from batch to batch: a
    log of any length needs the memory of a batch. A subscription's events are one task's work, since each state needs the one before."""
    kind = log.schema["subscription_id"].dataType.simpleString()
    rows = log.where("ts is not null").select("subscription_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("long").alias("seq"), "kind", "error_code", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, key, s = True, None, fresh()
        for b in batches:
            keys, events = b.column(0).to_pylist(), list(zip(*[b.column(k).to_pylist() for k in range(1, 6)], strict=True))
            own, out, lo = [], [], 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if first or keys[lo] != key:
                    first, key, s = False, keys[lo], fresh()
                before = len(out)
                s = fold(s, events[lo:hi], out)
                own += [key] * (len(out) - before)
                lo = hi
            if out:
                ts, seq, circuit, failures, probe = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, b.schema.field(0).type), pa.array(ts, pa.int64()), pa.array(seq, pa.int64()), pa.array(circuit), pa.array(failures, pa.int32()), pa.array(probe, pa.int64())], names=["subscription_id", "ts", "seq", "circuit", "failures", "next_probe"])

    done = rows.repartition("subscription_id").sortWithinPartitions("subscription_id", "ts", "seq").mapInArrow(run, f"subscription_id {kind}, ts long, seq long, circuit string, failures int, next_probe long")
    return done.withColumns({"ts": F.timestamp_micros("ts"), "next_probe": F.timestamp_micros("next_probe")})


def _micros(t) -> int | None:
    return None if pd.isna(t) else int(pd.Timestamp(t).value // 1000)


class Breaker(StatefulProcessor):
    """A subscription's circuit: its state as one value, and a timer at the probe's time of an open one."""

    FIELDS = list(fresh())

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("circuit", "circuit string, failures int, attempts int, parses int, rejects int, e403 int, e429 int, probe long")

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame([(key[0], *r) for r in rows], columns=["subscription_id", "ts", "seq", "circuit", "failures", "next_probe"])
        at = lambda c: pd.to_datetime(f[c], unit="us", utc=True)
        return f.assign(ts=at("ts"), next_probe=at("next_probe"), seq=f["seq"].astype("Int64"))

    def _get(self) -> dict:
        return dict(zip(self.FIELDS, self.value.get(), strict=True)) if self.value.exists() else fresh()

    def _put(self, s: dict, timer: int | None) -> None:
        """Stores the state; the timer is the one of its probe, if it is open."""
        wanted = -(-s["probe"] // 1000) if s["circuit"] == "OPEN" and s["probe"] is not None else None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.value.update(tuple(s[f] for f in self.FIELDS))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        f = pd.concat(list(rows)).dropna(subset=["ts"]).sort_values(["ts", "seq"])
        s = self._get()
        timer = -(-s["probe"] // 1000) if s["circuit"] == "OPEN" and s["probe"] is not None else None
        events = zip(map(_micros, f["ts"]), f["seq"].astype("int64").tolist(), f["kind"], f["error_code"], f["rejected"], strict=True)
        out: list[tuple] = []
        s = fold(s, events, out)
        self._put(s, timer)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = released(self._get(), expired.getExpiryTimeInMs() * 1000)
        if s is not None:
            self.value.update(tuple(s[f] for f in self.FIELDS))
            yield self._frame(key, [(s["probe"], None, s["circuit"], s["failures"], s["probe"])])

    def close(self) -> None:
        pass


#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def circuit_stream(log: DataFrame, clock: str = "event", delay: str = "1 minute") -> DataFrame:
    """The same over a stream: events of one micro-batch are ordered, state is kept by subscription, and a timer releases an
    open circuit when its probe's time comes, without any event of the subscription: by the watermark of ts (``clock`` event; later
    than ``delay`` is late) or by the time of day (processing). The session's state store must be STORE."""
    if clock == "event":
        log = log.withWatermark("ts", delay)
    return log.select("subscription_id", *EVENT).groupBy("subscription_id").transformWithStateInPandas(Breaker(), STATE, "append", {"event": "EventTime", "processing": "ProcessingTime"}[clock])


def release_due_probes(states: DataFrame, as_of: str) -> DataFrame:
    """Open circuits whose probe time has come, now half open."""
    due = (F.col("circuit") == "OPEN") & (F.col("next_probe") <= F.lit(as_of).cast("timestamp"))
    return states.where(due).withColumn("circuit", F.lit("HALF_OPEN"))


def logical_fetches(log: DataFrame, bucket: str = "10 minutes", delay: str = "20 minutes") -> DataFrame:
    """One fetch a subscription and time bucket. On a stream, repeats are dropped within the watermark."""
    b = log.withColumn("bucket", F.window("ts", bucket)["start"])
    if log.isStreaming:
        return b.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["subscription_id", "bucket"])
    return b.groupBy("subscription_id", "bucket").agg(F.min(F.struct("ts", "seq")).alias("first")).select("subscription_id", "bucket", "first.ts", "first.seq")


#: What tells jobs of a type apart, with what stands for a part that is missing, and the version of jobs (fixed values).
JOB_VERSION = 2
JOB_PARTS = {
    "DISCOVER_DUE_SOURCES": ["schedule_bucket"], "FETCH_SOURCE": ["subscription_id", "schedule_bucket"], "NORMALIZE_PAYLOAD": ["raw_payload_id"], "VALIDATE_CONTENT": ["canonical_content_id"],
    "CLUSTER_CONTENT": ["canonical_content_id", "policy_version"], "LOCALIZE_CONTENT": ["canonical_content_id", "locale", "source_content_hash", "policy_version", "glossary_version"],
    "MATCH_USERS": ["canonical_content_id", "policy_version"], "BUILD_BRIEFS": ["date_bucket", "locale"], "BACKFILL_CONTENT": ["cursor", "batch_size"], "REPLAY_PAYLOAD": ["raw_payload_id", "reason"],
}
JOB_DEFAULTS = {("BUILD_BRIEFS", "locale"): "all", ("BACKFILL_CONTENT", "cursor"): "start"}


def job_identity(jobs: DataFrame, version: int = JOB_VERSION):
    """Logical identity of each of ``jobs(type, ...)``, as a column over it: version, type and the SHA-256 of what tells jobs of the type apart.
    Null for an unknown type and where a part is missing that has no default."""
    part = lambda kind, c: F.coalesce(F.col(c).cast("string") if c in jobs.columns else F.lit(None).cast("string"), F.lit(JOB_DEFAULTS.get((kind, c))))
    own = None
    for kind, cols in JOB_PARTS.items():
        text = part(kind, cols[0])
        for c in cols[1:]:
            text = F.concat(text, F.lit("-"), part(kind, c))
        own = F.when(F.col("type") == kind, text) if own is None else own.when(F.col("type") == kind, text)
    raw = F.concat(F.lit(f"v{version}-"), F.lower("type"), F.lit("-"), F.sha2(own, 256))
    return F.left(F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9_-]+", "-"), "-+", "-"), F.lit(240))


def distinct_deliveries(log: DataFrame, identity: str = "identity", delay: str = "20 minutes") -> DataFrame:
    """Each job once, however often delivered."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([identity]) if log.isStreaming else log.dropDuplicates([identity])


def run_telemetry(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Runs with status and duration: starts joined to their end by run_id within a time bound; a start without
    an end is RUNNING."""
    s = starts.select("run_id", "pipeline", F.col("ts").alias("started_at"))
    e = ends.select(F.col("run_id").alias("_run"), F.col("ts").alias("ended_at"), "ok")
    if starts.isStreaming:
        s, e = s.withWatermark("started_at", within), e.withWatermark("ended_at", within)
    on = (F.col("run_id") == F.col("_run")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    j = s.join(e, on, "left").drop("_run")
    status = F.when(F.col("ok"), "SUCCESS").when(~F.col("ok"), "FAILED").otherwise("RUNNING")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return j.withColumn("status", status).withColumn("duration_ms", ms("ended_at") - ms("started_at")).drop("ok")
