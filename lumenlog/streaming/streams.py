"""Structured Streaming forms of the capture operators; each gives what its batch twin gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenlog.operators.joins import apply_blocklist
from lumenlog.sources.merge_table import MergeTable, hash_bucket, keep_latest

BUCKETS = 256  # groups of keys that share a state; a call of Python costs milliseconds, a row microseconds
MICRO = 1_000_000


class InOrder(StatefulProcessor):
    """Rows wait until the watermark is past them and are then worked off by key, time and id, late ones in their place.

    A group is a bucket of keys: a batch reads and writes the state of a bucket once, whatever its keys, and calls Python
    once for each bucket that has rows. `waiting` and `memory` hold one array a column. Times are microseconds.

    `key` and `waits`: names and types of the columns, (at, event_id) first among the latter. A subclass names what it
    remembers of a key (its last time first) and what it `gives`. A key is forgotten `silence` seconds after its last time."""

    waits: dict[str, str] = {}
    remembers: dict[str, str] = {}
    gives: list[str] = []

    def __init__(self, key: dict[str, str], silence: float | None = None):
        self.key, self.silence = key, None if silence is None else round(silence * MICRO)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = lambda held: ", ".join(f"{c} array<{t}>" for c, t in {**self.key, **held}.items())
        self.waiting = handle.getValueState("waiting", columns(self.waits))
        self.memory = handle.getValueState("memory", columns(self.remembers))

    def step(self, memory: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        """What is remembered after a row, and the rows that come out."""
        raise NotImplementedError

    def end(self, memory: tuple) -> list[tuple]:
        """The rows that come out as a key is forgotten."""
        return []

    def _held(self, state) -> list[tuple]:
        return list(zip(*state.get(), strict=True)) if state.exists() else []

    def _hold(self, state, rows: list[tuple]) -> None:
        if rows:
            state.update(tuple(list(c) for c in zip(*rows, strict=True)))
        elif state.exists():
            state.clear()

    def _release(self, timerValues, got: list[tuple]) -> Iterator[pd.DataFrame]:
        limit, n, silence = timerValues.getCurrentWatermarkInMs() * 1000, len(self.key), self.silence
        late, ready = [], {}
        for r in (*self._held(self.waiting), *got):
            if r[n] <= limit:
                ready.setdefault(r[:n], []).append(r[n:])
            else:
                late.append(r)
        memories = {r[:n]: r[n:] for r in self._held(self.memory)}
        out = []
        for key, rows in ready.items():
            memory = memories.get(key)
            for row in sorted(rows, key=lambda r: r[:2]):
                if memory is not None and silence is not None and row[0] - memory[0] > silence:
                    out.extend((*key, *v) for v in self.end(memory))
                    memory = None
                memory, values = self.step(memory, row)
                out.extend((*key, *v) for v in values)
            memories[key] = memory
        if silence is not None:
            for key in [k for k, m in memories.items() if limit - m[0] > silence]:
                out.extend((*key, *v) for v in self.end(memories.pop(key)))
        if got or ready:
            self._hold(self.waiting, late)
        self._hold(self.memory, [(*k, *m) for k, m in memories.items()])
        wake = [min(r[n] for r in late)] if late else []
        wake += [min(m[0] for m in memories.values()) + silence] if silence is not None and memories else []
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        yield pd.DataFrame(out, columns=[*self.key, *self.gives], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = []
        for pdf in rows:
            columns = []
            for c, kind in {**self.key, **self.waits}.items():
                there = pdf[c].notna()
                values = pdf[c].tolist() if there.all() else pdf[c].astype(object).where(there, None).tolist()
                columns.append([None if v is None else int(v) for v in values] if kind in ("long", "bigint", "int") else values)
            got.extend(zip(*columns, strict=True))
        yield from self._release(timerValues, got)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._release(timerValues, [])

    def close(self) -> None:
        pass


class SpanTracker(InOrder):
    """Emits spans as contexts change. With `silence`, a span whose next sample comes later than that, or not before the
    watermark says so, ends at its last sample."""

    waits = {"at": "long", "event_id": "long", "app_id": "string"}
    remembers = {"end_at": "long", "start_at": "long", "app_id": "string", "n": "long"}
    gives = ["start_at", "end_at", "app_id", "n_samples"]

    def step(self, memory, row):
        at, _, app = row
        if memory is not None and memory[2] == app:
            return (at, memory[1], app, memory[3] + 1), []
        return (at, at, app, 1), [] if memory is None else [(memory[1], at, *memory[2:])]

    def end(self, memory):
        return [(memory[1], memory[0], *memory[2:])]


class OrderedDups(InOrder):
    """A frame within the threshold of the one before it is a duplicate."""

    waits = {"at": "long", "event_id": "long", "fingerprint": "string"}
    remembers = {"at": "long", "fingerprint": "string"}
    gives = ["event_id", "is_dup"]
    threshold = 5

    def step(self, memory, row):
        near = memory is not None and (int(memory[1], 16) ^ int(row[2], 16)).bit_count() <= self.threshold
        return (row[0], row[2]), [(row[1], near)]


class Throttle(InOrder):
    """The first reading of each slot of time counts; other rows carry the last one on."""

    waits = {"at": "long", "event_id": "long", "value": "double"}
    remembers = {"at": "long", "slot": "long", "value": "double"}
    gives = ["event_id", "carried"]
    seconds = 60

    def step(self, memory, row):
        slot = row[0] // (self.seconds * MICRO)
        fresh = memory is None or memory[1] != slot
        last = None if memory is None else memory[2]
        value = row[2] if fresh and row[2] is not None else last
        return (row[0], slot, value), [(row[1], value)]


def _in_order(df: DataFrame, work: InOrder, schema: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Runs `work` over `df` with its time in `ts`; each bucket of keys is one group."""
    marked = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = marked.select(*work.key, "ts", F.unix_micros("ts").alias("at"), *[c for c in work.waits if c != "at"])
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*work.key), F.lit(buckets)).cast("int"))
    return dealt.groupBy("__bucket").transformWithStateInPandas(work, schema, "Append", "EventTime")


def stream_spans(samples: DataFrame, delay: str = "1 hour", idle: float | None = None) -> DataFrame:
    """ST1: closed spans of `(user_id, ts, event_id, app_id)`; a span closes at the sample that breaks it, or at its
    last sample if none follows within `idle` seconds (None: it stays open)."""
    out = _in_order(samples, SpanTracker({"user_id": "long"}, idle), "user_id long, start_at long, end_at long, app_id string, n_samples long", delay)
    return out.select("user_id", F.timestamp_micros("start_at").alias("start_ts"), F.timestamp_micros("end_at").alias("end_ts"), "app_id", "n_samples")


class DupFilter(StatefulProcessor):
    """Keeps the last fingerprint of a key; a frame within the threshold of it is a duplicate."""

    def __init__(self, key: list[str], threshold: int, ttl: int | None):
        self.key, self.threshold, self.ttl = key, threshold, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fingerprint string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        flags = []
        for fp in frames["fingerprint"]:
            flags.append(before is not None and (int(before, 16) ^ int(fp, 16)).bit_count() <= self.threshold)
            before = fp
        self.last.update((before,))
        yield frames[[*self.key, "event_id"]].assign(is_dup=flags)

    def close(self) -> None:
        pass


def _key(df: DataFrame, key: tuple[str, ...]) -> dict[str, str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return {c: types[c] for c in key}


def _keyed(df: DataFrame, key: tuple[str, ...]) -> str:
    return ", ".join([*(f"{c} {t}" for c, t in _key(df, key).items()), "event_id long"])


def stream_drop_dups(frames: DataFrame, threshold: int = 5, key: tuple[str, ...] = ("user_id",), ttl: int | None = None, delay: str | None = None, silence: float | None = None) -> DataFrame:
    """ST2: `(*key, event_id, is_dup)` per frame.

    With `delay` frames wait until the watermark is past them, so the one before is that by time and id, as in W03,
    however batches come; what is later still is dropped, and a key is forgotten `silence` seconds of event time after its
    last frame (None: never). Without, in the order of arrival between batches and of time within one, at once; a key
    that sends nothing for `ttl` milliseconds of processing time is forgotten (None: never), so its next frame is kept;
    such a stream runs on without data, so it is meant for triggers that don't wait for its end."""
    schema = _keyed(frames, key) + ", is_dup boolean"
    if delay is not None:
        work = OrderedDups(_key(frames, key), silence)
        work.threshold = threshold
        return _in_order(frames, work, schema, delay)
    mode = "None" if ttl is None else "ProcessingTime"
    return frames.groupBy(*key).transformWithStateInPandas(DupFilter(list(key), threshold, ttl), schema, "Append", mode)


def stream_throttle(readings: DataFrame, seconds: int, key: tuple[str, ...] = ("user_id",), delay: str = "1 hour", silence: float | None = None) -> DataFrame:
    """ST8: `(*key, event_id, carried)` of `(*key, ts, event_id, value)`: at most the first reading of each interval counts,
    others carry the last one on, as `throttle_carry` has it.

    Rows wait until the watermark is past them, so late ones stand in their place; a key's state goes `silence` seconds
    of event time after its last row (None: never), and its next row has nothing to carry on."""
    work = Throttle(_key(readings, key), silence)
    work.seconds = seconds
    return _in_order(readings.withColumn("value", F.col("value").cast("double")), work, _keyed(readings, key) + ", carried double", delay)


def stream_hourly(samples: DataFrame, delay: str = "1 hour", tokens: str | None = None) -> DataFrame:
    """ST3: events per app and hour and, with `tokens` (a column), the sum of those; late rows past the watermark are dropped."""
    marked = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    sums = [F.count("*").alias("events")] + ([F.sum(tokens).cast("long").alias("tokens")] if tokens else [])
    out = marked.groupBy(F.window("ts", "1 hour"), "app_id").agg(*sums)
    return out.select(F.col("window.start").alias("hour"), "app_id", "events", *(["tokens"] if tokens else []))


def stream_rates(samples: DataFrame, size: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """ST4: events per user in sliding windows."""
    marked = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return marked.groupBy(F.window("ts", size, slide), "user_id").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "user_id", "events")


def stream_sessions(samples: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """ST4: sessions per user that end after a gap."""
    marked = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "events")


def stream_blocklist(samples: DataFrame, blocklist: DataFrame) -> DataFrame:
    """ST5: allowed rows of a stream with `(app_id, domain)`: those whose app is not blocked, nor its domain, nor one
    above it (stream-static anti joins, one per number of labels that blocked domains have; case is ignored)."""
    live = blocklist.where("enabled")
    apps = live.where("block_type = 'app'").select(F.lower("pattern").alias("blocked"))
    domains = live.where("block_type = 'domain'").select(F.lower("pattern").alias("blocked"))
    out = samples.join(apps, F.lower("app_id") == F.col("blocked"), "left_anti")
    labels = F.size(F.split("blocked", r"\."))
    for n in [r[0] for r in domains.select(labels).distinct().collect()]:  # numbers of labels, 127 at most
        out = out.join(domains.where(labels == n), F.lower(F.substring_index("domain", ".", -n)) == F.col("blocked"), "left_anti")
    return out


def stream_redact(samples: DataFrame, blocklist: DataFrame, hidden: tuple[str, ...] = ("url", "window_title")) -> DataFrame:
    """ST5 as capture has it: all rows of a stream with `(app_id, domain)`, blocked ones without what `hidden` names and
    without domain; adds `blocked` and `blocked_reason` (`app: x` before `domain: y`, the shortest domain blocked)."""
    live = blocklist.where("enabled")
    of = lambda kind, name: live.where(F.col("block_type") == kind).select(F.lower("pattern").alias(name)).distinct()
    out = samples.join(of("app", "__app"), F.lower("app_id") == F.col("__app"), "left")
    domains, labels = of("domain", "blocked"), F.size(F.split("blocked", r"\."))
    counts = sorted(r[0] for r in domains.select(labels).distinct().collect())  # numbers of labels, 127 at most
    for n in counts:
        some = domains.where(labels == n).withColumnRenamed("blocked", f"__d{n}")
        out = out.join(some, F.lower(F.substring_index("domain", ".", -n)) == F.col(f"__d{n}"), "left")
    domain = F.coalesce(*[F.col(f"__d{n}") for n in counts], F.lit(None).cast("string"))
    reason = F.when(F.col("__app").isNotNull(), F.concat(F.lit("app: "), "__app")).when(domain.isNotNull(), F.concat(F.lit("domain: "), domain))
    out = out.withColumn("blocked_reason", reason).withColumn("blocked", F.col("blocked_reason").isNotNull())
    gone = {c: F.when(~F.col("blocked"), F.col(c)) for c in (*hidden, "domain")}
    return out.withColumns(gone).drop("__app", *[f"__d{n}" for n in counts])


def stream_frame_span_join(frames: DataFrame, spans: DataFrame, bound: str = "1 hour", how: str = "inner") -> DataFrame:
    """ST6: frames with the spans that hold them; spans are no longer than `bound`, which bounds the state.

    With `how="left_outer"` a frame that no span holds comes out with nulls once the watermark is past all spans that
    could still hold it; until then a span that comes late, but in time, finds it."""
    f = frames.withColumn("f_ts", F.col("ts").cast("timestamp")).select("user_id", "frame_id", "f_ts").withWatermark("f_ts", bound).alias("f")
    s = spans.select(F.col("user_id").alias("s_user"), "span_id", F.col("start_ts").cast("timestamp").alias("s_start"), F.col("end_ts").cast("timestamp").alias("s_end")).withWatermark("s_start", bound).alias("s")
    cond = F.expr(f"user_id = s_user and f_ts >= s_start and f_ts < s_end and f_ts <= s_start + interval {bound}")
    return f.join(s, cond, how).select("user_id", "frame_id", "span_id")


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Batches that a sink's table has as a whole, rising, as far back as it keeps them."""
    return MergeTable(spark, path, keep_latest([], []), F.lit(0)).versions()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """ST7: the table as its last complete batch left it; None before the first."""
    table = MergeTable(spark, path, keep_latest([], []), F.lit(0))
    about = table.manifest().get("about")
    if about is None:
        return None
    table.merge = keep_latest(about["key"], about["order"])
    return table.read()


def upsert_sink(path: str, key: list[str], order: str, keep: int = 3, buckets: int = 16):
    """ST7: a foreachBatch function that keeps the latest row per key.

    The table is one of merged segments in buckets of a hash of the key (`sources.merge_table`): a batch writes its own
    rows, one for each key, not the table. One that stops halfway leaves the table as it was; running it again replaces
    its segment by the same rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        about = {"key": key, "order": [order]}
        MergeTable(batch.sparkSession, path, keep_latest(key, [order]), hash_bucket(key, buckets), keep=keep, about=about).apply(batch, batch_id)

    return write


__all__ = ["apply_blocklist", "latest_version", "stream_blocklist", "stream_drop_dups", "stream_frame_span_join", "stream_hourly", "stream_rates", "stream_redact", "stream_sessions", "stream_spans", "stream_throttle", "table_versions", "upsert_sink"]
