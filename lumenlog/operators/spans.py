"""Spans: building them from samples, clipping, sessions, transitions, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import hamming
from lumenlog.operators.segments import block_piece, scan, time_piece
from lumenlog.sources.scratch import spread


def build_spans(samples: DataFrame, key: str = "user_id", browsers: list[str] | None = None, tie: str = "event_id", keep_ids: int = 100, piece: str = "day", max_gap: float | None = None) -> DataFrame:
    """Spans of one context per `key`.

    A sample starts a new span if the app differs from the one before, if the titles differ and neither is empty, or
    if the URL differs (null-safe) in a browser; with `max_gap`, also if it comes more than so many seconds later, and
    the span before then ends at its own last sample. Else a span ends at the sample that breaks it, the last one at
    its last sample. The last non-empty title wins, the URL is the first sample's; the last `keep_ids` ids are kept.

    Samples are put in order within a `piece` of time only (see `segments`); spans are summed up by piece first.
    """
    filled = lambda c: (F.col(c).isNotNull()) & (F.col(c) != "")
    order, ordered, at = ["ts", tie], F.struct("ts", tie), time_piece("ts", piece)
    rows = scan(samples, [key], order, at, lag={f"p_{c}": c for c in ("app_id", "window_title", "url", "ts")}, lead={"n_ts": "ts"})
    title = filled("window_title") & filled("p_window_title") & (F.col("window_title") != F.col("p_window_title"))
    url = F.col("app_id").isin(browsers or []) & ~F.col("url").eqNullSafe(F.col("p_url"))
    later = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") > max_gap * 1e6 if max_gap is not None else F.lit(False)
    starts = F.col("p_ts").isNull() | ~F.col("app_id").eqNullSafe(F.col("p_app_id")) | F.coalesce(title, F.lit(False)) | url | later("p_ts", "ts")
    rows = rows.withColumn("starts", starts.cast("long"))
    rows = scan(rows, [key], order, at, before={"span": F.col("starts")}).withColumn("span", F.col("span") + F.col("starts"))
    until = F.when(F.col("n_ts").isNull() | later("ts", "n_ts"), F.col("ts")).otherwise(F.col("n_ts"))
    newest = lambda c: F.when(F.size(c) > keep_ids, F.slice(c, -keep_ids, keep_ids)).otherwise(c)
    parts = rows.withColumn("piece", at).groupBy(key, "span", "piece").agg(
        F.min("ts").alias("start_ts"),
        F.max(F.struct("ts", tie, until.alias("until"))).alias("end"),
        F.first("app_id").alias("app_id"),
        F.max(F.when(filled("window_title"), F.struct("ts", tie, "window_title"))).alias("title"),
        F.min(F.struct("ts", tie, "url")).alias("url"),
        F.count("*").alias("n_samples"),
        newest(F.array_sort(F.collect_list(ordered))).alias("ids"),
    )
    # Any of the last `keep_ids` samples of a span is in one of its last `keep_ids` pieces.
    recent = F.row_number().over(Window.partitionBy(key, "span").orderBy(F.col("piece").desc())) <= keep_ids
    out = parts.withColumn("ids", F.when(recent, F.col("ids"))).groupBy(key, "span").agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end")["until"].alias("end_ts"),
        F.first("app_id").alias("app_id"),
        F.max("title")["window_title"].alias("window_title"),
        F.min("url")["url"].alias("url"),
        F.sum("n_samples").alias("n_samples"),
        newest(F.array_sort(F.flatten(F.collect_list("ids")))).alias("last_ids"),
    )
    return out.withColumn("evidence_ids", F.transform("last_ids", lambda x: x[tie])).drop("last_ids")


def lead_spans(events: DataFrame, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """Spans from each sample to the next one of its key (the last sample has none), dealt by key and number."""
    w = Window.partitionBy(key).orderBy("ts", tie)
    return spread(events, key).withColumn("end_ts", F.lead("ts").over(w)).where("end_ts is not null").withColumnRenamed("ts", "start_ts")


def clip_to_hours(spans: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """One row per span and hour that it touches, with `hour, clip_start, clip_end, seconds` (> 0)."""
    first = F.date_trunc("hour", start).cast("timestamp_ntz")
    hours = F.explode(F.sequence(first, F.date_trunc("hour", end).cast("timestamp_ntz"), F.expr("interval 1 hour"))).alias("hour")
    rows = spans.select("*", hours)
    rows = rows.withColumns({"clip_start": F.greatest(F.col(start), F.col("hour")), "clip_end": F.least(F.col(end), F.col("hour") + F.expr("interval 1 hour"))})
    return rows.withColumn("seconds", F.expr("timestampdiff(MICROSECOND, clip_start, clip_end)") / 1e6).where("seconds > 0")


def drop_consecutive_dups(df: DataFrame, key: str, fp: str = "fingerprint", threshold: int = 5, order: tuple[str, ...] = ("ts", "event_id"), piece: str = "day") -> DataFrame:
    """`distance` to the frame before and `is_dup` (at most the threshold); the frame before is always the last one."""
    rows = scan(df, [key], list(order), time_piece(order[0], piece), lag={"__before": fp})
    rows = rows.withColumn("distance", hamming(F.col(fp), F.col("__before"))).drop("__before")
    return rows.withColumn("is_dup", F.coalesce(F.col("distance") <= threshold, F.lit(False)))


def dwell(frames: DataFrame, key: str, order: tuple[str, ...] = ("ts", "event_id"), piece: str = "day") -> DataFrame:
    """Retained frames with the seconds until the next retained one, or until the last frame of the key."""
    kept = (~F.col("is_dup")).cast("long")
    group = scan(frames, [key], list(order), time_piece(order[0], piece), before={"g": kept}).withColumn("g", F.col("g") + kept)
    spans = group.groupBy(key, "g").agg(F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), F.count("*").alias("frames"))
    spans = scan(spans, [key], ["g"], block_piece("g"), lead={"__next": "ts"})
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return spans.withColumn("dwell_seconds", seconds(F.coalesce("__next", "last_ts")) - seconds(F.col("ts"))).drop("__next")


def focus_sessions(spans: DataFrame, key: list[str], app: str = "app_id", minutes: float = 30, max_gap: float | None = None, piece: str = "day") -> DataFrame:
    """Runs of consecutive spans on one app whose durations add up to at least `minutes`; with `max_gap`, a span that
    starts more than so many seconds after the end of the one before begins a new run."""
    order, at = ["start_ts", "event_id"], time_piece("start_ts", piece)
    rows = scan(spans, key, order, at, lag={"__app": app, "__end": "end_ts"})
    change = F.coalesce((F.col(app) != F.col("__app")).cast("long"), F.lit(1))
    if max_gap is not None:
        change = F.when(F.expr("timestampdiff(MICROSECOND, __end, start_ts)") > max_gap * 1e6, 1).otherwise(change)
    rows = rows.withColumn("__change", change.cast("long"))
    rows = scan(rows, key, order, at, before={"island": F.col("__change")}).withColumn("island", F.col("island") + F.col("__change"))
    seconds = F.expr("timestampdiff(MICROSECOND, start_ts, end_ts)") / 1e6
    out = rows.groupBy(*key, "island", app).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), (F.sum(seconds) / 60).alias("minutes"), F.count("*").alias("n_spans"))
    return out.where(F.col("minutes") >= minutes)


def media_spans(spans: DataFrame, key: str, media: str = "media") -> DataFrame:
    """Consecutive spans with the same media merged; empty ones are skipped."""
    w = Window.partitionBy(key).orderBy("start_ts", "event_id")
    rows = spans.where((F.col(media).isNotNull()) & (F.col(media) != ""))
    rows = rows.withColumn("change", F.coalesce((F.col(media) != F.lag(media).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island", media).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_spans"))


def budget_snippets(df: DataFrame, key: str, order: list[str], tokens: str = "token_estimate", budget: int = 4000, cap: int = 500, least: int = 100, piece: Column | None = None) -> DataFrame:
    """Rows in order until the budget is spent, each counting its tokens up to the cap; a row that would overflow
    is cut to what is left, or ends the selection if less than `least` is left. Adds `used_tokens`.

    What is spent before a row never falls, so a row behind the end finds the budget spent and no second pass is due."""
    rows = df.withColumn("capped", F.least(F.col(tokens), F.lit(cap)).cast("long"))
    rows = scan(rows, [key], order, piece, before={"spent": F.col("capped")})
    stop = (F.col("spent") >= budget) | ((F.col("spent") + F.col("capped") > budget) & (budget - F.col("spent") < least))
    return rows.where(~stop).withColumn("used_tokens", F.least(F.col("capped"), F.lit(budget) - F.col("spent")).cast("long")).drop("capped", "spent")


def budget_prefix(df: DataFrame, key: str, order: list[str], tokens: str = "token_estimate", budget: int = 4000, piece: Column | None = None) -> DataFrame:
    """The longest prefix whose tokens stay within the budget."""
    rows = scan(df, [key], order, piece, before={"running_tokens": F.col(tokens).cast("long")})
    return rows.withColumn("running_tokens", F.col("running_tokens") + F.coalesce(F.col(tokens), F.lit(0)).cast("long")).where(F.col("running_tokens") <= budget)


def mark_transitions(df: DataFrame, key: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Whether the app or title differs from the row before; the first row does."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = ~F.col("app_id").eqNullSafe(F.lag("app_id").over(w)) | ~F.col("window_title").eqNullSafe(F.lag("window_title").over(w))
    return df.withColumn("is_transition", changed | (F.row_number().over(w) == 1))


def temporal_sequence(df: DataFrame, key: str, match: str, order: tuple[str, ...] = ("start_ts", "event_id"), of: str = "event_id", piece: str = "day") -> DataFrame:
    """Matching rows with the ids of the rows just before and after."""
    return scan(df, [key], list(order), time_piece(order[0], piece), lag={"before_id": of}, lead={"after_id": of}).where(match)


def transition_matrix(spans: DataFrame, key: str, app: str = "app_id", order: tuple[str, ...] = ("start_ts", "event_id"), piece: str = "day") -> DataFrame:
    """How often one app follows another."""
    rows = scan(spans.select(key, *order, F.col(app).alias("from_app")), [key], list(order), time_piece(order[0], piece), lead={"to_app": "from_app"})
    return rows.where("to_app is not null and to_app <> from_app").groupBy("from_app", "to_app").agg(F.count("*").alias("n"))


def topk_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first `n` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def throttle_carry(df: DataFrame, key: str, value: str, seconds: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """ST8: at most the first reading of each interval counts; others carry the last reading on."""
    w = Window.partitionBy(key).orderBy(*order)
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    rows = df.withColumn("slot", slot)
    first = F.row_number().over(Window.partitionBy(key, "slot").orderBy(*order)) == 1
    return rows.withColumn("reading", F.when(first, F.col(value))).withColumn("carried", F.last("reading", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("slot", "reading")


def open_loops(notes: DataFrame, loops: str = "open_loops", limit: int = 50) -> DataFrame:
    """Open loops, the newest of each text (lower case, trimmed), newest first; id is `note:index`."""
    rows = notes.select("note_id", "start_ts", F.posexplode(loops).alias("idx", "loop")).where("loop is not null and trim(loop) <> ''")
    rows = rows.withColumn("norm", F.lower(F.trim("loop")))
    w = Window.partitionBy("norm").orderBy(F.col("start_ts").desc(), F.col("note_id").desc(), "idx")
    one = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return one.select(F.concat_ws(":", F.col("note_id").cast("string"), F.col("idx").cast("string")).alias("loop_id"), "note_id", "start_ts", "loop").orderBy(F.col("start_ts").desc(), "loop_id").limit(limit)
