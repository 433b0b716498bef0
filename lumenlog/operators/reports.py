"""Whole forms of the hourly, weekly and pattern reports, and of the entity lookups, for all users and periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.graph import expand
from lumenlog.operators.joins import edges_for
from lumenlog.operators.rollups import MINUTES



def hourly_apps(clipped: DataFrame, key: str = "user_id", app: str = "app_id") -> DataFrame:
    """Clipped seconds and spans per key, hour and app; an app without a name is Unknown."""
    name = F.coalesce(F.when(F.col(app) != "", F.col(app)), F.lit("Unknown"))
    return clipped.groupBy(key, "hour", name.alias("app")).agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.count("*").alias("spans"))


def hourly_counts(clipped: DataFrame, frames: DataFrame, texts: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key and hour with any of them the spans, clipped seconds, frames, texts and sorted distinct locations.

    `frames(key, ts, location)`, `texts(key, ts)`. The three are brought to one shape first, so that one aggregation
    (partial before its shuffle) does for all."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    none, nothing, nowhere = F.lit(0), F.lit(0.0), F.lit(None).cast("string")
    a = clipped.select(key, F.col("hour").cast("timestamp_ntz").alias("hour"), F.lit(1).alias("s"), F.col("seconds").cast("double").alias("seconds"), none.alias("f"), none.alias("t"), nowhere.alias("location"))
    b = frames.select(key, hour, none.alias("s"), nothing.alias("seconds"), F.lit(1).alias("f"), none.alias("t"), F.col("location").cast("string").alias("location"))
    c = texts.select(key, hour, none.alias("s"), nothing.alias("seconds"), none.alias("f"), F.lit(1).alias("t"), nowhere.alias("location"))
    places = F.array_join(F.array_sort(F.collect_set("location")), ",")
    return a.union(b).union(c).groupBy(key, "hour").agg(F.sum("s").cast("long").alias("spans"), F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("f").cast("long").alias("frames"), F.sum("t").cast("long").alias("texts"), places.alias("locations"))


def weekly_notes(spans: DataFrame, notes: DataFrame) -> DataFrame:
    """Per week hours and notes, each with its change from the week before, and the score of both.

    Changes in percent divide by at least 0.1; score: min(notes/7/10, 1)*50 + min(hours/7/8, 1)*50."""
    week = F.to_date(F.date_trunc("week", "start_ts")).alias("week")
    hours = spans.select(week, (F.expr(MINUTES) / 60).alias("h"), F.lit(0).alias("n"))
    written = notes.select(week, F.lit(0.0).alias("h"), F.lit(1).alias("n"))
    sums = hours.union(written).groupBy("week").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
    w = Window.orderBy("week")  # one row a week
    before = lambda c: F.coalesce(F.when(F.lag("week").over(w) == F.date_sub("week", 7), F.lag(c).over(w)), F.lit(0)).cast("double")
    percent = lambda c: F.round((F.col(c) - before(c)) / F.greatest(before(c), F.lit(0.1)) * 100, 1)
    score = F.least(F.col("n") / 7 / 10, F.lit(1.0)) * 50 + F.least(F.col("h") / 7 / 8, F.lit(1.0)) * 50
    return sums.select("week", F.round("h", 2).alias("hours"), F.col("n").cast("long").alias("notes"), percent("h").alias("hours_change"), percent("n").alias("notes_change"), F.round(score, 2).alias("score"))


def weekly_top(items: DataFrame, key: str, value: Column, n: int = 5, ts: str = "start_ts") -> DataFrame:
    """The `n` keys with the largest sums of each week."""
    sums = items.groupBy(F.to_date(F.date_trunc("week", ts)).alias("week"), F.col(key).alias("key")).agg(F.round(F.sum(value), 3).alias("value"))
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.col("value").desc(), "key"))
    return sums.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def hour_averages(events: DataFrame, ts: str = "ts", top: int = 3) -> DataFrame:
    """Events per active day of each hour of the day, and whether it is one of the `top` hours."""
    sums = events.groupBy(F.hour(ts).alias("hour")).agg((F.count("*") / F.count_distinct(F.to_date(ts))).alias("a"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("a").desc(), "hour"))  # 24 rows
    return sums.select("hour", F.round("a", 3).alias("average"), (rank <= top).alias("is_top"))


def week_balance(events: DataFrame, ts: str = "ts") -> DataFrame:
    """In one row the busiest and the quietest weekday (Monday 0), whether they differ by more than 1.3 times, and
    what the weekdays' average by the weekend's says: above 2 focus on weekdays, the weekend above 0.8 active all week."""
    day = (F.dayofweek(ts) + 5) % 7
    rows = events.groupBy(day.alias("d")).agg((F.count("*") / F.count_distinct(F.to_date(ts))).alias("a"))
    mean = lambda cond, n: F.coalesce(F.sum(F.when(cond, F.col("a"))), F.lit(0.0)) / n
    one = rows.agg(F.max_by("d", F.struct("a", -F.col("d"))).alias("busiest"), F.min_by("d", F.struct("a", -F.col("d"))).alias("quietest"), (F.max("a") > 1.3 * F.min("a")).alias("uneven"), mean(F.col("d") < 5, 5).alias("w"), mean(F.col("d") >= 5, 2).alias("e"))
    rule = F.when((F.col("w") <= 0) | (F.col("e") <= 0), None).when(F.col("w") > 2 * F.col("e"), "weekdays").when(F.col("e") > 0.8 * F.col("w"), "all week")
    return one.select("busiest", "quietest", "uneven", F.round("w", 3).alias("weekday_average"), F.round("e", 3).alias("weekend_average"), rule.alias("rule"))


def group_balance(spans: DataFrame, a: list[str], b: list[str], n: int = 10, app: str = "app_id") -> DataFrame:
    """Of the `n` apps of most minutes the ratio of group `a` to group `b`: above 3 the first, below 0.5 the second."""
    top = spans.groupBy(F.col(app).alias("app")).agg(F.sum(F.expr(MINUTES)).alias("m")).orderBy(F.col("m").desc(), "app").limit(n)
    part = lambda names: F.coalesce(F.sum(F.when(F.col("app").isin(names), F.col("m"))), F.lit(0.0))
    one = top.agg(F.max_by("app", F.struct("m", "app")).alias("top_app"), (F.max("m") / F.sum("m")).alias("s"), part(a).alias("a"), part(b).alias("b"))
    ratio = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") / F.col("b"))
    rule = F.when(ratio > 3, "first").when(ratio < 0.5, "second")
    return one.select("top_app", F.round("s", 4).alias("share"), (F.col("s") > 0.2).alias("is_pattern"), F.round(ratio, 3).alias("ratio"), rule.alias("rule"))


def focus_summary(sessions: DataFrame, days: int, key: str = "user_id") -> DataFrame:
    """Per key the focus sessions a day and their mean minutes; a rule holds from 1 a day and from 45 minutes."""
    per_day, mean = F.count("*") / days, F.avg("minutes")
    return sessions.groupBy(key).agg(F.round(per_day, 4).alias("per_day"), F.round(mean, 3).alias("mean_minutes"), (per_day >= 1).alias("often"), (mean >= 45).alias("long"))


def media_hours(spans: DataFrame, key: str = "user_id", media: str = "media") -> DataFrame:
    """Seconds of each medium per key and hour, of spans already merged, each clipped to the hours it touches."""
    first, last = F.date_trunc("hour", "start_ts"), F.date_trunc("hour", F.col("end_ts") - F.expr("interval 1 microsecond"))
    rows = spans.where("end_ts > start_ts").withColumn("hour", F.explode(F.sequence(first.cast("timestamp_ntz"), last.cast("timestamp_ntz"), F.expr("interval 1 hour"))))
    a, b = F.greatest(F.col("start_ts").cast("timestamp_ntz"), "hour"), F.least(F.col("end_ts").cast("timestamp_ntz"), F.col("hour") + F.expr("interval 1 hour"))
    clipped = rows.select(key, "hour", F.col(media).alias("media"), a.alias("a"), b.alias("b"))
    seconds = F.expr("timestampdiff(MICROSECOND, a, b) / 1e6")
    return clipped.groupBy(key, "hour", "media").agg(F.round(F.sum(seconds), 3).alias("seconds"))


def aggregates_for_day(agg: DataFrame, day: str) -> DataFrame:
    """All aggregates of one day, by type, the largest first within it."""
    rank = F.row_number().over(Window.partitionBy("key_type").orderBy(F.col("value").desc(), "key"))
    return agg.where(F.col("day") == F.lit(day).cast("date")).select("key_type", "key", "value", rank.cast("long").alias("rank"))


def app_usage_until(spans: DataFrame, now: str, n: int = 10, app: str = "app_id") -> DataFrame:
    """Minutes, sessions and share per app, where a span that is still open lasts until `now` (0 if it starts later)."""
    end = F.coalesce("end_ts", F.greatest(F.col("start_ts"), F.lit(now).cast("timestamp_ntz")))
    closed = spans.withColumn("end_ts", end)
    top = closed.groupBy(F.col(app).alias("app")).agg(F.sum(F.expr(MINUTES)).alias("m"), F.count("*").alias("sessions")).orderBy(F.col("m").desc(), "app").limit(n)
    share = F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1))) * 100
    return top.select("app", F.round("m", 3).alias("minutes"), "sessions", F.round(share, 3).alias("share"))


def entity_rollup(notes: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Minutes of the notes that name an entity, by day and `entity:<type>`; the notes' own lengths, no double counting."""
    minutes = F.expr(MINUTES)
    rows = links.select("note_id", "entity_id").distinct().join(notes.select("note_id", "start_ts", "end_ts"), "note_id").join(entities.select("entity_id", "entity_type", "canonical_name"), "entity_id")
    kind = F.concat(F.lit("entity:"), F.lower("entity_type"))
    return rows.groupBy(F.to_date("start_ts").alias("day"), kind.alias("key_type"), F.col("canonical_name").alias("key")).agg(F.round(F.sum(minutes), 4).alias("value"))


def media_rollup(activities: DataFrame) -> DataFrame:
    """Minutes by day of the artist and of the track of media named `artist - track`."""
    parts = F.split("media", " - ", 2)
    kinds = F.explode(F.array(F.struct(F.lit("artist").alias("key_type"), parts[0].alias("key")), F.struct(F.lit("track").alias("key_type"), F.get(parts, F.lit(1)).alias("key"))))
    return activities.where("media is not null").select("day", "minutes", kinds.alias("x")).where("x.key <> ''").groupBy("day", "x.key_type", "x.key").agg(F.round(F.sum("minutes"), 4).alias("value"))


def edges_at(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges valid at some time in [a, b]; an unknown start or end is open."""
    lo, hi = F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")
    begins, ends = F.col("start_ts").cast("timestamp_ntz"), F.col("end_ts").cast("timestamp_ntz")
    return edges.where((begins.isNull() | (begins <= hi)) & (ends.isNull() | (ends >= lo)))


def edges_of_range(edges: DataFrame, ids: DataFrame, a: str, b: str, **how) -> DataFrame:
    """J11 with its time filter."""
    return edges_for(edges_at(edges, a, b), ids, **how)


def expand_in_range(seeds: DataFrame, edges: DataFrame, a: str, b: str, **how) -> DataFrame:
    """G04 over the edges of a range of time."""
    return expand(seeds, edges_at(edges, a, b), **how)


def notes_for_entities(found: DataFrame, links: DataFrame, notes: DataFrame, n: int = 20) -> DataFrame:
    """Notes that name any of the entities: greatest strength first, then the newest."""
    strong = links.join(found.select("entity_id"), "entity_id", "left_semi").groupBy("note_id").agg(F.max("strength").alias("strength"))
    return strong.join(notes.select("note_id", "start_ts"), "note_id").orderBy(F.col("strength").desc(), F.col("start_ts").desc(), "note_id").limit(n)


def co_occurrences(seeds: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """Entities one edge of co-occurrence away from the seeds."""
    return expand(seeds, edges, hops=1, n=n, types=["CO_OCCURRED_WITH"])


def entity_card(entity, entities: DataFrame, edges: DataFrame, links: DataFrame, notes: DataFrame, n: int = 10) -> DataFrame:
    """One entity as rows `(section, rank, item, value)`: its info, heaviest edges either way, newest notes."""
    item = lambda df, section, order, name, value: df.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), name.cast("string").alias("item"), value.cast("double").alias("value")).where(F.col("rank") <= n)
    this = F.lit(entity)
    info = entities.where(F.col("entity_id") == this).select(F.lit("info").alias("section"), F.lit(1).cast("long").alias("rank"), F.concat_ws("|", "entity_type", "canonical_name").alias("item"), F.lit(None).cast("double").alias("value"))
    heavy = lambda c, other, section: item(edges.where(F.col(c) == this), section, [F.col("weight").desc(), other, "edge_type"], F.concat_ws("|", F.col(other).cast("string"), "edge_type"), F.col("weight"))
    named = links.where(F.col("entity_id") == this).join(notes.select("note_id", "start_ts"), "note_id")
    latest = item(named, "notes", [F.col("start_ts").desc(), "note_id"], F.col("note_id"), F.col("strength"))
    return info.union(heavy("from_id", "to_id", "outgoing")).union(heavy("to_id", "from_id", "incoming")).union(latest)


def missing_files(notes: DataFrame, rendered: DataFrame, key: str = "note_id") -> DataFrame:
    """Per day the notes without a rendered row."""
    return notes.join(rendered.select(key), key, "left_anti").groupBy(F.to_date("start_ts").alias("day")).agg(F.count("*").alias("missing_file"))


def foreign_keys(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per rule the rows whose key is set and isn't in the table that it points to."""
    out = None
    for name, (child, c, parent, p) in checks.items():
        lost = child.where(F.col(c).isNotNull()).join(parent.select(F.col(p).alias(c)), c, "left_anti")
        one = lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


