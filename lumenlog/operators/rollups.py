"""Aggregations, rollups and reports over spans, notes and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTES = "timestampdiff(MICROSECOND, start_ts, end_ts) / 6e7"


def hhmm_minutes(start: Column, end: Column) -> Column:
    """Minutes from HH:MM to HH:MM, past midnight if the end is before the start; 0 if either can't be read."""
    ok = start.rlike(r"^\d{1,2}:\d{1,2}$") & end.rlike(r"^\d{1,2}:\d{1,2}$")
    value = lambda c: F.regexp_extract(c, r"^(\d{1,2}):", 1).cast("int") * 60 + F.regexp_extract(c, r":(\d{1,2})$", 1).cast("int")
    diff = F.when(ok, value(end) - value(start))
    return F.coalesce(F.when(diff < 0, diff + 1440).otherwise(diff), F.lit(0)).cast("double")


def daily_rollup(activities: DataFrame, top: int | None = 20) -> DataFrame:
    """`(day, key_type, key, value)` from rows `(day, category, app, domain, topic, confidence, media, minutes)`.

    One exploded table and one aggregation: minutes for category, app and media, visits for domain, confidence*60 for
    topics; the `top` keys of each type and day (categories all)."""
    entry = lambda kind, key, value: F.struct(F.lit(kind).alias("key_type"), F.col(key).alias("key"), value.cast("double").alias("value"))
    items = F.array(entry("category", "category", F.col("minutes")), entry("app", "app", F.col("minutes")), entry("domain", "domain", F.lit(1)), entry("topic", "topic", F.coalesce("confidence", F.lit(0.5)) * 60), entry("media", "media", F.col("minutes")))
    long = activities.select("day", F.explode(items).alias("x")).select("day", "x.*").where("key is not null and key <> ''")
    out = long.groupBy("day", "key_type", "key").agg(F.round(F.sum("value"), 4).alias("value"))
    if top is None:
        return out
    w = Window.partitionBy("day", "key_type").orderBy(F.col("value").desc(), "key")
    return out.withColumn("rank", F.row_number().over(w)).where((F.col("key_type") == "category") | (F.col("rank") <= top)).drop("rank")


def merge_rollups(computed: DataFrame, curated: DataFrame, mode: str = "precedence") -> DataFrame:
    """Curated values replace computed ones of the same (day, key_type, key), or add to them."""
    both = computed.withColumn("source", F.lit(0)).unionByName(curated.withColumn("source", F.lit(1)))
    keys = ["day", "key_type", "key"]
    return both.groupBy(*keys).agg((F.sum("value") if mode == "additive" else F.max_by("value", "source")).alias("value"))


def rollup_periods(daily: DataFrame) -> DataFrame:
    """Week, month and year sums of a daily rollup, in one pass."""
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("period_type"), F.to_date(F.date_trunc(u, "day")).alias("period_start")) for u in ("week", "month", "year")])).alias("p")
    return daily.select("key_type", "key", "value", units).groupBy("p.period_type", "p.period_start", "key_type", "key").agg(F.round(F.sum("value"), 4).alias("value"))


def top_by_key_type(agg: DataFrame, key_type: str, n: int, a: str | None = None, b: str | None = None) -> DataFrame:
    """The `n` keys of a type with the largest sums, over periods that touch [a, b], with the total of those."""
    rows = agg.where(F.col("key_type") == key_type)
    if a:
        rows = rows.where((F.col("day") >= F.lit(a).cast("date")) & (F.col("day") <= F.lit(b).cast("date")))
    top = rows.groupBy("key").agg(F.round(F.sum("value"), 4).alias("value"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).orderBy(F.col("value").desc(), "key").limit(n)
    return top.withColumn("total", F.round(F.sum("value").over(Window.partitionBy(F.lit(1))), 3))


def time_for_key(agg: DataFrame, key: str) -> DataFrame:
    """Sums per key type of one key, ignoring case."""
    return agg.where(F.lower("key") == key.lower()).groupBy("key_type").agg(F.round(F.sum("value"), 4).alias("value"))


def search_aggregates(agg: DataFrame, part: str) -> DataFrame:
    """Sums of keys that hold a text, ignoring case (no wildcards)."""
    return agg.where(F.lower("key").contains(part.lower())).groupBy("key_type", "key").agg(F.round(F.sum("value"), 4).alias("value"))


def sum_of_keys(agg: DataFrame, keys: DataFrame) -> DataFrame:
    """A13 with the `(key_type, key)` that an index found."""
    rows = agg.join(keys.select("key_type", "key").distinct(), ["key_type", "key"], "left_semi")
    return rows.groupBy("key_type", "key").agg(F.round(F.sum("value"), 4).alias("value"))


def period_summary(agg: DataFrame, top: int = 5) -> DataFrame:
    """The `top` keys of each type with the type's total."""
    sums = agg.groupBy("key_type", "key").agg(F.sum("value").alias("v"))
    w = Window.partitionBy("key_type")
    ranked = sums.withColumns({"rank": F.row_number().over(w.orderBy(F.col("v").desc(), "key")), "t": F.sum("v").over(w)})
    return ranked.where(F.col("rank") <= top).select("key_type", "key", F.col("rank").cast("long").alias("rank"), F.round("v", 3).alias("value"), F.round("t", 2).alias("type_total"))


def compare_periods(agg: DataFrame, a: tuple[str, str], b: tuple[str, str], n: int = 5) -> DataFrame:
    """Per key type the top keys of two ranges of days: only_a, only_b or both, with the change in value."""

    def top(r: tuple[str, str], name: str) -> DataFrame:
        sums = agg.where(F.col("day").between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))).groupBy("key_type", "key").agg(F.round(F.sum("value"), 3).alias(name))
        return sums.withColumn("rank", F.row_number().over(Window.partitionBy("key_type").orderBy(F.col(name).desc(), "key"))).where(F.col("rank") <= n).drop("rank")

    both = top(a, "value_a").join(top(b, "value_b"), ["key_type", "key"], "full_outer")
    status = F.when(F.col("value_b").isNull(), "only_a").when(F.col("value_a").isNull(), "only_b").otherwise("both")
    delta = F.round(F.coalesce("value_b", F.lit(0.0)) - F.coalesce("value_a", F.lit(0.0)), 2)
    return both.select("key_type", "key", status.alias("status"), "value_a", "value_b", delta.alias("delta"))


def app_usage(spans: DataFrame, n: int = 10, app: str = "app_id") -> DataFrame:
    """Minutes and sessions per app, with each one's share of the top-n total."""
    top = spans.groupBy(F.col(app).alias("app")).agg(F.sum(F.expr(MINUTES)).alias("m"), F.count("*").alias("sessions")).orderBy(F.col("m").desc(), "app").limit(n)
    share = F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1))) * 100
    return top.select("app", F.round("m", 3).alias("minutes"), "sessions", F.round(share, 3).alias("share"))


def topic_usage(links: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """Distinct notes and summed strength per entity name."""
    rows = links.join(entities, "entity_id").groupBy("canonical_name").agg(F.count_distinct("note_id").alias("notes"), F.round(F.sum("strength"), 3).alias("strength"))
    return rows.orderBy(F.col("notes").desc(), F.col("strength").desc(), "canonical_name").limit(n)


def activity_trend(events: DataFrame, ts: str = "ts", app: str = "app_id", approximate: bool = False) -> DataFrame:
    """Events and distinct apps per day, exact or approximate."""
    distinct = F.approx_count_distinct(app) if approximate else F.count_distinct(app)
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("events"), distinct.alias("apps"))


def heatmap(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events by weekday (Monday 0) and hour, all 168 cells."""
    cells = events.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = events.groupBy(((F.dayofweek(ts) + 5) % 7).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count("*").alias("c"))
    return cells.join(counts, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("c", F.lit(0)).cast("long").alias("events"))


def productivity_summary(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Total minutes, apps, busiest hour (the smallest at a tie), notes and entities, in one row."""
    hours = spans.groupBy(F.hour("start_ts").alias("h")).agg(F.count("*").alias("c")).agg(F.min_by("h", F.struct(-F.col("c"), "h")).alias("busiest_hour"))
    total = spans.agg(F.round(F.sum(F.expr(MINUTES)), 1).alias("total_minutes"), F.count_distinct("app_id").alias("apps"))
    linked = links.agg(F.count_distinct("note_id").alias("notes"), F.count_distinct("entity_id").alias("entities"))
    return total.join(hours, F.lit(True)).join(linked, F.lit(True))


def weekly_digest(spans: DataFrame) -> DataFrame:
    """Per week minutes, apps and spans with the change from the week before and a score; all weeks at once.

    Percent changes divide by at least 0.1; score: min(spans/7/10, 1)*50 + min(hours/7/8, 1)*50."""
    week = F.to_date(F.date_trunc("week", "start_ts"))
    sums = spans.groupBy(week.alias("week")).agg((F.sum(F.expr(MINUTES))).alias("m"), F.count_distinct("app_id").alias("apps"), F.count("*").alias("spans"))
    w = Window.orderBy("week")  # one row a week
    prev = F.when(F.lag("week").over(w) == F.date_sub("week", 7), F.lag("m").over(w))
    before = F.coalesce(prev, F.lit(0.0))
    change = (F.col("m") - before) / F.greatest(before, F.lit(0.1)) * 100
    score = F.least(F.col("spans") / 7 / 10, F.lit(1.0)) * 50 + F.least(F.col("m") / 60 / 7 / 8, F.lit(1.0)) * 50
    return sums.select("week", F.round("m", 2).alias("minutes"), "apps", "spans", F.round(F.col("m") - before, 2).alias("delta_minutes"), F.round(change, 1).alias("change_percent"), F.round(score, 2).alias("score"))


def digest_highlights(digest: DataFrame) -> DataFrame:
    """Sentences that hold for a week."""
    lines = F.array(
        F.when(F.col("change_percent") > 20, F.lit("More activity than the week before")),
        F.when(F.col("change_percent") < -20, F.lit("Less activity than the week before")),
        F.when(F.col("apps") >= 5, F.concat(F.lit("Apps used: "), F.col("apps").cast("string"))),
        F.when(F.col("score") >= 75, F.lit("A productive week")),
    )
    return digest.select("week", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "; ").alias("highlights"))


def time_of_day_patterns(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Share of events by part of the day; a part with more than 0.4 is a pattern of confidence min(share+0.2, 1)."""
    part = F.when(F.hour(ts).between(6, 11), "morning").when(F.hour(ts).between(12, 17), "afternoon").when(F.hour(ts) >= 18, "evening").otherwise("night")
    rows = events.groupBy(part.alias("part")).agg(F.count("*").alias("events"))
    share = F.col("events") / F.sum("events").over(Window.partitionBy(F.lit(1)))
    return rows.select("part", "events", F.round(share, 4).alias("share"), (share > 0.4).alias("is_pattern"), F.round(F.least(share + 0.2, F.lit(1.0)), 4).alias("confidence"))


def day_of_week_patterns(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per active date of each weekday, and whether the busiest has more than 1.3 times the quietest."""
    rows = events.groupBy(((F.dayofweek(ts) + 5) % 7).alias("weekday")).agg((F.count("*") / F.count_distinct(F.to_date(ts))).alias("a"))
    w = Window.partitionBy(F.lit(1))
    return rows.select("weekday", F.round("a", 3).alias("average"), (F.max("a").over(w) > 1.3 * F.min("a").over(w)).alias("uneven"), (F.col("weekday") >= 5).alias("weekend"))


def app_patterns(spans: DataFrame, groups: dict[str, str], app: str = "app_id") -> DataFrame:
    """Minutes and share per app, its group, and whether its share exceeds 0.2."""
    names = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    rows = spans.groupBy(F.col(app).alias("app")).agg(F.sum(F.expr(MINUTES)).alias("m"))
    share = F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))
    return rows.select("app", F.coalesce(names[F.col("app")], F.lit("other")).alias("app_group"), F.round("m", 2).alias("minutes"), F.round(share, 4).alias("share"), (share > 0.2).alias("is_pattern"))


def all_patterns(*patterns: DataFrame, n: int = 3) -> DataFrame:
    """`(pattern, confidence)` of all kinds, the surest first."""
    out = patterns[0]
    for p in patterns[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("confidence").desc(), "pattern").limit(n)


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """Rows by value, with the total under a null key of `is_total`."""
    return df.rollup(col).agg(F.count("*").alias("n"), F.grouping(col).cast("int").alias("is_total"))


def hourly_evidence(clipped: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key and hour the clipped seconds, spans (each once an hour) and sorted distinct apps."""
    return clipped.groupBy(key, "hour").agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.count("*").alias("spans"), F.array_join(F.array_sort(F.collect_set("app_id")), ",").alias("apps"))


def open_loops_summary(loops: DataFrame, now: str) -> DataFrame:
    """Open loops in all, of today, of the last 7 days, and their days."""
    day, today = F.to_date("start_ts"), F.to_date(F.lit(now).cast("timestamp_ntz"))
    return loops.agg(F.count("*").alias("total"), F.count_if(day == today).alias("today"), F.count_if((day > F.date_sub(today, 7)) & (day <= today)).alias("last_7_days"), F.count_distinct(day).alias("days"))


def ingest_stats(samples: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key and day rows captured, duplicates, blocked ones and tokens and, where the flags are given, spans that
    start (`starts_span`) and samples of documents (`is_document`)."""
    more = [F.count_if(c).alias(n) for c, n in (("starts_span", "spans_created"), ("is_document", "documents_detected")) if c in samples.columns]
    return samples.groupBy(key, F.to_date("ts").alias("day")).agg(
        F.count("*").alias("captured"), F.count_if("is_dup").alias("duplicates"), F.count_if("is_blocked").alias("blocked"), F.sum("tokens").cast("long").alias("tokens"), *more
    )
