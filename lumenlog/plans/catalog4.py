"""Registered queries of the forms for large keys and of tables kept up by increments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import entities as E
from lumenlog.operators import graph as G
from lumenlog.operators import incremental as N
from lumenlog.operators import intervals as I
from lumenlog.operators import joins as J
from lumenlog.operators import rollups as A
from lumenlog.operators import spans as W
from lumenlog.operators.name_index import NameIndex
from lumenlog.operators.payload import tag_documents
from lumenlog.operators.segments import scan
from lumenlog.plans import base as B
from lumenlog.plans.catalog import ORACLES as FIRST_SQL
from lumenlog.plans.catalog2 import ORACLES as SECOND_SQL
from lumenlog.plans.catalog2 import _rollup as rollup
from lumenlog.plans.base import with_
from lumenlog.plans.catalog_streams import _shared as scratch
from lumenlog.plans.catalog_streams import drain
from lumenlog.sources.merge_table import MergeTable, hash_bucket, keep_latest
from lumenlog.streaming import streams as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_GAP_SPANS = with_("samples") + """, l AS (
  SELECT *, lag(app_id) OVER w AS papp, lag(ts) OVER w AS pts, lead(ts) OVER w AS nts FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), f AS (
  SELECT *, CASE WHEN pts IS NULL OR app_id IS DISTINCT FROM papp OR ts - pts > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS starts FROM
    (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS window_title, CAST(NULL AS VARCHAR) AS url) FROM l)
), g AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM f
)"""


@query(
    "w01_build_spans_gap",
    _GAP_SPANS
    + """ SELECT user_id, min(ts) AS start_ts, any_value(app_id) AS app_id, count(*) AS n_samples,
  arg_max(CASE WHEN nts IS NULL OR nts - ts > INTERVAL 2 HOUR THEN ts ELSE nts END, struct_pack(t := ts, e := event_id)) AS end_ts
  FROM g GROUP BY user_id, span""",
)
def w01_gap(spark, d):
    """W01 with `max_gap`: a silence of more than two hours ends a span."""
    rows = B.samples(spark, d).withColumns({"window_title": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    out = W.build_spans(rows, max_gap=7200)
    return out.select("user_id", "start_ts", "app_id", "n_samples", "end_ts")


@query(
    "w05_focus_sessions_gap",
    with_("samples")
    + """, s AS (SELECT *, ts AS start_ts, ts + INTERVAL 30 MINUTE AS end_ts FROM samples), c AS (
  SELECT *, CASE WHEN start_ts - lag(end_ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE coalesce(CAST(app_id <> lag(app_id) OVER w AS INT), 1) END AS ch
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id)
), i AS (
  SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS island FROM c
) SELECT user_id, app_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, round(count(*) * 30.0, 4) AS minutes, count(*) AS n_spans
FROM i GROUP BY user_id, island, app_id HAVING count(*) >= 2""",
)
def w05_gap(spark, d):
    """W05 with `max_gap` over half-hour spans: runs of an hour or more without a break of over two hours."""
    rows = B.samples(spark, d).withColumns({"start_ts": F.col("ts"), "end_ts": F.col("ts") + F.expr("interval 30 minutes")})
    out = W.focus_sessions(rows, ["user_id"], minutes=60, max_gap=7200)
    return out.select("user_id", "app_id", "start_ts", "end_ts", F.round("minutes", 4).alias("minutes"), "n_spans")


_HOURS = with_("samples") + ", t AS (SELECT event_id, user_id, date_trunc('day', ts) AS slot, ts, k * 40 AS tok FROM samples)"


def _slots(spark, d):
    """Samples with tokens, keyed by user and day: many short keys, as the budget of a summary has them."""
    slot = F.date_trunc("day", "ts").cast("timestamp_ntz")
    rows = B.samples(spark, d).select("event_id", "user_id", slot.alias("slot"), "ts", (F.col("k") * 40).alias("token_estimate"))
    return rows.withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), F.col("slot").cast("string")))


@query(
    "w07_budget_by_user_day",
    _HOURS
    + """, c AS (SELECT *, least(tok, 500) AS cap, coalesce(sum(least(tok, 500)) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t)
SELECT event_id, CAST(least(cap, 900 - spent) AS BIGINT) AS used_tokens FROM c WHERE NOT (spent >= 900 OR (spent + cap > 900 AND 900 - spent < 100))""",
)
def w07_slots(spark, d):
    return W.budget_snippets(_slots(spark, d), "key", ["ts", "event_id"], budget=900).select("event_id", "used_tokens")


@query(
    "w08_prefix_by_user_day",
    _HOURS + " SELECT * FROM (SELECT event_id, CAST(sum(tok) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) AS BIGINT) AS running_tokens FROM t) WHERE running_tokens <= 900",
)
def w08_slots(spark, d):
    return W.budget_prefix(_slots(spark, d), "key", ["ts", "event_id"], budget=900).select("event_id", "running_tokens")


# Kept up by increments: the table's rows come in three batches, dealt by a hash, so that each batch has rows of all days.


def _batches(df, *by):
    part = F.pmod(F.xxhash64(*by), F.lit(3))
    return [df.where(part == i) for i in range(3)]


@query("a06_incremental_rollup", with_("rollup") + " SELECT CAST(day AS VARCHAR) AS day, key_type, key, value FROM agg")
def a06_incremental(spark, d):
    table = N.daily_table(spark, f"{scratch(spark)}/daily")
    for i, rows in enumerate(_batches(B.activities(spark, d), "day", "app", "topic", "minutes", "confidence")):
        N.add_activities(table, rows, i)
    return table.read().select(F.col("day").cast("string").alias("day"), "key_type", "key", F.round("value", 4).alias("value"))


@query(
    "a09_incremental_periods",
    with_("rollup")
    + """, u AS (SELECT unnest(['week', 'month', 'year']) AS period_type) SELECT period_type, CAST(CAST(date_trunc(period_type, day) AS DATE) AS VARCHAR) AS period_start,
  key_type, key, round(sum(value), 2) AS value FROM agg, u GROUP BY ALL""",
)
def a09_incremental(spark, d):
    root = scratch(spark)
    daily, periods = N.daily_table(spark, f"{root}/daily"), N.period_table(spark, f"{root}/periods")
    for i, rows in enumerate(_batches(B.activities(spark, d), "day")):  # whole days: each batch touches some periods
        N.add_activities(daily, rows, i)
        N.refresh_periods(daily, periods, i, i - 1)
    return periods.read().select("period_type", F.col("period_start").cast("string").alias("period_start"), "key_type", "key", F.round("value", 2).alias("value"))


@query("a33_incremental_trend", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, count(DISTINCT event_type) AS apps FROM events GROUP BY 1")
def a33_incremental(spark, d):
    table = N.trend_table(spark, f"{scratch(spark)}/trend")
    for i, rows in enumerate(_batches(B.samples(spark, d), "event_id")):
        N.add_events(table, rows, i)
    return N.trend(table).withColumn("day", F.col("day").cast("string"))


@query(
    "s03_merge_table",
    "SELECT user_id, event_type AS app_id, max(ts) AS ts, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2",
)
def s03_merge(spark, d):
    """S03 kept up in eight batches, which is enough for buckets to be folded."""
    table = MergeTable(spark, f"{scratch(spark)}/latest", keep_latest(["user_id", "app_id"], ["ts", "event_id"]), hash_bucket(["user_id"], 8))
    rows = B.samples(spark, d).select("user_id", "app_id", "ts", "event_id")
    for i in range(8):
        table.apply(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(8)) == i), i)
    return table.read()


# Joins for intervals of any length, edits, groups and supports.


@query(
    "j14_overlap_any_length",
    with_("spans")
    + """ SELECT x.user_id, x.event_id AS a_id, y.event_id AS b_id,
  CAST(epoch_us(least(x.end_ts, y.end_ts)) // 1000000 - epoch_us(greatest(x.start_ts, y.start_ts)) // 1000000 AS BIGINT) AS seconds
FROM (SELECT user_id, event_id, start_ts, end_ts FROM spans WHERE app_id = 'click') x
JOIN (SELECT user_id, event_id, start_ts, start_ts + INTERVAL 1 HOUR * (k % 7 * 20) AS end_ts FROM spans WHERE app_id = 'view') y
  ON x.user_id = y.user_id AND x.start_ts < y.end_ts AND y.start_ts < x.end_ts""",
)
def j14_long(spark, d):
    """J14 with spans of up to five days on one side."""
    s = B.spans(spark, d).withColumnRenamed("event_id", "id")
    long = s.where("app_id = 'view'").withColumn("end_ts", F.expr("start_ts + make_interval(0, 0, 0, 0, int(k % 7 * 20))"))
    return I.overlap_join(s.where("app_id = 'click'"), long, "user_id")


@query(
    "j01_points_in_long_spans",
    with_("samples")
    + """, s AS (SELECT user_id, event_id AS span_id, ts AS start_ts, ts + INTERVAL 1 HOUR * (k % 7 * 20) AS end_ts FROM samples WHERE app_id = 'purchase')
SELECT p.event_id, coalesce(s.span_id, -1) AS span_id FROM samples p LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.start_ts AND p.ts < s.end_ts""",
)
def j01_long(spark, d):
    """J01 with spans of none to five days from every purchase on."""
    p = B.samples(spark, d)
    s = p.where("app_id = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start_ts"), F.expr("ts + make_interval(0, 0, 0, 0, int(k % 7 * 20))").alias("end_ts"))
    return I.points_in_intervals(p.select("user_id", "event_id", "ts"), s, "user_id").select("event_id", F.coalesce("span_id", F.lit(-1)).alias("span_id"))


@query(
    "j12_names_within_edits",
    """WITH n AS (SELECT DISTINCT p_brand AS entity_type, lower(p_name) AS name FROM part)
SELECT a.entity_type, a.name AS name_a, b.name AS name_b, CAST(levenshtein(a.name, b.name) AS INT) AS distance
FROM n a JOIN n b ON a.entity_type = b.entity_type AND a.name < b.name WHERE levenshtein(a.name, b.name) <= 3""",
)
def j12_edits(spark, d):
    return J.levenshtein_pairs(B.read(spark, d, "part").select(F.col("p_brand").alias("entity_type"), F.col("p_name").alias("name")), 3)


@query("e05_greedy_groups")
def e05_greedy(spark, d):
    """E05 by leaders; SQL has no loop over entities in order, `tests/test_joins_at_scale.py` has."""
    return J.greedy_groups(B.entities(spark, d)).select("group_id", "entity_id")


@query(
    "g02_cooccurrence_support",
    with_("links")
    + """, c AS (SELECT a.entity_id AS from_id, b.entity_id AS to_id, count(*) AS support FROM links a JOIN links b ON a.note_id = b.note_id AND a.entity_id < b.entity_id
  GROUP BY 1, 2 HAVING count(*) >= 2) SELECT from_id, to_id, support, round(support / (SELECT max(support) FROM c), 6) AS weight FROM c""",
)
def g02_support(spark, d):
    return G.cooccurrence_edges(B.links(spark, d), min_support=2)


# Streams over several files.


FILE_ROWS = 500_000


def _files(df: DataFrame, n: int = 4) -> DataFrame:
    """A stream of `df` in `n` batches by time, each of as many files as its rows need, which are read together."""
    spark = df.sparkSession
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    about = df.select(F.percentile_approx(at, [i / n for i in range(1, n)]).alias("q"), F.count("*").alias("n")).first()
    path, ends = scratch(spark), about["q"] or []
    files = max(1, about["n"] // (n * FILE_ROWS)) if len(set(ends)) == n - 1 else 1  # empty batches would write fewer files
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = df if low is None else df.where(at > low)
        part = part if high is None else part.where(at <= high)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "st2_stream_drop_dups_in_order",
    with_("frames")
    + f""", n AS (SELECT event_id, ts, fingerprint, lag(fingerprint) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM frames)
SELECT event_id, p IS NOT NULL AND substr(fingerprint, 1, 63) = substr(p, 1, 63) AS is_dup FROM n WHERE ts <= {_MARK}""",
)
def st2_order(spark, d):
    """ST2 by event time: what W03 says of all frames that the watermark has passed."""
    return drain(T.stream_drop_dups(_files(B.frames(spark, d).select("user_id", "ts", "event_id", "fingerprint")), delay="1 hour")).select("event_id", "is_dup")


@query(
    "st3_stream_hourly_tokens",
    f"""SELECT hour, app_id, events, tokens FROM (SELECT date_trunc('hour', ts) AS hour, event_type AS app_id, count(*) AS events,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= {_MARK}""",
)
def st3_tokens(spark, d):
    out = drain(T.stream_hourly(_files(B.samples(spark, d).select("ts", "app_id", "k")), tokens="k"))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "app_id", "events", "tokens")


@query(
    "st5_stream_redact",
    with_("samples")
    + """ SELECT event_id, CASE WHEN blocked_reason IS NULL THEN url END AS url, blocked_reason FROM (
  SELECT *, CASE WHEN app_id = 'click' THEN 'app: click' WHEN k % 4 = 0 THEN 'domain: s0.example.com' END AS blocked_reason FROM samples)""",
)
def st5_redact(spark, d):
    """ST5: events of blocked apps and domains are kept, with the reason and without their address."""
    rows = B.samples(spark, d).withColumn("domain", F.concat(F.lit("www.s"), (F.col("k") % 4).cast("string"), F.lit(".example.com")))
    apps = B.read(spark, d, "events").where("event_type = 'click'").select(F.lit("app").alias("block_type"), F.col("event_type").alias("pattern"), F.lit(True).alias("enabled")).distinct()
    blocked = apps.unionByName(apps.select(F.lit("domain").alias("block_type"), F.lit("S0.example.com").alias("pattern"), "enabled"))
    return drain(T.stream_redact(_files(rows), blocked)).select("event_id", "url", "blocked_reason")


@query(
    "st6_stream_frame_span_left",
    f"""WITH s AS (SELECT user_id, event_id AS span_id, ts AS start_ts, ts + INTERVAL 30 MINUTE AS end_ts FROM events WHERE event_type = 'purchase')
SELECT f.event_id AS frame_id, coalesce(s.span_id, -1) AS span_id FROM events f LEFT JOIN s ON f.user_id = s.user_id AND f.ts >= s.start_ts AND f.ts < s.end_ts
WHERE s.span_id IS NOT NULL OR f.ts < {_MARK.replace('1 HOUR', '4 HOUR')}""",
)
def st6_left(spark, d):
    """ST6 left outer: frames without a span within reach; of the last hours only what has met one, as their watermark isn't due."""
    e = B.samples(spark, d).select("user_id", "event_id", "ts", "app_id")
    last = e.agg(F.max("ts").alias("m"))
    spans = _files(e.where("app_id = 'purchase'")).select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 30 minutes")).alias("end_ts"))
    out = drain(T.stream_frame_span_join(_files(e).withColumnRenamed("event_id", "frame_id"), spans, how="left_outer"))
    due = e.join(last, F.col("ts") < F.col("m") - F.expr("interval 4 hours"), "left_semi").select(F.col("event_id").alias("frame_id"))
    alone = out.where("span_id is null").join(due, "frame_id", "left_semi")
    return out.where("span_id is not null").unionByName(alone).select("frame_id", F.coalesce("span_id", F.lit(-1)).alias("span_id"))


@query(
    "st8_stream_throttle",
    with_("samples")
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 21600000000 ORDER BY ts, event_id) AS i FROM samples)
SELECT * EXCLUDE (ts) FROM (SELECT event_id, ts, last_value(CASE WHEN i = 1 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS carried FROM r)
WHERE ts <= {_MARK}""",
)
def st8_stream(spark, d):
    """ST8 as a stream: readings at most each six hours."""
    return drain(T.stream_throttle(_files(B.samples(spark, d).select("user_id", "ts", "event_id", "value")), 6 * 3600, delay="1 hour")).select("event_id", "carried")


# Whole results of keyed merges, edges by name and ingestion.


def _chain(spark, d):
    """Normalizations of ids: those ending in 3 to 7, those ending in 7 to 1."""
    ids = B.entities(spark, d).select("entity_id")
    last = F.col("entity_id") % 10
    return ids.where(last == 3).select(F.col("entity_id").alias("variant"), (F.col("entity_id") + 4).alias("canonical")).union(ids.where(last == 7).select("entity_id", F.col("entity_id") - 6))


_INTO = "CASE WHEN {0} % 10 IN (3, 7) AND {0} IN (SELECT entity_id FROM entities) THEN {0} - {0} % 10 + 1 ELSE {0} END"


@query(
    "e04_normalized_entities",
    with_("entities")
    + f""", m AS (SELECT *, {_INTO.format("entity_id")} AS dest FROM entities), a AS (
  SELECT DISTINCT dest, unnest(list_concat(aliases, CASE WHEN entity_id <> dest THEN [canonical_name] ELSE [] END)) AS n FROM m
), l AS (SELECT dest, string_agg(n, ',' ORDER BY n) AS aliases FROM a GROUP BY dest)
SELECT m.dest AS entity_id, max(CASE WHEN entity_id = m.dest THEN entity_type END) AS entity_type, max(CASE WHEN entity_id = m.dest THEN canonical_name END) AS canonical_name,
  any_value(l.aliases) AS aliases FROM m JOIN l ON l.dest = m.dest GROUP BY m.dest""",
)
def e04_entities(spark, d):
    kept = E.apply_normalizations(_chain(spark, d), B.entities(spark, d), B.links(spark, d), B.edges(spark, d))[0]
    return kept.withColumn("aliases", F.array_join("aliases", ","))


@query(
    "e04_normalized_edges",
    with_("entities", "edges")
    + f""", m AS (SELECT {_INTO.format("from_id")} AS from_id, {_INTO.format("to_id")} AS to_id, edge_type, weight FROM edges)
SELECT from_id, to_id, edge_type, max(weight) AS weight FROM m WHERE from_id <> to_id GROUP BY ALL""",
)
def e04_edges(spark, d):
    return E.apply_normalizations(_chain(spark, d), B.entities(spark, d), B.links(spark, d), B.edges(spark, d), of=B.read(spark, d, "lineitem"))[2]


def _proposals(spark, d):
    """Edges by names: of a part and of its type (an alias), some of them of nobody."""
    part = B.read(spark, d, "part").select(F.col("p_partkey").alias("from_id"), "p_name", "p_type")
    rows = B.edges(spark, d).join(part, "from_id")
    to = F.when(F.col("to_id") % 4 == 0, F.concat(F.lit("nobody "), (F.col("to_id") % 3).cast("string"))).otherwise(F.col("p_type"))
    return rows.select(F.upper("p_name").alias("from_name"), to.alias("to_name"), "edge_type", "weight", F.array(F.col("to_id").cast("string")).alias("evidence"), "start_ts", "end_ts")


_PROPOSED = (
    with_("entities", "edges")
    + """, p AS (SELECT lower(p_name) AS from_name, CASE WHEN to_id % 4 = 0 THEN 'nobody ' || CAST(to_id % 3 AS VARCHAR) ELSE p_type END AS to_name, edge_type, weight, start_ts, end_ts
  FROM edges JOIN part ON p_partkey = from_id
), k AS (SELECT lower(canonical_name) AS name, 0 AS r, entity_id FROM entities UNION ALL SELECT lower(aliases[1]), 1, entity_id FROM entities
), ids AS (SELECT name, arg_min(entity_id, struct_pack(r := r, e := entity_id)) AS entity_id FROM k GROUP BY name
), x AS (SELECT p.*, a.entity_id AS from_id, b.entity_id AS to_id FROM p LEFT JOIN ids a ON a.name = lower(p.from_name) LEFT JOIN ids b ON b.name = lower(p.to_name))"""
)


@query("g01_edges_by_name", _PROPOSED + " SELECT from_id, to_id, edge_type, max(weight) AS weight, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM x WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY 1, 2, 3")
def g01_names(spark, d):
    return G.build_edges(_proposals(spark, d), B.entities(spark, d))[0].select("from_id", "to_id", "edge_type", "weight", "start_ts", "end_ts")


@query("g01_unresolved_names", _PROPOSED + " SELECT from_name, to_name, edge_type, count(*) AS n FROM x WHERE from_id IS NULL OR to_id IS NULL GROUP BY 1, 2, 3")
def g01_unresolved(spark, d):
    rows = G.build_edges(_proposals(spark, d), B.entities(spark, d))[1]
    return rows.groupBy(F.lower("from_name").alias("from_name"), "to_name", "edge_type").agg(F.count("*").alias("n"))


@query(
    "a34_ingest_stats_whole",
    with_("samples")
    + """, l AS (SELECT *, lag(app_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM samples)
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS captured, count(*) FILTER (k % 4 = 0) AS duplicates, count(*) FILTER (app_id = 'click') AS blocked, CAST(sum(k) AS BIGINT) AS tokens,
  count(*) FILTER (app_id IS DISTINCT FROM before) AS spans_created, count(*) FILTER (k % 3 = 0) AS documents_detected FROM l GROUP BY 1, 2""",
)
def a34_whole(spark, d):
    """A34 with spans that start, found by a segmented scan, and documents, told by their titles."""
    rows = scan(B.samples(spark, d), ["user_id"], ["ts", "event_id"], lag={"before": "app_id"})
    rows = rows.withColumns({"is_dup": F.col("k") % 4 == 0, "is_blocked": F.col("app_id") == "click", "tokens": F.col("k"), "starts_span": ~F.col("app_id").eqNullSafe(F.col("before"))})
    title = F.when(F.col("k") % 3 == 0, F.concat(F.lit("report "), F.col("k").cast("string"), F.lit(".pdf"))).otherwise("a page")
    return A.ingest_stats(tag_documents(rows.withColumn("window_title", title))).withColumn("day", F.col("day").cast("string"))


def _entity_index(spark: SparkSession, d: str) -> NameIndex:
    entities = B.entities(spark, d)
    names = entities.withColumn("name", F.explode(F.concat(F.array("canonical_name"), "aliases")))
    return NameIndex(spark, f"{scratch(spark)}/entity-names-{uuid.uuid4().hex}").build(names, "name", "entity_id", "canonical_name")


@query("j04_resolve_by_index", FIRST_SQL["j04_resolve_contains"])
def j04_by_index(spark, d):
    asked = B.read(spark, d, "part").select(F.split("p_name", " ")[0].alias("name"))
    return _entity_index(spark, d).held(asked, "name").select("name", "entity_id").distinct()


@query("e06_search_by_index", SECOND_SQL["e06_search_entities"])
def e06_by_index(spark, d):
    found = _entity_index(spark, d).search("Red").select("entity_id", "canonical_name").distinct()
    return found.orderBy("canonical_name", "entity_id").limit(20)


@query("a13_search_by_index", SECOND_SQL["a13_search_aggregates"])
def a13_by_index(spark, d):
    agg = rollup(spark, d)
    keys = agg.select("key_type", "key").distinct()
    index = NameIndex(spark, f"{scratch(spark)}/aggregate-keys-{uuid.uuid4().hex}").build(keys, "key", "key_type", "key")
    return A.sum_of_keys(agg, index.search("C"))
