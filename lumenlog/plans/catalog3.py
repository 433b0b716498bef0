"""Registered queries, continued: whole reports, entity lookups, keyed writes and prebuilt pipelines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import payload as P
from lumenlog.operators import reports as R
from lumenlog.operators import rollups as A
from lumenlog.operators import sets as U
from lumenlog.operators import spans as W
from lumenlog.plans import base as B
from lumenlog.plans import pipelines as L
from lumenlog.plans.base import with_
from lumenlog.plans.catalog2 import _CLIP, _Q, _TREE, MIN, _query_vector, _rollup, _top_cte, _tree
from lumenlog.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query; the columns in `dates` are compared as text."""

    def register(f):
        QUERIES[name] = (lambda spark, d: (lambda out: out.withColumns({c: F.col(c).cast("string") for c in dates}))(f(spark, d))) if dates else f
        if sql:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return register


# --- hourly evidence

_LOCATED = "located AS (SELECT *, CASE WHEN k % 6 <> 0 THEN 'L' || CAST(k % 3 AS VARCHAR) END AS location FROM samples)"


@query(
    "a30_hourly_apps",
    _CLIP
    + """ SELECT user_id, CAST(hour AS TIMESTAMP) AS hour, coalesce(nullif(app_id, ''), 'Unknown') AS app,
    round(sum(seconds), 3) AS seconds, count(*) AS spans FROM c WHERE seconds > 0 GROUP BY 1, 2, 3""",
)
def a30_apps(spark, d):
    return R.hourly_apps(W.clip_to_hours(B.spans(spark, d)))


@query(
    "a30_hourly_counts",
    _CLIP
    + f""", {_LOCATED}, u AS (
  SELECT user_id, CAST(hour AS TIMESTAMP) AS hour, 1 AS s, seconds, 0 AS f, 0 AS t, NULL AS location FROM c WHERE seconds > 0
  UNION ALL SELECT user_id, date_trunc('hour', ts), 0, 0, 1, 0, location FROM located WHERE k % 2 = 0
  UNION ALL SELECT user_id, date_trunc('hour', ts), 0, 0, 0, 1, NULL FROM located WHERE window_title IS NOT NULL)
SELECT user_id, hour, CAST(sum(s) AS BIGINT) AS spans, round(sum(seconds), 3) AS seconds, CAST(sum(f) AS BIGINT) AS frames,
  CAST(sum(t) AS BIGINT) AS texts, coalesce(array_to_string(list_sort(list_distinct(list(location) FILTER (location IS NOT NULL))), ','), '') AS locations
FROM u GROUP BY 1, 2""",
)
def a30_counts(spark, d):
    s = B.samples(spark, d)
    located = s.withColumn("location", F.when(F.col("k") % 6 != 0, F.concat(F.lit("L"), (F.col("k") % 3).cast("string"))))
    return R.hourly_counts(W.clip_to_hours(B.spans(spark, d)), located.where("k % 2 = 0"), s.where("window_title is not null"))


# --- weekly digest


@query(
    "a21_weekly_notes",
    with_("spans", "notes")
    + f""", u AS (SELECT CAST(date_trunc('week', start_ts) AS DATE) AS week, {MIN} / 60 AS h, 0 AS n FROM spans
  UNION ALL SELECT CAST(date_trunc('week', start_ts) AS DATE), 0, 1 FROM notes),
g AS (SELECT week, sum(h) AS h, sum(n) AS n FROM u GROUP BY 1),
p AS (SELECT *, coalesce(CASE WHEN lag(week) OVER w = week - 7 THEN lag(h) OVER w END, 0) AS ph,
  coalesce(CASE WHEN lag(week) OVER w = week - 7 THEN lag(n) OVER w END, 0) AS pn FROM g WINDOW w AS (ORDER BY week))
SELECT week, round(h, 2) AS hours, CAST(n AS BIGINT) AS notes, round((h - ph) / greatest(ph, 0.1) * 100, 1) AS hours_change,
  round((n - pn) / greatest(CAST(pn AS DOUBLE), 0.1) * 100, 1) AS notes_change,
  round(least(n / 7 / 10, 1.0) * 50 + least(h / 7 / 8, 1.0) * 50, 2) AS score FROM p""",
    dates=("week",),
)
def a21_notes(spark, d):
    return R.weekly_notes(B.spans(spark, d), B.notes(spark, d))


_TOP = """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY value DESC, key) AS rank FROM g) WHERE rank <= {n}"""


@query("a21_weekly_top_apps", with_("spans") + f", g AS (SELECT CAST(date_trunc('week', start_ts) AS DATE) AS week, app_id AS key, round(sum({MIN}), 3) AS value FROM spans GROUP BY 1, 2)" + _TOP.format(n=3), dates=("week",))
def a21_apps(spark, d):
    return R.weekly_top(B.spans(spark, d), "app_id", F.expr(A.MINUTES), 3)


@query(
    "a21_weekly_top_topics",
    with_("notes", "links", "entities")
    + """, g AS (SELECT CAST(date_trunc('week', start_ts) AS DATE) AS week, canonical_name AS key, round(sum(strength), 3) AS value
FROM links JOIN notes USING (note_id) JOIN entities USING (entity_id) GROUP BY 1, 2)"""
    + _TOP.format(n=5),
    dates=("week",),
)
def a21_topics(spark, d):
    rows = B.links(spark, d).join(B.notes(spark, d), "note_id").join(B.entities(spark, d), "entity_id")
    return R.weekly_top(rows, "canonical_name", F.col("strength"), 5)


# --- patterns


@query(
    "a24_hour_averages",
    """WITH r AS (SELECT hour(ts) AS h, count(*) / count(DISTINCT CAST(ts AS DATE)) AS a FROM events GROUP BY 1)
SELECT CAST(h AS INT) AS hour, round(a, 3) AS average, row_number() OVER (ORDER BY a DESC, h) <= 3 AS is_top FROM r""",
)
def a24_hours(spark, d):
    return R.hour_averages(B.samples(spark, d))


@query(
    "a25_week_balance",
    """WITH r AS (SELECT CAST(isodow(ts) - 1 AS INT) AS d, count(*) / count(DISTINCT CAST(ts AS DATE)) AS a FROM events GROUP BY 1),
o AS (SELECT arg_max(d, (a, -d)) AS busiest, arg_min(d, (a, -d)) AS quietest, max(a) > 1.3 * min(a) AS uneven,
  coalesce(sum(a) FILTER (d < 5), 0) / 5 AS w, coalesce(sum(a) FILTER (d >= 5), 0) / 2 AS e FROM r)
SELECT busiest, quietest, uneven, round(w, 3) AS weekday_average, round(e, 3) AS weekend_average,
  CASE WHEN w <= 0 OR e <= 0 THEN NULL WHEN w > 2 * e THEN 'weekdays' WHEN e > 0.8 * w THEN 'all week' END AS rule FROM o""",
)
def a25_balance(spark, d):
    return R.week_balance(B.samples(spark, d))


@query(
    "a26_group_balance",
    with_("spans")
    + f""", t AS (SELECT app_id AS app, sum({MIN}) AS m FROM spans GROUP BY 1 ORDER BY m DESC, app LIMIT 10),
o AS (SELECT arg_max(app, (m, app)) AS top_app, max(m) / sum(m) AS s, coalesce(sum(m) FILTER (app IN ('click', 'view')), 0) AS a,
  coalesce(sum(m) FILTER (app IN ('purchase')), 0) AS b FROM t), r AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN a / b END AS ratio FROM o)
SELECT top_app, round(s, 4) AS share, s > 0.2 AS is_pattern, round(ratio, 3) AS ratio,
  CASE WHEN ratio > 3 THEN 'first' WHEN ratio < 0.5 THEN 'second' END AS rule FROM r""",
)
def a26_balance(spark, d):
    return R.group_balance(B.spans(spark, d), ["click", "view"], ["purchase"])


_FOCUS = with_("spans") + f""", ch AS (SELECT *, coalesce(CAST(app_id <> lag(app_id) OVER w AS INT), 1) AS n FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS island FROM ch),
f AS (SELECT user_id, island, sum({MIN}) AS minutes FROM i GROUP BY 1, 2 HAVING sum({MIN}) >= 30)"""


@query(
    "w05_focus_summary",
    _FOCUS + " SELECT user_id, round(count(*) / 30, 4) AS per_day, round(avg(minutes), 3) AS mean_minutes, count(*) / 30 >= 1 AS often, avg(minutes) >= 45 AS long FROM f GROUP BY 1",
)
def w05_summary(spark, d):
    return R.focus_summary(W.focus_sessions(B.spans(spark, d), ["user_id"], minutes=30), 30)


@query(
    "w06_media_hours",
    with_("spans")
    + """, m AS (SELECT *, 'm' || CAST(k % 2 AS VARCHAR) AS media FROM spans WHERE k % 5 <> 0),
ch AS (SELECT *, coalesce(CAST(media <> lag(media) OVER w AS INT), 1) AS n FROM m WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS island FROM ch),
s AS (SELECT user_id, island, media, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM i GROUP BY 1, 2, 3),
h AS (SELECT *, unnest(generate_series(date_trunc('hour', start_ts), date_trunc('hour', end_ts - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS hour FROM s WHERE end_ts > start_ts)
SELECT user_id, CAST(hour AS TIMESTAMP) AS hour, media, round(sum((epoch_us(least(end_ts, hour + INTERVAL 1 HOUR)) - epoch_us(greatest(start_ts, hour))) / 1e6), 3) AS seconds
FROM h GROUP BY 1, 2, 3""",
)
def w06_hours(spark, d):
    s = B.spans(spark, d).withColumn("media", F.when(F.col("k") % 5 != 0, F.concat(F.lit("m"), (F.col("k") % 2).cast("string"))))
    return R.media_hours(W.media_spans(s, "user_id"))


# --- rollups


@query(
    "a14_aggregates_for_day",
    with_("rollup") + " SELECT key_type, key, value, row_number() OVER (PARTITION BY key_type ORDER BY value DESC, key) AS rank FROM agg WHERE day = DATE '2024-01-10'",
)
def a14(spark, d):
    return R.aggregates_for_day(_rollup(spark, d), "2024-01-10")


@query(
    "a15_app_usage_until",
    with_("samples")
    + """, s AS (SELECT *, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM samples),
x AS (SELECT *, coalesce(e, greatest(start_ts, TIMESTAMP '2024-02-01')) AS end_ts FROM s),"""
    + f" t AS (SELECT app_id AS app, sum({MIN}) AS m, count(*) AS sessions FROM x GROUP BY 1 ORDER BY m DESC, app LIMIT 3) SELECT app, round(m, 3) AS minutes, sessions, round(m / sum(m) OVER () * 100, 3) AS share FROM t",
)
def a15_until(spark, d):
    from pyspark.sql import Window

    s = B.samples(spark, d)
    spans = s.withColumn("end_ts", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumnRenamed("ts", "start_ts")
    return R.app_usage_until(spans, "2024-02-01", 3)


@query(
    "a08_entity_rollup",
    with_("notes", "links", "entities")
    + f""" SELECT CAST(start_ts AS DATE) AS day, 'entity:' || lower(entity_type) AS key_type, canonical_name AS key, round(sum({MIN}), 4) AS value
FROM (SELECT DISTINCT note_id, entity_id FROM links) JOIN notes USING (note_id) JOIN entities USING (entity_id) GROUP BY 1, 2, 3""",
    dates=("day",),
)
def a08_entities(spark, d):
    return R.entity_rollup(B.notes(spark, d), B.links(spark, d), B.entities(spark, d))


@query(
    "a08_media_rollup",
    with_("activities")
    + """, k AS (SELECT day, 'artist' AS key_type, string_split(media, ' - ')[1] AS key, minutes FROM activities WHERE media IS NOT NULL
  UNION ALL SELECT day, 'track', string_split(media, ' - ')[2], minutes FROM activities WHERE media IS NOT NULL)
SELECT day, key_type, key, round(sum(minutes), 4) AS value FROM k WHERE key <> '' GROUP BY 1, 2, 3""",
    dates=("day",),
)
def a08_media(spark, d):
    return R.media_rollup(B.activities(spark, d))


# --- graph and entities

_AT = "et AS (SELECT * FROM edges WHERE start_ts <= TIMESTAMP '1995-12-31' AND end_ts >= TIMESTAMP '1995-01-01')"


def _fifties(spark, d):
    return B.entities(spark, d).where("entity_id % 50 = 0").select("entity_id")


@query(
    "j11_edges_of_range",
    with_("edges") + f", {_AT} SELECT DISTINCT from_id, to_id, edge_type, weight FROM et WHERE (from_id % 50 = 0 AND from_id IN (SELECT p_partkey FROM part)) OR (to_id % 50 = 0 AND to_id IN (SELECT p_partkey FROM part))",
)
def j11_range(spark, d):
    return R.edges_of_range(B.edges(spark, d), _fifties(spark, d), "1995-01-01", "1995-12-31").select("from_id", "to_id", "edge_type", "weight")


@query(
    "g04_expand_in_range",
    with_("edges")
    + f""", {_AT}, l AS (SELECT from_id, to_id, weight AS w FROM et WHERE weight >= 0.3 AND edge_type = 'ABOUT_TOPIC'),
b AS (SELECT from_id, to_id, w FROM l UNION ALL SELECT to_id, from_id, w FROM l)
SELECT to_id AS entity_id, CAST(1 AS INT) AS hop, round(max(w), 6) AS relevance FROM b WHERE from_id = 50 AND to_id <> 50 GROUP BY 1 ORDER BY relevance DESC, entity_id LIMIT 20""",
)
def g04_range(spark, d):
    return R.expand_in_range(B.entities(spark, d).where("entity_id = 50"), B.edges(spark, d), "1995-01-01", "1995-12-31", hops=1, types=["ABOUT_TOPIC"])


@query(
    "g05_notes_for_entities",
    with_("links", "notes")
    + """ SELECT note_id, strength, start_ts FROM (SELECT note_id, max(strength) AS strength FROM links WHERE entity_id % 50 = 0 AND entity_id IN (SELECT p_partkey FROM part) GROUP BY 1)
JOIN (SELECT note_id, start_ts FROM notes) USING (note_id) ORDER BY strength DESC, start_ts DESC, note_id LIMIT 20""",
)
def g05(spark, d):
    return R.notes_for_entities(_fifties(spark, d), B.links(spark, d), B.notes(spark, d))


@query(
    "g09_co_occurrences",
    with_("edges")
    + """, l AS (SELECT from_id, to_id, weight FROM edges WHERE weight >= 0.3 AND edge_type = 'CO_OCCURRED_WITH'), b AS (SELECT from_id, to_id, weight FROM l UNION ALL SELECT to_id, from_id, weight FROM l)
SELECT to_id AS entity_id, CAST(1 AS INT) AS hop, round(max(weight * 0.9), 6) AS relevance FROM b WHERE from_id = 50 AND to_id <> 50 GROUP BY 1 ORDER BY relevance DESC, entity_id LIMIT 20""",
)
def g09(spark, d):
    return R.co_occurrences(B.entities(spark, d).where("entity_id = 50"), B.edges(spark, d))


@query(
    "g08_entity_card",
    with_("edges", "links", "notes", "entities")
    + """ SELECT 'info' AS section, CAST(1 AS BIGINT) AS rank, entity_type || '|' || canonical_name AS item, CAST(NULL AS DOUBLE) AS value FROM entities WHERE entity_id = 50
UNION ALL SELECT * FROM (SELECT 'outgoing', row_number() OVER (ORDER BY weight DESC, to_id, edge_type) AS r, CAST(to_id AS VARCHAR) || '|' || edge_type, CAST(weight AS DOUBLE) FROM edges WHERE from_id = 50) WHERE r <= 10
UNION ALL SELECT * FROM (SELECT 'incoming', row_number() OVER (ORDER BY weight DESC, from_id, edge_type) AS r, CAST(from_id AS VARCHAR) || '|' || edge_type, CAST(weight AS DOUBLE) FROM edges WHERE to_id = 50) WHERE r <= 10
UNION ALL SELECT * FROM (SELECT 'notes', row_number() OVER (ORDER BY start_ts DESC, note_id) AS r, CAST(note_id AS VARCHAR), CAST(strength AS DOUBLE) FROM links JOIN (SELECT note_id, start_ts FROM notes) USING (note_id) WHERE entity_id = 50) WHERE r <= 10""",
)
def g08_card(spark, d):
    return R.entity_card(50, B.entities(spark, d), B.edges(spark, d), B.links(spark, d), B.notes(spark, d))


@query("i01_missing_files", with_("notes") + " SELECT CAST(start_ts AS DATE) AS day, count(*) AS missing_file FROM notes WHERE note_id % 13 = 0 GROUP BY 1", dates=("day",))
def i01_files(spark, d):
    n = B.notes(spark, d)
    return R.missing_files(n, n.where("note_id % 13 <> 0"))


@query(
    "i05_foreign_keys",
    """SELECT 'lineitem_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 0)
UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def i05_keys(spark, d):
    t = lambda n: B.read(spark, d, n)
    some = t("orders").where("o_orderkey % 17 <> 0")
    return R.foreign_keys({"lineitem_order": (t("lineitem"), "l_orderkey", some, "o_orderkey"), "lineitem_part": (t("lineitem"), "l_partkey", t("part"), "p_partkey"), "order_customer": (t("orders"), "o_custkey", t("customer"), "c_custkey")})


# --- reading and writing


def _folder(spark: SparkSession, name: str) -> str:
    from lumenlog.sources.scratch import shared_folder

    return f"{shared_folder(spark)}/lumenlog-{name}-{uuid.uuid4().hex}"


@query("s01_read_samples", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def s01(spark, d):
    return S.read_samples(spark, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "s05_overwrite_period",
    "SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-31' THEN 2 ELSE 1 END) AS BIGINT) AS total FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1994-12-01' AND DATE '1995-02-28' GROUP BY 1",
    dates=("day",),
)
def s05(spark, d):
    """Three months are written, then one of them again, twice; the others stay as they were."""
    path = _folder(spark, "period")
    rows = B.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.lit(1).alias("value")).where("day between '1994-12-01' and '1995-02-28'")
    S.overwrite_period(rows.repartition("day"), path, ["day"])
    again = rows.where("day between '1995-01-01' and '1995-01-31'").withColumn("value", F.lit(2)).repartition("day")
    for _ in range(2):
        S.overwrite_period(again, path, ["day"])
    return spark.read.schema("value int, day date").parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("s06_write_notes", with_("notes") + " SELECT year(start_ts) AS y, month(start_ts) AS m, count(*) AS n FROM notes WHERE start_ts >= TIMESTAMP '1997-03-01' AND start_ts < TIMESTAMP '1997-05-01' GROUP BY 1, 2")
def s06_write(spark, d):
    """Notes of two months are written by day; the folders alone tell a month apart."""
    path = _folder(spark, "notes")
    S.write_notes(B.notes(spark, d).where("start_ts >= '1997-03-01' and start_ts < '1997-05-01'").select("note_id", "start_ts"), path)
    back = spark.read.schema("note_id long, start_ts timestamp_ntz, y int, m int, d int").parquet(path)
    return back.groupBy(F.col("y").cast("long").alias("y"), F.col("m").cast("long").alias("m")).agg(F.count("*").alias("n"))


@query("s07_export_bundle", with_("links", "edges", "entities") + " SELECT 'links' AS table_name, count(*) AS n, count(*) AS n_read FROM links UNION ALL SELECT 'edges', count(*), count(*) FROM edges UNION ALL SELECT 'entities', count(*), count(*) FROM entities")
def s07(spark, d):
    """The manifest of an export beside the rows read back from its files."""
    path = _folder(spark, "export")
    tables = {"links": B.links(spark, d), "edges": B.edges(spark, d), "entities": B.entities(spark, d)}
    manifest = S.export_bundle(tables, path)
    back = None
    for name, t in tables.items():
        one = spark.read.schema(t.schema).json(f"{path}/{name}").agg(F.count("*").alias("n_read")).select(F.lit(name).alias("table_name"), "n_read")
        back = one if back is None else back.union(one)
    return manifest.join(back, "table_name")


@query("s04_checked_source_type", "SELECT CASE source_type WHEN 0 THEN 'screen' WHEN 1 THEN 'pdf' ELSE 'other' END AS source_type, count(*) AS n, CAST(sum(token_estimate) AS BIGINT) AS tokens FROM (SELECT doc_id % 3 AS source_type, length(text) // 4 AS token_estimate FROM documents) GROUP BY 1")
def s04(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "screen").when(F.col("doc_id") % 3 == 1, "pdf").otherwise("other")
    rows = S.with_token_estimate(B.read(spark, d, "documents")).withColumn("source_type", S.check_source_type(kind, ["screen", "pdf", "other"]))
    return rows.groupBy("source_type").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("tokens"))


@query(
    "u02_order_by_all",
    with_("links", "notes") + " SELECT note_id, entity_id, strength, start_ts FROM links JOIN (SELECT note_id, start_ts FROM notes) USING (note_id) ORDER BY strength DESC, start_ts DESC, note_id, entity_id LIMIT 100",
)
def u02(spark, d):
    rows = B.links(spark, d).join(B.notes(spark, d).select("note_id", "start_ts"), "note_id").select("note_id", "entity_id", "strength", "start_ts")
    return U.order_by_all(rows, F.col("strength").desc(), F.col("start_ts").desc(), F.col("note_id"), F.col("entity_id")).limit(100)


# --- prebuilt pipelines

_NEAR = f"{_TREE}, near AS (SELECT vec_id, list_distance(e, q) AS dist FROM v, q ORDER BY dist, vec_id LIMIT {{n}})"


def _both(n: int, days: int) -> str:
    return (
        _NEAR.format(n=n).replace("ORDER BY dist, label LIMIT 6", f"ORDER BY dist, label LIMIT {2 * days}")
        + f""", r AS (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM cs WHERE label IN (SELECT label FROM tp) QUALIFY r <= 3),
m AS (SELECT label, avg(s) AS a FROM r GROUP BY 1), best AS (SELECT label FROM tp JOIN m USING (label) ORDER BY round(0.6 * tp.s + 0.4 * a, 6) DESC, label LIMIT {days}),
u AS (SELECT vec_id, 0 AS source_rank FROM near UNION ALL SELECT vec_id, 1 FROM r WHERE label IN (SELECT label FROM best))
SELECT vec_id, CAST(min(source_rank) AS INT) AS source_rank FROM u GROUP BY 1"""
    )


@query("p1_recall", _both(10, 3))
def p1(spark, d):
    return L.recall_by_both(B.read(spark, d, "embeddings"), *_tree(spark, d), _query_vector(spark, d), 10, 3).select("vec_id", "source_rank")


@query("p2_recall_wide", _both(15, 7))
def p2(spark, d):
    return L.recall_by_both(B.read(spark, d, "embeddings"), *_tree(spark, d), _query_vector(spark, d), 15, 7).select("vec_id", "source_rank")


def _tops(kind: str) -> str:
    return f"SELECT '{kind}' AS part, key, round(value, 2) AS value FROM (SELECT key, round(sum(value), 4) AS value FROM agg WHERE key_type = '{kind}' AND day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY key ORDER BY value DESC, key LIMIT 5)"


@query(
    "p3_comparison_report",
    with_("rollup")
    + f""", {_Q}, near AS (SELECT vec_id, list_distance(e, q) AS dist FROM v, q ORDER BY dist, vec_id LIMIT 5)
SELECT 'note' AS part, CAST(vec_id AS VARCHAR) AS key, round(dist, 5) AS value FROM near UNION ALL {_tops("app")} UNION ALL {_tops("category")}
UNION ALL SELECT 'change:' || CASE WHEN value_b IS NULL THEN 'only_a' WHEN value_a IS NULL THEN 'only_b' ELSE 'both' END,
  coalesce(x.key_type, y.key_type) || ':' || coalesce(x.key, y.key), round(coalesce(value_b, 0.0) - coalesce(value_a, 0.0), 2)
FROM {_top_cte("2024-01-01", "2024-01-15", "value_a")} x FULL JOIN {_top_cte("2024-01-16", "2024-01-31", "value_b")} y
  ON x.key_type = y.key_type AND x.key = y.key WHERE coalesce(x.key_type, y.key_type) IN ('app', 'category')""",
)
def p3(spark, d):
    return L.comparison_report(B.read(spark, d, "embeddings"), _query_vector(spark, d), _rollup(spark, d), ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31"))


@query(
    "p4_correlation_of_found",
    with_("spans")
    + f""", {_Q}, near AS (SELECT vec_id, list_distance(e, q) AS dist FROM v, q ORDER BY dist, vec_id LIMIT 20),
n AS (SELECT app_id, lead(app_id) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS after_app FROM spans)
SELECT *, round(n / sum(n) OVER (PARTITION BY app_id), 4) AS share FROM (SELECT app_id, after_app, count(*) AS n FROM n
  WHERE after_app IS NOT NULL AND app_id IN (SELECT app_id FROM spans WHERE event_id IN (SELECT vec_id FROM near)) GROUP BY 1, 2)""",
)
def p4(spark, d):
    return L.correlation_of_found(B.read(spark, d, "embeddings"), _query_vector(spark, d), B.spans(spark, d), 20)


@query(
    "p5_timeline_report",
    with_("rollup", "notes")
    + """, s AS (SELECT key_type, key, sum(value) AS v FROM agg WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2),
dated AS (SELECT note_id, start_ts + INTERVAL 9800 DAY AS start_ts FROM notes),
o AS (SELECT note_id, start_ts FROM dated WHERE start_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY start_ts, note_id LIMIT 50)
SELECT 'note' AS part, row_number() OVER (ORDER BY start_ts, note_id) AS rank, CAST(note_id AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS value FROM o
UNION ALL SELECT * FROM (SELECT key_type, row_number() OVER (PARTITION BY key_type ORDER BY v DESC, key) AS r, key, round(v, 3) FROM s) WHERE r <= 3""",
)
def p5(spark, d):
    dated = B.notes(spark, d).withColumn("start_ts", F.col("start_ts") + F.expr("interval 9800 days"))
    return L.timeline_report(dated, _rollup(spark, d), "2024-01-05", "2024-01-20", 50)


@query(
    "p6_entity_report",
    ORACLES["g08_entity_card"].replace("WITH ", with_("rollup") + ",\n", 1)
    + """ UNION ALL SELECT 'time', row_number() OVER (ORDER BY key_type), key_type, value FROM (
  SELECT key_type, round(sum(value), 4) AS value FROM agg JOIN entities ON entity_id = 50 AND lower(key) = lower(canonical_name) GROUP BY 1)""",
)
def p6(spark, d):
    named = A.daily_rollup(B.activities(spark, d), None)
    return L.entity_report(50, B.entities(spark, d), B.edges(spark, d), B.links(spark, d), B.notes(spark, d), named)


@query(
    "p7_most_report",
    with_("notes", "links", "entities")
    + f""", agg AS (SELECT CAST(start_ts AS DATE) AS day, canonical_name AS key, round(sum({MIN}), 4) AS value
  FROM (SELECT DISTINCT note_id, entity_id FROM links) JOIN notes USING (note_id) JOIN entities USING (entity_id) WHERE entity_type = 'Brand#11' GROUP BY 1, 2),
t AS (SELECT key AS top_key, round(sum(value), 4) AS value FROM agg GROUP BY key ORDER BY value DESC, top_key LIMIT 1),
f AS (SELECT DISTINCT note_id, start_ts, top_key FROM links JOIN (SELECT note_id, start_ts FROM notes) USING (note_id) JOIN entities USING (entity_id) JOIN t ON lower(canonical_name) = lower(top_key)),
l AS (SELECT * FROM f ORDER BY start_ts DESC, note_id LIMIT 10)
SELECT t.top_key, t.value, l.note_id, l.start_ts FROM t LEFT JOIN l ON l.top_key = t.top_key""",
)
def p7(spark, d):
    agg = R.entity_rollup(B.notes(spark, d), B.links(spark, d), B.entities(spark, d))
    return L.most_report(agg, "entity:brand#11", B.entities(spark, d), B.links(spark, d), B.notes(spark, d))


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN p_name || '.txt - Editor' WHEN 1 THEN 'Viewer \u2014 ' || p_name || '.pdf' WHEN 2 THEN 'n' || p_partkey || '.md' WHEN 3 THEN '~/notes/n' || p_partkey || ' - x' ELSE p_name END"


@query(
    "f15_document_paths",
    f"""WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part),
f AS (SELECT p_partkey, trim(regexp_extract(title, '(/(?:Users|Volumes|private|tmp)[^\\s\\[\\]]+|~/[^\\s\\[\\]]+)', 1)) AS a, trim(regexp_extract(title, '^([^-\\[\\]]+\\.[a-zA-Z]{{2,5}})\\s*[-\u2014]\\s*', 1)) AS b,
  trim(regexp_extract(title, '[-\u2014]\\s*([^-\\[\\]]+\\.[a-zA-Z]{{2,5}})$', 1)) AS c, trim(regexp_extract(title, '^([^/\\\\\\s\\[\\]]+\\.[a-zA-Z]{{2,5}})$', 1)) AS e FROM t)
SELECT p_partkey, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(e, '')) AS path FROM f""",
)
def f15_paths(spark, d):
    return B.read(spark, d, "part").select("p_partkey", P.document_path(F.expr(_TITLE)).alias("path"))
