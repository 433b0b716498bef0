"""Registered queries, continued: rollups, windows, sets, entities, graph, vectors, integrity and pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import entities as E
from lumenlog.operators import graph as G
from lumenlog.operators import integrity as I
from lumenlog.operators import rollups as A
from lumenlog.operators import selection as K
from lumenlog.operators import sets as U
from lumenlog.operators import spans as W
from lumenlog.operators import vectors as V
from lumenlog.operators.segments import block_piece
from lumenlog.plans import base as B
from lumenlog.plans import pipelines as L
from lumenlog.plans.base import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MIN = "(epoch_us(end_ts) - epoch_us(start_ts)) / 6e7"


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query; the columns in `dates` are compared as text."""

    def register(f):
        QUERIES[name] = (lambda spark, d: (lambda out: out.withColumns({c: F.col(c).cast("string") for c in dates}))(f(spark, d))) if dates else f
        if sql:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return register


def _c(*names: str):
    return [F.col(n) for n in names]


def _rollup(spark, d):
    return A.daily_rollup(B.activities(spark, d), None)


# --- aggregations


@query("a01_category_minutes", "SELECT event_id, CASE WHEN k % 11 = 0 THEN 0.0 ELSE CAST(((k * 3) % 1440 - (k * 37) % 1440 + 1440) % 1440 AS DOUBLE) END AS minutes FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def a01(spark, d):
    s = B.samples(spark, d)
    at = lambda m: F.format_string("%d:%02d", (m / 60).cast("int"), m % 60)
    start, end = at(F.col("k") * 37 % 1440), F.when(F.col("k") % 11 == 0, "late").otherwise(at(F.col("k") * 3 % 1440))
    return s.select("event_id", A.hhmm_minutes(start, end).alias("minutes"))


@query("a06_daily_rollup", with_("rollup") + " SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY day, key_type ORDER BY value DESC, key) AS r FROM agg) WHERE key_type = 'category' OR r <= 3", dates=("day",))
def a06(spark, d):
    return A.daily_rollup(B.activities(spark, d), 3)


@query("a07_merge_rollups", with_("rollup") + ", cur AS (SELECT day, key_type, key, 100.0 AS value FROM agg WHERE key_type = 'app' AND day < DATE '2024-01-05') SELECT a.day, a.key_type, a.key, coalesce(c.value, a.value) AS value FROM agg a LEFT JOIN cur c ON a.day = c.day AND a.key_type = c.key_type AND a.key = c.key", dates=("day",))
def a07(spark, d):
    r = _rollup(spark, d)
    return A.merge_rollups(r, r.where("key_type = 'app' and day < date'2024-01-05'").withColumn("value", F.lit(100.0)))


@query("a08_coactivity_rollup", with_("spans") + ", p AS (SELECT user_id, CAST(start_ts AS DATE) AS day, app_id, lead(app_id) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS other FROM spans) SELECT day, app_id || '+' || other AS key, count(*) AS n FROM p WHERE other IS NOT NULL GROUP BY 1, 2", dates=("day",))
def a08(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start_ts", "event_id")
    rows = B.spans(spark, d).select(F.to_date("start_ts").alias("day"), "app_id", F.lead("app_id").over(w).alias("other")).where("other is not null")
    return rows.groupBy("day", F.concat_ws("+", "app_id", "other").alias("key")).agg(F.count("*").alias("n"))


@query("a09_rollup_periods", with_("rollup") + ", u AS (SELECT unnest(['week', 'month', 'year']) AS period_type) SELECT period_type, CAST(date_trunc(period_type, day) AS DATE) AS period_start, key_type, key, round(sum(value), 4) AS value FROM agg, u GROUP BY ALL", dates=("period_start",))
def a09(spark, d):
    return A.rollup_periods(_rollup(spark, d))


@query("a10_top_by_key_type", with_("rollup") + ", t AS (SELECT key, round(sum(value), 4) AS value, min(day) AS first_day, max(day) AS last_day FROM agg WHERE key_type = 'media' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY key ORDER BY value DESC, key LIMIT 5) SELECT *, round(sum(value) OVER (), 3) AS total FROM t", dates=("first_day", "last_day",))
def a10(spark, d):
    return A.top_by_key_type(_rollup(spark, d), "media", 5, "2024-01-05", "2024-01-20")


@query("a11_time_for_key", with_("rollup") + " SELECT key_type, round(sum(value), 4) AS value FROM agg WHERE lower(key) = 'click' GROUP BY 1")
def a11(spark, d):
    return A.time_for_key(_rollup(spark, d), "CLICK")


@query("a12_period_summary", with_("rollup") + ", s AS (SELECT key_type, key, sum(value) AS v FROM agg GROUP BY 1, 2) SELECT key_type, key, rank, round(v, 3) AS value, round(t, 2) AS type_total FROM (SELECT *, row_number() OVER (PARTITION BY key_type ORDER BY v DESC, key) AS rank, sum(v) OVER (PARTITION BY key_type) AS t FROM s) WHERE rank <= 5")
def a12(spark, d):
    return A.period_summary(_rollup(spark, d))


@query("a13_search_aggregates", with_("rollup") + " SELECT key_type, key, round(sum(value), 4) AS value FROM agg WHERE contains(lower(key), 'c') GROUP BY 1, 2")
def a13(spark, d):
    return A.search_aggregates(_rollup(spark, d), "C")


@query("a15_app_usage", with_("spans") + f", t AS (SELECT app_id AS app, sum({MIN}) AS m, count(*) AS sessions FROM spans GROUP BY 1 ORDER BY m DESC, app LIMIT 3) SELECT app, round(m, 3) AS minutes, sessions, round(m / sum(m) OVER () * 100, 3) AS share FROM t")
def a15(spark, d):
    return A.app_usage(B.spans(spark, d), 3)


@query("a16_topic_usage", with_("links", "entities") + " SELECT canonical_name, count(DISTINCT note_id) AS notes, round(sum(strength), 3) AS strength FROM links JOIN entities USING (entity_id) GROUP BY 1 ORDER BY notes DESC, strength DESC, canonical_name LIMIT 20")
def a16(spark, d):
    return A.topic_usage(B.links(spark, d), B.entities(spark, d))


@query("a17_activity_trend", "SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT event_type) AS apps FROM events GROUP BY 1", dates=("day",))
def a17(spark, d):
    return A.activity_trend(B.samples(spark, d))


@query("a18_heatmap", "SELECT CAST(w AS INT) AS weekday, CAST(h AS INT) AS hour, count(event_id) AS events FROM range(7) a(w) CROSS JOIN range(24) b(h) LEFT JOIN events ON isodow(ts) - 1 = w AND hour(ts) = h GROUP BY 1, 2")
def a18(spark, d):
    return A.heatmap(B.samples(spark, d))


@query("a19_productivity", with_("spans", "links") + f" SELECT (SELECT round(sum({MIN}), 1) FROM spans) AS total_minutes, (SELECT count(DISTINCT app_id) FROM spans) AS apps, CAST((SELECT h FROM (SELECT hour(start_ts) AS h, count(*) AS c FROM spans GROUP BY 1) ORDER BY c DESC, h LIMIT 1) AS INT) AS busiest_hour, (SELECT count(DISTINCT note_id) FROM links) AS notes, (SELECT count(DISTINCT entity_id) FROM links) AS entities")
def a19(spark, d):
    return A.productivity_summary(B.spans(spark, d), B.links(spark, d))


_DIGEST = with_("spans") + f""", s AS (SELECT CAST(date_trunc('week', start_ts) AS DATE) AS week, sum({MIN}) AS m, count(DISTINCT app_id) AS apps, count(*) AS spans FROM spans GROUP BY 1),
p AS (SELECT *, coalesce(CASE WHEN lag(week) OVER (ORDER BY week) = week - INTERVAL 7 DAY THEN lag(m) OVER (ORDER BY week) END, 0.0) AS before FROM s),
g AS (SELECT week, round(m, 2) AS minutes, apps, spans, round(m - before, 2) AS delta_minutes, round((m - before) / greatest(before, 0.1) * 100, 1) AS change_percent, round(least(spans / 7 / 10, 1.0) * 50 + least(m / 60 / 7 / 8, 1.0) * 50, 2) AS score FROM p)"""


@query("a21_weekly_digest", _DIGEST + " SELECT * FROM g", dates=("week",))
def a21(spark, d):
    return A.weekly_digest(B.spans(spark, d))


@query("a23_digest_highlights", _DIGEST + " SELECT week, concat_ws('; ', CASE WHEN change_percent > 20 THEN 'More activity than the week before' END, CASE WHEN change_percent < -20 THEN 'Less activity than the week before' END, CASE WHEN apps >= 5 THEN 'Apps used: ' || CAST(apps AS VARCHAR) END, CASE WHEN score >= 75 THEN 'A productive week' END) AS highlights FROM g", dates=("week",))
def a23(spark, d):
    return A.digest_highlights(A.weekly_digest(B.spans(spark, d)))


_PART = "CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) >= 18 THEN 'evening' ELSE 'night' END"


@query("a24_time_of_day", f"SELECT part, events, round(events / sum(events) OVER (), 4) AS share, events / sum(events) OVER () > 0.4 AS is_pattern, round(least(events / sum(events) OVER () + 0.2, 1.0), 4) AS confidence FROM (SELECT {_PART} AS part, count(*) AS events FROM events GROUP BY 1)")
def a24(spark, d):
    return A.time_of_day_patterns(B.samples(spark, d))


@query("a25_day_of_week", "WITH r AS (SELECT CAST(isodow(ts) - 1 AS INT) AS weekday, count(*) / count(DISTINCT CAST(ts AS DATE)) AS a FROM events GROUP BY 1) SELECT weekday, round(a, 3) AS average, max(a) OVER () > 1.3 * min(a) OVER () AS uneven, weekday >= 5 AS weekend FROM r")
def a25(spark, d):
    return A.day_of_week_patterns(B.samples(spark, d))


@query("a26_app_patterns", with_("spans") + f", r AS (SELECT app_id AS app, sum({MIN}) AS m FROM spans GROUP BY 1) SELECT app, CASE WHEN app IN ('click', 'view') THEN 'browse' ELSE 'other' END AS app_group, round(m, 2) AS minutes, round(m / sum(m) OVER (), 4) AS share, m / sum(m) OVER () > 0.2 AS is_pattern FROM r")
def a26(spark, d):
    return A.app_patterns(B.spans(spark, d), {"click": "browse", "view": "browse"})


@query("a27_all_patterns", with_("samples") + f", a AS (SELECT 'part:' || part AS pattern, round(least(events / sum(events) OVER () + 0.2, 1.0), 4) AS confidence FROM (SELECT {_PART} AS part, count(*) AS events FROM events GROUP BY 1)), b AS (SELECT 'app:' || app_id AS pattern, round(c / sum(c) OVER (), 4) AS confidence FROM (SELECT app_id, count(*) AS c FROM samples GROUP BY 1)) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY confidence DESC, pattern LIMIT 3")
def a27(spark, d):
    from pyspark.sql import Window

    s = B.samples(spark, d)
    a = A.time_of_day_patterns(s).select(F.concat(F.lit("part:"), "part").alias("pattern"), "confidence")
    c = s.groupBy("app_id").agg(F.count("*").alias("c"))
    b = c.select(F.concat(F.lit("app:"), "app_id").alias("pattern"), F.round(F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(1))), 4).alias("confidence"))
    return A.all_patterns(a, b)


@query("a28_text_summary", "SELECT source, count(*) AS n, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def a28(spark, d):
    from lumenlog.sources.tables import with_token_estimate

    return with_token_estimate(B.read(spark, d, "documents")).groupBy("source").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("a29_counts_by", with_("edges") + " SELECT edge_type, count(*) AS n, CAST(grouping(edge_type) AS INT) AS is_total FROM edges GROUP BY ROLLUP (edge_type)")
def a29(spark, d):
    return A.counts_by(B.edges(spark, d), "edge_type")


_CLIP = with_("spans") + """, h AS (SELECT *, unnest(generate_series(date_trunc('hour', start_ts), date_trunc('hour', end_ts), INTERVAL 1 HOUR)) AS hour FROM spans),
c AS (SELECT *, (epoch_us(least(end_ts, hour + INTERVAL 1 HOUR)) - epoch_us(greatest(start_ts, hour))) / 1e6 AS seconds FROM h)"""


@query("a30_hourly_evidence", _CLIP + " SELECT user_id, CAST(hour AS TIMESTAMP) AS hour, round(sum(seconds), 3) AS seconds, count(DISTINCT event_id) AS spans, array_to_string(list_sort(list_distinct(list(app_id))), ',') AS apps FROM c WHERE seconds > 0 GROUP BY 1, 2")
def a30(spark, d):
    return A.hourly_evidence(W.clip_to_hours(B.spans(spark, d)))


def _top_cte(a: str, b: str, name: str) -> str:
    return f"(SELECT key_type, key, v AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY key_type ORDER BY v DESC, key) AS r FROM (SELECT key_type, key, round(sum(value), 3) AS v FROM agg WHERE day BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1, 2)) WHERE r <= 5)"


@query("a31_compare_periods", with_("rollup") + f" SELECT coalesce(x.key_type, y.key_type) AS key_type, coalesce(x.key, y.key) AS key, CASE WHEN value_b IS NULL THEN 'only_a' WHEN value_a IS NULL THEN 'only_b' ELSE 'both' END AS status, value_a, value_b, round(coalesce(value_b, 0.0) - coalesce(value_a, 0.0), 2) AS delta FROM {_top_cte('2024-01-01', '2024-01-10', 'value_a')} x FULL JOIN {_top_cte('2024-01-11', '2024-01-20', 'value_b')} y ON x.key_type = y.key_type AND x.key = y.key")
def a31(spark, d):
    return A.compare_periods(_rollup(spark, d), ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"))


@query("a32_open_loops_summary", with_("notes") + " SELECT count(*) AS total, count(*) FILTER (CAST(start_ts AS DATE) = DATE '1998-03-31') AS today, count(*) FILTER (CAST(start_ts AS DATE) > DATE '1998-03-24' AND CAST(start_ts AS DATE) <= DATE '1998-03-31') AS last_7_days, count(DISTINCT CAST(start_ts AS DATE)) AS days FROM notes WHERE status = 'O'")
def a32(spark, d):
    return A.open_loops_summary(B.notes(spark, d).where("status = 'O'"), "1998-03-31 15:00:00")


@query("a34_ingest_stats", with_("samples") + " SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS captured, count(*) FILTER (k % 4 = 0) AS duplicates, count(*) FILTER (app_id = 'click') AS blocked, CAST(sum(k) AS BIGINT) AS tokens FROM samples GROUP BY 1, 2", dates=("day",))
def a34(spark, d):
    return A.ingest_stats(B.samples(spark, d).withColumns({"is_dup": F.col("k") % 4 == 0, "is_blocked": F.col("app_id") == "click", "tokens": F.col("k")}))


# --- windows and sequences

_SPANS = with_("samples") + """, l AS (SELECT *, lag(ts) OVER w AS pts, lag(app_id) OVER w AS papp, lag(window_title) OVER w AS ptitle, lag(url) OVER w AS purl, lead(ts) OVER w AS nts FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN pts IS NULL OR app_id IS DISTINCT FROM papp OR (window_title <> '' AND ptitle <> '' AND window_title <> ptitle) OR (app_id = 'view' AND url IS DISTINCT FROM purl) THEN 1 ELSE 0 END AS starts FROM l),
g AS (SELECT *, sum(starts) OVER w AS span, lead(starts) OVER w AS nstarts FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("w01_build_spans", _SPANS + " SELECT user_id, min(ts) AS start_ts, max(CASE WHEN nstarts = 1 THEN nts ELSE ts END) AS end_ts, any_value(app_id) AS app_id, arg_max(window_title, struct_pack(t := ts, e := event_id)) FILTER (window_title IS NOT NULL AND window_title <> '') AS window_title, arg_min_null(url, struct_pack(t := ts, e := event_id)) AS url, count(*) AS n_samples, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS ids FROM g GROUP BY user_id, span")
def w01(spark, d):
    out = W.build_spans(B.samples(spark, d), browsers=["view"])
    return out.select("user_id", "start_ts", "end_ts", "app_id", "window_title", "url", "n_samples", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("ids"))


_DUPS = with_("frames") + ", n AS (SELECT *, lag(fingerprint) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM frames), dd AS (SELECT *, CASE WHEN p IS NOT NULL THEN " + " + ".join(f"CAST(bit_count(xor(CAST('0x' || substr(fingerprint, {8 * i + 1}, 8) AS BIGINT), CAST('0x' || substr(p, {8 * i + 1}, 8) AS BIGINT))) AS INT)" for i in range(8)) + " END AS distance FROM n)"


@query("w03_consecutive_dups", _DUPS + " SELECT event_id, coalesce(CAST(distance AS INT), -1) AS distance, coalesce(distance <= 5, false) AS is_dup FROM dd")
def w03(spark, d):
    return W.drop_consecutive_dups(B.frames(spark, d), "user_id").select("event_id", F.coalesce("distance", F.lit(-1)).alias("distance"), "is_dup")


@query("w04_diff_score", _DUPS + " SELECT event_id, round(least(1.0, distance / 256.0), 6) AS score FROM dd WHERE distance IS NOT NULL")
def w04(spark, d):
    from lumenlog.functions.text import diff_score

    return W.drop_consecutive_dups(B.frames(spark, d), "user_id").where("distance is not null").select("event_id", F.round(diff_score(F.col("distance")), 6).alias("score"))


@query("w05_focus_sessions", with_("spans") + f", c AS (SELECT *, coalesce(CAST(app_id <> lag(app_id) OVER w AS INT), 1) AS ch FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id)), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS island FROM c) SELECT user_id, app_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, round(sum({MIN}), 4) AS minutes, count(*) AS n_spans FROM i GROUP BY user_id, island, app_id HAVING sum({MIN}) >= 1440")
def w05(spark, d):
    return W.focus_sessions(B.spans(spark, d), ["user_id"], minutes=1440).select("user_id", "app_id", "start_ts", "end_ts", F.round("minutes", 4).alias("minutes"), "n_spans")


@query("w06_media_spans", with_("spans") + ", m AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 'm' || CAST(k % 2 AS VARCHAR) END AS media FROM spans), c AS (SELECT *, coalesce(CAST(media <> lag(media) OVER w AS INT), 1) AS ch FROM m WHERE media IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id)), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS island FROM c) SELECT user_id, media, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_spans FROM i GROUP BY user_id, island, media")
def w06(spark, d):
    s = B.spans(spark, d).withColumn("media", F.when(F.col("k") % 5 != 0, F.concat(F.lit("m"), (F.col("k") % 2).cast("string"))))
    return W.media_spans(s, "user_id").drop("island")


@query("w07_budget_snippets", """WITH t AS (SELECT doc_id, source, length(text) // 4 AS tok FROM documents), c AS (SELECT *, least(tok, 500) AS cap, coalesce(sum(least(tok, 500)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t),
s AS (SELECT *, max(CAST(spent >= 4000 OR (spent + cap > 4000 AND 4000 - spent < 100) AS INT)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS stopped FROM c) SELECT doc_id, source, CAST(least(cap, 4000 - spent) AS BIGINT) AS used_tokens FROM s WHERE stopped = 0""")
def w07(spark, d):
    from lumenlog.sources.tables import with_token_estimate

    return W.budget_snippets(with_token_estimate(B.read(spark, d, "documents")), "source", ["doc_id"], piece=block_piece("doc_id")).select("doc_id", "source", "used_tokens")


@query("w08_budget_prefix", "SELECT * FROM (SELECT doc_id, source, CAST(sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running_tokens FROM documents) WHERE running_tokens <= 4000")
def w08(spark, d):
    from lumenlog.sources.tables import with_token_estimate

    return W.budget_prefix(with_token_estimate(B.read(spark, d, "documents")), "source", ["doc_id"], piece=block_piece("doc_id")).select("doc_id", "source", "running_tokens")


_SCORED = with_("samples") + """, t AS (SELECT *, row_number() OVER w = 1 OR app_id IS DISTINCT FROM lag(app_id) OVER w OR window_title IS DISTINCT FROM lag(window_title) OVER w AS is_transition, CAST(k AS DOUBLE) / 100 AS diff_score FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN app_id LIKE 'cl%' THEN 'creative' WHEN app_id LIKE 'v%' THEN 'document' ELSE 'other' END AS category FROM t), i AS (SELECT *, round(greatest(0.0, least(1.0, diff_score * 0.6 + 0.2 + CASE WHEN category <> 'other' THEN 0.1 ELSE 0.0 END)), 6) AS importance FROM c)"""


def _scored(spark, d):
    rows = W.mark_transitions(B.samples(spark, d), "user_id").withColumn("diff_score", F.col("k") / 100)
    return K.score_frames(K.triage(rows, {"cl": "creative", "v": "document"}))


_SCORE = "round(CAST(is_transition AS INT) + 0.6 * diff_score + CASE WHEN importance >= 0.3 THEN importance * 0.5 ELSE 0.0 END + CASE category WHEN 'document' THEN 0.2 WHEN 'creative' THEN 0.15 ELSE 0.0 END, 6)"


@query("w09_w10_score_frames", _SCORED + " SELECT event_id, is_transition, " + _SCORE + " AS score, CASE WHEN is_transition THEN 'transition' WHEN diff_score >= 0.5 THEN 'change' WHEN importance >= 0.3 THEN 'importance' ELSE 'other' END AS reason FROM i")
def w10(spark, d):
    return _scored(spark, d).select("event_id", "is_transition", "score", "reason")


# The greedy choice folds each group's rows, best first; an anchor fills a gap between chosen rows, so gaps don't disturb
# each other and the first ones in time take what room is left.
_KEYFRAMES = (
    _SCORED
    + f""", f AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS frame_id, ts, epoch_us(ts) // 1000000 AS t, {_SCORE} AS score FROM i),
o AS MATERIALIZED (SELECT user_id, day, list([{{'t': t, 'id': frame_id}}] ORDER BY score DESC, t, frame_id) AS rows FROM f GROUP BY ALL),
h AS MATERIALIZED (SELECT user_id, day, list_reduce(rows, lambda a, r: CASE WHEN len(a) < 5 AND len(list_filter(a, lambda x: abs(x.t - r[1].t) < 3600)) = 0 THEN list_concat(a, r) ELSE a END) AS chosen FROM o),
u AS (SELECT user_id, day, unnest(chosen) AS c, len(chosen) AS n FROM h),
g AS (SELECT user_id, day, n, c.id AS id, c.t AS t, lead(c.t) OVER (PARTITION BY user_id, day ORDER BY c.t) AS e FROM u),
m AS (SELECT g.user_id, g.day, g.n, g.t AS a, f.frame_id, row_number() OVER (PARTITION BY g.user_id, g.day, g.t ORDER BY abs(f.t - (g.t + g.e) / 2), f.t, f.frame_id) AS r
  FROM g JOIN f ON f.user_id = g.user_id AND f.day = g.day AND f.t > g.t AND f.t < g.e WHERE g.e - g.t > 14400),
p AS (SELECT frame_id FROM (SELECT frame_id, n, row_number() OVER (PARTITION BY user_id, day ORDER BY a) AS i FROM m WHERE r = 1) WHERE i <= 5 - n)
SELECT user_id, day, frame_id, ts, score, 'score' AS why FROM f WHERE frame_id IN (SELECT id FROM g)
UNION ALL SELECT user_id, day, frame_id, ts, score, 'anchor' FROM f WHERE frame_id IN (SELECT frame_id FROM p)"""
)


@query("w11_w12_keyframes", _KEYFRAMES, dates=("day",))
def w11(spark, d):
    rows = _scored(spark, d).select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("frame_id"), "ts", "score")
    return K.select_keyframes(rows, ["user_id", "day"], k=5, gap=3600, anchor=14400)


@query("w13_temporal_sequence", with_("spans") + " SELECT event_id, coalesce(before_id, -1) AS before_id, coalesce(after_id, -1) AS after_id FROM (SELECT event_id, app_id, lag(event_id) OVER w AS before_id, lead(event_id) OVER w AS after_id FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, event_id)) WHERE app_id = 'purchase'")
def w13(spark, d):
    return W.temporal_sequence(B.spans(spark, d), "user_id", "app_id = 'purchase'").select("event_id", F.coalesce("before_id", F.lit(-1)).alias("before_id"), F.coalesce("after_id", F.lit(-1)).alias("after_id"))


@query("w14_transition_matrix", with_("spans") + " SELECT from_app, to_app, count(*) AS n FROM (SELECT app_id AS from_app, lead(app_id) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS to_app FROM spans) WHERE to_app IS NOT NULL AND to_app <> from_app GROUP BY 1, 2")
def w14(spark, d):
    return W.transition_matrix(B.spans(spark, d), "user_id")


@query("w15_topk_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def w15(spark, d):
    return W.topk_per_group(B.read(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("w16_open_loops", with_("notes") + """, x AS (SELECT note_id, start_ts, unnest(categories) AS loop, generate_subscripts(categories, 1) - 1 AS idx FROM notes), y AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(loop)) ORDER BY start_ts DESC, note_id DESC, idx) AS n FROM x WHERE trim(loop) <> '')
SELECT CAST(note_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR) AS loop_id, note_id, start_ts, loop FROM y WHERE n = 1 ORDER BY start_ts DESC, loop_id LIMIT 50""")
def w16(spark, d):
    return W.open_loops(B.notes(spark, d).withColumnRenamed("categories", "open_loops"))


@query("w17_clip_to_hours", _CLIP + " SELECT event_id, CAST(hour AS TIMESTAMP) AS hour, CAST(round(seconds * 1e6) AS BIGINT) AS micros FROM c WHERE seconds > 0")
def w17(spark, d):
    return W.clip_to_hours(B.spans(spark, d)).select("event_id", "hour", F.round(F.col("seconds") * 1e6).cast("long").alias("micros"))


@query("w18_dwell", _DUPS + """, g AS (SELECT *, sum(CAST(NOT coalesce(distance <= 5, false) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM dd), s AS (SELECT user_id, g, min(ts) AS ts, max(ts) AS last_ts, count(*) AS frames FROM g GROUP BY 1, 2)
SELECT user_id, ts, frames, CAST(epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY g), last_ts)) // 1000000 - epoch_us(ts) // 1000000 AS BIGINT) AS dwell_seconds FROM s""")
def w18(spark, d):
    f = W.drop_consecutive_dups(B.frames(spark, d), "user_id")
    return W.dwell(f, "user_id").select("user_id", "ts", "frames", "dwell_seconds")


@query("st8_throttle_carry", with_("samples") + """, s AS (SELECT *, epoch_us(ts) // 86400000000 AS slot FROM samples), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) = 1 THEN k END AS reading FROM s)
SELECT event_id, last_value(reading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM r""")
def st8(spark, d):
    return W.throttle_carry(B.samples(spark, d), "user_id", "k", 86400).select("event_id", "carried")


# --- sets


@query("u03_activity_hours", "SELECT date_trunc('hour', ts) AS hour FROM events UNION SELECT date_trunc('hour', o_orderdate) FROM orders")
def u03(spark, d):
    return U.activity_hours((B.samples(spark, d), "ts"), (B.notes(spark, d), "start_ts"))


@query("u04_merge_results", "SELECT o_orderkey, o_orderdate, CASE WHEN o_totalprice > 200000 THEN 0 ELSE 1 END AS source_rank FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'O'")
def u04(spark, d):
    o = B.read(spark, d, "orders")
    return U.merge_results(o.where("o_totalprice > 200000"), o.where("o_orderstatus = 'O'"), key="o_orderkey", ts="o_orderdate").select("o_orderkey", "o_orderdate", "source_rank")


@query("u05_key_set_ops", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 30), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05) SELECT coalesce(a.k, b.k) AS l_partkey, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS where_found FROM a FULL JOIN b ON a.k = b.k")
def u05(spark, d):
    li = B.read(spark, d, "lineitem")
    return U.key_set_ops(li.where("l_quantity > 30"), li.where("l_discount > 0.05"), "l_partkey")


@query("u06_union_arrays", with_("notes") + " SELECT status, array_to_string(list_sort(list_distinct(flatten(list(categories)))), ',') AS categories FROM notes GROUP BY status")
def u06(spark, d):
    return U.union_arrays(B.notes(spark, d), "status", "categories").select("status", F.array_join("categories", ",").alias("categories"))


@query("u07_pack_context", "WITH p AS (SELECT c_custkey AS parent_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pr FROM customer QUALIFY pr <= 5), c AS (SELECT o_orderkey, pr, row_number() OVER (PARTITION BY parent_id ORDER BY o_totalprice DESC, o_orderkey) AS cr FROM orders JOIN p ON o_custkey = parent_id) SELECT level, item_id, CAST(pr AS INT) AS parent_rank, CAST(cr AS INT) AS child_rank FROM (SELECT 'parent' AS level, parent_id AS item_id, 0 AS l, pr, 0 AS cr FROM p UNION ALL SELECT 'child', o_orderkey, 1, pr, cr FROM c) ORDER BY l, pr, cr LIMIT 30")
def u07(spark, d):
    p = B.read(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select(F.col("c_custkey").alias("parent_id"), F.col("c_acctbal").alias("relevance"))
    c = B.read(spark, d, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("child_id"), F.col("o_totalprice").alias("score"))
    return U.pack_context(p, c, 30)


# --- entities


def _mentions(spark, d):
    return B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("note_id"), F.lit("topic").alias("entity_type"), F.col("p_name").alias("name"), (F.col("l_discount") * 10).alias("strength"), F.col("l_returnflag").alias("context"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.ascii("l_returnflag")).alias("seq"))


@query("e01_extract_mentions", "SELECT o_orderkey AS note_id, 'topic' AS entity_type, o_orderpriority AS name, 0.5 AS strength FROM orders UNION ALL SELECT o_orderkey, 'domain', o_orderstatus, 0.9 FROM orders")
def e01(spark, d):
    n = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.array(F.struct(F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("double").alias("confidence"))).alias("topics"), F.array(F.struct(F.col("o_orderstatus").alias("domain"), F.lit("x").alias("purpose"))).alias("websites"))
    return E.extract_mentions(n).select("note_id", "entity_type", "name", "strength")


@query("e02_upsert_entities", r"SELECT sha256('topic|' || lower(p_name)) AS entity_id, lower(p_name) AS canonical_name, array_to_string(list_sort(list_distinct(list(n) FILTER (n <> lower(p_name)))), ',') AS aliases FROM (SELECT p_name, p_name AS n FROM part UNION ALL SELECT p_name, upper(p_name) FROM part) GROUP BY 1, 2")
def e02(spark, d):
    p = B.read(spark, d, "part")
    m = p.select(F.lit("topic").alias("entity_type"), F.col("p_name").alias("name")).union(p.select(F.lit("topic"), F.upper("p_name")))
    return E.upsert_entities(m).select("entity_id", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


@query("e03_upsert_links", "SELECT l_orderkey AS note_id, lower(p_name) AS entity_id, max(l_discount * 10) AS strength, arg_max(l_returnflag, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + ascii(l_returnflag)) AS context FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def e03(spark, d):
    return E.upsert_links(_mentions(spark, d).withColumn("entity_id", F.lower("name")))


@query("e04_apply_normalizations", with_("links") + ", m AS (SELECT note_id, CASE WHEN entity_id % 10 IN (3, 7) THEN entity_id - entity_id % 10 + 1 ELSE entity_id END AS entity_id, strength FROM links) SELECT note_id, entity_id, max(strength) AS strength FROM m GROUP BY 1, 2")
def e04(spark, d):
    e = B.entities(spark, d)
    chain = e.where("entity_id % 10 = 3").select(F.col("entity_id").alias("variant"), (F.col("entity_id") + 4).alias("canonical")).union(e.where("entity_id % 10 = 7").select("entity_id", F.col("entity_id") - 6))
    return E.apply_normalizations(chain, e, B.links(spark, d), B.edges(spark, d), of=B.read(spark, d, "lineitem"))[1].select("note_id", "entity_id", "strength")


@query("e06_search_entities", with_("entities") + " SELECT entity_id, canonical_name FROM entities WHERE contains(lower(canonical_name), 'red') OR contains(lower(aliases[1]), 'red') ORDER BY canonical_name, entity_id LIMIT 20")
def e06(spark, d):
    return E.search_entities(B.entities(spark, d), "Red").select("entity_id", "canonical_name")


@query("e07_entities_for_notes", with_("links", "entities") + " SELECT note_id, entity_id, canonical_name, strength FROM links JOIN entities USING (entity_id) WHERE note_id <= 100")
def e07(spark, d):
    return E.entities_for_notes(B.links(spark, d), B.entities(spark, d), B.notes(spark, d).where("note_id <= 100")).select("note_id", "entity_id", "canonical_name", "strength")


@query("e08_apply_revisions", "SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new ' || o_orderstatus || '. more' ELSE o_orderpriority END AS summary, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) || ',extra,' || o_orderstatus ELSE o_orderpriority || ',' || o_orderstatus END AS entities FROM orders")
def e08(spark, d):
    o = B.read(spark, d, "orders")
    n = o.select(F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("summary"), F.array("o_orderpriority", "o_orderstatus").alias("entities"))
    r = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("note_id"), F.concat(F.lit("new "), "o_orderstatus").alias("new_summary"), F.array(F.upper("o_orderpriority"), F.lit("extra")).alias("new_entities"), F.lit("more").alias("context"))
    return E.apply_revisions(n, r).select("note_id", "summary", F.array_join("entities", ",").alias("entities"))


# --- graph


@query("g01_build_edges", with_("edges") + " SELECT from_id, to_id, edge_type, max(weight) AS weight, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM (SELECT from_id // 2 AS from_id, to_id, edge_type, weight, start_ts, end_ts FROM edges) GROUP BY 1, 2, 3")
def g01(spark, d):
    e = B.edges(spark, d).withColumns({"from_id": F.floor(F.col("from_id") / 2).cast("long"), "evidence": F.array("from_id")})
    return G.merge_edges(e).select("from_id", "to_id", "edge_type", "weight", "start_ts", "end_ts")


@query("g02_cooccurrence", with_("links") + ", c AS (SELECT a.entity_id AS from_id, b.entity_id AS to_id, count(*) AS support FROM links a JOIN links b ON a.note_id = b.note_id AND a.entity_id < b.entity_id GROUP BY 1, 2) SELECT from_id, to_id, support, round(support / (SELECT max(support) FROM c), 6) AS weight FROM c")
def g02(spark, d):
    return G.cooccurrence_edges(B.links(spark, d))


@query("g03_edges_by_type", with_("edges") + " SELECT from_id, to_id, weight FROM edges WHERE edge_type = 'USED_APP' ORDER BY weight DESC, from_id, to_id, edge_type LIMIT 50")
def g03(spark, d):
    return G.edges_by_type(B.edges(spark, d), ["USED_APP"], 50).select("from_id", "to_id", "weight")


_EXPAND = with_("edges") + """, v AS (SELECT from_id, to_id, weight * CASE edge_type WHEN 'ABOUT_TOPIC' THEN 1.0 WHEN 'CO_OCCURRED_WITH' THEN 0.9 ELSE 0.8 END AS pull FROM edges WHERE weight >= 0.3),
b AS (SELECT from_id, to_id, pull FROM v UNION ALL SELECT to_id, from_id, pull FROM v), h0 AS (SELECT p_partkey AS id FROM part WHERE p_partkey IN (200, 201)),
h1 AS (SELECT to_id AS id, max(pull) AS r FROM b WHERE from_id IN (SELECT id FROM h0) AND to_id NOT IN (SELECT id FROM h0) GROUP BY 1),
h2 AS (SELECT to_id AS id, max(pull / 2) AS r FROM b WHERE from_id IN (SELECT id FROM h1) AND to_id NOT IN (SELECT id FROM h0) AND to_id NOT IN (SELECT id FROM h1) GROUP BY 1)"""


@query("g04_expand", _EXPAND + " SELECT * FROM (SELECT id AS entity_id, 1 AS hop, round(r, 6) AS relevance FROM h1 UNION ALL SELECT id, 2, round(r, 6) FROM h2) ORDER BY relevance DESC, hop, entity_id LIMIT 100")
def g04(spark, d):
    return G.expand(B.entities(spark, d).where("entity_id in (200, 201)"), B.edges(spark, d), 2, n=100)


@query("g06_expand_from_note", with_("edges", "links") + """, s AS (SELECT entity_id AS id FROM links WHERE note_id = (SELECT min(note_id) FROM links) AND strength >= 0.3), v AS (SELECT from_id, to_id, weight * CASE edge_type WHEN 'ABOUT_TOPIC' THEN 1.0 WHEN 'CO_OCCURRED_WITH' THEN 0.9 ELSE 0.8 END AS pull FROM edges WHERE weight >= 0.3),
b AS (SELECT from_id, to_id, pull FROM v UNION ALL SELECT to_id, from_id, pull FROM v) SELECT to_id AS entity_id, 1 AS hop, round(max(pull), 6) AS relevance FROM b WHERE from_id IN (SELECT id FROM s) AND to_id NOT IN (SELECT id FROM s) GROUP BY 1 ORDER BY relevance DESC, hop, entity_id LIMIT 50""")
def g06(spark, d):
    ln = B.links(spark, d)
    note = ln.agg(F.min("note_id").alias("note_id"))
    seeds = ln.join(note, "note_id", "left_semi").where("strength >= 0.3")
    return G.expand(seeds, B.edges(spark, d), 1, n=50)


@query("g07_paths", with_("edges") + ", b AS (SELECT DISTINCT from_id, to_id FROM (SELECT from_id, to_id FROM edges WHERE weight >= 0.9 UNION ALL SELECT to_id, from_id FROM edges WHERE weight >= 0.9)), p2 AS (SELECT '200>' || x.to_id || '>' || y.to_id AS path, 2 AS hops FROM b x JOIN b y ON x.to_id = y.from_id WHERE x.from_id = 200 AND y.to_id = 300), p1 AS (SELECT '200>300' AS path, 1 AS hops FROM b WHERE from_id = 200 AND to_id = 300), p3 AS (SELECT '200>' || x.to_id || '>' || y.to_id || '>' || z.to_id AS path, 3 AS hops FROM b x JOIN b y ON x.to_id = y.from_id JOIN b z ON y.to_id = z.from_id WHERE x.from_id = 200 AND z.to_id = 300 AND x.to_id <> 300 AND y.to_id NOT IN (200, 300) AND x.to_id <> y.to_id AND x.to_id <> 200), a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) SELECT path, CAST(hops AS INT) AS hops FROM a WHERE hops = (SELECT min(hops) FROM a)")
def g07(spark, d):
    return G.paths(B.edges(spark, d).where("weight >= 0.9"), 200, 300).select("path", "hops")


@query("g07_paths_of_two_parts", with_("edges") + """, b AS MATERIALIZED (SELECT from_id, to_id FROM edges WHERE weight >= 0.5 UNION SELECT to_id, from_id FROM edges WHERE weight >= 0.5),
p AS (SELECT '150>120' AS path, 1 AS hops FROM b WHERE from_id = 150 AND to_id = 120 UNION ALL SELECT '150>' || x.to_id || '>120', 2 FROM b x JOIN b y ON x.to_id = y.from_id WHERE x.from_id = 150 AND y.to_id = 120
  UNION ALL SELECT '150>' || x.to_id || '>' || y.to_id || '>120', 3 FROM b x JOIN b y ON x.to_id = y.from_id JOIN b z ON y.to_id = z.from_id WHERE x.from_id = 150 AND z.to_id = 120 AND x.to_id NOT IN (150, 120) AND y.to_id NOT IN (150, 120, x.to_id))
SELECT path, CAST(hops AS INT) AS hops FROM p WHERE hops = (SELECT min(hops) FROM p)""")
def g07_parts(spark, d):
    return G.paths(B.edges(spark, d).where("weight >= 0.5"), 150, 120)


@query("g08_entity_context", with_("edges", "links", "notes") + " SELECT (SELECT count(*) FROM edges WHERE from_id = 50) AS n_out, (SELECT count(*) FROM edges WHERE to_id = 50) AS n_in, (SELECT string_agg(CAST(note_id AS VARCHAR), ',' ORDER BY start_ts DESC, note_id) FROM (SELECT note_id, start_ts FROM links JOIN notes USING (note_id) WHERE entity_id = 50 ORDER BY start_ts DESC, note_id LIMIT 10)) AS notes")
def g08(spark, d):
    return G.entity_context(50, B.edges(spark, d), B.links(spark, d), B.notes(spark, d))


_DEG = with_("edges", "links").replace("edges AS (", "edges AS MATERIALIZED (").replace("links AS (", "links AS MATERIALIZED (") + ", x AS (SELECT from_id AS id FROM edges WHERE weight >= 0.3 UNION ALL SELECT to_id FROM edges WHERE weight >= 0.3 AND from_id <> to_id), dg AS MATERIALIZED (SELECT p_partkey AS entity_id, count(x.id) AS degree FROM part LEFT JOIN x ON x.id = p_partkey GROUP BY 1), nn AS (SELECT entity_id, count(DISTINCT note_id) AS notes FROM links GROUP BY 1), tp AS MATERIALIZED (SELECT dg.entity_id, degree, coalesce(notes, 0) AS notes FROM dg LEFT JOIN nn USING (entity_id) WHERE degree > 0 OR notes > 0 ORDER BY degree DESC, notes DESC, entity_id LIMIT 50)"


@query("g10_graph_view", _DEG + " SELECT * FROM tp")
def g10(spark, d):
    return G.graph_view(B.entities(spark, d), B.edges(spark, d), B.links(spark, d), B.notes(spark, d))[0]


@query("g10_graph_view_edges", _DEG + " SELECT e.from_id, e.to_id, e.edge_type FROM edges e JOIN tp a ON e.from_id = a.entity_id JOIN tp b ON e.to_id = b.entity_id WHERE e.weight >= 0.3")
def g10e(spark, d):
    return G.graph_view(B.entities(spark, d), B.edges(spark, d), B.links(spark, d), B.notes(spark, d))[1].select("from_id", "to_id", "edge_type")


@query("g11_entity_details", with_("edges", "entities") + ", n AS (SELECT to_id AS other_id, edge_type, 'out' AS direction, weight FROM edges WHERE from_id = 50 UNION ALL SELECT from_id, edge_type, 'in', weight FROM edges WHERE to_id = 50 AND from_id <> to_id) SELECT other_id, canonical_name, edge_type, direction, weight FROM n JOIN entities ON entity_id = other_id ORDER BY weight DESC, other_id, edge_type, direction LIMIT 20")
def g11(spark, d):
    return G.entity_details(B.entities(spark, d).where("entity_id = 50"), B.edges(spark, d), B.entities(spark, d))


# --- vectors

_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _query_vector(spark, d):
    return [float(x) for x in B.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query("v01_knn_l2", f"WITH {_Q} SELECT vec_id, round(dist, 6) AS distance, round(1 / (1 + dist), 6) AS score FROM (SELECT vec_id, list_distance(e, q) AS dist FROM v, q) ORDER BY dist, vec_id LIMIT 20")
def v01(spark, d):
    return V.knn(B.read(spark, d, "embeddings"), _query_vector(spark, d), 20).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("v02_knn_cosine", f"WITH {_Q} SELECT vec_id, round(1 - least(1 - list_cosine_similarity(e, q), 1.0), 6) AS score FROM v, q ORDER BY 1 - list_cosine_similarity(e, q), vec_id LIMIT 20")
def v02(spark, d):
    return V.knn(B.read(spark, d, "embeddings"), _query_vector(spark, d), 20, "cosine").select("vec_id", F.round("score", 6).alias("score"))


@query("v03_semantic_search", f"WITH {_Q} SELECT vec_id, round(list_distance(e, q), 6) AS distance, source FROM v JOIN documents ON doc_id = vec_id, q WHERE label < 5 AND 1 / (1 + list_distance(e, q)) >= 0.4 ORDER BY list_distance(e, q), vec_id LIMIT 20")
def v03(spark, d):
    rows = B.read(spark, d, "embeddings").join(B.read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    return V.knn(rows, _query_vector(spark, d), 20, where=F.col("label") < 5, min_score=0.4).select("vec_id", F.round("distance", 6).alias("distance"), "source")


def _tree(spark, d):
    v = B.read(spark, d, "embeddings").select(F.col("label").alias("parent_id"), "vec_id", "embedding")
    first = v.groupBy("parent_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first, v


_TREE = f"WITH {_Q}, par AS (SELECT label, arg_min(e, vec_id) AS e FROM v GROUP BY 1), ps AS (SELECT label, 1 - least(1 - list_cosine_similarity(e, q), 1.0) AS s, 1 - list_cosine_similarity(e, q) AS dist FROM par, q), tp AS (SELECT * FROM ps ORDER BY dist, label LIMIT 6), cs AS (SELECT v.label, vec_id, 1 - least(1 - list_cosine_similarity(e, q), 1.0) AS s FROM v, q)"


@query("v04_hierarchical_search", _TREE + ", r AS (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM cs WHERE label IN (SELECT label FROM tp) QUALIFY r <= 3), m AS (SELECT label, avg(s) AS a, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY r) AS children FROM r GROUP BY 1) SELECT label AS parent_id, round(0.6 * tp.s + 0.4 * a, 6) AS relevance, children FROM tp JOIN m USING (label) ORDER BY relevance DESC, parent_id LIMIT 3")
def v04(spark, d):
    parents, children = _tree(spark, d)
    return V.hierarchical_search(parents, children, _query_vector(spark, d))


@query("v05_hierarchical_fallback", _TREE + ", b AS (SELECT * FROM cs ORDER BY s DESC, vec_id LIMIT 9) SELECT label AS parent_id, round(avg(s), 6) AS relevance, count(*) AS n FROM b GROUP BY 1 ORDER BY relevance DESC, parent_id LIMIT 3")
def v05(spark, d):
    return V.hierarchical_fallback(_tree(spark, d)[1], _query_vector(spark, d))


@query("v06_knn_join", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.e, b.e) AS dist FROM v a, v b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(dist, 5) AS distance, rank FROM r WHERE rank <= 5")
def v06(spark, d):
    e = B.read(spark, d, "embeddings")
    return V.knn_join(e.where("vec_id % 50 = 0"), e, 5).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query("v07_needs_embedding", with_("notes") + " SELECT note_id FROM notes WHERE note_id % 3 = 0 OR (note_id % 3 = 1 AND start_ts > TIMESTAMP '1998-01-01')")
def v07(spark, d):
    n = B.notes(spark, d).withColumnRenamed("start_ts", "updated_ts")
    e = n.where("note_id % 3 <> 0").select("note_id", F.when(F.col("note_id") % 3 == 1, F.lit("1998-01-01").cast("timestamp_ntz")).otherwise(F.col("updated_ts")).alias("embedded_ts"))
    return V.needs_embedding(n, e).select("note_id")


@query("v08_day_context", with_("notes") + " SELECT CAST(start_ts AS DATE) AS day, string_agg(CAST(note_id AS VARCHAR), ',' ORDER BY start_ts, note_id) AS note_ids FROM notes GROUP BY 1", dates=("day",))
def v08(spark, d):
    return V.day_context(B.notes(spark, d))


# --- integrity


_CHECKED = with_("notes", "links", "edges") + ", k AS (SELECT p_partkey AS id FROM part WHERE p_size > 2)"


def _issues(spark, d):
    n = B.notes(spark, d).withColumn("payload", F.when(F.col("note_id") % 500 == 0, "{bad").otherwise("{}"))
    known = B.entities(spark, d).join(B.read(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("entity_id")), "entity_id", "left_semi")
    return n, I.integrity_issues(n, n.where("note_id % 7 <> 0"), known, B.links(spark, d), B.edges(spark, d))


_ISSUES = _CHECKED + """, iss AS (SELECT CAST(start_ts AS DATE) AS day, 'invalid_json' AS issue FROM notes WHERE note_id % 500 = 0 UNION ALL SELECT CAST(start_ts AS DATE), 'missing_embedding' FROM notes WHERE note_id % 7 = 0
UNION ALL (SELECT DISTINCT CAST(start_ts AS DATE), 'missing_daily_note' FROM notes WHERE note_type = 'hour' AND CAST(start_ts AS DATE) NOT IN (SELECT CAST(start_ts AS DATE) FROM notes WHERE note_type = 'day'))
UNION ALL SELECT CAST(n.start_ts AS DATE), 'orphaned_link' FROM links l JOIN notes n USING (note_id) WHERE l.entity_id NOT IN (SELECT id FROM k)
UNION ALL SELECT CAST(start_ts AS DATE), 'orphaned_edge' FROM edges WHERE from_id NOT IN (SELECT id FROM k) UNION ALL SELECT CAST(start_ts AS DATE), 'orphaned_edge' FROM edges WHERE to_id NOT IN (SELECT id FROM k)),
rep AS (SELECT d.day, count(*) FILTER (issue = 'invalid_json') AS invalid_json, count(*) FILTER (issue = 'missing_embedding') AS missing_embedding, count(*) FILTER (issue = 'missing_daily_note') AS missing_daily_note, count(*) FILTER (issue = 'orphaned_edge') AS orphaned_edge, count(*) FILTER (issue = 'orphaned_link') AS orphaned_link, count(*) FILTER (issue IN ('invalid_json', 'orphaned_edge', 'orphaned_link')) AS errors FROM (SELECT DISTINCT CAST(start_ts AS DATE) AS day FROM notes) d LEFT JOIN iss ON iss.day = d.day GROUP BY 1)"""


@query("i01_integrity_report", _ISSUES + " SELECT *, errors = 0 AS passed FROM rep", dates=("day",))
def i01(spark, d):
    n, issues = _issues(spark, d)
    return I.integrity_report(issues, n.select(F.to_date("start_ts").alias("day")))


@query("i02_safe_days", _ISSUES + " SELECT day FROM rep WHERE errors = 0", dates=("day",))
def i02(spark, d):
    n, issues = _issues(spark, d)
    return I.safe_days(I.integrity_report(issues, n.select(F.to_date("start_ts").alias("day"))))


@query("i03_purge", "SELECT CAST(ts AS DATE) AS day, count(*) AS deleted FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-24' AND day(ts) % 2 = 0 GROUP BY 1", dates=("day",))
def i03(spark, d):
    e = B.read(spark, d, "events")
    safe = e.select(F.to_date("ts").alias("day")).distinct().where("day(day) % 2 = 0")
    return I.purge(e, safe, 7, "2024-01-31 10:00:00")[1]


@query("i04_deletion_history", "SELECT 'events' AS table_name, CAST(ts AS DATE) AS day, count(*) AS deleted FROM events GROUP BY 2 ORDER BY day DESC LIMIT 10", dates=("day",))
def i04(spark, d):
    return I.deletion_history(B.read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("deleted")).withColumn("table_name", F.lit("events")), 10)


@query("i05_audit_constraints", "SELECT 'domain_l_returnflag' AS rule, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS violations FROM lineitem UNION ALL SELECT 'range_l_discount', count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.08) FROM lineitem UNION ALL SELECT 'unique_key', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey)")
def i05(spark, d):
    return I.audit_constraints(B.read(spark, d, "lineitem"), {"l_returnflag": ["A", "N"]}, {"l_discount": (0.0, 0.08)}, ["l_orderkey", "l_partkey"])


@query("i06_missing_hours", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS rows FROM events GROUP BY 1 HAVING count(*) >= 5) SELECT hour, rows FROM h WHERE hour < TIMESTAMP '2024-01-20 10:00:00' AND hour NOT IN (SELECT date_trunc('hour', ts) FROM events WHERE event_id % 40 = 0) ORDER BY hour LIMIT 10")
def i06(spark, d):
    e = B.read(spark, d, "events")
    done = e.where("event_id % 40 = 0").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return I.missing_hours(e, done, "2024-01-20 10:30:00")


@query("i07_pending_windows", "SELECT DISTINCT date_trunc('day', ts) AS window_start FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_id % 400 = 0)")
def i07(spark, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start")
    e = B.read(spark, d, "events")
    return I.pending_windows(e.select(day).distinct(), e.where("event_id % 400 = 0").select(day).distinct(), ["window_start"])


# --- prebuilt pipelines


@query("p5_timeline", with_("notes") + " SELECT note_id, start_ts, status FROM notes WHERE start_ts BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31' ORDER BY start_ts, note_id LIMIT 200")
def p5(spark, d):
    return L.timeline(B.notes(spark, d), "1997-03-01", "1997-03-31", 200).select("note_id", "start_ts", "status")


@query("p6_entity_profile", with_("edges", "links") + " SELECT p_partkey AS entity_id, (SELECT count(*) FROM links WHERE entity_id = p_partkey) AS notes, (SELECT count(*) FROM edges WHERE from_id = p_partkey) AS n_out, (SELECT count(*) FROM edges WHERE to_id = p_partkey) AS n_in FROM part")
def p6(spark, d):
    return L.entity_profiles(B.entities(spark, d), B.links(spark, d), B.edges(spark, d))


@query("p7_most", with_("rollup") + " SELECT key, round(sum(value), 4) AS value FROM agg WHERE key_type = 'app' GROUP BY key ORDER BY value DESC, key LIMIT 1")
def p7(spark, d):
    return A.top_by_key_type(_rollup(spark, d), "app", 1).select("key", "value")


@query("p1_relationship", f"WITH {_Q}, fl AS (SELECT vec_id, list_distance(e, q) AS dist FROM v, q ORDER BY dist, vec_id LIMIT 15), cs AS (SELECT vec_id, 1 - list_cosine_similarity(e, q) AS dist FROM v, q ORDER BY dist, vec_id LIMIT 15) SELECT coalesce(fl.vec_id, cs.vec_id) AS vec_id, CASE WHEN fl.vec_id IS NOT NULL THEN 0 ELSE 1 END AS source_rank FROM fl FULL JOIN cs ON fl.vec_id = cs.vec_id")
def p1(spark, d):
    return L.recall(B.read(spark, d, "embeddings"), _query_vector(spark, d), 15).select("vec_id", "source_rank")


@query("p3_comparison", with_("rollup") + f" SELECT coalesce(x.key_type, y.key_type) AS key_type, coalesce(x.key, y.key) AS key, CASE WHEN value_b IS NULL THEN 'only_a' WHEN value_a IS NULL THEN 'only_b' ELSE 'both' END AS status FROM {_top_cte('2024-01-01', '2024-01-15', 'value_a')} x FULL JOIN {_top_cte('2024-01-16', '2024-01-31', 'value_b')} y ON x.key_type = y.key_type AND x.key = y.key WHERE coalesce(x.key_type, y.key_type) IN ('app', 'category')")
def p3(spark, d):
    return L.comparison(_rollup(spark, d), ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31")).select("key_type", "key", "status")


@query("p4_correlation", with_("spans") + ", n AS (SELECT app_id, lead(app_id) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS after_app FROM spans) SELECT app_id, after_app, count(*) AS n FROM n WHERE after_app IS NOT NULL AND app_id = 'click' GROUP BY 1, 2")
def p4(spark, d):
    return L.correlation(B.spans(spark, d), "click")


# --- payloads


def _payloads(spark, d):
    o = B.read(spark, d, "orders")
    topic = F.struct(F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 5 == 0, 1.5).alias("confidence"))
    activity = F.struct(F.when(F.col("o_orderkey") % 7 == 0, "late").otherwise("09:15").alias("time_start"), F.concat(F.lit("work "), "o_orderstatus").alias("description"))
    text = F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("summary"), F.array(topic).alias("topics"), F.array(activity).alias("activities")))
    return o.select(F.col("o_orderkey").alias("note_id"), F.col("o_orderdate").alias("start_ts"), F.when(F.col("o_orderkey") % 11 == 0, "{broken").otherwise(text).alias("payload"))


@query("f09_validate_payloads", "SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not JSON' WHEN o_orderkey % 3 = 0 THEN 'no summary' WHEN o_orderkey % 5 = 0 THEN 'confidence' WHEN o_orderkey % 7 = 0 THEN 'time' ELSE 'valid' END AS outcome FROM orders")
def f09(spark, d):
    from lumenlog.operators.payload import validate_payloads

    valid, aside = validate_payloads(_payloads(spark, d))
    return valid.select("note_id", F.lit("valid").alias("outcome")).union(aside.select("note_id", "problem"))


@query("f15_tag_documents", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'code' WHEN 2 THEN 'gdoc' END AS document_type, CASE WHEN p_partkey % 4 = 1 THEN '/Users/x/' || replace(p_name, ' ', '_') || '.py' END AS document_path, CASE p_partkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 ELSE 0.0 END AS document_confidence FROM part")
def f15(spark, d):
    from lumenlog.operators.payload import tag_documents

    m = F.col("p_partkey") % 4
    p = B.read(spark, d, "part").select("p_partkey", F.when(m == 0, "com.apple.Preview").otherwise("x").alias("app_id"), F.when(m == 1, F.concat(F.lit("/Users/x/"), F.regexp_replace("p_name", " ", "_"), F.lit(".py"))).when(m == 2, F.concat("p_name", F.lit(" - Google Docs"))).otherwise(F.col("p_name")).alias("window_title"))
    return tag_documents(p).select("p_partkey", "document_type", "document_path", F.col("document_confidence").cast("double").alias("document_confidence"))


@query("f20_embedding_text", """SELECT o_orderkey AS note_id, 'Time: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || chr(10) || o_orderstatus || chr(10) || 'Activities: work ' || o_orderstatus || chr(10) || 'Topics: ' || o_orderpriority AS text
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def f20(spark, d):
    from lumenlog.operators.payload import embedding_text, validate_payloads

    return embedding_text(validate_payloads(_payloads(spark, d))[0])


@query("f21_timeline_text", _CLIP + " SELECT user_id, CAST(hour AS TIMESTAMP) AS hour, string_agg(strftime(greatest(start_ts, hour), '%H:%M') || ' ' || app_id || coalesce(' ' || window_title, ''), chr(10) ORDER BY greatest(start_ts, hour), event_id) AS timeline FROM c WHERE seconds > 0 GROUP BY 1, 2")
def f21(spark, d):
    from lumenlog.operators.payload import timeline_text

    return timeline_text(W.clip_to_hours(B.spans(spark, d)))


@query("a20_dashboard", with_("spans", "links", "entities") + " SELECT 'apps' AS report, count(DISTINCT app_id) AS n FROM spans UNION ALL SELECT 'topics', least(20, (SELECT count(DISTINCT canonical_name) FROM links JOIN entities USING (entity_id))) UNION ALL SELECT 'trend', (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) UNION ALL SELECT 'heatmap', 168 UNION ALL SELECT 'summary', 1")
def a20(spark, d):
    from lumenlog.operators.payload import dashboard
    from lumenlog.sources.tables import export_summary

    return export_summary(dashboard(B.spans(spark, d), B.samples(spark, d), B.links(spark, d), B.entities(spark, d))).withColumnRenamed("table_name", "report")
