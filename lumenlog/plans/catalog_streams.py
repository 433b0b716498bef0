"""Streaming queries: the events table replayed as a file stream until its end, the sink's rows returned."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.plans import base as B
from lumenlog.plans.base import with_
from lumenlog.sources.scratch import shared_folder
from lumenlog.sources.tables import read_samples
from lumenlog.streaming import streams as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lumenlog-stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has and returns what it wrote to a table in the shared folder."""
    spark = stream.sparkSession
    path = _shared(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; a plain file is given as a pattern, which a file stream needs."""
    schema = B.read(spark, d, "events").schema
    e = read_samples(spark, f"{d}/events*.parquet", streaming=True, schema=schema)
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("app_id"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


@query("st3_stream_hourly", f"SELECT hour, app_id, events FROM (SELECT date_trunc('hour', ts) AS hour, event_type AS app_id, count(*) AS events FROM events GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= {_MARK}")
def st3(spark, d):
    return drain(T.stream_hourly(_stream(spark, d))).select(ntz("hour"), "app_id", "events")


@query("st4_stream_rates", f"""WITH w AS (SELECT user_id, ts, unnest(generate_series(0, 3)) AS i FROM events), s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, user_id FROM w)
SELECT start, user_id, count(*) AS events FROM s WHERE start + INTERVAL 1 HOUR <= {_MARK} GROUP BY 1, 2""")
def st4(spark, d):
    return drain(T.stream_rates(_stream(spark, d))).select(ntz("start"), "user_id", "events")


@query("st4_stream_sessions", f"""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS events FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {_MARK}""")
def st4s(spark, d):
    return drain(T.stream_sessions(_stream(spark, d))).select(ntz("start"), ntz("end"), "user_id", "events")


@query("st5_stream_blocklist", """WITH b AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/:]+)', 1)) AS pattern FROM pages WHERE page_id % 3 = 0)
SELECT event_id, user_id FROM (SELECT *, 'www.' || (SELECT min(pattern) FROM b) AS host, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS h FROM events) WHERE event_type <> 'click' AND NOT (h = 0 AND host IS NOT NULL)""")
def st5(spark, d):
    pages = B.read(spark, d, "pages").where("page_id % 3 = 0").select(F.lower(F.regexp_extract("url", "://([^/:]+)", 1)).alias("pattern")).distinct()
    bl = pages.select(F.lit("domain").alias("block_type"), "pattern", F.lit(True).alias("enabled"))
    bl = bl.unionByName(B.read(spark, d, "events").where("event_type = 'click'").select(F.lit("app").alias("block_type"), F.col("event_type").alias("pattern"), F.lit(True).alias("enabled")).distinct())
    first = pages.agg(F.min("pattern").alias("first"))
    s = _stream(spark, d).join(first, F.lit(True), "left")
    s = s.withColumn("domain", F.when(F.col("k") % 4 == 0, F.concat(F.lit("www."), "first")).otherwise("other.invalid"))
    return drain(T.stream_blocklist(s, bl)).select("event_id", "user_id")


@query("st1_stream_spans", f"""WITH l AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS n, lead(ts) OVER w AS nts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, lead(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nn FROM l)
SELECT user_id, min(ts) AS start_ts, max(nts) FILTER (nn = 1) AS end_ts, any_value(event_type) AS app_id, count(*) AS n_samples FROM g GROUP BY user_id, s HAVING max(nts) FILTER (nn = 1) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st1(spark, d):
    out = drain(T.stream_spans(_stream(spark, d)))
    return out.select("user_id", ntz("start_ts"), ntz("end_ts"), "app_id", "n_samples")


@query("st1_stream_spans_idle", f"""WITH l AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER w AS nts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l),
x AS (SELECT user_id, s, min(ts) AS start_ts, max(ts) AS last_ts, max(nts) AS next_ts, any_value(event_type) AS app_id, count(*) AS n_samples, bool_or(nts IS NULL) AS open FROM g GROUP BY user_id, s),
y AS (SELECT *, open OR next_ts - last_ts > INTERVAL 4 HOUR AS idle FROM x)
SELECT user_id, start_ts, CASE WHEN idle THEN last_ts ELSE next_ts END AS end_ts, app_id, n_samples FROM y WHERE CASE WHEN idle THEN last_ts + INTERVAL 4 HOUR < {_MARK} OR (NOT open AND next_ts <= {_MARK}) ELSE next_ts <= {_MARK} END""")
def st1i(spark, d):
    out = drain(T.stream_spans(_stream(spark, d), idle=4 * 3600))
    return out.select("user_id", ntz("start_ts"), ntz("end_ts"), "app_id", "n_samples")


@query("st2_stream_drop_dups_monitors", with_("frames") + ", n AS (SELECT event_id, user_id, k % 2 AS monitor, fingerprint, lag(fingerprint) OVER (PARTITION BY user_id, k % 2 ORDER BY ts, event_id) AS p FROM frames) SELECT user_id, monitor, event_id, p IS NOT NULL AND substr(fingerprint, 1, 63) = substr(p, 1, 63) AS is_dup FROM n")
def st2m(spark, d):
    s = _stream(spark, d).withColumn("monitor", F.col("k") % 2)
    head = F.substring(F.sha2(F.concat(F.col("app_id"), (F.col("k") % 2).cast("string")), 256), 1, 63)
    last = F.substring(F.lit("0123456789abcdef"), F.col("k") % 16 + 1, F.lit(1))
    return drain(T.stream_drop_dups(s.withColumn("fingerprint", F.concat(head, last)), key=("user_id", "monitor")))


@query("st2_stream_drop_dups", with_("frames") + ", n AS (SELECT event_id, fingerprint, lag(fingerprint) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM frames) SELECT event_id, p IS NOT NULL AND substr(fingerprint, 1, 63) = substr(p, 1, 63) AS is_dup FROM n")
def st2(spark, d):
    s = _stream(spark, d)
    head = F.substring(F.sha2(F.concat(F.col("app_id"), (F.col("k") % 2).cast("string")), 256), 1, 63)
    last = F.substring(F.lit("0123456789abcdef"), F.col("k") % 16 + 1, F.lit(1))
    return drain(T.stream_drop_dups(s.withColumn("fingerprint", F.concat(head, last)))).select("event_id", "is_dup")


@query("st6_stream_frame_span_join", """WITH l AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events), s AS (SELECT user_id, event_id AS span_id, ts AS start_ts, ts + INTERVAL 30 MINUTE AS end_ts FROM events WHERE event_id % 2 = 0)
SELECT f.user_id, f.event_id AS frame_id, s.span_id FROM events f JOIN s ON f.user_id = s.user_id AND f.ts >= s.start_ts AND f.ts < s.end_ts""")
def st6(spark, d):
    e = _stream(spark, d)
    s = _stream(spark, d).where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 30 minutes")).alias("end_ts"))
    return drain(T.stream_frame_span_join(e.withColumnRenamed("event_id", "frame_id"), s))


@query("st7_upsert_sink", "SELECT user_id, event_type AS app_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def st7(spark, d):
    path = _shared(spark)
    rows = _stream(spark, d).select("user_id", "app_id", "event_id", "value")
    write = T.upsert_sink(f"{path}/table", ["user_id", "app_id"], "event_id")
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return T.latest_version(spark, f"{path}/table")
