"""The activity model over the given tables, for queries, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators.spans import lead_spans
from lumenlog.sources.scratch import spread


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, d, "events").withColumn("k", k)
    title = F.when(F.col("k") % 10 != 0, F.concat(F.lit("t"), (F.col("k") % 3).cast("string")))
    url = F.when(F.col("k") % 7 != 0, F.concat(F.lit("https://S"), (F.col("k") % 4).cast("string"), F.lit(".Example.com:8080/p")))
    return rows.select("event_id", "user_id", "ts", F.col("event_type").alias("app_id"), title.alias("window_title"), url.alias("url"), "value", "k")


def spans(spark: SparkSession, d: str) -> DataFrame:
    return lead_spans(samples(spark, d))


def links(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read(spark, d, "lineitem"), "l_orderkey")  # a note has few links
    return rows.groupBy(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("entity_id")).agg(F.max(F.col("l_discount") * 10).alias("strength"), F.max("l_returnflag").alias("context"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("canonical_name"), F.array("p_type").alias("aliases"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.when(F.col("o_orderkey") % 10 == 0, "day").otherwise("hour").alias("note_type"), F.col("o_orderdate").alias("start_ts"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("end_ts"), F.split("o_orderpriority", "-").alias("categories"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "ABOUT_TOPIC").when(F.col("l_returnflag") == "N", "CO_OCCURRED_WITH").otherwise("USED_APP")
    rows = spread(read(spark, d, "lineitem").withColumn("kind", kind), "l_partkey", "l_suppkey", "kind")
    return rows.groupBy(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("kind").alias("edge_type")).agg(F.max(F.col("l_discount") * 10).alias("weight"), F.min("l_shipdate").alias("start_ts"), F.max("l_shipdate").alias("end_ts"))


def activities(spark: SparkSession, d: str) -> DataFrame:
    m = F.expr("timestampdiff(SECOND, start_ts, end_ts) / 60.0D")
    return spans(spark, d).select(F.to_date("start_ts").alias("day"), F.concat(F.lit("c"), (F.col("k") % 6).cast("string")).alias("category"), F.col("app_id").alias("app"), F.when(F.col("url").isNotNull(), F.concat(F.lit("s"), (F.col("k") % 4).cast("string"), F.lit(".example.com"))).alias("domain"), F.col("window_title").alias("topic"), (F.col("k") / 100).alias("confidence"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("a"), (F.col("k") % 2).cast("string"), F.lit(" - t"), (F.col("k") % 9).cast("string"))).alias("media"), F.round(m, 0).alias("minutes"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints whose last digit alone varies between neighbours of a kind, so that near duplicates occur."""
    head = F.substring(F.sha2(F.concat(F.col("app_id"), (F.col("k") % 2).cast("string")), 256), 1, 63)
    last = F.substring(F.lit("0123456789abcdef"), F.col("k") % 16 + 1, F.lit(1))
    return samples(spark, d).withColumn("fingerprint", F.concat(head, last))


SQL = {
    "samples": """samples AS (SELECT event_id, user_id, ts, event_type AS app_id, CASE WHEN k % 10 <> 0 THEN 't' || CAST(k % 3 AS VARCHAR) END AS window_title,
  CASE WHEN k % 7 <> 0 THEN 'https://S' || CAST(k % 4 AS VARCHAR) || '.Example.com:8080/p' END AS url, value, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "spans": """spans AS (SELECT * FROM (SELECT event_id, user_id, ts AS start_ts, app_id, window_title, url, value, k, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM samples) WHERE end_ts IS NOT NULL)""",
    "links": "links AS (SELECT l_orderkey AS note_id, l_partkey AS entity_id, max(l_discount * 10) AS strength, max(l_returnflag) AS context FROM lineitem GROUP BY 1, 2)",
    "entities": "entities AS (SELECT p_partkey AS entity_id, p_brand AS entity_type, p_name AS canonical_name, [p_type] AS aliases FROM part)",
    "notes": "notes AS (SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 10 = 0 THEN 'day' ELSE 'hour' END AS note_type, o_orderdate AS start_ts, o_orderdate + INTERVAL 1 HOUR AS end_ts, string_split(o_orderpriority, '-') AS categories, o_orderstatus AS status, o_totalprice AS price FROM orders)",
    "edges": """edges AS (SELECT l_partkey AS from_id, l_suppkey AS to_id, CASE WHEN l_returnflag = 'A' THEN 'ABOUT_TOPIC' WHEN l_returnflag = 'N' THEN 'CO_OCCURRED_WITH' ELSE 'USED_APP' END AS edge_type,
  max(l_discount * 10) AS weight, min(l_shipdate) AS start_ts, max(l_shipdate) AS end_ts FROM lineitem GROUP BY 1, 2, 3)""",
    "activities": """activities AS (SELECT CAST(start_ts AS DATE) AS day, 'c' || CAST(k % 6 AS VARCHAR) AS category, app_id AS app, CASE WHEN url IS NOT NULL THEN 's' || CAST(k % 4 AS VARCHAR) || '.example.com' END AS domain, window_title AS topic, k / 100.0 AS confidence,
  CASE WHEN k % 5 = 0 THEN 'a' || CAST(k % 2 AS VARCHAR) || ' - t' || CAST(k % 9 AS VARCHAR) END AS media, round((epoch_us(end_ts) - epoch_us(start_ts)) // 1000000 / 60.0, 0) AS minutes FROM spans)""",
    "frames": """frames AS (SELECT *, substr(sha256(app_id || CAST(k % 2 AS VARCHAR)), 1, 63) || substr('0123456789abcdef', k % 16 + 1, 1) AS fingerprint FROM samples)""",
    "rollup": """longs AS (SELECT day, 'category' AS key_type, category AS key, CAST(minutes AS DOUBLE) AS value FROM activities UNION ALL SELECT day, 'app', app, minutes FROM activities
  UNION ALL SELECT day, 'domain', domain, 1 FROM activities UNION ALL SELECT day, 'topic', topic, confidence * 60 FROM activities UNION ALL SELECT day, 'media', media, minutes FROM activities),
agg AS (SELECT day, key_type, key, round(sum(value), 4) AS value FROM longs WHERE key IS NOT NULL AND key <> '' GROUP BY ALL)""",
}
NEEDS = {"spans": ["samples"], "activities": ["samples", "spans"], "frames": ["samples"], "rollup": ["samples", "spans", "activities"]}


def with_(*names: str, recursive: bool = False) -> str:
    """WITH clause with the named tables and what they need."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in order)
