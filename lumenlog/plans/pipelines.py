"""Prebuilt pipelines: the composite questions as one DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.reports import entity_card
from lumenlog.operators.rollups import compare_periods, period_summary, top_by_key_type
from lumenlog.operators.sets import merge_results
from lumenlog.operators.vectors import hierarchical_search, knn


def recall(vectors: DataFrame, query: list[float], n: int = 15) -> DataFrame:
    """The nearest by l2 joined with the nearest by cosine, each once."""
    a = knn(vectors, query, n, "l2").select("vec_id")
    b = knn(vectors, query, n, "cosine").select("vec_id")
    return merge_results(a, b, key="vec_id", ts="vec_id")


def comparison(agg: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Apps and categories of two ranges of days."""
    return compare_periods(agg.where(F.col("key_type").isin("app", "category")), a, b)


def correlation(spans: DataFrame, app: str) -> DataFrame:
    """What follows an app."""
    w = Window.partitionBy("user_id").orderBy("start_ts", "event_id")
    return spans.select("app_id", F.lead("app_id").over(w).alias("after_app")).where("after_app is not null").where(F.col("app_id") == app).groupBy("app_id", "after_app").agg(F.count("*").alias("n"))


def timeline(notes: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """P5: notes of a range in order."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return notes.where(F.col("start_ts").between(t(a), t(b))).orderBy("start_ts", "note_id").limit(n)


def entity_profiles(entities: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity its notes and edges in either direction, for all entities at once."""
    count = lambda df, c, name: df.groupBy(F.col(c).alias("entity_id")).agg(F.count("*").alias(name))
    out = entities.select("entity_id")
    for df, c, name in ((links, "entity_id", "notes"), (edges, "from_id", "n_out"), (edges, "to_id", "n_in")):
        out = out.join(count(df, c, name), "entity_id", "left")
    return out.select("entity_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("notes", "n_out", "n_in")])


def recall_by_both(rows: DataFrame, parents: DataFrame, children: DataFrame, query: list[float], n: int = 10, days: int = 3) -> DataFrame:
    """P1, and with 15 notes and 7 days P2: the nearest notes, then those of the most relevant days, each once."""
    flat = knn(rows, query, n).select("vec_id")
    tree = hierarchical_search(parents, children, query, days).select(F.explode(F.split("children", ",").cast("array<long>")).alias("vec_id"))
    return merge_results(flat, tree, key="vec_id", ts="vec_id")


def comparison_report(rows: DataFrame, query: list[float], agg: DataFrame, a: tuple[str, str], b: tuple[str, str], n: int = 5) -> DataFrame:
    """`(part, key, value)`: the notes nearest to the question, the top apps and categories of both ranges, and what changed."""
    found = knn(rows, query, n).select(F.lit("note").alias("part"), F.col("vec_id").cast("string").alias("key"), F.round("distance", 5).alias("value"))
    for kind in ("app", "category"):
        top = top_by_key_type(agg, kind, n, a[0], b[1])
        found = found.union(top.select(F.lit(kind).alias("part"), "key", F.round("value", 2)))
    return found.union(comparison(agg, a, b).select(F.concat(F.lit("change:"), "status"), F.concat_ws(":", "key_type", "key"), F.col("delta")))


def correlation_of_found(rows: DataFrame, query: list[float], spans: DataFrame, n: int = 20) -> DataFrame:
    """Which apps follow the apps of the spans nearest to the question, over all spans, with their share."""
    near = knn(rows, query, n).select(F.col("vec_id").alias("event_id"))
    apps = spans.join(near, "event_id", "left_semi").select("app_id").distinct()
    w = Window.partitionBy("user_id").orderBy("start_ts", "event_id")
    pairs = spans.select("app_id", F.lead("app_id").over(w).alias("after_app")).where("after_app is not null").join(apps, "app_id", "left_semi")
    sums = pairs.groupBy("app_id", "after_app").agg(F.count("*").alias("n"))
    return sums.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("app_id")), 4))


def timeline_report(notes: DataFrame, agg: DataFrame, a: str, b: str, n: int, top: int = 3) -> DataFrame:
    """P5: `(part, rank, key, value)`: the notes of a range in order, and the top keys of each type in it."""
    rank = F.row_number().over(Window.orderBy("start_ts", "note_id")).cast("long")  # over at most n rows
    told = timeline(notes, a, b, n).select(F.lit("note").alias("part"), rank.alias("rank"), F.col("note_id").cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    inside = agg.where(F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    return told.union(period_summary(inside, top).select("key_type", "rank", "key", "value"))


def entity_report(entity, entities: DataFrame, edges: DataFrame, links: DataFrame, notes: DataFrame, agg: DataFrame, n: int = 10) -> DataFrame:
    """The card of an entity with the time that rollups know under its name."""
    name = entities.where(F.col("entity_id") == F.lit(entity)).select(F.lower("canonical_name").alias("name"))
    spent = agg.join(name, F.lower("key") == F.col("name"), "left_semi").groupBy("key_type").agg(F.round(F.sum("value"), 4).alias("value"))
    rank = F.row_number().over(Window.orderBy("key_type")).cast("long")  # a row a type
    return entity_card(entity, entities, edges, links, notes, n).union(spent.select(F.lit("time"), rank, "key_type", "value"))


def most_report(agg: DataFrame, key_type: str, entities: DataFrame, links: DataFrame, notes: DataFrame, n: int = 10) -> DataFrame:
    """The key of a type with the largest sum, with the newest notes that name an entity of that name."""
    top = top_by_key_type(agg, key_type, 1).select(F.col("key").alias("top_key"), "value")
    named = entities.join(top, F.lower("canonical_name") == F.lower("top_key")).select("entity_id", "top_key")
    found = links.join(named, "entity_id").join(notes.select("note_id", "start_ts"), "note_id").select("note_id", "start_ts", "top_key").distinct()
    latest = found.orderBy(F.col("start_ts").desc(), "note_id").limit(n)
    return top.join(latest, "top_key", "left")
