"""Rollups kept up by increments: partial states per window, merged; only windows that new rows touch are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators.rollups import daily_rollup, rollup_periods
from lumenlog.sources.merge_table import Merge, MergeTable

LG_K = 12  # of distinct sketches: 4,096 registers, a standard error of about 1.6 %
UNITS = ("week", "month", "year")


def fold(key: list[str], sums: list[str], sketches: list[str] = ()) -> Merge:
    """Adds up partial states of equal keys: sums are summed, distinct sketches united."""

    def merge(rows: DataFrame) -> DataFrame:
        parts = [F.sum(c).alias(c) for c in sums] + [F.hll_union_agg(c, F.lit(True)).alias(c) for c in sketches]
        return rows.groupBy(*key).agg(*parts, F.max("segment").alias("segment"))

    return merge


def daily_table(spark: SparkSession, path: str) -> MergeTable:
    """Sums by `(day, key_type, key)`, a bucket for each day."""
    return MergeTable(spark, path, fold(["day", "key_type", "key"], ["value"]), F.col("day"))


def period_table(spark: SparkSession, path: str) -> MergeTable:
    """Sums by period, a bucket for each period; always written whole."""
    key = ["period_type", "period_start", "key_type", "key"]
    return MergeTable(spark, path, fold(key, ["value"]), F.concat_ws("-", "period_type", F.col("period_start").cast("string")))


def trend_table(spark: SparkSession, path: str) -> MergeTable:
    """Events and a sketch of distinct apps by day, a bucket for each month."""
    return MergeTable(spark, path, fold(["day"], ["events"], ["apps"]), F.date_format("day", "yyyy-MM"))


def add_activities(daily: MergeTable, activities: DataFrame, batch_id: int, replace: bool = False) -> list[str]:
    """Adds the activities of a batch, early or late, to their days and returns those days. With `replace`, the
    batch is all that its days hold: that is how days whose rows were changed are computed again (I07)."""
    return daily.apply(daily_rollup(activities, top=None), batch_id, replace)


def refresh_periods(daily: MergeTable, periods: MergeTable, batch_id: int, since: int) -> list[str]:
    """Computes again the weeks, months and years that hold a day touched after batch `since`, from their days alone."""
    spark = daily.spark
    dirty, there = daily.dirty(since), sorted(daily.manifest()["live"])
    if not dirty:
        return []
    starts = lambda days: spark.createDataFrame([(d,) for d in days], "d string").select("d", F.explode(F.array(*[F.struct(F.lit(u).alias("period_type"), F.to_date(F.date_trunc(u, F.to_date("d"))).alias("period_start")) for u in UNITS])).alias("p")).select("d", "p.*")
    wanted = starts(dirty).select("period_type", "period_start").distinct()
    days = [r["d"] for r in starts(there).join(wanted, ["period_type", "period_start"], "left_semi").select("d").distinct().collect()]  # names of buckets of a manifest
    rows = rollup_periods(daily.read(days)).join(F.broadcast(wanted), ["period_type", "period_start"], "left_semi")
    return periods.apply(rows, batch_id, replace=True)


def add_events(trend: MergeTable, events: DataFrame, batch_id: int, ts: str = "ts", app: str = "app_id") -> list[str]:
    """Adds events to their days: counts, and the sketch of the apps that were seen."""
    states = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("events"), F.hll_sketch_agg(F.coalesce(F.col(app), F.lit("")), F.lit(LG_K)).alias("apps"))
    return trend.apply(states, batch_id)


def trend(table: MergeTable, days: list[str] | None = None) -> DataFrame:
    """`(day, events, apps)`, apps estimated from the sketch (exact while there are few)."""
    rows = table.read(None if days is None else sorted({d[:7] for d in days}))
    out = rows.select("day", "events", F.hll_sketch_estimate("apps").alias("apps"))
    return out if days is None else out.where(F.col("day").cast("string").isin(days))


def trend_over(table: MergeTable, unit: str) -> DataFrame:
    """The same by week, month or year: sketches of days unite, so distinct apps of a period need no events."""
    rows = table.read().groupBy(F.to_date(F.date_trunc(unit, "day")).alias("period_start"))
    return rows.agg(F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("apps")).alias("apps"))
