"""Segmented scans against plain windows over the whole key, and the plans they give."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlog.operators import spans as W
from lumenlog.operators.segments import block_piece, scan, time_piece


def rows(n=400, seed=3):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        user = rng.choice([None, 1, 1, 1, 1, 2, 3])
        out.append((user, t0 + timedelta(minutes=rng.randrange(60 * 24 * 3) if user != 3 else 5), i, rng.choice([None, "a", "a", "b"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "", "t", "u"])))
    return out


SCHEMA = "user_id long, ts timestamp, event_id long, app_id string, n int, window_title string"


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "year"])
def test_scan_against_windows(spark, unit):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("url", F.lit(None).cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"l": F.lag("app_id").over(w), "m": F.lead("n").over(w), "b": F.coalesce(F.sum("n").over(past), F.lit(0)), "last": F.last("n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    got = scan(df, ["user_id"], ["ts", "event_id"], time_piece("ts", unit), lag={"l": "app_id"}, lead={"m": "n"}, before={"b": F.col("n").cast("long")}, last={"last": F.col("n")})
    assert got.columns == want.columns
    key = lambda r: r.event_id
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])
    assert scan(df.limit(0), ["user_id"], ["ts"], lag={"l": "app_id"}).count() == 0 and key is not None


def test_spans_do_not_hang_on_the_pieces(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("url", F.lit(None).cast("string")).where("user_id is not null")
    key = lambda r: str(tuple(r))
    for build in (
        lambda p: W.build_spans(df, piece=p, keep_ids=3),
        lambda p: W.build_spans(df, piece=p, max_gap=600),
        lambda p: W.dwell(W.drop_consecutive_dups(df.withColumn("fp", F.sha2(F.coalesce("app_id", F.lit("")), 256)), "user_id", fp="fp", piece=p), "user_id", piece=p),
        lambda p: W.focus_sessions(df.withColumnsRenamed({"ts": "start_ts"}).withColumn("end_ts", F.col("start_ts") + F.expr("interval 5 minutes")), ["user_id"], minutes=1, max_gap=900, piece=p),
        lambda p: W.temporal_sequence(df.withColumnRenamed("ts", "start_ts"), "user_id", "app_id = 'a'", piece=p),
        lambda p: W.transition_matrix(df.withColumnRenamed("ts", "start_ts"), "user_id", piece=p),
    ):
        small, whole = build("hour").collect(), build("year").collect()
        assert len(small) > 0 and sorted(map(key, small)) == sorted(map(key, whole))


def test_budgets_do_not_hang_on_the_pieces(spark):
    df = spark.range(300).selectExpr("id", "id % 2 as k", "cast(id * 7 % 40 as int) as token_estimate")
    for f in (W.budget_snippets, W.budget_prefix):
        small = f(df, "k", ["id"], budget=800, cap=30, piece=block_piece("id", 8)) if f is W.budget_snippets else f(df, "k", ["id"], budget=800, piece=block_piece("id", 8))
        whole = f(df, "k", ["id"], budget=800, cap=30, piece=F.lit(0)) if f is W.budget_snippets else f(df, "k", ["id"], budget=800, piece=F.lit(0))
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect())) and small.count() > 10


def test_no_window_orders_a_whole_key(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("url", F.lit(None).cast("string"))
    plan = W.build_spans(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert windows and all("__piece" in part or "ts#" not in order for part, order in windows)
