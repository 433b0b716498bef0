"""Tables kept up by increments: equal to whole runs, written by what a batch has, whole or not at all."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import incremental as N
from lumenlog.operators.rollups import daily_rollup, rollup_periods
from lumenlog.sources.merge_table import MergeTable, hash_bucket, keep_latest


def latest(spark, path, **more):
    return MergeTable(spark, f"file://{path}", keep_latest(["k"], ["t"]), hash_bucket(["k"], 4), **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, t long, v string")


def written(path):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def test_latest_rows_over_many_batches(spark, tmp_path):
    rng, table, all_rows = random.Random(1), latest(spark, tmp_path / "t", max_segments=3), []
    for i in range(7):
        rows = [(rng.randrange(30), rng.randrange(20), f"{i}-{j}") for j in range(rng.choice([0, 4, 20]))]
        rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
        table.apply(frame(spark, rows), i)
        if i % 2:
            table.apply(frame(spark, rows), i)  # run again
        all_rows += [(i, *r) for r in rows]
        want = {}
        for b, k, t, v in all_rows:
            if k not in want or (t, b) >= (want[k][0], want[k][1]):
                want[k] = (t, b, v)
        assert sorted(map(tuple, table.read().collect())) == sorted((k, t, v) for k, (t, _, v) in want.items())
        assert all(len(p) <= 3 for p in table.manifest()["live"].values())


def test_a_batch_that_dies_leaves_the_table(spark, tmp_path):
    table = latest(spark, tmp_path / "t")
    table.apply(frame(spark, [(1, 1, "a")]), 0)

    def die(manifest):
        raise RuntimeError("gone")

    broken = latest(spark, tmp_path / "t")
    broken._commit = die
    with pytest.raises(RuntimeError):
        broken.apply(frame(spark, [(1, 2, "b"), (2, 2, "c")]), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, 1, "a")]
    table.apply(frame(spark, [(1, 2, "b")]), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2, "b")] and [tuple(r) for r in table.read(version=0).collect()] == [(1, 1, "a")]


def test_what_is_written_follows_the_batch(spark, tmp_path):
    table = latest(spark, tmp_path / "t")
    table.apply(spark.range(50_000).selectExpr("id as k", "1L as t", "sha2(string(id), 256) as v"), 0)
    before = written(tmp_path / "t")
    table.apply(frame(spark, [(7, 9, "new")]), 1)
    assert written(tmp_path / "t") - before < before / 100
    assert table.read().where("k = 7").collect()[0].v == "new" and table.read().count() == 50_000
    one = table.read(buckets=table.dirty(0))
    assert len(table.dirty(0)) == 1 and all(f"bucket={table.dirty(0)[0]}" in f for f in one.inputFiles())


def test_old_versions_go(spark, tmp_path):
    table = latest(spark, tmp_path / "t", keep=2, max_segments=2)
    for i in range(8):
        table.apply(frame(spark, [(1, i, str(i))]), i)
    assert table.versions() == [6, 7] and table.read().collect()[0].v == "7"
    assert len(os.listdir(tmp_path / "t" / "segments")) <= 8
    with pytest.raises(ValueError):
        table.apply(frame(spark, []).withColumn("bucket", F.lit(1)), 9)


ACTIVITIES = "day date, category string, app string, domain string, topic string, confidence double, media string, minutes double"


def activities(rng, days):
    return [(date(2024, 1, 1) + timedelta(days=rng.choice(days)), rng.choice("xy"), rng.choice(["a", "b", None]), None, rng.choice(["t", ""]), rng.choice([None, 0.5, 1.0]), None, float(rng.randrange(60))) for _ in range(60)]


def rows(df):
    return sorted(tuple(str(x) if not isinstance(x, float) else round(x, 3) for x in r) for r in df.collect())


def test_rollups_with_late_rows_equal_a_whole_run(spark, tmp_path):
    rng = random.Random(2)
    daily, periods = N.daily_table(spark, f"file://{tmp_path}/d"), N.period_table(spark, f"file://{tmp_path}/p")
    seen = []
    for i, days in enumerate(([0, 1, 2, 40], [2, 3, 41], [0, 3])):  # later batches hold rows of earlier days
        batch = activities(rng, days)
        seen += batch
        touched = N.add_activities(daily, spark.createDataFrame(batch, ACTIVITIES), i)
        made = N.refresh_periods(daily, periods, i, i - 1)
        assert touched == sorted({str(r[0]) for r in batch}) == daily.dirty(i - 1)
        whole = daily_rollup(spark.createDataFrame(seen, ACTIVITIES), top=None)
        assert rows(daily.read().select(*whole.columns)) == rows(whole)
        p = rollup_periods(whole)
        assert rows(periods.read().select(*p.columns)) == rows(p)
    assert made == ["month-2024-01-01", "week-2024-01-01", "year-2024-01-01"]  # the week of days 40 and 41 was left alone
    again = activities(rng, [3])
    N.add_activities(daily, spark.createDataFrame(again, ACTIVITIES), 3, replace=True)  # rows of a day were changed
    whole = daily_rollup(spark.createDataFrame([r for r in seen if r[0] != date(2024, 1, 4)] + again, ACTIVITIES), top=None)
    assert rows(daily.read().select(*whole.columns)) == rows(whole)


def test_distinct_sketches_merge(spark, tmp_path):
    table = N.trend_table(spark, f"file://{tmp_path}/t")
    events = spark.range(120_000).selectExpr("timestamp'2024-01-30 00:00:00' + make_interval(0, 0, 0, int(id % 4)) as ts", "concat('app', id % 30000) as app_id", "id")
    for i in range(3):
        N.add_events(table, events.where(F.col("id") % 3 == i), i)
    got = {str(r.day): (r.events, r.apps) for r in N.trend(table).collect()}
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys(["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"], 30_000)
    assert all(abs(v[1] - 7_500) < 0.05 * 7_500 for v in got.values())  # three standard errors
    over = N.trend_over(table, "year").collect()[0]
    assert over.events == 120_000 and abs(over.apps - 30_000) < 0.05 * 30_000
    few = N.trend(table, ["2024-02-01"])
    assert [str(r.day) for r in few.collect()] == ["2024-02-01"] and all("2024-02" in f for f in few.inputFiles())
